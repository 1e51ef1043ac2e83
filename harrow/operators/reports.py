"""Reports as text: Markdown and HTML tables of small aggregates, and which model judges.

A report's table is an aggregate with a row for each scenario or task; ``rows`` takes ``limit`` of them at most to the driver and
says so in the report.
"""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

#: Rows of a table in a report; a longer one is cut with a note.
LIMIT = 1000


def rows(table: DataFrame, limit: int = LIMIT) -> tuple[list[tuple], bool]:
    got = table.limit(limit + 1).collect()
    return [tuple("" if v is None else str(v) for v in r) for r in got[:limit]], len(got) > limit


def markdown(title: str, tables: dict[str, DataFrame], limit: int = LIMIT) -> str:
    """A digest: a heading and a table for each of ``tables``, columns as they are named."""
    out = [f"# {title}", ""]
    for name, table in tables.items():
        body, more = rows(table, limit)
        cell = lambda v: v.replace("|", "\\|").replace("\n", " ")
        out += [f"## {name}", "", "| " + " | ".join(map(cell, table.columns)) + " |", "| " + " | ".join("---" for _ in table.columns) + " |"]
        out += ["| " + " | ".join(map(cell, r)) + " |" for r in body]
        out += [*([f"The first {limit} rows."] if more else []), ""]
    return "\n".join(out)


def page(title: str, tables: dict[str, DataFrame], limit: int = LIMIT) -> str:
    """The same as an HTML page; all values are escaped."""
    parts = []
    for name, table in tables.items():
        body, more = rows(table, limit)
        line = lambda tag, r: "<tr>" + "".join(f"<{tag}>{escape(v)}</{tag}>" for v in r) + "</tr>"
        note = f"<p>The first {limit} rows.</p>" if more else ""
        parts.append(f"<h2>{escape(name)}</h2><table>{line('th', table.columns)}{''.join(line('td', r) for r in body)}</table>{note}")
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{''.join(parts)}</body></html>"


def judge_model(given: str | None, scenario_default: str | None, default: str) -> str:
    """What is given, else what the scenarios name, else the default; an empty name counts as none."""
    return given or scenario_default or default
