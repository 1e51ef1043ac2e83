"""Queries against their SQL on odd rows."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries


def both(spark, tmp_path, name: str, table: str, rows: list[tuple], schema: str) -> tuple[Counter, Counter]:
    """The rows of a query and those of its SQL over one table."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = queries()[name](spark, str(tmp_path))
    columns = ", ".join(f'"{c}"' for c in got.columns)
    return Counter(map(tuple, got.collect())), Counter(con.execute(f"SELECT {columns} FROM ({oracle_sql()[name]})").fetchall())


@pytest.mark.parametrize("name", ["page_titles", "inline_groups"])
def test_references_without_a_semicolon(spark, tmp_path, name):
    pages = [(1, "https://a.example.com/", "<html><head><title>Salt &amp;&amp</title></head><body><p>a &lt b &quot;c&quot d &copy</p><p>&am &a &</p></body></html>")]
    got, sql = both(spark, tmp_path, name, "pages", pages, "page_id long, url string, html string")
    assert got == sql and (1, 7) in got if name == "page_titles" else got == sql


ODD = [
    "call 212-555-0123 or 1-212-555-0123, then +1 (212) 555-0123", "run 212-555-01234 is none, 212-555-0123;212-555-0124 are two", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 end", "card 4111 1111 1111 1111, longer 94111 1111 1111 11110",
    "123-45-6789 and 123-45-67890", ".212-555-0123 (212)555-0123x +(212) 555.0123", "212-555-0123 4567 890 é 212-555-0123", "", None, "none", "12125550123 1212-555-0123",
]


@pytest.mark.parametrize("name", ["pii_masked_text", "pii_card_counts"])
def test_masks_by_place(spark, tmp_path, name):
    docs = [(i, "en", "web", t) for i, t in enumerate(ODD)]
    got, sql = both(spark, tmp_path, name, "documents", docs, "doc_id long, lang string, source string, text string")
    assert got == sql


def test_mask_of_a_card_of_single_digits(spark):
    from harrow.operators import text_rules

    docs = spark.createDataFrame([("4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 end",)], "text string")
    assert text_rules.mask(docs).first()["masked"] == "[card hidden] end"


def test_the_store_keeps_its_own_number_of_entries(spark, tmp_path):
    from datetime import datetime

    events = [(i, 40, "view", 1.0, datetime(2024, 1, 1)) for i in range(2005)]
    got, sql = both(spark, tmp_path, "trace_prune", "events", events, "event_id long, user_id long, event_type string, value double, ts timestamp")
    assert got == sql and len(got) == 2000 and min(got) == (0, 5)
