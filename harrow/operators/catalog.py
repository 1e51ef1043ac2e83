"""The rule catalog as data: states, options, groups, pauses, denylists and what is enforced where."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import urls as U
from harrow.operators.page_rules import RULES

#: Option trees by rule: numbers and switches of its parts.
OPTIONS = {
    "encoded-payload-redact": {"base64": {"enabled": True, "min_length": 120}, "hex": {"enabled": True, "min_length": 160}, "percent": {"enabled": True, "min_length": 20}, "ciphers": {"enabled": True, "min_length": 80}, "leet": {"enabled": True, "min_length": 40}, "nato": {"enabled": True, "min_length": 10}, "morse": {"enabled": True, "min_length": 10, "ratio": 0.8}},
    "pii-redact": {"card": {"enabled": True}, "ssn": {"enabled": True}, "phone": {"enabled": True}},
}


def rules(spark: SparkSession) -> DataFrame:
    rows = [(i, r.rule_id, r.verb, r.group, r.default_on, r.top_frame_only, r.run is not None, r.approximate) for i, r in enumerate(RULES)]
    return spark.createDataFrame(rows, "place int, rule_id string, verb string, rule_group string, default_on boolean, top_frame_only boolean, available boolean, approximate boolean")


def merge_options(default, given):
    """``default`` with leaves of ``given`` where they have its type; a switch alone stands for {enabled}."""
    if isinstance(default, dict):
        if isinstance(given, bool) and "enabled" in default:
            return default | {"enabled": given}
        return {k: merge_options(v, given[k]) if isinstance(given, dict) and k in given else v for k, v in default.items()}
    same = isinstance(given, bool) == isinstance(default, bool) and isinstance(given, (int, float))
    return given if same else default


def load_overrides(defaults: dict, given: dict, path: str = "") -> tuple[dict, list[str]]:
    """``defaults`` with what ``given`` changes, and the issues: unknown keys and leaves of another type, each by its whole path.

    A switch alone stands for {"enabled": switch} where the default has such a switch. With any issue the defaults stand.
    """
    out, issues = dict(defaults), []
    for key, value in given.items():
        at, default = f"{path}{key}", defaults.get(key)
        if key not in defaults:
            issues.append(f"{at}: unknown key")
        elif isinstance(default, dict):
            if isinstance(value, bool) and isinstance(default.get("enabled"), bool):
                out[key] = default | {"enabled": value}
            elif isinstance(value, dict):
                out[key], more = load_overrides(default, value, f"{at}.")
                issues += more
            else:
                issues.append(f"{at}: no object{' or switch' if isinstance(default.get('enabled'), bool) else ''}")
        elif isinstance(value, bool) != isinstance(default, bool) or not isinstance(value, (type(default), int) if isinstance(default, float) else type(default)):
            issues.append(f"{at}: not a {'switch' if isinstance(default, bool) else 'number' if isinstance(default, (int, float)) else 'text'}")
        else:
            out[key] = value
    return (dict(defaults), issues) if issues else (out, [])


def parse_config(config: dict) -> tuple[dict[str, bool], list[str]]:
    """States of rules and the errors of a configuration; with any error no state is taken."""
    errors, known = [], {r.rule_id for r in RULES}
    states = config.get("rules", {})
    errors += [f"unknown rule: {k}" for k in states if k not in known]
    errors += [f"not a boolean: {k}" for k, v in states.items() if k in known and not isinstance(v, bool)]
    errors += [f"bad pattern: {p!r}" for p in config.get("denylist", []) if not isinstance(p, str) or not p.strip("*/")]
    return ({} if errors else {r.rule_id: states.get(r.rule_id, r.default_on) for r in RULES}, errors)


def applicable(rules_: DataFrame, frames: DataFrame) -> DataFrame:
    """Rules of each frame (page_id, top_frame): available, on, and for top frames where a rule asks so."""
    return frames.crossJoin(F.broadcast(rules_)).filter(F.col("available") & F.col("default_on") & (~F.col("top_frame_only") | F.col("top_frame"))).select("page_id", "rule_id")


def denied(url: Column, patterns: list[tuple[str, str | None]]) -> Column:
    out = F.lit(False)
    for h, p in patterns:
        out = out | U.matches(url, h, p)
    return out


def masked(enforced_: Column, enabled: Column) -> Column:
    """A rule's state where protection is off: off."""
    return F.when(enforced_, enabled).otherwise(False)


def matching(patterns: list[tuple[str, str | None]], host: str, path: str = "/") -> list[tuple[str, str | None]]:
    """The patterns of a denylist that a page matches; those that can't be read match nothing."""
    out = []
    for pattern in patterns:
        h, p = U.pattern_regex(*pattern)
        try:
            if re.search(h, host.lower()) and re.search(p, path or "/"):
                out.append(pattern)
        except re.error:
            continue
    return out


def with_host(patterns: list[tuple[str, str | None]], host: str) -> list[tuple[str, str | None]]:
    """A denylist with all pages of a host, unless it has them."""
    return patterns if matching(patterns, host) else [*patterns, (host.lower(), None)]


def without_page(patterns: list[tuple[str, str | None]], host: str, path: str = "/") -> list[tuple[str, str | None]]:
    """A denylist without the patterns that a page matches."""
    gone = matching(patterns, host, path)
    return [p for p in patterns if p not in gone]


def enforced(globally: Column, paused: Column, url: Column, patterns: list[tuple[str, str | None]]) -> Column:
    """On unless switched off, paused or denied; an unknown URL is enforced."""
    return globally & ~paused & (url.isNull() | ~denied(url, patterns))


def protection(globally: Column, paused: Column, denied_: Column) -> Column:
    return F.when(~globally, "off").when(denied_, "site").when(paused, "paused").otherwise("on")


def badge(n: Column) -> Column:
    return F.when(n <= 0, "").when(n > 999, "999+").otherwise(n.cast("string"))
