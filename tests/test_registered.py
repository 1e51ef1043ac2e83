"""Every registered query of the library itself against its check SQL, over the smallest tables."""

import importlib

import duckdb
import numpy as np
import pandas as pd
import pytest

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MODULES = [f"harrow.plans.{m}_queries" for m in ("text", "page", "run", "trace", "stream", "source")]
QUERIES = {n: q for m in MODULES for n, q in importlib.import_module(m).QUERIES.items()}
SQL = {n: q for m in MODULES for n, q in importlib.import_module(m).ORACLES.items()}


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return str(round(float(v), 6)) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(one(v) for v in row) for row in frame.itertuples(index=False))


def test_names():
    assert set(SQL) <= set(QUERIES)
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0


def test_rules_read_the_given_pages(spark, tmp_path):
    from harrow.operators import site_rules
    from harrow.plans import page_queries as P

    rows = [*P.FIXTURE, *[(10 + i, url, "<p>x</p>") for i, url in site_rules.VISITS]]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {n: QUERIES[n](spark, str(tmp_path)).collect() for n in ("rule_counts_by_page", "roach_motel_pages", "url_recipe_pages", "json_ld_pages")}
    assert {r.rule_id: r.n for r in got["rule_counts_by_page"] if r.page_id == 1} == P.EXPECTED
    assert sorted(r.page_id for r in got["roach_motel_pages"]) == [11, 13, 16] and sorted(r.page_id for r in got["url_recipe_pages"]) == [1, 15]
    assert [r.page_id for r in got["json_ld_pages"]] == [1] and P.BAD not in got["json_ld_pages"][0].json
