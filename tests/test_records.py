from pyspark.sql import functions as F

from harrow.functions import records as R


def test_usage(spark):
    bodies = ['{"a": [{"usage": {"prompt_tokens": 3, "completion_tokens": 4, "prompt_tokens_details": {"cached_tokens": 1}, "completion_tokens_details": {"reasoning_tokens": 2}}}]}', '{"usage": {"input_tokens": 5, "output_tokens": 7, "cache_creation_input_tokens": 6}}', '{"prompt_tokens": 1}', "no", None, '{"payload": {"tokenUsage": {"promptTokenCount": 8, "cachedContentTokenCount": 3}}}', '{"usage": {"reasoning_tokens": 1}}', "[1]"]
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", R.usage("b").alias("u")).orderBy("i").collect()
    assert [tuple(r.u) for r in rows] == [(3, 4, 7, 1, None, 2), (5, 7, 12, None, 6, None), (None,) * 6, (None,) * 6, (None,) * 6, (8, 0, 8, 3, None, None), (None,) * 6, (None,) * 6]


def test_usage_of_several_objects(spark):
    """The object that lies least deep counts, the last of equals; what strings say is no object."""
    bodies = ['{"steps": [{"usage": {"input_tokens": 1, "output_tokens": 1}}], "usage": {"input_tokens": 5, "output_tokens": 6}, "more": {"a": {"usage": {"input_tokens": 9}}}}', '[{"usage": {"input_tokens": 1}}, {"usage": {"input_tokens": 2}}]', '{"said": "\\"usage\\": {\\"input_tokens\\": 7} }", "x": {"usage": {"output_tokens": 3, "prompt_tokens": "4"}}}', '{"usage": {"input_tokens": 1}']
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", R.usage("b").alias("u")).orderBy("i").collect()
    assert [tuple(r.u)[:3] for r in rows] == [(5, 6, 11), (2, 0, 2), (4, 3, 7), (None,) * 3]


def test_diff_and_kind(spark):
    r = spark.createDataFrame([("a\nb", "a\nc"), ("x", "x"), (None, "x")], "a string, b string").select(R.unified_diff("a", "b").alias("d"), R.match_kind(F.col("a"), F.col("b")).alias("k")).collect()
    assert r[0].d.endswith(" a\n-b\n+c") and r[1].d == ""
    assert [x.k for x in r] == ["different", "same", "only b"]


def test_glob_block_summary(spark):
    d = spark.createDataFrame([("task-1", "Captcha", True, ["a" * 500, "b"]), ("other.x", "odd", True, []), ("Task-1", "captcha", False, ["c"])], "id string, kind string, blocked boolean, steps array<string>")
    got = d.select(R.glob(F.col("id"), ["task-*", "other?x"]).alias("g"), R.block_type(F.col("kind"), F.col("blocked")).alias("b"), F.length(R.summary(F.col("steps"), 600)).alias("n")).collect()
    assert [tuple(x) for x in got] == [(True, "captcha", 403), (True, "other", 0), (False, None, 1)]
