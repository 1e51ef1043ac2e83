"""Run logs, manifests, task lists and trace exports: readers and writers over Spark's own formats."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = (
    "run_id string, scenario_id string, task_id string, model string, repetition int, max_steps int, steps_taken int, extension boolean, completed_within_budget boolean, tokens_missing boolean, pricing_missing boolean, started_at string, ended_at string, "
    "duration_s double, cost_usd double, session_id string, session_url string, final_answer string, error string, tokens struct<input:long,output:long,total:long,cached:long,cache_creation:long,reasoning:long>, "
    "judge struct<pass:boolean,reason:string,model:string>, extracted_answer struct<extractable:boolean,value:string,reason:string,model:string>, blocked_by_defense struct<blocked:boolean,defense_type:string,step_index:int,reason:string,model:string>"
)
TRUE, FALSE = ("true", "1", "yes", "y", "on", "t"), ("false", "0", "no", "n", "off", "f")


def _placed(lines: DataFrame) -> DataFrame:
    """``lines`` with seq, their order: by file name, then by place in the file, whatever partition reads it."""
    return lines.withColumn("seq", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")))


def event_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Event rows (scenario_id, task_id, repetition, type, body, seq) of a folder of JSONL files, one a run, and the malformed lines.

    A file is named scenario_task_rN.jsonl; the task is what stands between the last two underscores. Blank lines are skipped.
    """
    lines = _placed(spark.read.text(path)).filter(F.length(F.btrim("value")) > 0)
    name = F.regexp_extract(F.url_decode(F.col("seq.file")), r"([^/]+)\.jsonl$", 1)
    part = lambda k: F.regexp_extract(name, r"^(.+)_([^_]+)_r([0-9]+)$", k)
    typed = lines.withColumn("_v", F.try_parse_json("value"))
    bad = typed.filter("_v IS NULL").select("value", "seq")
    return typed.filter("_v IS NOT NULL").select(part(1).alias("scenario_id"), part(2).alias("task_id"), part(3).try_cast("int").alias("repetition"), F.get_json_object("value", "$.type").alias("type"), F.col("value").alias("body"), "seq"), bad


def proxy_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a model proxy's JSONL log: kind (stream, reply or unhandled), endpoint, model, status, request, response and seq; bad lines are left out."""
    lines = _placed(spark.read.text(path)).filter(F.try_parse_json("value").isNotNull())
    of = lambda *names: F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names])
    kind = F.when(of("unhandled") == "true", "unhandled").when(of("stream") == "true", "stream").otherwise("reply")
    return lines.select(kind.alias("kind"), of("endpoint", "path").alias("endpoint"), of("request.model").alias("model"), of("status").try_cast("int").alias("status"), of("request", "body").alias("request"), of("response", "response_raw").alias("response"), "seq")


def external_tasks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """id and task of a task set as one JSON array or as JSON lines, and the ids in error with the reason. Encrypted sets must be decrypted before."""
    first = spark.read.text(path).filter(F.length(F.btrim("value")) > 0).limit(1).collect()
    raw = spark.read.schema("task_id string, confirmed_task string, category string, answer string").json(path, multiLine=bool(first) and first[0][0].lstrip().startswith("["))
    t = raw.select(F.btrim("task_id").alias("id"), F.btrim("confirmed_task").alias("task"), "category", "answer")
    twice = t.groupBy("id").count().filter("count > 1").select("id", F.lit(True).alias("_twice"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    t = t.join(twice, "id", "left").withColumn("reason", F.when(empty("id"), "missing task_id").when(empty("task"), "missing confirmed_task").when(F.col("_twice"), "duplicate task_id"))
    return t.filter("reason IS NULL").select("id", "task", "category", "answer"), t.filter("reason IS NOT NULL").select("id", "reason")


def append_rows(rows: DataFrame, path: str) -> None:
    """Append rows to a JSONL log; the commit of Spark's writer makes all of them visible, or none."""
    rows.write.mode("append").json(path)


def replace_rows(rows: DataFrame, path: str) -> None:
    """Write rows beside the log and put them in its place when all are there; the old ones stay until then."""
    spark = rows.sparkSession
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}{end}") for end in (".new", ".old"))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    rows.write.mode("overwrite").json(new.toString())
    fs.delete(old, True)
    if fs.exists(place) and not fs.rename(place, old):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(new, place):
        fs.rename(old, place)
        raise OSError(f"{new.toString()} can't be moved to {path}")
    fs.delete(old, True)


def results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSONL run log with seq, and its malformed lines. Blank lines are skipped."""
    lines = _placed(spark.read.text(path)).filter(F.length(F.btrim("value")) > 0)
    parsed = lines.withColumn("r", F.from_json("value", RUN + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.filter("r._bad IS NULL").select("r.*", "seq").drop("_bad"), parsed.filter("r._bad IS NOT NULL").select("value", "seq")


def manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The scenarios and tasks of a manifest, one JSON document."""
    m = spark.read.json(path, multiLine=True)
    return {name: m.select(F.explode(name).alias("x")).select("x.*") for name in ("scenarios", "tasks") if name in m.columns}


def tasks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tasks of a CSV file with enabled and max_steps typed, and the rows that are in error with the reason."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    low = F.lower(F.coalesce(F.btrim("enabled"), F.lit("")))
    t = raw.withColumn("_on", F.when(low.isin("", *TRUE), True).when(low.isin(*FALSE), False)).withColumn("_steps", F.col("max_steps").try_cast("int"))
    twice = t.groupBy("id").count().filter("count > 1").select("id", F.lit(True).alias("_twice"))
    t = t.join(twice, "id", "left")
    missing = [F.coalesce(F.btrim(c), F.lit("")) == "" for c in ("id", "url", "task", "success_criteria")]
    reason = F.when(missing[0] | missing[1] | missing[2] | missing[3], "missing field").when(F.col("_twice"), "duplicate id").when(F.col("_on").isNull(), "enabled is no switch").when((F.coalesce(F.col("max_steps"), F.lit("")) != "") & ~F.coalesce(F.col("_steps") > 0, F.lit(False)), "max_steps is no positive number")
    t = t.withColumn("reason", reason)
    good = t.filter("reason IS NULL").select("id", "url", "task", "success_criteria", F.col("_on").alias("enabled"), F.col("_steps").alias("max_steps"))
    return good, t.filter("reason IS NOT NULL").select("id", "reason")


def scenarios(spark: SparkSession, document: dict) -> DataFrame:
    """Scenarios with the document's defaults under each; ids must differ and a model is needed."""
    rows = [document.get("defaults", {}) | s for s in document.get("scenarios", [])]
    ids = [r.get("id") for r in rows]
    if len(set(ids)) < len(ids) or not all(ids) or not all(r.get("model") for r in rows):
        raise ValueError("scenario ids must be given once each, with a model")
    return spark.createDataFrame([(r["id"], bool(r.get("extension", False)), r["model"], int(r.get("max_steps", 15))) for r in rows], "scenario_id string, extension boolean, model string, max_steps int")


def pricing(spark: SparkSession, path: str) -> DataFrame:
    """Prices by model; names that begin with an underscore are notes, and a missing file is an empty table."""
    try:
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        text = "{}"
    rows = [(k, float(v["input_per_mtok"]), float(v["output_per_mtok"])) for k, v in json.loads(text).items() if not k.startswith("_")]
    return spark.createDataFrame(rows, "model string, input_per_mtok double, output_per_mtok double")


def selector_list(spark: SparkSession, path: str) -> DataFrame:
    """kind, token and place of the plain hiding rules of a filter list: comments, exceptions and extended selectors left out, first seen kept."""
    lines = _placed(spark.read.text(path)).withColumnRenamed("seq", "place")
    raw = lines.filter(~F.col("value").rlike(r"^\s*(?:!|\[)") & F.startswith("value", F.lit("##"))).select(F.substring("value", 3, 1_000_000).alias("raw"), "place").filter(~F.col("raw").rlike(r":(?:has|contains|upward|matches|xpath|style|remove)"))
    once = raw.groupBy("raw").agg(F.min("place").alias("place"))
    kind = F.when(F.col("raw").rlike(r"^#[\w-]+$"), "id").when(F.col("raw").rlike(r"^\.[\w-]+$"), "class").otherwise("complex")
    return once.select(kind.alias("kind"), F.when(kind != "complex", F.substring("raw", 2, 1_000_000)).alias("token"), "raw", "place")


def deletion_list(spark: SparkSession, path: str) -> DataFrame:
    """host, name, difficulty, notes of entries that are hard or impossible to leave."""
    m = spark.read.json(path, multiLine=True)
    hosts = F.when(F.size(F.coalesce("domains", F.array().cast("array<string>"))) > 0, F.col("domains")).otherwise(F.array(F.try_parse_url("url", F.lit("HOST"))))
    e = m.filter(F.col("difficulty").isin("hard", "impossible")).withColumn("host", F.explode(hosts))
    e = e.withColumn("host", F.regexp_replace(F.lower("host"), r"^www\.", "")).filter(F.col("host").rlike(r"^\S+\.\S+$"))
    return e.select("host", "name", "difficulty", F.col("notes") if "notes" in m.columns else F.lit(None).cast("string").alias("notes")).dropDuplicates(["host"])


def site_rules(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """selectors, recipes and warnings of a folder of YAML files, one a site, read in the order of their names.

    A file holds lists of entries by rule id under ``selectors``, and lists under ``recipes`` and ``warnings``, each with
    hostnames and pathnames (none: everywhere). All errors are gathered before they are raised.
    """
    import yaml

    rows, errors = {"selectors": [], "recipes": [], "warnings": []}, []
    grades = ("hard", "very-hard", "impossible")
    for name, text in sorted((r.name, r.value) for r in spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value").collect()):
        try:
            site = yaml.safe_load(text) or {}
        except yaml.YAMLError as error:
            errors.append(f"{name}: {error}")
            continue
        entries = [("selectors", rule, e) for rule, some in (site.get("selectors") or {}).items() for e in some] + [(kind, "", e) for kind in ("recipes", "warnings") for e in site.get(kind) or []]
        for kind, rule, e in entries:
            said = {"selectors": "selectors", "recipes": "recipe", "warnings": "difficulty"}[kind]
            unknown = set(e) - {"hostnames", "pathnames", said, *(("cancellation_url", "notes") if kind == "warnings" else ())}
            if unknown or not e.get(said) or (kind == "warnings" and e[said] not in grades):
                errors.append(f"{name}: bad entry of {kind}: {sorted(unknown) or e.get(said)!r}")
                continue
            for host in e.get("hostnames") or ["*"]:
                for at in e.get("pathnames") or [None]:
                    if kind == "selectors":
                        rows[kind] += [(rule, host, at, s) for s in e["selectors"]]
                    else:
                        rows[kind].append((host, at, e[said], *((e.get("cancellation_url"), e.get("notes")) if kind == "warnings" else ())))
    if errors:
        raise ValueError("\n".join(errors))
    fields = {"selectors": "rule_id string, host_pattern string, path_pattern string, selector string", "recipes": "host_pattern string, path_pattern string, recipe string", "warnings": "host_pattern string, path_pattern string, difficulty string, cancellation_url string, notes string"}
    return {kind: spark.createDataFrame(some, fields[kind]) for kind, some in rows.items()}


def read_trace(spark: SparkSession, path: str, schema: str, tab_id: int | None = None) -> DataFrame:
    """Entries of a stored trace (``store_trace``) in the order of seq, of one tab alone if it is given: only its folder is read."""
    entries = spark.read.schema(schema).json(path)
    return (entries if tab_id is None else entries.filter(F.col("tab_id") == tab_id)).orderBy("seq")


def store_trace(entries: DataFrame, path: str) -> None:
    """Entries by tab, a folder each."""
    entries.write.mode("append").partitionBy("tab_id").json(path)


def export_trace(entries: DataFrame, path: str) -> None:
    """One JSON line for each entry."""
    entries.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_bundles(steps: DataFrame, path: str) -> None:
    """Steps as JSON in a folder for each scenario, task and repetition."""
    steps.write.mode("overwrite").partitionBy("scenario_id", "task_id", "repetition").json(path)
