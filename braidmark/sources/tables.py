"""Scans and sinks of the record formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from braidmark.session import written

SIDECAR = r"(^_|\.bak$|\.incomplete\.json$|\.summary\.json$|\.manifest\.json$)"
FORMULA = ("=", "+", "-", "@")


def read_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object per file; sidecar files are skipped, malformed ones fail the read."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(path)
    return df.withColumn("file_name", F.col("_metadata.file_name")).filter(~F.col("file_name").rlike(SIDECAR))


def exploded_verdicts(files: DataFrame) -> DataFrame:
    """A row per verdict with its place; files that hold none drop out; the file's prompt_version fills gaps."""
    rows = files.filter("verdicts IS NOT NULL").select("file_name", "prompt_version", F.posexplode("verdicts").alias("i", "v"))
    return rows.select("file_name", "i", "v.*", F.coalesce("v.prompt_version", "prompt_version").alias("version"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """job_id (the file's name), line_no from 1, text; files are split, and no task holds one.

    A split numbers its own lines; the lines of the splits before it in its file are added from a
    table of a row for each split. The scan is written once, so that both see the same numbers.
    """
    at = F.col("_metadata")
    job = F.regexp_replace(at["file_name"], r"\.[^.]*$", "")
    scan = spark.read.text(path).select(at["file_path"].alias("file"), at["file_block_start"].alias("start"), job.alias("job_id"), F.monotonically_increasing_id().alias("id"), F.rtrim(F.col("value"), F.lit("\r")).alias("text"))
    scan = written(scan, "lines")
    splits = scan.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "start", (before - F.col("first") + 1).alias("shift"))
    return scan.join(splits, ["file", "start"]).select("job_id", (F.col("id") + F.col("shift")).alias("line_no"), "text")


def read_gold(spark: SparkSession, path: str, keys: list[str], status: str, kept: tuple[str, ...] = ("full", "partial")) -> DataFrame:
    """JSON lines with both keys and a positive status."""
    schema = ", ".join(f"{c} STRING" for c in [*keys, status])
    df = spark.read.schema(schema).json(path).filter(F.col(status).isin(*kept))
    for k in keys:
        df = df.filter(F.coalesce(F.trim(F.col(k)), F.lit("")) != "")
    return df


def latest_of(lists: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all lists; where several have a key, the last list's row wins."""
    out = None
    for place, df in enumerate(lists):
        one = df.withColumn("__p", F.lit(place))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__p").alias("r")).select(*keys, *[f"r.{c}" for c in rest if c != "__p"])


def guarded(column: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a leading quote."""
    return F.when(F.substring(column, 1, 1).isin(*FORMULA), F.concat(F.lit("'"), column)).otherwise(column)


def write_report(df: DataFrame, path: str, columns: list[str], texts: list[str]) -> None:
    """CSV with a header: quotes doubled, spaces at the ends kept, text columns guarded."""
    out = df.select(*[guarded(F.col(c)).alias(c) if c in texts else F.col(c) for c in columns])
    out.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).mode("overwrite").csv(path)


def write_by_entity(df: DataFrame, path: str, entity: str) -> None:
    """A folder for each entity; those of entities that df lacks stay as they are."""
    df.write.partitionBy(entity).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, after a check that no key repeats."""
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"repeated keys: {keys}")
    return df


def read_corpus(spark: SparkSession, path: str, schema: StructType | str, key: str, text: str) -> DataFrame:
    """read_records with an error for missing or repeated keys and for blank texts."""
    df = read_records(spark, path, schema)
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    bad = df.agg(F.count_if(blank(key)).alias("keys"), F.count_if(blank(text)).alias("texts")).first()
    if bad["keys"] or bad["texts"]:
        raise ValueError(f"{bad['keys']} records without a key, {bad['texts']} without a text")
    return assert_unique(df, [key])


def read_alignments(spark: SparkSession, path: str, schema: StructType | str, keys: list[str]) -> DataFrame:
    """CSV files with a header; rows with an empty key drop out."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for k in keys:
        df = df.filter(F.trim(F.coalesce(F.col(k), F.lit(""))) != "")
    return df


def read_master(spark: SparkSession, path: str, required: list[str], keys: list[str]) -> DataFrame:
    """A corrected table: an error if a required header is missing; keyless rows drop out."""
    df = spark.read.option("header", True).csv(path)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    for k in keys:
        df = df.filter(F.trim(F.coalesce(F.col(k), F.lit(""))) != "")
    return df


def ordered_entities(gold: DataFrame, entity: str, order: str) -> DataFrame:
    """Distinct entities in order of their first gold row."""
    return gold.groupBy(entity).agg(F.min(order).alias("__at")).orderBy("__at", entity).select(entity)


def gold_of_markdown(spark: SparkSession, path: str, head: str = r"(?m)^#+\s*(\S+)\s*:\s*(\S+)\s*$", row: str = r"(?m)^\|\s*(\S+)\s*\|\s*(full|partial)\s*\|") -> DataFrame:
    """gold_id, entity_id, doc_id, status: table rows of Markdown files under their headings ("# id: entity")."""
    text = spark.read.text(path, wholetext=True)
    parts = text.select(F.explode(F.split("value", r"(?m)(?=^#)")).alias("part"))
    ids = parts.select(F.regexp_extract("part", head, 1).alias("gold_id"), F.regexp_extract("part", head, 2).alias("entity_id"), F.inline(F.arrays_zip(F.regexp_extract_all("part", F.lit(row), F.lit(1)).alias("doc_id"), F.regexp_extract_all("part", F.lit(row), F.lit(2)).alias("status"))))
    return ids.filter("entity_id != ''")


def retrieved(files: DataFrame, field: str) -> DataFrame:
    """entity_id, rank (from 1), doc_id, has_field of one list of codes in artifacts; an artifact without the list has one row, its doc_id null."""
    rows = files.select("entity_id", F.col(field).isNotNull().alias("has_field"), F.posexplode_outer(field).alias("__i", "doc_id"))
    return rows.select("entity_id", (F.col("__i") + 1).alias("rank"), "doc_id", "has_field")


def sheet_violations(sheet: DataFrame) -> DataFrame:
    """row, violation of a flat standards sheet (row, code, text): text without a code, code without a text, formulas, repeated codes, a grade other than the sheet's most common."""
    code, text = F.trim(F.coalesce("code", F.lit(""))), F.trim(F.coalesce("text", F.lit("")))
    rows = sheet.select("row", code.alias("code"), text.alias("text"), F.substring_index(code, ".", 1).alias("grade"))
    named = rows.filter("code != ''")
    counts = named.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    main = named.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("grade", F.struct("n", "grade")).alias("main"))
    met = rows.join(counts, "code", "left").join(F.broadcast(main))  # one row
    kinds = {
        "blank_code": (F.col("code") == "") & (F.col("text") != ""),
        "blank_text": (F.col("code") != "") & (F.col("text") == ""),
        "formula": F.col("text").startswith("=") | F.col("code").startswith("="),
        "repeated": F.coalesce(F.col("n") > 1, F.lit(False)),
        "other_grade": (F.col("code") != "") & (F.col("grade") != F.col("main")),
    }
    return met.select("row", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))).alias("violation"))


def corpus_for_retrieval(records: DataFrame, text: Column) -> DataFrame:
    """Alignable leaves with the one text that the sparse and the dense arm share."""
    from braidmark.operators.retrieval import alignable_leaves

    return alignable_leaves(records, "doc_id", "parent", "level").withColumn("text", text)


def raw_or_competency(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text from raw_text or else competency; doc_ids without either)."""
    said = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    out = docs.select("doc_id", F.coalesce(said("raw_text"), said("competency")).alias("text"))
    return out.filter("text IS NOT NULL"), out.filter("text IS NULL").select("doc_id")


def index_rows(lessons: DataFrame) -> DataFrame:
    """code, pages, min, declared_standards, title: the index of lessons, for a tab-separated file."""
    return lessons.select("code", F.concat_ws("-", "page_start", "page_end").alias("pages"), F.coalesce(F.col("minutes").cast("string"), F.lit("")).alias("min"), F.array_join("declared", ", ").alias("declared_standards"), "title")


def write_index(lessons: DataFrame, path: str) -> None:
    index_rows(lessons).write.option("sep", "\t").option("header", True).mode("overwrite").csv(path)


def run_summary(rows: DataFrame, status: str, sources: str) -> DataFrame:
    """One row: rows, counts by status, and how many sources they came from."""
    n = lambda s: F.count_if(F.col(status) == s).alias(f"n_{s}")
    return rows.agg(F.count(F.lit(1)).alias("row_count"), n("full"), n("partial"), n("none"), F.count_distinct(sources).alias("sources"))


def write_summary(summary: DataFrame, path: str) -> None:
    """The one row of a summary as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def dumped(df: DataFrame, order: list[str], optional: list[str], pipeline: list[str]) -> DataFrame:
    """json: records with keys in order, optional nulls left out, pipeline columns under _pipeline."""
    required = [c for c in order if c not in optional]
    body = F.struct(*[F.coalesce(c, F.lit("")).alias(c) if c in required and df.schema[c].dataType.typeName() == "string" else F.col(c) for c in order], F.struct(*pipeline).alias("_pipeline"))
    return df.select(F.to_json(body).alias("json"))


def loaded(dumps: DataFrame, schema: StructType | str) -> DataFrame:
    """The records of `dumped`, pipeline columns beside the others."""
    rows = dumps.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return rows.select(*[c for c in rows.columns if c != "_pipeline"], "_pipeline.*")
