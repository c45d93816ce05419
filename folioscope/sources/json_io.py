"""JSON documents, line-delimited rows, catalogues, overlays and manifests: explicit schemas, unknown keys dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "struct<id:string,type:string,content:string,page:int,reading_order:int,bbox:struct<x0:double,y0:double,x1:double,y1:double>,provider:string,attributes:map<string,string>>"
DOCUMENT = f"schema_version string, version string, source string, title string, pages array<struct<number:int,width:double,height:double>>, blocks array<{BLOCK}>, relations array<struct<kind:string,source_id:string,target_id:string>>"
REPORT = "status string, verdict string, warnings array<string>, reasons array<string>, checks array<struct<check_id:string,status:string,severity:string,blocking:boolean,score:double>>"
CASES = "cases array<struct<id:string,suite:string,tags:array<string>,fixture:string,page_count:int,expect_status:string>>"
MANIFEST = "schema_version string, schema string, batches array<struct<id:int,start_page:int,end_page:int,status:string,text:string>>"
# Fixed values.
TAGS = ("formula", "table", "figure", "scan", "multilingual", "pages", "empty", "caption", "anchors")
SUITES = ("academic", "scan", "table", "multilingual", "pathological", "regression")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON value a file; a file that doesn't parse is a row of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones kept in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def blocks(documents: DataFrame) -> DataFrame:
    """A row for each block of a document, in reading order."""
    return documents.select("source", F.posexplode("blocks").alias("pos", "b")).select("source", "pos", "b.*")


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents as JSON lines, without evaluation results, with their schema version."""
    keep = [c for c in documents.columns if c != "qa"]
    documents.select(*keep).withColumn("schema_version", F.coalesce(F.col("schema_version"), F.lit("1.0"))).write.mode("overwrite").json(path)


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Quality reports; older key names count where the newer are missing."""
    found = read_json(spark, path, REPORT)
    checks = F.transform("checks", lambda c: c.withField("blocking", F.coalesce(c["blocking"], F.lit(True))))
    return found.select(F.coalesce("status", "verdict").alias("status"), F.coalesce("warnings", "reasons").alias("warnings"), checks.alias("checks"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a catalogue: known tags only, a suite for each."""
    case = read_json(spark, path, CASES).select(F.explode("cases").alias("c"))
    tags = F.array_intersect(F.coalesce("c.tags", F.array()), F.array(*[F.lit(t) for t in TAGS]))
    return case.select("c.id", F.when(F.col("c.suite").isin(*SUITES), F.col("c.suite")).otherwise("academic").alias("suite"), tags.alias("tags"), "c.fixture", "c.page_count", F.coalesce("c.expect_status", F.lit("DONE_VERIFIED")).alias("expect_status"))


def overlay(base: DataFrame, over: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """base with the columns of over where these are neither null nor empty lists."""
    o = over.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    full = lambda c: F.when(F.size(f"_{c}") > 0, F.col(f"_{c}"))
    return base.join(o, key, "left").select(key, *[F.coalesce(full(c), F.col(c)).alias(c) for c in columns])


def batches(spark: SparkSession, path: str) -> DataFrame:
    """Batches of a run's manifest, of either schema key."""
    return read_json(spark, path, MANIFEST).select(F.coalesce("schema_version", "schema").alias("schema_version"), F.explode("batches").alias("b")).select("schema_version", "b.*")


def accepted_text(found: DataFrame) -> DataFrame:
    """The batches' texts in order; raises if one isn't accepted."""
    checked = found.agg(F.bool_and(F.col("status") == "accepted").alias("ok"), F.array_sort(F.collect_list(F.struct("id", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["text"]), "\n\n")
    return checked.select(F.when(F.col("ok"), text).otherwise(F.raise_error(F.lit("a batch is not accepted"))).alias("text"))


def next_pending(found: DataFrame) -> DataFrame:
    """The first batch that is not accepted; no row if all are."""
    return found.where("status <> 'accepted'").orderBy("id").limit(1)
