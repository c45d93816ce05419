"""Text files of unknown encoding, and folders of experiment reports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TIMES = ("total", "docling", "asset", "repair_total", "batch_cold_start_seconds", "batch_steady_state_seconds", "model_cold_start", "ocr_inference_seconds")
TIMINGS = f"pdf string, run_id string, batch_id string, timings struct<{','.join(f'{t}:double' for t in TIMES)},recovery:struct<attempted:long,accepted:long,rejected:long,accept_rate:double>>"
QA = "recovery_attempted_count long, recovery_success_count long, recovery_failed_count long"


def decoded(raw: bytes) -> tuple[str, str, str, str]:
    """(text without a mark, encoding, mark, line end): UTF-8, with or without a mark, else GB 18030, else UTF-8 with replacements."""
    marked = raw.startswith(b"\xef\xbb\xbf")
    for encoding in ("utf-8-sig", "gb18030"):
        try:
            text = raw.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    else:
        text, encoding = raw.decode("utf-8", "replace"), "utf-8"
    return text.removeprefix("\ufeff"), encoding, "utf-8-sig" if marked else "", "\r\n" if "\r\n" in text else "\n"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text, encoding, mark, newline, modified: a row a file, below path at any depth (the scan leaves out empty files)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)

    def run(batches):
        for batch in batches:
            found = [decoded(x.as_py()) for x in batch.column(1)]
            columns = [pa.array([f[k] for f in found], pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2)], names=["path", "text", "encoding", "mark", "newline", "modified"])

    return files.select("path", "content", F.col("modificationTime").alias("modified")).mapInArrow(run, "path string, text string, encoding string, mark string, newline string, modified timestamp")


def _reports(spark: SparkSession, root: str, pattern: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(root)
    path = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_replace(path, "/[^/]*$", "").alias("folder"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))


def experiments(spark: SparkSession, root: str, latest: bool = False) -> DataFrame:
    """document, run_id, batch_id, modified, times, attempted, accepted, rejected, accept_rate: all runs below root.

    Timing reports meet the formula report of their document in the same folder; formula reports without a run are rows
    of their own. With ``latest`` a document's last run counts only. A report that doesn't parse has no document or
    counts, and is left out if it is a timing report.
    """
    runs = _reports(spark, root, "timings_*.json", TIMINGS).where("pdf is not null or run_id is not null or timings is not null")
    stem = lambda name, gone: F.regexp_replace(F.regexp_replace(name, "^.*/", ""), gone, "")
    short = F.regexp_replace(stem(F.col("file"), r"\.json$"), "^timings_", "")
    runs = runs.select(
        F.when(F.coalesce("pdf", F.lit("")) == "", short).otherwise(stem(F.col("pdf"), r"\.[^.]*$")).alias("document"), "folder", F.coalesce(F.when(F.col("run_id") != "", F.col("run_id")), short).alias("run_id"),
        F.coalesce("batch_id", F.lit("")).alias("batch_id"), "modified", *[F.col(f"timings.{t}").alias(t) for t in TIMES], F.col("timings.recovery").alias("r"),
    )
    if latest:
        runs = runs.withColumn("_n", F.row_number().over(Window.partitionBy("document").orderBy(F.desc("modified"), F.desc("run_id")))).where("_n = 1").drop("_n")
    qa = _reports(spark, root, "*.formula_qa.json", QA).select(F.regexp_replace("file", r"\.formula_qa\.json$", "").alias("document"), "folder", F.col("modified").alias("qa_modified"), *[c.split()[0] for c in QA.split(", ")])
    both = runs.join(qa, ["document", "folder"], "full")
    rate = F.coalesce("r.accept_rate", F.expr("try_divide(recovery_success_count, recovery_attempted_count)"))
    return both.select(
        "document", F.coalesce("run_id", F.lit("")).alias("run_id"), F.coalesce("batch_id", F.lit("")).alias("batch_id"), F.coalesce("modified", "qa_modified").alias("modified"), *TIMES,
        F.coalesce("r.attempted", "recovery_attempted_count").alias("attempted"), F.coalesce("r.accepted", "recovery_success_count").alias("accepted"), F.coalesce("r.rejected", "recovery_failed_count").alias("rejected"), rate.alias("accept_rate"),
    )
