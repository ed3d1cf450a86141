"""A training corpus from raw documents: five stages, each written and read again by the next."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantcast.llm import contamination, jaccard, lines, mixing, toxicity
from plantcast.llm.common import broadcast_if_few, staged, work_folder

REJECT_SCORE = 0.5
ORACLE_SQL = None  # boosted trees cannot be written in SQL; the stages are tested one by one


def _row() -> Column:
    """What a stage decides on: a doc_id, also null, with two hashes of its text."""
    return F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("th"), F.xxhash64(F.lit("second"), "text").alias("th2"))


def _without(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents that are not among ``rows``, structs as of ``_row`` in their only column."""
    keyed = documents.select(_row().alias("_row"), F.struct(*documents.columns).alias("document"))
    kept = keyed.join(broadcast_if_few(rows.toDF("_row")), "_row", "left_anti")
    return kept.select(*[F.col("document")[c].alias(c) for c in documents.columns])


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is written meanwhile: a task holds a batch of texts twice, in Spark and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score ``REJECT_SCORE`` or more; the model learns from the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    hashed = docs.select("text", _row().alias("_row")).select("text", "_row.*")
    scored = toxicity.Model(docs.select("doc_id", "text"), labels).score(hashed, ["doc_id", "th", "th2"])
    rejected = scored.filter(F.col("score") >= REJECT_SCORE).select(F.struct("doc_id", "th", "th2").alias("_row"))
    return _without(docs, staged(rejected.distinct(), work_folder(spark, "rejected")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that occurred before, and documents of which only white space is left."""
    packed = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("others"))
    reduced = lines.dedup_lines(packed)
    emptied = (F.col("dropped_lines") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = reduced.filter(~F.coalesce(emptied, F.lit(False)))
    made = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    return kept.select(*[made.get(c, F.col("others")[c]).alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least doc_id of every group of near copies, and one row of a repeated doc_id and text.

    Five-word shingles, similarity 0.8. Rows are told apart by doc_id and text; a null doc_id comes last.
    """
    rows = docs.select(_row().alias("_row"), "text").withColumn("id", F.xxhash64("_row.doc_id", "text"))
    groups = jaccard.near_documents(rows.select(F.col("id").alias("doc_id"), "text"), width=5, num=80, den=100)
    groups = groups.groupBy(F.col("doc_id").alias("id")).agg(F.min("component_id").alias("component_id"))
    counted = rows.groupBy("_row", "id").agg(F.count("*").alias("n"))
    counted = staged(counted.join(groups, "id"), work_folder(spark, "groups"))
    order = F.struct(F.col("_row.doc_id").isNull().alias("last"), "_row", "id")
    best = counted.groupBy("component_id").agg(F.min(order).alias("best"), F.count("*").alias("members")).filter("members > 1")
    best = staged(best.select("component_id", F.col("best._row").alias("best")), work_folder(spark, "best"))
    lost = counted.join(broadcast_if_few(best), "component_id").filter("NOT _row <=> best").select("_row")
    lost = staged(lost, work_folder(spark, "lost"))
    repeated = counted.filter("n > 1").join(broadcast_if_few(lost), "_row", "left_anti").select("_row")
    again = docs.select(_row().alias("_row"), F.struct(*docs.columns).alias("document"))
    again = again.join(broadcast_if_few(repeated), "_row", "left_semi").groupBy("_row")
    again = again.agg(F.min_by("document", F.struct("document.source", "document.lang")).alias("document"))
    return _without(docs, lost.union(repeated)).unionByName(again.select(*[F.col("document")[c].alias(c) for c in docs.columns]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    with _batches_of(spark, 1000):
        found = contamination.contaminated(docs.select(_row().alias("doc_id"), "text"), benchmark).select("doc_id").distinct()
        found = staged(found, work_folder(spark, "found"))
    return _without(docs, found)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    packed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("document"))
    mixed = mixing.mix_sources(packed).filter("copies > 0")
    copies = mixed.select("document", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return copies.select(*[F.col("document")[c].alias(c) for c in docs.columns if c != "copy"], "copy")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return docs
