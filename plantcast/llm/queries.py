"""The registered query of every operator, with production parameters, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantcast.llm import chat, contamination, jaccard, language, lines, mixing, negatives, phrases, pii, recurrent, toxicity, vectors, warc
from plantcast.llm.common import work_folder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    probe = spark.sql("SELECT -7L AS conv_id, turn, role FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    examples = chat.prefix_examples(talks.unionByName(probe.withColumn("text", F.lit(said))))
    return chat.digests(examples)


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise_documents(documents, key=b"change me in production")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = language.learn(documents.filter(fold != 0).select("text", "lang"))
    held_out = F.coalesce(fold == 0, F.lit(False)).alias("held_out")
    return language.identify(documents, model).select("doc_id", held_out, "lang_pred", "score", "ambiguous")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "copies")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_documents(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    labels = table(spark, sf_dir, "labels").filter(fold != 2).select("doc_id", "toxic")
    scored = toxicity.Model(documents, labels).score(documents, ["doc_id"])
    held_out = F.coalesce(fold == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "warc")
    warc.write_archives(warc.resolve_revisits(table(spark, sf_dir, "pages")), folder)
    return warc.read_archives(spark, folder).drop("url")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(documents).select("doc_id", "n_lines", "dropped_lines", "text")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"), least=100, most=2000)


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    held_out = F.coalesce(fold == 2, F.lit(False)).alias("held_out")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", held_out)
    model = recurrent.Model(documents.filter("NOT held_out").select("text"))
    return model.score(documents, ["doc_id", "held_out"])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.hard_negatives(embeddings, F.col("vec_id") % 100 == 0, positives=5, negatives=5, scale=256.0)


def queries() -> dict[str, Query]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_chat_format": op2_chat_format,
        "op3_pii_pseudonyms": op3_pii_pseudonyms,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_language_id": op5_language_id,
        "op6_mix_sources": op6_mix_sources,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_toxicity": op8_toxicity,
        "op9_warc_revisit": op9_warc_revisit,
        "op10_line_dedup": op10_line_dedup,
        "op11_collocations": op11_collocations,
        "op12_lm_scores": op12_lm_scores,
        "op13_hard_negatives": op13_hard_negatives,
    }
