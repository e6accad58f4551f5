"""Corpus preparation as a chain of stages. Each stage takes (spark, docs, sf_dir); its result is written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import op1_langid, op2_lines, op3_bpe, op4_jaccard, op10_mix
from pagelens.session import own_folder, table

#: Near copies share so many words a shingle and so many percent of their shingles.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: A document goes if its languages are this mixed, or if so few of its features are of any learned language; ``und`` goes as well.
LEAST_SCORE, LEAST_KNOWN = 0.3, 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language.

    Null and empty texts and texts without a letter go; texts of any length are labelled whole; repeated rows share one fate, ties
    go to the alphabetically first language; without any labelled row everything goes; an empty table gives an empty one."""
    return op1_langid.recognised(docs, op1_langid.fit(docs), LEAST_SCORE, least_known=LEAST_KNOWN)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes cross-site boilerplate lines. A document of nothing else goes: its lines stay with their first carrier.

    Null and empty texts stay as they are; null sources spread no line; rows with equal ids are told apart by their texts; n_chars
    follows the text where that changes; an empty table gives an empty one."""
    out = op2_lines.remove_boilerplate(docs)
    out = out.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*docs.columns)


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each component; rows that repeat an id are one document and stay together.

    Texts without words are in no component but their own; a null id stays only where its component has no other; an empty table
    gives an empty one."""
    keep = op4_jaccard.jaccard_components(docs, NEAR_WORDS, NEAR_PERCENT).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col("__keep")), "left_semi")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents to the target weights.

    Null sources and languages are of the group ``*``; texts without words follow their cell; repeated rows share one fate, rows
    with a null id that of their text; marginals that cannot hold are an error; an empty table gives an empty one."""
    return op10_mix.mix_sources(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the columns that identify it.

    A null text is empty and has no tokens; texts of any length are encoded whole; repeated rows and null ids stay; an empty table
    gives an empty one."""
    import public_tokenizers as P

    out = op3_bpe.encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("jaccard_dedup", jaccard_dedup), ("mix", mix), ("encode", encode)]
#: The stages' models and similarity joins are beyond SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each but the last is written as Parquet in the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), own_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
