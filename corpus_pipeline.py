"""The corpus pipeline: language, near duplicates, personal data, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's documents. All but the last return the columns of documents; ids repeat after the mix, once per copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kindred.llm import language, mixing, neardup, packing, pii
from kindred.session import cut, delete_path, scratch_path


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is identified; rejected ones go.

    Null and empty texts and texts without a letter are rejected; null ids and languages are kept and only not learnt from; repeated
    rows share their fate; an empty table gives no rows; other columns, whatever their names, pass through.
    """
    return language.keep_known(docs)


def row_key() -> Column:
    """Binary that tells rows of documents apart by id and text, and orders them by id (null last), then by the text's SHA-256."""
    id_ = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    text = F.coalesce(F.sha2(F.encode("text", "UTF-8"), 256), F.lit("0" * 64))
    return F.unhex(F.concat(F.when(F.col("doc_id").isNull(), F.lit("01" + "0" * 16)).otherwise(F.concat(F.lit("00"), id_)), text))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): the first by id, then text.

    Rows equal in id and text become one; different texts under one id, or under none, are documents of their own. Null, empty and
    blank texts are near nothing and stay; an empty table gives no rows; other columns, whatever their names, pass through.
    """
    keyed = docs.withColumn("__kindred_key", row_key())
    near = neardup.near_duplicates(keyed.select(F.col("__kindred_key").alias("doc_id"), "text"))
    kept = cut(near.where("kept").groupBy(F.col("doc_id").alias("__kindred_key")).agg(F.count(F.lit(1)).alias("n")))
    repeated = kept.where("n > 1").limit(1).count() > 0
    out = keyed.join(kept.select("__kindred_key"), "__kindred_key", "left_semi")
    return (out.dropDuplicates(["__kindred_key"]) if repeated else out).select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data in its text replaced by the kind's name.

    Null and empty texts stay as they are; repeated rows have equal results; an empty table gives no rows; other columns, whatever
    their names, pass through.
    """
    return pii.mask_pii(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or as whole copies.

    Rows of one id are taken alike, as often as any of them; null ids count as one id, and a null source as a source. Null and empty
    texts have no words. An empty table gives no rows; other columns, whatever their names, pass through.
    """
    copies = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias("__kindred_mixed_id")).agg(F.max("copies").alias("__kindred_copies")).where("__kindred_copies > 0")
    taken = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("__kindred_mixed_id")))
    return taken.withColumn("__kindred_nth", F.explode(F.sequence(F.lit(1), F.col("__kindred_copies")))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row per piece.

    A null or empty text is the end token alone; null ids are kept; repeated rows are packed each; an empty table gives no rows;
    other columns are not used.
    """
    return packing.pack(docs)


STAGES = [
    ("language", keep_known_languages),
    ("near duplicates", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("source mix", mix_to_targets),
    ("packing", pack_sequences),
]

#: SQL can express neither the tagger nor the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return docs
