"""TF-IDF vectors of tokenised blocks, projected to a dense unit vector; and the hash-seeded stand-in model.

``idf='batch'`` uses the whole collection's document frequencies: order-free, and equal blocks get equal vectors.
``idf='online'`` gives a block the frequencies of the blocks up to it in an ingest order, as an engine that learns while it
indexes would. Both are joins and windows; only the projection runs in Python, one Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from kindred.functions import scalars as S
from kindred.functions.terms import CODED, batch_terms, coded, coded_terms, gaussian, projected, totals
from kindred.session import cut, release, ship


def term_frequencies(tokens: DataFrame, n: int = 2) -> DataFrame:
    """(block_id, term, tf) of (block_id, keys ARRAY<STRING>): the keys themselves and their n-grams."""
    terms = F.concat("keys", S.ngrams(F.col("keys"), n)) if n > 1 else F.col("keys")
    return tokens.select("block_id", F.explode(terms).alias("term")).groupBy("block_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(tf: DataFrame, min_df: int = 1, max_df: int | None = None) -> DataFrame:
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    return df if max_df is None else df.where(F.col("df") <= max_df)


def running_document_frequencies(tf: DataFrame, order: str = "block_id") -> DataFrame:
    """df of each term as of each document in ingest order."""
    upto = W.partitionBy("term").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return tf.withColumn("df", F.count(F.lit(1)).over(upto))


def vocabulary(tf: DataFrame, most: int, order: str = "block_id") -> DataFrame:
    """(term, idx) by first appearance (ties by term), the first ``most``."""
    first = tf.groupBy("term").agg(F.min(order).alias("first"))
    head = first.orderBy("first", "term").limit(most)
    return head.withColumn("idx", (F.row_number().over(W.orderBy("first", "term")) - 1).cast("int")).drop("first")


def weights(tf: DataFrame, df: DataFrame, n_docs) -> DataFrame:
    """(block_id, term, weight): sub-linear tf by smoothed idf; terms without a frequency contribute nothing."""
    joined = tf.join(df, "term")
    return joined.select("block_id", "term", (S.tf_weight(F.col("tf")) * S.idf_smooth(F.lit(float(n_docs)), F.col("df"))).alias("weight")).where("weight > 0")


def online_weights(tf: DataFrame, order: str = "block_id") -> DataFrame:
    """The same with the frequencies as of each document; the document count is its place in the order."""
    run = running_document_frequencies(tf, order)
    place = tf.select(order).distinct().withColumn("n", F.row_number().over(W.orderBy(order)))
    joined = run.join(place, order)
    return joined.select("block_id", "term", (S.tf_weight(F.col("tf")) * S.idf_smooth(F.col("n").cast("double"), F.col("df"))).alias("weight"))


#: Up to this many terms of several blocks, their frequencies are sent to every task; beyond, terms are joined with them.
SENT_TERMS = 16_000_000


#: What of a row of ``coded_texts`` its terms are made of.
_CHUNK = ["ids", "copies", "lens", "keys", "codes"]


def _text_columns(blocks: DataFrame, *more: str) -> DataFrame:
    ship(blocks.sparkSession)
    return blocks.select("block_id", F.col("content").cast("string").alias("content"), F.col("language").cast("string").alias("language"), *more)


def _term_rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for ids, terms in found:
        at = np.repeat(np.arange(len(terms)), [len(t) for t, _ in terms])
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(np.concatenate([t for t, _ in terms])), pa.array(np.concatenate([c for _, c in terms]))], ["block_id", "term", "tf"])


def term_rows(blocks: DataFrame, n: int = 2) -> DataFrame:
    """(block_id, term BIGINT, tf) of (block_id, content, language): token keys and their n-grams as 64-bit hashes."""
    kind = blocks.schema["block_id"].dataType.simpleString()

    return _text_columns(blocks).mapInArrow(lambda batches: _term_rows(batch_terms(batches, n)), f"block_id {kind}, term long, tf long")


def text_frequencies(blocks: DataFrame, n: int = 2) -> DataFrame:
    """(term, df) of the terms that ``term_rows`` finds; counted within tasks first, no row of a block and term is made."""
    counted = _text_columns(blocks).mapInArrow(lambda batches: totals((np.ones(len(found), np.int64), [t for t, _ in found]) for _, found in batch_terms(batches, n)), "term long, df long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"))


def coded_texts(blocks: DataFrame) -> DataFrame:
    """Rows of many texts each, as of `terms.coded`, of (block_id, content, language, copies): each text is tokenised once."""
    kind = blocks.schema["block_id"].dataType.simpleString()
    return cut(_text_columns(blocks, "copies").mapInArrow(coded, f"ids array<{kind}>, {CODED}"))


def coded_frequencies(chunks: DataFrame, n: int = 2) -> DataFrame:
    """``text_frequencies`` of ``coded_texts``, copies counted."""
    counted = chunks.select(*_CHUNK).mapInArrow(lambda batches: totals((copies, [t for t, _ in found]) for _, copies, found in coded_terms(batches, n)), "term long, df long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"))


def _sent(df: DataFrame):
    """The frequencies of terms of several blocks, for the tasks; None where they are too many."""
    common = cut(df.where("df > 1").select("term", F.col("df").cast("int").alias("df")))
    if common.count() > SENT_TERMS:
        release(common)
        return None
    table = common.toArrow()
    release(common)
    keys, counts = (table[c].to_numpy() for c in ("term", "df"))
    del table
    order = np.argsort(keys)
    return df.sparkSession.sparkContext.broadcast((keys[order], counts[order]))


def _joined(rows: DataFrame, dimension: int, df: DataFrame, n_docs: int, min_df: int, max_df: int | None) -> DataFrame:
    kept = df.where(F.col("df") >= min_df)
    kept = kept if max_df is None else kept.where(F.col("df") <= max_df)
    return project(weights(rows, kept, n_docs), dimension)


def _vectors(found: Iterator[tuple], sent, dimension: int, n_docs: int, min_df: int, max_df: int | None) -> Iterator[pa.RecordBatch]:
    known, often = sent.value
    rows = gaussian(7, 1 << 16, dimension)
    for ids, *_, terms in found:
        v = np.array([projected(t, c, known, often, n_docs, min_df, max_df, rows) for t, c in terms], np.float32).reshape(-1)
        yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.arange(len(terms) + 1) * dimension, pa.int32()), pa.array(v))], ["block_id", "embedding"])


def embed_texts(blocks: DataFrame, dimension: int, df: DataFrame, n_docs: int, n: int = 2, min_df: int = 1, max_df: int | None = None) -> DataFrame:
    """(block_id, embedding) of (block_id, content, language): ``project`` of ``weights`` of ``term_rows``, by the ``text_frequencies`` of these blocks.

    Terms of one block alone need no look-up, so only the others are sent to the tasks.
    """
    sent = _sent(df)
    if sent is None:
        return _joined(term_rows(blocks, n), dimension, df, n_docs, min_df, max_df)
    kind = blocks.schema["block_id"].dataType.simpleString()
    return _text_columns(blocks).mapInArrow(lambda batches: _vectors(batch_terms(batches, n), sent, dimension, n_docs, min_df, max_df), f"block_id {kind}, embedding array<float>")


def embed_coded(chunks: DataFrame, dimension: int, df: DataFrame, n_docs: int, n: int = 2, min_df: int = 1, max_df: int | None = None) -> DataFrame:
    """``embed_texts`` of ``coded_texts``."""
    sent, kind = _sent(df), chunks.schema["ids"].dataType.elementType.simpleString()
    own = chunks.select(*_CHUNK)
    if sent is None:
        return _joined(own.mapInArrow(lambda batches: _term_rows((ids, found) for ids, _, found in coded_terms(batches, n)), f"block_id {kind}, term long, tf long"), dimension, df, n_docs, min_df, max_df)
    return own.mapInArrow(lambda batches: _vectors(coded_terms(batches, n), sent, dimension, n_docs, min_df, max_df), f"block_id {kind}, embedding array<float>")


def project(weighted: DataFrame, dimension: int, seed: int = 7, slots: int = 1 << 16) -> DataFrame:
    """(block_id, embedding ARRAY<FLOAT>): each term adds its weight times a fixed Gaussian row, found by the term's hash; unit length."""
    ship(weighted.sparkSession)
    lists = weighted.groupBy("block_id").agg(F.collect_list(F.pmod(F.xxhash64("term"), F.lit(slots)).cast("int")).alias("slot"), F.collect_list("weight").alias("weight"))

    @F.pandas_udf("array<float>")
    def dense(slot: pd.Series, weight: pd.Series) -> pd.Series:
        rows = gaussian(seed, slots, dimension)
        out = []
        for s, w in zip(slot, weight, strict=True):
            order = np.lexsort((w, s))
            v = np.asarray(w, np.float64)[order] @ rows[np.asarray(s)[order]].astype(np.float64)
            size = np.linalg.norm(v)
            out.append((v / size if size else v).astype(np.float32))
        return pd.Series(out)

    return lists.select("block_id", dense("slot", "weight").alias("embedding"))


def embed(tokens: DataFrame, dimension: int, n: int = 2, min_df: int = 1, idf: str = "batch") -> DataFrame:
    """(block_id, embedding) of (block_id, keys)."""
    tf = term_frequencies(tokens, n)
    if idf == "online":
        return project(online_weights(tf), dimension)
    return project(weights(tf, document_frequencies(tf, min_df), tokens.count()), dimension)


def mock_embed(blocks: DataFrame, dimension: int) -> DataFrame:
    """(block_id, embedding) of (block_id, content): a unit vector drawn from a generator seeded by the text's hash; equal texts, equal vectors."""
    ship(blocks.sparkSession)

    @F.pandas_udf("array<float>")
    def drawn(h: pd.Series) -> pd.Series:
        out = []
        for x in h:
            v = np.random.Generator(np.random.PCG64(int(x) & ((1 << 64) - 1))).standard_normal(dimension)
            out.append((v / np.linalg.norm(v)).astype(np.float32))
        return pd.Series(out)

    return blocks.select("block_id", drawn(F.xxhash64("content")).alias("embedding"))
