"""Similarity queries and all-pairs clone search over a clone index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from kindred.functions import scalars as S
from kindred.operators.index import BROADCAST_ROWS, CloneIndex, candidates, probe_rows
from kindred.operators.pairs import block_pairs
from kindred.session import cut


def query(index: CloneIndex, queries: DataFrame, k: int = 50, min_similarity: float = 0.7, prefilter: float | None = None, exclude_self: bool = False) -> DataFrame:
    """(query_id, block_id, table_matches, estimated, similarity, place): up to k blocks per query, most similar first, ties by id.

    A candidate must be met in a share ``prefilter`` of the tables (half of ``min_similarity`` by default) before
    its vector is read and compared.
    """
    least = min_similarity / 2 if prefilter is None else prefilter
    probes = probe_rows(queries, index.config)
    few = queries.limit(BROADCAST_ROWS + 1).count() * index.config.tables * (index.config.probes + 1) <= BROADCAST_ROWS
    met = candidates(probes, index.buckets, few).withColumn("estimated", F.col("table_matches") / index.config.tables).where(F.col("estimated") >= least)
    if exclude_self:
        met = met.where(F.col("query_id") != F.col("block_id"))
    vectors = index.vectors.select("block_id", F.col("embedding").alias("target"))
    found = met.join(vectors, "block_id").join(queries.select("query_id", "embedding"), "query_id")
    found = found.withColumn("similarity", S.cosine(F.col("embedding"), F.col("target"))).where(F.col("similarity") >= min_similarity)
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "block_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "block_id", "table_matches", "estimated", "similarity", "place")


def query_clones(index: CloneIndex, queries: DataFrame, k: int = 100, min_similarity: float = 0.8, types: tuple[str, ...] = (), exclude_path: str | None = None, languages: tuple[str, ...] = ()) -> DataFrame:
    """Two-stage query: twice as many results at 0.8 of the threshold, then the threshold, types, paths and languages, then k.

    ``total_matches`` is a query's number of results before the last limit.
    """
    wide = query(index, queries, 2 * k, 0.8 * min_similarity).where(F.col("similarity") >= min_similarity).withColumn("clone_type", S.clone_type(F.col("similarity")))
    if types:
        wide = wide.where(F.col("clone_type").isin(*types))
    if index.blocks is not None and (exclude_path is not None or languages):
        wide = wide.join(index.blocks.select("block_id", "file_path", "language"), "block_id")
        wide = wide.where(F.col("file_path") != exclude_path) if exclude_path is not None else wide
        wide = wide.where(F.col("language").isin(*languages)) if languages else wide
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "block_id")
    wide = wide.withColumn("total_matches", F.count(F.lit(1)).over(W.partitionBy("query_id")))
    return wide.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def find_similar(index: CloneIndex, block_id, k: int = 100, min_similarity: float = 0.8) -> DataFrame:
    """Blocks like an indexed one, itself left out; an unknown id gives no rows."""
    own = index.vectors.where(F.col("block_id") == F.lit(block_id)).select(F.col("block_id").alias("query_id"), "embedding")
    return query(index, own, k, min_similarity, 0.4 * min_similarity, exclude_self=True)


def clone_pairs(index: CloneIndex, min_similarity: float = 0.8, per_source: int | None = 50, prefilter: float | None = None) -> DataFrame:
    """Directed (source_id, target_id, table_matches, similarity) of all blocks against all, by a join of buckets.

    Probes of fixed low bits are symmetric, so each pair is met, counted and verified once, block against block, and then mirrored.
    ``per_source`` keeps each block's most similar ones; None keeps all.
    """
    least = min_similarity / 2 if prefilter is None else prefilter
    c = index.config
    matches = next(m for m in range(1, c.tables + 2) if m > c.tables or m / c.tables >= least)
    found = block_pairs(index.vectors, min_similarity, matches, S.probe_masks(c.bits, c.probes), per_source)
    if per_source is None:
        one = cut(found)
        return one.unionByName(one.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "table_matches", "similarity"))
    order = W.partitionBy("source_id").orderBy(F.desc("similarity"), "target_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_source).drop("place")


def exact_duplicates(blocks: DataFrame, key: str = "content_hash", id_: str = "block_id") -> DataFrame:
    """(key, n, first_id) of every key that several blocks share."""
    return blocks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(id_).alias("first_id")).where("n > 1")
