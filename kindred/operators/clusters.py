"""Clusters of clones and the relations that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from kindred.functions import scalars as S
from kindred.operators.components import components
from kindred.session import cut


def cluster_members(pairs: DataFrame) -> DataFrame:
    """(cluster_id, block_id) of directed pairs (source_id, target_id); a cluster's id is its least block id."""
    return components(pairs, "source_id", "target_id").select(F.col("root").alias("cluster_id"), F.col("node").alias("block_id"))


def clusters(pairs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(cluster_id, size, avg_similarity, clone_type), largest first: the mean is over the directed pairs of a cluster."""
    members = cluster_members(pairs) if members is None else members
    mean = pairs.join(members.withColumnRenamed("block_id", "source_id"), "source_id").groupBy("cluster_id").agg(F.avg("similarity").alias("avg_similarity"))
    size = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    return size.join(mean, "cluster_id").withColumn("clone_type", S.clone_type(F.col("avg_similarity"))).orderBy(F.desc("size"), "cluster_id")


def copy_classes(vectors: DataFrame) -> DataFrame:
    """(block_id, embedding, hashes) of each distinct vector of (block_id, embedding): its least id, and its copies and the pairs among them as hashes.

    Rows of an id that comes more than once are no pairs of each other, so they share a class only with their like.
    """
    kept = vectors.where(F.col("block_id").isNotNull() & F.col("embedding").isNotNull())
    again = kept.groupBy("block_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block_id", F.col("block_id").alias("again"))
    classes = kept.join(again, "block_id", "left").groupBy("embedding", "again").agg(F.min("block_id").alias("block_id"), F.count(F.lit(1)).alias("n"))
    among = F.when(F.col("again").isNull(), F.expr("n * (n - 1) div 2")).otherwise(F.lit(0))
    return cut(classes.select("block_id", "embedding", F.array("n", among.cast("long")).alias("hashes"), F.when(F.col("again").isNull(), F.col("n")).otherwise(F.lit(1)).alias("members")))


def linked_nodes(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(cluster_id, block_id, members, weight, total) of the classes that their links (`block_pairs` with ``linked``) or their copies put into a cluster."""
    links = cut(links)
    roots = components(links, "source_id", "target_id").select(F.col("node").alias("block_id"), "root")
    copies = classes.groupBy("block_id").agg(F.max("members").alias("members"))
    sums = links.groupBy(F.col("source_id").alias("block_id")).agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))
    # Copies that are linked with nothing else are in no edge; a row that only others are linked to has no sums.
    return sums.join(roots, "block_id", "full").join(copies, "block_id").select(F.coalesce("root", "block_id").alias("cluster_id"), "block_id", "members", "weight", "total")


def linked_clusters(links: DataFrame, classes: DataFrame) -> DataFrame:
    """`clusters` of the classes' links, copies counted."""
    return node_clusters(linked_nodes(links, classes))


def node_clusters(nodes: DataFrame) -> DataFrame:
    """`clusters` of ``linked_nodes``."""
    found = nodes.groupBy("cluster_id").agg(F.sum("members").alias("size"), (F.sum("total") / F.sum("weight")).alias("avg_similarity")).where("size >= 2")
    return found.withColumn("clone_type", S.clone_type(F.col("avg_similarity"))).orderBy(F.desc("size"), "cluster_id")


def star_pairs(members: DataFrame) -> DataFrame:
    """(cluster_id, representative, block_id): each other member beside the cluster's first."""
    first = members.groupBy("cluster_id").agg(F.min("block_id").alias("representative"))
    return members.join(first, "cluster_id").where("block_id <> representative").select("cluster_id", "representative", "block_id")


def clusters_for_file(members: DataFrame, blocks: DataFrame, path) -> DataFrame:
    """Members of the clusters that touch a file."""
    own = members.join(blocks.where(F.col("file_path") == F.lit(path)).select("block_id"), "block_id", "left_semi").select("cluster_id").distinct()
    return members.join(own, "cluster_id", "left_semi")


def scan_summary(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """One row: files, blocks, languages; clone pairs (members beyond the first of each cluster) and clusters."""
    one = blocks.agg(F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("blocks"), F.array_sort(F.collect_set("language")).alias("languages"))
    two = found.agg(F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("clone_pairs"), F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("cloned_blocks"))
    return one.crossJoin(two)


def by_type(found: DataFrame) -> DataFrame:
    """Blocks and clusters of each clone type."""
    return found.groupBy("clone_type").agg(F.sum("size").alias("blocks"), F.count(F.lit(1)).alias("clusters"))


def clones_by_file(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file_path, clones), most first."""
    return members.join(blocks.select("block_id", "file_path"), "block_id").groupBy("file_path").agg(F.count(F.lit(1)).alias("clones")).orderBy(F.desc("clones"), "file_path")


def clones_at(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file_path, start_line, end_line, clones): how many cloned blocks lie at each place of a file."""
    place = ["file_path", "start_line", "end_line"]
    return members.join(blocks.select("block_id", *place), "block_id").groupBy(*place).agg(F.count(F.lit(1)).alias("clones"))


def ci_gate(summary: DataFrame, max_pairs: int, max_percent: float) -> DataFrame:
    """Whether a summary is within both limits, with the ratio in percent."""
    ratio = F.col("clone_pairs") / F.greatest(F.col("blocks"), F.lit(1)) * 100
    return summary.select("clone_pairs", "blocks", ratio.alias("percent"), ((F.col("clone_pairs") <= max_pairs) & (ratio <= max_percent)).alias("passed"))


def first_per(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key: one diagnostic per range, one lens per line, first insertion of an id."""
    return rows.withColumn("__place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__place = 1").drop("__place")
