"""The clone index as relations: vectors with their hashes, and narrow buckets (table, hash, block).

Buckets hold ids only; a block joins back to its vector when a candidate is verified. All-zero vectors are left out: their
cosine with anything is 0, and they would all meet in one bucket.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from kindred.config import LshConfig
from kindred.functions import scalars as S
from kindred.functions.hyperplanes import planes, srp_hashes, srp_margins
from kindred.session import ship

#: Up to this many probe rows the probe side is broadcast.
BROADCAST_ROWS = 50_000


@dataclass(frozen=True)
class CloneIndex:
    """vectors(block_id, embedding, hashes), buckets(tbl, hash, block_id) and optionally blocks(block_id, ...)."""

    config: LshConfig
    vectors: DataFrame
    buckets: DataFrame
    blocks: DataFrame | None = None

    @staticmethod
    def build(vectors: DataFrame, config: LshConfig, blocks: DataFrame | None = None) -> CloneIndex:
        """Index (block_id, embedding); of rows with the same id the first by embedding stays."""
        ship(vectors.sparkSession)
        kept = vectors.select("block_id", "embedding").where(F.col("block_id").isNotNull() & F.exists("embedding", lambda x: x != 0))
        kept = kept.groupBy("block_id").agg(F.min("embedding").alias("embedding"))
        hashed = kept.withColumn("hashes", srp_hashes(F.col("embedding"), planes(config)))
        return CloneIndex(config, hashed, bucket_rows(hashed), blocks)

    def append(self, vectors: DataFrame) -> CloneIndex:
        """Add vectors; an id that is already there is replaced, so no bucket keeps an entry of its old vector."""
        new = CloneIndex.build(vectors, self.config)
        kept = self.remove(new.vectors.select("block_id"))
        both = kept.vectors.unionByName(new.vectors)
        return replace(self, vectors=both, buckets=kept.buckets.unionByName(new.buckets))

    def remove(self, ids: DataFrame) -> CloneIndex:
        """Drop the blocks of ``ids`` (block_id) everywhere."""
        ids = ids.select("block_id").distinct()
        blocks = self.blocks.join(ids, "block_id", "left_anti") if self.blocks is not None else None
        return replace(self, vectors=self.vectors.join(ids, "block_id", "left_anti"), buckets=self.buckets.join(ids, "block_id", "left_anti"), blocks=blocks)

    def clear(self) -> CloneIndex:
        return replace(self, vectors=self.vectors.limit(0), buckets=self.buckets.limit(0), blocks=self.blocks.limit(0) if self.blocks is not None else None)

    def save(self, path: str) -> None:
        """One Parquet table per relation; buckets by table, so that a probe of one table reads one folder."""
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        self.buckets.write.mode("overwrite").partitionBy("tbl").parquet(f"{path}/buckets")
        if self.blocks is not None:
            self.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        c = self.config
        spark = self.vectors.sparkSession
        row = (c.tables, c.bits, c.dimension, c.seed, c.probes, c.scored_probes, c.orthogonal, c.bucket_rows, c.overflow_buckets, self.blocks is not None)
        spark.createDataFrame([row], "tables int, bits int, dimension int, seed int, probes int, scored_probes boolean, orthogonal boolean, bucket_rows int, overflow_buckets int, has_blocks boolean").write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CloneIndex:
        meta = spark.read.parquet(f"{path}/meta").first().asDict()
        blocks = spark.read.parquet(f"{path}/blocks") if meta.pop("has_blocks") else None
        buckets = spark.read.parquet(f"{path}/buckets")
        return CloneIndex(LshConfig(**meta), spark.read.parquet(f"{path}/vectors"), buckets.select(F.col("tbl").cast("int").alias("tbl"), "hash", "block_id"), blocks)

    # --- lookups and statistics -----------------------------------------------------------------------------

    def size(self) -> int:
        return self.vectors.count()

    def has(self, block_id) -> bool:
        return self.vectors.where(F.col("block_id") == F.lit(block_id)).limit(1).count() > 0

    def tables_of(self, block_id) -> DataFrame:
        return self.buckets.where(F.col("block_id") == F.lit(block_id))

    def stats(self) -> DataFrame:
        """One row: blocks, buckets, and the sizes of buckets."""
        per = bucket_sizes(self.buckets)
        c = self.config
        return per.agg(
            F.lit(c.tables).alias("num_tables"), F.lit(c.bits).alias("num_bits"), F.count(F.lit(1)).alias("num_buckets"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_entries"),
            F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("avg_size"), F.coalesce(F.sum(F.greatest(F.col("n") - c.bucket_rows, F.lit(0))), F.lit(0)).alias("overflow_entries"),
        )

    def occupancy(self) -> DataFrame:
        """One row: buckets, entries of a table and of a bucket on average; both are 0 for an empty index."""
        tables = float(self.config.tables)
        sums = bucket_sizes(self.buckets).agg(F.count(F.lit(1)).alias("total_buckets"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_entries"))
        of_table = F.col("total_entries") / tables
        return sums.select("total_buckets", of_table.alias("load_factor"), (of_table / F.greatest(F.col("total_buckets") / tables, F.lit(1.0))).alias("avg_bucket_size"))


def bucket_rows(hashed: DataFrame) -> DataFrame:
    return hashed.select("block_id", F.posexplode("hashes").alias("tbl", "hash")).select("tbl", "hash", "block_id")


def bucket_sizes(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("tbl", "hash").agg(F.count(F.lit(1)).alias("n"))


def bucket_fill(buckets: DataFrame, config: LshConfig) -> DataFrame:
    """Per bucket: the rows that its primary bucket holds, and those beyond it, none left out."""
    primary = F.least(F.col("n"), F.lit(config.bucket_rows))
    return bucket_sizes(buckets).select("tbl", "hash", primary.alias("primary_rows"), (F.col("n") - primary).alias("overflow_rows"))


def capped(buckets: DataFrame, config: LshConfig, order: str = "block_id") -> DataFrame:
    """The first rows of each bucket by ``order``, as a store with a primary bucket and overflow buckets would keep; an explicit opt-in, since it loses candidates."""
    most = config.bucket_rows * (1 + config.overflow_buckets)
    return buckets.withColumn("place", F.row_number().over(W.partitionBy("tbl", "hash").orderBy(order))).where(F.col("place") <= most).drop("place")


def probe_rows(queries: DataFrame, config: LshConfig) -> DataFrame:
    """(query_id, tbl, hash) of every bucket that (query_id, embedding) look into: those of the lowest bits flipped, or of the bits that
    the vector is nearest to flipping itself (``scored_probes``)."""
    ship(queries.sparkSession)
    normals = planes(config)
    hashed = queries.withColumn("hashes", srp_hashes(F.col("embedding"), normals))
    if config.scored_probes:
        best = lambda t: S.scored_probes(F.element_at("hashes", t + 1), srp_margins(F.col("embedding"), normals, t), config.bits, config.probes + 1)
        at = hashed.select("query_id", F.posexplode(F.array(*[F.transform(best(t), lambda p: p["hash"]) for t in range(config.tables)])).alias("tbl", "probes"))
        return at.select("query_id", "tbl", F.explode("probes").alias("hash"))
    at = hashed.select("query_id", F.posexplode("hashes").alias("tbl", "h"))
    return at.select("query_id", "tbl", F.explode(S.probes(F.col("h"), config.bits, config.probes)).alias("hash"))


def candidates(probes: DataFrame, buckets: DataFrame, broadcast: bool = False) -> DataFrame:
    """(query_id, block_id, table_matches): in how many tables a query's probes met a block."""
    side = F.broadcast(probes) if broadcast else probes
    met = side.join(buckets, ["tbl", "hash"]).select("query_id", "block_id", "tbl").distinct()
    return met.groupBy("query_id", "block_id").agg(F.count(F.lit(1)).alias("table_matches"))


def analytics(buckets: DataFrame, accesses: DataFrame | None = None) -> DataFrame:
    """Per bucket: insertions, collisions, and accesses of a log (tbl, hash)."""
    per = bucket_sizes(buckets).select("tbl", "hash", F.col("n").alias("insertions"), (F.col("n") - 1).alias("collisions"))
    if accesses is None:
        return per.withColumn("accesses", F.lit(0).cast("long"))
    log = accesses.groupBy("tbl", "hash").agg(F.count(F.lit(1)).alias("accesses"))
    return per.join(log, ["tbl", "hash"], "left").withColumn("accesses", F.coalesce("accesses", F.lit(0)))


def hot_spots(stats: DataFrame, k: int = 10) -> DataFrame:
    return stats.orderBy((F.col("collisions") + F.col("accesses")).desc(), "tbl", "hash").limit(k)


def evict_oldest(rows: DataFrame, access: str, key: str, capacity: int, share: float = 0.1) -> DataFrame:
    """What stays after the least recently used share goes, once there are ``capacity`` rows."""
    n = rows.count()
    if n < capacity:
        return rows
    gone = rows.orderBy(access, key).limit(int(n * share)).select(key)
    return rows.join(gone, key, "left_anti")
