"""Sharding by global byte-size prefix sums, in DataFrame functions only.

Rows lie in one global order: by the MD5 of the text (so equal texts are neighbours), then by a slice of the
id, then by id. Totals of bytes and rows per slice, then per range of the digest, then over all ranges give
every row its place in the global byte line without any global sort; the line is cut at equal targets into
contiguous shards. A group of equal texts goes whole to the shard that holds its middle, unless it is larger
than half a shard: then its rows are cut at the targets like any others.

Only narrow rows (digest, id, size, checksum) are shuffled, once. A group of copies is dealt over up to
256 slices, so a text that fills a third of the table does not meet in one task.

Defined results: a null text has size 1 and checksum 0 and forms one group of its own with the other null
texts; an empty text likewise has size 1; equal rows get different slots; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from kindred.session import cut

#: Slices into which the copies of one text are dealt, as hexadecimal digits of the id's MD5: 16 ** 2.
SLICE_DIGITS = 2
#: Ranges of the digest, as hexadecimal digits: 16 ** 3 totals in the top prefix sum.
RANGE_DIGITS = 3


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs`` (doc_id, text)."""
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("digest"),
    )
    slice_ = F.coalesce(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, SLICE_DIGITS), F.lit(""))
    rows = cut(rows.withColumn("slice", slice_))

    slices = rows.groupBy("digest", "slice").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    slices = slices.withColumn("range", F.substring("digest", 1, RANGE_DIGITS))
    along = W.partitionBy("range").orderBy("digest", "slice")
    group = W.partitionBy("range", "digest")
    up_to = W.partitionBy("range").orderBy("digest")
    slices = slices.select(
        "digest", "slice", "range",
        (F.sum("bytes").over(along) - F.col("bytes")).alias("start"),
        (F.sum("n").over(along) - F.col("n")).alias("first"),
        F.sum("bytes").over(group).alias("group_bytes"),
        (F.sum("bytes").over(up_to) - F.sum("bytes").over(group)).alias("group_start"),
    )
    # At most 16 ** RANGE_DIGITS rows from here to the broadcast.
    ranges = rows.groupBy(F.substring("digest", 1, RANGE_DIGITS).alias("range")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    line, all_ = W.orderBy("range"), W.partitionBy(F.lit(1))
    ranges = ranges.select(
        "range",
        (F.sum("bytes").over(line) - F.col("bytes")).alias("range_start"),
        (F.sum("n").over(line) - F.col("n")).alias("range_first"),
        F.sum("bytes").over(all_).alias("total"),
    )
    slices = slices.join(F.broadcast(ranges), "range")
    inside = W.partitionBy("digest", "slice").orderBy(F.col("doc_id").asc_nulls_first(), "size")
    placed = rows.select(
        "*",
        (F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")).alias("offset"),
        (F.row_number().over(inside) - 1).alias("nth"),
    ).join(slices, ["digest", "slice"])
    start = F.col("range_start") + F.col("start") + F.col("offset")
    twice_row = 2 * start + F.col("size")
    twice_group = 2 * (F.col("range_start") + F.col("group_start")) + F.col("group_bytes")
    whole = F.col("group_bytes") * F.lit(2 * shards) <= F.col("total")
    middle = F.when(whole, twice_group).otherwise(twice_row)
    placed = cut(
        placed.select(
            "doc_id", "size", "text_crc32",
            F.least(F.floor(middle * F.lit(shards) / (2 * F.col("total"))), F.lit(shards - 1)).cast("int").alias("shard"),
            (F.col("range_first") + F.col("first") + F.col("nth")).alias("place"),
        )
    )
    begins = placed.groupBy("shard").agg(F.min("place").alias("begin"))  # one row per shard
    return placed.join(F.broadcast(begins), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("begin")).alias("slot"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_by_bytes(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return table


OP8_SQL = f"""
WITH crc AS (SELECT {_crc_table()}::BIGINT[] AS t),
bytes AS (SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
docs AS (
  SELECT doc_id, len(b)::BIGINT + 1 AS size, coalesce(md5(text), '') AS digest, coalesce(substr(md5(doc_id::VARCHAR), 1, 2), '') AS slice,
         xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM bytes CROSS JOIN crc
), line AS (
  SELECT *, sum(size) OVER (ORDER BY digest, slice, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS start, row_number() OVER (ORDER BY digest, slice, doc_id NULLS FIRST, size) - 1 AS place,
         sum(size) OVER (PARTITION BY digest) AS group_bytes, sum(size) OVER () AS total FROM docs
), grouped AS (SELECT *, min(start) OVER (PARTITION BY digest) AS group_start FROM line
), cut AS (
  SELECT *, least(floor((CASE WHEN group_bytes * 32 <= total THEN 2 * group_start + group_bytes ELSE 2 * start + size END)::DOUBLE * 16 / (2 * total)::DOUBLE), 15)::INT AS shard FROM grouped
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM cut
"""
