"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every source gets a target number of words (water filling under a cap of whole copies). A source whose
target is r times its size gives each of its documents floor(r) copies for certain; the fraction
p = r - floor(r) is the share of its words that one more copy is to bring. Documents take part with unequal
probabilities: the odds of a document of s words are those of p times (m + 4 s) / (2 m + 2 s), m being the
source's mean size, so they run from half of p's odds for the shortest to twice them for the longest. Documents
are ranked by the Pareto order

    q = (u / (1 - u)) / (p_i / (1 - p_i)),        u uniform, from a digest of seed and doc_id

and the head of that order is taken until the source's remaining words are reached. Long documents (above the
source's mean size) are drawn first, against their part of the expected words, and the short ones then make up
what is left, so the words taken end within half a short document of the target.

Nothing about a source is one task's work: sources are numbered by ranges of their names, the level of the water
is found by sums over their table, and a source's documents are ranked in buckets of the order.

Defined results: null text has size 0 and takes 0 words; a null source is a source of its own and comes
last; an empty table gives an empty result; repeated rows are separate documents (equal ids tie, and ties go
by size); other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from kindred.session import cut, release

#: Up to this many sources the table of sources is broadcast; above, it is joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Documents in a bucket of the rank order: the most that one window frame group holds, on average.
BUCKET_ROWS = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str, doc_id):
    """A number in (0, 1) from 52 bits of the MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, max_copies: int) -> DataFrame:
    """One row per source: number, source, source_size, n, target. ``sized`` has source and size.

    Water filling: a source whose share at the present level is above its cap keeps the cap, which raises the level for the
    others, until no further one does. Only sums over the sources come to the driver.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranged = cut(per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("of_part"))  # at most as many rows as partitions
    parts = parts.select("part", (F.sum("of_part").over(W.orderBy("part")) - F.col("of_part")).alias("first"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    table = F.array(*[F.lit(float(w)) for w in weights])
    per = ranged.withColumn("nth", inside).join(F.broadcast(parts), "part").withColumn("number", F.col("first") + F.col("nth"))
    per = per.withColumn("weight", F.element_at(table, (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int")))
    numbered = cut(per.select("number", "source", "source_size", "n", "weight", (F.col("source_size") * F.lit(float(max_copies))).alias("cap")))
    release(ranged)
    words = (numbered.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, closed = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        now = numbered.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if now[2] == closed or not now[1]:
            break
        level, closed = (words - now[0]) / now[1], now[2]
    return numbered.select("number", "source", "source_size", "n", F.when(over, F.col("cap")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_copies: int = 2, seed: str = "mix", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of ``docs`` (doc_id, text, source)."""
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    sources = cut(source_targets(sized, weights, share, max_copies))
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    side = sources.withColumnRenamed("source", "of_source")
    rows = sized.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    words_n = F.col("size") * F.col("n")
    rows = (
        rows.withColumn("whole", F.floor(ratio))
        .withColumn("p", ratio - F.col("whole"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("u", uniform(seed, F.col("doc_id")))
        .withColumn("base", F.when(F.col("p") > 0, F.col("p") / (1 - F.col("p"))).otherwise(F.lit(1.0)))
        .withColumn("favour", F.when(F.col("source_size") > 0, (F.col("source_size") + 4 * words_n).cast("double") / (2 * F.col("source_size") + 2 * words_n).cast("double")).otherwise(F.lit(1.0)))
        .withColumn("odds", F.col("base") * F.col("favour"))
        .withColumn("q", (F.col("u") / (1 - F.col("u"))) / F.col("odds"))
        .withColumn("expected", F.floor(F.lit(1024.0) * F.col("odds") / (1 + F.col("odds")) * F.col("size")))  # in 1,024ths, so that sums don't depend on their order
        .withColumn("long", words_n > F.col("source_size"))
        .withColumn("buckets", F.ceil(F.col("n") / F.lit(bucket_rows)))
        .withColumn("at", F.col("q") * F.col("base"))
        .withColumn("bucket", F.least(F.floor(F.col("at") / (1 + F.col("at")) * F.col("buckets")), F.col("buckets") - 1))  # at most twice as dense anywhere as evenly dealt
        .select("doc_id", "source", "size", "source_size", "target", "whole", "p", "rest", "q", "expected", "number", "long", "bucket")
    )
    keys = ["number", "long", "bucket"]
    inside = W.partitionBy(*keys).orderBy("q", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    totals = rows.groupBy(*keys).agg(F.sum("size").alias("words"), F.sum("expected").alias("hoped"))
    along, of_part, of_source = W.partitionBy("number", "long").orderBy("bucket"), W.partitionBy("number", "long"), W.partitionBy("number")
    totals = totals.select(*keys, (F.sum("words").over(along) - F.col("words")).alias("start"), F.sum("hoped").over(of_part).alias("hoped_part"), F.sum("hoped").over(of_source).alias("hoped_all"))
    rows = cut(rows.join(totals, keys).withColumn("before", F.col("before") + F.col("start")).drop("start", "expected"))
    half = F.col("before") + F.col("size") / 2.0
    part = F.when(F.col("hoped_all") > 0, F.col("rest") * F.col("hoped_part").cast("double") / F.col("hoped_all").cast("double")).otherwise(F.lit(0.0))
    rows = rows.withColumn("long_more", F.col("long") & (F.col("p") > 0) & (half <= part))
    gained = rows.where("long_more").groupBy("number").agg(F.sum("size").alias("gained"))
    rows = rows.join(F.broadcast(gained) if few else gained, "number", "left").withColumn("gained", F.coalesce("gained", F.lit(0)))
    short_more = ~F.col("long") & (F.col("p") > 0) & (half <= F.col("rest") - F.col("gained"))
    copies = F.col("whole") + F.when(F.col("long_more") | short_more, F.lit(1)).otherwise(F.lit(0))
    return rows.withColumn("copies", copies.cast("int")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS number FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (number - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM per
), filled AS (
  SELECT *, row_number() OVER fill AS place,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW fill AS (ORDER BY cap / weight, number)
), opened AS (
  SELECT min(place) AS place, arg_min(level, place) AS level FROM filled WHERE level * weight <= cap
), sources AS (
  SELECT f.source, f.number, f.source_size, f.n,
         CASE WHEN o.place IS NOT NULL AND f.place >= o.place THEN o.level * f.weight ELSE f.cap END AS target
  FROM filled f CROSS JOIN opened o
), ranked AS (
  SELECT d.doc_id, d.size, s.number, s.n, s.source_size, s.target,
         CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0 END AS ratio,
         (('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u,
         d.size * s.n > s.source_size AS long
  FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source
), split AS (
  SELECT *, floor(ratio) AS whole, ratio - floor(ratio) AS p, target - floor(ratio) * source_size AS rest,
         CASE WHEN source_size > 0 THEN (source_size + 4 * size * n)::DOUBLE / (2 * source_size + 2 * size * n)::DOUBLE ELSE 1.0::DOUBLE END AS favour FROM ranked
), odds AS (
  SELECT *, CASE WHEN p > 0 THEN p / (1 - p) ELSE 1.0::DOUBLE END * favour AS odds FROM split
), ordered AS (
  SELECT *, (u / (1 - u)) / odds AS q, floor(1024.0::DOUBLE * odds / (1 + odds) * size)::BIGINT AS expected FROM odds
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY number, long ORDER BY q, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         (sum(expected) OVER (PARTITION BY number, long))::DOUBLE AS hoped_part, (sum(expected) OVER (PARTITION BY number))::DOUBLE AS hoped_all FROM ordered
), drawn AS (
  SELECT *, long AND p > 0 AND before + size / 2.0::DOUBLE <= CASE WHEN hoped_all > 0 THEN rest * hoped_part / hoped_all ELSE 0 END AS long_more FROM placed
), gained AS (
  SELECT number, sum(size)::BIGINT AS gained FROM drawn WHERE long_more GROUP BY number
), copied AS (
  SELECT d.*, (whole + CASE WHEN long_more OR (NOT long AND p > 0 AND before + size / 2.0::DOUBLE <= rest - coalesce(g.gained, 0)) THEN 1 ELSE 0 END)::INT AS copies
  FROM drawn d LEFT JOIN gained g ON d.number = g.number
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM copied
"""
