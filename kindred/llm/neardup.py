"""Near-duplicate documents by SetSketch registers, verified on full shingle sets.

A document's set holds the hashes of its distinct word shingles. A SetSketch of m registers keeps, for each
register, the minimum of an exponential variable over the set, on an exponential scale of base b and truncated to
one byte: K = clip(floor(1 - log_b x), 0, 255). Registers of a union are the registers' maxima, and two sets agree
in a register with a probability that grows with their Jaccard similarity.

1. Equal sets collapse to classes first: a thousand copies are one row from here on.
2. Registers are banded; classes that agree in a whole band meet in a bucket. Each meets only the bucket's
   head (the class that meets most others, so the text that the others were copied from), which gives one candidate
   per member, not all pairs.
3. A candidate is kept if the likelihood of the registers' comparisons (more, fewer, equal), given both exact set
   sizes, has its maximum near or above the threshold; then the full sets are compared.
4. Components of the links are found. Where one bucket still holds several components, all of its members' registers
   are compared in bounded blocks. Members that may pair with one of another component are measured against the head
   too, however little they share with it, and compared in bounded blocks by their differences from the head, which give
   the size of their intersection exactly; only members and links come out of a block, not pairs.

Links are exact on 64-bit shingle hashes; the band table misses a pair at exactly the threshold with a
probability of ``(1 - p ** rows) ** bands``, about 3e-5 by default.

Defined results: null, empty and blank texts have the empty set and link with nothing; repeated rows are copies of
one another; a null id never becomes a component's id (a component of only null ids has a null id and all of
its rows are kept); a table without rows gives no rows; columns other than doc_id and text are not used.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kindred.llm import words
from kindred.llm.worker import by_key, forget_others, give_back
from kindred.operators.components import components
from kindred.session import cut, release, ship

#: Registers per band and bands; base and rate of the exponential scale.
ROWS, BANDS, BASE, RATE = 5, 24, 1.1, 20.0
#: Members of a block where the members of a large bucket are compared.
BLOCK_MEMBERS = 2000
#: Parts over which the rows that share a bucket's head are dealt in joins on it.
SALTS = 32
#: Bits of the filter that spares documents without a wanted id the shuffle of their texts: 4 MiB, whatever the input's size.
FILTER_BITS = 1 << 25
#: Standard deviations that the estimate may lie below the threshold.
SLACK = 4.5

_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The byte registers of a set of 64-bit hashes (not empty)."""
    least = np.full(len(_A), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        h = shingles[at : at + 1024, None] * _A + _B
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, h.min(axis=0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1.0 - np.log(x) / math.log(BASE)), 0, 255).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def jaccard_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 200) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of register rows, given the sets' sizes."""
    more, fewer = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - fewer
    u = (n_a / (n_a + n_b))[:, None]
    v = 1.0 - u
    grid = np.linspace(0.0, 1.0, steps + 1)[None, :] * np.minimum(u / v, v / u)
    at = lambda x: -np.log(np.clip(1.0 - np.clip(x, 0, 1) * (BASE - 1.0) / BASE, 1e-12, 1.0)) / math.log(BASE)
    p_more, p_fewer = at(u - v * grid), at(v - u * grid)
    p_same = np.clip(1.0 - p_more - p_fewer, 1e-12, 1.0)
    score = more * np.log(np.clip(p_more, 1e-12, 1)) + fewer * np.log(np.clip(p_fewer, 1e-12, 1)) + same * np.log(p_same)
    return np.take_along_axis(np.broadcast_to(grid, score.shape), score.argmax(axis=1)[:, None], axis=1)[:, 0]


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketch_rows(width: int):
    """mapInArrow function: (doc_id, text) to (doc_id, n_shingles, digest, registers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            n, digest, regs = [], [], []
            for s in words.shingle_sets(batch.column(1), width):
                n.append(len(s))
                digest.append(set_digest(s) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "digest", "registers"])
        give_back()

    return run


def set_rows(width: int):
    """mapInArrow function: (digest, text) to (digest, shingles), for rows whose text has that digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, sets = [], []
            size = 0
            for want, s in zip(batch.column(0).to_pylist(), words.shingle_sets(batch.column(1), width), strict=True):
                if set_digest(s) == want:
                    known.append(want)
                    sets.append(s.view(np.int64))
                    size += len(s)
                if size > 1 << 20:
                    yield _set_batch(known, sets)
                    known, sets, size = [], [], 0
            yield _set_batch(known, sets)
        give_back()

    return run


def _set_batch(known: list, sets: list) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(known, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["digest", "shingles"])


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: pairs with both sizes and registers to (a, b, na, nb, estimate)."""
    for batch in batches:
        found = np.zeros(batch.num_rows)
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            ra, rb = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(part.num_rows, -1) for c in ("ra", "rb"))
            na, nb = (part.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
            found[at : at + 2048] = jaccard_estimate(ra, rb, na, nb)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(found)], ["a", "b", "na", "nb", "estimate"])


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    percent = round(threshold * 100)
    slack = SLACK * math.sqrt(threshold * (1 - threshold) / (ROWS * BANDS))
    typed = docs.schema["doc_id"].dataType.simpleString()
    rows = cut(docs.select("doc_id", "text").mapInArrow(sketch_rows(width), f"doc_id {typed}, n_shingles long, digest binary, registers binary"))
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    classes = cut(classes)

    # Buckets of two classes or more, each with its head: the class that meets most others over all its buckets.
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * ROWS + 1, ROWS)))
    banded = classes.select("digest", "n", F.explode(bands).alias("band"))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = cut(banded.join(sizes, "band"))
    weight = shared.groupBy("digest").agg(F.sum("size").alias("weight"))
    weighed = shared.join(weight, "digest")
    heads = weighed.groupBy("band").agg(F.max_by(F.struct("digest", "n"), F.struct("weight", "digest")).alias("head"))
    met = cut(shared.join(heads, "band").select("band", "digest", "n", F.col("head.digest").alias("head"), F.col("head.n").alias("head_n")))
    release(shared)

    near = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)
    enough = lambda shared, x, y: shared * (100 + percent) >= (x + y) * percent
    tried = met.where("digest <> head").where(near(F.col("n"), F.col("head_n"))).select(F.col("head").alias("a"), F.col("digest").alias("b")).distinct()
    guessed = _with_estimates(classes, tried)
    measured = _measured(docs, classes, guessed.where(F.col("estimate") >= threshold - slack), width)
    links = measured.where(enough(F.col("shared"), F.col("na"), F.col("nb"))).select("a", "b")
    roots = components(links)
    release(guessed)

    # Buckets that still hold several components: members that may pair with one of another component are measured against the
    # head, however far from it they are, and all that are measured are compared by their differences from it.
    rooted = cut(met.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest")))
    split = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    held = cut(rooted.join(split, "band", "left_semi"))
    release(met, rooted)
    known = measured.select(F.col("a").alias("head"), F.col("b").alias("digest"), F.lit(True).alias("known"))
    beside = held.where("digest <> head").join(known, ["head", "digest"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    far = _far_members(classes, beside, percent, math.ceil(ROWS * BANDS * (threshold - slack)))
    added = _measured(docs, classes, far, width)
    exact = measured.union(added).select(F.col("a").alias("head"), F.col("b").alias("digest"), "shared", "apart")
    more = _linked_beside_heads(held, exact, roots, percent)
    release(held, far, measured, added)
    final = components(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    release(more)

    named = classes.select("digest", "first_id").join(final.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(ids, "root").select("digest", "component_id")
    out = rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _with_estimates(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, na, nb, estimate) of pairs (a, b) of classes."""
    side = classes.select("digest", "n", "registers")
    with_a = pairs.join(side.select(F.col("digest").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra")), "a")
    with_b = with_a.join(side.select(F.col("digest").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb")), "b")
    return cut(with_b.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimated, "a binary, b binary, na long, nb long, estimate double"))


def _measured(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(a, b, na, nb, shared, apart) of pairs of classes from their full sets: the number in common, and the shingles that only one has."""
    needed = pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).distinct()
    wanted = cut(needed.join(classes.select("digest", "first_id"), "digest"))
    likely = _with_likely_ids(docs.select("doc_id", "text"), wanted)
    texts = wanted.join(likely, F.col("first_id").eqNullSafe(F.col("doc_id"))).select("digest", "text")
    sets = cut(texts.mapInArrow(set_rows(width), "digest binary, shingles array<bigint>").dropDuplicates(["digest"]))
    both = pairs.select("a", "b", "na", "nb").join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("sb")), "b")
    both = both.select("a", "b", "na", "nb", F.array_except("sb", "sa").alias("new"), F.array_except("sa", "sb").alias("gone"))
    out = cut(both.select("a", "b", "na", "nb", (F.col("nb") - F.size("new")).alias("shared"), F.concat("new", "gone").alias("apart")))
    release(wanted, sets)
    return out


def _with_likely_ids(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id may be a first_id of ``wanted``: all that are, and others by a chance that grows with ``wanted``.

    The filter is a bitmap of fixed size, so it may be broadcast.
    """
    place = lambda id_: F.pmod(F.xxhash64(id_), F.lit(FILTER_BITS))
    maps = wanted.select(place("first_id").alias("at"))
    maps = maps.groupBy(F.bitmap_bucket_number("at").alias("__map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))
    rows = docs.withColumn("__at", place("doc_id")).withColumn("__map", F.bitmap_bucket_number("__at")).withColumn("__bit", F.bitmap_bit_position("__at"))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    set_ = byte.bitwiseAND(F.expr("shiftleft(1, cast(__bit % 8 as int))")) != 0
    return rows.join(F.broadcast(maps), "__map").where(set_).select(docs.columns)


def _by_head(rows: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` (head, digest, ...) joined with one row of ``side`` a head, a head's rows dealt over ``SALTS`` parts by digest."""
    side = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).join(side, ["head", "salt"], how).drop("salt")


def _far_members(classes: DataFrame, members: DataFrame, percent: int, least: int) -> DataFrame:
    """(a, b, na, nb): heads and not yet measured members that agree in ``least`` registers or more with another component's member of the bucket.

    Sets agree in a register with at least the probability of their similarity. All pairs of a bucket meet in tasks of two blocks
    of at most about ``BLOCK_MEMBERS`` each, and each in the first bucket it shares; only members come out.
    """
    counts = members.groupBy("band").agg(F.count(F.lit(1)).alias("n_all"), F.min("known").alias("all_known"), F.min("root").alias("low"), F.max("root").alias("high"))
    counts = counts.where("not all_known and low <> high").select("band", F.ceil(F.col("n_all") / F.lit(BLOCK_MEMBERS)).cast("int").alias("blocks"))
    members = members.join(counts, "band").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    members = members.withColumn("task", F.explode(tasks)).join(classes.select("digest", "registers"), "digest")
    key = F.concat_ws(":", F.col("band").cast("string"), F.col("task.i").cast("string"), F.col("task.j").cast("string"))
    dealt = members.select(key.cast("binary").alias("key"), F.col("task.i").alias("i"), F.col("task.j").alias("j"), "block", "head", "head_n", "digest", "n", "root", "known", "registers")
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    return cut(dealt.mapInArrow(by_key(_far_in_task(percent, least)), "a binary, b binary, na long, nb long").distinct())


def _far_in_task(percent: int, least: int):
    """Function of one task's rows: the members to measure, with their head."""

    def far(rows: pa.Table) -> pa.RecordBatch:
        n, block = rows["n"].to_numpy(), rows["block"].to_numpy()
        known = rows["known"].to_numpy(zero_copy_only=False)
        roots = rows["root"].to_pylist()
        names = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        group = np.array([names[r] for r in roots])
        regs = np.frombuffer(b"".join(rows["registers"].to_pylist()), np.uint8).reshape(len(n), -1)
        common = (regs == regs[0]).all(axis=0).reshape(-1, ROWS).all(axis=1)
        own = int(common.argmax()) if common.any() else 0
        across = rows["i"][0].as_py() != rows["j"][0].as_py()
        marked = known.copy()
        for x in np.flatnonzero(~known).tolist():
            met = (group != group[x]) & (np.minimum(n, n[x]) * 100 >= np.maximum(n, n[x]) * percent)
            if across:
                met &= block != block[x]
            if marked[x]:
                met &= ~marked
            y = np.flatnonzero(met)
            same = regs[y] == regs[x]
            near = np.count_nonzero(same, axis=1) >= least
            y, same = y[near], same[near]
            first = ~same[:, : own * ROWS].reshape(len(y), own, ROWS).all(axis=2).any(axis=1)
            if first.any():
                marked[x] = True
                marked[y[first]] = True
        found = rows.filter(pa.array(marked & ~known)).combine_chunks()
        columns = [found[c].combine_chunks() for c in ("head", "digest", "head_n", "n")]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "na", "nb"])

    return far


def _linked_beside_heads(held: DataFrame, exact: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a head's buckets that lie in different components.

    With s(x) the shingles shared with the head and d(x) those in which x and the head differ, |x & y| = s(x) + s(y) - |head|
    + |d(x) & d(y)| exactly, so the short difference lists stand for the sets. Members outside of the head's
    component meet all others in tasks of two blocks of at most about ``BLOCK_MEMBERS`` each; only links come out.
    """
    head_root = held.select("head").distinct().join(roots.select(F.col("node").alias("head"), F.col("root").alias("head_root")), "head", "left")
    members = held.where("digest <> head").select("head", "head_n", "digest", "n", "root").distinct().join(exact, ["head", "digest"])
    members = _by_head(members, head_root)
    members = members.withColumn("out", F.col("root") != F.coalesce("head_root", "head"))
    counts = members.groupBy("head").agg(F.sum(F.col("out").cast("long")).alias("n_out"), F.count(F.lit(1)).alias("n_all")).where("n_out > 0 and n_all > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK_MEMBERS)).cast("int")
    members = _by_head(members, counts).withColumn("outs", blocks(F.col("n_out"))).withColumn("ins", blocks(F.col("n_all") - F.col("n_out")))
    members = members.withColumn("block", F.pmod(F.xxhash64("digest"), F.when(F.col("out"), F.col("outs")).otherwise(F.col("ins"))).cast("int"))
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    block = F.col("block")
    with_outs = F.transform(up_to(F.col("outs")), lambda o: task(block, o))
    with_ins = F.transform(up_to(F.col("ins")), lambda m: task(m, block))
    among = F.transform(up_to(F.col("outs")), lambda o: task(-1 - F.least(block, o), F.greatest(block, o)))
    members = members.withColumn("task", F.explode(F.when(F.col("out"), F.concat(with_ins, among)).otherwise(with_outs)))
    key = F.concat("head", F.lit(":"), F.col("task.i").cast("string"), F.lit(":"), F.col("task.j").cast("string"))
    dealt = members.select(key.cast("binary").alias("key"), "digest", F.col("n").cast("long"), F.col("head_n").cast("long"), F.col("shared").cast("long"), "root", "out", "apart")
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    return cut(dealt.mapInArrow(by_key(_links_by_difference(percent)), "a binary, b binary"))


def _links_by_difference(percent: int):
    """Function of one task's rows: for each member outside, one link to each other component of its task."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        digest, root = rows["digest"].to_pylist(), rows["root"].to_pylist()
        n, shared, head_n = (rows[c].to_numpy() for c in ("n", "shared", "head_n"))
        out = np.flatnonzero(rows["out"].to_numpy(zero_copy_only=False))
        names = {r: i for i, r in enumerate(dict.fromkeys(root))}
        group = np.array([names[r] for r in root])
        lists = rows["apart"].combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        ids, flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        owner = np.repeat(np.arange(len(n)), lengths)
        starts = np.cumsum(lengths) - lengths
        mark = np.zeros(len(ids) + 1, bool)
        a, b = [], []
        for x in out.tolist():
            own = flat[starts[x] : starts[x] + lengths[x]]
            mark[own] = True
            common = np.bincount(owner[mark[flat]], minlength=len(n))
            mark[own] = False
            both = shared[x] + shared - head_n[x] + common
            for y in np.flatnonzero((both * (100 + percent) >= (n[x] + n) * percent) & (group != group[x])).tolist():
                if group[y] != group[x]:
                    a.append(min(digest[x], digest[y]))
                    b.append(max(digest[x], digest[y]))
                    group[group == group[y]] = group[x]  # linked now: further links between the two would say the same
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return links


def op1_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)
