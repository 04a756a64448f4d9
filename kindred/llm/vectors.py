"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Vectors are compared only within their label. Equal vectors collapse to one class first. The forest is fitted on a bounded
sample (``sample_rows`` classes): each tree splits its sample at random directions near the median until a node holds at
most ``leaf_rows``. All classes are then routed down every tree; one that lies within the spill margin of a split goes
to both sides, so that a pair near the threshold is parted in a tree only where the split falls between the two, and many trees
seldom part it all at once. Classes that share a leaf are compared in double precision; a pair is told by the first leaf that
both lie in. A leaf's task gives out how many vectors each of its classes links to, and as many links as span its components,
so what it writes grows with its rows, not with its pairs.

The number of leaves is bounded by the sample, so their row counts can be broadcast; a leaf that holds more than
``block_rows`` rows is dealt into blocks, and each pair of blocks is one task of bounded size. No pair is skipped.

Defined results: vectors that are null, empty, all zero or hold a null or non-finite component, and vectors without a label, link
with nothing; vectors of different lengths do not link; repeated rows are copies of one another; a null id never becomes a
component's id; an empty table gives no rows; columns other than vec_id, embedding and label are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kindred.llm.worker import by_key, give_back
from kindred.operators.components import components
from kindred.session import cut, release, ship

TREES, LEAF_ROWS, SAMPLE_ROWS, BLOCK_ROWS = 10, 256, 200_000, 8_000
#: Most bytes of the sample.
SAMPLE_BYTES = 128 << 20
#: Spill margin in standard deviations of the projected difference of a pair at the threshold.
SPILL = 0.25


@dataclass
class Tree:
    """Splits in breadth order: direction, value, and the children's places (negative: leaf number -1 - n)."""

    directions: list[np.ndarray] = field(default_factory=list)
    values: list[float] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0

    def grow(self, x: np.ndarray, leaf_rows: int, margin: float, rng: np.random.Generator) -> int:
        """Split the unit rows x; returns this node's place."""
        if len(x) > leaf_rows:
            for _ in range(4):
                d = rng.standard_normal(x.shape[1])
                d /= np.linalg.norm(d)
                p = x @ d
                value = float(np.quantile(p, rng.uniform(0.4, 0.6)))
                low, high = p <= value + margin, p >= value - margin
                if max(low.sum(), high.sum()) <= 0.85 * len(x):
                    place = len(self.values)
                    self.directions.append(d)
                    self.values.append(value)
                    self.children.append([0, 0])
                    self.children[place][0] = self.grow(x[low], leaf_rows, margin, rng)
                    self.children[place][1] = self.grow(x[high], leaf_rows, margin, rng)
                    return place
        self.leaves += 1
        return -self.leaves

    def route(self, x: np.ndarray, margin: float, root: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of x in it) for every leaf that gets rows."""
        stack = [(root, np.arange(len(x)))]
        while stack:
            place, rows = stack.pop()
            if not len(rows):
                continue
            if place < 0:
                yield -1 - place, rows
                continue
            p = x[rows] @ self.directions[place]
            value = self.values[place]
            stack.append((self.children[place][0], rows[p <= value + margin]))
            stack.append((self.children[place][1], rows[p >= value - margin]))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, safe for very large and very small components."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Forest:
    """For every (label, length) group of the sample: ``trees`` trees and the number of its first leaf in each."""

    def __init__(self, sample: dict[tuple, np.ndarray], threshold: float, trees: int, leaf_rows: int, seed: int = 17):
        self.groups: dict[tuple, list[tuple[Tree, int, int]]] = {}
        self.distance = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
        leaves = 0
        for key in sorted(sample):
            rng = np.random.Generator(np.random.PCG64([seed, leaves]))
            x, made = unit_rows(sample[key]), []
            for _ in range(trees):
                tree = Tree()
                root = tree.grow(x, leaf_rows, self.margin(key[1]), rng)
                made.append((tree, root, leaves))
                leaves += tree.leaves
                if not tree.values:
                    break  # one leaf: another tree would be the same
            self.groups[key] = made

    def margin(self, length: int) -> float:
        return SPILL * self.distance / float(np.sqrt(length)) if length > 1 else 2.0

    def leaves_of(self, key: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each place that the vectors x go to. A group that the sample lacks is one leaf, one of 65,536 for all such groups."""
        made = self.groups.get(key)
        if not made:
            return np.arange(len(x)), np.full(len(x), -1 - (zlib.crc32(repr(key).encode()) & 0xFFFF), np.int64)
        rows, leaves = [], []
        for tree, root, first in made:
            for leaf, own in tree.route(x, self.margin(key[1]), root):
                rows.append(own)
                leaves.append(np.full(len(own), first + leaf, np.int64))
        return np.concatenate(rows), np.concatenate(leaves)


def _rows_of(column: pa.ListArray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, rows) of the vectors of each length in a list column."""
    lengths = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    out = []
    for n in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == n)
        out.append((n, own, flat[starts[own][:, None] + np.arange(n)]))
    return out


def _route(forest: Forest):
    """mapInArrow function: (node, label, copies, embedding) to (leaf, node, label, copies, vector, leaves) for every leaf of the row.

    ``vector`` holds the components as they are, ``leaves`` the numbers of all the row's leaves in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), object)
            for length, places, raw in _rows_of(batch.column(3)):
                for label in dict.fromkeys(labels[places].tolist()):
                    mine = labels[places] == label
                    own, x = places[mine], raw[mine]
                    rows, leaves = forest.leaves_of((label, length), unit_rows(x))
                    order = np.lexsort((leaves, rows))
                    rows, leaves = rows[order], leaves[order].astype("<i8")
                    ends = np.searchsorted(rows, np.arange(len(x) + 1))
                    lists = [leaves[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    bytes_ = [v.tobytes() for v in x]
                    for at in range(0, len(rows), 4096):
                        r = rows[at : at + 4096]
                        kept = pa.array(own[r])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(leaves[at : at + 4096]), batch.column(0).take(kept), batch.column(1).take(kept), batch.column(2).take(kept), pa.array([bytes_[i] for i in r], pa.binary()), pa.array([lists[i] for i in r], pa.binary())],
                            ["leaf", "node", "label", "copies", "vector", "leaves"],
                        )
        give_back()

    return run


def _earlier(lists: list[bytes], leaf: int) -> np.ndarray:
    """(rows, leaves) membership of rows in the leaves before ``leaf`` that more than one of them lies in, as 0 and 1."""
    flat = [np.frombuffer(v, "<i8") for v in lists]
    row = np.repeat(np.arange(len(flat)), [len(v) for v in flat])
    all_ = np.concatenate(flat)
    row, all_ = row[all_ < leaf], all_[all_ < leaf]
    _, column, count = np.unique(all_, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count > 1)
    out = np.zeros((len(flat), len(again)), np.float32)
    place = np.full(len(count), -1)
    place[again] = np.arange(len(again))
    met = place[column] >= 0
    out[row[met], place[column[met]]] = 1.0
    return out


def _compare(threshold: float, kind: str):
    """Function of the rows of two blocks of a leaf, or of one: (node, other, n), the vectors that each row links to (``other`` null)
    and links that span the components (``n`` null). Of all the leaves that two rows share, the first tells."""

    def run(rows: pa.Table) -> pa.RecordBatch:
        i, j, leaf = (rows[c][0].as_py() for c in ("i", "j", "leaf"))
        labels, vectors, lists = (rows[c].to_pylist() for c in ("label", "vector", "leaves"))
        nodes, block = np.array(rows["node"].to_pylist(), object), rows["block"].to_numpy()
        copies = rows["copies"].to_numpy().astype(np.float64)
        by: dict[tuple, list[int]] = {}
        for k, (label, v) in enumerate(zip(labels, vectors, strict=True)):
            by.setdefault((label, len(v)), []).append(k)
        names, others, counts = [], [], []
        for own_ in by.values():
            own = np.array(own_)
            x = unit_rows(np.frombuffer(b"".join(vectors[k] for k in own_), kind).reshape(len(own), -1))
            left = np.flatnonzero(block[own] == i)
            right = left if i == j else np.flatnonzero(block[own] == j)
            n, met = np.zeros(len(own)), None
            group = np.arange(len(own))
            for at in range(0, len(left), 512):
                some = left[at : at + 512]
                near = x[some] @ x[right].T
                close = near >= threshold - 1e-9
                if i == j:
                    close[np.arange(len(some)), np.arange(at, at + len(some))] = False
                p, q = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
                if not len(p):
                    continue
                if met is None:
                    met = _earlier([lists[k] for k in own_], leaf)
                a, b = some[p], right[q]
                linked = close[np.ix_(p, q)]
                edge = np.argwhere(linked & (near[np.ix_(p, q)] < threshold + 1e-9))
                for lo in range(0, len(edge), 1 << 14):  # as near to the threshold as rounding reaches: once more, one by one
                    e = edge[lo : lo + (1 << 14)]
                    linked[e[:, 0], e[:, 1]] = np.einsum("ij,ij->i", x[a[e[:, 0]]], x[b[e[:, 1]]]) >= threshold
                linked &= met[a] @ met[b].T == 0
                n[a] += linked @ copies[own[b]]
                if i != j:
                    n[b] += copies[own[a]] @ linked
                for k in np.flatnonzero(linked.any(axis=1)).tolist():
                    y = b[linked[k]]
                    for g in np.setdiff1d(group[y], group[a[k]]).tolist():
                        names.append(nodes[own[a[k]]])
                        others.append(nodes[own[y[group[y] == g][0]]])
                        counts.append(None)
                        group[group == g] = group[a[k]]
            told = np.flatnonzero(n)
            names += nodes[own[told]].tolist()
            others += [None] * len(told)
            counts += n[told].astype(np.int64).tolist()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(others, pa.string()), pa.array(counts, pa.int64())], ["node", "other", "n"])

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, trees: int = TREES, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    ship(vectors.sparkSession)
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = v.isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    node = F.concat(F.hex(F.xxhash64("label", v)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), v, F.col("label"))))
    rows = vectors.select("vec_id", "label", v, F.when(F.coalesce(good, F.lit(False)), node).alias("node"))
    classes = cut(rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies")))

    shape = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("length")).first()
    most = max(1, min(sample_rows, SAMPLE_BYTES // (8 * max(shape["length"] or 1, 1))))
    chance = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = classes.where(chance < min(1.0, most / max(shape["n"], 1))).select("node", "label", "embedding").toArrow().sort_by("node").combine_chunks()
    of_group: dict[tuple, np.ndarray] = {}
    labels = np.array(sample["label"].to_pylist(), object)
    for length, places, raw in _rows_of(sample["embedding"].combine_chunks()) if len(sample) else []:
        for label in dict.fromkeys(labels[places].tolist()):
            of_group[label, length] = raw[labels[places] == label]
    forest = Forest(of_group, threshold, trees, leaf_rows)
    del sample, of_group

    typed = vectors.schema["label"].dataType.simpleString()
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    shaped = classes.select("node", "label", "copies", "embedding" if single else F.col("embedding").cast("array<double>"))
    routed = cut(shaped.mapInArrow(_route(forest), f"leaf long, node string, label {typed}, copies long, vector binary, leaves binary"))
    blocks = routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))  # at most as many rows as the forest has leaves, and 65,536
    dealt = routed.join(F.broadcast(blocks), "leaf").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.select(F.concat_ws(":", "leaf", i, j).cast("binary").alias("key"), "leaf", i.alias("i"), j.alias("j"), "block", "node", "label", "copies", "vector", "leaves")
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    told = cut(dealt.mapInArrow(by_key(_compare(threshold, "<f4" if single else "<f8")), "node string, other string, n long"))
    release(routed)

    degree = told.where("n is not null").groupBy("node").agg(F.sum("n").alias("others"))
    roots = components(told.where("other is not null"), "node", "other")
    named = classes.select("node", "first_id", "copies").join(roots, "node", "left").join(degree, "node", "left")
    named = cut(named.select("node", "first_id", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    release(told, classes)
    ids = named.groupBy("root").agg(F.min("first_id").alias("component"))
    named = named.join(ids, "root").select("node", "n_links", "component")
    out = rows.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op6_vectors(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), u AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a
), deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON c.a = e.vec_id LEFT JOIN deg d ON d.a = e.vec_id
"""
