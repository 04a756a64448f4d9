"""All pairs of a table of vectors, block against block: no pair is shuffled before it is known to count.

Rows are packed into blocks of some thousand vectors, written once; a Cartesian product of blocks gives each task two of them.
A task counts table matches for 64 pairs at once: one bitmap of the second block per bucket, added bit by bit over the tables.
Cosines are a matrix product in single precision with a margin; pairs that it leaves are computed again in double precision, the
components added in order, as `scalars.cosine` does, so results don't depend on how rows fell into blocks. Of wide vectors the product
takes the first components and the length of the rest, which no cosine exceeds; where that leaves many pairs, all components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from kindred.functions.terms import spare
from kindred.session import cut, ship

#: Most vectors of a block, half as many where they have more than WIDE components, and least while there are fewer blocks than WAYS.
MOST, WIDE, LEAST, WAYS = 8192, 128, 1024, 6
#: Pairs looked at in one step of a task.
STEP = 1 << 21
#: Above the error of a single-precision cosine of some thousand components.
MARGIN = 1e-4
#: Components of wide vectors that a bound of their cosines takes.
HEAD = 128
#: A matrix product costs less than gathered rows above this share of pairs.
DENSE = 1 / 30


def packed(vectors: DataFrame, hashed: bool) -> DataFrame:
    """(blk, dim, ids, vecs, hashes) of (block_id, embedding[, hashes]); rows without id or vector, or with a null component, link with nothing and are left out."""
    ship(vectors.sparkSession)
    kept = vectors.where(F.col("block_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    kept = kept.select("block_id", "embedding", *(["hashes"] if hashed else []))
    n, width = kept.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    count = max(1, math.ceil(n / (MOST // (2 if (width or 0) > WIDE else 1))), min(WAYS, math.ceil(n / LEAST)))
    kind = kept.schema["block_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        sizes = np.asarray(rows["embedding"].value_lengths())
        for k, dim in enumerate(np.unique(sizes)):
            own = rows.take(pa.array(np.flatnonzero(sizes == dim)))
            v = own["embedding"].flatten().to_numpy(zero_copy_only=False)
            h = own["hashes"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes() if hashed else b""
            ids = pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own["block_id"])
            with np.errstate(all="ignore"):
                small = v.astype(np.float32)
            exact = np.array_equal(small, v, equal_nan=True)
            v = v.astype(np.float64, copy=False)
            blk = (TaskContext.get().partitionId() << 20) + k
            yield pa.RecordBatch.from_arrays([pa.array([blk], pa.int64()), pa.array([dim if exact else -dim], pa.int32()), ids, pa.array([(small if exact else v).tobytes()], pa.binary()), pa.array([h], pa.binary())], ["blk", "dim", "ids", "vecs", "hashes"])

    return cut(kept.repartition(count).mapInArrow(pack, f"blk long, dim int, ids array<{kind}>, vecs binary, hashes binary"))


class _Block:
    def __init__(self, row: dict, at: int, side: str):
        self.blk, dim = row[f"blk{side}"][at].as_py(), row[f"dim{side}"][at].as_py()
        self.ids = row[f"ids{side}"][at].values
        self.v = np.frombuffer(row[f"vecs{side}"][at].as_buffer(), np.float32 if dim >= 0 else np.float64).reshape(len(self.ids), abs(dim))
        self.h = np.frombuffer(row[f"hashes{side}"][at].as_buffer(), np.int64).reshape(len(self.ids), -1)
        self.dim = abs(dim)

    def measured(self) -> None:
        """Components by column, norms with them added in order, and unit rows; zero vectors stay zero."""
        self.columns = self.v.T.astype(np.float64, order="C")
        total = np.zeros(len(self.ids))
        for x in self.columns:
            total += x * x
        self.norm = np.sqrt(total)
        self.unit = np.zeros(self.v.shape, np.float32)
        for k in range(0, len(self.ids), 512):
            norm = self.norm[k : k + 512, None]
            with np.errstate(all="ignore"):
                np.divide(self.v[k : k + 512], norm, out=self.unit[k : k + 512], where=~(norm <= 0), casting="same_kind")
        self.head = None
        if self.dim > WIDE:
            with np.errstate(all="ignore"):
                rest = np.sqrt(np.einsum("nd,nd->n", self.unit[:, HEAD:], self.unit[:, HEAD:]))
            self.head = np.concatenate([self.unit[:, :HEAD], rest[:, None]], axis=1)


def cosines(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        total = np.zeros(len(x))
        for p, q in zip(a.columns, b.columns, strict=True):
            total += p[x] * q[y]
        size = a.norm[x] * b.norm[y]
        with np.errstate(all="ignore"):
            out[at : at + (1 << 16)] = np.where(~(size <= 0), total / size, 0.0)
    return out


class _Meeting:
    """In how many tables rows of one block look into a bucket that holds a row of another."""

    def __init__(self, a: _Block, b: _Block, masks: list[int]):
        self.width, self.n = -(-len(b.ids) // 64) * 64, len(b.ids)
        self.a, self.b, self.masks = a.h, b.h, np.array(masks, np.int64)
        self.maps, self.place = [], np.empty(a.h.shape, np.int32)
        for t in range(a.h.shape[1]):
            wanted, self.place[:, t] = np.unique(a.h[:, t], return_inverse=True)
            there, at = np.unique(b.h[:, t], return_inverse=True)
            grid = np.zeros((len(there) + 1, self.width // 8), np.uint8)  # the last row is the empty bucket
            row, lane = at, np.arange(self.n)
            np.bitwise_or.at(grid, (row, lane >> 3), (1 << (lane & 7)).astype(np.uint8))
            grid, found = grid.view(np.uint64), np.zeros((len(wanted), self.width // 64), np.uint64)
            for m in self.masks:
                k = np.minimum(np.searchsorted(there, wanted ^ m), len(there) - 1)
                found |= grid[np.where(there[k] == wanted ^ m, k, len(there))]
            self.maps.append(found)

    def at_least(self, rows: slice, least: int) -> np.ndarray:
        """Bits of the pairs (row, row of the other block) that meet in ``least`` tables or more."""
        place, planes_ = self.place[rows], []
        if least == 1:
            out = self.maps[0][place[:, 0]]
            for t in range(1, len(self.maps)):
                out |= self.maps[t][place[:, t]]
            return out
        for t, found in enumerate(self.maps):
            carry = found[place[:, t]]
            if (t + 1) & t == 0:
                planes_.append(np.zeros_like(carry))
            for p in planes_:
                over = p & carry
                p ^= carry
                carry = over
        if least >> len(planes_):
            return np.zeros_like(carry)
        more, same = np.zeros_like(carry), np.full_like(carry, ~np.uint64(0))
        for k in reversed(range(len(planes_))):
            if least >> k & 1:
                same &= planes_[k]
            else:
                more |= same & planes_[k]
                same &= ~planes_[k]
        return more | same

    def pairs(self, rows: slice, least: int) -> tuple[np.ndarray, np.ndarray]:
        bits = np.unpackbits(self.at_least(rows, least).view(np.uint8), axis=1, count=self.n, bitorder="little")
        flat = np.flatnonzero(bits.ravel().view(bool))
        i = flat // self.n
        return i + rows.start, flat - i * self.n

    def count(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for t in range(self.a.shape[1]):
            out += np.isin(self.a[i, t] ^ self.b[j, t], self.masks)
        return out


def _first(source: np.ndarray, similarity: np.ndarray, target: np.ndarray, k: int, margin: float = 0.0) -> np.ndarray:
    """Which entries are among their source's k most similar, ties by target; with a margin, or might be once computed exactly."""
    similarity = np.where(np.isnan(similarity), np.inf, similarity)  # as Spark orders them
    order = np.lexsort((target, -similarity, source))
    s = source[order]
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    group = np.cumsum(np.r_[True, s[1:] != s[:-1]]) - 1
    rank = np.arange(len(s)) - starts[group]
    out = np.zeros(len(s), bool)
    if not margin:
        out[order] = rank < k
        return out
    last = np.minimum(starts + k - 1, np.r_[starts[1:], len(s)] - 1)
    out[order] = ~(similarity[order] < similarity[order][last][group] - margin)
    return out


class _Linked:
    """What the pairs of two blocks come to: the part that each row is linked into, and the weight and weighted sum of its pairs.

    Rows are classes of equal vectors, with their copies and the pairs among those in the place of hashes.
    """

    def __init__(self, a: _Block, b: _Block, least: float):
        self.a, self.b, n = a, b, len(a.ids)
        self.shift = 0 if a.blk == b.blk else n
        self.part = np.arange(n + (len(b.ids) if self.shift else 0))
        self.weight, self.total = np.zeros(len(self.part)), np.zeros(len(self.part))
        if not self.shift:
            every = np.flatnonzero(a.h[:, 1])
            own = cosines(a, a, every, every)
            every, own = every[~(own < least)], own[~(own < least)]
            self.weight[every] = a.h[every, 1]
            self.total[every] = own * a.h[every, 1]

    def add(self, i: np.ndarray, j: np.ndarray, similarity: np.ndarray) -> None:
        weight, n = (self.a.h[i, 0] * self.b.h[j, 0]).astype(np.float64), len(self.part)
        self.weight += np.bincount(i, weight, n)
        self.total += np.bincount(i, weight * similarity, n)
        part, x, y = self.part, i, j + self.shift
        while len(x):
            u, v = part[x], part[y]
            apart = u != v
            x, y, u, v = x[apart], y[apart], u[apart], v[apart]
            np.minimum.at(part, np.maximum(u, v), np.minimum(u, v))
            while not np.array_equal(part, part[part]):
                part = part[part]
        self.part = part

    def rows(self) -> pa.RecordBatch:
        """(source_id, target_id, weight, total): a row of the part is its target."""
        ids = pa.concat_arrays([self.a.ids, self.b.ids]) if self.shift else self.a.ids
        some = np.flatnonzero((self.part != np.arange(len(self.part))) | (self.weight > 0))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(some)), ids.take(pa.array(self.part[some])), pa.array(self.weight[some]), pa.array(self.total[some])], ["source_id", "target_id", "weight", "total"])


def block_pairs(vectors: DataFrame, least: float | None = None, matches: int = 0, masks: list[int] | None = None, per_source: int | None = None, linked: bool = False) -> DataFrame:
    """(source_id, target_id, table_matches, similarity) of all pairs of rows of (block_id, embedding[, hashes]) with different ids that
    have a cosine of ``least`` or more and meet in ``matches`` tables or more, a row's probes being its hash under each of ``masks``.

    Without ``least`` the similarity, without ``matches`` the matches are null. Each pair comes once, the lesser id first; with ``per_source`` each
    direction comes, if a pair may be among its source's first ``per_source`` by similarity, then target.

    With ``linked``, for rows of (block_id, embedding, hashes) as of `clusters.copy_classes` and ``least`` alone, no pair leaves its task: there come
    (source_id, target_id, weight, total), at most one for each row of both blocks. The links from source to target connect what the pairs
    connect; the weights and totals of a component add up to its pairs, copies counted, and to their similarities.
    """
    blocks = packed(vectors, matches > 0 or linked)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    left, right = (blocks.select(*(F.col(c).alias(f"{c}_{side}") for c in blocks.columns)) for side in "ab")
    met = left.hint("shuffle_replicate_nl").join(right, F.col("blk_a") <= F.col("blk_b"))
    names = ["source_id", "target_id", "table_matches", "similarity"]

    def steps(a: _Block, b: _Block, ra: np.ndarray, rb: np.ndarray, meeting: _Meeting | None) -> Iterator[tuple[np.ndarray, ...]]:
        """(i, j, similarity, forward) of the pairs that count, step by step; forward: the row of the first block is the source."""
        if least is not None:
            a.measured()
            b.measured()
        own = a.blk == b.blk
        step = max(1, STEP // len(b.ids))
        for start in range(0, len(a.ids), step):
            rows = slice(start, min(start + step, len(a.ids)))
            near = None
            if meeting:
                i, j = meeting.pairs(rows, matches)
                if least is not None:
                    if len(i) > DENSE * (rows.stop - start) * len(b.ids):
                        near = (a.unit[rows] @ b.unit.T)[i - start, j]
                    else:
                        near = np.concatenate([np.einsum("nd,nd->n", a.unit[i[k : k + 4096]], b.unit[j[k : k + 4096]]) for k in range(0, len(i), 4096)] or [np.empty(0, np.float32)])
            else:
                for x, y in ((a.head, b.head), (a.unit, b.unit)):
                    if x is a.unit or (x is not None and not per_source):  # of bounds no row's first ones can be told
                        product = x[rows] @ y.T
                        flat = np.flatnonzero(~(product < least - MARGIN).ravel())
                        if len(flat) <= DENSE * product.size:
                            break
                near = product.ravel()[flat]
                i = flat // len(b.ids)
                i, j = i + start, flat - i * len(b.ids)
            wanted = ra[i] != rb[j]
            if own:
                wanted &= i < j
            if near is not None:
                wanted &= ~(near < least - MARGIN)
            i, j = i[wanted], j[wanted]
            if per_source and len(i):
                near = near[wanted]
                kept = _first(i, near, rb[j], per_source, 2 * MARGIN) | _first(j, near, ra[i], per_source, 2 * MARGIN) if not own else np.ones(len(i), bool)
                i, j = i[kept], j[kept]
            similarity = None
            if least is not None:
                similarity = cosines(a, b, i, j)
                kept = ~(similarity < least)
                i, j, similarity = i[kept], j[kept], similarity[kept]
            if not per_source:
                yield i, j, similarity, ra[i] < rb[j]
            elif len(i):
                both = np.r_[similarity, similarity]
                kept = np.flatnonzero(_first(np.r_[ra[i], rb[j]], both, np.r_[rb[j], ra[i]], per_source))
                yield np.r_[i, i][kept], np.r_[j, j][kept], both[kept], kept < len(i)

    def found(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray, similarity: np.ndarray | None, forward: np.ndarray, meeting: _Meeting | None) -> pa.RecordBatch:
        x, y, turn = a.ids.take(pa.array(i)), b.ids.take(pa.array(j)), pa.array(forward)
        count = pa.array(meeting.count(i, j)) if meeting else pa.nulls(len(i), pa.int64())
        sim = pa.array(similarity, pa.float64()) if similarity is not None else pa.nulls(len(i), pa.float64())
        return pa.RecordBatch.from_arrays([pc.if_else(turn, x, y), pc.if_else(turn, y, x), count, sim], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare()
        for batch in batches:
            row = {n: batch.column(n) for n in batch.schema.names}
            for at in range(batch.num_rows):
                a, b = _Block(row, at, "_a"), _Block(row, at, "_b")
                if a.dim != b.dim:
                    continue
                _, rank = np.unique(np.concatenate([x.ids.to_numpy(zero_copy_only=False) for x in (a, b)]), return_inverse=True)
                ra, rb = rank[: len(a.ids)], rank[len(a.ids) :]
                meeting = _Meeting(a, b, masks) if matches else None
                if linked:
                    parts = None
                    for i, j, similarity, _ in steps(a, b, ra, rb, None):
                        parts = parts or _Linked(a, b, least)
                        parts.add(i, j, similarity)
                    if parts:
                        yield parts.rows()
                    continue
                held = (x for x in steps(a, b, ra, rb, meeting) if len(x[0]))
                if per_source and (all_ := list(held)):
                    i, j, similarity, forward = (np.concatenate([x[k] for x in all_]) for k in range(4))
                    kept = _first(np.where(forward, ra[i], rb[j]), similarity, np.where(forward, rb[j], ra[i]), per_source)
                    yield found(a, b, i[kept], j[kept], similarity[kept], forward[kept], meeting)
                for x in held:
                    yield found(a, b, *x, meeting)

    if linked:
        return met.mapInArrow(compare, f"source_id {kind}, target_id {kind}, weight double, total double")
    return met.mapInArrow(compare, f"source_id {kind}, target_id {kind}, table_matches long, similarity double")
