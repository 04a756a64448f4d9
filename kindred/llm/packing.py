"""Packing documents into fixed-size sequences: best-fit decreasing with certified bounds and repacking.

Documents are tokenised once; from there on only lengths move. A document longer than a sequence is cut into
full pieces, its first piece taking the remainder. Full pieces are sequences of their own. The other pieces are
dealt over partitions of bounded size, each packed by best-fit decreasing. A dual-feasible-function bound says how
few sequences each partition needs; partitions above their bound give up the documents of every sequence that
isn't full, all others those of their emptiest one, and what was given up is dealt anew over fewer partitions and packed
again. A round that saves no sequence is undone and ends the rounds.

Defined results: a null or empty text is the end token alone; repeated rows are packed each; null ids are kept as
they are; an empty table gives no rows; columns other than doc_id and text are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kindred.llm.tokens import Encoder, groups_by_size
from kindred.llm.worker import give_back
from kindred.session import cut, ship

#: Pieces in a partition that is packed at once, and most rounds of repacking.
PARTITION_PIECES, ROUNDS = 20_000, 3


def cut_pieces(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes the remainder, the others are full."""
    first = total % capacity or min(total, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, total, capacity)]


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins. Bins by room are stacks; a bit mask finds the least room that suffices."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
        else:
            room, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - room
        if room > n:
            stacks[room - n].append(b)
            mask |= 1 << (room - n)
    return bins, offsets, made


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins that any packing needs, by dual feasible functions.

    First family: for each t up to half a bin, items above capacity - t weigh a whole bin, items below t nothing,
    others their size. Second: an item weighs the number of times that a k-th part of a bin is exceeded by it,
    in units of k parts.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = count * np.arange(capacity + 1)
    n_to, s_to = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(size)])
    t = np.arange(0, capacity // 2 + 1)
    big = n_to[-1] - n_to[capacity - t + 1]
    middle = s_to[capacity - t + 1] - s_to[t]
    best = int(np.max(big + -(-middle // capacity)))
    sizes = np.arange(capacity + 1)
    for k in range(2, 21):
        scaled = sizes * (k + 1)
        weight = np.where(scaled % capacity == 0, sizes * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((weight * count).sum()) // (k * capacity)))
    return best


def token_pieces(vocabulary: str | None, capacity: int, end: int):
    """mapInArrow function: (doc_id, text) to one row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names, texts = part.column(0), part.column(1).to_pylist()
                row, piece, start, length, crc = [], [], [], [], []
                for a, b in groups_by_size(texts):
                    ids, offsets = encoder.encode(texts[a:b], end)
                    raw = ids.astype("<u4")
                    for i in range(b - a):
                        own = raw[offsets[i] : offsets[i + 1]]
                        for k, (s, n) in enumerate(cut_pieces(len(own), capacity)):
                            row.append(a + i)
                            piece.append(k)
                            start.append(s)
                            length.append(n)
                            crc.append(zlib.crc32(own[s : s + n]))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        give_back()

    return run


def _packer(capacity: int, round_: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        lengths = rows["length"].to_numpy()
        bins, offsets, made = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=made).astype(np.int64)
        gap = made - lower_bound(lengths, capacity)
        loose = fill < capacity if gap > 0 else np.arange(made) == int(fill.argmin())
        lead = (round_ << 56) + (int(rows["part"].iat[0]) << 28)
        return rows.assign(sequence_id=lead + bins, offset=offsets, loose=loose[bins])

    return run


def pack(docs: DataFrame, capacity: int = 2048, end: int = 0, vocabulary: str | None = None, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every row of ``docs``."""
    ship(docs.sparkSession)
    typed = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {typed}, piece int, start long, length long, ids_crc32 long"
    pieces = docs.select("doc_id", "text").mapInArrow(token_pieces(vocabulary, capacity, end), columns)
    pieces = cut(pieces.withColumn("row", F.monotonically_increasing_id()))
    out = [c for c in pieces.columns if c != "row"] + ["sequence_id", "offset"]
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    schema = f"{columns}, row long, part int, sequence_id long, offset long, loose boolean"

    def packed(rows: DataFrame, round_: int, n: int) -> DataFrame:
        parts = max(1, -(-n // partition_pieces))
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("row", F.lit(round_)), F.lit(parts)).cast("int"))
        return cut(dealt.groupBy("part").applyInPandas(_packer(capacity, round_), schema))

    open_ = pieces.where(F.col("length") < capacity)
    now = packed(open_, 0, open_.count())
    done = [full.select(out)]
    for round_ in range(1, rounds + 1):
        loose = now.where("loose")
        was = loose.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sequence_id").alias("bins")).first()
        if was["bins"] < 2 or now.select("part").distinct().limit(2).count() < 2:
            break
        again = packed(loose.select(*pieces.columns), round_, was["n"])
        if again.select("sequence_id").distinct().count() >= was["bins"]:
            break
        done.append(now.where(~F.col("loose")).select(out))
        now = again
    result = now.select(out)
    for part in done:
        result = result.union(part)
    return result


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
