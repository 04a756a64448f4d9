"""Token ids as binary files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Ids are coded by a mixture of three adaptive predictions. Order 2 expects the id that followed the same two ids before (a hashed
table), order 1 the one that followed the same id, each with a confidence that grows with hits and falls with misses;
order 0 gives every id a share by its frequency so far among the ids that the other two missed. The weights of the mixture are
running counts of which order was right, kept apart by both confidences and by whether the two expect the same id. The mixture's
cumulative range drives a carryless 64-bit range coder with 16-bit words.

Blocks of at most ``BLOCK`` ids begin with a new model, so each can be decoded alone, and have a CRC-32 of their ids. A block is cut
into up to ``LANES`` runs of ids, each with words of its own; numpy takes a step for one id of every run at once,
and the model learns from all runs.

File format: a file is a run of segments. A segment has a header (magic, counts), the doc_ids and id counts of its documents
in order, its blocks (ids, runs, words, CRC-32, different ids; those ids; the words of each run; the words), a CRC-32 of all before, and the end mark. A
document lies in one segment. Files are written by Spark's committed text writer with the end mark as record separator, into any file
system that Spark can write, and read back by its binary source.

Defined results: a null or empty text is the end token alone; a null id is stored as such; repeated rows are stored each, those
of one id in the order of their texts' hashes; an empty table gives no rows; columns other than doc_id and text are not used.
Ids must be below 65,536.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from kindred.llm.tokens import Encoder, groups_by_size
from kindred.llm.worker import give_back
from kindred.session import cut, delete_path, scratch_path, ship

#: Ids of a block, most lanes of a block, fewest ids of a lane, documents' ids of a segment, segments of a file.
BLOCK, LANES, LANE_IDS, SEGMENT_IDS, FILE_SEGMENTS = 1 << 22, 12288, 256, 1 << 22, 4
#: Pieces of a generation of the tokeniser's cache, about 120 MB: a piece that isn't kept costs ten times one that is.
PIECES = 600_000
#: Different ids, slots of the order-2 table, and the highest confidence of a table's entry.
IDS, SLOTS, SURE = 1 << 16, 1 << 18, 7
#: Bits of a probability, gain of an id's frequency at each meeting, most that frequencies may sum to, steps between sums.
UNIT, GAIN, MOST, REFRESH = 28, 48, 1 << 22, 8
#: Bits of the place in order 0's table that finds most ids at once when reading.
PLACES = 14
MAGIC, END_MARK = b"KTB3", b"KEND"
_HEAD, _BLOCK = struct.Struct("<4sIQI"), struct.Struct("<IIIII")
_U = np.uint64


#: What a hit or a miss adds to an entry, by how sure it is; a miss that leaves it without confidence is dealt with apart.
_CHANGE = np.array([[-(2 << 16), (c < SURE) << 16] for c in range(SURE + 1)], np.int64).ravel()


class _Model:
    """What a block's lanes share: predictions of orders 2, 1 and 0, how far each is to be trusted, and their updates."""

    def __init__(self, ids: int, reads: bool = False):
        self.frequency, self.reads = np.ones(ids, np.int64), reads
        # Entries: the id that is expected, and above 16 bits how sure that is.
        self.one, self.two = np.zeros(ids, np.int64), np.zeros(SLOTS, np.int64)
        # Outcomes (order 2 right, order 1 right, neither) by both confidences and whether the two expect the same.
        self.outcomes = np.tile(np.array([2, 1, 3], np.int64), (2 * (SURE + 1) ** 2, 1))
        self.met: list[np.ndarray] = []
        self.seen: list[np.ndarray] = []
        self.steps, self.due = 0, 1
        self._sum()

    def _sum(self) -> None:
        """Bring frequencies and weights up to date."""
        if self.met:
            self.frequency += np.bincount(np.concatenate(self.met), minlength=len(self.frequency)) * GAIN
            self.met = []
            while int(self.frequency.sum()) > MOST:
                self.frequency = (self.frequency + 1) >> 1
        # In parts of 2 ** UNIT, so that no id needs a division: the least share, 63 parts of a 32nd, is still above one.
        self.upto = np.zeros(len(self.frequency) + 1, np.int64)
        np.cumsum(self.frequency, out=self.upto[1:])
        self.upto = (self.upto << UNIT) // self.upto[-1]
        if self.reads:
            first = (self.upto + (1 << (UNIT - PLACES)) - 1) >> (UNIT - PLACES)
            self.at_place = np.append(np.repeat(np.arange(len(self.frequency)), np.diff(first)), len(self.frequency) - 1)
        if self.seen:
            self.outcomes += np.bincount(np.concatenate(self.seen), minlength=self.outcomes.size).reshape(self.outcomes.shape)
            self.seen = []
        old = self.outcomes.sum(axis=1) > 1 << 15
        self.outcomes[old] = (self.outcomes[old] + 1) >> 1
        # A 32nd stays for order 0, so that each id has a share.
        shares = np.cumsum(self.outcomes, axis=1) * ((1 << UNIT) - (1 << (UNIT - 5))) // self.outcomes.sum(axis=1)[:, None]
        self.upto2, self.upto1 = np.ascontiguousarray(shares[:, 0]), np.ascontiguousarray(shares[:, 1])
        shares[:, 2] = 1 << UNIT
        self.sizes = np.diff(shares, axis=1, prepend=0).ravel()
        self.starts = shares.ravel() - self.sizes

    def predict(self, last: np.ndarray, before: np.ndarray) -> None:
        self.at1, self.at2 = last, (last * 40503 + before * 30011) & (SLOTS - 1)
        self.e1, self.e2 = self.one[last], self.two[self.at2]
        self.p1, self.p2 = self.e1 & (IDS - 1), self.e2 & (IDS - 1)
        self.c1, self.c2 = self.e1 >> 16 << 1, self.e2 >> 16 << 1
        self.bin = self.c2 * (SURE + 1) + self.c1 + (self.p1 == self.p2)

    def outcome(self, ids: np.ndarray) -> np.ndarray:
        """0 where order 2 is right, else 1 where order 1 is, else 2."""
        self.hit2, self.hit1 = self.p2 == ids, self.p1 == ids
        return (2 - self.hit1) * ~self.hit2

    def update(self, ids: np.ndarray, which: np.ndarray) -> None:
        self.seen.append(self.kind)
        for table, at, entry, sure, hit in ((self.two, self.at2, self.e2, self.c2, self.hit2), (self.one, self.at1, self.e1, self.c1, self.hit1)):
            new = entry + _CHANGE[sure + hit]
            lost = np.flatnonzero(new < 0)
            new[lost] = ids[lost]
            table[at] = new
        self.met.append(ids[self.zero])
        self.steps += 1
        if self.steps >= self.due:
            self._sum()
            self.due = self.steps + min(self.steps, REFRESH)

    def narrow(self, low: np.ndarray, width: np.ndarray, ids: np.ndarray, which: np.ndarray) -> None:
        """Take each lane's interval to that of its id."""
        self.zero = zero = np.flatnonzero(which == 2)
        self.kind = self.bin * 3 + which
        start, size = self.starts[self.kind], self.sizes[self.kind]
        x, rest = ids[zero], size[zero]
        a = rest * self.upto[x] >> UNIT
        start[zero] += a
        size[zero] = (rest * self.upto[x + 1] >> UNIT) - a
        unit = width >> _U(UNIT)
        low += start.view(_U) * unit
        np.multiply(unit, size.view(_U), out=width)

    def read(self, value: np.ndarray) -> np.ndarray:
        """The id in whose interval each value (of 2 ** UNIT) lies."""
        ids = np.where(value < self.upto2[self.bin], self.p2, self.p1)
        f12 = self.upto1[self.bin]
        zero = np.flatnonzero(value >= f12)
        f12 = f12[zero]
        place = (((value[zero] - f12 + 1) << UNIT) - 1) // ((1 << UNIT) - f12)
        # Most places of the table lie within one id.
        k = place >> (UNIT - PLACES)
        found = self.at_place[k]
        more = np.flatnonzero(self.upto[found + 1] <= place)
        found[more] = np.searchsorted(self.upto, place[more], "right") - 1
        ids[zero] = found
        return ids


def _settled(low: np.ndarray, width: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Of the lanes ``active``, those that must shift out a word now; a straddling narrow interval is cut short."""
    wi = width[active]
    short = np.flatnonzero(wi <= _U(1 << 48))
    active, wi = active[short], wi[short]
    lo = low[active]
    same = (lo ^ (lo + wi - _U(1))) < _U(1 << 48)
    narrow = (wi < _U(1 << 32)) & ~same
    if narrow.any():
        who = active[narrow]
        width[who] = (~low[who] + _U(1)) & _U((1 << 32) - 1)
    return active[same | narrow]


def _lanes(n: int) -> tuple[int, int]:
    """Lanes of a block of n ids, and the ids of each but the last."""
    each = -(-n // max(1, min(LANES, n // LANE_IDS)))
    return -(-n // each), each


def encode_block(ids: np.ndarray, most: int = IDS) -> tuple[np.ndarray, np.ndarray]:
    """(16-bit words of all lanes, words of each lane) of a block of ids below ``most``."""
    lanes, each = _lanes(len(ids))
    grid = np.zeros(lanes * each, np.int64)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, each).T)
    model, all_ = _Model(most), np.arange(lanes)
    low, width = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    owners, words = [], []
    for t in range(each):
        n = lanes if t + (lanes - 1) * each < len(ids) else lanes - 1
        x = grid[t, :n]
        model.predict(last[:n], before[:n])
        which = model.outcome(x)
        model.narrow(low[:n], width[:n], x, which)
        model.update(x, which)
        before, last = last, x
        out = _settled(low, width, all_[:n])
        while len(out):
            owners.append(out)
            words.append(low[out] >> _U(48))
            low[out] <<= _U(16)
            width[out] <<= _U(16)
            out = _settled(low, width, out)
    end = (low + _U((1 << 32) - 1)) >> _U(32)
    owner = np.concatenate([*owners, all_, all_]).astype(np.uint16)
    word = np.concatenate([*words, end >> _U(16), end & _U(0xFFFF)]).astype("<u2")
    return word[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=lanes)


def decode_block(words: np.ndarray, counts: np.ndarray, total: int, most: int = IDS) -> np.ndarray:
    """The ids of a block coded by ``encode_block``."""
    lanes, each = _lanes(total)
    if len(counts) != lanes:
        raise ValueError("block of another shape")
    words = np.append(words, np.zeros(1, "<u2")).astype(_U)
    stop = np.cumsum(counts)
    at = stop - counts
    model, all_ = _Model(most, True), np.arange(lanes)
    low, width = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    code = np.zeros(lanes, _U)

    def take(who: np.ndarray) -> None:
        place = at[who]
        code[who] = (code[who] << _U(16)) | np.where(place < stop[who], words[np.minimum(place, len(words) - 1)], _U(0))
        at[who] += 1

    for _ in range(4):
        take(all_)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    grid = np.zeros((each, lanes), np.int64)
    for t in range(each):
        n = lanes if t + (lanes - 1) * each < total else lanes - 1
        model.predict(last[:n], before[:n])
        x = model.read(((code[:n] - low[:n]) // (width[:n] >> _U(UNIT))).astype(np.int64))
        grid[t, :n] = x
        which = model.outcome(x)
        model.narrow(low[:n], width[:n], x, which)
        model.update(x, which)
        before, last = last, x
        out = _settled(low, width, all_[:n])
        while len(out):
            low[out] <<= _U(16)
            width[out] <<= _U(16)
            take(out)
            out = _settled(low, width, out)
    return np.ascontiguousarray(grid.T).reshape(-1)[:total].astype(np.uint32)


def write_segment(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of documents with these ids one after another."""
    if len(ids) and int(ids.max()) >= IDS:
        raise ValueError("ids must be below 65,536")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d if d is not None else 0 for d in doc_ids], "<i8")
    blocks = [ids[at : at + BLOCK] for at in range(0, len(ids), BLOCK)]
    parts = [_HEAD.pack(MAGIC, len(doc_ids), len(ids), len(blocks)), names.tobytes(), known.tobytes(), counts.astype("<u8").tobytes()]
    for own in blocks:
        # Ids are coded by their place among those of the block: its tables are short.
        used = np.flatnonzero(np.bincount(own, minlength=IDS))
        rank = np.zeros(IDS, np.int64)
        rank[used] = np.arange(len(used))
        words, each = encode_block(rank[own], len(used))
        parts += [_BLOCK.pack(len(own), len(each), len(words), zlib.crc32(own.astype("<u4")), len(used)), used.astype("<u2").tobytes(), each.astype("<u2").tobytes(), words.tobytes()]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def read_segments(raw: bytes) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, counts, ids) of each segment of a file."""
    at = 0
    while at < len(raw):
        magic, n, total, blocks = _HEAD.unpack_from(raw, at)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        begin, at = at, at + _HEAD.size
        names = np.frombuffer(raw, "<i8", n, at)
        known = np.frombuffer(raw, np.uint8, n, at + 8 * n)
        counts = np.frombuffer(raw, "<u8", n, at + 9 * n).astype(np.int64)
        at += 17 * n
        coded = []
        for _ in range(blocks):
            size, lanes, words, check, known_ids = _BLOCK.unpack_from(raw, at)
            at += _BLOCK.size
            used = np.frombuffer(raw, "<u2", known_ids, at).astype(np.uint32)
            at += 2 * known_ids
            coded.append((np.frombuffer(raw, "<u2", words, at + 2 * lanes), np.frombuffer(raw, "<u2", lanes, at).astype(np.int64), size, check, used))
            at += 2 * (lanes + words)
        if struct.unpack_from("<I", raw, at)[0] != zlib.crc32(raw[begin:at]):
            raise ValueError("segment fails its checksum")
        at += 4
        if raw[at : at + len(END_MARK)] != END_MARK:
            raise ValueError("segment lacks its end mark")
        at += len(END_MARK)
        ids = [np.zeros(0, np.uint32)]
        for words, each, size, check, used in coded:
            ids.append(used[decode_block(words, each, size, len(used))])
            if zlib.crc32(ids[-1].astype("<u4")) != check:
                raise ValueError("block fails its checksum")
        if sum(map(len, ids)) != total:
            raise ValueError("segment lacks ids")
        yield [int(d) if k else None for d, k in zip(names, known, strict=True)], counts, np.concatenate(ids)


def write_tokens(docs: DataFrame, path: str, end: int = 0, vocabulary: str | None = None) -> None:
    """Write the ids of all ``docs`` (doc_id long, text) below ``path``, in ascending doc_id order over files and within them."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary, PIECES)
        names: list = []
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def segment() -> pa.RecordBatch:
            data = write_segment(names, np.concatenate(counts), np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["segment"])

        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, 512):
                texts = batch.column(1).slice(at, 512).to_pylist()
                for a, b in groups_by_size(texts):
                    ids, offsets = encoder.encode(texts[a:b], end)
                    names += ids_of[at + a : at + b]
                    parts.append(ids.astype(np.uint16) if int(ids.max()) < 65536 else ids)
                    counts.append(np.diff(offsets))
                    size += len(ids)
                    if size >= SEGMENT_IDS:
                        yield segment()
                        names, parts, counts, size = [], [], [], 0
        if names:
            yield segment()
        give_back()

    # Many rows of one id, or of none, are dealt over several ranges by their texts.
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    segments = rows.mapInArrow(run, "segment binary")
    segments.select(F.col("segment").cast("string").alias("value")).write.option("lineSep", END_MARK.decode()).option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files below ``path``, in order of doc_id; start counts all ids before."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name, start = path_.rsplit("/", 1)[-1], 0
                for names, counts, ids in read_segments(content.as_buffer()):
                    raw = ids.astype("<u4")
                    ends = np.cumsum(counts)
                    crc = [zlib.crc32(raw[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                    n = len(names)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(names, pa.int64()), pa.array(ends - counts + start), pa.array(counts), pa.array(crc, pa.int64())], ["file", "doc_id", "inner", "n_tokens", "ids_crc32"])
                    start += int(ends[-1]) if n else 0
        give_back()

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    docs = cut(files.mapInArrow(run, "file string, doc_id long, inner long, n_tokens long, ids_crc32 long"))
    # One row per file. A file's name ends in the numbers of its range of doc_id and of the file within the range.
    totals = docs.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")
    order = W.orderBy(number(r"^part-(\d+)"), number(r"-c(\d+)[^-]*$"), "file")
    totals = totals.select("file", (F.sum("total").over(order) - F.col("total")).alias("before"))
    return docs.join(totals, "file").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op5_tokenfile(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    found = read_tokens(spark, path)  # holds what it needs of the files
    delete_path(spark, path)
    return found
