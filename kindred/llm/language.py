"""Language identification by averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A text's subwords are its byte 3- and 4-grams (ASCII letters lowered, everything else below 128 read as a space) whose
second byte belongs to a letter. Each is hashed to one of ``BUCKETS`` embeddings; a text is the mean of its subwords'
embeddings, and a linear layer gives one logit per language. Both layers are trained by stochastic gradient descent in
numpy, then folded into one table of per-bucket logits, so that a text of any length costs one gather per subword.

Only the rows of the training sample are bounded: about ``per_label`` rows of each language, or fewer of all alike where their
texts are so long that the sample would pass ``SAMPLE_BYTES``, chosen by a hash of id and text. Whole texts are learnt from:
all subwords of a row go to the driver as counts. Every language of the labelled rows is learnt. A fifth of the sample is set
aside to fit the softmax temperature and the rejection threshold (below which the given share of rightly labelled texts would fall).

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; without any labelled row
every text is ``und``; rows with a null id or null language are predicted but never learnt from; repeated rows have
equal results; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kindred.llm.words import text_buffers
from kindred.llm.worker import forget_others, give_back
from kindred.session import ship

BUCKETS, SIZE = 1 << 15, 16
#: Most bytes that the training sample is expected to have on the driver, as distinct subwords of six bytes each.
SAMPLE_BYTES = 128 << 20
#: Fewest steps of gradient descent: small samples are gone through more often.
LEAST_STEPS = 250
#: Bytes handled at once.
BLOCK = 1 << 20

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def subwords(raw: np.ndarray, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 3- and 4-grams of the bytes that begin before ``stop``, and the places of their first bytes; grams whose second byte is no letter's are left out."""
    b = np.concatenate([_FOLD[raw], np.full(3, 32, np.uint8)]).astype(np.uint32)
    n = len(raw) if stop is None else min(stop, len(raw))
    if len(raw) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.flatnonzero(b[1 : n + 1] != 32)
    three = b[:n] | (b[1 : n + 1] << np.uint32(8)) | (b[2 : n + 2] << np.uint32(16))
    four = (three | (b[3 : n + 3] << np.uint32(24)))[place]
    three = three[place]
    h3 = (three * np.uint32(0x9E3779B1)) >> np.uint32(17)
    h4 = ((four ^ (four >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(17)
    return np.concatenate([h3, h4]).astype(np.int64), np.concatenate([place, place])


def subword_counts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of all subwords of a text, a block at a time."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw), BLOCK):
        total += np.bincount(subwords(raw[at : at + BLOCK + 3], BLOCK)[0], minlength=BUCKETS)
    own = np.flatnonzero(total)
    return own, total[own]


@dataclass
class Model:
    """labels, embeddings (BUCKETS, SIZE) and what takes their mean to logits (SIZE, labels), bias, softmax temperature and rejection threshold.

    With at most SIZE languages the two are folded into one table of logits and ``weights`` is None.
    """

    labels: list[str]
    table: np.ndarray
    weights: np.ndarray | None
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        z = ((means if self.weights is None else means @ self.weights) + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and probability of each text."""
        raw, offsets = text_buffers(column)
        n = len(offsets) - 1
        k, width = len(self.labels), self.table.shape[1]
        sums, counts = np.zeros((n, width)), np.zeros(n)
        i = 0
        while i < n:
            to = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
            for a, b, lo, hi in self._blocks(offsets, i, to):
                got, place = subwords(raw[a : min(b + 3, int(offsets[hi]))], b - a)
                if len(got):
                    doc = np.searchsorted(offsets[lo : hi + 1], place + a, "right") - 1
                    values = self.table[got]
                    for c in range(width):
                        sums[lo:hi, c] += np.bincount(doc, weights=values[:, c], minlength=hi - lo)
                    counts[lo:hi] += np.bincount(doc, minlength=hi - lo)
            i = to
        p = self.probabilities(sums / np.maximum(counts, 1)[:, None]) if k else np.zeros((n, 1))
        best = p.argmax(axis=1)
        names, score = [], p.max(axis=1)
        for j in range(n):
            whole = raw[offsets[j] : offsets[j + 1]]
            known = k and len(whole) and _has_letter(whole)
            names.append(self.labels[best[j]] if known else "und")
            if not known:
                score[j] = 0.0
        return names, score

    @staticmethod
    def _blocks(offsets: np.ndarray, i: int, to: int) -> Iterator[tuple[int, int, int, int]]:
        """(from, to, first text, last text) byte blocks: texts i .. to - 1 one by one where a text is alone and long, else all together."""
        a, b = int(offsets[i]), int(offsets[to])
        if to - i > 1 or b - a <= BLOCK:
            # Grams may reach over a text's end by up to three bytes; texts are parted by working each text's tail as its own would be.
            yield from ((int(offsets[j]), int(offsets[j + 1]), j, j + 1) for j in range(i, to))
        else:
            for at in range(a, b, BLOCK):
                yield at, min(b, at + BLOCK), i, i + 1


def _has_letter(raw: np.ndarray) -> bool:
    fold = _FOLD[raw[:4096]]
    if ((fold > 32) & (fold < 128)).any():
        return True
    return any(map(str.isalpha, raw.tobytes().decode("utf-8", "replace")))


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 4, rate: float = 0.5, reject: float = 0.002, seed: int = 3) -> Model:
    """A model from (language, buckets, counts) samples."""
    samples = sorted((s for s in samples if len(s[1])), key=lambda s: (s[0], len(s[1]), s[1].tobytes(), s[2].tobytes()))
    labels = sorted({s[0] for s in samples})
    if not labels:
        return Model([], np.zeros((BUCKETS, 0)), None, np.zeros(0), 1.0, 0.5)
    rng = np.random.Generator(np.random.PCG64(seed))
    number = {lang: i for i, lang in enumerate(labels)}
    y = np.array([number[s[0]] for s in samples], np.int64)
    # Of each language a fifth is set aside, but nothing where it has less than five rows.
    order = rng.permutation(len(samples))
    seen, held = np.zeros(len(labels), np.int64), np.zeros(len(samples), bool)
    for i in order.tolist():
        seen[y[i]] += 1
        held[i] = seen[y[i]] % 5 == 0
    e = (rng.standard_normal((BUCKETS, SIZE)) * 0.1).astype(np.float32)
    w, bias = (rng.standard_normal((SIZE, len(labels))) * 0.1).astype(np.float32), np.zeros(len(labels), np.float32)
    train, check = np.flatnonzero(~held), np.flatnonzero(held)
    size = 32
    epochs = max(epochs, -(-LEAST_STEPS * size // len(train)))
    steps, total = 0, epochs * -(-len(train) // size)
    shares = [(s[2] / s[2].sum()).astype(np.float32) for s in samples]
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), size):
            own = train[at : at + size]
            flat, share = np.concatenate([samples[i][1] for i in own]).astype(np.int64), np.concatenate([shares[i] for i in own])
            lengths = np.array([len(samples[i][1]) for i in own])
            starts = np.cumsum(lengths) - lengths
            mean = np.add.reduceat(e[flat] * share[:, None], starts, axis=0)
            z = mean @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1.0
            now = rate * (1.0 - steps / total)
            d_mean = (p @ w.T) * np.float32(8.0 * now)
            w -= now * (mean.T @ p) / len(own)
            bias -= now * p.mean(axis=0)
            which, place = np.unique(flat, return_inverse=True)
            parts = np.repeat(d_mean, lengths, axis=0) * share[:, None]
            e[which] -= np.stack([np.bincount(place, weights=parts[:, c], minlength=len(which)) for c in range(SIZE)], axis=1).astype(np.float32)
            steps += 1
    folded = len(labels) <= SIZE
    model = Model(labels, (e @ w).astype(np.float64) if folded else e.astype(np.float64), None if folded else w.astype(np.float64), bias.astype(np.float64), 1.0, 0.0)
    if len(check):
        means = np.array([shares[i] @ model.table[samples[i][1]] for i in check])
        truth = y[check]

        def loss(t: float) -> float:
            model.temperature = t
            return -float(np.log(np.maximum(model.probabilities(means)[np.arange(len(check)), truth], 1e-12)).mean())

        model.temperature = min((2.0 ** (x / 4) for x in range(-20, 13)), key=loss)
        right = model.probabilities(means)[np.arange(len(check)), truth]
        model.threshold = float(min(0.5, np.quantile(right, reject)))
    return model


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 4).cast("int")


def learn(docs: DataFrame, per_label: int = 600, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from about ``per_label`` rows of each language among the rows of ``docs`` (doc_id, text, lang) outside fold 2."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where(fold_of(F.col("doc_id")) != 2).where("lang is not null and text is not null")
    cost = F.least(2 * F.octet_length("text"), F.lit(BUCKETS)) * 6.0
    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(cost).alias("cost"))
    per = per.withColumn("share", F.least(F.lit(1.0), F.lit(float(per_label)) / F.col("n")))
    expected = per.agg(F.sum(F.col("n") * F.col("share") * F.col("cost"))).first()[0] or 0.0
    per = per.select(F.col("lang").alias("of_lang"), (F.col("share") * min(1.0, sample_bytes / max(expected, 1.0))).alias("share"))  # a row for each language that the model will have
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.join(F.broadcast(per), F.col("lang") == F.col("of_lang")).where(chance < F.col("share")).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for at in range(0, batch.num_rows, 256):
                got = [subword_counts(raw[offsets[i] : offsets[i + 1]]) for i in range(at, min(at + 256, batch.num_rows))]
                columns = [pa.array([b.astype("<u2").tobytes() for b, _ in got], pa.binary()), pa.array([c.astype("<f4").tobytes() for _, c in got], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), *columns], ["lang", "buckets", "counts"])
        give_back()

    found = chosen.mapInArrow(counted, "lang string, buckets binary, counts binary").toLocalIterator()
    return fit([(r["lang"], np.frombuffer(r["buckets"], "<u2"), np.frombuffer(r["counts"], "<f4")) for r in found])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of ``docs``; the model is learnt from ``docs`` if none is given."""
    ship(docs.sparkSession)
    model = model or learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = model.predict(batch.column(1))
            rejected = [n == "und" or s < model.threshold for n, s in zip(names, score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])
        give_back()

    typed = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {typed}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with the columns they had."""
    ship(docs.sparkSession)
    model = model or learn(docs)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                names, score = model.predict(batch.column(place))
                yield batch.filter(pa.array([n != "und" and s >= model.threshold for n, s in zip(names, score.tolist(), strict=True)], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs).select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
