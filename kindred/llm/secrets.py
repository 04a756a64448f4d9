"""Secrets in whole texts: exact patterns, and character Markov models compared by log-likelihood ratio.

Two second-order models over the token alphabet are trained from labelled samples: random strings (hexadecimal, letters of one
case or both, alphanumeric, base64) and ordinary strings (words, identifiers in several styles, numbers, versions, paths). Both
samples come from a seeded generator. Every run of token characters of ``MIN_RUN`` or more in every text is scored by the mean of
log P(random) - log P(ordinary) over its characters, and is a secret if that exceeds what any ordinary training string reaches.
In a run that is none as a whole (a key in a path, or after a name), the stretches of ``MIN_RUN`` or more with the greatest sums
above what any stretch of an ordinary training string reaches are secrets, each widened to the letters and digits it ends in.
Nothing but the two models decides.

Pattern spans always stay; what they leave of a run is scored as a run of its own.

Defined results: null and empty texts have no spans; repeated rows have equal results; null ids pass through; an empty
table gives no rows; columns other than doc_id and text are not used.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.session import ship

#: Fixed order of the kinds; the last is what the models add.
KINDS = ("assign", "access", "hex", "markov")
MIN_RUN = 16
#: Share of an even distribution in each model, so that one unseen character doesn't decide.
EVEN = 0.05
#: How far above all ordinary training strings a score must lie.
MARGIN = 0.3
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_KEYS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
_CODE = np.full(128, len(ALPHABET), np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Pattern spans (kind, start, end) by start, then kind as listed."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def labelled_strings(n: int, seed: int) -> tuple[list[str], list[str]]:
    """(random, ordinary) sample strings of MIN_RUN to 64 characters."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    parts = (
        "the ing and ion tio ent ati for her ter hat tha ere ate his con res ver all ons nce men ith ted ers pro thi wit are ess not ive was ect rea com eve per int est sta cti ica ist ear ain one our iti rat "
        "ly ble ness ful ship less ous ough ight wh sh st sp tr ck th qu ph un re in on en an er al or "
        "ung sch ich ein der lich keit heit ge be zu ver ach pf tz ch ck st auf gen bar los zug eu ei ie "
        "que eau ment aux cion mente ado osa eux oir elle ette ais ez les ille gn oi ou "
        "llo rra ente ista dad cia iento ando ar ir"
    ).split()
    word = lambda: "".join(pick(parts) for _ in range(int(rng.integers(1, 4))))
    kinds = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + "0123456789", ALPHABET[:52], ALPHABET[:26], ALPHABET[26:52])
    random = [chars(pick(kinds), int(rng.integers(MIN_RUN, 65))) for _ in range(n)]

    def ordinary() -> str:
        words = [word() for _ in range(12)]
        form = rng.integers(12)
        if form == 0:
            s = "_".join(words)
        elif form == 1:
            s = "-".join(words)
        elif form == 2:
            s = "/".join(words)
        elif form == 3:
            s = "".join(w.capitalize() for w in words)
        elif form == 4:
            s = "_".join(words).upper()
        elif form == 5:
            s = f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}-" + "-".join(words)
        elif form == 6:
            s = "".join(words[:3]) + str(rng.integers(1, 1000)) + "_" + "_".join(words)
        elif form == 7:
            s = pick(["=", "-", "_", "+", "/"]) * 40 if rng.integers(2) else str(rng.integers(0, 10)) * 6 + "0" * 30
        elif form == 8:
            s = chars("0123456789", 48)
        elif form == 9:
            s = pick("/_-").join(chars("0123456789", int(rng.integers(1, 21))) if rng.integers(3) == 0 else w for w in words)
        elif form == 10:
            s = "-".join(chars("0123456789", int(rng.integers(2, 7))) for _ in range(16))
        else:
            s = "".join(words)
        return s[: int(rng.integers(MIN_RUN, 48))]

    return random, [ordinary() for _ in range(n)]


class Ratio:
    """log P(random) - log P(ordinary) of each character after the two before it; both tables smoothed toward first order."""

    def __init__(self, n: int = 4000, seed: int = 31):
        random, ordinary = labelled_strings(n, seed)
        self.table = self._model(random) - self._model(ordinary)
        self.threshold = max(0.0, float(self.scores(ordinary).max())) + MARGIN
        #: The same for the best stretch of MIN_RUN characters.
        self.stretch_threshold = max(self.threshold, max(float(np.convolve(self.steps(s), np.full(MIN_RUN - 2, 1.0 / (MIN_RUN - 2)), "valid").max()) for s in ordinary) + MARGIN)

    @staticmethod
    def _codes(s: str) -> np.ndarray:
        return _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]

    def _model(self, strings: list[str]) -> np.ndarray:
        k = len(ALPHABET) + 1
        third, second = np.zeros((k, k, k)), np.zeros((k, k))
        for s in strings:
            c = self._codes(s)
            np.add.at(third, (c[:-2], c[1:-1], c[2:]), 1)
            np.add.at(second, (c[:-1], c[1:]), 1)
        first = second.sum(axis=0) + 1.0
        p1 = first / first.sum()
        p2 = (second + 4.0 * p1) / (second.sum(axis=1, keepdims=True) + 4.0)
        p3 = (third + 4.0 * p2[None]) / (third.sum(axis=2, keepdims=True) + 4.0)
        return np.log((1.0 - EVEN) * p3 + EVEN / len(ALPHABET))

    def scores(self, strings: list[str]) -> np.ndarray:
        """Mean ratio per character of each string."""
        return np.array([self.steps(s).mean() for s in strings])

    def steps(self, s: str) -> np.ndarray:
        """Ratio of each character from the third on."""
        c = self._codes(s)
        return self.table[c[:-2], c[1:-1], c[2:]]


@functools.lru_cache(maxsize=1)
def trained_ratio() -> Ratio:
    return Ratio()


def stretches(run: str, ratio: Ratio) -> list[tuple[int, int]]:
    """(start, end) of the secrets in a run of token characters: the whole run, or its best stretches of MIN_RUN or more."""
    if len(run) < MIN_RUN:
        return []
    steps = ratio.steps(run)
    if steps.mean() > ratio.threshold:
        return [(0, len(run))]
    sums = np.concatenate([[0.0], np.cumsum(steps - ratio.stretch_threshold)])
    found, parts = [], [(0, len(steps))]
    while parts:
        lo, hi = parts.pop()
        if hi - lo < MIN_RUN - 2:
            continue
        own = sums[lo : hi + 1]
        gain = own[MIN_RUN - 2 :] - np.minimum.accumulate(own)[: len(own) - MIN_RUN + 2]
        k = int(gain.argmax())
        if gain[k] <= 0:
            continue
        start, end = lo + int(own[: k + 1].argmin()), lo + k + MIN_RUN - 2
        parts += [(lo, start), (end, hi)]
        a, b = (start + 2 if start else 0), end + 2
        while a and run[a - 1].isalnum():
            a -= 1
        while b < len(run) and run[b].isalnum():
            b += 1
        found.append((a, b))
    joined: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


def spans_of(text: str | None, ratio: Ratio) -> tuple[list, list]:
    """(pattern spans, all spans) of a text."""
    base = base_spans(text)
    if not text:
        return base, base
    reach = list(itertools.accumulate((e for _, _, e in base), max))
    more, first = [], 0
    for m in _RUN.finditer(text):
        at, stop = m.start(), m.end()
        while first < len(base) and reach[first] <= at:  # spans that end before this run, and all before them
            first += 1
        for _, s, e in itertools.takewhile(lambda span: span[1] < stop, itertools.islice(base, first, None)):
            if s > at:
                more += [("markov", at + a, at + b) for a, b in stretches(text[at:s], ratio)]
            at = max(at, e)
        if at < stop:
            more += [("markov", at + a, at + b) for a, b in stretches(text[at:stop], ratio)]
    return base, in_order(base + more)


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (of pattern spans), base_sha256, spans, n_markov for every row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    ratio = trained_ratio()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            sha, joined = [], []
            for at in range(0, batch.num_rows, 512):
                for text in batch.column(1).slice(at, 512).to_pylist():
                    base, all_ = spans_of(text, ratio)
                    for c, k in zip(counts, KINDS, strict=True):
                        c.append(sum(s[0] == k for s in all_))
                    sha.append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                    joined.append(join_spans(all_))
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(joined, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    typed = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {typed}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
