"""Personal data in whole texts: exact patterns, and a character-level bidirectional LSTM with a CRF on top.

The tagger is trained here, in numpy, from labelled spans: a seeded generator writes prose with e-mail addresses, IP
addresses, card and phone numbers in many written forms (also spelled-out and spaced ones that no pattern covers) and
with look-alikes that are none. Every character of every text is tagged: texts are cut into overlapping windows, the
windows of many texts run side by side, each is decoded by Viterbi, and a character's tag is taken from the
window in whose middle it lies; spans are then read from the whole text's tags. Windows where the all-outside path is
provably the best one (no interval of tags could gain by any transition) skip the search and have that result.

Pattern spans always stay; a tagged span is added as the search found it, less white space and closing marks at its edges,
if it overlaps no pattern span. A plausibility rule of its kind can only veto it.

Defined results: null and empty texts have no spans; repeated rows have equal results; null ids pass through; an empty
table gives no rows; columns other than doc_id and text are not used by ``find_pii``, and ``mask_pii`` leaves
them as they are.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.llm.tokens import groups_by_size
from kindred.llm.worker import forget_others, give_back
from kindred.session import ship

KINDS = ("email", "ip", "card", "phone")
#: Units per direction, numbers per letter, window length and the margin given up at each inner window edge, windows run at once.
UNITS, LETTER_SIZE, WINDOW, MARGIN, LANES = 12, 8, 512, 32, 1024

_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local+ @ label (. label)+ from the left, each found from its @ so that a long run costs its length once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Pattern spans (kind, start, end) by kind, then start."""
    if not text:
        return []
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


# --- the tagger ---------------------------------------------------------------------------------------------

#: Character classes: printable ASCII one by one, then padding, other control, other letter, anything else.
N_CLASSES, PAD = 99, 95


def classes_of(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(code, len(_CLASS) - 1)]


_CLASS = np.full(0x3001, 98, np.uint8)
_CLASS[:32] = 96
_CLASS[32:127] = np.arange(95)
_CLASS[127:160] = 96
_CLASS[[i for i in range(160, 0x3000) if chr(i).isalpha()]] = 97


def labelled_samples(n: int, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Character classes and tags (0 outside, 1-4 by kind), both (length, n), of generated prose with labelled spans."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    parts = "th in er an re on at en nd st es ing tion ou ed de la que ung sch ver le el os ar ción ment eau ge ich ant or it is".split()
    word = lambda: "".join(pick(parts) for _ in range(int(rng.integers(1, 4))))

    def email() -> str:
        local = pick([word(), f"{word()}.{word()}", f"{word()}.{digits(2)}", f"{word()}_{word()}{digits(1)}"])
        host = pick([word(), f"mail{digits(1)}.{word()}", f"{word()}-{word()}"])
        top = pick(["com", "org", "net", "de", "fr", "es", "info"])
        form = rng.integers(8)
        if form < 4:
            return f"{local}@{host}.{top}"
        at, dot = pick([(" at ", " dot "), ("[at]", "."), (" (at) ", "."), (" @ ", "."), ("[at]", "[dot]"), (" at ", ".")])
        return f"{local}{at}{host if dot == '.' else host.replace('.', dot)}{dot}{top}"

    def ip() -> str:
        part = [str(int(x)) for x in rng.integers(0, 256, 4)]
        return pick([".", ".", ".", " . ", "[.]"]).join(part)

    def card() -> str:
        raw = digits(int(pick([15, 15, 15, 14, 12])))
        for last in "0123456789":
            if luhn(raw + last):
                raw += last
                break
        sep = pick(["", " ", "-", "  ", "."])
        return sep.join(raw[i : i + 4] for i in range(0, len(raw), 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {a} {b} {c}", f"00{pick('1346')}{digits(1)} {a} {b}{c}", f"+1-{a}-{b}-{c}", f"{a}.{b}.{c}"])

    makers = (email, ip, card, phone)

    def plain() -> str:
        form = rng.integers(40)
        if form < 32:
            w = word()
            return (w.capitalize() if rng.integers(7) == 0 else w) + pick(["", "", "", "", "", ".", ",", ".\n", "###", "***", "&&&", " |"])
        return pick([
            digits(4), digits(2), digits(int(rng.integers(1, 9))), f"{digits(1)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}",
            f"${digits(2)}.{digits(2)}", f"v{digits(1)}.{digits(2)}", "at", "dot", f"{word()}_{word()}", f"{word()}={rng.integers(1 << 60):x}{rng.integers(1 << 60):x}", f"AKIA{word().upper()}{digits(5)}{word().upper()}",
            f"token = \"{rng.integers(1 << 60):x}{rng.integers(1 << 60):x}\"", f"({digits(4)})", f"{digits(3)},{digits(3)}", f"{digits(2)}%", "@", f"{word()} at {word()}", f"https://{word()}.com/{digits(6)}", f"+{digits(1)}", f"{digits(5)}-{digits(2)}", f"{word()}@{word()}",
        ])

    x, y = np.full((n, length), PAD, np.uint8), np.zeros((n, length), np.uint8)
    for i in range(n):
        at, stop = 0, length if rng.integers(5) else int(rng.integers(10, length))
        line: list[tuple[str, int]] = []
        total = 0
        while total < stop + 20:
            k = int(rng.integers(4)) if rng.integers(7) == 0 else -1
            s = makers[k]() if k >= 0 else plain()
            line += [(s, k + 1), (" ", 0)]
            total += len(s) + 1
        shift = int(rng.integers(0, 20))
        for s, tag in line:
            for ch_class in classes_of(s):
                if shift:
                    shift -= 1
                    continue
                if at < stop:
                    x[i, at], y[i, at] = ch_class, tag
                    at += 1
    return np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)


class Tagger:
    """A bidirectional LSTM over character classes with piecewise linear gates, and a linear-chain CRF over five tags.

    Arrays are (features, lanes) so that each gate is one contiguous block.
    """

    TAGS = 5

    def __init__(self, units: int = UNITS, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        u, f = units, np.float32
        self.units = units
        self.p = {"letters": rng.standard_normal((LETTER_SIZE, N_CLASSES)).astype(f)}
        for d in "fb":
            # Columns: the loop, the letter, a constant. Rows: in, forget and out gates (clipped to 0..1), candidate (to -1..1).
            w = np.concatenate([rng.standard_normal((4 * u, u)) * 0.3, rng.standard_normal((4 * u, LETTER_SIZE)) * 0.3, np.zeros((4 * u, 1))], axis=1)
            w[: 3 * u] *= 0.25
            w[: 3 * u, -1] = 0.5
            w[u : 2 * u, -1] = 0.75
            self.p[f"cell_{d}"] = w.astype(f)
            self.p[f"out_{d}"] = (rng.standard_normal((self.TAGS, u)) * 0.3).astype(f)
        self.p["bias"] = np.array([1, 0, 0, 0, 0], f)
        self.p["trans"] = (np.eye(self.TAGS) * 1.0).astype(f)

    def _run(self, d: str, x: np.ndarray, emit: np.ndarray, keep: list | None = None) -> None:
        u, letters, cell, out = self.units, self.p["letters"], self.p[f"cell_{d}"], self.p[f"out_{d}"]
        n = x.shape[1]
        c = np.zeros((u, n), np.float32)
        seen = np.zeros((u + LETTER_SIZE + 1, n), np.float32)  # the last output, the letter, the constant
        seen[-1] = 1.0
        h, letter = seen[:u], seen[u:-1]
        z, t_, e = np.empty((4 * u, n), np.float32), np.empty((u, n), np.float32), np.empty((self.TAGS, n), np.float32)
        into, forget, give, new = (z[k * u : (k + 1) * u] for k in range(4))
        gates = z[: 3 * u]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.take(letters, x[t].astype(np.int64), axis=1, out=letter, mode="clip")
            np.matmul(cell, seen, out=z)
            before = (c.copy(), seen.copy(), z.copy()) if keep is not None else None
            np.clip(gates, 0.0, 1.0, out=gates)
            np.clip(new, -1.0, 1.0, out=new)
            c *= forget
            np.multiply(into, new, out=t_)
            c += t_
            np.clip(c, -1.0, 1.0, out=h)
            h *= give
            np.matmul(out, h, out=e)
            emit[t] += e
            if keep is not None:
                keep.append((t, before, z.copy(), c.copy(), h.copy()))

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(time, tag, lane) scores of classes x (time, lane)."""
        emit = np.empty((len(x), self.TAGS, x.shape[1]), np.float32)
        emit[:] = self.p["bias"][None, :, None]
        for d in "fb":
            steps = [] if keep is not None else None
            self._run(d, x, emit, steps)
            if keep is not None:
                keep[d] = steps
        return emit

    def viterbi(self, emit: np.ndarray) -> np.ndarray:
        trans = self.p["trans"]
        score, back = emit[0], np.empty(emit.shape, np.int8)
        for t in range(1, len(emit)):
            all_ = score[:, None, :] + trans[:, :, None]
            back[t] = all_.argmax(axis=0)
            score = all_.max(axis=0) + emit[t]
        tags = np.empty((len(emit), emit.shape[2]), np.int8)
        tags[-1] = score.argmax(axis=0)
        lanes = np.arange(emit.shape[2])
        for t in range(len(emit) - 1, 0, -1):
            tags[t - 1] = back[t][tags[t], lanes]
        return tags

    def surely_outside(self, emit: np.ndarray) -> np.ndarray:
        """Lanes whose best path is provably outside everywhere: at each time even the best other tag with the best transitions into and out of it scores no more."""
        trans = self.p["trans"].copy()
        outside, trans[0, 0] = float(trans[0, 0]), -np.inf
        gain = float(trans.max()) - outside
        # A run of n other tags has n + 1 transitions instead of as many outside ones, or n or n - 1 at the window's ends.
        return ((emit[:, 1:].max(axis=1) - emit[:, 0]).max(axis=0) + gain + abs(gain)) <= 0.0

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood per character of the CRF, and its gradients by back-propagation through time."""
        keep: dict = {}
        emit = self.emissions(x, keep).astype(np.float64)
        trans = self.p["trans"].astype(np.float64)
        steps, k, n = emit.shape
        total = steps * n
        soft = lambda a, axis: (m := a.max(axis=axis)) + np.log(np.exp(a - np.expand_dims(m, axis)).sum(axis=axis))
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0]
        for t in range(1, steps):
            alpha[t] = soft(alpha[t - 1][:, None, :] + trans[:, :, None], 0) + emit[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = soft(trans[:, :, None] + (emit[t + 1] + beta[t + 1])[None], 1)
        log_z = soft(alpha[-1], 0)
        hot = np.eye(k)[y].transpose(0, 2, 1)
        pairs = hot[:-1].transpose(1, 0, 2).reshape(k, -1) @ hot[1:].transpose(1, 0, 2).reshape(k, -1).T
        gold = (emit * hot).sum() + (pairs * trans).sum()
        d_emit = ((np.exp(alpha + beta - log_z) - hot) / total).astype(np.float32)
        expected = np.zeros((k, k))
        for t in range(steps - 1):
            expected += np.exp(alpha[t][:, None] + trans[:, :, None] + (emit[t + 1] + beta[t + 1])[None] - log_z).sum(axis=2)
        grads = {"trans": ((expected - pairs) / total).astype(np.float32), "bias": d_emit.sum(axis=(0, 2))}
        u = self.units
        grads["letters"] = np.zeros_like(self.p["letters"])
        by_class = np.zeros((N_CLASSES, LETTER_SIZE), np.float32)
        for d in "fb":
            cell, out = self.p[f"cell_{d}"], self.p[f"out_{d}"]
            dh_next, dc_next = np.zeros((u, n), np.float32), np.zeros((u, n), np.float32)
            g_out, g_cell = np.zeros_like(out), np.zeros_like(cell)
            for t, (c_was, seen, raw), z, c, h in reversed(keep[d]):
                g_out += d_emit[t] @ h.T
                dh = out.T @ d_emit[t] + dh_next
                dc = dc_next + dh * z[2 * u : 3 * u] * (np.abs(c) < 1.0)
                dz = np.concatenate([dc * z[3 * u :], dc * c_was, dh * np.clip(c, -1, 1), dc * z[:u]])
                inside = (raw[: 3 * u] > 0.0) & (raw[: 3 * u] < 1.0)
                dz[: 3 * u] *= inside + 0.05 * ~inside
                dz[3 * u :] *= np.abs(raw[3 * u :]) < 1.0
                g_cell += dz @ seen.T
                dx = cell.T @ dz
                np.add.at(by_class, x[t], dx[u:-1].T)
                dh_next, dc_next = dx[:u], dc * z[u : 2 * u]
            grads[f"out_{d}"], grads[f"cell_{d}"] = g_out, g_cell
        grads["letters"] = np.ascontiguousarray(by_class.T)
        return float((log_z.sum() - gold) / total), grads

    def fit(self, steps: int = 1000, lanes: int = 64, length: int = 96, rate: float = 0.02, seed: int = 11) -> Tagger:
        x, y = labelled_samples(lanes * 32, length, seed)
        rng = np.random.Generator(np.random.PCG64(seed))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i in range(1, steps + 1):
            own = rng.choice(x.shape[1], lanes, replace=False)
            _, grads = self.loss_and_gradients(x[:, own], y[:, own])
            norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads.values()))
            now = rate * min(1.0, i / 20) * (1.0 - 0.9 * i / steps)
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                self.p[k] -= (now * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return self

    def tags(self, codes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """Tagged runs (tag, start, end) in concatenated texts codes[offsets[i]:offsets[i + 1]]; no run crosses texts."""
        lengths = np.diff(offsets)
        stride = WINDOW - 2 * MARGIN
        counts = np.where(lengths > 0, np.maximum(1, -(-(lengths - 2 * MARGIN) // stride)), 0)
        doc = np.repeat(np.arange(len(lengths)), counts)
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts, ends = offsets[doc] + nth * stride, np.minimum(offsets[doc] + nth * stride + WINDOW, offsets[doc + 1])
        tags = np.zeros(len(codes), np.int8)
        order = np.argsort(starts - ends, kind="stable")
        for at in range(0, len(order), LANES):
            own = order[at : at + LANES]
            a, b = starts[own], ends[own]
            place = a[None, :] + np.arange(int((b - a).max()))[:, None]
            x = np.where(place < b[None, :], codes[np.minimum(place, len(codes) - 1)], np.uint8(PAD))
            emit = self.emissions(x)
            seek = np.flatnonzero(~self.surely_outside(emit))
            if not len(seek):
                continue
            found = self.viterbi(emit[:, :, seek])
            for j, w in enumerate(own[seek].tolist()):
                lo = starts[w] + (MARGIN if nth[w] else 0)
                hi = ends[w] - (MARGIN if ends[w] < offsets[doc[w] + 1] else 0)
                tags[lo:hi] = found[lo - starts[w] : hi - starts[w], j]
        change = np.zeros(len(codes) + 1, bool)
        change[1:-1] = tags[1:] != tags[:-1]
        change[offsets] = True
        edges = np.flatnonzero(change)
        return [(int(tags[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True) if tags[a]] if tags.any() else []


@functools.lru_cache(maxsize=4)
def trained_tagger(units: int = UNITS, steps: int = 1000) -> Tagger:
    """The tagger, trained once per process from generated spans with fixed seeds."""
    return Tagger(units).fit(steps)


_AT = re.compile(r"@|\bat\b|\(at\)|\[at\]")


def plausible(kind: str, text: str) -> bool:
    """Whether a tagged span may be what its tag says."""
    digits = sum(c.isdigit() for c in text)
    if kind == "email":
        return bool(m := _AT.search(text)) and m.start() > 0 and ("." in text[m.end() :] or "dot" in text[m.end() :])
    if kind == "ip":
        parts = re.split(r"\D+", text)
        return len(parts) == 4 and all(0 < len(p) <= 3 and int(p) <= 255 for p in parts) and text.count(".") == 3
    if kind == "card":
        return 13 <= digits <= 19 and luhn("".join(c for c in text if c.isdigit())) and all(c in "0123456789 -." for c in text)
    return 9 <= digits <= 15 and all(c in "0123456789 -.()+" for c in text)


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A tagged run without white space at its edges and marks at its end."""
    while a < b and text[a].isspace():
        a += 1
    while a < b and (text[b - 1].isspace() or text[b - 1] in ".,;:"):
        b -= 1
    return a, b


def reconcile(base: list[tuple[str, int, int]], tagged: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """All pattern spans, and those tagged ones that overlap none of them; by kind, then start."""
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
    out = list(base)
    for kind, a, b in tagged:
        before = bisect.bisect_left(starts, b)
        if not before or reach[before - 1] <= a:
            out.append((kind, a, b))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def spans_of(texts: list[str | None], tagger: Tagger) -> Iterator[tuple[list, list]]:
    """(pattern spans, all spans) of each text."""
    for lo, hi in groups_by_size(texts):
        own = [t or "" for t in texts[lo:hi]]
        coded = [classes_of(t) for t in own]
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
        tagged: list[list] = [[] for _ in own]
        for tag, a, b in tagger.tags(np.concatenate(coded), offsets):
            i = int(np.searchsorted(offsets, a, "right")) - 1
            a, b = trimmed(own[i], a - int(offsets[i]), b - int(offsets[i]))
            if a < b and plausible(KINDS[tag - 1], own[i][a:b]):
                tagged[i].append((KINDS[tag - 1], a, b))
        for t, more in zip(own, tagged, strict=True):
            base = base_spans(t)
            yield base, reconcile(base, more)


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of pattern spans), base_sha256, spans, n_added for every row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    tagger = trained_tagger()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            sha, joined, added = [], [], []
            for at in range(0, batch.num_rows, 512):
                for base, all_ in spans_of(batch.column(1).slice(at, 512).to_pylist(), tagger):
                    for c, k in zip(counts, KINDS, strict=True):
                        c.append(sum(s[0] == k for s in base))
                    sha.append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                    joined.append(join_spans(all_))
                    added.append(len(all_) - len(base))
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(joined, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])
        give_back()

    typed = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {typed}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask_pii(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with every span in ``column`` replaced by its kind in angle brackets; null texts stay null."""
    ship(docs.sparkSession)
    tagger = trained_tagger()
    place = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(place).to_pylist()
                out = [masked(text, spans) if spans else text for text, (_, spans) in zip(texts, spans_of(texts, tagger), strict=True)]
                yield batch.set_column(place, batch.schema.field(place), pa.array(out, batch.schema.field(place).type))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with spans replaced; where spans overlap, the one that begins first names the stretch and the rest goes with it."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
