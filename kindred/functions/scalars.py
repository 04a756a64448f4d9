"""Column functions over code and text blocks, vectors, hashes and paths: built-in expressions only."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from kindred.config import CLONE_BANDS, CLONE_NAMES, EXTENSION_LANGUAGE

#: White space as script engines see it: wider than Java's \s.
SPACE = r"[\t\n\x0B\f\r    -     　﻿]"


def trim_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+\\z", "")


def normalize_code(text: Column) -> Column:
    """Trimmed, line comments then block comments removed, white space collapsed."""
    bare = F.regexp_replace(trim_space(text), r"//[^\n\r  ]*", "")
    return trim_space(F.regexp_replace(F.regexp_replace(bare, r"(?s)/\*.*?\*/", ""), f"{SPACE}+", " "))


def token_count(normalized: Column) -> Column:
    return F.size(F.filter(F.split(normalized, f"{SPACE}+"), lambda x: x != "")).cast("int")


def polynomial_hashes(texts: pd.Series) -> pd.Series:
    """The 31-polynomial hash of each text's UTF-16 units as an unsigned 32-bit number: units times powers of 31, a batch of texts at a time."""
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    lengths = np.array([len(u) for u in units], np.int64)
    longest = int(lengths.max()) if len(lengths) else 0
    if len(_powers[0]) < longest:
        grown = np.full(max(longest, 2 * len(_powers[0])), 31, np.uint32)
        grown[:1] = 1
        _powers[0] = np.multiply.accumulate(grown)
    return pd.Series([int((u * _powers[0][n - 1 :: -1][:n]).sum(dtype=np.uint32)) if n else 0 for u, n in zip(units, lengths.tolist(), strict=True)], dtype="int64")


_powers = [np.multiply.accumulate(np.array([1] + [31] * 4095, np.uint32))]


def _polynomial(text: Column) -> Column:
    """The 31-polynomial hash of a string's UTF-16 units as an unsigned 32-bit number, one Arrow batch at a time."""

    @F.pandas_udf("bigint")
    def hashes(texts: pd.Series) -> pd.Series:
        known = texts.notna()
        out = pd.Series([None] * len(texts), index=texts.index, dtype="Int64")
        if known.any():
            out[known] = polynomial_hashes(texts[known]).to_numpy()
        return out

    return hashes(text)


def _polynomial_sql(text: Column) -> Column:
    """The same in built-in functions only: slower by far on long texts."""
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    pairs = F.flatten(F.transform(units, lambda u: F.when(u < 65536, F.array(u)).otherwise(F.array(F.floor((u - 65536) / 1024) + 55296, F.pmod(u - 65536, F.lit(1024)) + 56320))))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, u: (a * 31 + u).bitwiseAND(F.lit(4294967295)))


def _hex8(number: Column) -> Column:
    return F.lpad(F.lower(F.hex(number)), 8, "0")


def content_hash(text: Column) -> Column:
    """Eight hexadecimal digits of the absolute value of the signed 32-bit polynomial hash."""
    h = _polynomial(text)
    return _hex8(F.when(h >= 2147483648, 4294967296 - h).otherwise(h))


def string_hash(text: Column) -> Column:
    return _polynomial(text)


def string_hash_hex(text: Column) -> Column:
    return _hex8(_polynomial(text))


def block_id(path: Column, start: Column, end: Column) -> Column:
    return F.concat(F.replace(path, F.lit("\\"), F.lit("/")), F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def split_identifier(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("_")), F.split(name, "_")).otherwise(F.split(name, "(?<=.)(?=[A-Z][a-z])"))


def ngrams(keys: Column, n: int = 2) -> Column:
    """Joined runs of n neighbouring keys; none if there are fewer."""
    return F.when(F.size(keys) >= n, F.transform(F.sequence(F.lit(1), F.size(keys) - (n - 1)), lambda i: F.array_join(F.slice(keys, i, n), "|"))).otherwise(F.array().cast("array<string>"))


def tf_weight(tf: Column) -> Column:
    return 1 + F.log(tf.cast("double"))


def idf_smooth(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def idf_plain(n: Column, df: Column) -> Column:
    return F.log(n / df) + 1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def l2_normalize(v: Column) -> Column:
    return F.when(norm(v) > 0, F.transform(v, lambda x: x.cast("double") / norm(v))).otherwise(F.transform(v, lambda x: x.cast("double")))


def euclidean_similarity(a: Column, b: Column) -> Column:
    return 1 / (1 + F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)))


def ensemble(vectors: list[Column], how: str = "average", weights: list[float] | None = None) -> Column:
    """One vector from several: their mean, weighted sum or element-wise maximum."""
    if how == "max":
        out = vectors[0]
        for v in vectors[1:]:
            out = F.zip_with(out, v, lambda x, y: F.greatest(x, y))
        return out
    weights = [1.0 / len(vectors)] * len(vectors) if how == "average" else [w / sum(weights) for w in weights]
    out = F.transform(vectors[0], lambda x: x * F.lit(weights[0]))
    for v, w in zip(vectors[1:], weights[1:], strict=True):
        out = _plus(out, v, w)
    return out


def _plus(a: Column, b: Column, weight: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * F.lit(weight))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine_from_hamming(distance: Column, bits: int) -> Column:
    return F.cos(F.lit(math.pi) * distance / bits)


def collision_probability(similarity: Column, tables: int, bits: int) -> Column:
    """Chance that two vectors of this cosine meet in at least one table."""
    return 1 - F.pow(1 - F.pow(1 - F.acos(similarity) / math.pi, F.lit(bits)), F.lit(tables))


def probe_masks(bits: int, probes: int) -> list[int]:
    """XOR masks of the buckets to look into: none, then single bits from the lowest, then pairs once all single bits are used."""
    single = [1 << i for i in range(bits)]
    pairs = [a | b for i, a in enumerate(single) for b in single[i + 1 :]]
    return [0, *single, *pairs][: max(0, probes) + 1]


def probes(h: Column, bits: int, count: int) -> Column:
    return F.array(*[h.bitwiseXOR(F.lit(m).cast("long")) for m in probe_masks(bits, count)])


def scored_probes(h: Column, margins: Column, bits: int, count: int) -> Column:
    """The ``count`` best (hash, score) by e^-distance over flips of one bit, and of two once single flips don't suffice; the hash itself scores 1."""
    if count <= 0:
        return F.array().cast("array<struct<hash:bigint,score:double>>")
    entry = lambda mask, distance: F.struct(h.bitwiseXOR(F.lit(mask).cast("long")).alias("hash"), F.exp(-distance).alias("score"))
    at = lambda i: F.abs(F.element_at(margins, i + 1))
    found = [entry(0, F.lit(0.0))] + [entry(1 << i, at(i)) for i in range(bits)]
    if count > bits + 1:
        found += [entry((1 << i) | (1 << j), at(i) + at(j)) for i in range(bits) for j in range(i + 1, bits)]
    order = lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).when(x["hash"] < y["hash"], -1).when(x["hash"] > y["hash"], 1).otherwise(0)
    return F.slice(F.array_sort(F.array(*found), order), 1, count)


def clone_type(similarity: Column) -> Column:
    out = F
    for least, name in CLONE_BANDS:
        out = out.when(similarity >= least, name)
    return out.otherwise("type-4")


def pair_clone_type(similarity: Column, hash_a: Column, hash_b: Column) -> Column:
    return F.when(hash_a == hash_b, "type-1").otherwise(clone_type(similarity))


def clone_type_name(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CLONE_NAMES.items() for x in kv]), kind)


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a glob: ** crosses folders, * and ? stay within a name (? is any one character)."""
    out = []
    for part in re.findall(r"\*\*|\*|\?|[^*?]+", glob):
        out.append({"**": ".*", "*": "[^/]*", "?": "."}.get(part) or re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", part))
    return "^" + "".join(out) + "$"


def matches_globs(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    ok = F.lit(True)
    if include:
        ok = path.rlike("|".join(map(glob_regex, include)))
    return ok & ~path.rlike("|".join(map(glob_regex, exclude))) if exclude else ok


def extension(path: Column) -> Column:
    """The last dot and what follows it; empty without a dot."""
    return F.regexp_extract(path, r"(\.[^./\\]*)$", 1)


def language_of(path: Column, default: str | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EXTENSION_LANGUAGE.items() for x in kv])
    found = F.try_element_at(table, extension(path))
    return F.coalesce(found, F.lit(default)) if default else found


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def relative_path(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def truncate_path(path: Column, most: int = 40) -> Column:
    return F.when(F.length(path) > most, F.concat(F.lit("..."), F.right(path, F.lit(most - 3)))).otherwise(path)


def format_bytes(n: Column) -> Column:
    """One decimal and the largest unit up to TB that leaves 1 or more; 0 has no decimal."""
    out = F.when(n == 0, "0 B")
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        out = out.when(n >= 1024**power, F.format_string(f"%.1f {unit}", n / float(1024**power)))
    return out.otherwise(F.format_string("%.1f B", n.cast("double")))


def format_percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def format_duration(ms: Column) -> Column:
    ms = ms.cast("double")
    return (
        F.when(ms < 1000, F.format_string("%.1fms", ms))
        .when(ms < 60000, F.format_string("%.2fs", ms / 1000))
        .when(ms < 3600000, F.format_string("%.1fmin", ms / 60000))
        .otherwise(F.format_string("%.1fh", ms / 3600000))
    )


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def chunk(items: Column, size: int) -> Column:
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(1), F.size(items), F.lit(size)), lambda i: F.slice(items, i, size))).otherwise(F.array())


def shared_tokens(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(F.split(a, " "), F.split(b, " ")))
