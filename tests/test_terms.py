"""Compact terms against rows of terms, and what the engine makes of them."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import terms as T
from kindred.functions.tokenizer import find_tokens, tokenize
from kindred.operators import embed as E
from kindred.plans import queries as P

TEXTS = [
    "const fooBar = snake_case + 'a string' // note on HTTPServer\n/* block\ncomment */ x => y ?? -1.5e3;",
    "def f(self): return 'it''s' # last",
    "the quick brown fox - the 3 quick foxes, 'unclosed and $money_bag parseXMLFile a1 b",
    "`tmpl ${x}` 0xFF--12 a/b /*open",
    "",
    None,
    "   ",
]


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [(k, t, ("typescript", "python", "en", None)[k % 4]) for k, t in enumerate(TEXTS * 3 + [f"word{k} other{k % 3} more word{k}" for k in range(40)])]
    return spark.createDataFrame(rows, "block_id long, content string, language string").repartition(3)


@pytest.mark.parametrize("language", ("typescript", "python", "c"))
def test_tokens_stand_alone(language):
    for text in TEXTS:
        assert [t for value in find_tokens(text or "") for t in tokenize(value, language)] == tokenize(text, language)


def test_numbers_as_spark_has_them(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 300)
    got = spark.createDataFrame([(int(k),) for k in keys], "k long").select("k", F.xxhash64("k").alias("h")).collect()
    assert T.xxhash64(np.array([r.k for r in got])).tolist() == [r.h for r in got]


def test_terms_count_as_rows_do(blocks):
    """As many terms, with the same counts, as keys and their bigrams written out."""
    got, want = {}, {}
    for r in E.term_rows(blocks).collect():
        got.setdefault(r.block_id, []).append(r.tf)
    for r in blocks.collect():
        keys = [f"{t}:{v}" for v, t in tokenize(r.content, r.language or "typescript")]
        if keys:
            want[r.block_id] = sorted(Counter(keys + [f"{a}|{b}" for a, b in zip(keys, keys[1:], strict=False)]).values())
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("sent", (E.SENT_TERMS, 0))
@pytest.mark.parametrize("least, most", ((1, None), (2, 20)))
def test_vectors(monkeypatch, blocks, sent, least, most):
    monkeypatch.setattr(E, "SENT_TERMS", sent)
    n = blocks.count()
    df = E.text_frequencies(blocks)
    got = {r.block_id: np.array(r.embedding) for r in E.embed_texts(blocks, 32, df, n, 2, least, most).collect()}
    often = {r.term: r.df for r in df.collect()}
    rows = np.random.Generator(np.random.PCG64(7)).standard_normal((1 << 16, 32)).astype(np.float32)
    want: dict = {}
    for r in E.term_rows(blocks).collect():
        d = often[r.term]
        w = (1 + math.log(r.tf)) * (math.log((n + 1) / (d + 1)) + 1) if d >= least and (most is None or d <= most) else 0
        slot = int(T.xxhash64(np.array([r.term]))[0]) % (1 << 16)
        want[r.block_id] = want.get(r.block_id, 0) + w * rows[slot].astype(float)
    for k, v in want.items():
        size = np.linalg.norm(v)
        assert np.allclose(got.get(k, np.zeros(32)), v / size if size else v, atol=1e-5), k


def test_no_row_of_a_block_and_term(monkeypatch, spark):
    """The reports' vectors are made without exploding texts into rows of terms."""
    monkeypatch.setattr(E, "term_rows", None)
    monkeypatch.setattr(E, "term_frequencies", None)
    assert P.QUERIES["f13_scan_summary"](spark, "/root/testdata/sf0.001").first().clusters > 0
