"""Clone reports over documents with near copies, against all pairs of the engine's vectors."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.engine import CloneEngine
from kindred.functions import terms
from kindred.functions.tokenizer import tokenize
from kindred.operators import embed as E
from kindred.operators.embed import coded_texts
from kindred.plans import queries as P

REPORTS = "f13_scan_summary f13_by_type f14_clones_by_file f15_clones_at f17_clone_ratio f18_ci_gate e10_clusters_for_file e11_star_pairs d15_report_filter".split()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    rows = []
    for group in range(14):  # one text each, and copies with 0 to 24 of its 160 words changed
        base = [f"{'abcdefgh'[group % 8]}word{w}" for w in rng.integers(0, 4000, 160)]
        for changed in ((0, 0, 1, 2), (0, 4, 8, 14, 24), (0, 0, 1, 4, 8, 14))[group % 3]:
            words = list(base)
            for k in rng.choice(160, changed, replace=False):
                words[k] = f"new{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(words), "en" if len(rows) % 2 else "de", ("c1", "c2", "src3", "d4")[len(rows) % 4]))
    rows += [(len(rows) + i, " ".join(f"only{i}x{k}" for k in range(120)), "fr", "src3") for i in range(12)]
    folder = str(tmp_path_factory.mktemp("reports"))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars")
    d.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


@pytest.fixture(scope="module")
def brute(spark, docs):
    """(members {id: cluster}, mean similarity of each cluster) by all pairs at 0.85 or more."""
    engine = CloneEngine(spark)
    engine.index_blocks(P.blocks_of(spark, docs[0]))
    got = {r.block_id: np.array(r.embedding, float) for r in engine.index.vectors.collect()}
    ids = sorted(got)
    v = np.array([got[i] / np.linalg.norm(got[i]) for i in ids])
    cosine = v @ v.T
    linked = cosine >= 0.85
    least = np.arange(len(ids))
    while (new := np.where(linked, least[None, :], len(ids)).min(axis=1)).tolist() != least.tolist():
        least = new
    sizes = Counter(least.tolist())
    members = {ids[i]: ids[least[i]] for i in range(len(ids)) if sizes[least[i]] > 1}
    off = linked & ~np.eye(len(ids), dtype=bool)
    mean = {ids[c]: cosine[(least == c)[:, None] & off].mean() for c, n in sizes.items() if n > 1}
    return members, mean


def test_reports_over_near_copies(spark, docs, brute):
    folder, rows = docs
    members, mean = brute
    got = {n: P.QUERIES[n](spark, folder).collect() for n in REPORTS}
    lang, source = {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
    size = Counter(members.values())
    pairs = sum(n - 1 for n in size.values())
    one = got["f13_scan_summary"][0]
    assert (one.files, one.blocks, one.clone_pairs, one.clusters, one.cloned_blocks) == (4, len(rows), pairs, len(size), len(members))
    kind = lambda s: "type-1" if s >= 0.99 else "type-2" if s >= 0.95 else "type-3" if s >= 0.85 else "type-4"
    blocks, clusters = Counter(), Counter()
    for c, n in size.items():
        blocks[kind(mean[c])] += n
        clusters[kind(mean[c])] += 1
    assert {(r.clone_type, r.blocks, r.clusters) for r in got["f13_by_type"]} == {(k, blocks[k], clusters[k]) for k in blocks}
    assert {(r.file_path, r.clones) for r in got["f14_clones_by_file"]} == set(Counter(source[i] for i in members).items())
    assert {(r.file_path, r.language, r.clones) for r in got["f15_clones_at"]} == {(*k, n) for k, n in Counter((source[i], lang[i]) for i in members).items()}
    percent = round(pairs / len(rows) * 100, 6)
    assert got["f17_clone_ratio"][0].percent == pytest.approx(percent, abs=1e-6)
    gate = got["f18_ci_gate"][0]
    assert (gate.clone_pairs, gate.blocks, gate.passed) == (pairs, len(rows), pairs <= 50 and percent <= 10)
    assert {(r.cluster_id, r.representative, r.block_id) for r in got["e11_star_pairs"]} == {(c, c, i) for i, c in members.items() if i != c}
    touched = {c for i, c in members.items() if source[i] == "src3"}
    assert {(r.cluster_id, r.block_id) for r in got["e10_clusters_for_file"]} == {(c, i) for i, c in members.items() if c in touched}
    assert {(r.cluster_id, r.block_id) for r in got["d15_report_filter"]} == {(c, i) for i, c in members.items() if "c1" in source[i] and lang[i] == "en"}


def test_near_copies_are_counted(spark, docs, brute):
    folder, _ = docs
    exact = P.QUERIES["f13_scan_summary_exact_copies"](spark, folder).first()
    near = P.QUERIES["f13_scan_summary"](spark, folder).first()
    assert near.clone_pairs > 3 * exact.clone_pairs > 0
    assert {r.clone_type for r in P.QUERIES["f13_by_type"](spark, folder).collect()} >= {"type-2", "type-3"}


def test_texts_are_tokenised_once_and_no_pair_is_missed(spark, docs, brute, monkeypatch):
    """Of one part read, texts go to several tasks, each different one once; the clusters need no index and are those of all pairs."""
    folder, rows = docs
    seen = []

    def spied(texts):
        chunks = coded_texts(texts)
        seen.append((texts.count(), chunks.count()))
        return chunks

    monkeypatch.setattr(E, "coded_texts", spied)
    monkeypatch.setattr(CloneEngine, "index_blocks", None)
    twice = P.blocks_of(spark, folder)
    twice = twice.unionByName(twice.withColumn("block_id", twice.block_id + 1000)).unionByName(twice.limit(1).withColumn("block_id", F.lit(None).cast("long")))
    _, members, found = CloneEngine(spark).clone_clusters(twice, written=True)
    got = {r.block_id: r.cluster_id for r in members.collect()}
    assert len(seen) == 1 and seen[0][0] == len({r[1:3] for r in rows}) and seen[0][1] > 1
    assert set(got) == {r[0] + k for r in rows for k in (0, 1000)} and all(got[i] == got[i + 1000] for i, *_ in rows)
    assert all(got[i] == c for i, c in brute[0].items())
    assert {r.cluster_id: r["size"] for r in found.collect()} == Counter(got.values())


def test_copies_count_in_frequencies(spark):
    texts = [(1, "alpha beta gamma", "en", 3), (2, "alpha delta", "en", 1), (3, "beta", "de", 2), (4, None, "en", 5)]
    coded = E.coded_texts(spark.createDataFrame(texts, "block_id long, content string, language string, copies long"))
    each = [(10 * i + k, t, g) for i, t, g, n in texts for k in range(n)]
    want = E.text_frequencies(spark.createDataFrame(each, "block_id long, content string, language string"))
    assert sorted(E.coded_frequencies(coded).collect()) == sorted(want.collect())


def test_names_are_split_as_by_the_scanner():
    for language in ("typescript", "python"):
        memo = terms._Memo(language)
        for token in ("fooBar", "HTTPServer", "a_b_cd", "class", "self", "x", "_", "$el", "ab1", "A", "12", "'s'", "// Some words", "==", "{"):
            keys = [f"{t}:{v}" for v, t in tokenize(token, language)]
            assert memo[token] == tuple(int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "little", signed=True) for k in keys), token
