"""Pairs by blocks against brute force, and that no pair is shuffled before it counts."""

import math

import duckdb
import numpy as np
import pytest

from kindred.config import LshConfig
from kindred.functions import scalars as S
from kindred.functions.hyperplanes import planes, srp_hashes
from kindred.operators import clusters as C, index as I, pairs as P, search as Q
from kindred.plans import queries
from kindred.session import cut, numbered

SF = "/root/testdata/sf0.001"
SMALL = LshConfig(tables=20, bits=6, dimension=16)


@pytest.fixture(scope="module")
def rows():
    """Clustered vectors, 60 copies of one, zero ones, and some of another length, with null components, or null."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    v = [(base[k % 40] + 0.6 * rng.standard_normal(16)).astype(np.float32).tolist() for k in range(300)]
    v += [v[0]] * 60 + [[0.0] * 16] * 2 + [[1.0, 2.0]] * 2
    return [(int(i), x) for i, x in zip(rng.permutation(len(v)) * 7, v, strict=True)] + [(-1, None), (-2, [None] + v[0][1:]), (None, v[0])]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "block_id long, embedding array<float>").repartition(5)


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):  # sum() would compensate
        total += x * y
    return total


def cosine(a, b):
    size = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
    return dot(a, b) / size if size > 0 else 0.0


@pytest.fixture(params=(8192, 50))
def blocks(request, monkeypatch):
    monkeypatch.setattr(P, "MOST", request.param)


def brute(rows, least):
    ok = sorted((i, x) for i, x in rows if i is not None and i >= 0)
    return {(i, j): s for n, (i, x) in enumerate(ok) for j, y in ok[n + 1 :] if len(x) == len(y) and (s := cosine(x, y)) >= least}


def test_cosine_pairs(spark, rows, table, blocks):
    got = P.block_pairs(table, 0.4).collect()
    assert {(r.source_id, r.target_id): r.similarity for r in got} == brute(rows, 0.4)
    assert len(got) == len(brute(rows, 0.4))


def test_string_ids(spark, rows, table, blocks):
    named = table.selectExpr("concat('b', block_id) AS block_id", "embedding")
    got = {(r.source_id, r.target_id) for r in P.block_pairs(named, 0.7).collect()}
    assert got == {tuple(sorted((f"b{i}", f"b{j}"))) for i, j in brute(rows, 0.7)}


@pytest.mark.parametrize("least", (1, 4, 6, 20))
def test_table_matches(spark, table, blocks, least):
    full = table.where("block_id >= 0 AND size(embedding) = 16")
    hashed = full.withColumn("hashes", srp_hashes(full.embedding, planes(SMALL)))
    masks = S.probe_masks(6, 3)
    h = {r.block_id: np.array(r.hashes) for r in hashed.collect()}
    want = {(i, j): n for i in h for j in h if i < j and (n := int(np.isin(h[i] ^ h[j], masks).sum())) >= least}
    assert {(r.source_id, r.target_id): r.table_matches for r in P.block_pairs(hashed, None, least, masks).collect()} == want


def test_first_per_source(spark, table, blocks):
    full = table.where("block_id >= 0 AND size(embedding) = 16")
    index = I.CloneIndex.build(full, SMALL)
    every = sorted(Q.clone_pairs(index, 0.2, None, 0.2).collect(), key=lambda r: (r.source_id, -r.similarity, r.target_id))
    want, last, n = [], None, 0
    for r in every:
        n = n + 1 if r.source_id == last else 1
        last = r.source_id
        if n <= 3:
            want.append(tuple(r))
    assert sorted(map(tuple, Q.clone_pairs(index, 0.2, 3, 0.2).collect())) == sorted(want)
    count = P.block_pairs(index.vectors, 0.2, 4, S.probe_masks(6, 3), 3).count()
    n = index.vectors.count()
    assert count <= 3 * n * (math.ceil(n / P.MOST) + 2)  # of 60 copies most pairs never leave a task


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pair_is_shuffled(spark):
    assert "Exchange" not in plan(queries.QUERIES["d04_table_match_filter"](spark, SF))
    assert "Exchange" not in plan(queries.QUERIES["e07_lsh_self_join"](spark, SF))
    assert "Join" not in plan(queries.QUERIES["g06_topk_per_source"](spark, SF))


def test_brute_force_by_blocks(spark):
    for name in ("f16_report", "m05_clusters", "c25_cosine_pairs"):
        assert "zip_with" not in plan(queries.QUERIES[name](spark, SF)) and "NestedLoop" not in plan(queries.QUERIES[name](spark, SF)), name


def test_numbered(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("id", "id % 13 AS k")
    got = numbered(rows, "k", "id").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.row)] == sorted(range(5000), key=lambda i: (i % 13, i))
    assert sorted(r.row for r in got) == list(range(1, 5001))
    assert "SinglePartition" not in plan(queries.QUERIES["h07_report_rows"](spark, SF)).split("Broadcast")[0]


def test_clusters_compare_pairs_once(monkeypatch, spark):
    calls = []
    monkeypatch.setattr(queries, "block_pairs", lambda *a: calls.append(1) or P.block_pairs(*a))
    assert queries.QUERIES["m05_clusters"](spark, SF).count() and calls == [1]


def test_clusters_of_copies_write_no_pairs(spark, rows, table, blocks, monkeypatch):
    # Copies of one vector and of a zero one, copies linked with nothing else, and an id that comes twice.
    more = [*rows, (5000, [9.0] + [0.0] * 15), (5001, [9.0] + [0.0] * 15), (0, rows[1][1]), (0, rows[1][1])]
    least, written = 0.7, []
    monkeypatch.setattr(C, "cut", lambda df: written.append(cut(df)) or written[-1])
    classes = C.copy_classes(spark.createDataFrame(more, table.schema).repartition(5))
    got = {r.cluster_id: r for r in C.linked_clusters(P.block_pairs(classes, least, 0, None, None, True), classes).collect()}
    ok = [(i, x) for i, x in more if i is not None and x and None not in x]
    near = [(i, j, s) for n, (i, x) in enumerate(ok) for j, y in ok[n + 1 :] if i != j and len(x) == len(y) and (s := cosine(x, y)) >= least]
    root = {i: i for p in near for i in p[:2]}
    for _ in root:
        for i, j, _ in near:
            root[i] = root[j] = min(root[i], root[j])
    assert set(got) == set(root.values())
    for k, r in got.items():
        own = [s for i, _, s in near if root[i] == k]
        assert r["size"] == list(root.values()).count(k) and r.avg_similarity == pytest.approx(sum(own) / len(own), abs=1e-9)
    assert 5000 in got and len({r["size"] for r in got.values()}) > 1
    assert written[1].count() < len(near)


def test_clusters_of_repeated_vectors_equal_their_sql(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").limit(60).cache()
    rows.unionByName(rows.withColumn("vec_id", rows.vec_id + 1_000_000)).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(queries.ORACLE_SQL["m05_clusters"]).fetchall())
    assert len(want) > 5 and sorted(map(tuple, queries.QUERIES["m05_clusters"](spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("dense", (0.0, 1 / 30, 1.0))
def test_wide_vectors_by_a_bound(spark, blocks, monkeypatch, dense):
    """As by brute force, whether the first components are taken, all, or the rest holds all or nothing."""
    monkeypatch.setattr(P, "DENSE", dense)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((20, 200))
    v = [base[k % 20] + 0.5 * rng.standard_normal(200) for k in range(120)]
    v += [np.r_[np.zeros(P.HEAD), x[P.HEAD :]] for x in v[:10]] + [np.r_[x[: P.HEAD], np.zeros(200 - P.HEAD)] for x in v[:10]] + [np.zeros(200)] * 2
    wide = [(k, x.astype(np.float32).tolist()) for k, x in enumerate(v)]
    got = P.block_pairs(spark.createDataFrame(wide, "block_id long, embedding array<float>"), 0.75).collect()
    want = brute(wide, 0.75)
    assert {(r.source_id, r.target_id): r.similarity for r in got} == want and 100 < len(want) < 5000
