"""Parsing, tokens, vectors, the engine, incremental ingest and the command line over inline sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.__main__ import main
from kindred.config import EngineConfig, LshConfig
from kindred.engine import CloneEngine
from kindred.functions import scalars as S
from kindred.functions.hyperplanes import plane_quality, planes, srp_hashes, srp_margins
from kindred.functions.tokenizer import split_identifier, tokenize
from kindred.operators import clusters as C, embed as E, index as I, search as Q
from kindred.operators.components import components
from kindred.sources import files as files_
from kindred.streaming import ingest

ADD = "export function addAll(items: number[]) {\n  let total = 0;\n  for (const item of items) {\n    total += item;\n  }\n  return total;\n}\n"
OTHER = "class Stack {\n  push(x) { this.items.push(x); }\n  pop() { return this.items.pop(); }\n}\n"
PY = "def load(path):\n    with open(path) as f:\n        return f.read()\n\n\n@decorated\nclass Reader:\n    def go(self):\n        return load('x')\n"


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a.ts", ADD), ("b/a2.ts", ADD), ("c.ts", OTHER), ("d.py", PY), ("empty.py", ""), ("none.go", None)]
    return spark.createDataFrame(rows, "path string, content string").withColumn("language", S.language_of(F.col("path"), "typescript"))


@pytest.fixture(scope="module")
def engine(spark, files):
    e = CloneEngine(spark, EngineConfig().merged({"parser": {"min_tokens": 3}, "lsh": {"dimension": 64}}))
    e.index_files(files)
    return e


def test_line_blocks():
    got = [(b["block_type"], b["name"], b["start_line"], b["end_line"]) for b in files_.line_blocks(ADD + OTHER, "typescript")]
    assert got == [("function", "addAll", 1, 7), ("class", "Stack", 8, 11)]
    got = [(b["block_type"], b["name"], b["start_line"]) for b in files_.line_blocks(PY, "python")]
    assert got == [("function", "load", 1), ("class", "Reader", 7)]
    assert list(files_.line_blocks("function f() {}", "typescript")) == []
    assert [b["name"] for b in files_.line_blocks("func (s *S) Run(x int) int {\n  return x + 1\n}\ntype T struct {\n  a, b, c int64\n}", "go")] == ["Run", "T"]


@pytest.mark.parametrize(
    ("language", "line", "want"),
    [
        ("typescript", "export default async function load(x) {", ("load", "function")),
        ("typescript", "function* steps() {", ("steps", "function")),
        ("typescript", "export const run = async (x: number) => {", ("run", "function")),
        ("typescript", "  private static async fetchAll(x) {", ("fetchAll", "method")),
        ("typescript", "  size(): number {", ("size", "method")),
        ("typescript", "if (x) {", None),
        ("typescript", "return go(x);", None),
        ("typescript", "run(x);", None),
        ("typescript", "interface Shape {", ("Shape", "interface")),
        ("typescript", "const limit = 5;", None),
        ("python", "async def fetch(x):", ("fetch", "function")),
        ("python", "value = call(x)", None),
        ("java", "public static int size(List<String> x) {", ("size", "method")),
        ("java", "abstract class Base {", ("Base", "class")),
        ("go", "func (s *Set) Has(x int) bool {", ("Has", "function")),
        ("go", "type Row struct {", ("Row", "struct")),
        ("go", "type Id int", None),
        ("rust", "pub(crate) async fn run<T>(x: T) {", ("run", "function")),
        ("rust", "impl<T> Set<T> {", ("Set", "impl")),
        ("c", "static int add(int a, int b) {", ("add", "function")),
        ("c", "struct node {", ("node", "struct")),
        ("c", "add(a, b);", None),
    ],
)
def test_openings(language, line, want):
    assert files_.opening(line, files_.GRAMMARS[language]) == want


def test_braces_in_strings_and_comments_do_not_count():
    code = "function open() {\n  const a = '}}}'; // }\n  /* } */ return `}\n}`;\n}\nfunction after() {\n  return '{';\n}\n"
    assert [(b["name"], b["start_line"], b["end_line"]) for b in files_.line_blocks(code, "typescript")] == [("open", 1, 5), ("after", 6, 8)]
    text = 'def f():\n    """\nnot a block\n    """\n    return 1\n\ndef g():\n    return "#"\n'
    assert [(b["name"], b["start_line"]) for b in files_.line_blocks(text, "python")] == [("f", 1), ("g", 7)]


def test_sizes_and_durations(spark):
    sizes = spark.createDataFrame([(0,), (512,), (1024,), (1280,), (3 * 1024**4,)], "n long").select(S.format_bytes(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["0 B", "512.0 B", "1.0 KB", "1.3 KB", "3.0 TB"]
    took = spark.createDataFrame([(12.34,), (1500.0,), (90000.0,), (5400000.0,)], "ms double").select(S.format_duration(F.col("ms"))).collect()
    assert [r[0] for r in took] == ["12.3ms", "1.50s", "1.5min", "1.5h"]


def test_scored_probes_take_the_nearest_bits(spark):
    config = LshConfig(tables=2, bits=5, dimension=8, probes=2, scored_probes=True)
    x = np.random.default_rng(4).standard_normal((6, 8))
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "query_id long, embedding array<double>")
    got = {(r.query_id, r.tbl, r.hash) for r in I.probe_rows(rows, config).collect()}
    want = set()
    for i, v in enumerate(x):
        for t, p in enumerate(planes(config)):
            m = p.astype(float) @ v
            h = sum(1 << b for b in range(5) if m[b] >= 0)
            want |= {(i, t, h)} | {(i, t, h ^ (1 << int(b))) for b in np.argsort(np.abs(m))[:2]}
    assert got == want


def test_syntax_blocks_and_errors(files):
    rows = files_.parse_files(files.union(files.sparkSession.createDataFrame([("e.py", "def (", "python")], files.schema)), "syntax")
    assert [r.path for r in files_.parse_errors(rows).collect()] == ["e.py"]
    got = {(r.path, r.block_type, r.start_line) for r in rows.where("error is null").collect()}
    assert ("d.py", "function", 6) in got


def test_tokens():
    assert tokenize("let fooBarBaz = 'text here' + 12; // Some Words") == [("let", "keyword"), ("foo", "identifier"), ("bar", "identifier"), ("baz", "identifier"), ("=", "operator"), ("STRING_LITERAL", "string"), ("+", "operator"), ("NUMBER", "number"), (";", "punctuation"), ("some", "comment"), ("words", "comment")]
    assert split_identifier("XMLParser") == ["XML", "Parser"] and split_identifier("snake_case") == ["snake", "case"] and split_identifier("fooB") == ["fooB"]
    assert tokenize("") == tokenize(None) == []


def test_content_hash_folds_signs(spark):
    def reference(s):
        h = 0
        for u in np.frombuffer(s.encode("utf-16-le"), "<u2").tolist():
            h = (h * 31 + u) & 0xFFFFFFFF
        return f"{abs(h - (1 << 32) if h >= 1 << 31 else h):08x}"

    texts = ["", "a", "hello world", "é ü", "emoji \U0001f600 here", "x" * 200]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.content_hash(F.col("t")).alias("h")).collect()
    assert all(r.h == reference(r.t) for r in rows)


def test_globs(spark):
    assert S.glob_regex("**/*.ts") == "^.*/[^/]*\\.ts$"
    paths = spark.createDataFrame([("src/a.ts",), ("a.ts",), ("node_modules/x/a.ts",)], "p string")
    assert [r.p for r in paths.where(S.matches_globs(F.col("p"), ("**/*.ts",), ("node_modules/**",))).collect()] == ["src/a.ts"]


def test_planes_and_hashes(spark):
    config = LshConfig(tables=3, bits=5, dimension=8, orthogonal=True)
    normals = planes(config)
    assert np.allclose(normals[0] @ normals[0].T, np.eye(5), atol=1e-6)
    v = np.random.default_rng(1).standard_normal((20, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id int, v array<double>")
    got = {r.id: r.h for r in df.select("id", srp_hashes(F.col("v"), normals).alias("h")).collect()}
    for i in range(20):
        assert got[i] == [sum(int(v[i] @ normals[t, b] >= 0) << b for b in range(5)) for t in range(3)]
    scored = df.select(S.scored_probes(F.element_at(srp_hashes(F.col("v"), normals), 1), srp_margins(F.col("v"), normals, 0), 5, 4).alias("p"), F.element_at(srp_hashes(F.col("v"), normals), 1).alias("h")).collect()
    assert all(len(r.p) == 4 and r.p[0].hash == r.h and r.p[0].score == 1.0 and [x.score for x in r.p] == sorted((x.score for x in r.p), reverse=True) for r in scored)
    with pytest.raises(ValueError):
        planes(LshConfig(bits=9, dimension=8, orthogonal=True))
    assert S.probe_masks(3, 5) == [0, 1, 2, 4, 3, 5]


def test_engine_finds_copies(engine):
    found = engine.query(ADD, k=5, min_similarity=0.5).collect()
    assert [r.block_id for r in found[:2]] == ["a.ts:1-7", "b/a2.ts:1-7"] and found[0].clone_type == "type-1"
    assert [r.block_id for r in engine.find_similar("a.ts:1-7", 5, 0.9).collect()] == ["b/a2.ts:1-7"]
    assert engine.find_similar("nothing").count() == 0
    clusters, _ = engine.clusters(0.9)
    assert [(r.cluster_id, r.size, r.clone_type) for r in clusters.collect()] == [("a.ts:1-7", 2, "type-1")]
    row = engine.summary().first()
    assert (row.clone_pairs, row.clusters) == (1, 1) and "typescript" in row.languages
    assert engine.has_block("c.ts:1-4") and engine.get_block("c.ts:1-4").first().name == "Stack"


def test_save_load_remove(engine, spark, tmp_path):
    engine.save(str(tmp_path))
    other = CloneEngine(spark, engine.config).load(str(tmp_path))
    assert [tuple(r) for r in other.query(ADD, k=5, min_similarity=0.5).collect()] == [tuple(r) for r in engine.query(ADD, k=5, min_similarity=0.5).collect()]
    n = other.size()
    other.remove_block("a.ts:1-7")
    assert other.size() == n - 1 and not other.has_block("a.ts:1-7")
    other.remove_file("d.py")
    assert all(r.file_path != "d.py" for r in other.all_blocks().collect())
    other.clear()
    assert other.size() == 0


def test_mock_model_and_empty_index(spark, files):
    e = CloneEngine(spark, EngineConfig().merged({"embedding": {"model": "mock"}, "lsh": {"dimension": 32}, "parser": {"min_tokens": 3}}))
    e.index_files(files)
    assert {r.source_id for r in e.clone_pairs(0.99).collect()} == {"a.ts:1-7", "b/a2.ts:1-7"}
    e.index_files(files.where("false"))
    assert e.size() == 0 and e.query(ADD).count() == 0 and e.clone_pairs().count() == 0


def test_projection_gives_unit_vectors_and_equal_texts_equal_ones(spark):
    tokens = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["c", "d"]), (3, ["a", "b", "c"])], "block_id int, keys array<string>")
    got = {r.block_id: np.array(r.embedding) for r in E.embed(tokens, 16).collect()}
    assert np.allclose([np.linalg.norm(v) for v in got.values()], 1, atol=1e-6) and (got[1] == got[3]).all() and (got[1] != got[2]).any()
    assert {r.block_id for r in E.embed(tokens, 16, idf="online").collect()} == {1, 2, 3}


def test_index_never_invents_pairs_and_recalls_close_ones(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 24))
    rows = [(i, [float(x) for x in base[i % 40] + rng.standard_normal(24) * 0.05]) for i in range(160)]
    v = {i: np.array(x) / np.linalg.norm(x) for i, x in rows}
    index = I.CloneIndex.build(spark.createDataFrame(rows, "block_id int, embedding array<double>"), LshConfig(tables=12, bits=8, dimension=24))
    found = {(r.source_id, r.target_id) for r in Q.clone_pairs(index, 0.9, None).collect()}
    want = {(a, b) for a in v for b in v if a != b and v[a] @ v[b] >= 0.9}
    assert found <= want and len(found) >= 0.95 * len(want)


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2)) if a != b] + [(i, i + 1) for i in range(1000, 1100)]
    at = {}

    def find(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        at[hi] = lo
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in at}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_streamed_index_equals_batch(spark, tmp_path):
    config = LshConfig(tables=4, bits=4, dimension=4)
    schema = "block_id int, embedding array<double>"
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(30)]
    spark.createDataFrame(rows[:15], schema).write.parquet(f"{tmp_path}/in/one")
    stream = lambda: ingest.stream_vectors(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/cp", config).awaitTermination()
    stream()
    spark.createDataFrame(rows[15:], schema).write.parquet(f"{tmp_path}/in/two")
    stream()
    batch = I.CloneIndex.build(spark.createDataFrame(rows, schema), config)
    key = lambda b: sorted((r.tbl, r.hash, r.block_id) for r in b.collect())
    assert key(ingest.load_streamed(spark, f"{tmp_path}/out", config).buckets) == key(batch.buckets)


def test_ledger(spark, files, tmp_path):
    ledger = files_.read_ledger(spark, f"{tmp_path}/none")
    assert files_.changed_files(files.na.fill(""), ledger).count() == files.count()


def test_command_line(spark, tmp_path, capsys):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.ts").write_text(ADD)
    (src / "b.ts").write_text(ADD)
    assert main(["scan", str(src), "--output", str(tmp_path / "idx")]) == 0
    assert main(["query", str(tmp_path / "idx"), "--code", ADD, "--format", "compact", "--threshold", "0.5"]) == 0
    assert "type-1" in capsys.readouterr().out
    assert main(["report", str(tmp_path / "idx"), "--format", "markdown", "--max-pairs", "0"]) == 1
    assert main(["stats", str(tmp_path / "idx")]) == 0


def test_optional_parts_are_optional(monkeypatch):
    import sys

    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names
    monkeypatch.setitem(sys.modules, "kindred.llm", None)
    for name in [m for m in sys.modules if m.startswith("kindred.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    import __spark_entry__ as again

    left = set(again.queries())
    assert left and not any(n.startswith("op") or n == "pipeline" for n in left)


def test_clusters_take_all_partners(spark):
    shared = [f"name{i}" for i in range(40)]
    one, two = (" ".join([*shared, *(f"{c}{i}" for i in range(6))]) for c in ("left", "right"))
    rows = [(f"{c}{i:02d}", text, "typescript", "f") for c, text in (("a", one), ("b", two)) for i in range(60)]
    e = CloneEngine(spark, EngineConfig().merged({"lsh": {"dimension": 64, "bits": 2}}))
    e.index_blocks(spark.createDataFrame(rows, "block_id string, content string, language string, file_path string"))
    between = e.clone_pairs(0.5, None).where("left(source_id, 1) <> left(target_id, 1)").agg(F.min("similarity")).first()[0]
    assert 0.5 < between < 0.99
    clusters, _ = e.clusters(0.5)
    assert [(r.cluster_id, r.size) for r in clusters.collect()] == [("a00", 120)]


def test_plane_quality_of_one_plane_and_of_orthogonal_ones():
    assert plane_quality(planes(LshConfig(tables=2, bits=1, dimension=8))) == [(0, 0.0, 0.0, 1.0, True), (1, 0.0, 0.0, 1.0, True)]
    for _, mean, most, diversity, orthogonal in plane_quality(planes(LshConfig(tables=2, bits=8, dimension=8, orthogonal=True))):
        assert most < 1e-6 and diversity == 1.0 - mean and orthogonal
    assert not plane_quality(planes(LshConfig(tables=1, bits=16, dimension=8)))[0][4]


def test_occupancy_and_fill_of_buckets(spark):
    config = LshConfig(tables=2, bits=2, dimension=2, bucket_rows=2)
    v = spark.createDataFrame([(i, [1.0, 0.5]) for i in range(5)], "block_id long, embedding array<double>")
    index = I.CloneIndex.build(v, config)
    assert index.occupancy().first().asDict() == {"total_buckets": 2, "load_factor": 5.0, "avg_bucket_size": 5.0}
    assert index.clear().occupancy().first().asDict() == {"total_buckets": 0, "load_factor": 0.0, "avg_bucket_size": 0.0}
    assert sorted((r.tbl, r.primary_rows, r.overflow_rows) for r in I.bucket_fill(index.buckets, config).collect()) == [(0, 2, 3), (1, 2, 3)]


def test_clones_at_places(spark):
    blocks = spark.createDataFrame([(1, "a", 1, 9), (2, "a", 1, 9), (3, "a", 10, 12), (4, "b", 1, 9)], "block_id long, file_path string, start_line int, end_line int")
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 4)], "cluster_id long, block_id long")
    assert {tuple(r) for r in C.clones_at(members, blocks).collect()} == {("a", 1, 9, 2), ("b", 1, 9, 1)}
