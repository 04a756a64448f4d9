"""Comparison of a registered query with its SQL in DuckDB over the same tables."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, name: str, f, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got, want = f(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns), (name, list(got.columns), list(want.columns))
    columns = sorted(got.columns)
    rows = [sorted(map(repr, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None))) for x in (got, want)]
    differing = [(a, b) for a, b in zip(*rows, strict=False) if a != b]
    assert len(rows[0]) == len(rows[1]), (name, len(rows[0]), len(rows[1]), rows[0][:1], rows[1][:1])
    assert not differing, (name, len(differing), str(differing[0])[:800])
    assert rows[0], (name, "empty")
