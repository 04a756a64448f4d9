"""Random-hyperplane hashing: seeded planes on the driver, one matrix product per Arrow batch on the executors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from kindred.config import LshConfig


def planes(config: LshConfig) -> np.ndarray:
    """(tables, bits, dimension) unit normals in single precision; table i draws from its own seed. Orthogonal within a table on request."""
    out = np.empty((config.tables, config.bits, config.dimension), np.float32)
    for t in range(config.tables):
        rng = np.random.Generator(np.random.PCG64(config.seed + 1000 * t))
        x = rng.standard_normal((config.bits, config.dimension))
        if config.orthogonal:
            if config.bits > config.dimension:
                raise ValueError("more planes than dimensions cannot be orthogonal")
            q, r = np.linalg.qr(x.T)
            x = (q * np.sign(np.diag(r))).T
        out[t] = x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def srp_hashes(vector: Column, normals: np.ndarray) -> Column:
    """ARRAY<BIGINT> of one hash per table: bit i is set where the dot product with plane i is not negative; null vectors give null."""
    tables, bits, dimension = normals.shape
    flat = normals.reshape(-1, dimension).astype(np.float64).T.copy()
    weights = (np.int64(1) << np.arange(bits)).astype(np.int64)

    @F.pandas_udf("array<bigint>")
    def hashes(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), index=v.index, dtype=object)
        ok = v.notna()
        if ok.any():
            x = np.array(v[ok].tolist(), np.float64)
            if x.shape[1] != dimension:
                raise ValueError(f"vectors of {x.shape[1]} components, planes of {dimension}")
            set_ = (x @ flat >= 0).reshape(len(x), tables, bits)
            out[ok] = pd.Series(list(set_ @ weights), index=v.index[ok])
        return out

    return hashes(vector)


def srp_margins(vector: Column, normals: np.ndarray, table: int) -> Column:
    """ARRAY<DOUBLE> of the dot products with one table's planes."""
    matrix = normals[table].astype(np.float64).T.copy()

    @F.pandas_udf("array<double>")
    def margins(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.array(v.tolist(), np.float64) @ matrix), index=v.index)

    return margins(vector)


def srp_hash_sql(vector: str, normals: np.ndarray, table: int) -> Column:
    """One table's hash in built-in functions only: slower, and checkable against any SQL engine."""
    total = F.lit(0).cast("long")
    for i, plane in enumerate(normals[table]):
        plane_ = F.array(*[F.lit(float(x)) for x in plane])
        value = F.aggregate(F.zip_with(F.col(vector), plane_, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
        total = total + F.when(value >= 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return total


#: Planes of a table count as orthogonal below this greatest |cosine|.
ORTHOGONAL = 0.1


def plane_quality(normals: np.ndarray) -> list[tuple[int, float, float, float, bool]]:
    """(table, mean and greatest |cosine| of two of its planes, diversity, orthogonal); a table of one plane has (0, 0, 1, true)."""
    out = []
    for t, own in enumerate(normals.astype(np.float64)):
        between = np.abs((own @ own.T)[np.triu_indices(len(own), 1)])
        mean, most = (float(between.mean()), float(between.max())) if len(between) else (0.0, 0.0)
        out.append((t, mean, most, 1.0 - mean, most < ORTHOGONAL))
    return out
