"""Reading vector columns: which rows count, and their components as one block of bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding"):
    """Neither null nor empty, and without null or non-finite components."""
    values = F.col(column).cast("array<double>")
    odd = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(odd, F.lit(True))


def stacked(cells) -> np.ndarray:
    """Rows of bytes (float64 or int64 components of equal number) as a matrix."""
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), -1)


def packed(rows: DataFrame, keep: tuple[str, ...], column: str = "embedding") -> DataFrame:
    """``keep`` plus ``dim``, ``vec`` (float64 bytes) and a 128-bit fingerprint ``f1, f2`` of usable rows."""
    chosen = rows.where(usable(column)).select(*keep, F.col(column).cast("array<double>").alias("__v"))
    types = dict(chosen.dtypes)

    def run(batches):
        for pdf in batches:
            vecs = [np.asarray(v, np.float64) + 0.0 for v in pdf["__v"]]  # -0.0 becomes 0.0
            data = [v.tobytes() for v in vecs]
            marks = np.frombuffer(b"".join(hashlib.blake2b(d, digest_size=16).digest() for d in data), np.int64).reshape(-1, 2)
            out = pdf[list(keep)].copy()
            out["dim"] = [len(v) for v in vecs]
            out["vec"], out["f1"], out["f2"] = data, marks[:, 0], marks[:, 1]
            yield out

    return chosen.mapInPandas(run, ", ".join([f"`{c}` {types[c]}" for c in keep] + ["dim int, vec binary, f1 long, f2 long"]))


def runs(batches, keys: list[str]):
    """Sorted batches cut where a key changes: yields (key, frame); a key's rows may come in several frames."""
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys].reset_index(drop=True)
        starts = np.flatnonzero((k != k.shift()).any(axis=1).to_numpy())
        for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True):
            yield tuple(k.iloc[a]), pdf.iloc[a:b]


def frame(columns: dict) -> pd.DataFrame:
    return pd.DataFrame({k: np.asarray(v) for k, v in columns.items()})
