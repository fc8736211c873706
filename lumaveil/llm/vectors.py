"""Vectors as the two operators on embeddings see them: valid ones in double precision, packed into blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_valid(v: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & (squares(v) > 0), F.lit(False))


def squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def valid(table: DataFrame) -> DataFrame:
    """vec_id long and v array<double> of the vectors that take part; rows without a vec_id take none."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where("vec_id is not null").where(is_valid(F.col("v")))


def matrix(vectors, width: int) -> np.ndarray:
    """Rows of one width; a shorter vector counts as padded with zeros."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def blocks(rows: DataFrame, by: list[str], extra: str, width: int) -> DataFrame:
    """A row for each value of the columns `by`: ids, the column `extra` (long) and vectors as bytes."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["vec_id", extra])
        head = {b: [frame[b].iloc[0]] for b in by}
        return pd.DataFrame(head | {"ids": [frame["vec_id"].to_numpy(np.int64).tobytes()], "extra": [frame[extra].to_numpy(np.int64).tobytes()], "x": [matrix(frame["v"].tolist(), width).tobytes()]})

    schema = ", ".join([*(f"{b} int" for b in by), "ids binary", "extra binary", "x binary"])
    return rows.groupBy(*by).applyInPandas(run, schema)


def unblock(ids: bytes, extra: bytes, x: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(extra, np.int64), np.frombuffer(x, np.float64).reshape(-1, width)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, always summed alike."""
    return (a * b).sum(axis=1) / (norms(a) * norms(b))
