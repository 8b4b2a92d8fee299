"""Pooling of groups of vectors into one: (groups, idx, embedding) -> (groups, pooled), of unit length.

Sums and maxima are taken of whole vectors, in matrices: each task reduces its rows to one vector for each group and batch before the
shuffle, so that a wide vector is one value and never a row for each place. The median needs all values, and explodes vectors into
(group, place) rows. The others weigh whole vectors with one or two joins on the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vector import dot, l2_normalize, norm
from .knn import matrix, usable

#: Groups that are written together.
BATCH = 1024


def _exploded(df: DataFrame, groups: list[str], how: Callable[[Column], Column]) -> DataFrame:
    each = df.select(*groups, F.posexplode("embedding").alias("_i", "_v")).groupBy(*groups, "_i").agg(how(F.col("_v").cast("double")).alias("_v"))
    out = each.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("pooled"))
    return out.withColumn("pooled", l2_normalize(F.col("pooled")))


def _elementwise(df: DataFrame, groups: list[str], how: str, unit: bool = True) -> DataFrame:
    """``how``: mean, sum or max of each group's vectors."""
    k = len(groups)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*groups).schema)
    put = np.maximum if how == "max" else np.add

    def rows(keys: list[tuple], own: list[pa.DataType], vectors: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        flat = pa.array(np.ascontiguousarray(vectors).reshape(-1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * vectors.shape[1], pa.int32()), flat)
        return pa.RecordBatch.from_arrays([*[pa.array([x[j] for x in keys], own[j]) for j in range(k)], lists,
            pa.array(counts, pa.int64())], names=[*groups, "_v", "_n"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            number: dict[tuple, int] = {}
            at = np.array([number.setdefault(x, len(number)) for x in zip(*[c.to_pylist() for c in b.columns[:k]], strict=True)])
            m = matrix(b.column(k))
            out = np.full((len(number), m.shape[1]), -np.inf if how == "max" else 0.0)
            put.at(out, at, m)
            yield rows(list(number), [c.type for c in b.columns[:k]], out, np.bincount(at, minlength=len(number)))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group."""
        now, vector, count, own, held = None, None, 0, [], []
        put_out = lambda: rows([x[0] for x in held], own, np.stack([x[1] for x in held]), np.array([x[2] for x in held]))
        for b in batches:
            own = [c.type for c in b.columns[:k]]
            m, counts = matrix(b.column(k)), b.column(k + 1).to_pylist()
            for j, key in enumerate(zip(*[c.to_pylist() for c in b.columns[:k]], strict=True)):
                if key != now:
                    if vector is not None:
                        held.append((now, vector / count if how == "mean" else vector, count))
                    if len(held) >= BATCH:
                        yield put_out()
                        held = []
                    now, vector, count = key, m[j].copy(), counts[j]
                else:
                    if len(vector) != m.shape[1]:
                        raise ValueError("all embeddings of a table must have the same length")
                    vector = put(vector, m[j])
                    count += counts[j]
        if vector is not None:
            held.append((now, vector / count if how == "mean" else vector, count))
            yield put_out()

    schema = f"{kinds}, _v array<double>, _n long"
    parts = usable(df).select(*groups, "embedding").mapInArrow(partial, schema)
    out = parts.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(merged, schema).select(*groups, F.col("_v").alias("pooled"))
    return out.withColumn("pooled", l2_normalize(F.col("pooled"))) if unit else out


def mean(df: DataFrame, groups: list[str]) -> DataFrame:
    return _elementwise(df, groups, "mean")


def maximum(df: DataFrame, groups: list[str]) -> DataFrame:
    return _elementwise(df, groups, "max")


def median(df: DataFrame, groups: list[str]) -> DataFrame:
    return _exploded(df, groups, F.median)


def topk_mean(df: DataFrame, groups: list[str], k: int = 5) -> DataFrame:
    """Of the k longest vectors; ties by idx, lengths compared at six decimals."""
    order = Window.partitionBy(*groups).orderBy(F.desc(F.round(norm(F.col("embedding")), 6)), "idx")
    return mean(df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k), groups)


def attention(df: DataFrame, groups: list[str], temperature: float = 0.1) -> DataFrame:
    """Weights: softmax of the products with the mean."""
    centre = mean(df, groups).withColumnRenamed("pooled", "_c")
    rows = df.join(centre, groups).withColumn("_s", dot(F.col("embedding"), F.col("_c")) / max(temperature, 1e-6))
    own = Window.partitionBy(*groups)
    rows = rows.withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(own)))
    rows = rows.withColumn("_w", F.col("_e") / (F.sum("_e").over(own) + 1e-12))
    return _elementwise(rows.withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.col("_w"))), groups, "sum")


def pyramid(df: DataFrame, groups: list[str], levels: tuple[int, ...] = (1, 2, 4), include_max: bool = False) -> DataFrame:
    """Temporal pyramid: a level of L has cells with edges at round(i * n / L), halves to even; an empty cell has the last row.
    Means (and maxima) of the cells follow each other."""
    if not levels or min(levels) <= 0:
        raise ValueError("levels must be positive")
    own = Window.partitionBy(*groups)
    rows = df.withColumn("_r", F.row_number().over(own.orderBy("idx")) - 1).withColumn("_n", F.count("*").over(own))
    cells = F.array(*[F.struct(F.lit(a * 1000 + i).alias("at"), F.bround(F.col("_n") * i / F.lit(float(n)), 0).cast("int").alias("lo"),
        F.bround(F.col("_n") * (i + 1) / F.lit(float(n)), 0).cast("int").alias("hi")) for a, n in enumerate(levels) for i in range(n)])
    rows = rows.withColumn("_cell", F.explode(cells))
    lo, hi = F.col("_cell.lo"), F.col("_cell.hi")
    rows = rows.where(((F.col("_r") >= lo) & (F.col("_r") < hi)) | ((hi <= lo) & (F.col("_r") == F.col("_n") - 1))).withColumn("_at", F.col("_cell.at"))
    parts = [_elementwise(rows, [*groups, "_at"], "mean", unit=False).withColumn("_o", F.lit(0))]
    if include_max:
        parts.append(_elementwise(rows, [*groups, "_at"], "max", unit=False).withColumn("_o", F.lit(1)))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = every.groupBy(*groups).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_o", "pooled"))), lambda x: x["pooled"])).alias("pooled"))
    return out.withColumn("pooled", l2_normalize(F.col("pooled")))


AGGREGATORS: dict[str, Callable[..., DataFrame]] = {"mean": mean, "max": maximum, "topk_mean": topk_mean, "median": median,
    "attention": attention, "spe": pyramid}
