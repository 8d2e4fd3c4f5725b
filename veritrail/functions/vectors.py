"""Functions on ``ARRAY<FLOAT>`` columns, all evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RMS_EPS = 1e-5
POOL_MIN_WEIGHT = 1e-6


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def as_double(vec: str | Column) -> Column:
    c = F.col(vec) if isinstance(vec, str) else vec
    return c.cast("array<double>")


def constant_vector(values: Sequence[float]) -> Column:
    # one parsed literal list: far fewer calls than one per element
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once.

    A column named inside an array lambda is otherwise computed per element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def affine(vec: Column, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """``Wx + b`` for a modest number of outputs; wide layers belong in ``score``."""
    shift = [0.0] * len(weights) if bias is None else [float(b) for b in bias]
    return bind(vec, lambda v: F.array(*[dot(v, constant_vector(w)) + F.lit(b) for w, b in zip(weights, shift)]))


def _scaled(vec: Column, second_moment: Column, eps: float) -> Column:
    scale = F.lit(1.0) / F.sqrt(second_moment / F.size(vec) + F.lit(eps))
    return bind(scale, lambda s: F.transform(vec, lambda x: x * s))


def rms_normalise(vec: Column, weight: Column | None = None, eps: float = RMS_EPS) -> Column:
    scaled = bind(vec, lambda v: _scaled(v, _sum(F.transform(v, lambda x: x * x)), eps))
    return scaled if weight is None else F.zip_with(scaled, weight, lambda x, w: x * w)


def layer_normalise(vec: Column, eps: float = 1e-5) -> Column:
    centred = bind(vec, lambda v: bind(_sum(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m)))
    return bind(centred, lambda c: _scaled(c, _sum(F.transform(c, lambda x: x * x)), eps))


def width_adapter(vec: Column, in_dim: int, weights: Sequence[Sequence[float]]) -> Column:
    """RMS normalise, then project without bias; identity at equal widths."""
    if len(weights) == in_dim:
        return vec
    return affine(rms_normalise(vec), weights)


def class_vector_row(states: DataFrame, id_col: str, class_vec: Sequence[float]) -> DataFrame:
    """Put one learnt vector in front of each sequence of ``(id, pos, mask, vec)``."""
    shifted = states.withColumn("pos", F.col("pos") + 1)
    first = (
        states.select(id_col)
        .distinct()
        .select(
            id_col,
            F.lit(0).cast(states.schema["pos"].dataType).alias("pos"),
            F.lit(1).cast(states.schema["mask"].dataType).alias("mask"),
            constant_vector(class_vec).cast(states.schema["vec"].dataType).alias("vec"),
        )
    )
    return shifted.select(id_col, "pos", "mask", "vec").unionByName(first)


def first_position(states: DataFrame) -> DataFrame:
    return states.where(F.col("pos") == 0)


def width_check(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Rows, missing vectors and the narrowest and widest vector, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(vec).isNull()).alias("n_missing"),
        F.min(F.size(vec)).alias("min_width"),
        F.max(F.size(vec)).alias("max_width"),
    )


def long_vector(df: DataFrame, keys: Sequence[str], vec: str, digits: int = 6) -> DataFrame:
    """``(keys, dim, value)`` with values rounded, ``dim`` from 0."""
    # the outer form keeps Spark from testing, and so computing, the vector twice
    long = df.select(*keys, F.posexplode_outer(vec).alias("dim", "value")).where("dim is not null")
    return long.withColumn("value", F.round(F.col("value").cast("double"), digits))
