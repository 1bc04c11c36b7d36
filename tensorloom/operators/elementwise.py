"""Element-wise operators. None needs its operands sorted."""

from __future__ import annotations

from pyspark.sql import functions as F

from tensorloom.errors import ShapeMismatchError, TensorZeroDivisionError
from tensorloom.tensor import SparseTensor


def collect_zeros(x: SparseTensor) -> SparseTensor:
    """Without explicit zeros; NaN stays."""
    return x.with_df(x.df.where("v <> 0"))


def add(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    """x + y: one aggregate over the union, partial before its only shuffle."""
    x.same_shape(y)
    return collect_zeros(x.with_df(x.df.unionByName(y.df).groupBy(*x.modes).agg(F.sum("v").alias("v"))))


def sub(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    x.same_shape(y)
    return add(x, y.with_df(y.df.withColumn("v", -F.col("v"))))


def dot_mul(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    """Hadamard product: coordinates of both; resulting zeros are dropped."""
    x.same_shape(y)
    return collect_zeros(x.with_df(x.df.join(y.df.withColumnRenamed("v", "_y"), x.modes).select(*x.modes, (F.col("v") * F.col("_y")).alias("v"))))


def dot_mul_eq(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    """Hadamard product of tensors with the same pattern, which is checked."""
    x.same_shape(y)
    both = x.df.withColumn("_x", F.lit(1)).unionByName(y.df.withColumn("_x", F.lit(-1)))
    if both.groupBy(*x.modes).agg(F.sum("_x").alias("d")).where("d <> 0").limit(1).count():
        raise ShapeMismatchError("the patterns differ")
    return dot_mul(x, y)


def dot_div(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    """Hadamard quotient where both are present; explicit zeros stay, a division by zero gives infinity or NaN."""
    x.same_shape(y)
    quotient = F.coalesce(F.try_divide("v", "_y"), F.when(F.col("v") > 0, F.lit(float("inf"))).when(F.col("v") < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan"))))
    return x.with_df(x.df.join(y.df.withColumnRenamed("v", "_y"), x.modes).select(*x.modes, quotient.alias("v")))


def mul_scalar(x: SparseTensor, a: float) -> SparseTensor:
    """a * x; zero empties the tensor."""
    return x.with_df(x.df.where(F.lit(False)) if a == 0 else x.df.withColumn("v", F.col("v") * F.lit(float(a))), x.sortorder)


def div_scalar(x: SparseTensor, a: float) -> SparseTensor:
    if a == 0:
        raise TensorZeroDivisionError("division by zero")
    return x.with_df(x.df.withColumn("v", F.col("v") / F.lit(float(a))), x.sortorder)


def mask(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    """The entries of x at coordinates of y."""
    x.same_shape(y)
    return x.with_df(x.df.join(y.df.select(*x.modes), x.modes, "left_semi"))


def unmask(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    """The entries of x at coordinates that y hasn't."""
    x.same_shape(y)
    return x.with_df(x.df.join(y.df.select(*x.modes), x.modes, "left_anti"))
