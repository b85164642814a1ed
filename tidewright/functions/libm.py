"""Arc tangents and cosines of the C library, by Arrow's kernels. The JVM's own differ from them in the last bit, which decides about values
that lie on the edge of a rounding; these give the bits that engines outside the JVM give."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def atan2(y: Column, x: Column) -> Column:
    def kernel(y: pa.Array, x: pa.Array) -> pa.Array:
        return pc.atan2(y, x)

    return F.arrow_udf(kernel, DoubleType())(y, x)


def cos(x: Column) -> Column:
    def kernel(x: pa.Array) -> pa.Array:
        return pc.cos(x)

    return F.arrow_udf(kernel, DoubleType())(x)
