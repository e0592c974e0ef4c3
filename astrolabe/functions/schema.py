"""Small schema helpers (never mutate a DataFrame's cached schema)."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType,
                               StringType, StructField, StructType)

_NAMES = {"double": DoubleType(), "long": LongType(), "bigint": LongType(), "int": IntegerType(),
          "string": StringType(), "boolean": BooleanType(), "array<double>": ArrayType(DoubleType())}


def _t(t) -> DataType:
    return _NAMES[t] if isinstance(t, str) else t


def extend(schema: StructType, *fields: tuple[str, str | DataType]) -> StructType:
    """A new StructType: ``schema``'s fields followed by ``fields``."""
    return StructType(list(schema.fields) + [StructField(n, _t(t), True) for n, t in fields])


def seq_long(n: int):
    """``explode(sequence(0, n-1))`` as BIGINT (a generator cannot be wrapped in a cast)."""
    from pyspark.sql import functions as F
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
