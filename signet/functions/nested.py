"""Values of any type with their texts redacted; the type decides, so one expression fits all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .text import redact


def redacted(value: Column, kind: S.DataType, longest: int = 500) -> Column:
    """``value`` with every text in it redacted and bytes replaced by how many there were; names and keys stay."""
    if isinstance(kind, S.StringType):
        return redact(value, longest)
    if isinstance(kind, S.BinaryType):
        return F.concat(F.lit("<"), F.octet_length(value).cast("string"), F.lit(" bytes omitted>"))
    if isinstance(kind, S.StructType):
        return F.when(value.isNotNull(), F.struct(*(redacted(value[f.name], f.dataType, longest).alias(f.name) for f in kind))) if len(kind) else value
    if isinstance(kind, S.ArrayType):
        return F.transform(value, lambda x: redacted(x, kind.elementType, longest))
    if isinstance(kind, S.MapType):
        return F.transform_values(value, lambda _, x: redacted(x, kind.valueType, longest))
    return value


def redact_columns(df: DataFrame, *columns: str, longest: int = 500) -> DataFrame:
    """``df`` with the given columns redacted at any depth."""
    return df.withColumns({c: redacted(F.col(f"`{c}`"), df.schema[c].dataType, longest) for c in columns})
