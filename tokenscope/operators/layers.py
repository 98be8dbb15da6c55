"""Settings in layers: each later layer overrides the ones before it, field by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _present(value: Column, kind: T.DataType) -> Column:
    """Whether a layer says something: no null, no empty text or list, no number of 0 or less."""
    if isinstance(kind, T.StringType):
        return value != ""
    if isinstance(kind, T.ArrayType | T.MapType):
        return F.size(value) > 0
    if isinstance(kind, T.NumericType):
        return value > 0
    return value.isNotNull()


def _merged(value: Column, kind: T.DataType, order: str, whole: Sequence[str]) -> Column:
    """The aggregate of one field over the layers."""
    if not isinstance(kind, T.StructType):
        return F.max_by(value, F.when(_present(value, kind), F.col(order)))
    fields = []
    for f in kind.fields:
        inner = value[f.name]
        if f.name in whole and isinstance(f.dataType, T.StructType):
            said = _present(inner[f.dataType.fields[0].name], f.dataType.fields[0].dataType)
            fields.append(F.max_by(inner, F.when(said, F.col(order))).alias(f.name))
        else:
            fields.append(_merged(inner, f.dataType, order, whole).alias(f.name))
    return F.when(F.max(value.isNotNull()), F.struct(*fields))


def override(layers: DataFrame, key: str, order: str, whole: Sequence[str] = ("meta",)) -> DataFrame:
    """key and every other column of layers, merged over the layers of a key in the order of order.

    Texts and numbers: the last layer's that has one; lists and maps: the last that isn't empty, whole; structs: field by
    field, and null where no layer has one. Structs named in whole are replaced as a whole, by the last whose first
    field says something. One aggregation with partial sums; layers of a key are never collected. Layers of one key must
    differ in order.
    """
    rest = [f for f in layers.schema.fields if f.name not in (key, order)]
    out = []
    for f in rest:
        if f.name in whole and isinstance(f.dataType, T.StructType):
            first = f.dataType.fields[0]
            out.append(F.max_by(f.name, F.when(_present(F.col(f.name)[first.name], first.dataType), F.col(order))).alias(f.name))
        else:
            out.append(_merged(F.col(f.name), f.dataType, order, whole).alias(f.name))
    return layers.groupBy(key).agg(*out)
