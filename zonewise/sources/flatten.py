"""Flattening of catalogs with nested fields to plain columns, and packing of flags."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Square arcseconds to a square radian, and their square.
ARCSEC2_PER_RAD2 = (math.degrees(1) * 3600) ** 2
ARCSEC4_PER_RAD4 = ARCSEC2_PER_RAD2**2
FLAGS_PER_INTEGER = 63


def pack_flags(flags: Sequence[Column]) -> list[Column]:
    """Flags as bits of 64-bit integers, 63 in each, from the lowest bit."""
    out = []
    for first in range(0, len(flags), FLAGS_PER_INTEGER):
        total = F.lit(0).cast("bigint")
        for k, flag in enumerate(flags[first : first + FLAGS_PER_INTEGER]):
            total = total.bitwiseOR(F.when(flag, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        out.append(total)
    return out


def unpack_flag(packed: Sequence[Column], k: int) -> Column:
    return F.shiftright(packed[k // FLAGS_PER_INTEGER], k % FLAGS_PER_INTEGER).bitwiseAND(F.lit(1).cast("bigint")) == 1


def flatten(df: DataFrame, flags_as_bits: bool = True, ignore: Sequence[str] = (), nullable_integers: Sequence[str] = (), canonical_flags: Sequence[str] = ()) -> DataFrame:
    """Plain columns in schema order: structs by field (``a_b``), arrays of a fixed ``size`` by place (``a_0``).

    What a column is stands in its metadata: ``unit`` rad makes degrees of an angle or of a struct of
    angles, rad^2 and rad^4 square arcseconds and their square; ``size`` is an array's length.
    nullable_integers: columns whose 0 means null. Flags stay columns, or go packed to the end as
    flags_0, ...; then canonical_flags follow, packed in the order given, as canonical_0, ...
    """
    out: list[Column] = []
    flags: list[Column] = []
    for field in df.schema.fields:
        if field.name in ignore:
            continue
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.BooleanType):
            if flags_as_bits:
                out.append(value)
            else:
                flags.append(value)
            continue
        out += [c.alias(n) for n, c in _plain(field.name, value, field.dataType, field.metadata or {}, field.name in nullable_integers)]
    if not flags_as_bits:
        out += [c.alias(f"flags_{k}") for k, c in enumerate(pack_flags(flags))]
        types = {f.name: f.dataType for f in df.schema.fields}
        for name in canonical_flags:
            if not isinstance(types.get(name), T.BooleanType):
                raise ValueError(f"{name} is no flag")
        out += [c.alias(f"canonical_{k}") for k, c in enumerate(pack_flags([F.col(f"`{n}`") for n in canonical_flags]))]
    return df.select(*out)


def _plain(name: str, value: Column, kind: T.DataType, meta: dict, zero_is_null: bool) -> list[tuple[str, Column]]:
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _plain(f"{name}_{f.name}", value[f.name], f.dataType, meta | (f.metadata or {}), False)]
    if isinstance(kind, T.ArrayType):
        if "size" not in meta:
            raise ValueError(f"{name} has no fixed size")
        return [x for k in range(meta["size"]) for x in _plain(f"{name}_{k}", F.get(value, F.lit(k)), kind.elementType, meta, False)]
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        factor = {"rad": math.degrees(1), "rad^2": ARCSEC2_PER_RAD2, "rad^4": ARCSEC4_PER_RAD4}.get(meta.get("unit", ""))
        return [(name, value * factor if factor else value)]
    if zero_is_null:
        return [(name, F.nullif(value, F.lit(0).cast(kind)))]
    return [(name, value)]
