"""Masking of secrets and identifiers in any schema."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = "[REDACTED]"
#: Fixed value: names of keys whose values are secret.
SECRET_KEY = re.compile(r"(?i)(password|passwd|secret|token|api[-_]?key|authorization|bearer|private[-_]?key)")


def redact(df: DataFrame, patterns: Sequence[str] = (), exempt: Sequence[str] = ()) -> DataFrame:
    """Values under a key that names a secret are masked whole; in all other text every match of `patterns` is masked.

    Fields of structs and keys of maps are keys, at any depth and for values of any type; a secret value that isn't text
    becomes null. What lies under a key in `exempt` stays as it is, unless that key names a secret.
    """
    mark = MASK.replace("[", "\\[").replace("]", "\\]")

    def text(c: Column) -> Column:
        for p in patterns:
            c = F.regexp_replace(c, f"(?i){p}", mark)
        return c

    def masked(c: Column, kind: T.DataType) -> Column:
        return F.when(c.isNotNull(), F.lit(MASK)) if isinstance(kind, T.StringType) else F.lit(None).cast(kind)

    def walk(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return text(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType)) if nested(kind.elementType) else c
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[under(f.name, c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.MapType):
            named = isinstance(kind.keyType, T.StringType)
            return F.transform_values(c, lambda k, v: entry(k, v, kind.valueType) if named else walk(v, kind.valueType))
        return c

    def under(key: str, c: Column, kind: T.DataType) -> Column:
        if SECRET_KEY.search(key):
            return masked(c, kind)
        return c if key in exempt else walk(c, kind)

    def entry(k: Column, v: Column, kind: T.DataType) -> Column:
        """The value of a map's entry, whose key is known at run time only."""
        value = F.when(k.rlike(SECRET_KEY.pattern), masked(v, kind))
        return (value.when(k.isin(list(exempt)), v) if exempt else value).otherwise(walk(v, kind))

    def nested(kind: T.DataType) -> bool:
        return isinstance(kind, (T.StringType, T.ArrayType, T.StructType, T.MapType))

    return df.select(*[under(f.name, F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
