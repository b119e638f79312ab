"""Checks of analysis fields written by an external model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from navloom import constants as K


def check_fields(cells: DataFrame, field: str = "field", value: str = "value") -> DataFrame:
    """Adds clean (text form of the accepted value) and reason (null when accepted).

    Enums must be listed, integers must lie in their range (true and false count as 1 and 0),
    floats must parse, tags become a JSON list, text passes; other fields are unknown.
    """
    f, v = F.col(field), F.col(value)
    allowed = F.create_map(*[x for k, vs in K.AI_ENUMS.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in vs]))])
    limits = F.create_map(*[x for k, (lo, hi) in K.AI_INT_RANGES.items() for x in (F.lit(k), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))])
    number = F.when(F.lower(v) == "true", F.lit(1)).when(F.lower(v) == "false", F.lit(0)).otherwise(v.try_cast("int"))
    is_enum, is_int = f.isin(list(K.AI_ENUMS)), f.isin(list(K.AI_INT_RANGES))
    tags = F.when(F.trim(v).startswith("["), F.to_json(F.from_json(v, "array<string>"))).otherwise(F.to_json(F.array(v)))
    reason = (
        F.when(is_enum & ~F.coalesce(F.array_contains(allowed[f], v), F.lit(False)), "value not allowed")
        .when(is_int & number.isNull(), "not an integer")
        .when(is_int & ~number.between(limits[f]["lo"], limits[f]["hi"]), "out of range")
        .when(f.isin(K.AI_FLOAT_FIELDS) & v.try_cast("double").isNull(), "not a number")
        .when(~(is_enum | is_int | f.isin([*K.AI_FLOAT_FIELDS, *K.AI_TEXT_FIELDS, "tags"])), "unknown field"))
    clean = (
        F.when(is_int, number.cast("string")).when(f.isin(K.AI_FLOAT_FIELDS), v.try_cast("double").cast("string"))
        .when(f == "tags", tags).otherwise(v))
    return cells.withColumn("reason", reason).withColumn("clean", F.when(F.col("reason").isNull(), clean))
