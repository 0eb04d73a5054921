"""Nested JSON to flat and child tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(df: DataFrame, prefix: str = "") -> DataFrame:
    """Struct fields as dotted columns, lists as JSON text; driven by the schema, so it is one projection."""
    out = []

    def walk(field: T.StructField, path: list[str]) -> None:
        kind, name = field.dataType, ".".join([*path, field.name])
        column = F.col(".".join(f"`{p}`" for p in [*path, field.name]))
        if isinstance(kind, T.StructType):
            for inner in kind.fields:
                walk(inner, [*path, field.name])
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            out.append(F.to_json(column).alias(prefix + name))
        else:
            out.append(column.alias(prefix + name))

    for f in df.schema.fields:
        walk(f, [])
    return df.select(*out)


def children(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """A list of objects as a table of its own: the parent's keys, the object's place, its fields."""
    exploded = df.select(*keys, F.posexplode(F.col(column)).alias("_id", "_item"))
    return flatten(exploded.select(*keys, "_id", "_item.*"))


def entities(df: DataFrame, name: str, keys: list[str]) -> dict[str, DataFrame]:
    """The flat table and, recursively, a child table for every list of objects."""
    out: dict[str, DataFrame] = {}
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    out[name] = flatten(df.drop(*lists))
    for c in lists:
        child = df.select(*[F.col(k).alias(f"{name}_{k}" if k == "_id" else k) for k in keys], F.posexplode(c).alias("_id", "_item")).select("*", "_item.*").drop("_item")
        own = [f"{name}_{k}" if k == "_id" else k for k in keys]
        out |= entities(child, f"{name}.{c}", [*own, "_id"])
    return out


def key_values(df: DataFrame, json: str, keys: list[str]) -> DataFrame:
    """Objects of unknown shape in long form: one row for each key, values as text."""
    return df.select(*keys, F.explode(F.from_json(F.col(json), "map<string,string>")).alias("key", "value"))


def read(df: DataFrame, json: str, schema: str) -> DataFrame:
    """Text under a schema: a list gives a row each, a scalar ``{value}``."""
    kind = T._parse_datatype_string(schema)
    parsed = df.withColumn("_j", F.from_json(F.col(json), kind))
    return parsed.select("*", F.explode("_j").alias("record")).drop("_j") if isinstance(kind, T.ArrayType) else parsed.withColumnRenamed("_j", "record")
