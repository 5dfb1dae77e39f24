"""Validation and edits of stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validated(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with errors, the names of the rules that a row breaks; a rule that is null is not broken."""
    return df.withColumn("errors", F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull()))


def catalogue(checked: DataFrame) -> DataFrame:
    """(error, n): rows by broken rule."""
    return checked.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def apply_edits(df: DataFrame, edits: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """df with the last edit (by ord, then value) of each (id, field) written over the field."""
    last = edits.where(F.col("field").isin(fields)).groupBy("id").agg(
        *(F.max(F.when(F.col("field") == f, F.struct("ord", "value"))).alias(f"__{f}") for f in fields)
    )
    j = df.join(last.withColumnRenamed("id", "__id"), F.col(id_col) == F.col("__id"), "left")
    new = {f: F.when(F.col(f"__{f}").isNotNull(), F.col(f"__{f}.value").cast(df.schema[f].dataType)).otherwise(F.col(f)).alias(f) for f in fields}
    return j.select(*(new.get(c, F.col(c)) for c in df.columns))


def latest(df: DataFrame, keys: list[str], version: str, upto=None) -> DataFrame:
    """The row of the greatest version of each key, of those not after `upto`; of equal versions the greatest row.

    Combined before the shuffle, so a key of very many versions stays spread.
    """
    if upto is not None:
        df = df.where(F.col(version) <= upto)
    rest = [c for c in df.columns if c not in keys]
    row = F.max(F.struct(F.col(version).alias("__v"), *[F.col(c) for c in rest])).alias("__row")
    return df.groupBy(*keys).agg(row).select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def compacted(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """A store with only the last version of each key."""
    return latest(df, keys, version)
