"""Keys between tables: orphans, cascading deletes, nulled and renamed references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference is set but not found."""
    known = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def cascade_delete(child: DataFrame, key: str, deleted: DataFrame, deleted_key: str) -> DataFrame:
    """The rows that stay when the ``deleted`` rows of the parent go."""
    return child.join(deleted.select(F.col(deleted_key).alias(key)).distinct(), key, "left_anti")


def set_null(child: DataFrame, key: str, deleted: DataFrame, deleted_key: str) -> DataFrame:
    """References to ``deleted`` parents become null."""
    gone = deleted.select(F.col(deleted_key).alias("gone")).distinct()
    out = child.join(gone, child[key] == gone.gone, "left")
    return out.withColumn(key, F.when(F.col("gone").isNull(), F.col(key))).drop("gone")


def rename(child: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """References follow ``names`` (old, new)."""
    out = child.join(names, child[key] == names.old, "left")
    return out.withColumn(key, F.coalesce("new", key)).drop("old", "new")
