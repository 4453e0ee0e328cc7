"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where it is unset, a temporary folder serves for a local master; on a
    cluster that is an error, since executors would not see the files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    base = "file://" + tempfile.mkdtemp(prefix="bruit-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/bruit-{uuid.uuid4().hex}/{name}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session's application, once."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        name = Path(tempfile.mkdtemp(prefix="bruit-")) / "bruit_package.zip"
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(name))
        _shipped.add(app)


def map_pandas(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``mapInPandas`` for functions of this package."""
    ship(df.sparkSession)
    return df.mapInPandas(f, schema)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; later steps don't repeat its work."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Tables between the steps of one operator: written, read by name, and deleted when the steps are over."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.at = spark, new_path(spark, "steps"), {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Writes ``df``; a table that had this name before goes, now that its readers are done."""
        path = f"{self.base}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop(name)
        self.at[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.at.pop(name, None):
                remove(self.spark, path)


@contextmanager
def steps(spark: SparkSession) -> Iterator[Steps]:
    """``Steps`` whose tables go at the end, after a failure, too.  Shuffle files inside go with their job."""
    own = Steps(spark)
    try:
        with short_lived_shuffles(spark):
            yield own
    finally:
        remove(spark, own.base)


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a job's shuffle files go when the job ends, not when the driver's garbage is collected.

    For steps that are written to the shared folder: nothing reads their shuffles again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, "false") if spark.conf.isModifiable(key) else None
    try:
        if old is not None:
            spark.conf.set(key, "true")
        yield
    finally:
        if old is not None:
            spark.conf.set(key, old)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact name even if others differ from them just by case."""
    at = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return at.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def beside(df: DataFrame, *names: str) -> DataFrame:
    """All columns, renamed by position (``c0``, ``c1``, ...), and the named ones once more under their own names.

    So an operator's own columns can't clash with what a table carries; ``restored`` goes back.
    """
    at = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return at.select("*", *[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` from a frame made by ``beside``."""
    return df.select(*[F.col(f"c{i}") for i in range(len(like.columns))]).toDF(*like.columns)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, all other characters as they are (``lower`` on pure ASCII is the same and faster)."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, UPPER.lower())
    )


def words(c: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), WS_RE), lambda w: w != "")


def piecewise(c: Column, bounds: Sequence, first: int = 0) -> Column:
    """``first`` plus the number of sorted ``bounds`` that are <= ``c``, by a balanced tree of tests."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(c < F.lit(bounds[mid]), piecewise(c, bounds[:mid], first)).otherwise(
        piecewise(c, bounds[mid + 1 :], first + mid + 1)
    )


def quantile_bounds(df: DataFrame, col: str, n: int) -> list:
    """At most ``n - 1`` boundaries that cut the values of ``col`` into about equal ranges.

    One aggregation over the single column; the result has ``n`` values.
    """
    if n < 2:
        return []
    q = df.agg(F.percentile_approx(col, [i / n for i in range(1, n)], 20_000)).first()[0] or []
    return sorted(set(q))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b) of longs: rows (id, component), smallest id of each.

    Alternates large-star and small-star steps.  The minimum of a node's
    neighbours comes from a partial aggregation and goes back by a join that
    adaptive execution can split, so a node with very many links needs no task
    of its own.  Nodes without an edge don't appear.  Each round is written to
    the shared folder.
    """
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct().write.parquet(path)
    schema = "a long, b long"
    cur, state = spark.read.schema(schema).parquet(path), None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        last, path = path, new_path(spark, "edges")
        small.write.parquet(path)
        cur = spark.read.schema(schema).parquet(path)
        remove(spark, last)
        now = tuple(
            cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        )
        if now == state:
            break
        state = now
    roots = cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)

