"""Tables written between the steps of an iterative operator."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import fields
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

T = TypeVar("T")


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="bruit-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/step-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


#: Paths that ``stored`` has made since the innermost ``tidied`` began, in this thread.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a job's shuffle files go when the job ends, not when the driver's garbage is collected.

    For tables that are written to the shared folder: nothing reads their shuffles again.
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


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """``df`` written once and read back: later plans start from the files."""
    path = scratch(df.sparkSession)
    with short_lived_shuffles(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_place(rows: DataFrame, mid: str) -> DataFrame:
    """Stored ``rows`` with ``at``, their place from 0 without gaps, in the place of ``mid``, which was
    ``monotonically_increasing_id`` when they were written."""
    part = F.shiftright(mid, 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.select("part", before.alias("before")))  # a row for each part
    at = F.col("before") + F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("part", part).join(sizes, "part").withColumn("at", at).drop("part", mid, "before")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``at``, its place in the order of the unique ``key``, from 0 without gaps."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = stored(df.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("mid", F.monotonically_increasing_id()))
    return with_place(rows, "mid").withColumn("at", F.col("at").cast("int"))


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dropped(df: DataFrame) -> None:
    """Remove the folder of what ``stored`` gave."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        remove(df.sparkSession, path)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[Callable[[T], T]]:
    """Tables that ``stored`` writes inside go at the end, after a failure, too, but for those that what is given to the yielded
    function (a dataclass of DataFrames, or one) reads; these go with the ``tidied`` around this one, if there is one."""
    made, kept = [], []

    def keep(result: T) -> T:
        frames = [result] if isinstance(result, DataFrame) else [getattr(result, f.name) for f in fields(result)]
        kept.extend(name for df in frames for name in df.inputFiles())
        return result

    token = _made.set(made)
    try:
        yield keep
    finally:
        _made.reset(token)
        outer = _made.get()
        for path in made:
            if not any(f"/{path.rsplit('/', 1)[1]}/" in name for name in kept):
                remove(spark, path)
            elif outer is not None:
                outer.append(path)


class Versions:
    """Numbered versions of one or more tables under ``base``, which change together.

    A version counts when its mark stands, which is made after all of its tables; so a reader sees all tables of one version or of
    another.  The ``keep`` newest ones stay for readers that have begun; older ones go, their marks first.
    """

    def __init__(self, spark: SparkSession, base: str, keep: int = 2):
        self.spark, self.base, self.keep = spark, base, keep
        self.path_class = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path_class(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, n: int) -> str:
        return f"{self.base}/version={n:012d}"

    def _mark(self, n: int):
        return self.path_class(f"{self.path(n)}/_complete")

    def all(self) -> list[int]:
        """Numbers of complete versions, the oldest first."""
        if not self.fs.exists(self.path_class(self.base)):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.path_class(self.base))]
        numbers = sorted(int(x.removeprefix("version=")) for x in names if x.startswith("version="))
        return [n for n in numbers if self.fs.exists(self._mark(n))]

    def newest(self) -> int | None:
        return max(self.all(), default=None)

    def write(self, n: int, tables: dict[str, DataFrame]) -> bool:
        """Whether the version is new: one that is complete stays as it is, so a batch that is repeated changes nothing."""
        have = self.all()
        if have and n <= have[-1]:
            return False
        remove(self.spark, self.path(n))  # what an attempt that failed has left
        for name, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{self.path(n)}/{name}")
        self.fs.create(self._mark(n)).close()
        for old in have[: max(0, len(have) + 1 - self.keep)]:
            self.fs.delete(self._mark(old), False)
            remove(self.spark, self.path(old))
        return True

    def read(self, name: str, n: int | None = None) -> DataFrame:
        """A table of a version, by default of the newest."""
        return self.spark.read.parquet(f"{self.path(self.newest() if n is None else n)}/{name}")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session's application, once."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        name = Path(tempfile.mkdtemp(prefix="bruit-")) / "bruit_operators.zip"
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(name))
        _shipped.add(app)
