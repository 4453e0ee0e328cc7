"""Line dedup over levelled sorted runs (operator 3), DataFrame functions only.

Keys of lines are two 64-bit hashes.  Documents come in batches of descending
``doc_id``, as a crawl that is loaded newest first.  Each batch reduces its own
lines to (key, documents, largest doc_id), merge-anti-joins the runs to leave
out the keys they have settled (enough documents seen; the keeper, which came
earlier, is known), and adds the rest as a sorted run of level 0.  When a level
holds ``fanout`` runs they are compacted into one run of the next level.  Runs
are bucketed and sorted by key, so a run alone is merged without a shuffle; the
planner exchanges a union of several runs again.  At the end
all runs give the repeated keys and each one's keeper.  Lines then meet the repeated keys in a join that adaptive execution
can split at hot lines; only (document, line number) of what is dropped moves on.

Defined results: null or empty text is one empty line; rows with a ``doc_id``
in common are one document when documents are counted, and each keeps its lines
if that id is the keeper; rows without a ``doc_id`` count as one document, which
ranks below all others; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bruit.llm.common import WS_CHARS, ascii_lower, beside, new_path, pick, quantile_bounds, remove, restored, table

NO_ID = -(2**63)


@dataclass(frozen=True)
class LineParams:
    """A key is repeated if it has ``min_chars`` code points and stands in ``min_docs`` documents."""

    min_chars: int = 40
    min_docs: int = 5
    batches: int = 4
    fanout: int = 2


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WS_CHARS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashes(text: Column, p: LineParams) -> Column:
    """For each line its key's hashes, or null where the key is too short to count."""
    keys = F.transform(_lines(text), line_key)
    two = lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"))
    return F.transform(keys, lambda k: F.when(F.length(k) >= p.min_chars, two(k)))


@dataclass
class LineRuns:
    """Levels of runs: tables (h1, h2, n, top) bucketed and sorted by key in the shared folder."""

    spark: SparkSession
    params: LineParams
    levels: list[list[tuple[str, str]]] = field(default_factory=list)

    def _write(self, df: DataFrame) -> tuple[str, str]:
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name, path = f"bruit_run_{uuid.uuid4().hex}", new_path(self.spark, "run")
        df = df.repartition(n, "h1", "h2").sortWithinPartitions("h1", "h2")
        df.write.bucketBy(n, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name, path

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)

    def merged(self) -> DataFrame:
        return self._merge([r for level in self.levels for r in level])

    def _merge(self, runs: list[tuple[str, str]]) -> DataFrame:
        out = self.spark.table(runs[0][0])
        for name, _ in runs[1:]:
            out = out.unionByName(self.spark.table(name))
        return out.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def add(self, keys: DataFrame) -> None:
        """``keys``: one row (h1, h2, n, top) for each key of a batch whose ids are below all earlier ones."""
        if any(self.levels):
            settled = self.merged().where(F.col("n") >= self.params.min_docs).select("h1", "h2")
            keys = keys.join(settled, ["h1", "h2"], "left_anti")
        self._push(0, self._write(keys))

    def _push(self, level: int, run: tuple[str, str]) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.params.fanout:
            old, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._write(self._merge(old)))
            self._drop(old)

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []


def repeated_lines(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """Keys of lines that too many documents hold: (h1, h2, n documents, top = doc_id that keeps the line)."""
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    bounds = quantile_bounds(docs, "doc_id", params.batches)
    runs, path = LineRuns(spark, params), new_path(spark, "repeated")
    edges = [None, *bounds, None]
    try:
        for low, high in reversed(list(zip(edges, edges[1:], strict=False))):
            batch = docs
            if low is not None:
                batch = batch.where(F.col("doc_id") >= low)
            if high is not None:
                batch = batch.where(F.col("doc_id") < high)
            own = F.array_distinct(F.filter(_hashes(F.col("text"), params), lambda h: h.isNotNull()))
            # All rows of an id are in one batch, so its documents are counted here for good.
            keys = batch.select("doc_id", F.explode(own).alias("h")).select("doc_id", "h.h1", "h.h2").distinct()
            runs.add(keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("top")))
        out = runs.merged().where(F.col("n") >= params.min_docs)
        out.write.parquet(path)
    finally:
        runs.close()
    return spark.read.schema(out.schema).parquet(path)


def dedup_lines(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """Each document with ``c0..`` (its columns by position), ``n_lines``, ``n_dropped`` and ``kept`` text."""
    rep = repeated_lines(docs, params).select("h1", "h2", "top")
    both = pick(docs, "doc_id", "text")
    mine = both.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("d"),
        F.xxhash64("text").alias("t"),
        F.posexplode(_hashes(F.col("text"), params)).alias("pos", "h"),
    ).where("h is not null")
    mine = mine.select("d", "t", "pos", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))
    gone = mine.join(rep, ["h1", "h2"]).where("d <> top")
    gone = gone.groupBy("d", "t").agg(F.collect_set("pos").alias("gone"))
    out = beside(docs, "doc_id", "text").withColumns(
        {"d": F.coalesce("doc_id", F.lit(NO_ID)), "t": F.xxhash64("text")}
    )
    out = out.join(gone, ["d", "t"], "left").withColumn("ls", _lines(F.col("text")))
    at = F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), "gone")
    kept = F.array_join(F.transform(at, lambda i: F.get(F.col("ls"), i)), "\n")
    return (
        out.withColumn("n_lines", F.size("ls").cast("long"))
        .withColumn("n_dropped", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long"))
        .withColumn("kept", F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept))
        .drop("d", "t", "gone", "ls")
    )


def filter_documents(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """Documents without their repeated lines, with the columns they came with (``n_chars`` follows the text).

    A document of which nothing but white space is left goes, unless it came so.
    """
    out = dedup_lines(docs, params)
    left = (F.col("n_dropped") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(left)
    changed = F.col("n_dropped") > 0
    text = f"c{docs.columns.index('text')}"
    out = out.withColumn(text, F.when(changed, F.col("kept")).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        n = f"c{docs.columns.index('n_chars')}"
        kind = docs.schema[docs.columns.index("n_chars")].dataType
        out = out.withColumn(n, F.when(changed, F.length("kept").cast(kind)).otherwise(F.col(n)))
    return restored(out, docs)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = """
WITH l AS (
  SELECT doc_id, u.i AS i, u.line AS line,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(ls) AS line, unnest(range(len(ls))) AS i) u),
r AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, l.i, l.line, r.k IS NOT NULL AND l.doc_id <> r.top AS gone FROM l LEFT JOIN r USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
