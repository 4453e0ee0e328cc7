"""Word rates per grid cell and period, their history, and bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bruit.functions.geo import with_cell
from bruit.params import Params


def period(time: Column, p: Params) -> Column:
    """Number of the period since 1970."""
    return F.floor(F.unix_timestamp(time.cast("timestamp")) / p.period_seconds).cast("long")


def one_per_user(tweets: DataFrame, p: Params) -> DataFrame:
    """The newest message of each user in each period."""
    t = tweets.withColumn("period", period(F.col("time"), p))
    w = Window.partitionBy("period", "uid").orderBy(F.desc("time"), F.desc("id"))
    return t.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def cell_counts(tweets: DataFrame, p: Params) -> DataFrame:
    """(period, x, y, n): messages per cell, one for each user."""
    return with_cell(one_per_user(tweets, p), p).groupBy("period", "x", "y").agg(F.count("*").alias("n"))


def word_cell_counts(tweets: DataFrame, p: Params) -> DataFrame:
    """(period, x, y, word, n): messages of a cell that hold the word."""
    t = with_cell(one_per_user(tweets, p), p).select("period", "x", "y", F.explode(F.array_distinct("words")).alias("word"))
    return t.groupBy("period", "x", "y", "word").agg(F.count("*").alias("n"))


def word_rates(tweets: DataFrame, p: Params) -> DataFrame:
    """(period, x, y, word, local_rate, global_rate): share of messages with the word, in the cell and everywhere."""
    cells, words = cell_counts(tweets, p), word_cell_counts(tweets, p)
    total = cells.groupBy("period").agg(F.sum("n").alias("all"))
    everywhere = words.groupBy("period", "word").agg(F.sum("n").alias("hits")).join(total, "period")
    everywhere = everywhere.select("period", "word", (F.col("hits") / F.col("all")).alias("global_rate"))
    local = words.join(cells.withColumnRenamed("n", "m"), ["period", "x", "y"])
    local = local.select("period", "x", "y", "word", (F.col("n") / F.col("m")).alias("local_rate"))
    return local.join(everywhere, ["period", "word"]).select("period", "x", "y", "word", "local_rate", "global_rate")


def word_history(rates: DataFrame, p: Params) -> DataFrame:
    """Adds mean and deviation of a word's local rate in the cell over all earlier periods; absent ones count as zero."""
    first = rates.agg(F.min("period").alias("first"))
    w = Window.partitionBy("word", "x", "y").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    r = rates.crossJoin(F.broadcast(first)).withColumn("earlier", F.col("period") - F.col("first"))  # one row
    total, square = F.sum("local_rate").over(w), F.sum(F.col("local_rate") * F.col("local_rate")).over(w)
    r = r.withColumns({"s": F.coalesce(total, F.lit(0.0)), "q": F.coalesce(square, F.lit(0.0))})
    mean = F.try_divide("s", "earlier")
    sd = F.when(F.col("earlier") > 0, F.sqrt(F.greatest(F.try_divide("q", "earlier") - mean * mean, F.lit(0.0))))
    return r.withColumns({"mean": mean, "sd": sd}).drop("s", "q", "earlier", "first")


def grid_blur(grid: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """3 x 3 binomial blur of ``value`` over cells (x, y); beyond the edge nothing is added."""
    steps = [(i, j, (2 - abs(i)) * (2 - abs(j)) / 16) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    spread = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in steps]))
    s = grid.withColumn("s", spread)
    s = s.select(*keys, (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"), (F.col(value) * F.col("s.w")).alias("v"))
    return s.groupBy(*keys, "x", "y").agg(F.sum("v").alias(value))


def burst_events(rates: DataFrame, p: Params) -> DataFrame:
    """Words whose rate in a cell stands out against its past and, blurred over neighbouring cells, against everywhere."""
    h = word_history(rates, p)
    space = rates.groupBy("period", "word").agg(F.stddev_pop("local_rate").alias("space_sd"))
    blurred = grid_blur(rates.select("period", "word", "x", "y", F.col("local_rate").alias("blurred")), "blurred", ("period", "word"))
    h = h.join(blurred, ["period", "word", "x", "y"]).join(space, ["period", "word"])
    new = F.col("local_rate") > F.greatest(F.col("mean") * (1 + p.temporal_share), F.col("mean") + p.temporal_deviations * F.col("sd"))
    here = F.col("blurred") > F.greatest(
        F.col("global_rate") * (1 + p.spatial_share), F.col("global_rate") + p.spatial_deviations * F.col("space_sd")
    )
    return h.where(new & here).select("period", "x", "y", "word", "local_rate", "global_rate", "mean", "sd", "blurred")
