"""Reductions of what happened when.

Step functions and running counts are taken within a run (a partition column), so many runs are
many groups; a single run's samples are one group, as the questions are sequential in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, FIRST_BIN_US, SERIAL = 30, 1_000_000, 2


def step_average(df: DataFrame, run: str, at: str, value: str) -> DataFrame:
    """Average of a step function: each value holds until the next sample."""
    held = F.lead(at).over(Window.partitionBy(run).orderBy(at)) - F.col(at)
    rows = df.withColumn("_held", held)
    area, time = F.sum(F.col(value).cast("double") * F.col("_held")), F.sum("_held")
    return rows.groupBy(run).agg(F.when(time > 0, area / time).otherwise(0.0).alias("average"), F.coalesce(time, F.lit(0)).alias("elapsed"))


def bin_width(df: DataFrame, run: str, at: str, bins: int = BINS, first: int = FIRST_BIN_US) -> DataFrame:
    """run, width: the first width doubled until all samples (from 0) fit into so many bins."""
    most = df.groupBy(run).agg(F.max(at).alias("_most"))
    doublings = F.greatest(F.ceil(F.log2((F.col("_most") + 1).cast("double") / (first * bins))), F.lit(0))
    return most.select(run, (F.lit(first) * F.pow(F.lit(2.0), doublings)).cast("bigint").alias("width"))


def trajectory(df: DataFrame, run: str, at: str, window: str, value: str, total: str) -> DataFrame:
    """By bin of a sample's end: time, average value, rate of the running total (per second)."""
    widths = bin_width(df, run, at)
    rows = df.join(widths, run).withColumn("bin", F.floor(F.col(at) / F.col("width")).cast("bigint"))
    best = F.max(total).over(Window.partitionBy(run).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.greatest(F.col(total) - F.coalesce(best, F.lit(0)), F.lit(0)))
    time = F.sum(window)
    used = rows.groupBy(run, "width", "bin").agg(time.alias("elapsed"), (F.sum(F.col(value).cast("double") * F.col(window)) / time).alias("average"), (F.sum("_new") / (time / 1e6)).alias("rate"))
    last = widths.join(df.groupBy(run).agg(F.max(at).alias("_most")), run).select(run, "width", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_most") / F.col("width")))).alias("bin"))
    full = last.join(used, [run, "width", "bin"], "left")
    return full.select(run, "width", "bin", F.coalesce("elapsed", F.lit(0)).alias("elapsed"), F.coalesce("average", F.lit(0.0)).alias("average"), F.coalesce("rate", F.lit(0.0)).alias("rate"))


def trajectory_summary(bins: DataFrame, run: str) -> DataFrame:
    """Share of time at low concurrency, where the last low stretch begins (-1: none), and the final value."""
    low = F.col("average") <= SERIAL
    last_high = F.max(F.when(~low, F.col("bin")))
    rows = bins.groupBy(run).agg(F.sum("elapsed").alias("_t"), F.sum(F.when(low, F.col("elapsed")).otherwise(0)).alias("_low"), last_high.alias("_high"), (F.max("bin") + 1).alias("_used"), F.round(F.max_by("average", "bin")).cast("bigint").alias("final"))
    begin = F.coalesce(F.col("_high") + 1, F.lit(0))
    return rows.select(run, F.when(F.col("_t") > 0, F.col("_low") / F.col("_t")).otherwise(0.0).alias("serial_share"), F.when(begin >= F.col("_used"), -1.0).otherwise(begin / F.col("_used")).alias("collapse_at"), "final")


def tail_window(df: DataFrame, run: str, emitted: str, at: str, value: str, percent: int, baseline: int = 0) -> DataFrame:
    """Mean value and share of time from the sample on at which all but the last percent were emitted."""
    totals = df.groupBy(run).agg(F.max(emitted).alias("_total"), F.max(at).alias("_end"))
    rows = df.join(totals, run)
    mark = baseline + (F.col("_total") - baseline) * F.lit(1.0 - percent / 100.0)
    tail = rows.where(F.col(emitted) >= mark)
    share = 1.0 - F.min(at) / F.first("_end")
    return tail.groupBy(run).agg(F.avg(value).alias("average"), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)).alias("time_share"))


def peak_live(df: DataFrame, run: str, at: str, change: str) -> DataFrame:
    """Most at once, and when first; change is +1 or -1."""
    live = F.sum(change).over(Window.partitionBy(run).orderBy(at, F.col(change).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = df.withColumn("live", live)
    return rows.groupBy(run).agg(F.max("live").alias("peak"), F.min_by(at, F.struct(-F.col("live"), F.col(at))).alias("peak_at"))


def time_bins(df: DataFrame, at: str, mass: str, bins: int = 120) -> DataFrame:
    """Mass by bin of the whole time, and as a share of the fullest bin."""
    ends = df.agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    rows = df.join(F.broadcast(ends), F.lit(True))  # one row
    b = F.least(F.floor(bins * (F.col(at) - F.col("_a")) / F.greatest(F.col("_b") - F.col("_a"), F.lit(1))), F.lit(bins - 1))
    sums = rows.groupBy(b.cast("bigint").alias("bin")).agg(F.sum(mass).alias("mass"), F.count("*").alias("n"))
    return sums.withColumn("share", F.col("mass") / F.max("mass").over(Window.partitionBy()))


def ewma(df: DataFrame, run: str, at: str, value: str, alpha: float) -> DataFrame:
    """Exponentially weighted average of a run's values in time order; starts at the first.

    A value's weight depends on how many come after it, so it is a weighted sum; a run is sorted, never collected.
    """
    v = F.col(value).cast("double")
    later = Window.partitionBy(run).orderBy(F.col(at).desc(), v.desc())
    rows = df.select(run, v.alias("_v"), (F.row_number().over(later) - 1).alias("_k"), F.count("*").over(Window.partitionBy(run)).alias("_n"))
    weight = F.pow(F.lit(1 - alpha), F.col("_k")) * F.when(F.col("_k") == F.col("_n") - 1, 1.0).otherwise(alpha)
    return rows.groupBy(run).agg(F.sum(F.col("_v") * weight).alias("ewma"))


def density_share(trailing: Column, overall: Column) -> Column:
    """Where to cut by density: between the middle and three quarters; the middle without a signal."""
    ok = (overall > 0) & trailing.isNotNull()
    return F.when(ok, F.greatest(F.least(0.5 + 0.25 * F.least(trailing / overall, F.lit(1.0)), F.lit(0.75)), F.lit(0.5))).otherwise(0.5)


def window_verdicts(df: DataFrame, run: str, at: str, good: str, size: int, least: float) -> DataFrame:
    """Windows of so many samples: the share of good ones, and whether it reaches the least; the verdict of a full window stands for the next."""
    rows = df.withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy(at)) - 1)
    wins = rows.groupBy(run, F.floor(F.col("_n") / size).alias("window")).agg(F.count("*").alias("n"), F.avg(F.col(good).cast("double")).alias("share"))
    return wins.withColumn("passes", (F.col("n") == size) & (F.col("share") >= least))


def live_rate(df: DataFrame, run: str, at: str, total: str) -> DataFrame:
    """Rate per second over the last interval of each run that takes time; samples of one instant count by their total, and a run of one instant has an infinite rate."""
    w = Window.partitionBy(run).orderBy(at, total)
    rows = df.withColumn("_rise", F.col(total) - F.lag(total).over(w)).withColumn("_time", F.col(at) - F.lag(at).over(w))
    rate = F.max_by(F.try_divide(F.col("_rise"), F.col("_time") / 1e6), F.when(F.col("_time") > 0, F.col(at)))
    return rows.groupBy(run).agg(F.coalesce(rate, F.when(F.count_if(F.col("_time") == 0) > 0, F.lit(float("inf")))).alias("rate"))


def stuck(df: DataFrame, run: str, at: str, kind: str, least: int = 10) -> DataFrame:
    """The class of errors since the last progress: the majority's if there are enough, else none."""
    last = F.max(F.when(F.col(kind) == "progress", F.col(at))).over(Window.partitionBy(run))
    since = df.withColumn("_last", last).where((F.col("_last").isNull() | (F.col(at) > F.col("_last"))) & (F.col(kind) != "progress"))
    counts = since.groupBy(run, kind).agg(F.count("*").alias("n"))
    best = counts.groupBy(run).agg(F.sum("n").alias("total"), F.max(F.struct("n", kind)).alias("m"))
    return best.select(run, "total", F.when((F.col("total") >= least) & (F.col("m.n") * 2 > F.col("total")), F.col(f"m.{kind}")).alias("stuck_on"))


def run_summary(df: DataFrame, run: str, at: str, in_flight: str, total: str, last_split: str) -> DataFrame:
    """Rates and occupancy of a run, whole and after its last split."""
    held = F.lead(at).over(Window.partitionBy(run).orderBy(at)) - F.col(at)
    rows = df.withColumn("_held", F.coalesce(held, F.lit(0))).withColumn("_tail", F.col(at) >= F.col(last_split))
    time, tail = F.max(at) - F.min(at), F.max(at) - F.max(last_split)
    mean = lambda c: F.try_divide(F.sum(F.when(c, F.col(in_flight) * F.col("_held"))), F.sum(F.when(c, F.col("_held"))))
    keys_tail = F.max(total) - F.min(F.when(F.col("_tail"), F.col(total)))
    return rows.groupBy(run).agg(
        F.try_divide(tail, time).alias("tail_share"), F.try_divide(F.max(total), time / 1e6).alias("rate"), F.when(tail > 0, keys_tail / (tail / 1e6)).alias("tail_rate"), mean(F.lit(True)).alias("occupancy"), mean(F.col("_tail")).alias("tail_occupancy"),
        F.try_divide(F.sum(F.when(F.col(in_flight) <= SERIAL, F.col("_held")).otherwise(0)), F.sum("_held")).alias("serial_share"), F.max(in_flight).alias("most"),
    )
