"""Metric logs and measurements: event windows, deltas, rates and verdicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigrane.operators.profile import nearest_ranks


def event_windows(samples: DataFrame, by: list[str], ts: str, is_event: Column) -> DataFrame:
    """Spans from the log's first time over its events to its last: window, start, end; both ends belong to it."""
    edges = samples.groupBy(*by).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    points = samples.where(is_event).select(*by, F.col(ts).alias("at")).unionByName(edges.select(*by, F.col("lo").alias("at"))).unionByName(edges.select(*by, F.col("hi").alias("at"))).distinct()
    w = Window.partitionBy(*by).orderBy("at")
    out = points.select(*by, (F.row_number().over(w) - 1).alias("window"), F.col("at").alias("start"), F.lead("at").over(w).alias("end"))
    return out.where("end IS NOT NULL")


def in_windows(samples: DataFrame, windows: DataFrame, by: list[str], ts: str) -> DataFrame:
    """Samples of each window; one at a border is in two. An equality on `by` with the range beside it."""
    s, w = samples.alias("s"), windows.alias("w")
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"w.{c}")) for c in by] + [F.col(f"s.{ts}").between(F.col("w.start"), F.col("w.end"))]
    return s.join(w, on).select("s.*", "w.window", "w.start", "w.end")


def deltas(samples: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """First and last value by time of series with two numeric samples or more, largest change first."""
    at = F.struct(ts, value)
    own = samples.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.min(at)[value].alias("first"), F.max(at)[value].alias("last"))
    return own.where("n >= 2").withColumn("delta", F.col("last") - F.col("first")).orderBy(F.abs("delta").desc(), *by)


def distinct_metrics(samples: DataFrame, by: list[str]) -> DataFrame:
    return samples.select(*by).distinct().agg(F.count("*").alias("metrics"))


def counter_rates(counters: DataFrame, key: str = "key", ts: str = "observed_at", value: str = "value", least: float = 0.25, order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """Rate per second of each sample, in `order` within its key. The first one, a smaller value or an earlier time start anew (null); a gap below
    `least` seconds gives the last rate again and leaves the state as it is, so this is a fold and not a lag;
    tasks stream their sorted rows with one state."""

    def fold(frames):
        last, state = None, [None, None, None]
        for pdf in frames:
            rates: list = []
            for k, rows in pdf.groupby(key, sort=False, dropna=False):
                if not rates and k == last:
                    pass  # the key goes on from the batch before
                else:
                    state = [None, None, None]
                last = k
                rates += fold_rates(zip(rows[ts].map(lambda t: t.timestamp()), rows[value], strict=True), least, state)
            yield pdf.assign(rate=pd.array(rates, "Float64"))

    schema = T.StructType([*counters.schema, T.StructField("rate", T.DoubleType())])
    return counters.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, schema)


def fold_rates(samples, least: float, state: list | None = None) -> list:
    """State: last time, value and rate."""
    state = state if state is not None else [None, None, None]
    out = []
    for at, v in samples:
        t0, v0, rate = state
        if t0 is None or at < t0 or v < v0:
            state[:] = [at, v, None]
        elif at - t0 >= least:
            state[:] = [at, v, (v - v0) / (at - t0)]
        out.append(state[2])
    return out


def change_percent(base: Column, now: Column) -> Column:
    return F.when(base > 0, (now - base) / base * 100)


def verdict(measured: DataFrame, keys: list[str], run: str, values: tuple[str, ...], threshold: float) -> DataFrame:
    """baseline against candidate: regression if any value grew by more than the threshold, improvement if any fell by
    more and none grew, else unmeasurable; missing if a side is not there."""
    a = measured.where(F.col(run) == "baseline").select(*keys, *[F.col(v).alias(f"a_{v}") for v in values])
    b = measured.where(F.col(run) == "candidate").select(*keys, *[F.col(v).alias(f"b_{v}") for v in values])
    both = a.join(b, keys, "full_outer")
    changes = {f"{v}_change": change_percent(F.col(f"a_{v}"), F.col(f"b_{v}")) for v in values}
    both = both.withColumns(changes)
    worse, better, known = F.lit(False), F.lit(False), F.lit(True)
    for c in changes:
        worse, better, known = worse | (F.col(c) > threshold), better | (F.col(c) < -threshold), known & F.col(c).isNotNull()
    return both.select(*keys, *changes, F.when(~known, "missing").when(worse, "regression").when(better, "improvement").otherwise("unmeasurable").alias("verdict"))


def variance_band(runs: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The largest change in percent between neighbouring runs."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.abs(change_percent(F.lag(value).over(w), F.col(value)))
    return runs.withColumn("__c", change).groupBy(*keys).agg(F.max("__c").alias("band"))


def paired_reference(before: Column, after: Column) -> Column:
    """What a run between two baselines is held against."""
    return (before + after) / 2


def warm_up(runs: DataFrame, keys: list[str], order: str, value: str, tolerance: float = 5.0) -> DataFrame:
    """How many warm-up runs it took until all further ones lie within the tolerance (percent) of the median of the last
    three; three at least, all if they never settle or are no more than three."""
    whole = Window.partitionBy(*keys)
    rows = runs.withColumns({"__i": F.row_number().over(whole.orderBy(order)), "__n": F.count("*").over(whole)})
    last = rows.where("__i > __n - 3").groupBy(*keys).agg(F.element_at(F.array_sort(F.collect_list(value)), 2).alias("__m"))  # three values
    rows = rows.join(last, keys)
    off = ~F.coalesce(F.abs(change_percent(F.col("__m"), F.col(value))) <= tolerance, F.lit(False))
    settled = F.greatest(F.lit(3), F.coalesce(F.max(F.when(off, F.col("__i"))), F.lit(0)) + 1)
    out = rows.groupBy(*keys).agg(settled.alias("__s"), F.max("__n").alias("__n"))
    return out.select(*keys, F.when(F.col("__n") <= 3, F.col("__n")).otherwise(F.least("__s", "__n")).cast("long").alias("settled"))


def idle_seconds(samples: DataFrame, keys: list[str], seconds: str, values: tuple[str, ...], tolerance: float = 0.02) -> DataFrame:
    """The first time after which all values stay within the tolerance of their least; the last time if they never do."""
    tail = Window.partitionBy(*keys).orderBy(F.col(seconds).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ok = F.lit(True)
    for v in values:
        low, high = F.min(v).over(tail), F.max(v).over(tail)
        ok = ok & (low > 0) & ((high - low) / low <= tolerance)
    rows = samples.withColumn("__ok", ok & (F.col(seconds) > 0))
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("__ok"), F.col(seconds))), F.max(seconds)).alias("idle"))


def phases(stages: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Each stage's own time from cumulative medians, and its share of the whole."""
    med = nearest_ranks(stages, value, {"cumulative": 0.5}, [*keys, order])
    w = Window.partitionBy(*keys).orderBy(order)
    own = med.withColumn("own", F.col("cumulative") - F.coalesce(F.lag("cumulative").over(w), F.lit(0)))
    total = F.sum("own").over(Window.partitionBy(*keys))
    return own.withColumn("share", F.when(total > 0, F.col("own") / total).otherwise(0.0))
