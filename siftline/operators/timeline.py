"""Timelines of workers' events: durations, merged runs, bar widths and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def durations(events: DataFrame, worker: str, tick: str, tie: str) -> DataFrame:
    """events with t (ticks since the first of all) and len (ticks to the worker's next event; null at its last).

    The origin is one aggregate, not a window over all rows.
    """
    origin = events.agg(F.min(tick)).scalar()
    following = Window.partitionBy(worker).orderBy(tick, tie)
    return events.withColumn("t", F.col(tick) - origin).withColumn("len", F.lead(tick).over(following) - F.col(tick))


def islands(events: DataFrame, worker: str, tick: str, tie: str, name: str, tuples: str) -> DataFrame:
    """Consecutive events of one name merged: worker, island, name, first t, summed len and tuples.

    One shuffle by worker serves the lead, the change marks, their running sum and the grouping.
    """
    order = Window.partitionBy(worker).orderBy(tick, tie)
    timed = durations(events, worker, tick, tie)
    begins = F.when(F.lag(name).over(order).eqNullSafe(F.col(name)) & F.lag(F.lit(1)).over(order).isNotNull(), 0).otherwise(1)
    marked = timed.withColumn("begins", begins)
    numbered = marked.withColumn("island", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(worker, "island").agg(F.min(name).alias(name), F.min("t").alias("t"), F.sum("len").alias("len"), F.sum(tuples).alias(tuples))


def bar_width(name: Column, tuples: Column, length: Column, timed: tuple[str, ...] = ("CPUJOIN", "CPUWORK")) -> Column:
    """Speed as a bar's width: tuples a cycle times 120 within [1, 10] for timed work, 5 for the rest."""
    speed = tuples / F.nullif(length, F.lit(0)) * 120
    return F.when(name.isin(*timed) & (tuples > 0), F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(10.0), speed)), F.lit(10.0))).otherwise(5.0)


def event_class(name: Column) -> Column:
    """What an event's time was spent on."""
    return F.when(name == "CPUJOIN", "CPU join").when(name == "CPUWORK", "CPU work").when(name.isin("SCHEDPROBE", "FINISHPROBE"), "GPU scheduling").otherwise("other")
