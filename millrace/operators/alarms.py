"""Metric alarms: a statistic per period, and runs of periods beyond a threshold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``statistic`` ('avg' or 'max') over ``period`` above or below ``threshold`` for ``periods`` periods on end."""

    name: str
    statistic: str
    period: str
    above: bool
    threshold: float
    periods: int = 1
    change: int = 1


def period_statistics(samples: DataFrame, period: str) -> DataFrame:
    """``name``, ``start``, ``avg``, ``max``, ``n`` per metric and period; ``samples`` has ``ts``, ``name``, ``value``."""
    w = F.window(F.col("ts").cast("timestamp"), period)
    return samples.where("value IS NOT NULL").groupBy("name", w.alias("w")).agg(F.avg("value").alias("avg"), F.max("value").alias("max"), F.count(F.lit(1)).alias("n")).select("name", F.col("w.start").alias("start"), "avg", "max", "n")


def alarms(statistics: DataFrame, rule: Rule) -> DataFrame:
    """``name``, ``start``, ``rule``, ``change``: periods that complete a run beyond the threshold, compared strictly.

    Periods without samples break no run, as they have no row.
    """
    if rule.statistic not in ("avg", "max"):
        raise ValueError("statistic must be avg or max")
    value = F.col(rule.statistic)
    beyond = (value > rule.threshold if rule.above else value < rule.threshold).cast("int")
    run = Window.partitionBy("name").orderBy("start").rowsBetween(-(rule.periods - 1), 0)
    judged = statistics.withColumn("_ok", F.min(beyond).over(run)).withColumn("_n", F.count(F.lit(1)).over(run))
    return judged.where((F.col("_ok") == 1) & (F.col("_n") == rule.periods)).select("name", "start", F.lit(rule.name).alias("rule"), F.lit(rule.change).alias("change"))
