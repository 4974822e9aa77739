"""Homogeneous two-state recursions as folds over a group's ordered array, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log_likelihood(rows: DataFrame, keys: list[str], order: str, low: Column, high: Column, enter: float, leave: float, start: float) -> DataFrame:
    """Per group: windows and the log likelihood of the two-state chain over them. A group's
    array is as long as a chromosome has windows."""
    import math

    ln = lambda p: F.lit(math.log(p))
    step = F.struct(F.col(order).alias("o"), low.alias("e0"), high.alias("e1"))
    arrays = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("w"))
    first = F.get("w", F.lit(0))
    begin = F.struct((ln(1 - start) + first["e0"]).alias("a0"), (ln(start) + first["e1"]).alias("a1"))

    def move(s, x):
        return F.struct(
            (log_add(s["a0"] + ln(1 - enter), s["a1"] + ln(leave)) + x["e0"]).alias("a0"),
            (log_add(s["a0"] + ln(enter), s["a1"] + ln(1 - leave)) + x["e1"]).alias("a1"),
        )

    rest = F.slice("w", F.lit(2), F.size("w"))
    total = F.aggregate(rest, begin, move, lambda s: log_add(s["a0"], s["a1"]))
    return arrays.select(*keys, F.size("w").cast("long").alias("n_windows"), total.alias("log_likelihood"))
