"""Reports of called against true windows, as tables and as text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.kernels.states import match_switches
from pairloom.operators.intervals import agreement
from pairloom.operators.islands import runs, switch_points
from pairloom.shipping import ship


def concordance(rows: DataFrame, keys: list[str], order: str, ours: str, truth: str, tolerance: float = 1) -> DataFrame:
    """Per group: windows, their share with equal states, true and predicted switches, how many
    of the true ones a greedy matching detects within the tolerance, spurious ones,
    detection rate (1 without true switches), precision and mean distance of matches.

    Windows are compared in the JVM; only switch positions, at most a chromosome's windows,
    go to Python, to be matched in order."""
    ship(rows.sparkSession)
    share = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"), F.avg((F.col(ours) == F.col(truth)).cast("double")).alias("concordance"))
    switches = [switch_points(rows, keys, order, c).select(*keys, F.col("position").cast("double").alias("position"), F.lit(k).alias("side")) for k, c in enumerate((ours, truth))]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in share.select(*keys).schema) + ", n_true_switches long, n_predicted_switches long, n_detected long, n_spurious long, detection_rate double, switch_precision double, mean_distance double"

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        own, true = (sorted(pdf.loc[pdf["side"] == k, "position"]) for k in (0, 1))
        r = match_switches(own, true, tolerance)
        return pd.DataFrame([[*pdf[keys].iloc[0], len(true), len(own), r["matched"], r["spurious"], r["recall"], r["precision"], r["mean_distance"]]])

    matched = switches[0].unionByName(switches[1]).groupBy(*keys).applyInPandas(match, schema)
    out = share.join(matched, keys, "left")
    return out.na.fill(0, ["n_true_switches", "n_predicted_switches", "n_detected", "n_spurious"]).na.fill(1.0, ["detection_rate"]).na.fill(0.0, ["switch_precision", "mean_distance"])


def segment_concordance(rows: DataFrame, keys: list[str], order: str, ours: str, truth: str, start: str, end: str) -> DataFrame:
    """Per group and state: lengths of called and true segments and of what both have,
    Jaccard, precision, recall and F1 by length. start and end are a window's bounds."""
    bounds = rows.groupBy(*keys, order).agg(F.min(start).alias("_s"), F.max(end).alias("_e"))

    def segments(state: str) -> DataFrame:
        found = runs(rows, keys, order, state).withColumnRenamed(state, "state")
        first = bounds.select(*keys, F.col(order).alias("first_pos"), F.col("_s").alias("start_bp"))
        last = bounds.select(*keys, F.col(order).alias("last_pos"), F.col("_e").alias("end_bp"))
        return found.join(first, [*keys, "first_pos"]).join(last, [*keys, "last_pos"]).select(*keys, "state", "start_bp", "end_bp")

    rated = agreement(segments(ours), segments(truth), [*keys, "state"])
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", F.when(p + r > 0, F.round(2 * p * r / (p + r), 6)).otherwise(0.0))


def grid_starts(segments: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Starts of the windows of a size from the first start to the last end of each group."""
    span = segments.groupBy(*keys).agg(F.min("start_bp").alias("_lo"), F.max("end_bp").alias("_hi")).filter((F.col("_hi") > F.col("_lo")) & F.lit(size > 0))
    return span.select(*keys, F.explode(F.sequence("_lo", F.col("_hi") - 1, F.lit(max(size, 1)).cast("long"))).alias("start_bp"))


def has_bias(validation: DataFrame) -> bool:
    """Whether any population of a cross validation is right in under half of its windows."""
    return bool(validation.filter("population <> 'overall' and accuracy < 0.5").take(1))


def concordance_text(row) -> str:
    """A row of concordance() as text."""
    return (
        f"Concordance: {100 * row.concordance:.2f} % of {row.n_windows} windows\n"
        f"Switches: {row.n_true_switches} true, {row.n_predicted_switches} predicted, {row.n_detected} detected, {row.n_spurious} spurious\n"
        f"Detection {100 * row.detection_rate:.2f} %, precision {100 * row.switch_precision:.2f} %, mean distance {row.mean_distance:.1f} windows"
    )


def segment_text(rows, names: list[str]) -> str:
    """Rows of segment_concordance() as text, a line a population."""
    return "\n".join(f"{names[r.state]}: Jaccard={r.jaccard:.4f}, precision={r.precision:.4f}, recall={r.recall:.4f}, F1={r.f1:.4f}" for r in sorted(rows, key=lambda r: r.state))


def validation_text(rows) -> str:
    """Rows of a cross validation as text, with a warning where one population is biased."""
    out = [f"{r.population:<12}{r.accuracy:>10.4f}{r.precision:>10.4f}{r.recall:>10.4f}{r.f1:>10.4f}  ({r.windows} windows)" for r in sorted(rows, key=lambda r: (r.population == "overall", r.population))]
    if any(r.population != "overall" and r.accuracy < 0.5 for r in rows):
        out.append("bias: a population is right in under half of its windows")
    return "\n".join([f"{'population':<12}{'accuracy':>10}{'precision':>10}{'recall':>10}{'f1':>10}", *out])
