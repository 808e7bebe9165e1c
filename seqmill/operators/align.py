"""Aligning two versions of one note list, and how far they drift apart."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_index(a: DataFrame, b: DataFrame, key: str, order: list[str], clock: str, pitch: str) -> DataFrame:
    """Pair equal places within a key: for versions with equally many notes."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    left = a.select(key, n.cast("long").alias("k"), F.col(clock).alias("us_a"), F.col(pitch).alias("p_a"))
    right = b.select(key, n.cast("long").alias("k"), F.col(clock).alias("us_b"), F.col(pitch).alias("p_b"))
    return left.join(right, [key, "k"]).select(key, "k", "us_a", "us_b", (F.col("us_b") - F.col("us_a")).alias("d_on"), (F.col("p_b") - F.col("p_a")).alias("d_pitch"))


def greedy(a: DataFrame, b: DataFrame, key: str, tolerance: int) -> DataFrame:
    """``a, b (key, pitch, on)`` -> pairs: in the order of a, the nearest free note of b of the same pitch.

    At most ``tolerance`` apart; of equally near ones the earlier. Unmatched notes have a null partner.
    One key's notes are one task's work, sorted, with a window that moves with a.
    """
    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        x, y = (d.sort_values(["on", "pitch"], kind="stable").reset_index(drop=True) for d in (x, y))
        name = (x if len(x) else y)[key].iloc[0]
        free = {p: list(g["on"]) for p, g in y.groupby("pitch")}
        start = dict.fromkeys(free, 0)
        used = {p: [False] * len(v) for p, v in free.items()}
        rows = []
        for p, on in zip(x["pitch"], x["on"], strict=True):
            best, ons = None, free.get(p, [])
            while start.get(p, 0) < len(ons) and ons[start[p]] < on - tolerance:
                start[p] += 1
            for k in range(start.get(p, 0), len(ons)):
                if ons[k] > on + tolerance:
                    break
                if not used[p][k] and (best is None or abs(ons[k] - on) < abs(ons[best] - on)):
                    best = k
            if best is None:
                rows.append((name, p, on, None))
            else:
                used[p][best] = True
                rows.append((name, p, on, ons[best]))
        rows += [(name, p, None, on) for p, ons in free.items() for on, u in zip(ons, used[p], strict=True) if not u]
        out = pd.DataFrame(rows, columns=[key, "pitch", "on_a", "on_b"])
        return out.astype({"on_a": "Int64", "on_b": "Int64"})

    kind = dict(a.dtypes)[key]
    return a.select(key, "pitch", "on").groupBy(key).cogroup(b.select(key, "pitch", "on").groupBy(key)).applyInPandas(run, f"{key} {kind}, pitch long, on_a long, on_b long")


def drift(pairs: DataFrame, key: str) -> DataFrame:
    """Mean, median, 95th percentile by rank and largest drift of onsets, and differing pitches."""
    w = W.partitionBy(key)
    ranked = pairs.withColumns({"r": F.row_number().over(w.orderBy(F.abs("d_on"), "k")), "n": F.count("*").over(w)})
    at = F.least(F.floor(F.lit(0.95) * F.col("n")).cast("long"), F.col("n") - 1) + 1
    return ranked.groupBy(key, "n").agg(
        F.round(F.avg("d_on"), 6).alias("mean_on"), F.round(F.median("d_on"), 6).alias("median_on"), F.max(F.when(F.col("r") == at, F.abs("d_on"))).alias("p95_on"),
        F.max(F.abs("d_on")).alias("max_on"), F.count_if(F.col("d_pitch") != 0).alias("mismatches"),
    )
