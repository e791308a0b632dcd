"""Selection of scored segments to illustrate, and the states of their editors.

Segments are ``doc, id, ord, y, score``: ``ord`` is document order, ``y`` the vertical centre in
pages. Picks look ahead from one segment to the next, so a document is the unit of parallel work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_GAP, MAX_GAP, MIN_SCORE, LEAST_GAP = 1.5, 8.0, 0.25, 0.5  # fixed values: defaults, in pages


def y_centre(polygons: Column, aspect: float = 1.0) -> Column:
    """SEL3: the mean over pages of page number and middle of the polygon's heights, by the page's
    aspect ratio; null without pages. ``polygons`` is map<page, array<array<x, y>>>."""
    middles = F.transform(F.map_entries(polygons), lambda e: e["key"] + (F.array_min(F.transform(e["value"], lambda p: p[1])) + F.array_max(F.transform(e["value"], lambda p: p[1]))) / 2)
    return F.try_divide(F.aggregate(middles, F.lit(0.0), lambda a, x: a + x), F.size(polygons)) * aspect


def picks(y: np.ndarray, score: np.ndarray, low: float, high: float, least: float) -> list[int]:
    """SEL1 for one document: places of the chosen segments. From each start, the best of the window up
    to ``high`` below it ends the stretch of candidates; by falling score those are kept that lie
    more than ``low`` from the kept ones; the scan goes on beyond the last one kept."""
    out: list[int] = []
    i, n = 0, len(y)
    while i < n:
        end = i
        while end < n and y[end] - y[i] <= high:
            end += 1
        fit = [j for j in range(i, end) if score[j] >= least]
        if np.isnan(y[i]) or not fit:
            i += 1
            continue
        best = max(fit, key=lambda j: (score[j], -j))
        kept: list[int] = []
        for j in sorted((j for j in fit if j <= best), key=lambda j: (-score[j], y[j])):
            if all(abs(y[j] - y[k]) > low for k in kept):
                kept.append(j)
        out += kept
        i = last = max(kept)
        i += 1
        while i < n and y[i] - y[last] <= low:
            i += 1
    return out


def selected(segments: DataFrame, min_gap: float = MIN_GAP, max_gap: float = MAX_GAP, least: float = MIN_SCORE) -> DataFrame:
    """SEL1: ``doc, id`` of the segments to illustrate; unscored segments are left out first."""
    low = max(min_gap, LEAST_GAP)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord", kind="stable")
        rows = picks(frame["y"].to_numpy(float), frame["score"].to_numpy(float), low, max_gap, least)
        return frame.iloc[rows][["doc", "id"]]

    rows = segments.filter("score IS NOT NULL").select("doc", "id", "ord", "y", "score")
    return rows.groupBy("doc").applyInPandas(run, rows.select("doc", "id").schema)


def most_selectable(segments: DataFrame, min_gap: float = MIN_GAP, least: float = MIN_SCORE) -> DataFrame:
    """SEL2: ``doc, most``: the earliest pick, then the earliest one after the stretch inside its gap,
    as a fold inside the JVM. What has no position or score enough is passed over and ends no gap
    once one was left."""
    low = max(min_gap, LEAST_GAP)
    rows = segments.filter("score IS NOT NULL").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("y").cast("double").alias("y"), "score"))).alias("a"))
    start = F.struct(F.lit(None).cast("double").alias("gap_of"), F.lit(0).alias("n"))

    def step(s, x):
        inside = F.coalesce(x["y"] - s["gap_of"] <= low, F.lit(False))
        fits = (x["score"] >= least) & x["y"].isNotNull()
        free = F.struct(F.when(fits, x["y"]).alias("gap_of"), (s["n"] + fits.cast("int")).alias("n"))
        return F.when(inside, s).otherwise(free)

    return rows.select("doc", F.aggregate("a", start, step, lambda s: s["n"]).alias("most"))


def catch_up(chosen: DataFrame, known: DataFrame) -> DataFrame:
    """SEL4: chosen ids with ``action``: new ones, and known ones whose enhancement or image was
    switched on since. ``known`` has ``doc, id, enhanced, generated``."""
    joined = chosen.join(known, ["doc", "id"], "left")
    action = F.when(F.col("enhanced").isNull() & F.col("generated").isNull(), "new").when(~F.col("enhanced") & ~F.col("generated"), "enhance+generate").when(~F.col("enhanced"), "enhance").when(~F.col("generated"), "generate")
    return joined.select("doc", "id", action.alias("action")).filter("action IS NOT NULL")


def page_window(ratios: DataFrame, pages: int, preload: int = 3) -> DataFrame:
    """SEL5: ``doc, page, first, last``: the page that shows most (of equal ones the last) and the
    pages to load around it."""
    page = F.max_by("page", F.struct("ratio", "page"))
    return ratios.groupBy("doc").agg(page.alias("page")).select("doc", "page", F.greatest(F.col("page") - preload, F.lit(1)).alias("first"), F.least(F.col("page") + preload, F.lit(pages)).alias("last"))


def toggled(queue: DataFrame, keys: tuple[str, ...] = ("id", "prompt")) -> DataFrame:
    """SEL6: what stays queued when putting the same entry in again takes it out."""
    return queue.groupBy(*keys).agg(F.count("*").alias("n")).filter("n % 2 = 1").select(*keys)


def batch_plan(throughput: Column, most: int = 8) -> tuple[Column, Column]:
    """SEL7: batch size and interval in milliseconds for a number of things a second."""
    whole = lambda c: F.floor(c + 0.5).cast("int")
    size = F.when(throughput >= most, most).when(throughput >= 1, whole(throughput)).otherwise(1)
    wait = F.when(throughput >= most, whole(1000 * most / throughput)).when(throughput >= 1, 1000).otherwise(whole(F.try_divide(F.lit(1000.0), throughput)))
    return size.cast("int"), wait.cast("int")


def editor_states(changes: DataFrame) -> DataFrame:
    """SEL8: open editors from changes ``doc, id, at, kind, has_image``: the latest state of each that
    was not closed since. Opening an open one again changes nothing."""
    closed = F.max(F.when(F.col("kind") == "close", F.col("at"))).over(W.partitionBy("doc", "id"))
    live = changes.withColumn("closed", closed).filter("kind <> 'close' AND (closed IS NULL OR at > closed)")
    return live.groupBy("doc", "id").agg(F.coalesce(F.max_by(F.when(F.col("kind") == "update", F.col("has_image")), F.when(F.col("kind") == "update", F.col("at"))), F.lit(False)).alias("has_image"))
