"""Isolation forest on one column, after Liu, Ting and Zhou (2008).

A tree over one column is a set of cut points, and the path length of a value summed over all trees is a
step function. The steps are a table, one row for each breakpoint, fitted on a bounded pool of each series;
the rows of a series take theirs from the greatest breakpoint below them, in one sorted merge. All
randomness comes from digests, and path lengths are whole numbers, so that results depend on the rows alone.
"""

from __future__ import annotations

import math
from functools import cache
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.scoring import severity_fixed
from sensorloom.operators.detectors import register_method, register_reader
from sensorloom.operators.ordered import HALO, Ordered, last_rows
from sensorloom.operators.series import profiled, quantiles
from sensorloom.scale import Scale, attach, cut
from sensorloom.schema import DETECT_MIN_POINTS

TREES = 120
SAMPLE = 256
#: rows of a series from which the trees draw, enough for every tree to have its own
POOL = TREES * SAMPLE
SEED = 0
EULER = 0.5772156649
HASH = "_pool_hash"
#: path lengths are counted in millionths of a step
UNIT = 1_000_000
#: hexadecimal digits of a digest that make a number below one
DIGITS = 13


def contamination(threshold: float) -> float:
    return min(0.25, max(0.005, 0.02 * threshold))


def mean_path(n):
    """Expected path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype="float64")
    safe = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(safe - 1) + EULER) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def fraction_of(text: str) -> float:
    """A number from 0 to below 1 that a text determines."""
    return int(md5(text.encode()).hexdigest()[:DIGITS], 16) / 16.0 ** DIGITS


@cache
def cut_fractions() -> np.ndarray:
    """Where every node of every tree cuts between its extremes; a node's children are 2v and 2v + 1."""
    return np.array([[fraction_of(f"{SEED}:{tree}:{node}") for node in range(SAMPLE)] for tree in range(TREES)])


@cache
def leaf_units() -> np.ndarray:
    return np.rint(mean_path(np.arange(SAMPLE + 1)) * UNIT).astype("int64")


def fit(pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Breakpoints of a series, the first at minus infinity, and the path length of all trees above each.

    ``pool`` holds its values in the order of the draw: each tree takes a run of it, the next tree the next
    one, and starts over at its end. All trees grow together, a level at a time. A node is a run of
    its tree's sorted sample; it is cut between its extremes until it holds one value or the depth is reached.
    """
    size = min(SAMPLE, len(pool))
    depth_limit = max(math.ceil(math.log2(max(size, 2))), 1)
    distinct, code = np.unique(pool, return_inverse=True)
    run = (np.arange(TREES)[:, None] * size + np.arange(size)) % len(pool)
    ranks = np.sort(code[run], axis=1)
    width = len(distinct) + 1
    flat = (ranks + np.arange(TREES)[:, None] * width).ravel()
    tree, start, end, node = np.arange(TREES), np.zeros(TREES, int), np.full(TREES, size), np.ones(TREES, int)
    leaves, cuts = [], []
    for depth in range(depth_limit + 1):
        low, high = ranks[tree, start], ranks[tree, end - 1]
        parted = (low < high) & (depth < depth_limit)
        leaves.append((tree[~parted], start[~parted], depth * UNIT + leaf_units()[(end - start)[~parted]]))
        tree, start, end, node = tree[parted], start[parted], end[parted], node[parted]
        least, most = distinct[low[parted]], distinct[high[parted]]
        at = least + cut_fractions()[tree, node] * (most - least)
        at = np.where(at < most, at, least)  # both sides keep a value
        reached = np.searchsorted(distinct, at, side="right")
        middle = np.searchsorted(flat, tree * width + reached, side="left") - tree * size
        cuts.append((tree, middle, at))
        tree, node = np.tile(tree, 2), np.concatenate([2 * node, 2 * node + 1])
        start, end = np.concatenate([start, middle]), np.concatenate([middle, end])
    owner, first, length = (np.concatenate(c) for c in zip(*leaves))
    order = np.lexsort((first, owner))
    owner, length = owner[order], length[order]
    cut_owner, cut_at, edge = (np.concatenate(c) for c in zip(*cuts))
    edge = edge[np.lexsort((cut_at, cut_owner))]
    # within a tree the k-th cut lies between leaves k and k+1
    step = np.diff(length)[owner[1:] == owner[:-1]]
    lowest = length[np.concatenate([[True], owner[1:] != owner[:-1]])].sum()
    order = np.argsort(edge, kind="stable")
    return np.concatenate([[-np.inf], edge[order]]), lowest + np.concatenate([[0], np.cumsum(step[order])])


def paths_of(values: np.ndarray, edges: np.ndarray, paths: np.ndarray) -> np.ndarray:
    """Path length over all trees: that of the greatest breakpoint below each value."""
    return paths[np.searchsorted(edges, values, side="left") - 1]


def raw_score(paths, size):
    """Score of the published algorithm from a path length over all trees and the rows of a tree."""
    return 2.0 ** (-(paths / (TREES * UNIT)) / np.maximum(mean_path(size), 1e-12))


def _key_names(n: int) -> list[str]:
    return [f"_key{i}" for i in range(n)]


def _breakpoints(key: tuple, pool: pd.DataFrame, whole: int) -> pd.DataFrame:
    values = pool.sort_values("rank")["value"].to_numpy()
    edges, paths = fit(values)
    if len(values) < whole:  # every row is in the pool: breakpoints between the same two values count as one
        needed = np.unique(np.searchsorted(edges, np.unique(values), side="left") - 1)
        edges, paths = edges[needed], paths[needed]
    return pd.DataFrame({**dict(zip(_key_names(len(key)), key, strict=True)), "value": edges, "_paths": paths,
                         "_norm": float(max(mean_path(min(SAMPLE, len(values))), 1e-12))})


def pool_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that the trees of each series draw from, with their place (``rank``) in the draw.

    They are the ``POOL`` rows with the lowest digests of ``row_id``; of a series of more than twice as many
    (``n``), of those whose digest lies below a bound that leaves about twice as many, so no task orders more.
    """
    share = F.conv(F.substring(HASH, 1, DIGITS), 16, 10).cast("double") / F.lit(16.0 ** DIGITS)
    near = rows.filter((F.col("n") <= 2 * POOL) | (share < F.lit(2.0 * POOL) / F.col("n")))
    return last_rows(near.select(*keys, HASH, "value"), keys, POOL, [F.col(HASH), F.col("value")]).drop(HASH)


def breakpoints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per breakpoint of each series: ``value``, the path length above it (``_paths``) and ``_norm``."""
    spark = rows.sparkSession
    # fitting costs more than the bytes of a pool suggest: keep the partitions that a size rule would merge
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pool = pool_rows(rows, keys).repartition(parts, *keys)
    kinds = dict(rows.dtypes)
    names = _key_names(len(keys))
    schema = ", ".join([f"{n} {kinds[k]}" for n, k in zip(names, keys, strict=True)] + ["value double", "_paths long", "_norm double"])
    whole = POOL
    fitted = pool.groupBy(*keys).applyInPandas(lambda key, own: _breakpoints(key, own, whole), schema)
    return fitted.withColumnsRenamed(dict(zip(names, keys, strict=True)))


def raw_scores(o: Ordered, rows: DataFrame) -> DataFrame:
    """Add ``raw``, higher for rows that are easier to isolate.

    Breakpoints and rows are sorted together within a series, or within a span of a long one, which gets a
    copy of its series' breakpoints; a row takes the last breakpoint before it.
    """
    rows = rows.withColumn(HASH, F.md5(F.coalesce(F.col("row_id").cast("string"), F.lit(""))))
    marks = breakpoints(rows, o.keys)
    if o.split:
        marks = marks.join(rows.select(*o.partition).distinct(), o.keys)
    both = rows.withColumn("_is_row", F.lit(True)).unionByName(marks.withColumn("_is_row", F.lit(False)), allowMissingColumns=True)
    # a row on a breakpoint lies below it
    below = (Window.partitionBy(*o.partition).orderBy("value", F.desc("_is_row"))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stepped = both.withColumns({c: F.last(c, ignorenulls=True).over(below) for c in ("_paths", "_norm")}).filter("_is_row")
    raw = F.pow(F.lit(2.0), -(F.col("_paths") / F.lit(float(TREES * UNIT))) / F.col("_norm"))
    return stepped.withColumn("raw", raw).drop("_is_row", "_paths", "_norm", HASH)


def forest_columns(o: Ordered, rows: DataFrame, threshold: float, scale: Scale) -> DataFrame:
    """Rows with ``raw`` and, of their series, its mean, deviation and the quantile above which rows are flagged."""
    raw, quantile = raw_scores(o, rows), 1.0 - contamination(threshold)
    if o.split:
        raw = cut(raw)  # scored once, read three times
        scores = raw.select(*o.keys, F.col("raw").alias("value"))
        stats = raw.groupBy(*o.keys).agg(F.avg("raw").alias("_mean"), F.stddev_pop("raw").alias("_std"))
        limits = quantiles(scores, [quantile], o.keys, scale=scale).withColumnRenamed("q0", "_cut")
        return attach(attach(o.done(raw), stats, o.keys, scale, keys_from=o.source), limits, o.keys, scale,
                      keys_from=o.source)
    series = Window.partitionBy(*o.keys)
    return raw.withColumns({"_mean": F.avg("raw").over(series), "_std": F.stddev_pop("raw").over(series),
                            "_cut": F.percentile("raw", F.lit(quantile)).over(series)})


def forest_score() -> tuple[Column, Column]:
    """Whether a row is flagged, and its deviation."""
    return F.col("raw") > F.col("_cut"), F.abs(F.col("raw") - F.col("_mean")) / F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)


def isolation_forest(o: Ordered, threshold: float, window: int, scale: Scale) -> DataFrame:
    """Rows above the series' 1 - contamination quantile of the raw score, scored by its deviation."""
    rows = profiled(o, scale).filter(F.col("value").isNotNull() & (F.col("n") >= DETECT_MIN_POINTS))
    if o.split:
        rows = rows.filter(~F.col(HALO))
    flagged, deviation = forest_score()
    scored = forest_columns(o, rows, threshold, scale).filter(flagged).withColumn("_dev", deviation)
    return scored.withColumn("score", F.greatest("_dev", F.lit(0.5))).withColumn(
        "severity", severity_fixed(F.col("_dev"))).drop("_mean", "_std", "_cut", "_dev", "raw")


def _columns(o: Ordered, rows: DataFrame, threshold: float, window: int, scale: Scale) -> DataFrame:
    """For ``side_by_side``: too short series are scored as well and left out by ``_read``."""
    return forest_columns(o, rows.filter(F.col("value").isNotNull()), threshold, scale)


def _read(threshold: float) -> tuple[Column, Column]:
    flagged, deviation = forest_score()
    keep = flagged & (F.col("n") >= DETECT_MIN_POINTS)
    return F.when(keep, F.greatest(deviation, F.lit(0.5))), severity_fixed(deviation)


register_method("isolation_forest", isolation_forest)
register_reader("isolation_forest", _columns, _read)
