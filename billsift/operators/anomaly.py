"""Vendor-relative features and Isolation Forest anomaly scores.

Preparation is plain DataFrame work. Every tree is grown in its own task from a
bounded sample, and scoring is an Arrow-batched pass against the forest, whose size
depends on the number of trees only.

Nothing is left to chance or to the order of additions: samples, features and thresholds
come from digests of row ids and node numbers, scaled features are compared to nine
decimals, and depths are whole numbers. The same rows give the same scores on any
cluster, and SQL can state the same forest level by level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from billsift.functions.frames import beside
from billsift.session import cut_lineage, discard

# Names and order of the features.
FEATURES = ("quantity", "unit_price", "total_amount", "vendor_avg_price_ratio")
# Size of the forest and assumed share of outliers.
TREES = 200
CONTAMINATION = 0.2
MAX_CONTAMINATION = 0.4
SEED = 42
#: Rows a tree is grown from unless ``fit`` is told otherwise: the bound that makes the method isolate.
SAMPLE = 256

_BINS_PER_DOUBLING = 512
_SLICES = 4096
_HASH_RANGE = 1 << 32
#: Rows offered to the trees, as a multiple of the rows that all trees together take.
POOL = 2
#: Decimals to which scaled features are compared, and parts of a step in which depths are counted.
FEATURE_DECIMALS = 9
DEPTH_PARTS = 1_000_000


# -- features ----------------------------------------------------------------


def coerce_numbers(rows: DataFrame) -> DataFrame:
    """Numbers or null; text that is no number and NaN become null."""
    out = rows
    for name in FEATURES[:3]:
        value = F.col(name).try_cast("double")
        out = out.withColumn(name, F.when(~F.isnan(value), value))
    return out


def with_price_ratio(rows: DataFrame) -> DataFrame:
    """Unit price over the vendor's mean unit price.

    A zero mean gives 1, or null for a zero price; no vendor gives null.
    """
    means = (
        rows.filter(F.col("vendor_name").isNotNull())
        .groupBy("vendor_name")
        .agg(F.avg("unit_price").alias("vendor_mean"))
    )
    price, mean = F.col("unit_price"), F.col("vendor_mean")
    ratio = F.when(mean == 0, F.when(price != 0, F.lit(1.0))).otherwise(price / mean)
    return (
        rows.join(means, "vendor_name", "left")
        .withColumn("vendor_avg_price_ratio", ratio)
        .drop("vendor_mean")
    )


def _long(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    long = rows.select(F.inline(pairs)).filter(F.col("value").isNotNull())
    scaled = F.signum("value") * F.log2(F.abs(F.col("value")) + 1) * _BINS_PER_DOUBLING
    return long.withColumn("bin", F.floor(scaled))


def _middle(counted: DataFrame, part: str, groups: list[str]) -> DataFrame:
    """Parts of each group that hold the middle ranks; at most two per feature.

    ``counted`` has one row per part with its size ``n``, the number of values before
    the group and the total of the feature.
    """
    running = Window.partitionBy(*groups).orderBy(part)
    placed = counted.withColumn("before", F.col("before") + F.sum("n").over(running) - F.col("n"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)

    def holds(rank: Column) -> Column:
        return (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))

    return placed.filter(holds(low) | holds(high)).drop("n")


def medians(rows: DataFrame, columns: tuple[str, ...] = FEATURES, stored: bool = False) -> DataFrame:
    """Exact medians, one row (feature, median) each, without sorting all values.

    Values are counted into bins of growing width; the one or two bins that hold the
    middle ranks are cut into equal slices, and only the distinct values of the middle
    slices are put in order. Bins and slices are few, whatever the size of the data.
    The columns are read three times: they are stored first unless the rows are ``stored``.
    """
    long = _long(rows if stored else cut_lineage(rows.select(*columns)), columns)
    size = F.count(F.lit(1)).alias("n")
    bins = long.groupBy("feature", "bin").agg(
        size, F.min("value").alias("least"), F.max("value").alias("most")
    )
    totals = F.sum("n").over(Window.partitionBy("feature"))
    bins = _middle(bins.withColumns({"total": totals, "before": F.lit(0).cast("bigint")}), "bin", ["feature"])

    spread = F.col("most") - F.col("least")
    slice_no = F.when(spread > 0, F.floor((F.col("value") - F.col("least")) / spread * _SLICES)).otherwise(0)
    # Broadcast sides have at most two rows per feature.
    sliced = long.join(F.broadcast(bins), ["feature", "bin"]).withColumn("slice", slice_no)
    keys = ["feature", "bin", "total", "before"]
    slices = _middle(sliced.groupBy(*keys, "slice").agg(size), "slice", ["feature", "bin"])

    values = sliced.drop("before", "total").join(F.broadcast(slices), ["feature", "bin", "slice"])
    counted = values.groupBy(*keys, "slice", "value").agg(size)
    middle = _middle(counted, "value", ["feature", "bin", "slice"])
    return middle.groupBy("feature").agg(F.avg("value").alias("median"))


def _one_row(long: DataFrame, value: str, columns: tuple[str, ...], suffix: str) -> DataFrame:
    return long.agg(
        *[F.max(F.when(F.col("feature") == c, F.col(value))).alias(f"{c}{suffix}") for c in columns]
    )


def fill_medians(rows: DataFrame, columns: tuple[str, ...] = FEATURES, stored: bool = False) -> DataFrame:
    single = _one_row(medians(rows, columns, stored), "median", columns, "_median")
    filled = beside(rows, single)
    for c in columns:
        filled = filled.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"{c}_median")))
    return filled.drop(*[f"{c}_median" for c in columns])


def build_features(rows: DataFrame) -> DataFrame:
    return fill_medians(cut_lineage(with_price_ratio(coerce_numbers(rows))), stored=True)


def scaler(features: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row with mean and population deviation of each feature."""
    parts = []
    for c in columns:
        parts += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return features.agg(*parts)


def scale(features: DataFrame, fitted: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    out = beside(features, fitted)
    for c in columns:
        spread = F.col(f"{c}_std")
        centred = F.col(c) - F.col(f"{c}_mean")
        out = out.withColumn(c, F.when(spread == 0, F.lit(0.0)).otherwise(centred / spread))
    return out.drop(*[f"{c}_{part}" for c in columns for part in ("mean", "std")])


def _compared(scaled: DataFrame) -> DataFrame:
    """Features as the trees compare them; adding zero turns a negative zero into a plain one."""
    return scaled.withColumns({c: F.round(c, FEATURE_DECIMALS) + F.lit(0.0) for c in FEATURES})


# -- forest ------------------------------------------------------------------

_NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, path long, sample int"
)


@dataclass(frozen=True)
class Forest:
    """Node table, scaler row, and the depth found at fit time below which a row is an outlier."""

    nodes: DataFrame
    scaler: DataFrame
    offset: int


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` leaves."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _share(*parts) -> float:
    """A number from 0 to below 1 that the parts alone decide."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / _HASH_RANGE


def _drawn(*parts: str) -> str:
    """SQL for the whole number behind ``_share`` of SQL texts."""
    return f"cast(conv(substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8), 16, 10) as bigint)"


def _grow_tree(pdf: pd.DataFrame, sample: int) -> pd.DataFrame:
    """Isolation tree over one bounded sample. The children of place p are places 2p and 2p + 1."""
    tree = int(pdf["tree"].iloc[0])
    chosen = pdf.sort_values(["draw", "row_id"]).head(sample)
    x = chosen[list(FEATURES)].to_numpy(dtype=float)
    limit = ceil(log2(max(len(x), 2)))
    nodes = []
    todo = [(0, 1, np.arange(len(x)), 0)]
    issued = 1
    while todo:
        node, place, rows, depth = todo.pop()
        spread = np.flatnonzero(np.ptp(x[rows], axis=0) > 0) if len(rows) > 1 else []
        if depth >= limit or len(spread) == 0:
            path = round(DEPTH_PARTS * (depth + average_path(len(rows))))
            nodes.append((tree, node, -1, 0.0, -1, -1, path, len(x)))
            continue
        feature = int(spread[int(_share(SEED, tree, place, "feature") * len(spread))])
        values = x[rows, feature]
        low, high = values.min(), values.max()
        threshold = low + _share(SEED, tree, place, "threshold") * (high - low)
        threshold = low if threshold >= high else threshold
        goes_left = values <= threshold
        left, right = issued, issued + 1
        issued += 2
        nodes.append((tree, node, feature, threshold, left, right, 0, len(x)))
        todo += [(left, 2 * place, rows[goes_left], depth + 1), (right, 2 * place + 1, rows[~goes_left], depth + 1)]
    names = [part.split()[0] for part in _NODE_SCHEMA.split(", ")]
    return pd.DataFrame(nodes, columns=names)


def _tree_samples(scaled: DataFrame, total: int, trees: int, sample: int) -> DataFrame:
    """Samples of about 1.3 times the tree size, drawn by digest in one pass.

    A first draw leaves a pool of bounded size, whose rows are offered to every tree.
    """
    share = min(1.0, 1.3 * sample / max(total, 1))
    kept = min(1.0, float(POOL) * trees * sample / max(total, 1))
    key = "cast(row_id as string)"
    first = F.expr(_drawn(f"'{SEED}'", key)) < int(kept * _HASH_RANGE)
    limit = int(min(1.0, share / kept) * _HASH_RANGE)
    hits = F.expr(
        f"filter(transform(sequence(0, {trees - 1}), t -> struct(t as tree, "
        f"{_drawn(key, 'cast(t as string)')} as draw)), s -> s.draw < {limit}L)"
    )
    return scaled.filter(first).select("row_id", *FEATURES, F.inline(hits))


def _grow(scaled: DataFrame, total: int, trees: int, sample: int) -> DataFrame:
    return _tree_samples(scaled, total, trees, sample).groupBy("tree").applyInPandas(
        lambda rows: _grow_tree(rows, sample), _NODE_SCHEMA
    )


@dataclass(frozen=True)
class _Filled:
    """Trees of one depth: level d of a tree has 2**d places, and the children of place p are 2p and 2p + 1.

    ``features`` and ``thresholds`` hold one array (tree, place) per level, ``paths`` the places below the last one.
    Below a leaf all places have its path.
    """

    features: list[np.ndarray]
    thresholds: list[np.ndarray]
    paths: np.ndarray

    def depths(self, x: np.ndarray, trees_at_once: int = 16) -> np.ndarray:
        """Path lengths summed over the trees for every row of ``x`` (feature, row)."""
        rows = x.shape[1]
        flat, row = np.ascontiguousarray(x).reshape(-1), np.arange(rows)
        out = np.zeros(rows, np.int64)
        for begin in range(0, len(self.paths), trees_at_once):
            trees = slice(begin, begin + trees_at_once)
            # Place in the level's array of all these trees, one row per tree.
            place = np.repeat(np.arange(len(self.paths[trees]))[:, None], rows, axis=1)
            at, value, bound = np.empty_like(place), np.empty(place.shape), np.empty(place.shape)
            right = np.empty(place.shape, bool)
            for features, thresholds in zip(self.features, self.thresholds, strict=True):
                # Indices are never out of range; "clip" lets numpy write into the buffers directly.
                (features[trees] * rows).reshape(-1).take(place, out=at, mode="clip")
                at += row
                flat.take(at, out=value, mode="clip")
                thresholds[trees].reshape(-1).take(place, out=bound, mode="clip")
                np.logical_not(np.less_equal(value, bound, out=right), out=right)
                place *= 2
                place += right
            self.paths[trees].reshape(-1).take(place, out=at, mode="clip")
            out += at.sum(axis=0)
        return out


def _filled(table: pd.DataFrame) -> _Filled:
    """The node table, ordered by tree and node, as trees of one depth."""
    trees = []
    deepest = 0
    for _, nodes in table.groupby("tree", sort=True):
        cells = {r.node: r for r in nodes.itertuples()}
        placed, todo = [], [(0, 0, 0)]
        while todo:
            node, level, place = todo.pop()
            cell = cells[node]
            placed.append((level, place, cell))
            if cell.feature >= 0:
                todo += [(cell.left, level + 1, 2 * place), (cell.right, level + 1, 2 * place + 1)]
            deepest = max(deepest, level)
        trees.append(placed)
    features = [np.zeros((len(trees), 1 << d), np.int64) for d in range(deepest)]
    thresholds = [np.zeros((len(trees), 1 << d)) for d in range(deepest)]
    paths = np.zeros((len(trees), 1 << deepest), np.int64)
    for tree, placed in enumerate(trees):
        for level, place, cell in placed:
            if cell.feature >= 0:
                features[level][tree, place] = cell.feature
                thresholds[level][tree, place] = cell.threshold
            else:
                below = deepest - level
                paths[tree, place << below : (place + 1) << below] = cell.path
    return _Filled(features, thresholds, paths)


def _path_lengths(scaled: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``depth`` (summed over the trees, in parts of a step) and ``isolation`` (0..1, higher is more anomalous).

    The forest has at most 2 x trees x sample nodes, so it is shipped to every task.
    """
    table = nodes.orderBy("tree", "node").toPandas()
    forest = _filled(table)
    norm = average_path(float(table.groupby("tree")["sample"].first().mean())) if len(table) else 1.0
    packed = scaled.sparkSession.sparkContext.broadcast(forest)

    def depth(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.stack([s.to_numpy(dtype=float) for s in columns])
            parts = [packed.value.depths(x[:, begin : begin + 2000]) for begin in range(0, x.shape[1], 2000)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    found = scaled.withColumn("depth", F.pandas_udf(depth, "long")(*[F.col(c) for c in FEATURES]))
    mean = F.col("depth") / float(DEPTH_PARTS * max(len(forest.paths), 1))
    return found.withColumn("isolation", F.pow(F.lit(2.0), -mean / (norm or 1.0)))


def _depth_at(depths: DataFrame, rank: int) -> int:
    """The depth of the row with this rank from the deepest: three rounds of counting in equal parts."""
    prefix = None
    for shift in (24, 12, 0):
        part = F.shiftright("depth", shift)
        held = depths if prefix is None else depths.filter(F.shiftright("depth", shift + 12) == prefix)
        # A part has 4096 parts at most.
        counts = sorted(map(tuple, held.groupBy(part.alias("part")).agg(F.count(F.lit(1))).collect()), reverse=True)
        for prefix, n in counts:
            if n >= rank:
                break
            rank -= n
    return prefix


def _offset(depths: DataFrame, contamination: float) -> int:
    """The depth that the assumed share of outliers lies below, exactly."""
    rank = max(1, ceil((1.0 - min(contamination, MAX_CONTAMINATION)) * depths.count()))
    return _depth_at(depths, rank)


def _fit_features(
    features: DataFrame, trees: int, contamination: float, sample: int = SAMPLE
) -> tuple[Forest, DataFrame]:
    """Forest and the isolation of its training rows."""
    total = features.count()
    if total < 2:
        raise ValueError("need at least 2 rows to train the forest")
    fitted = cut_lineage(scaler(features))
    scaled = _compared(scale(features, fitted))
    # Pin the forest: growing it again for the next use would be wasted work.
    nodes = cut_lineage(_grow(scaled, total, trees, sample))
    isolation = cut_lineage(_path_lengths(scaled, nodes).select("row_id", "depth", "isolation"))
    return Forest(nodes, fitted, _offset(isolation, contamination)), isolation


def _stored_features(rows: DataFrame, used: tuple[DataFrame, ...] = ()) -> DataFrame:
    """row_id and the filled features, stored. Of the rows only what they are made from is stored on the way."""
    raw = cut_lineage(rows.select("row_id", "vendor_name", *FEATURES[:3]))
    discard(*used)
    prepared = cut_lineage(with_price_ratio(coerce_numbers(raw)).drop("vendor_name"))
    discard(raw)
    features = cut_lineage(fill_medians(prepared, stored=True).select("row_id", *FEATURES))
    discard(prepared)
    return features


def fit(
    rows: DataFrame, trees: int = TREES, contamination: float = CONTAMINATION, sample: int = SAMPLE
) -> Forest:
    """Fit scaler and forest on rows with a unique row_id, vendor_name and the raw numbers.

    Each tree sees ``sample`` rows drawn by hash; scaler and offset cover all rows.
    """
    features = _stored_features(rows)
    model = _fit_features(features, trees, contamination, sample)[0]
    discard(features)
    return model


def save(model: Forest, path: str) -> None:
    model.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    model.scaler.withColumn("offset", F.lit(model.offset)).write.mode("overwrite").parquet(f"{path}/scaler")


def load(spark: SparkSession, path: str) -> Forest:
    stored = spark.read.parquet(f"{path}/scaler")
    return Forest(
        spark.read.parquet(f"{path}/nodes"), stored.drop("offset"), stored.first()["offset"]
    )


def scores(rows: DataFrame, model: Forest | None = None, used: tuple[DataFrame, ...] = ()) -> DataFrame:
    """row_id, ml_risk_score (0..100 over the scored rows) and ml_flag.

    Fits on the rows themselves when there is no model. Fewer than two rows score 0. ``rows`` is read once;
    stored tables in ``used``, which nothing else needs, are discarded then.
    """
    features = _stored_features(rows, used)
    if len(features.take(2)) < 2:
        return features.select("row_id", F.lit(0.0).alias("ml_risk_score"), F.lit(False).alias("ml_flag"))
    if model is None:
        model, raw = _fit_features(features, TREES, CONTAMINATION)
        discard(features)
    else:
        raw = _path_lengths(_compared(scale(features, model.scaler)), model.nodes).select("row_id", "depth", "isolation")
    span = raw.agg(F.min("isolation").alias("least"), F.max("isolation").alias("most"))
    # decision = offset - isolation, so the most isolated row has the lowest decision value.
    position = (F.col("isolation") - F.col("least")) / (F.col("most") - F.col("least") + 1e-9)
    return beside(raw, span).select(
        "row_id",
        F.round(position * 100, 1).alias("ml_risk_score"),
        (F.col("depth") < model.offset).alias("ml_flag"),
    )


def score(rows: DataFrame, model: Forest | None = None) -> DataFrame:
    """Adds the columns of ``scores``; ``rows`` is read twice."""
    return rows.join(scores(rows, model), "row_id")
