"""Rain classifiers per horizon on Spark ML: fit, calibrate, blend, choose a threshold, score."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..policy import RAIN_THRESHOLD
from . import forests
from .chunks import KEY
from .coherence import check_nested, coherent
from .features import check_onset_features, onset_feature_names
from .labels import onset_weights, split
from .lineage import cut, fresh_path
from .metrics import best_threshold, blend_weight, blended, brier, confusion, holdout_metrics, persistence, sweep

ONSET = "rf_onset"


@dataclass(frozen=True)
class ForestRule:
    """``depth`` and ``trees`` default by kind: 18 and 300 for forests, 5 and 300 for boosted trees."""

    kind: str = "rf"  # rf, rf_onset or gbt
    trees: int = 300
    depth: int | None = None
    min_leaf: int = 2
    seed: int = 42
    blend: bool = False

    @property
    def levels(self) -> int:
        return self.depth if self.depth is not None else 5 if self.kind == "gbt" else 18


@dataclass
class HorizonModel:
    horizon: int
    rule: ForestRule
    features: list[str]
    stages: PipelineModel
    threshold: float
    calibrated: bool
    blend_weight: float
    metrics: dict = field(default_factory=dict)


def class_weights(df: DataFrame, target: str = "target") -> DataFrame:
    """Weight rows so that both classes carry the same mass."""
    n = df.agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("p")).first()
    if not n["p"] or n["p"] == n["n"]:
        raise ValueError("training needs observed rain and dry examples")
    positive, negative = n["n"] / (2.0 * n["p"]), n["n"] / (2.0 * (n["n"] - n["p"]))
    balance = F.when(F.col(target) > 0.5, positive).otherwise(negative)
    return df.withColumn("weight", F.col("weight") * balance if "weight" in df.columns else balance)


def part_counts(parts: DataFrame) -> dict[str, tuple[int, int]]:
    """Rows and positive rows of every part."""
    rows = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("p")).collect()
    return {r["part"]: (r["n"], int(r["p"] or 0)) for r in rows}


def check_parts(counts: dict[str, tuple[int, int]]) -> None:
    """Every part has rows, and those that decide something have both classes."""
    for name in ("train", "calibration", "validation", "test"):
        n, p = counts.get(name, (0, 0))
        if not n:
            raise ValueError(f"the {name} part is empty")
        if name != "test" and p in (0, n):
            raise ValueError(f"the {name} part needs observed rain and dry examples")


def _classifier(rule: ForestRule):
    common = dict(featuresCol="features", labelCol="target", weightCol="weight", seed=rule.seed, minInstancesPerNode=rule.min_leaf)
    if rule.kind == "gbt":
        return GBTClassifier(maxIter=rule.trees, maxDepth=rule.levels, stepSize=0.05, subsamplingRate=0.9, **common)
    # Rows remember their nodes, so a pass does not walk the trees grown so far; with more memory a level takes fewer passes.
    return RandomForestClassifier(
        numTrees=rule.trees, maxDepth=rule.levels, featureSubsetStrategy="sqrt", cacheNodeIds=True, maxMemoryInMB=NODE_MB, **common)


#: Megabytes that a task may hold of node statistics; up to four forests are fitted side by side in an executor.
NODE_MB = 512
#: Most rows of a partition that Spark ML fits a forest on.
PART_ROWS = 1_000_000
#: Most bytes of binned rows that a task may hold: 5 million rows of 202 features.
TASK_BYTES = 700_000_000


def dealt(df: DataFrame, *, side_by_side: bool) -> tuple[DataFrame, int]:
    """The rows stored once in even partitions, and how many fits these leave cores for.

    Every partition sends the statistics of every node, so for forests deep
    enough to have nodes of a few rows, that traffic grows with the partitions
    and not with the rows. Forests are therefore given few partitions, of at
    most ``PART_ROWS`` rows, and groups of their trees are fitted side by side.
    Boosted trees follow one another and take all cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    stored = cut(df.repartition(cores), "examples")
    most = max(1, -(-stored.count() // PART_ROWS))
    parts = most if side_by_side and most < cores else cores
    return (stored.coalesce(parts) if parts < cores else stored), max(1, cores // parts)


class Grove(Transformer):
    """Forests of equal rules fitted side by side, as one forest: ``out`` is the mean over all their trees.

    They are kept in Spark's stored form of a model, one folder each.
    """

    def __init__(self, kind: type, paths: Sequence[str], out: str):
        super().__init__()
        self.kind, self.paths, self.out = kind, list(paths), out
        self._trees = None

    @property
    def forests(self) -> list[Model]:
        """The groups as Spark's own models."""
        return [self.kind.load(p) for p in self.paths]

    def _transform(self, df: DataFrame) -> DataFrame:
        """Rows walk the trees as arrays, a tree at a time for a batch, so that what is read lies close together."""
        spark, out = df.sparkSession, self.out
        if self._trees is None:
            with ThreadPoolExecutor(len(self.paths)) as pool:
                read = list(pool.map(inheritable_thread_target(spark)(lambda p: tree_arrays(p, self.kind)), self.paths))
            self._trees = spark.sparkContext.broadcast([tree for forest in read for tree in forest])
        trees = self._trees

        @F.pandas_udf("double")
        def mean_vote(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in rows:
                yield pd.Series(mean_of_trees(trees.value, batch))

        return df.withColumn(out, mean_vote(vector_to_array("features")))


#: Of a tree by its nodes: feature asked (-1: leaf), threshold, the child of values up to it, the other child, the leaf's vote.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def tree_arrays(path: str, kind: type) -> list[Tree]:
    """The trees of a stored forest; a classifier's leaf votes with its share of class 1."""
    spark = SparkSession.active()
    split, stats = F.col("nodeData.split"), F.col("nodeData.impurityStats")
    vote = stats[1] / (stats[0] + stats[1]) if kind is RandomForestClassificationModel else F.col("nodeData.prediction")
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", F.col("nodeData.id").alias("id"), split["featureIndex"].alias("feature"),
        F.coalesce(F.try_element_at(split["leftCategoriesOrThreshold"], F.lit(1)), F.lit(0.0)).alias("threshold"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"), vote.alias("vote"))
    table = nodes.toArrow().sort_by([("treeID", "ascending"), ("id", "ascending")])
    tree, *columns = (table[c].to_numpy() for c in ("treeID", "feature", "threshold", "left", "right", "vote"))
    ends = np.flatnonzero(np.diff(tree)) + 1
    return list(zip(*[np.split(c, ends) for c in columns]))


def mean_of_trees(trees: Sequence[Tree], rows: Sequence[np.ndarray], most: int = 4096) -> np.ndarray:
    """The mean vote of the trees on each row of features."""
    out = np.zeros(len(rows))
    for at in range(0, len(rows), most):
        values = np.stack(rows[at:at + most])
        width, flat = values.shape[1], values.ravel()
        for feature, threshold, left, right, vote in trees:
            node = np.zeros(len(values), np.int32)
            inside = np.flatnonzero(feature[node] >= 0)
            while len(inside):
                here = node[inside]
                here = np.where(flat[inside * width + feature[here]] <= threshold[here], left[here], right[here])
                node[inside] = here
                inside = inside[feature[here] >= 0]
            out[at:at + most] += vote[node]
    return out / len(trees)


def _grown(estimator, rows: DataFrame, out: str, assemble: Callable[[DataFrame], DataFrame] = lambda df: df) -> Grove:
    """All trees of a forest, in as many groups as there are cores for, each with its own seed.

    Up to ``TASK_BYTES`` each group is grown by a task that holds the bins of
    all rows (:mod:`.forests`). More rows than that are left in partitions,
    and Spark ML fits the groups on them.  ``assemble`` adds the vectors to
    ``rows`` that lack them, so that a sample of rows is drawn before.
    """
    spark, classes = rows.sparkSession, isinstance(estimator, RandomForestClassifier)
    n, trees = rows.count(), estimator.getNumTrees()
    weight = estimator.getWeightCol() if estimator.isDefined(estimator.weightCol) else None

    def values(df: DataFrame) -> DataFrame:
        return forests.as_values(assemble(df), estimator.getFeaturesCol(), estimator.getLabelCol(), weight)

    points = forests.split_points_of(values(forests.sampled(rows, n, estimator.getMaxBins(), estimator.getSeed())), estimator.getMaxBins())
    if whole := n * 8 * forests.Packing(points, estimator.getMaxBins()).words <= TASK_BYTES:
        rule, groups = forests.rule_of(estimator, len(points), classes), spark.sparkContext.defaultParallelism
        ready = cut(forests.binned(values(rows), points, rule.bins).repartition(groups), "examples").coalesce(1)
    else:
        kept = [c for c in (estimator.getFeaturesCol(), estimator.getLabelCol(), weight) if c]
        ready, groups = dealt(assemble(rows).select(*kept), side_by_side=True)
    groups = min(groups, trees)
    shares = [trees // groups + (i < trees % groups) for i in range(groups)]

    def fit(i: int) -> str:
        path, one = fresh_path(spark, "forest"), estimator.copy({estimator.numTrees: shares[i], estimator.seed: estimator.getSeed() + i})
        if whole:
            grow = forests.grower(points, rule, n, range(sum(shares[:i]), sum(shares[:i + 1])))
            ready.mapInArrow(grow, forests.NODES).write.parquet(f"{path}/data")
            forests.describe(spark, path, one, classes, len(points))
        else:
            one.fit(ready).write().save(path)
        return path

    with ThreadPoolExecutor(groups) as pool:
        paths = list(pool.map(inheritable_thread_target(spark)(fit), range(groups)))
    return Grove(RandomForestClassificationModel if classes else RandomForestRegressionModel, paths, out)


def _fitted(rule: ForestRule, train: DataFrame, assemble: Callable[[DataFrame], DataFrame] = lambda df: df) -> Transformer:
    """The classifier of ``train`` (``features, target, weight`` once assembled)."""
    if rule.kind == "gbt":
        return _classifier(rule).fit(dealt(assemble(train).select("features", "target", "weight"), side_by_side=False)[0])
    return _grown(_classifier(rule), train, "raw_probability", assemble)


def _voted(forest: Transformer, df: DataFrame) -> DataFrame:
    out = forest.transform(df)
    if not isinstance(forest, Grove):
        out = out.withColumn("raw_probability", _positive("probability")).drop("rawPrediction", "probability", "prediction")
    return out.drop("features")


def _positive(vector: str) -> Column:
    return vector_to_array(F.col(vector)).getItem(1)


def fit_horizon(rows: DataFrame, features: Sequence[str], horizon: int, target: str, rule: ForestRule = ForestRule()) -> tuple[HorizonModel, DataFrame]:
    """Fit on the earliest part, calibrate on the next, decide on validation, report on test.

    ``rows`` needs station, ``ts``, the features, ``rain_flag`` and, for onset
    models, ``rain_last_60m``; ``target`` names the label.  Returns the model and
    the scored validation and test rows.  Stations too short to be split take no
    part; their number and rows are in the model's metrics.  An empty part, or
    one class alone in training, calibration or validation, is an error.
    """
    features = list(features)
    if rule.kind == ONSET:
        check_onset_features(features)
    keep = [KEY, "ts", "rain_flag", *(["rain_last_60m"] if "rain_last_60m" in rows.columns else []), *features]
    parts = split(rows.select(*dict.fromkeys(keep), F.col(target).cast("double").alias("target")), horizon)
    if rule.kind == ONSET:
        parts = parts.filter((F.col("rain_flag") <= RAIN_THRESHOLD) & (F.col("rain_last_60m") <= RAIN_THRESHOLD))
    parts = cut(parts, "parts")  # read by every tree level and every later stage

    def part(name: str) -> DataFrame:
        return parts.filter(F.col("part") == name)

    counts = part_counts(parts)
    check_parts(counts)
    short = part("too_short").agg(F.count_distinct(KEY).alias("n")).first()["n"]
    train = class_weights(onset_weights(part("train")) if rule.kind == ONSET else part("train"))
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")
    forest = _fitted(rule, train, assembler.transform)

    context = [c for c in ("rain_flag", "rain_last_60m") if c in parts.columns]
    # The trees are walked once: the sigmoid is fitted on stored probabilities, and every later stage reads them.
    raw = _voted(forest, assembler.transform(parts.filter("part in ('calibration', 'validation', 'test')")))
    raw = cut(raw.select(KEY, "ts", "part", *context, "target", "raw_probability"), "raw")
    line = VectorAssembler(inputCols=["raw_probability"], outputCol="_raw")
    sigmoid = LogisticRegression(featuresCol="_raw", labelCol="target", probabilityCol="_cal", rawPredictionCol="_r", predictionCol="_p").fit(
        line.transform(raw.filter("part = 'calibration'")))

    def calibrated(df: DataFrame) -> DataFrame:
        return sigmoid.transform(line.transform(df)).withColumn("calibrated", _positive("_cal")).drop("_raw", "_cal", "_r", "_p")

    judged = cut(calibrated(raw.filter("part in ('validation', 'test')")).select(
        KEY, "ts", "part", *context, F.col("target").alias("observed"), "raw_probability", "calibrated"), "judged")
    judged = judged.withColumn("persistence", persistence())
    valid = judged.filter("part = 'validation'")
    b = brier(valid, [], p="raw_probability", extra={"cal": "calibrated"}).first()
    use_sigmoid = b["cal"] < b["brier"]
    base = F.col("calibrated") if use_sigmoid else F.col("raw_probability")
    judged = judged.withColumn("base_probability", base).withColumn("probability", base)
    weight = 1.0
    if rule.blend and rule.kind != ONSET:
        weight = blend_weight(judged.filter("part = 'validation'"), []).first()["weight"]
        judged = judged.withColumn("probability", blended(F.col("base_probability"), F.col("persistence"), F.lit(weight)))
    chosen = best_threshold(sweep(judged.filter("part = 'validation'"))).first()
    test = judged.filter("part = 'test'")
    facts = {"short_stations": short, "short_rows": counts.get("too_short", (0, 0))[0]}
    facts |= brier(test, [], extra={"raw_brier": "raw_probability", "persistence_brier": "persistence"}).first().asDict()
    facts |= confusion(test, chosen["threshold"]).first().asDict()
    learned = part("train").select(KEY, "ts", "part", *context, F.col("target").alias("observed"))
    cohorts = holdout_metrics(test.unionByName(learned, allowMissingColumns=True), chosen["threshold"])
    facts["cohorts"] = {r["cohort"]: {k: v for k, v in r.asDict().items() if k != "cohort"} for r in cohorts.collect()}
    stages = PipelineModel(stages=[assembler, forest, *([sigmoid] if use_sigmoid else [])])
    return HorizonModel(horizon, rule, features, stages, chosen["threshold"], use_sigmoid, weight, facts), judged


def predict(model: HorizonModel, rows: DataFrame, out: str | None = None) -> DataFrame:
    """Add the calibrated, blended probability of one horizon to any feature frame."""
    out = out or f"p_{model.horizon}m"
    assembler, forest, *sigmoid = model.stages.stages
    df = _voted(forest, assembler.transform(rows))
    p = F.col("raw_probability")
    if sigmoid:
        line = VectorAssembler(inputCols=["raw_probability"], outputCol="_raw")
        df = sigmoid[0].transform(line.transform(df)).withColumn("_p1", _positive("_cal")).drop("_raw", "_cal", "_r", "_p")
        p = F.col("_p1")
    if model.blend_weight < 1:
        p = blended(p, persistence(), F.lit(model.blend_weight))
    return df.withColumn(out, p).drop("raw_probability", "_p1")


def predict_horizons(models: Sequence[HorizonModel], rows: DataFrame, project: bool = True) -> DataFrame:
    """All horizons side by side, made non-decreasing unless told otherwise."""
    for m in models:
        rows = predict(m, rows)
    return coherent(rows, [m.horizon for m in models]) if project else rows


def joint_thresholds(judged: dict[int, DataFrame], key: Sequence[str] = (KEY, "ts")) -> tuple[DataFrame, dict[int, float]]:
    """Project saved horizon predictions jointly and choose thresholds anew on validation.

    All horizons must have been judged on the same rows; a row that one of them
    lacks or repeats is an error.
    """
    horizons = sorted(judged)
    wide = None
    for h in horizons:
        cols = judged[h].select(*key, "part", F.col("probability").alias(f"p_{h}m"), F.col("observed").alias(f"observed_{h}m"))
        wide = cols if wide is None else wide.join(cols, [*key, "part"], "full")
    given = wide.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"p_{h}m").alias(str(h)) for h in horizons]).first()
    counted = [judged[h].agg(F.lit(h).alias("horizon"), F.count(F.lit(1)).alias("n")) for h in horizons]
    sizes = {r["horizon"]: r["n"] for r in reduce(DataFrame.unionByName, counted).collect()}
    if any(given[str(h)] != given["n"] or sizes[h] != given["n"] for h in horizons):
        raise ValueError(f"the horizons were judged on different rows: {sizes}, together {given['n']}")
    wide = cut(coherent(check_nested(wide, horizons), horizons), "joint")
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"p_{h}m").alias("probability"), F.col(f"observed_{h}m").alias("observed")) for h in horizons])
    valid = wide.filter("part = 'validation'").select(F.explode(each).alias("e")).select("e.*")
    chosen = {r["horizon"]: r["threshold"] for r in best_threshold(sweep(valid, ["horizon"]), ["horizon"]).collect()}
    return wide, chosen


def fit_temperature(rows: DataFrame, features: Sequence[str], target: str, trees: int = 100, depth: int = 12, seed: int = 42, memory_mb: int = NODE_MB) -> PipelineModel:
    """Regressor for the temperature some minutes ahead, fitted on the rows that have it and every feature.

    The assembled rows are stored once, and groups of trees are fitted side by
    side (:func:`dealt`). ``memory_mb`` is what a task may hold of node
    statistics: with more nodes a pass the forest needs fewer passes.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    forest = RandomForestRegressor(
        featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed, maxMemoryInMB=memory_mb, cacheNodeIds=True)
    usable = rows.filter(F.col(target).isNotNull() & known(features))
    return PipelineModel(stages=[assembler, _grown(forest, usable, "prediction", assembler.transform)])


def temperature_errors(model: PipelineModel, rows: DataFrame, target: str) -> DataFrame:
    """Mean absolute and squared error of the forecast, and of the present temperature as the forecast, where the target is known."""
    # Rows without a forecast go before the trees are walked: a filter on the forecast would walk them twice.
    judged = predict_temperature(model, rows.filter(F.col(target).isNotNull() & known(model.stages[0].getInputCols())))
    e, q = F.col("temp_forecast") - F.col(target), F.col("temp") - F.col(target)
    return judged.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(F.abs(q)).alias("persistence_mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.avg(q * q)).alias("persistence_rmse"))


def known(features: Sequence[str]) -> Column:
    """Every feature is a number."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features], F.lit(True))


def predict_temperature(model: PipelineModel, rows: DataFrame, out: str = "temp_forecast") -> DataFrame:
    """Every row of ``rows``; the forecast is null where a feature is missing."""
    usable = known(model.stages[0].getInputCols())
    df = model.transform(rows).withColumn(out, F.when(usable, F.col("prediction"))).drop("prediction", "features")
    return df.withColumn("delta", F.col(out) - F.col("temp"))


def default_features(kind: str, names: Sequence[str]) -> list[str]:
    return onset_feature_names(names) if kind == ONSET else list(names)
