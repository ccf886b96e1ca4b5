"""Classifiers, ensembles and their cross-validation on pyspark.ml.

A learner is a name and a way to build pipeline stages for a given training table. Scaling and feature
selection are stages of that pipeline, so inside a fold they see the fold's training rows only.

Input tables have ``doc_id``, a vector ``features`` and a double ``label`` (class index). They are read
many times, so write them first with ``storage.materialize``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool
from threading import Lock

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import Normalizer, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.functions.names import quoted
from inkprint.operators.evaluation import PREDICTED, TRUE, per_class
from inkprint.operators.labels import LabelEncoder, decode_predictions
from inkprint.operators.networks import SIDE_BY_SIDE, Network, accuracies, blocks, descend, ways
from inkprint.operators.profile import summarize_folds
from inkprint.operators.sampling import stratified_folds
from inkprint.operators.scaling import reduction_stages
from inkprint.sources.sinks import write_csv
from inkprint.storage import materialize, scratch_path, set_checkpoints

SCORES = "model string, fold bigint, score double"
REPORT_COLUMNS = ("label", "precision", "recall", "f1", "support", "tp")
ZOO = (
    "model string, feature_set string, accuracy double, status string, "
    "report array<struct<label: string, precision: double, recall: double, f1: double, support: bigint>>"
)


@dataclass(frozen=True)
class Learner:
    """A classifier recipe. ``params`` are the recipe's own arguments; ``reduce`` is an optional
    (method, n) feature reduction, fitted with the model."""

    name: str
    recipe: str
    params: dict = field(default_factory=dict)
    reduce: tuple[str, int] | None = None


def logistic_regression(name: str = "LogisticRegression", **params) -> Learner:
    """L2-regularised multinomial regression; ``c`` is the inverse strength, relative to the row count."""
    return Learner(name, "logistic", {"max_iter": 1000, "c": 1.0, **params})


# The recipes' settings; 30 is the deepest tree Spark grows.
def random_forest(name: str = "RandomForest", **params) -> Learner:
    return Learner(name, "forest", {"trees": 100, "max_depth": 30, "seed": 42, "scale": False, **params})


def neural_network(name: str = "NeuralNetwork", **params) -> Learner:
    return Learner(name, "network", {"hidden": (100,), "max_iter": 500, "step": 0.03, "seed": 42, **params})


def boosted_trees(name: str = "BoostedTrees", **params) -> Learner:
    """Gradient-boosted trees, one binary model per class, probabilities scaled to sum 1."""
    return Learner(name, "boosted", {"rounds": 100, "max_depth": 5, "seed": 42, "scale": False, **params})


def voting(members: Sequence[Learner], name: str = "Voting") -> Learner:
    """Mean of the members' class probabilities."""
    return Learner(name, "voting", {"members": tuple(members)})


def stacking(
    members: Sequence[Learner], name: str = "Stacking", folds: int = 5, key: str = "doc_id", **meta
) -> Learner:
    """A logistic regression on the members' out-of-fold class probabilities; rows are told apart by ``key``."""
    return Learner(name, "stacking", {"members": tuple(members), "folds": folds, "key": key, "meta": meta})


# --- fitted models --------------------------------------------------------------------------------


def _argmax(probability: Column) -> Column:
    values = vector_to_array(probability)
    return (F.array_position(values, F.array_max(values)) - 1).cast("double")


@dataclass
class Fitted:
    """A fitted learner. ``transform`` adds ``<prefix>probability`` and ``<prefix>prediction``."""

    kind: str
    pipeline: PipelineModel | None = None
    members: list[Fitted] = field(default_factory=list)
    n_classes: int = 0

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        keep = [F.col(quoted(c)) for c in df.columns]
        if self.kind == "pipeline":
            out = self.pipeline.transform(df)
            probability, prediction = F.col("probability"), F.col("prediction")
        elif self.kind == "boosted":
            out = self.pipeline.transform(df)
            probability, prediction = F.col("_shares"), _argmax(F.col("_shares"))
        else:
            out = self._member_probabilities(df)
            if self.kind == "stacking":
                out = self.pipeline.transform(_meta_features(out, len(self.members)))
                probability, prediction = F.col("_meta_probability"), F.col("_meta_prediction")
            else:
                # Members are classes-long vectors; their mean is taken entry by entry.
                arrays = [vector_to_array(f"_m{i}_probability") for i in range(len(self.members))]
                mean = F.array(
                    *[sum((F.get(a, F.lit(c)) for a in arrays), F.lit(0.0)) / len(arrays) for c in range(self.n_classes)]
                )
                out = out.withColumn("_mean", array_to_vector(mean))
                probability, prediction = F.col("_mean"), _argmax(F.col("_mean"))
        return out.select(*keep, probability.alias(f"{prefix}probability"), prediction.alias(f"{prefix}prediction"))

    def _member_probabilities(self, df: DataFrame) -> DataFrame:
        """All members applied one after the other in the same stage: no join of their outputs."""
        for i, member in enumerate(self.members):
            df = member.transform(df, f"_m{i}_").drop(f"_m{i}_prediction")
        return df

    def save(self, spark: SparkSession, path: str) -> None:
        row = [(self.kind, len(self.members), self.n_classes, self.pipeline is not None)]
        spark.createDataFrame(row, "kind string, members int, n_classes int, pipeline boolean").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/about")
        if self.pipeline is not None:
            self.pipeline.write().overwrite().save(f"{path}/pipeline")
        for i, member in enumerate(self.members):
            member.save(spark, f"{path}/member-{i}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Fitted:
        about = spark.read.parquet(f"{path}/about").first()
        pipeline = PipelineModel.load(f"{path}/pipeline") if about["pipeline"] else None
        members = [cls.load(spark, f"{path}/member-{i}") for i in range(about["members"])]
        return cls(about["kind"], pipeline, members, about["n_classes"])


def _meta_features(df: DataFrame, n_members: int) -> DataFrame:
    names = [f"_m{i}_probability" for i in range(n_members)]
    return VectorAssembler(inputCols=names, outputCol="_meta").transform(df)


def class_count(df: DataFrame) -> int:
    return int(df.agg(F.max("label")).first()[0]) + 1


def _prepared(learner: Learner, train: DataFrame) -> tuple[list, str, int]:
    """Scaling and reduction stages, the column they end in, and its width."""
    width = len(train.select("features").first()["features"])
    stages, column = [], "features"
    if learner.params.get("scale", True):
        # Sparse vectors stay sparse if they are not centred.
        centre = learner.params.get("centre", True)
        stages.append(StandardScaler(inputCol=column, outputCol="_scaled", withMean=centre, withStd=True))
        column = "_scaled"
    if learner.reduce:
        method, n = learner.reduce
        reducers = reduction_stages(method, n, width, column, "_reduced")
        if reducers:
            stages, column, width = stages + reducers, "_reduced", min(n, width)
    return stages, column, width


def fit(learner: Learner, train: DataFrame, n_classes: int | None = None, key: str | None = None) -> Fitted:
    """Fit a learner on (features, label). ``key`` names the column that tells rows apart, for learners with inner folds."""
    n_classes = class_count(train) if n_classes is None else n_classes
    p = learner.params
    if learner.recipe == "voting":
        return Fitted("voting", None, _side_by_side(p["members"], train, n_classes, key), n_classes)
    if learner.recipe == "stacking":
        return _fit_stacking(learner, train, n_classes, key or p["key"])
    stages, column, width = _prepared(learner, train)
    if learner.recipe == "logistic":
        strength = 1.0 / (p["c"] * max(1, train.count()))
        stages.append(
            LogisticRegression(
                featuresCol=column, maxIter=p["max_iter"], regParam=strength, standardization=False, family="multinomial"
            )
        )
    elif learner.recipe == "forest":
        # Without cached node ids every pass sends every row through all levels of every tree again. The trees are the same.
        set_checkpoints(train.sparkSession)
        stages.append(
            RandomForestClassifier(
                featuresCol=column, numTrees=p["trees"], maxDepth=p["max_depth"], seed=p["seed"], cacheNodeIds=True,
                checkpointInterval=p.get("checkpoint", 10),
            )
        )
    elif learner.recipe == "network":
        stages.append(
            MultilayerPerceptronClassifier(
                featuresCol=column, layers=[width, *p["hidden"], n_classes], maxIter=p["max_iter"],
                stepSize=p["step"], seed=p["seed"],
            )
        )
    elif learner.recipe == "boosted":
        return _fit_boosted(learner, train, stages, column, n_classes)
    else:
        raise ValueError(f"unknown recipe {learner.recipe!r}")
    return Fitted("pipeline", Pipeline(stages=stages).fit(train), [], n_classes)


def _fit_boosted(learner: Learner, train: DataFrame, stages: list, column: str, n_classes: int) -> Fitted:
    """One binary model per class, fitted side by side. What the rounds build on is checkpointed on the way, so that neither plans
    nor a lost executor's work grow with the number of rounds."""
    p = learner.params
    spark = train.sparkSession
    set_checkpoints(spark)
    prepared = Pipeline(stages=stages).fit(train)
    ready = prepared.transform(train).select(column, "label")
    if stages:
        ready = materialize(ready, "boost")

    def one(c: int):
        own = f"_is_{c}"
        gbt = GBTClassifier(
            featuresCol=column, labelCol=own, predictionCol=f"_pred_{c}", maxIter=p["rounds"],
            maxDepth=p["max_depth"], seed=p["seed"], checkpointInterval=p.get("checkpoint", 10),
        )
        gbt.setRawPredictionCol(f"_raw_{c}").setProbabilityCol(f"_prob_{c}")
        return gbt.fit(ready.withColumn(own, (F.col("label") == c).cast("double")))

    with ThreadPool(min(4, n_classes)) as pool:
        models = pool.map(inheritable_thread_target(spark)(one), range(n_classes))
    fitted, scores = list(prepared.stages), []
    for c, model in enumerate(models):
        fitted.append(model)
        fitted.append(VectorSlicer(inputCol=f"_prob_{c}", outputCol=f"_score_{c}", indices=[1]))
        scores.append(f"_score_{c}")
    fitted += [
        VectorAssembler(inputCols=scores, outputCol="_scores"),
        Normalizer(p=1.0, inputCol="_scores", outputCol="_shares"),
    ]
    return Fitted("boosted", PipelineModel(stages=fitted), [], n_classes)


def _side_by_side(members: Sequence[Learner], train: DataFrame, n_classes: int, key: str | None) -> list[Fitted]:
    """The members fitted from driver threads, so that small jobs of one fill the gaps of another."""
    with ThreadPool(min(4, max(1, len(members)))) as pool:
        return pool.map(inheritable_thread_target(train.sparkSession)(lambda m: fit(m, train, n_classes, key)), members)


def _fit_stacking(learner: Learner, train: DataFrame, n_classes: int, key: str) -> Fitted:
    """Every row gets its members' probabilities from models that did not see it; the final model learns
    from those. Members are then refitted on all rows."""
    p = learner.params
    k = p["folds"]
    if "_stack_fold" not in train.columns:
        train = stratified_folds(train, "label", k, key, seed=None, output="_stack_fold")
    names = [f"_m{i}_probability" for i in range(len(p["members"]))]
    unseen = None
    for fold in range(k):
        rest, held = train.filter(F.col("_stack_fold") != fold), train.filter(F.col("_stack_fold") == fold)
        scored = Fitted("voting", None, _side_by_side(p["members"], rest, n_classes, key), n_classes)._member_probabilities(held)
        # Written fold by fold: what follows neither keeps nor repeats a fold's models.
        scored = materialize(scored.select("label", *names), f"unseen-{fold}")
        unseen = scored if unseen is None else unseen.unionByName(scored)
    meta_rows = materialize(_meta_features(unseen, len(names)).select("label", "_meta"), "stack")
    meta_params = {"max_iter": 1000, "c": 1.0, **p["meta"]}
    final = LogisticRegression(
        featuresCol="_meta", maxIter=meta_params["max_iter"], regParam=1.0 / (meta_params["c"] * max(1, meta_rows.count())),
        standardization=False, family="multinomial", rawPredictionCol="_meta_raw", probabilityCol="_meta_probability",
        predictionCol="_meta_prediction",
    ).fit(meta_rows)
    members = _side_by_side(p["members"], train, n_classes, key)
    return Fitted("stacking", PipelineModel(stages=[final]), members, n_classes)


# --- cross-validation -----------------------------------------------------------------------------


def score(fitted: Fitted, df: DataFrame) -> float:
    """Share of rows predicted right."""
    right = fitted.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    return float(right) if right is not None else 0.0


def failure(error: Exception) -> str:
    """The status of a model that could not be fitted: kind of error and the first line of what it says."""
    said = str(error).strip().splitlines()
    return f"failed: {type(error).__name__}: {said[0][:300]}" if said else f"failed: {type(error).__name__}"


Prepare = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def fold_accuracies(
    learner: Learner, df: DataFrame, k: int, fold: str = "fold", prepare: Prepare | None = None, parallelism: int = 4
) -> list[float]:
    """Accuracy on each held-out fold. Folds are fitted side by side from driver threads; ``prepare`` may
    fit further features on the fold's training rows."""
    n_classes = class_count(df)

    def run(i: int) -> float:
        train, test = df.filter(F.col(fold) != i), df.filter(F.col(fold) == i)
        if prepare is not None:
            train, test = prepare(train, test)
        return score(fit(learner, train, n_classes), test)

    with ThreadPool(min(parallelism, k)) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(run), range(k))


def cross_validate(learners: Sequence[Learner], df: DataFrame, k: int, fold: str = "fold", parallelism: int = 4) -> DataFrame:
    """(model, fold, score)."""
    rows = []
    for learner in learners:
        rows += [(learner.name, i, s) for i, s in enumerate(fold_accuracies(learner, df, k, fold, None, parallelism))]
    return df.sparkSession.createDataFrame(rows, SCORES)


def compare_models(learners: Sequence[Learner], df: DataFrame, k: int, fold: str = "fold", parallelism: int = 4) -> DataFrame:
    """Mean, spread and fold scores of each learner with a status; a learner that fails is a row, not an end."""
    spark = df.sparkSession
    rows, status = [], []
    for learner in learners:
        try:
            scores = fold_accuracies(learner, df, k, fold, None, parallelism)
            rows += [(learner.name, i, s) for i, s in enumerate(scores)]
            status.append((learner.name, "success"))
        except Exception as error:
            status.append((learner.name, failure(error)))
    summary = summarize_folds(spark.createDataFrame(rows, SCORES))
    return spark.createDataFrame(status, "model string, status string").join(F.broadcast(summary), "model", "left").select(
        "model", "mean_accuracy", "std_accuracy", "fold_scores", "status"
    )


# --- searches -------------------------------------------------------------------------------------

# The two search spaces, as far as the Spark network has the parameter.
WIDE_GRID = {"hidden": [(128,), (64, 32), (256, 128, 64)], "max_iter": [500, 1000, 2000], "step": [0.001, 0.01]}
DEEP_GRID = {
    "hidden": [(64,), (128,), (256,), (128, 64), (256, 128), (128, 128), (256, 256)], "max_iter": [1000],
    "step": [0.001, 0.01],
}


TRIED = "reduced string, hidden string, max_iter int, step double, fold int, score double"


def prepared_fold(df: DataFrame, fold: str, i: int, reduce: tuple[str, int] | None) -> tuple[DataFrame, DataFrame, int]:
    """Training and test rows of one fold as (label, x), and the width of x: scaler and reduction are fitted on the training
    rows once, and the rows are written, for all candidates that are fitted on them."""
    train, test = df.filter(F.col(fold) != i), df.filter(F.col(fold) == i)
    stages, column, width = _prepared(Learner("search", "network", {}, reduce), train)
    model = Pipeline(stages=stages).fit(train)
    ready = [materialize(model.transform(d).select("label", F.col(column).alias("x")), "fold") for d in (train, test)]
    return ready[0], ready[1], width


def grid_search(
    df: DataFrame, grid: dict[str, list], k: int, fold: str = "fold", reduce: tuple[str, int] | None = None,
    solver: str = "gd", parallelism: int = 4, seed: int = 42, results: str | None = None,
) -> DataFrame:
    """Every network of the grid on every fold: (hidden, max_iter, step, mean_accuracy), best first.

    ``step`` only matters to the gradient-descent solver, which is therefore the default here. Every fit leaves a row in the table
    ``results`` (by default one in the scratch folder) as soon as it is done, and fits that have one are not repeated: a search that
    lost its driver goes on where it was. With that solver the fits of a search learn side by side (``networks.descend``), and fits that differ
    in ``max_iter`` only are made by the longest of them.
    """
    results = results or scratch_path(df.sparkSession, "search")
    _search(df, grid, k, [reduce], results, fold, solver, parallelism, seed)
    return _found(df.sparkSession, grid, k, reduce, results)


def _candidates(grid: dict[str, list]) -> list[tuple[str, int, float]]:
    return [("-".join(map(str, h)), m, s) for h in grid["hidden"] for m in grid["max_iter"] for s in grid["step"]]


def _tag(reduce: tuple[str, int] | None) -> str:
    return "none" if reduce is None else f"{reduce[0]}-{reduce[1]}"


def _search(
    df: DataFrame, grid: dict[str, list], k: int, reductions: Sequence[tuple[str, int] | None], results: str,
    fold: str = "fold", solver: str = "gd", parallelism: int = 4, seed: int = 42,
) -> None:
    """Fits what has no row in ``results`` yet: every candidate behind every reduction on every fold."""
    spark = df.sparkSession
    n_classes = class_count(df)
    done = {(r["reduced"], r["hidden"], r["max_iter"], r["step"], r["fold"]) for r in _tried(spark, results).collect()}
    todo = [(r, c, i) for r in reductions for c in _candidates(grid) for i in range(k) if (_tag(r), *c, i) not in done]
    if not todo:
        return
    writing = Lock()

    def keep(tasks: list, scores: list[float]) -> None:
        rows = [(_tag(r), *c, i, s) for (r, c, i), s in zip(tasks, scores)]
        with writing:
            spark.createDataFrame(rows, TRIED).coalesce(1).write.mode("append").parquet(results)

    def network(task: tuple, **settings) -> MultilayerPerceptronClassifier:
        reduce, (hidden, _, step), i = task
        layers = [folds[reduce, i][2], *map(int, hidden.split("-")), n_classes]
        return MultilayerPerceptronClassifier(featuresCol="x", solver=solver, seed=seed, layers=layers, stepSize=step, **settings)

    def run(task: tuple) -> None:
        train, test, _ = folds[task[0], task[2]]
        fitted = network(task, maxIter=task[1][1]).fit(train)
        keep([task], [score(Fitted("pipeline", PipelineModel(stages=[fitted]), [], n_classes), test)])

    def draw(task: tuple) -> tuple[tuple[int, ...], np.ndarray]:
        """Layers and weights of the network as Spark draws it before its first iteration; neither depends on rounds and step."""
        drawn = network(task, maxIter=0).fit(folds[task[0], task[2]][0].limit(1))
        return tuple(drawn.getLayers()), drawn.weights.toArray()

    tables = list(dict.fromkeys((r, i) for r, _, i in todo))
    with ThreadPool(min(parallelism, len(todo))) as pool:
        side_by_side = inheritable_thread_target(spark)
        folds = dict(zip(tables, pool.map(side_by_side(lambda at: prepared_fold(df, fold, at[1], at[0])), tables, chunksize=1)))
        if solver != "gd":
            pool.map(side_by_side(run), todo, chunksize=1)
            return
        first = {(r, c[0], i): (r, c, i) for r, c, i in todo}
        drawn = dict(zip(first, pool.map(side_by_side(draw), first.values(), chunksize=1)))
    networks = [Network(tables.index((r, i)), *drawn[r, hidden, i], max_iter, step) for r, (hidden, max_iter, step), i in todo]
    for part in _parts(networks):
        group, used = [networks[i] for i in part], sorted({networks[i].at for i in part})
        train, test = (
            functools.reduce(DataFrame.unionByName, [blocks(folds[tables[at]][side], at, n_classes if side == 0 else None) for at in used])
            for side in (0, 1)
        )
        for ready in descend(train, group):
            keep([todo[part[i]] for i in ready], accuracies(test, [group[i] for i in ready]))


def _parts(networks: Sequence[Network]) -> list[list[int]]:
    """Places of the networks, in parts of at most SIDE_BY_SIDE weights (or of one network). Networks that walk the same way count once and
    stay together; those that end early come first."""
    parts, size = [], SIDE_BY_SIDE
    for way in sorted(ways(networks), key=lambda way: networks[way[-1]].max_iter):
        size += len(networks[way[0]].weights)
        if size > SIDE_BY_SIDE:
            parts.append([])
            size = len(networks[way[0]].weights)
        parts[-1] += way
    return parts


def _found(spark: SparkSession, grid: dict[str, list], k: int, reduce: tuple[str, int] | None, results: str) -> DataFrame:
    wanted = spark.createDataFrame(_candidates(grid), "hidden string, max_iter int, step double")
    mine = (F.col("reduced") == _tag(reduce)) & (F.col("fold") < k)
    found = _tried(spark, results).filter(mine).join(F.broadcast(wanted), ["hidden", "max_iter", "step"])
    table = found.groupBy(F.split("hidden", "-").cast("array<int>").alias("hidden"), "max_iter", "step").agg(F.avg("score").alias("mean_accuracy"))
    return table.orderBy(F.desc("mean_accuracy"), "hidden", "max_iter", "step")


def _tried(spark: SparkSession, results: str) -> DataFrame:
    """The rows of fits that are done; none if there is no table yet."""
    try:
        return spark.read.schema(TRIED).parquet(results)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TRIED)


def kbest_grid_search(
    df: DataFrame, grid: dict[str, list], k: int, k_list: Sequence[int] = (50, 100, 200), **options
) -> DataFrame:
    """The grid behind a k-best selection, for each number of features; the selection is fitted once per fold and number, and the
    networks behind all of them learn side by side."""
    spark = df.sparkSession
    results = options.pop("results", None) or scratch_path(spark, "search")
    _search(df, grid, k, list(dict.fromkeys(("selectkbest", n) for n in k_list)), results, **options)
    out = None
    for n in k_list:
        rows = _found(spark, grid, k, ("selectkbest", n), results).withColumn("k", F.lit(n))
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy(F.desc("mean_accuracy"), "k", "hidden", "max_iter", "step")


def best_network(results: DataFrame, max_iter: int = 1000, seed: int = 42) -> Learner:
    """The learner of the best row of a (k-best) grid search."""
    row = results.orderBy(F.desc("mean_accuracy")).first().asDict()
    params = {"hidden": tuple(row["hidden"]), "max_iter": row["max_iter"], "step": row["step"], "seed": seed}
    if "k" in row:
        return replace(neural_network(f"NeuralNetwork_FS{row['k']}", **params), reduce=("selectkbest", row["k"]))
    return neural_network(**params)


# --- many models on many feature sets -------------------------------------------------------------


def feature_set_variants(n: int = 50) -> dict[str, tuple[str, tuple[str, int] | None]]:
    """Feature set name -> (vector column, reduction)."""
    return {
        "stylometric": ("style", None),
        "embeddings": ("embedding", None),
        "all": ("features", None),
        "pca": ("features", ("pca", n)),
        "kbest": ("features", ("selectkbest", n)),
    }


def train_model_zoo(
    learners: Sequence[Learner], train: DataFrame, test: DataFrame,
    variants: dict[str, tuple[str, tuple[str, int] | None]] | None = None, model_dir: str | None = None,
    wrong_dir: str | None = None, labels: LabelEncoder | None = None, text: str = "text", parallelism: int = 4,
) -> DataFrame:
    """Every learner on every feature set: (model, feature_set, accuracy, status, report).

    ``report`` holds precision, recall, F1 and support of every class. With ``model_dir`` the models are saved; with
    ``wrong_dir`` the wrong test rows are written as ``<model>_<set>_misclassified.csv`` with text, true_label and
    predicted_label, named by ``labels``, as the error summary reads them. A failing combination becomes a row with its status.
    Combinations are fitted side by side from driver threads, ``parallelism`` at a time.
    """
    spark = train.sparkSession
    n_classes = class_count(train)

    def run(task: tuple[str, str, tuple[str, int] | None, Learner]) -> list[tuple]:
        set_name, column, reduce, learner = task
        fit_on, score_on = (d.withColumn("features", F.col(column)) for d in (train, test))
        tag, rows = f"{learner.name}_{set_name}", []
        try:
            fitted = fit(replace(learner, reduce=reduce), fit_on, n_classes)
            scored = fitted.transform(score_on)
            for index, name in (("label", TRUE), ("prediction", PREDICTED)):
                scored = decode_predictions(scored, index, name, labels)
            report = [tuple(r) for r in per_class(scored).select(*REPORT_COLUMNS).orderBy("label").collect()]
            right, total = sum(r[-1] for r in report), sum(r[4] for r in report)
            rows.append((learner.name, set_name, right / total if total else None, "success", [r[:5] for r in report]))
            if model_dir:
                fitted.save(spark, f"{model_dir}/{tag}")
            if wrong_dir:
                shown = [c for c in (text, TRUE, PREDICTED) if c in scored.columns]
                write_csv(scored.filter(F.col(TRUE) != F.col(PREDICTED)).select(*shown), f"{wrong_dir}/{tag}_misclassified.csv")
        except Exception as error:
            rows.append((learner.name, set_name, None, failure(error), None))
        return rows

    tasks = [(name, *variant, learner) for name, variant in (variants or feature_set_variants()).items() for learner in learners]
    with ThreadPool(min(parallelism, max(1, len(tasks)))) as pool:
        found = pool.map(inheritable_thread_target(spark)(run), tasks, chunksize=1)
    return spark.createDataFrame([row for rows in found for row in rows], ZOO)


def ablation(
    learner: Learner, df: DataFrame, k: int, sets: dict[str, tuple[str, Prepare | None, tuple[str, int] | None]],
    fold: str = "fold", parallelism: int = 4,
) -> DataFrame:
    """The same learner on each feature set: (model, fold, score) with the set's name as model.

    A set is a vector column, an optional function fitting it on a fold's training rows, and a reduction.
    """
    rows = []
    for name, (column, prepare, reduce) in sets.items():
        def use(train, test, column=column, prepare=prepare):
            if prepare is not None:
                train, test = prepare(train, test)
            return tuple(d.withColumn("features", F.col(column)) for d in (train, test))

        scores = fold_accuracies(replace(learner, reduce=reduce), df, k, fold, use, parallelism)
        rows += [(name, i, s) for i, s in enumerate(scores)]
    return df.sparkSession.createDataFrame(rows, SCORES)


def soft_vote(probabilities: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, model, label, p) to the label with the highest mean probability; ties to the first label.

    For probabilities that come as a table; fitted models vote inside ``Fitted.transform`` without a shuffle.
    """
    means = probabilities.groupBy(key, "label").agg(F.avg("p").alias("p"))
    return means.groupBy(key).agg(F.min(F.struct((-F.col("p")).alias("_n"), F.col("label"))).alias("_b")).select(
        key, F.col("_b.label").alias("predicted_label"), (-F.col("_b._n")).alias("p")
    )
