"""Classifiers on pyspark.ml: fast lane, deep lane, separability probe, studies, version table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import decide, evaluate, sampling
from flowlens.operators.contract import require_real
from flowlens.operators.graph import WINDOW_VECTOR
from flowlens.operators.scan import exact_quantiles
from flowlens.operators.separability import held_out_scores
from flowlens.operators.trailing import FEATURES, trailing_features
from flowlens.operators.windows import in_intervals
from flowlens.session import cut_lineage

DEPTH, STEP, ROUNDS = 5, 0.1, 100
# Cut values for probabilities; a fixed grid saves scoring the rows once more to find them.
GRID = tuple(i / 64 for i in range(1, 64))


def assemble(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="error").transform(rows)


def holdout(rows: DataFrame, identity: str, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rest, held out) by a hash of the id: the same rows on every run, without an order."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(identity).cast("string")), F.lit(10_000))
    held = bucket < int(share * 10_000)
    return rows.filter(~held), rows.filter(held)


@dataclass
class FastModel:
    """Boosted trees with a temperature; ``logit`` is twice the tree margin."""

    trees: object
    temperature: float
    features: tuple[str, ...]

    def logits(self, rows: DataFrame) -> DataFrame:
        scored = self.trees.transform(assemble(rows, self.features))
        return scored.withColumn("logit", vector_to_array("rawPrediction")[1] * 2.0).drop(
            "_x", "rawPrediction", "probability", "prediction")

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds the calibrated ``p_flood``."""
        return self.logits(rows).withColumn("p_flood", evaluate.sigmoid(F.col("logit") / self.temperature)).drop("logit")

    def verdicts(self, rows: DataFrame) -> DataFrame:
        return decide.fast_verdicts(self.score(rows))


def fit_fast(rows: DataFrame, identity: str, label: str = "y", features: Sequence[str] = FEATURES, rounds: int = ROUNDS,
             calibration: float = 0.2, seed: int = 42) -> FastModel:
    """Trees on 80 % of the rows, temperature on the held-out rest."""
    train, held = holdout(rows, identity, calibration, seed)
    learner = GBTClassifier(featuresCol="_x", labelCol=label, maxDepth=DEPTH, stepSize=STEP, maxIter=rounds, seed=seed)
    model = FastModel(learner.fit(assemble(train, features)), 1.0, tuple(features))
    logits = cut_lineage(model.logits(held).select("logit", label))  # read once per round of the search
    model.temperature = evaluate.fit_temperature(logits, "logit", label)
    return model


def fit_deep(vectors: DataFrame, label: str = "label_index", features: Sequence[str] = WINDOW_VECTOR):
    """Deep lane classifier on window vectors (class indices in the order benign, port_scan, lateral_movement)."""
    return LogisticRegression(featuresCol="_x", labelCol=label, maxIter=200, regParam=1e-3).fit(assemble(vectors, features))


def score_deep(model, vectors: DataFrame, keys: Sequence[str], features: Sequence[str] = WINDOW_VECTOR,
               classes: Sequence[str] = ("benign", "port_scan", "lateral_movement")) -> DataFrame:
    scored = model.transform(assemble(vectors, features)).withColumn("_p", vector_to_array("probability"))
    names = F.array(*[F.lit(c) for c in classes])
    out = scored.withColumn("confidence", F.array_max("_p")).withColumn(
        "predicted", F.element_at(names, F.array_position("_p", F.array_max("_p")).cast("int")))
    return out.select(*keys, "predicted", "confidence",
                      decide.derive_label(F.col("predicted"), F.col("confidence")).alias("label"))


def replay_features(rows: DataFrame, streams: Sequence[str], order: Sequence[str], start_us: int, step_us: int = 20_000,
                    window_us: int = 2_000_000) -> DataFrame:
    """Fast-lane features of class streams replayed on a synthetic clock, each stream on its own."""
    clocked = sampling.replay_clock(require_real(rows), order, start_us, step_us, streams)
    features = trailing_features(clocked.withColumn("seq", F.monotonically_increasing_id()) if "seq" not in clocked.columns else clocked,
                                 window_us, [*streams, "src"])
    return features


def train_and_report(features: DataFrame, identity: str, label: str = "y", split_keys: Sequence[str] = ("y",),
                     rounds: int = ROUNDS, seed: int = 42) -> tuple[FastModel, DataFrame]:
    """Split per class (and day), fit on the train side, report on the test side."""
    sided = cut_lineage(sampling.class_split(features, split_keys, identity, seed))
    model = fit_fast(sided.filter("side = 'train'"), identity, label, rounds=rounds, seed=seed)
    scored = model.score(sided.filter("side = 'test'"))
    return model, evaluate.threshold_report(scored, "p_flood", label, 0.5, points=GRID)


def cross_day(features: DataFrame, identity: str, day: str = "day", label: str = "y", rounds: int = ROUNDS) -> DataFrame:
    """Leave one day out: fit without the day, score the day. The loop is over days, not rows."""
    out = None
    for (fold,) in features.select(day).distinct().orderBy(day).collect():
        model = fit_fast(features.filter(F.col(day) != fold), identity, label, rounds=rounds)
        row = evaluate.threshold_report(model.score(features.filter(F.col(day) == fold)), "p_flood", label, 0.5,
                                        points=GRID).withColumn(
            "test_day", F.lit(fold))
        out = row if out is None else out.unionByName(row)
    return out


def separability_probe(vectors: DataFrame, identity: str, label: str = "y", features: Sequence[str] = WINDOW_VECTOR,
                       folds: int = 3, seed: int = 42) -> DataFrame:
    """Cross-validated balanced logistic regression: how much a linear model sees at this window size."""
    scored = cut_lineage(held_out_scores(vectors, [], identity, label, features, folds, seed))
    report = evaluate.threshold_report(scored, "p", label, 0.5)
    medians = exact_quantiles(vectors, "n_edges", {"median": 0.5}, [label])
    pick = lambda v: medians.filter(F.col(label) == v).select("median").scalar()
    return (report.withColumn("windows", vectors.agg(F.count(F.lit(1))).scalar())
            .withColumn("median_edges_attack", pick(1)).withColumn("median_edges_benign", pick(0)))


def lane_substitution(events: DataFrame, verdicts: DataFrame, keys: Sequence[str], score: str, y: str,
                      deep: str = "p_attack", threshold: float = 0.5) -> DataFrame:
    """The same windows judged by both lanes: event scores lifted by max and mean, window scores as they are."""
    lifted = evaluate.window_scores(events, keys, score).join(verdicts.select(*keys, deep, y), list(keys))
    out = None
    for grain, column in (("event_max", "score_max"), ("event_mean", "score_mean"), ("window", deep)):
        row = evaluate.threshold_report(lifted, column, y, threshold, points=GRID).withColumn("grain", F.lit(grain))
        out = row if out is None else out.unionByName(row)
    return out


def windows_in_attack(vectors: DataFrame, intervals: DataFrame, keys: Sequence[str], cell_us: int) -> DataFrame:
    flagged = in_intervals(vectors, intervals, keys, "window_start", cell_us, "_in")
    return flagged.withColumn("y", F.col("_in").cast("int")).drop("_in")


# --- versions -----------------------------------------------------------------------------------


def register_version(spark: SparkSession, root: str, component: str, version: str, model, metrics: dict[str, float],
                     created_us: int) -> None:
    """Saves the model with its own writer and appends one row to the version table."""
    model.write().overwrite().save(f"{root}/models/{component}/{version}")
    row = [(component, version, {k: float(v) for k, v in metrics.items()}, created_us)]
    spark.createDataFrame(row, "component string, version_id string, metrics map<string,double>, created_us bigint").write.mode(
        "append").parquet(f"{root}/versions")


def promote_version(spark: SparkSession, root: str, component: str, version: str, promoted_us: int) -> None:
    """Appends a promotion; the latest one of a component is its pointer."""
    known = spark.read.parquet(f"{root}/versions").filter((F.col("component") == component) & (F.col("version_id") == version))
    if known.isEmpty():
        raise FileNotFoundError(f"no version {component}/{version}")
    spark.createDataFrame([(component, version, promoted_us)], "component string, version_id string, promoted_us bigint").write.mode(
        "append").parquet(f"{root}/promotions")
