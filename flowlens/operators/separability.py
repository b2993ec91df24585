"""How well a linear model separates labelled windows, for every cadence (or any other key) at once.

The logistic regressions of all keys and folds are fitted together. Each round is one pass over the windows: with the
current coefficients of every model at hand, gradient, Hessian and loss are grouped sums, and one Newton step per
model follows from its sums. The objective is that of a balanced logistic regression with an L2 penalty on the coefficients
of the features as they are (not on the intercept); scaling inside only helps the arithmetic. What reaches the driver per
round is one vector of sums per key and fold, whatever the number of windows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators import evaluate, sampling
from flowlens.operators.evaluate import long_form, ratio
from flowlens.operators.graph import WINDOW_VECTOR
from flowlens.operators.scan import exact_quantiles
from flowlens.session import cut_lineage

FOLDS = 3
DEGENERATE = "degenerate label distribution"


class _Model:
    """One regression while it is fitted: scaled coefficients (intercept last), the last step and the last loss."""

    def __init__(self, center: np.ndarray, scale: np.ndarray, weights: tuple[float, float], penalty: float):
        self.center, self.scale, self.weights = center, scale, weights
        self.ridge = np.append(penalty / scale ** 2, 0.0)
        self.beta = np.zeros(len(scale) + 1)
        self.step = np.zeros(len(scale) + 1)
        self.loss, self.done = np.inf, False

    def newton(self, loss: float, gradient: np.ndarray, hessian: np.ndarray, tolerance: float) -> None:
        """Takes the sums at ``beta`` and moves on: a full step, or half of the last one where the loss has grown."""
        loss += 0.5 * float(self.ridge @ self.beta ** 2)
        if loss > self.loss + 1e-12 * abs(self.loss):
            self.beta = self.beta - self.step / 2
            self.step = self.step / 2
        else:
            self.loss = loss
            self.step = -np.linalg.solve(hessian + np.diag(self.ridge) + 1e-12 * np.eye(len(self.beta)),
                                         gradient + self.ridge * self.beta)
            self.beta = self.beta + self.step
        self.done = bool(np.abs(self.step).max() < tolerance)


def _total(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def _score(features: Sequence[str]) -> Column:
    """The linear part of a model: columns ``_beta``, ``_center`` and ``_scale`` are its arrays."""
    parts = [F.col("_beta")[j] * (F.col(f).cast("double") - F.col("_center")[j]) / F.col("_scale")[j] for j, f in enumerate(features)]
    return _total(parts) + F.col("_beta")[len(features)]


def _table(rows: DataFrame, keys: Sequence[str], models: dict) -> DataFrame:
    """The models as a DataFrame: keys, ``_model`` (the fold it does not see) and its arrays."""
    data = [(*name, m.beta.tolist(), m.center.tolist(), m.scale.tolist(), *m.weights) for name, m in models.items()]
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.sparkSession.createDataFrame(
        data, f"{fields}, _model long, _beta array<double>, _center array<double>, _scale array<double>, _w0 double, _w1 double")


def _newton_round(numbered: DataFrame, models: list[tuple[int, int, _Model]], features: Sequence[str], label: str,
                  tolerance: float) -> None:
    """One step of every model ``(key number, fold it does not see, model)`` that still moves, from one grouped pass.

    Each task adds up loss, gradient and upper Hessian of its rows for all models; the sums per model meet in one shuffle.
    """
    moving = [(i, key, fold, m) for i, (key, fold, m) in enumerate(models) if not m.done]
    plain = [(i, key, fold, m.beta, m.center, m.scale, m.weights) for i, key, fold, m in moving]
    n = len(features) + 1
    upper = np.triu_indices(n)

    def partial(frames):
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            number, fold = frame["_k"].to_numpy(), frame["_fold"].to_numpy()
            x, y = frame[list(features)].to_numpy(dtype=np.float64), frame[label].to_numpy(dtype=np.float64)
            for i, key, unseen, beta, center, scale, weights in plain:
                own = (number == key) & (fold != unseen)
                if not own.any():
                    continue
                a = np.hstack([(x[own] - center) / scale, np.ones((int(own.sum()), 1))])
                z, t = a @ beta, y[own]
                weight = np.where(t == 1, weights[1], weights[0])
                p = np.exp(-np.logaddexp(0.0, -z))
                hessian = (a * (weight * p * (1 - p))[:, None]).T @ a
                found = np.concatenate([[(weight * (np.logaddexp(0.0, z) - t * z)).sum()], a.T @ (weight * (p - t)), hessian[upper]])
                sums[i] = sums.get(i, 0.0) + found
        yield pd.DataFrame({"_i": np.repeat(np.array(list(sums), np.int32), 1 + n + len(upper[0])),
                            "_at": np.tile(np.arange(1 + n + len(upper[0]), dtype=np.int32), len(sums)),
                            "_v": np.concatenate([*sums.values(), np.zeros(0)])})

    narrow = numbered.select("_k", "_fold", label, *features)
    totals = narrow.mapInPandas(partial, "_i int, _at int, _v double").groupBy("_i", "_at").agg(F.sum("_v").alias("_v"))
    vectors = {i: np.zeros(1 + n + len(upper[0])) for i, *_ in moving}
    for row in totals.collect():
        vectors[row["_i"]][row["_at"]] = row["_v"]
    for i, _, _, model in moving:
        hessian = np.zeros((n, n))
        hessian[upper] = vectors[i][1 + n:]
        model.newton(vectors[i][0], vectors[i][1: 1 + n], hessian + np.triu(hessian, 1).T, tolerance)


def held_out_scores(vectors: DataFrame, keys: Sequence[str], identity: str, label: str = "y",
                    features: Sequence[str] = WINDOW_VECTOR, folds: int = FOLDS, seed: int = 42, penalty: float = 1.0,
                    tolerance: float = 1e-8, rounds: int = 60) -> DataFrame:
    """``keys, identity, label, p``: each row's probability by the model of its key that has not seen its fold.

    Folds are dealt per class in hash order of ``identity``, which must be unique per key. A key with one class has no
    model and no rows here; where only the training side lacks a class, the probability is that of the class it has.
    """
    keys, whole = list(keys), "_all"
    named = vectors.select(*keys, identity, label, *features).withColumn(whole, F.lit(0))
    group = [*keys, whole]
    ranked = sampling.hash_rank(named, seed, identity, [*group, label], "_rank")
    folded = cut_lineage(ranked.withColumn("_fold", F.pmod("_rank", F.lit(folds))).drop("_rank"))
    sides = folded.groupBy(*group, "_fold").agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0")).collect()
    spread = folded.groupBy(*group).agg(*[f(F.col(c).cast("double")).alias(f"{n}{j}") for j, c in enumerate(features)
                                          for n, f in (("m", F.avg), ("s", F.stddev_pop))]).collect()
    models: dict[tuple, _Model] = {}
    numbers: dict[tuple, int] = {}
    for row in spread:
        name = tuple(row[k] for k in group)
        own = [s for s in sides if tuple(s[k] for k in group) == name]
        ones, zeros = sum(s["n1"] for s in own), sum(s["n0"] for s in own)
        if not ones or not zeros:
            continue
        numbers[name] = len(numbers)
        scale = np.array([row[f"s{j}"] for j in range(len(features))])
        scale[scale == 0] = 1.0
        center = np.array([row[f"m{j}"] for j in range(len(features))])
        for side in own:
            n1, n0 = ones - side["n1"], zeros - side["n0"]
            both = n1 > 0 and n0 > 0
            model = _Model(center, scale, ((n1 + n0) / (2.0 * n0), (n1 + n0) / (2.0 * n1)) if both else (0.0, 0.0), penalty)
            if not both:
                model.done, model.beta[-1] = True, np.inf if n1 else -np.inf
            models[(*name, side["_fold"])] = model
    fields = ", ".join(f"`{k}` {folded.schema[k].dataType.simpleString()}" for k in group)
    numbered = folded.join(vectors.sparkSession.createDataFrame([(*k, v) for k, v in numbers.items()], f"{fields}, _k int"), group)
    every = [(numbers[name[:-1]], name[-1], m) for name, m in models.items()]
    for _ in range(rounds):
        if all(m.done for _, _, m in every):
            break
        _newton_round(numbered, every, features, label, tolerance)
    judged = folded.join(_table(folded, group, models), group).filter(F.col("_fold") == F.col("_model"))
    return judged.select(*keys, identity, label, evaluate.sigmoid(_score(features)).alias("p"))


def label_shares(vectors: DataFrame, keys: Sequence[str], label: str = "y", features: Sequence[str] = WINDOW_VECTOR,
                 edges: str = "n_edges") -> DataFrame:
    """Per key: windows, attack windows and share, majority accuracy, medians of the edge count and all median ratios.

    A ratio is attack over benign, null where the benign median is 0. A key with one class only is not ``available``: it says
    why, and its figures but the number of windows are null.
    """
    keys = list(keys)
    counts = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col(label) == 1).alias("attack_windows"))
    medians = exact_quantiles(long_form(vectors, features, [*keys, label]), "value", {"median": 0.5}, [*keys, label, "feature"])
    pick = lambda name, y: F.max(F.when((F.col("feature") == name) & (F.col(label) == y), F.col("median")))
    benign = lambda name: F.when(pick(name, 0) != 0, pick(name, 0))
    ratios = medians.groupBy(*keys).agg(
        pick(edges, 1).alias("median_edges_attack"), pick(edges, 0).alias("median_edges_benign"),
        *[(pick(f, 1) / benign(f)).alias(f"ratio_{f}") for f in features])
    joined = counts.join(ratios, keys)
    both = (F.col("attack_windows") > 0) & (F.col("attack_windows") < F.col("windows"))
    share = F.col("attack_windows").cast("double") / F.col("windows")
    return joined.select(
        *keys, "windows", both.alias("available"), F.when(~both, F.lit(DEGENERATE)).alias("reason"),
        F.when(both, F.col("attack_windows")).alias("attack_windows"), F.when(both, share).alias("attack_fraction"),
        F.when(both, F.greatest(share, 1 - share)).alias("majority_class_accuracy"),
        *[F.when(both, F.col(c)).alias(c) for c in ratios.columns if c not in keys])


def separability(vectors: DataFrame, keys: Sequence[str], identity: str, label: str = "y", features: Sequence[str] = WINDOW_VECTOR,
                 folds: int = FOLDS, seed: int = 42, edges: str = "n_edges") -> DataFrame:
    """``label_shares`` with the cross-validated ``auc`` and ``f1_attack`` (at 0.5) of a balanced linear model per key."""
    keys = list(keys)
    shares = label_shares(vectors, keys, label, features, edges)
    scored = cut_lineage(held_out_scores(vectors, keys, identity, label, features, folds, seed))
    areas = evaluate.auc(scored, "p", label, keys).select(*keys, "auc")
    hit, y = F.col("p") >= 0.5, F.col(label) == 1
    tp, fp, fn = F.count_if(hit & y), F.count_if(hit & ~y), F.count_if(~hit & y)
    f1 = scored.groupBy(*keys).agg(ratio(tp * 2, tp * 2 + fp + fn).alias("f1_attack"))
    return shares.join(areas.join(f1, keys), keys, "left")
