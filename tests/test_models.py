import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from flowlens.operators import models
from flowlens.operators.attention import CLASSES, score_windows, segment_softmax
from flowlens.operators.drift import current_versions, promotion
from flowlens.operators.evaluate import fit_temperature
from flowlens.operators.graph import WINDOW_VECTOR


def weights(seed=7, hidden=6, embed=3):
    rng = np.random.default_rng(seed)
    layers = []
    for width in (4, hidden, hidden):
        layers.append({"W": rng.normal(0, .5, (width, hidden)), "We": rng.normal(0, .5, (4, embed)), "a": rng.normal(0, .5, 2 * hidden + embed)})
    return {"layers": layers, "classifier": rng.normal(0, 1, (hidden, 3))}


def plain(node_feats, src, dst, edge_feats, w):
    """Dense definition of the network."""
    leaky = lambda x: np.where(x > 0, x, .2 * x)

    def soft(s, seg, n):
        e = np.exp(s - s.max())
        return e / (np.bincount(seg, e, n)[seg] + 1e-12)

    h, roll = node_feats, np.zeros(len(src))
    for p in w["layers"]:
        wh, we = h @ p["W"], edge_feats @ p["We"]
        roll = roll + soft(leaky(np.hstack([wh[src], wh[dst], we]) @ p["a"]), dst, len(h))
        s2, d2 = np.r_[src, dst], np.r_[dst, src]
        att = soft(leaky(np.hstack([wh[s2], wh[d2], np.vstack([we, we])]) @ p["a"]), d2, len(h))
        mixed = np.zeros_like(wh)
        np.add.at(mixed, d2, att[:, None] * wh[s2])
        h = leaky(mixed + wh)
    z = h.mean(axis=0) @ w["classifier"]
    e = np.exp(z - z.max())
    return e / e.sum(), roll


def test_attention_scoring_equals_the_dense_network(spark):
    rng, w = np.random.default_rng(1), weights()
    edges, nodes, want = [], [], {}
    for window in range(3):
        names = [f"h{i}" for i in range(5 + window)]
        pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(9)})
        ef = np.c_[rng.integers(1, 5000, len(pairs)), rng.integers(1, 9, len(pairs)), rng.random(len(pairs)), rng.integers(1, 40, len(pairs))].astype(float)
        nf = np.c_[rng.integers(0, 9, len(names)), rng.integers(0, 9, len(names)), rng.integers(0, 9000, len(names)), rng.integers(0, 5, len(names))].astype(float)
        edges += [(window, str(s), str(d), float(f[0]), int(f[1]), float(f[2]), float(f[3])) for (s, d), f in zip(pairs, ef)]
        nodes += [(window, n, float(f[0]), float(f[1]), float(f[2]), int(f[3])) for n, f in zip(names, nf)]
        ef[:, 0], nf[:, 2] = np.log1p(ef[:, 0]), np.log1p(nf[:, 2])
        at = {n: i for i, n in enumerate(names)}
        probs, roll = plain(nf, np.array([at[s] for s, _ in pairs]), np.array([at[d] for _, d in pairs]), ef, w)
        order = sorted(range(len(pairs)), key=lambda i: (-round(roll[i], 9), pairs[i]))[:3]
        want[window] = (probs, [f"{pairs[i][0]}->{pairs[i][1]}" for i in order])
    e = spark.createDataFrame(edges, "w int, src string, dst string, bytes double, flow_count int, port_entropy double, duration_mean_ms double")
    n = spark.createDataFrame(nodes, "w int, node string, degree_in double, degree_out double, bytes_total double, unique_ports_contacted int")
    for row in score_windows(e, n, ["w"], w).collect():
        probs, top = want[row.w]
        assert np.allclose([row[f"p_{c}"] for c in CLASSES], probs, atol=1e-9)
        assert row.predicted == CLASSES[int(probs.argmax())] and row.edge_ids == ([] if row.label == "benign" else top)


def test_softmax_sums_to_one_per_segment(spark):
    rows = [(0, i, d, float(i)) for i, d in enumerate([0, 0, 0, 1, 1, 2, 2, 2, 2, 3])]
    df = segment_softmax(spark.createDataFrame(rows, "w int, src int, dst int, s double"), ["w"], "s", "dst")
    assert all(abs(r.t - 1) < 1e-9 for r in df.groupBy("dst").agg(F.sum("attention").alias("t")).collect())


def test_temperature_finds_the_overconfidence(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(int)
    df = spark.createDataFrame([(float(a * 3), int(b)) for a, b in zip(z, y)], "logit double, y int")
    assert 2.4 < fit_temperature(df, "logit", "y") < 3.8


@pytest.fixture(scope="module")
def flows(spark):
    rng, rows = np.random.default_rng(2), []
    for i in range(400):
        rows.append((i, 1, f"a{i % 2}", "victim", 80, int(rng.integers(400, 900)), 5, "real", i % 2))
        rows.append((1000 + i, 0, f"b{i % 97}", f"d{i % 31}", int(rng.integers(1, 500)), int(rng.integers(10, 200)), 40, "real", i % 2))
    return spark.createDataFrame(rows, "seq bigint, y int, src string, dst string, port int, bytes bigint, duration_ms bigint, origin string, day int")


def test_fast_lane_trains_scores_and_reports(spark, flows):
    features = models.replay_features(flows, ["y"], ["src", "seq"], 0).persist()
    assert features.count() == 800
    model, report = models.train_and_report(features, "seq", rounds=2)
    row = report.first()
    assert row.f1 > 0.95 and row.auc > 0.98 and 0.05 <= model.temperature <= 10
    verdicts = model.verdicts(features).groupBy("label").agg(F.avg("y").alias("y")).collect()
    assert {v.label for v in verdicts} <= {"flood", "benign", "uncertain"}
    days = features.join(flows.select("seq", "day"), "seq")
    assert [r.f1 > 0.9 for r in models.cross_day(days, "seq", rounds=1).collect()] == [True, True]
    scored = model.score(features).withColumn("w", F.floor(F.col("ts_us") / 2_000_000)).persist()
    windows = scored.groupBy("y", "w").agg(F.avg("p_flood").alias("p_attack"))
    study = {r.grain: r.f1 for r in models.lane_substitution(scored.drop("y").join(features.select("seq", "y"), "seq"), windows.withColumn("label", F.col("y")), ["y", "w"], "p_flood", "label").collect()}
    assert set(study) == {"event_max", "event_mean", "window"} and study["event_mean"] > 0.9


def test_synthetic_rows_are_refused(spark, flows):
    with pytest.raises(Exception, match="must be real"):
        models.replay_features(flows.withColumn("origin", F.lit("synthetic")), ["y"], ["src", "seq"], 0).collect()


def test_deep_lane_probe_and_versions(spark, tmp_path):
    rng, rows = np.random.default_rng(3), []
    for i in range(120):
        y = i % 2
        rows.append((i, y, *[float(v) for v in rng.normal(3 * y, 1, len(WINDOW_VECTOR))]))
    df = spark.createDataFrame(rows, "id int, y int, " + ", ".join(f"{c} double" for c in WINDOW_VECTOR)).persist()
    probe = models.separability_probe(df, "id").first()
    assert probe.auc > 0.95 and probe.windows == 120 and probe.median_edges_attack > probe.median_edges_benign
    model = models.fit_deep(df, "y")
    assert models.score_deep(model, df, ["id"]).filter("predicted = 'port_scan'").count() > 50
    root = str(tmp_path)
    models.register_version(spark, root, "deep", "v1", model, {"f1": 0.8}, 1)
    models.register_version(spark, root, "deep", "v2", model, {"f1": 0.9}, 2)
    models.promote_version(spark, root, "deep", "v1", 3)
    models.promote_version(spark, root, "deep", "v2", 4)
    with pytest.raises(FileNotFoundError):
        models.promote_version(spark, root, "deep", "v9", 5)
    now = current_versions(spark.read.parquet(f"{root}/versions"), spark.read.parquet(f"{root}/promotions")).first()
    assert now.version_id == "v2" and LogisticRegressionModel.load(f"{root}/models/deep/v2").numFeatures == len(WINDOW_VECTOR)
    new = spark.createDataFrame([("deep", 0.9), ("fast", 0.1)], "component string, f1 double")
    old = spark.createDataFrame([("deep", 0.9)], "component string, f1 double")
    assert {r.component: r.promote for r in promotion(old, new).collect()} == {"deep": False, "fast": True}
