"""Feature vector, scaling, split, training, evaluation, scoring, persistence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from neo import schemas as S
from neo.operators import aggregates as A
from neo.operators import ml as M
from neo.plans import pipelines as P
from neo.sources import domain as DM
from tests.conftest import SF_MED, SF_SMALL
from tests.fixtures import scenarios_df


def test_row_zscore(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([5.0, 5.0],)], "features array<float>")
    rows = M.row_zscore(df).collect()
    a = np.array([1.0, 2.0, 3.0, 4.0])
    assert rows[0]["features_z"] == pytest.approx(list((a - a.mean()) / (a.std() + 1e-8)))
    assert rows[1]["features_z"] == [0.0, 0.0]


def test_model_features_defaults(spark):
    df = DM.with_model_inputs(scenarios_df(spark).withColumn("event_id", F.lit(1)).withColumn("size", F.lit(None).cast("double")))
    r = M.model_features(df).first()
    assert r["diameter_km"] == 1.0 and r["inclination_deg"] is not None


def test_fill_assemble_scale(spark):
    df = spark.createDataFrame([(1.0, None, 3), (3.0, 2.0, None)], "a double, b double, c int")
    filled = M.fill_features(df, ["a", "b", "c"])
    assert [tuple(r) for r in filled.collect()] == [(1.0, 0.0, 3), (3.0, 2.0, 0)]
    scaled, _ = M.scale(M.assemble(filled, ["a", "b", "c"]))
    out = M.unpack(scaled, "scaled_features", ["a", "b", "c"]).collect()
    assert out[1]["a"] == pytest.approx(3.0 / np.std([1.0, 3.0], ddof=1))


def test_stratified_split_exact_shares(spark):
    lab = A.percentile_label(M.training_risk(DM.training_rows(DM.table(spark, SF_MED, "events"))), "collision_risk")
    split = M.stratified_split(lab)
    counts = {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()}
    for label in (0, 1):
        n = sum(v for (lb, _s), v in counts.items() if lb == label)
        assert counts[(label, "train")] == int(0.6 * n)
        assert counts[(label, "train")] + counts[(label, "validation")] == int(0.8 * n)
    again = M.stratified_split(lab)
    assert split.exceptAll(again).count() == 0


def test_train_evaluate_save_load(spark, tmp_dir):
    out = P.train(DM.training_rows(DM.table(spark, SF_MED, "events")), model_path=f"{tmp_dir}/model",
                  iterations=60)
    assert 0.0 <= out["accuracy"] <= 1.0 and out["auc"] > 0.8
    table = {r["class"]: r for r in out["per_class"].collect()}
    assert set(table) == {0, 1} and all(0 <= r["f1"] <= 1 for r in table.values())
    model = M.load_model(f"{tmp_dir}/model")
    te = out["predictions"].select(*S.TRAINING_FEATURES, "event_id", "label")
    again = model.transform(te).select("event_id", "prediction")
    first = out["predictions"].select("event_id", "prediction")
    assert again.exceptAll(first).count() == 0


def test_score_fallback_and_model(spark):
    ev = DM.table(spark, SF_SMALL, "events")
    ast = DM.asteroids(ev)
    fb = M.score(ast, None).select("ml_probability", "ml_risk_level").collect()
    assert all(0 <= r[0] <= 1 for r in fb)
    split = M.stratified_split(A.percentile_label(M.training_risk(DM.training_rows(ev)), "collision_risk"))
    model = M.train_classifier(split.where("split = 'train'"), None, iterations=20)
    scored = M.score(M.model_features(DM.with_model_inputs(ast)), model)
    assert scored.where("ml_probability IS NULL").count() == 0 and scored.count() == ast.count()


def test_per_class_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "label int, prediction int")
    t = {r["class"]: r for r in M.per_class_metrics(df).collect()}
    assert t[1]["precision"] == pytest.approx(0.5) and t[1]["recall"] == pytest.approx(0.5)
    assert t[0]["support"] == 3 and t[0]["precision"] == pytest.approx(2 / 3)


def test_split_resolves_ties_on_the_key(spark, monkeypatch):
    # force collisions: every row of a label gets one of three digests
    monkeypatch.setattr(M, "split_digest", lambda key_col, seed="42": (F.col(key_col) % 3).cast("string"))
    df = spark.createDataFrame([(i, i % 2) for i in range(101)], "event_id long, label int")
    out = M.stratified_split(df).collect()
    for label in (0, 1):
        rows = sorted((r["event_id"] % 3, r["event_id"], r["split"]) for r in out if r["label"] == label)
        n = len(rows)
        want = ["train" if i < int(0.6 * n) else "validation" if i < int(0.8 * n) else "test" for i in range(n)]
        assert [r[2] for r in rows] == want


def _rows(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] + 0.8 * rng.normal(size=n) > 0).astype(int)
    return spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y)], "a double, b double, label int")


def test_training_is_one_run_that_stops_early(spark, monkeypatch):
    starts, losses = [], []
    real = M.MultilayerPerceptronClassifier.setInitialWeights
    monkeypatch.setattr(M.MultilayerPerceptronClassifier, "setInitialWeights", lambda self, w: (starts.append(w), real(self, w))[1])
    monkeypatch.setattr(M, "log_loss", lambda pred, label="label", own=M.log_loss: (losses.append(own(pred, label)), losses[-1])[1])
    model = M.train_classifier(_rows(spark, 60, 1), _rows(spark, 200, 2), cols=["a", "b"], layers=(2, 16, 2), iterations=400,
                               step=10, patience=2)
    assert len(losses) < 40 and len(starts) == len(losses) - 1  # it ended early, every slice went on from the last
    assert losses.index(min(losses)) == len(losses) - 3
    kept = M.log_loss(model.transform(_rows(spark, 200, 2)))
    assert kept == pytest.approx(min(losses))


def test_score_without_a_scaler(spark):
    ev = DM.table(spark, SF_SMALL, "events")
    split = M.stratified_split(A.percentile_label(M.training_risk(DM.training_rows(ev)), "collision_risk"))
    network = M.train_classifier(split.where("split = 'train'"), None, iterations=10).stages[-1]
    df = M.model_features(DM.with_model_inputs(DM.asteroids(ev)))
    df = df.withColumn("albedo", F.when(F.col("event_id") % 5 > 0, F.col("albedo")))
    got = {r.event_id: r.ml_probability for r in M.score(df, network).collect()}
    plain = {r.event_id: r.ml_probability for r in M.score(df, None).collect()}
    assert all(got[i] == plain[i] for i in got if i % 5 == 0)
    first = df.where("event_id = 1").first()
    x = np.array([first[c] for c in S.TRAINING_FEATURES])
    layer, at = (x - x.mean()) / (x.std() + 1e-8), 0
    weights, sizes = network.weights.toArray(), network.getLayers()
    for a, b in zip(sizes, sizes[1:]):
        w, bias = weights[at:at + a * b].reshape((b, a), order="F"), weights[at + a * b:at + a * b + b]
        at += a * b + b
        layer = w @ layer + bias
        layer = np.exp(layer) / np.exp(layer).sum() if b == 2 and at == len(weights) else 1 / (1 + np.exp(-layer))
    assert got[1] == pytest.approx(layer[1], rel=1e-9)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_row_zscore_computes_mean_and_deviation_once(spark):
    """Neither is computed again for each element: the plan holds two sums over the array."""
    df = M.row_zscore(spark.createDataFrame([([1.0, 2.0, 6.0],), ([],), (None,), ([1.0, None],)], "features array<double>"))
    assert _plan(df).count("aggregate(") == 2
    got = [r.features_z for r in df.collect()]
    assert got[0] == pytest.approx([(x - 3) / ((14 / 3) ** 0.5 + 1e-8) for x in (1, 2, 6)])
    assert got[1:] == [[], None, [None, None]]


def test_split_deals_no_label_to_one_task(spark):
    """The rows are not shuffled by their label."""
    df = spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    split = M.stratified_split(df)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert split.where("split = 'train'").count() == 600


def test_training_rows_are_dealt_evenly(spark, monkeypatch):
    """Rows that come in one partition are learned from on all cores."""
    seen, fit = [], M.MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(M.MultilayerPerceptronClassifier, "fit",
                        lambda self, df: seen.append(df.rdd.glom().map(len).collect()) or fit(self, df))
    rows = spark.range(4000).select((F.col("id") % 2).alias("label"), F.rand(1).alias("a"), F.rand(2).alias("b")).coalesce(1)
    M.train_classifier(rows, None, cols=("a", "b"), layers=(2, 3, 2), iterations=2)
    cores = spark.sparkContext.defaultParallelism
    assert sum(seen[0]) == 4000 and max(seen[0]) <= 2 * 4000 / cores


def _even_rows(spark):
    """Blocks of 128 rows leave none over, so that Spark's mean over blocks is the mean over rows."""
    rows = spark.range(0, 4096, 1, 4).select((F.rand(3) + F.col("id") % 2 > 1).cast("int").alias("label"), F.array(
        F.randn(1) + F.col("id") % 2, F.randn(2)).alias("x"))
    return rows.select("label", M.array_to_vector("x").alias("features"))


def test_stacked_training_gives_the_weights_of_sparks(spark, tmp_dir):
    from pyspark.ml import classification

    _even_rows(spark).write.parquet(f"{tmp_dir}/rows")
    rows = spark.read.parquet(f"{tmp_dir}/rows")
    got, want = (c(layers=[2, 8, 4, 2], maxIter=12, seed=7).fit(rows)
                 for c in (M.MultilayerPerceptronClassifier, classification.MultilayerPerceptronClassifier))
    assert got.weights.toArray() == pytest.approx(want.weights.toArray(), rel=5e-3, abs=5e-3)
    assert M.log_loss(got.transform(rows)) == pytest.approx(M.log_loss(want.transform(rows)), rel=1e-5)


def test_every_gradient_is_one_stage_over_rows_stacked_once(spark, monkeypatch):
    from neo.operators import perceptron as NN

    stacked, used, stages = [], [], []
    tracker = spark.sparkContext.statusTracker()

    def objective(blocks, layers, own=NN.objective):
        def at(weights, cost=own(blocks, layers)):
            before = set(tracker.getJobIdsForGroup(None))
            out = cost(weights)
            stages.append([len(tracker.getJobInfo(j).stageIds) for j in set(tracker.getJobIdsForGroup(None)) - before])
            return out
        used.append(blocks)
        return at

    monkeypatch.setattr(NN, "stack", lambda *a, own=NN.stack: (stacked.append(own(*a)), stacked[-1])[1])
    monkeypatch.setattr(NN, "objective", objective)
    M.train_classifier(_rows(spark, 600, 1), _rows(spark, 200, 2), cols=["a", "b"], layers=(2, 4, 2), iterations=6, step=2)
    assert len(stacked) == 1 and all(b is stacked[0] for b in used) and not stacked[0].is_cached
    assert len(stages) > 6 and all(s in ([1], []) for s in stages)


def test_a_slice_starts_from_the_gradient_of_the_last_one(spark, monkeypatch):
    from neo.operators import perceptron as NN

    passes, starts = [], []
    monkeypatch.setattr(NN, "gradient_pass", lambda layers, w, own=NN.gradient_pass: (passes.append(w), own(layers, w))[1])
    monkeypatch.setattr(NN, "minimise", lambda cost, x, n, tol, own=NN.minimise: (starts.append(x), own(cost, x, n, tol))[1])
    M.train_classifier(_rows(spark, 600, 1), None, cols=["a", "b"], layers=(2, 4, 2), iterations=6, step=2)
    assert len(starts) == 3 and all(sum(np.array_equal(w, x) for w in passes) == 1 for x in starts)


def test_gradient_of_stacked_rows(spark):
    from neo.operators import perceptron as NN

    rng, layers = np.random.default_rng(5), [3, 5, 4, 3]
    weights = rng.normal(size=sum(a * b + b for a, b in zip(layers, layers[1:])))
    x, y = rng.normal(size=(2500, 3)).astype("float32"), rng.integers(0, 3, 2500).astype("int32")
    parts = [(x[:1500], y[:1500]), (x[1500:], y[1500:])]
    rows, loss, *grad = next(NN.gradient_pass(layers, weights)(parts))
    out, at = x.astype("float64"), 0
    for a, b in zip(layers, layers[1:]):
        out = out @ weights[at:at + a * b].reshape(a, b) + weights[at + a * b:at + a * b + b]
        at += a * b + b
        out = 1 / (1 + np.exp(-out)) if at < len(weights) else out - np.log(np.exp(out).sum(axis=1, keepdims=True))
    assert rows == 2500 and loss == pytest.approx(-out[np.arange(2500), y].sum(), rel=1e-6)
    for k in range(0, len(weights), 7):
        step = np.zeros_like(weights)
        step[k] = 1e-2
        high, low = (next(NN.gradient_pass(layers, w)(parts))[1] for w in (weights + step, weights - step))
        assert grad[k] == pytest.approx((high - low) / 2e-2, rel=2e-2, abs=0.1)


def test_labels_that_are_no_class_end_the_training(spark):
    for label in (2, None):
        rows = spark.createDataFrame([(0.5, 0), (0.1, 1), (0.3, label)], "a double, label int")
        with pytest.raises(Exception):
            M.train_classifier(rows, None, cols=["a"], layers=(1, 2, 2), iterations=2)


def test_split_puts_in_order_only_rows_near_the_cuts(spark, monkeypatch):
    from neo.operators import ranks as R

    ordered = []
    monkeypatch.setattr(R, "_dealt", lambda df, *a, own=R._dealt: (ordered.append(df.count()), own(df, *a))[1])
    i = F.col("id")
    rows = spark.range(20000).select(F.when(i % 50 > 0, i % 15000).alias("event_id"), F.when(i % 7 > 0, (i % 3).cast("int")).alias("label"))
    got = M.stratified_split(rows).collect()
    assert sum(ordered) < 2000
    digest = {r[0]: r[1] for r in rows.select("event_id", M.split_digest("event_id", "42")).distinct().collect()}
    for label in (None, 0, 1, 2):
        mine = [r for r in got if r["label"] == label]
        at = sorted((digest[r["event_id"]] or "", -1 if r["event_id"] is None else r["event_id"]) for r in mine)
        train, validation = at[int(0.6 * len(at)) - 1], at[int(0.8 * len(at)) - 1]
        for r in mine:
            own = (digest[r["event_id"]] or "", -1 if r["event_id"] is None else r["event_id"])
            assert r["split"] == ("train" if own <= train else "validation" if own <= validation else "test")


@pytest.mark.parametrize("name", ["m8_score_model", "m9_save_load"])
def test_scored_rows_are_not_broadcast(spark, monkeypatch, name):
    """However small their files are: the other side holds as many rows."""
    from neo.plans import catalog

    monkeypatch.setattr(M, "train_classifier", lambda *a, own=M.train_classifier: own(*a, iterations=2))
    df = catalog.REGISTRY[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert df.first()["n"] == {"m8_score_model": 1000, "m9_save_load": 200}[name]


def test_gradients_of_many_partitions_are_added_on_the_way(spark, monkeypatch):
    """More partitions than the driver takes at once give the same sums, in one more stage."""
    from neo.operators import perceptron as NN

    rows = _even_rows(spark).repartition(12, "features").persist()
    weights = np.linspace(-1, 1, 2 * 3 + 3 + 3 * 2 + 2)
    blocks = NN.stack(rows, "features", "label", 2)
    loss, grad = NN.objective(blocks, [2, 3, 2])(weights)
    monkeypatch.setattr(NN, "DIRECT_PARTITIONS", 4)
    again, summed = NN.objective(blocks, [2, 3, 2])(weights)
    assert blocks.getNumPartitions() == 12 and again == pytest.approx(loss) and summed == pytest.approx(grad)
    blocks.unpersist()
    rows.unpersist()
