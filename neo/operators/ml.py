"""Machine learning on tables (F31-F33, M1-M9) with Spark ML.

Training is distributed (Spark ML aggregates gradients across partitions);
scoring is ``model.transform`` over whole partitions, never one row per call.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neo import constants as K
from neo import schemas as S
from neo.functions.risk import risk_ladder
from neo.functions.vector import distance3, norm3
from neo.operators import perceptron as NN
from neo.operators import ranks as R
from neo.operators.collision import model_fallback_probability_col
from neo.operators.perceptron import MultilayerPerceptronClassifier
from neo.session import scratch_path
from neo.sources.tables import remove

#: Hex digits of the split's digest by which a label's rows are counted.
HEAD_DIGITS = 3
MODEL_INPUTS = ("orbital_eccentricity", "inclination_deg", "albedo", "rotation_period_h", "surface_temp_k")


# --- F31-F33 ---------------------------------------------------------------
def model_features(df: DataFrame) -> DataFrame:
    """the ten model features of an asteroid record, in ``TRAINING_FEATURES``
    order.  Missing size -> 1 km, mass -> 1e12 kg, position / velocity -> zero
    vectors.  The five unobserved inputs (``MODEL_INPUTS``) must be columns."""
    z = F.lit(0.0)
    px, py, pz = (F.coalesce(F.col(f"position.{c}"), z) for c in "xyz")
    vx, vy, vz = (F.coalesce(F.col(f"velocity.{c}"), z) for c in ("vx", "vy", "vz"))
    feats = {
        "diameter_km": F.coalesce(F.col("size"), F.lit(K.DEFAULT_ASTEROID_SIZE_KM)),
        "velocity_km_s": norm3(vx, vy, vz),
        "distance_earth_au": distance3(px, py, pz, K.AU_KM, 0.0, 0.0) / F.lit(K.AU_KM),
        "mass_kg": F.coalesce(F.col("mass"), F.lit(K.DEFAULT_ASTEROID_MASS_KG)),
        "orbital_eccentricity": F.col("orbital_eccentricity"),
        "inclination_deg": F.col("inclination_deg"),
        "approach_angle": F.atan2(vy, vx),
        "albedo": F.col("albedo"), "rotation_period_h": F.col("rotation_period_h"),
        "surface_temp_k": F.col("surface_temp_k"),
    }
    return df.withColumns(feats)


def row_zscore(df: DataFrame, col: str = "features", out: str = "features_z") -> DataFrame:
    """F32: standardise each row's own array: (f - mean) / (population std + 1e-8).
    Array higher-order functions, evaluated inside the JVM."""
    one = F.array(F.transform(F.col(col), lambda x: x.cast("double")))

    def average(total: Column, of: Column) -> Column:
        return F.try_divide(total, F.size(of).cast("double"))

    # mean and deviation are fields of the only element of an array: as columns of their own they would be
    # put into the function over the elements, and computed again for each
    one = F.transform(one, lambda r: F.struct(
        r.alias("a"), average(F.aggregate(r, F.lit(0.0), lambda s, x: s + x), r).alias("m")))
    one = F.transform(one, lambda r: F.struct(r["a"].alias("a"), r["m"].alias("m"), F.sqrt(average(F.aggregate(
        r["a"], F.lit(0.0), lambda s, x: s + (x - r["m"]) * (x - r["m"])), r["a"])).alias("s")))
    return df.withColumn(out, F.transform(
        one, lambda r: F.transform(r["a"], lambda x: (x - r["m"]) / (r["s"] + F.lit(K.ZSCORE_EPSILON))))[0])


def _clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def training_risk(df: DataFrame, noise_col: str | None = "noise", out: str = "collision_risk") -> DataFrame:
    """weighted physical risk score in [0, 1] (noise is an input column)."""
    ws, wv, wd, we, wa = (F.lit(w) for w in K.TRAINING_RISK_WEIGHTS)
    size_r = _clip01((F.col("diameter_km") - F.lit(0.5)) / F.lit(2.0))
    vel_r = _clip01((F.col("velocity_km_s") - F.lit(15.0)) / F.lit(20.0))
    dist_r = _clip01(F.lit(2.0) / (F.col("distance_earth_au") + F.lit(0.1)))
    total = (ws * size_r + wv * vel_r + wd * dist_r + we * F.col("orbital_eccentricity")
             + wa * F.abs(F.sin(F.col("approach_angle"))))
    noise = F.col(noise_col) if noise_col else F.lit(0.0)
    return df.withColumn(out, _clip01(total + noise))


# --- M1-M3: batch feature vector -------------------------------------------
def fill_features(df: DataFrame, cols=S.ML_FEATURES) -> DataFrame:
    """M1: nulls -> 0 in the feature columns (one projection)."""
    return df.fillna(0.0, subset=list(cols))


def assemble(df: DataFrame, cols=S.ML_FEATURES, out: str = "features") -> DataFrame:
    """M2."""
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def scale(df: DataFrame, col: str = "features", out: str = "scaled_features", with_mean: bool = False):
    """M3: divide by the sample standard deviation (Spark defaults: no centering).
    Returns ``(frame, fitted scaler)``."""
    model = StandardScaler(inputCol=col, outputCol=out, withStd=True, withMean=with_mean).fit(df)
    return model.transform(df), model


def unpack(df: DataFrame, col: str, names) -> DataFrame:
    """Vector column -> one double column per name."""
    arr = vector_to_array(F.col(col))
    return df.withColumns({n: arr[i] for i, n in enumerate(names)})


# --- M4-M9: training ---------------------------------------------------------
def split_digest(key_col: str, seed: str = K.SPLIT_SEED) -> Column:
    """md5(key || seed) as hex text: the order of the rows in the split."""
    return F.md5(F.concat(F.col(key_col).cast("string"), F.lit(seed)))


def _landed(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stratified_split(df: DataFrame, label: str = "label", key: str = "event_id",
                     fractions=K.SPLIT_FRACTIONS, seed: str = K.SPLIT_SEED) -> DataFrame:
    """M4: exact, repeatable stratified split.

    Within each label, rows are ranked by (whole md5, ``key``); rank < floor(f1 n)
    is ``train``, < floor((f1+f2) n) is ``validation``, the rest ``test``.  The last row of a
    part is an order statistic of each label: rows are counted by the head of their digest, and only
    those under the head that holds a cut are put in order (:mod:`neo.operators.ranks`).  Any number of
    labels is one plan, no label is sorted in one task, and nothing comes to the driver.  The rows are read once
    more against the table of cuts, one row a label.  That table is written first: its size is then known
    before the join, and the rows of a large label are not dealt to one task."""
    digest = split_digest(key, seed)
    own = F.struct(digest.alias("d"), F.col(key).alias("k"))
    rows = df.select(F.col(label).alias("_of"), F.substring(digest, 1, HEAD_DIGITS).alias("_head"), own.alias("_own"))
    of = Window.partitionBy("_of")
    heads = rows.groupBy("_of", "_head").agg(F.count(F.lit(1)).alias("c")).select(
        "_of", "_head", "c", F.sum("c").over(of).alias("n"),
        (F.sum("c").over(of.orderBy("_head").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before"))
    at = F.array(*[F.struct(F.lit(name).alias("name"), (F.floor(F.lit(f) * F.col("n")) - 1).alias("k"))
                   for name, f in (("_train", fractions[0]), ("_validation", fractions[0] + fractions[1]))])
    inside = F.col("k").between(F.col("before"), F.col("before") + F.col("c") - 1)
    wanted = _landed(heads.withColumn("r", F.explode(at)).select("*", "r.*").where(inside).select(
        "_of", "_head", "name", (F.col("k") - F.col("before")).alias("k")), "heads")
    keys = ["_of", "_head"]
    near = R.match(rows, wanted.select(*keys).distinct(), keys, "left_semi")
    found = R.match(R.running_totals(near, "_own", {"c": F.lit(1)}, keys), wanted, keys).where(
        F.col("k").between(F.col("c_before"), F.col("c_before") + F.col("c") - 1))
    cuts = _landed(found.groupBy("_of").agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n)
                                              for n in ("_train", "_validation")]), "cuts")
    joined = df.join(cuts, F.col(label).eqNullSafe(F.col("_of")), "left")
    split = F.when(own <= F.col("_train"), "train").when(own <= F.col("_validation"), "validation").otherwise("test")
    return joined.select(*[df[c] for c in df.columns], split.alias("split"))


def fit_scaler(train: DataFrame, cols=S.TRAINING_FEATURES, out: str = "scaled"):
    """M5: centre and scale with statistics of the training rows only.
    Returns a fitted ``PipelineModel`` (assembler + scaler) to apply to any split.
    Note: Spark's scaler uses the sample std (the reference's library the population one)."""
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="__raw"),
                            StandardScaler(inputCol="__raw", outputCol=out, withMean=True, withStd=True)])
    return pipe.fit(train)


def probability_of_one(df: DataFrame, col: str = "probability") -> Column:
    """Probability of class 1 as a double; a model's probability vector or a plain column."""
    return vector_to_array(F.col(col))[1] if df.schema[col].dataType.typeName() == "vectorudt" else F.col(col).cast("double")


def log_loss(pred: DataFrame, label: str = "label") -> float:
    """Mean binary cross-entropy of scored rows."""
    p = F.least(F.greatest(probability_of_one(pred), F.lit(1e-12)), F.lit(1 - 1e-12))
    return pred.agg(F.avg(-F.log(F.when(F.col(label) == 1, p).otherwise(1 - p)))).first()[0]


def train_classifier(train: DataFrame, validation: DataFrame | None = None, cols=S.TRAINING_FEATURES,
                     label: str = "label", layers=(10, 64, 32, 16, 2), iterations: int = 300, step: int = 20,
                     patience: int = 3, algorithm: str = "mlp", seed: int = 42) -> PipelineModel:
    """M6: assembler + scaler (fitted on train) + classifier as one pipeline.

    ``mlp`` is a 10-64-32-16-2 perceptron (the reference's network shape; Spark ML
    has no batch-norm or dropout).  One run is trained in slices of ``step`` iterations, each starting
    from the weights of the one before.  After a slice the loss on the validation rows is measured; after
    ``patience`` slices without a better one the run ends, and the best slice's weights are the
    model.  The scaled rows are written once, dealt evenly over the cores, and stacked once into the
    blocks that every slice goes over (:mod:`neo.operators.perceptron`).

    ``algorithm="rf"`` trains a random forest instead.  Rows with a missing feature are not
    learned from; the model scores them as NaN, which :func:`score` replaces."""
    train = train.dropna(subset=list(cols))
    stages = [VectorAssembler(inputCols=list(cols), outputCol="__raw", handleInvalid="keep"),
              StandardScaler(inputCol="__raw", outputCol="features_scaled", withMean=True, withStd=True)]
    if algorithm == "rf":
        clf = RandomForestClassifier(featuresCol="features_scaled", labelCol=label, numTrees=50, seed=seed)
        return Pipeline(stages=stages + [clf]).fit(train)
    spark = train.sparkSession
    prepared = Pipeline(stages=stages).fit(train)
    path, blocks, layers = scratch_path(spark, "training"), None, [len(cols), *layers[1:]]

    def landed(df: DataFrame, name: str) -> DataFrame:
        scaled = prepared.transform(df).select(label, "features_scaled")
        scaled.repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    try:
        rows = landed(train, "train")
        blocks = NN.stack(rows, "features_scaled", label, layers[-1])
        cost = NN.objective(blocks, layers)
        held = landed(validation.dropna(subset=list(cols)), "validation") if validation is not None else None
        best, least, waited, weights = None, float("inf"), 0, None
        for done in range(0, iterations, step):
            clf = MultilayerPerceptronClassifier(
                featuresCol="features_scaled", labelCol=label, layers=layers,
                maxIter=min(step, iterations - done), blockSize=128, seed=seed)
            clf.cost = cost
            if weights is not None:
                clf = clf.setInitialWeights(weights)
            model = clf.fit(rows)
            weights = model.weights
            if held is None:
                best = model
                continue
            loss = log_loss(model.transform(held), label)
            if best is None or loss < least:
                best, least, waited = model, loss, 0
            else:
                waited += 1
                if waited >= patience:
                    break
        return PipelineModel(stages=[*prepared.stages, best])
    finally:
        if blocks is not None:
            blocks.unpersist()
        remove(spark, path)


def per_class_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M7 (table part): precision, recall, F1 and support per class.  Two tiny
    grouped aggregates (one row per class) joined on the class."""
    lab = pred.groupBy(F.col(label).cast("int").alias("class")).agg(
        F.count(F.lit(1)).alias("support"),
        F.count_if(F.col(prediction).cast("int") == F.col(label).cast("int")).alias("true_positives"))
    prd = pred.groupBy(F.col(prediction).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("predicted"))
    j = lab.join(prd, "class", "full_outer").fillna(0, subset=["support", "true_positives", "predicted"])
    precision = F.coalesce(F.try_divide(F.col("true_positives").cast("double"), F.col("predicted").cast("double")),
                           F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("true_positives").cast("double"), F.col("support").cast("double")),
                        F.lit(0.0))
    j = j.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"),
                                 F.col("precision") + F.col("recall")), F.lit(0.0))
    return j.withColumn("f1", f1).select("class", "precision", "recall", "f1", "support")


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M7 (accuracy at threshold 0.5 = the predicted class)."""
    return pred.agg(F.count(F.lit(1)).alias("n"),
                    F.avg((F.col(prediction).cast("int") == F.col(label).cast("int")).cast("double")).alias("accuracy"))


def roc_auc(pred: DataFrame, score: str = "probability", label: str = "label") -> DataFrame:
    """M7 (ROC-AUC): the exact share of (positive, negative) pairs that the score puts in order, ties as
    half: ``auc``, one row; null without both classes.  Rows without a score are left out.

    The ranks are running totals over the distinct scores (:mod:`neo.operators.ranks`): no task sorts them
    all, and no threshold is left out as in a binned curve."""
    rows = pred.select(probability_of_one(pred, score).alias("p"), F.col(label).alias("y"))
    totals = R.running_totals(rows, "p", {"pos": (F.col("y") == 1).cast("long"), "neg": (F.col("y") == 0).cast("long")})
    pos, neg, before = (F.col(c).cast("decimal(19, 0)") for c in ("pos", "neg", "neg_before"))
    ordered = F.sum((2 * pos * before + pos * neg).cast("decimal(38, 0)")).cast("double")
    return totals.agg(F.try_divide(ordered, 2.0 * F.max("pos_all") * F.max("neg_all")).alias("auc"))


def evaluate(pred: DataFrame, label: str = "label") -> dict:
    """M7: accuracy, ROC-AUC and the per-class table."""
    return {"accuracy": accuracy(pred, label).first()["accuracy"], "auc": roc_auc(pred, label=label).first()["auc"],
            "per_class": per_class_metrics(pred, label)}


def score(df: DataFrame, model: PipelineModel | MultilayerPerceptronClassificationModel | None, factor_col: str | None = None) -> DataFrame:
    """M8: ``ml_probability`` (probability of class 1) and ``ml_risk_level`` (model
    ladder) per record; without a model, or where the model gives no
    probability (a missing feature), the fallback formula F28 is used.  ``model`` is a pipeline with its
    scaler, or a bare classifier: without a scaler every record is standardised by itself (F32)."""
    speed = norm3(F.col("velocity.vx"), F.col("velocity.vy"), F.col("velocity.vz")) \
        if "velocity" in df.columns else F.col("velocity_km_s")
    size = F.col("size") if "size" in df.columns else F.col("diameter_km")
    fallback = model_fallback_probability_col(size, speed, F.col(factor_col) if factor_col else None)
    if model is None:
        out = df.withColumn("ml_probability", fallback)
    elif not isinstance(model, PipelineModel):  # a network saved without its scaler: F32
        features = F.array(*[F.col(c).cast("double") for c in S.TRAINING_FEATURES])
        complete = ~F.exists(F.col("__features"), lambda x: x.isNull() | F.isnan(x))
        rows = row_zscore(df.withColumn("__features", features), "__features", "__z")
        some = F.when(complete, F.col("__z")).otherwise(F.array(*[F.lit(0.0)] * len(S.TRAINING_FEATURES)))
        scored = model.transform(rows.withColumn(model.getFeaturesCol(), array_to_vector(some)))
        p = F.when(complete, vector_to_array(F.col("probability"))[1])
        out = scored.select(*df.columns, F.coalesce(p, fallback).alias("ml_probability"))
    else:
        for stage in model.stages:
            if isinstance(stage, VectorAssembler):  # a missing feature must not end the job
                stage.setHandleInvalid("keep")
        scored = model.transform(df)
        p = vector_to_array(F.col("probability"))[1]
        p = F.when(~F.isnan(p), p)
        keep = [c for c in df.columns]
        out = scored.select(*keep, F.coalesce(p, fallback).alias("ml_probability"))
    return out.withColumn("ml_risk_level", risk_ladder(F.col("ml_probability"), "model"))


def save_model(model: PipelineModel, path: str) -> None:
    """M9: assembler, scaler and classifier saved together."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """M9."""
    return PipelineModel.load(path)
