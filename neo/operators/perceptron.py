"""Spark ML's multilayer perceptron, trained by matrix passes over stacked rows.

Spark's own trainer multiplies blocks of 128 rows in the JVM and sums the gradients in two stages, and
a training asks for some hundred gradients.  Here the rows are stacked once into blocks of numbers, kept
by the executors, and every gradient is one stage of numpy passes over all of them.  The rest follows Spark:
starting weights, network (sigmoid layers, softmax with cross-entropy), L-BFGS of ten corrections with
a strong Wolfe line search, its tests of convergence, and the model.  The loss is the mean over
the rows (Spark's is that over the blocks, so that the short last block of a partition weighs more).
"""

from __future__ import annotations

from collections.abc import Callable
from operator import add

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml import classification
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.ml.common import _java2py, _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a stacked block, and rows that a numpy pass works on at a time (its layers then stay in the cache).
BLOCK_ROWS, PASS_ROWS = 8192, 1024
#: Partial sums come to the driver from so many partitions at once; from more they are added up on the way.
DIRECT_PARTITIONS = 64
CORRECTIONS, LINE_STEPS, ZOOM_STEPS, VALUES_KEPT = 10, 10, 10, 20


class SearchFailed(Exception):
    """The line search found no step, or the history gives no direction."""


def stack(df: DataFrame, features: str, label: str, classes: int) -> RDD:
    """The rows as blocks ``(matrix of features, classes)``, kept on the executors' disks until
    ``unpersist``.  Features are single precision, as in the reference.  A label that is not a class
    ends the job."""
    rows_at_once = BLOCK_ROWS

    def packed(batches):
        import pyarrow as pa

        kept, n = [], 0

        def block(parts):
            x, y = (np.concatenate(p) for p in zip(*parts))
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["x", "y"])

        for b in batches:
            for s in range(0, b.num_rows, rows_at_once):
                part = b.slice(s, rows_at_once)
                y = part.column(1).to_numpy(zero_copy_only=False).astype("float64")  # null is NaN
                wrong = ~((y >= 0) & (y < classes) & (y == np.floor(y)))
                if wrong.any():
                    raise ValueError(f"label {y[wrong][0]} is not one of the {classes} classes")
                kept.append((part.column(0).flatten().to_numpy(zero_copy_only=False).astype("float32"), y.astype("int32")))
                n += part.num_rows
                if n >= rows_at_once:
                    yield block(kept)
                    kept, n = [], 0
        if kept:
            yield block(kept)

    def matrices(rows):
        for x, y in rows:
            y = np.frombuffer(y, "int32")
            yield np.frombuffer(x, "float32").reshape(len(y), -1), y

    rows = df.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"))
    return rows.mapInArrow(packed, "x binary, y binary").rdd.mapPartitions(matrices).persist(StorageLevel.DISK_ONLY)


def gradient_pass(layers: list[int], weights: np.ndarray) -> Callable:
    """A function of stacked blocks that gives ``(rows, sum of the losses, sum of the gradients)``, once.
    The layers are single precision; the softmax, the loss and all sums are double."""
    at_once = PASS_ROWS

    def run(blocks):
        net, total, at = [], np.zeros_like(weights), 0
        for a, b in zip(layers, layers[1:]):  # Spark's layout: the weights of a layer by input, then its biases
            end = at + a * b
            # a sigmoid is 1 / (1 + exp(-z)): the layers hold -w and -b, so that no pass is needed for the sign
            net.append((-weights[at:end].reshape(a, b).astype("float32"), weights[end:end + b].astype("float32"),
                        total[at:end].reshape(a, b), total[end:end + b]))
            at = end + b
        ones, rows, loss = np.ones(at_once, "float32"), 0, 0.0
        with np.errstate(over="ignore", invalid="ignore"):  # exp of a very negative input: the sigmoid is 0
            for features, classes in blocks:
                for s in range(0, len(classes), at_once):
                    y = classes[s:s + at_once]
                    n, outs = len(y), [features[s:s + at_once]]
                    for w, b, _, _ in net:
                        z = outs[-1] @ w
                        z -= b
                        if len(outs) < len(net):
                            np.exp(z, out=z)
                            z += 1
                            np.reciprocal(z, out=z)
                        outs.append(z)
                    z = -outs.pop().T.astype("float64", order="C")  # a row per class: numpy is slow along short rows
                    z -= z.max(axis=0)
                    delta = np.exp(z)
                    sums = delta.sum(axis=0)
                    own = (y, np.arange(n))
                    loss += float((np.log(sums) - z[own]).sum())
                    delta /= sums
                    delta[own] -= 1.0
                    delta = delta.T.astype("float32", order="C")
                    rows += n
                    for k in range(len(net) - 1, -1, -1):
                        w, _, gw, gb = net[k]
                        gw += outs[k].T @ delta
                        gb += ones[:n] @ delta
                        if k:  # delta w (1 - out) out, with -w and out - 1
                            delta = delta @ w.T
                            delta *= outs[k]
                            outs[k] -= 1
                            delta *= outs[k]
        yield np.concatenate([[rows, loss], total])

    return run


def objective(blocks: RDD, layers: list[int]) -> Callable:
    """Mean loss and gradient of weights over all stacked rows.  The last answer is kept: a slice of a
    training starts from the weights that the one before ended with."""
    depth = 1 if blocks.getNumPartitions() <= DIRECT_PARTITIONS else 2
    known: list = [None, None]

    def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        if known[0] is None or not np.array_equal(known[0], weights):
            rows, loss, *_ = sums = blocks.mapPartitions(gradient_pass(layers, weights)).treeReduce(add, depth)
            if not rows:
                raise ValueError("no rows to learn from")
            known[:] = weights.copy(), (loss / rows, sums[2:] / rows)
        return known[1]

    return at


def _direction(grad: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Two-loop recursion over ``(step, change of the gradient)``, the newest first."""
    d, kept = grad.copy(), []
    for step, change in history:
        rho = step @ change
        a = step @ d / rho if rho else np.nan
        if np.isnan(a):
            raise SearchFailed("history is not a number")
        d -= a * change
        kept.append((a, rho))
    if history:
        step, change = history[0]
        curvature = step @ change
        if curvature < 0 or np.isnan(curvature):
            raise SearchFailed("curvature is negative")
        d *= curvature / (change @ change)
    for (step, change), (a, rho) in zip(reversed(history), reversed(kept)):
        d += (a - change @ d / rho) * step
    return -d


def _between(left: tuple, right: tuple) -> float:
    """Minimum of the cubic through two points ``(t, value, slope)``, a tenth away from both at least."""
    (lt, lv, ls), (rt, rv, rs) = left, right
    d1 = ls + rs - 3 * (lv - rv) / (lt - rt)
    square = d1 * d1 - ls * rs
    d2 = square ** 0.5 if square >= 0 else np.nan
    below = rs - ls + 2 * d2
    t = rt - (rt - lt) * (rs + d2 - d1) / below if below else np.nan
    low, high = lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)
    return low if t < low else high if t > high else t


def _step(phi: Callable, start: tuple, t: float) -> float:
    """A step that meets the strong Wolfe conditions.  ``phi(t)`` and ``start`` are ``(t, value, slope)``."""
    _, value, slope = low = start
    if slope > 0:
        raise SearchFailed("direction does not descend")

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(ZOOM_STEPS):
            c = phi(_between(high, low) if low[0] > high[0] else _between(low, high))
            if c[1] > value + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= 0.9 * abs(slope):
                return c[0]
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise SearchFailed("no step between two bounds")

    for k in range(LINE_STEPS):
        c = phi(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * slope or (k and c[1] >= low[1]):
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(slope):
            return c[0]
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise SearchFailed("no step")


def minimise(cost: Callable, x: np.ndarray, iterations: int, tolerance: float) -> tuple[np.ndarray, list[float]]:
    """L-BFGS as Spark runs it: the last weights and the losses of all iterations, the starting one first."""
    value, grad = cost(x)
    first, last, recent, history, losses, failed, turn = value, (x, value, grad), [float("inf")], [], [value], False, 0

    def along(t: float, d: np.ndarray) -> tuple:
        nonlocal last
        y = x + t * d
        if not np.array_equal(y, last[0]):
            last = (y, *cost(y))
        return t, last[1], last[2] @ d

    while turn < iterations:
        if len(recent) > 1 and abs(value - max(recent)) <= tolerance * first:
            break
        if np.linalg.norm(grad) <= max(tolerance * value, 1e-8):
            break
        try:
            d = _direction(grad, history)
            t = _step(lambda t: along(t, d), (0.0, value, grad @ d), 1.0 if turn else 1.0 / np.linalg.norm(d))  # noqa: B023
            if t * np.linalg.norm(grad) < 1e-10:
                raise SearchFailed("step is too small")
        except SearchFailed:
            if failed:
                break
            failed, history = True, []
            continue
        along(t, d)
        y, new_value, new_grad = last
        history = [(y - x, new_grad - grad), *history][:CORRECTIONS]
        x, value, grad, failed, turn = y, new_value, new_grad, False, turn + 1
        recent = [*recent, value][-VALUES_KEPT:]
        losses.append(value)
    return x, losses


class MultilayerPerceptronClassifier(classification.MultilayerPerceptronClassifier):
    """Spark's classifier with its parameters (solver ``l-bfgs``) and its model; ``cost`` may be the
    :func:`objective` of the rows of ``fit``, for trainings that go over the same rows again."""

    cost: Callable | None = None

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        if self.getSolver() != "l-bfgs":
            return super()._fit(dataset)
        sc, layers = dataset.sparkSession.sparkContext, list(self.getLayers())
        if self.isSet(self.initialWeights):
            start = self.getInitialWeights()
        else:
            sizes = sc._gateway.new_array(sc._jvm.int, len(layers))
            for i, n in enumerate(layers):
                sizes[i] = n
            network = sc._jvm.org.apache.spark.ml.ann.FeedForwardTopology.multiLayerPerceptron(sizes, True)
            start = _java2py(sc, network.model(self.getSeed()).weights())
        blocks, cost = None, self.cost
        try:
            if cost is None:
                blocks = stack(dataset, self.getFeaturesCol(), self.getLabelCol(), layers[-1])
                cost = objective(blocks, layers)
            weights, _ = minimise(cost, start.toArray(), self.getMaxIter(), self.getTol())
        finally:
            if blocks is not None:
                blocks.unpersist()
        java = self._new_java_obj("org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel",
                                  self.uid, _py2java(sc, Vectors.dense(weights)))
        return self._copyValues(self._create_model(java))
