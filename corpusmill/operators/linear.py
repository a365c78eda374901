"""Linear classifiers of all folds and classes at once.

Each class of each fold has a one-against-rest machine over the fold's training part: the regularised
mean of squared hinge losses (`svm`) or logistic ones (`logistic`).  The coefficients are the columns of one matrix;
an iteration of the optimiser is one pass over the instances, which adds up losses and gradients of
all columns, task by task and then in a tree.  The optimiser (limited-memory BFGS, each column with
its own memory and step) works on the driver on that matrix, whose size is features * folds * classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stored

#: numbers in the matrix of coefficients
MOST_CELLS = 1 << 24
MEMORY = 8
ROWS_AT_ONCE = 1024


class Batched:
    """Instances in sparse rows, and their machines.  `fold_of` (instance_id, test_fold): a fold's machines don't learn from its test part, and null is tested by none; without it one machine for each class learns from all."""

    def __init__(self, features: DataFrame, space: DataFrame, class_map: DataFrame, fold_of: DataFrame | None = None, kind: str = "svm", l2: float = 0.01):
        if kind not in ("svm", "logistic"):
            raise ValueError(kind)
        self.kind, self.l2, self.space = kind, l2, space
        self.size = space.count() + 1  # the last coefficient is the intercept, which isn't regularised
        self.labels = sorted(r.label for r in class_map.select("label").distinct().collect())  # small closed spaces
        self.folds = sorted(r.test_fold for r in fold_of.select("test_fold").distinct().collect() if r.test_fold is not None) if fold_of is not None else [None]
        self.columns = len(self.labels) * len(self.folds)
        if self.size * self.columns > MOST_CELLS:
            raise ValueError(f"more than {MOST_CELLS} coefficients")
        self.rows = stored(self._rows(features, class_map, fold_of))
        self.weights = np.zeros((self.size, self.columns))

    def _rows(self, features: DataFrame, class_map: DataFrame, fold_of: DataFrame | None) -> DataFrame:
        """(instance_id, i, x, y, fold): features and values, the places of the labels, and the fold that tests it (-1: none)."""
        cells = features.join(self.space, "feature").select("instance_id", F.struct(F.col("idx").cast("int").alias("i"), F.col("value").cast("double").alias("x")).alias("c"))
        own = cells.groupBy("instance_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
        y = class_map.select("instance_id", (F.array_position(F.lit(self.labels), F.col("label")) - 1).cast("int").alias("l")).groupBy("instance_id").agg(F.collect_set("l").alias("y"))
        ids = class_map.select("instance_id").distinct()
        if fold_of is not None:
            ids = ids.join(fold_of.select("instance_id", F.coalesce(F.array_position(F.lit(self.folds), F.col("test_fold")) - 1, F.lit(-1)).cast("int").alias("fold")), "instance_id")
        else:
            ids = ids.withColumn("fold", F.lit(-1))
        none = F.array().cast("array<struct<i:int,x:double>>")
        rows = ids.join(y, "instance_id").join(own, "instance_id", "left").withColumn("c", F.coalesce("c", none))
        return rows.select("instance_id", F.col("c.i").alias("i"), F.col("c.x").alias("x"), "y", "fold")

    def _blocks(self):
        size, classes, n_folds = self.size, len(self.labels), len(self.folds)

        def lists(column):
            return column.values.to_numpy(), column.offsets.to_numpy()

        def blocks(batch):
            """(dense rows, targets of all columns, which rows each column learns from)."""
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                n = part.num_rows
                x, y = np.zeros((n, size)), -np.ones((n, classes))
                (i, at), (v, _), (l, at_l) = (lists(part.column(c)) for c in (0, 1, 2))
                i, v, l = i[at[0] : at[-1]], v[at[0] : at[-1]], l[at_l[0] : at_l[-1]]
                x[np.repeat(np.arange(n), np.diff(at)), i] = v
                x[:, -1] = 1
                y[np.repeat(np.arange(n), np.diff(at_l)), l] = 1
                fold = part.column(3).to_numpy(zero_copy_only=False)
                learns = np.repeat(fold[:, None] != np.arange(n_folds)[None, :], classes, axis=1).astype(float)
                yield x, np.tile(y, n_folds), learns

        return blocks

    def pass_over(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(loss, gradient) of all columns."""
        blocks, kind, shape = self._blocks(), self.kind, weights.shape
        shared = self.rows.sparkSession.sparkContext.broadcast(weights)
        names = ["part", "sums"]

        def own(batches):
            total = np.zeros((shape[0] + 2, shape[1]))  # gradient, loss and number of instances
            for batch in batches:
                for x, y, learns in blocks(batch):
                    margin = y * (x @ shared.value)
                    if kind == "svm":
                        gap = np.maximum(0, 1 - margin)
                        loss, slope = gap * gap, -2 * gap * y
                    else:
                        loss, slope = np.logaddexp(0, -margin), -y / (1 + np.exp(np.minimum(margin, 700)))
                    total[:-2] += x.T @ (slope * learns)
                    total[-2] += (loss * learns).sum(axis=0)
                    total[-1] += learns.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names)

        def added(batches):
            total = None
            for batch in batches:
                for b in batch.column(1).to_pylist():
                    one = np.frombuffer(b)
                    total = one if total is None else total + one
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names)

        schema = "part long, sums binary"
        parts = self.rows.select("i", "x", "y", "fold").mapInArrow(own, schema)
        width = max(1, int(self.rows.rdd.getNumPartitions() ** 0.5))
        found = parts.repartition(width).mapInArrow(added, schema).collect()  # a matrix for each of few tasks
        total = sum(np.frombuffer(r.sums) for r in found).reshape(shape[0] + 2, shape[1])
        shared.unpersist()
        n = np.maximum(total[-1], 1)
        w = weights.copy()
        w[-1] = 0
        return total[-2] / n + self.l2 / 2 * (w * w).sum(axis=0), total[:-2] / n + self.l2 * w

    def fit(self, rounds: int = 200, tolerance: float = 1e-6) -> Batched:
        """Iterate until no gradient's largest entry exceeds the tolerance; each column stops by itself."""
        w = self.weights
        loss, slope = self.pass_over(w)
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(rounds):
            open_ = np.abs(slope).max(axis=0) > tolerance
            if not open_.any():
                break
            # two-loop recursion, a column each
            d, kept = -slope, []
            for s, y, r in reversed(steps):
                a = r * (s * d).sum(axis=0)
                d = d - a * y
                kept.append(a)
            if steps:
                s, y, r = steps[-1]
                scale = np.where(r > 0, (s * y).sum(axis=0) / np.maximum((y * y).sum(axis=0), 1e-300), 1.0)
            else:
                scale = 1 / np.maximum(1, np.abs(slope).sum(axis=0))
            d = d * scale
            for (s, y, r), a in zip(steps, reversed(kept)):
                d = d + (a - r * (y * d).sum(axis=0)) * s
            down = (d * slope).sum(axis=0)
            bad = down >= 0
            d[:, bad], down[bad] = -slope[:, bad], -(slope[:, bad] ** 2).sum(axis=0)
            length = open_.astype(float)
            for _ in range(30):
                tried = w + length * d
                new_loss, new_slope = self.pass_over(tried)
                far = open_ & (length > 0) & (new_loss > loss + 1e-4 * length * down + 1e-15)
                if not far.any():
                    break
                length = np.where(far, length / 2, length)
            s, y = tried - w, new_slope - slope
            sy = (s * y).sum(axis=0)
            steps = [*steps, (s, y, np.where(sy > 1e-18, 1 / np.where(sy > 1e-18, sy, 1), 0.0))][-MEMORY:]
            w, loss, slope = tried, new_loss, new_slope
        self.weights = w
        return self

    def scores(self) -> DataFrame:
        """(fold, instance_id, label, score) of each fold's test part; without folds of all instances."""
        blocks, labels, classes, folds = self._blocks(), self.labels, len(self.labels), self.folds
        shared = self.rows.sparkSession.sparkContext.broadcast(self.weights)

        def run(batches):
            for batch in batches:
                inner = batch.select(["i", "x", "y", "fold"])
                at = 0
                for x, _, learns in blocks(inner):
                    n = len(x)
                    score = (x @ shared.value).reshape(n, len(folds), classes)
                    fold = np.maximum(inner.column(3).slice(at, n).to_numpy(zero_copy_only=False), 0)
                    own = score[np.arange(n), fold]
                    ids = batch.column(0).slice(at, n).take(pa.array(np.repeat(np.arange(n), classes)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fold, classes).astype(np.int32)), ids, pa.array(labels * n), pa.array(own.ravel())], ["fold", "instance_id", "label", "score"])
                    at += n

        kind = dict(self.rows.dtypes)["instance_id"]
        tested = self.rows if folds == [None] else self.rows.where("fold >= 0")
        found = tested.mapInArrow(run, f"fold int, instance_id {kind}, label string, score double")
        if folds == [None]:
            return found
        return found.withColumn("fold", F.get(F.lit(folds), F.col("fold")))

    def feature_weights(self) -> DataFrame:
        """(feature, weight): largest absolute coefficient over all machines; of two classes, both machines are one."""
        best = np.abs(self.weights[:-1]).max(axis=1)
        table = self.rows.sparkSession.createDataFrame(list(enumerate(map(float, best))), "idx long, weight double")
        return self.space.join(table, "idx").select("feature", "weight")
