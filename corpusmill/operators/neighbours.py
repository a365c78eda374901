"""Exact nearest neighbours with upper bounds: most pairs are never joined.

Both distances here are a constant less a sum over shared features of k(x, y), x and y the weights of
a feature in the training and the query vector:

- cosine: k = x * y, over vectors of unit length;
- skew: k = x * ln(1 + c * y / x), over shares, with c = alpha / (1 - alpha).

k is concave and homogeneous in the masses (squares or shares), so what a set of features can add is at most the
bound of the masses that both vectors have on it.  Features are ordered from the rarest to the most
frequent.  If the rarest feature that two vectors share is f, their score is at most k at f and the
bound of the masses after f.

1. Seeds: a query's rarest features, as far as few postings hold them, give pairs whose scores are
   computed; the best is what others must beat.
2. A posting knows its mass from its feature on, in LEVELS steps.  A query's cell asks only for the
   levels whose bound can beat the best so far, so most postings of a frequent feature are never
   joined: what makes a feature frequent also makes it last, with little mass after it.
3. The pairs that are left are verified with whole vectors, many pairs at once in Arrow batches.

Queries may search each group of the training part apart (the nearest of each class).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from .ranking import row_numbers

LEVELS = 32
#: postings that the seeds of a query may have, but for the rarest shared feature
SEEDS = 256
#: pairs whose features are merged at once
PAIRS_AT_ONCE = 512
#: bounds are sums of doubles; distances are compared to 9 places
SLACK = 1e-8
ALPHA = 0.99


class Search:
    """Postings and vectors of a training part and a set of queries, for one distance.

    `train` is (train_id, feature, value), `queries` (instance_id, feature, value), values positive.
    `groups` (train_id, group), if given, parts the training part; an instance may be in several.
    """

    def __init__(self, train: DataFrame, queries: DataFrame, kind: str, groups: DataFrame | None = None):
        if kind not in ("cosine", "skew"):
            raise ValueError(kind)
        self.kind, self.furthest = kind, 1.0 if kind == "cosine" else None
        if groups is None:
            t, g = train.withColumn("group", F.lit("")), train.sparkSession.createDataFrame([("",)], "group string")
        else:
            t, g = train.join(groups, "train_id"), groups.select("group").distinct()
        count = t.groupBy("group", "feature").agg(F.count("*").alias("df"))
        ranks = row_numbers(count, [F.col("df"), F.col("feature")], ["group"], "r").select("group", "feature", "df", F.col("r").cast("int").alias("r"))
        # the groups are a small closed space
        q = queries.crossJoin(F.broadcast(g))
        self.postings = stored(self._cells(t, ranks, "train_id"))
        self.cells = stored(self._cells(q, ranks, "instance_id"))
        self.vectors = stored(self._vectors(self.postings, "train_id", "tv"))
        self.asked = stored(self._vectors(self.cells, "instance_id", "qv"))

    def _cells(self, table: DataFrame, ranks: DataFrame, key: str) -> DataFrame:
        """(group, key, r, df, value, size, w, m, after): weight, mass, and the mass of more frequent features."""
        v = F.col("value").cast("double")
        own = Window.partitionBy("group", key)
        size = F.sqrt(F.sum(v * v).over(own)) if self.kind == "cosine" else F.sum(v).over(own)
        # features that the training part lacks count in the vector's size, but can't be shared
        rows = table.join(ranks, ["group", "feature"], "left").select("group", key, "r", "df", v.alias("value"), size.alias("size"))
        rows = rows.where("r IS NOT NULL").withColumn("w", F.col("value") / F.col("size")).withColumn("m", F.col("w") * F.col("w") if self.kind == "cosine" else F.col("w"))
        later = own.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("after", F.coalesce(F.sum("m").over(later), F.lit(0.0)))

    @staticmethod
    def _vectors(cells: DataFrame, key: str, name: str) -> DataFrame:
        """(group, key, <name>: features in order with their values, <name>_size)."""
        # one instance's own features
        entries = F.array_sort(F.collect_list(F.struct("r", "value")))
        return cells.groupBy("group", key).agg(entries.alias("e"), F.first("size").alias(f"{name}_size")).select("group", key, F.col("e.r").alias(f"{name}_r"), F.col("e.value").alias(name), f"{name}_size")

    def k(self, x: Column, y: Column) -> Column:
        return x * y if self.kind == "cosine" else x * F.log1p(ALPHA / (1 - ALPHA) * y / x)

    def bound(self, a: Column, b: Column) -> Column:
        """The most that features can add on which the vectors have the masses a and b."""
        return F.sqrt(a * b) if self.kind == "cosine" else F.when(a > 0, self.k(a, b)).otherwise(0.0)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(group, instance_id, train_id, dist) of pairs, from whole vectors: the features of many pairs are merged at once."""
        both = pairs.join(self.vectors, ["group", "train_id"]).join(self.asked, ["group", "instance_id"])
        cosine, kinds = self.kind == "cosine", dict(pairs.dtypes)

        def entries(ranks, values):
            """(pair, feature, value) of all entries, in order of pair and feature."""
            ends = ranks.offsets.to_numpy()
            inside = slice(ends[0], ends[-1])
            pair = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            return pair, ranks.values.to_numpy()[inside].astype(np.int64), values.values.to_numpy()[inside]

        def run(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, PAIRS_AT_ONCE):
                    batch = whole.slice(at, PAIRS_AT_ONCE)
                    pair, r, x = entries(batch.column(3), batch.column(4))
                    other, s, y = entries(batch.column(6), batch.column(7))
                    size_t, size_q = batch.column(5).to_numpy(), batch.column(8).to_numpy()
                    width = max(int(r.max(initial=0)), int(s.max(initial=0))) + 1
                    mine, theirs = pair * width + r, other * width + s
                    place = np.minimum(np.searchsorted(mine, theirs), max(len(mine) - 1, 0))
                    same = mine[place] == theirs if len(mine) else np.zeros(len(theirs), bool)
                    x, y, of = x[place[same]], y[same], other[same]
                    if cosine:
                        dist = np.maximum(0.0, 1 - np.bincount(of, x * y, batch.num_rows) / (size_t * size_q))
                    else:
                        p, q = x / size_t[of], y / size_q[of]
                        shared = np.bincount(of, p * np.log(p / (ALPHA * q + (1 - ALPHA) * p)), batch.num_rows)
                        dist = shared + (1 - np.bincount(of, p, batch.num_rows)) * np.log(1 / (1 - ALPHA))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(dist)], ["group", "instance_id", "train_id", "dist"])

        columns = both.select("group", "instance_id", "train_id", "tv_r", "tv", "tv_size", "qv_r", "qv", "qv_size")
        return columns.mapInArrow(run, f"group {kinds['group']}, instance_id {kinds['instance_id']}, train_id {kinds['train_id']}, dist double")

    def score(self, dist: Column) -> Column:
        return (F.lit(1.0) if self.kind == "cosine" else F.ln(F.lit(1 / (1 - ALPHA)))) - dist

    def seeds(self) -> DataFrame:
        """Pairs that share one of the query's rarest features."""
        rare = Window.partitionBy("group", "instance_id").orderBy("r")
        rows = self.cells.where("df > 1").select("group", "instance_id", "r", F.sum("df").over(rare).alias("so_far"), F.row_number().over(rare).alias("rn"))
        asked = rows.where(f"so_far <= {SEEDS} OR rn = 1").select("group", "instance_id", "r")
        return asked.join(self.postings.select("group", "r", "train_id"), ["group", "r"]).where("train_id <> instance_id").select("group", "instance_id", "train_id").distinct()

    def candidates(self, best: DataFrame) -> DataFrame:
        """Pairs that may be as near as the best seeds (group, instance_id, dist)."""
        goal = best.select("group", "instance_id", (self.score(F.col("dist")) - SLACK).alias("goal"))
        level = F.explode(F.filter(F.sequence(F.lit(1), F.lit(LEVELS)), lambda l: self.bound(l / LEVELS, F.col("m") + F.col("after")) >= F.coalesce("goal", F.lit(0.0))))
        asked = self.cells.join(goal, ["group", "instance_id"], "left").select("group", "instance_id", "r", level.alias("level"), F.col("w").alias("y"), F.col("after").alias("b"), F.coalesce("goal", F.lit(0.0)).alias("goal"))
        step = F.least(F.lit(LEVELS), F.greatest(F.lit(1), F.ceil((F.col("m") + F.col("after")) * LEVELS - 1e-9))).cast("int")
        held = self.postings.select("group", "r", step.alias("level"), "train_id", F.col("w").alias("x"), F.col("after").alias("a"))
        both = asked.join(held, ["group", "r", "level"]).where("train_id <> instance_id")
        enough = self.k(F.col("x"), F.col("y")) + self.bound(F.col("a"), F.col("b")) >= F.col("goal")
        return both.where(enough).select("group", "instance_id", "train_id").distinct()

    def nearest(self) -> DataFrame:
        """(group, instance_id, train_id, dist): the nearest other instance that shares a feature; ties by train_id."""

        def best(rows):
            found = rows.groupBy("group", "instance_id").agg(F.min(F.struct(F.round("dist", 9).alias("dist"), "train_id", F.col("dist").alias("exact"))).alias("b"))
            return found.select("group", "instance_id", F.col("b.train_id").alias("train_id"), F.col("b.exact").alias("dist"))

        first = stored(best(self.verified(self.seeds())))
        return best(self.verified(self.candidates(first)))
