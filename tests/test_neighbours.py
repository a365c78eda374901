"""Exact nearest neighbours against all pairs, and how few pairs they join."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import neighbours as nb
from corpusmill.operators import prototypes as pr

FURTHEST = {"cosine": 1.0, "skew": 4.605170185988092}


def corpus(spark, n, seed=1, common=1, rare=3000, words=5):
    rng = random.Random(seed)
    cells = {(i, f"common{c}"): rng.randrange(1, 3) for i in range(n) for c in range(common)}
    for i in range(n):
        for _ in range(words):
            key = i, f"w{int(rare * rng.random() ** 2)}"
            cells[key] = cells.get(key, 0) + 1
    return spark.createDataFrame([(i, f, v) for (i, f), v in cells.items()], "instance_id long, feature string, value long").repartition(3).cache()


def best_of(rows, keys=("instance_id",)):
    found = {}
    for r in rows:
        key = tuple(r[k] for k in keys)
        found[key] = min(found.get(key, (9, 0)), (round(r["dist"], 9), r["train_id"]))
    return found


@pytest.mark.parametrize("kind", ["cosine", "skew"])
def test_same_as_all_pairs_with_few_joined(spark, kind):
    n = 2000
    table = corpus(spark, n)
    train, queries = table.withColumnRenamed("instance_id", "train_id"), table.where("instance_id % 100 = 0")
    search = nb.Search(train, queries, kind)
    want = best_of(getattr(pr, kind)(train, queries).collect())
    assert best_of(search.nearest().collect()) == want
    first = search.verified(search.seeds()).groupBy("group", "instance_id").agg(F.min("dist").alias("dist"))
    joined = search.seeds().count() + search.candidates(first).count()
    # the common word pairs every query with every instance
    assert getattr(pr, kind)(train, queries).count() == 20 * (n - 1) and joined < 20 * n / 20


@pytest.mark.parametrize("kind", ["cosine", "skew"])
def test_dense_texts_and_groups(spark, kind):
    table = corpus(spark, 150, seed=2, common=4, rare=40, words=30)
    train = table.withColumnRenamed("instance_id", "train_id")
    # some queries aren't in the training part and have features that it lacks; groups overlap
    other = corpus(spark, 12, seed=3, common=5, rare=60, words=10).withColumn("instance_id", F.col("instance_id") + 1000)
    queries = table.where("instance_id % 10 = 0").union(other)
    groups = spark.range(150).selectExpr("id AS train_id", "explode(if(id % 7 = 0, array('a', 'b'), array(if(id % 2 = 0, 'a', 'c')))) AS group")
    pairs = getattr(pr, kind)(train, queries)
    want = best_of(pairs.join(groups, "train_id").collect(), ("group", "instance_id"))
    assert best_of(nb.Search(train, queries, kind, groups).nearest().collect(), ("group", "instance_id")) == want
    assert best_of(nb.Search(train, queries, kind).nearest().collect()) == best_of(pairs.collect())


def test_no_shared_feature_and_empty_tables(spark):
    schema = "instance_id long, feature string, value long"
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 1), (4, "c", 5)], schema)
    got = nb.Search(table.withColumnRenamed("instance_id", "train_id"), table, "cosine").nearest().collect()
    assert sorted((r.instance_id, r.train_id, r.dist) for r in got) == [(3, 4, 0.0), (4, 3, 0.0)]
    none = table.limit(0)
    assert nb.Search(none.withColumnRenamed("instance_id", "train_id"), table, "skew").nearest().count() == 0
    assert nb.Search(table.withColumnRenamed("instance_id", "train_id"), none, "skew").nearest().count() == 0
