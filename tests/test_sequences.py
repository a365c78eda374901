"""Levels of graphs, and Markov features and decisions, against plain loops."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import sequences as sq


def longest(edges):
    parents = defaultdict(set)
    nodes = {x for e in edges for x in e}
    for a, b in edges:
        parents[b].add(a)
    level, left = {}, set(nodes)
    while left:
        free = [n for n in left if parents[n] <= level.keys()]
        if not free:
            raise ValueError
        for n in free:
            level[n] = max((level[p] + 1 for p in parents[n]), default=0)
        left -= set(free)
    return level


def levels(spark, edges):
    return {r.instance_id: r.level for r in sq.topological_levels(spark.createDataFrame(edges, "parent long, child long")).collect()}


def test_levels_of_random_graphs(spark):
    rng = random.Random(5)
    for n, m in ((12, 14), (40, 50)):
        order = rng.sample(range(1000), n)
        edges = [tuple(order[i] for i in sorted(rng.sample(range(n), 2))) for _ in range(m)] + [(order[i], order[i + 1]) for i in range(0, n // 2)]
        edges += edges[:3]
        assert levels(spark, edges) == longest(edges)


def test_long_thread_takes_few_rounds(spark, monkeypatch):
    rounds, plain = [], sq.stored
    monkeypatch.setattr(sq, "stored", lambda df, *a: rounds.append(1) or plain(df, *a))
    ids = random.Random(6).sample(range(100_000), 10_000)
    edges = list(zip(ids, ids[1:])) + [(ids[17], ids[4000]), (-1, ids[9000]), (ids[9999], -2), (ids[9999], -3)]
    got = levels(spark, edges)
    want = {x: i for i, x in enumerate(ids)} | {-1: 0, -2: 10_000, -3: 10_000}
    assert got == want and len(rounds) < 40


def test_cycles(spark):
    for edges in ([(1, 2), (2, 3), (3, 1)], [(0, 1), (1, 2), (2, 3), (3, 1), (3, 4)], [(5, 5)], [(1, 2), (2, 1), (1, 3), (2, 3), (3, 4)]):
        with pytest.raises(ValueError, match="cycle"):
            levels(spark, edges)
    assert sq.topological_levels(spark.createDataFrame([], "parent long, child long")).count() == 0


def graph(rng, n):
    return sorted({(i, j) for j in range(1, n) for i in rng.sample(range(max(0, j - 4), j), rng.choice([0, 1, 1, 2]) if j > 1 else 1)})


def plain_features(i, parents, features, labels, order):
    out = Counter({f"own:{f}": v for f, v in features[i].items()})
    for p in parents[i]:
        for f, v in features[p].items():
            out[f"above:{f}"] += v
    at = {i}
    for k in range(1, order + 1):
        at = {p for x in at for p in parents[x]}
        for p in at:
            if p in labels:
                out[f"prev{k}:{labels[p]}"] += 1
        if not at:
            out[f"prev{k}:START"] += 1
    return out


WEIGHTS = {"own:a": {"x": 1.0}, "own:b": {"y": 1.0}, "above:a": {"y": 0.4}, "prev1:x": {"y": 1.3}, "prev1:y": {"x": 0.9}, "prev2:x": {"x": 0.6}, "prev2:START": {"y": 0.5}}


def decide(counts):
    score = {c: sum(v * WEIGHTS.get(f, {}).get(c, 0.0) for f, v in counts.items()) for c in "xy"}
    return min("xy", key=lambda c: (-round(score[c], 6), c))


def test_markov_on_a_graph(spark):
    rng = random.Random(7)
    edges = graph(rng, 40)
    parents = defaultdict(set)
    for a, b in edges:
        parents[b].add(a)
    features = {i: Counter(rng.choice("abc") for _ in range(3)) for i in range(42)}  # two stand alone
    gold = {i: rng.choice("xy") for i in range(42) if i % 9}
    table = spark.createDataFrame([(i, f, v) for i, c in features.items() for f, v in c.items()], "instance_id long, feature string, value long")
    frame = spark.createDataFrame(edges, "parent long, child long")
    ids = spark.range(42).withColumnRenamed("id", "instance_id")
    labels = spark.createDataFrame(list(gold.items()), "instance_id long, label string")
    got = defaultdict(Counter)
    for r in sq.graph_markov_features(table, frame, labels, ids, 3).collect():
        assert r.feature not in got[r.instance_id]
        got[r.instance_id][r.feature] = r.value
    assert got == {i: plain_features(i, parents, features, gold, 3) for i in range(42)}

    weights = spark.createDataFrame([(f, c, w) for f, own in WEIGHTS.items() for c, w in own.items()], "feature string, label string, w double")

    def classify(rows):
        every = rows.select("instance_id").distinct().select("instance_id", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("label"))
        sums = rows.join(F.broadcast(weights), "feature").groupBy("instance_id", "label").agg(F.sum(F.col("value") * F.col("w")).alias("s"))
        both = every.join(sums, ["instance_id", "label"], "left")
        return both.groupBy("instance_id").agg(F.min(F.struct(-F.round(F.coalesce("s", F.lit(0.0)), 6), "label")).alias("b")).select("instance_id", "b.label")

    want = {}
    for i in range(42):  # parents have smaller numbers
        want[i] = decide(plain_features(i, parents, features, want, 2))
    found = {r.instance_id: r.label for r in sq.markov_classify(table, frame, ids, classify, 2).collect()}
    assert found == want and len(set(want.values())) == 2


def test_decisions_along_a_long_thread(spark):
    rng = random.Random(8)
    labels, steps = ["a", "b", "c"], {("START", "c"): 0.7, ("a", "b"): 0.5, ("b", "b"): -0.4, ("c", "a"): 0.6, ("b", "c"): 0.2}
    rows = [(t, p, f"{t}-{p}", c, rng.choice([0.0, 0.25, 0.5, 1.0])) for t, n in ((1, 3000), (2, 1), (3, 40)) for p in range(n) for c in labels if rng.random() < 0.95 or c == "a"]
    scores = {(t, p, c): s for t, p, _, c, s in rows}
    want = {}
    for t, n in ((1, 3000), (2, 1), (3, 40)):
        before = "START"
        for p in range(n):
            before = min(labels, key=lambda c: (-(scores.get((t, p, c), -1e300) + steps.get((before, c), 0.0)), c))
            want[f"{t}-{p}"] = before
    frame = spark.createDataFrame(rows, "thread_id int, pos int, instance_id string, label string, score double").repartition(5)
    assert {r.instance_id: r.label for r in sq.markov_decode(frame, steps, labels).collect()} == want
