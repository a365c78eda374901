"""Batched linear machines against dense solutions, and topics of a planted corpus."""

import random

import numpy as np
import pytest

from corpusmill.operators import linear, topics


def table(n=160, d=6, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2) * (rng.random((n, d)) < 0.7)
    label = np.argmax(x[:, :3] + rng.normal(size=(n, 3)) * 0.4, axis=1)
    x[5] = 0  # an instance without features
    return x, label


def dense(x, y, kind, l2):
    """Newton's method on one machine."""
    x = np.hstack([x, np.ones((len(x), 1))])
    reg = np.full(x.shape[1], l2)
    reg[-1] = 0
    w = np.zeros(x.shape[1])

    def value(w):
        m = y * (x @ w)
        return (np.maximum(0, 1 - m) ** 2 if kind == "svm" else np.logaddexp(0, -m)).mean() + (reg * w * w).sum() / 2

    for _ in range(100):
        m = y * (x @ w)
        if kind == "svm":
            g, h = -2 * np.maximum(0, 1 - m) * y, 2.0 * (m < 1)
        else:
            p = 1 / (1 + np.exp(m))
            g, h = -p * y, p * (1 - p)
        step = np.linalg.solve((x.T * h) @ x / len(x) + np.diag(reg) + 1e-10 * np.eye(len(w)), x.T @ g / len(x) + reg * w)
        t = 1.0
        while value(w - t * step) > value(w) and t > 1e-8:
            t /= 2
        w = w - t * step
    return w


@pytest.mark.parametrize("kind", ["svm", "logistic"])
def test_all_folds_and_classes_at_once(spark, kind):
    x, label = table()
    n, d = x.shape
    fold = np.arange(n) % 3
    features = spark.createDataFrame([(i, f"f{j}", float(x[i, j])) for i in range(n) for j in range(d) if x[i, j]], "instance_id long, feature string, value double")
    space = spark.createDataFrame([(f"f{j}", j) for j in range(d)], "feature string, idx long")
    classes = spark.createDataFrame([(i, "abc"[c]) for i, c in enumerate(label)], "instance_id long, label string").repartition(3)
    folds = spark.createDataFrame([(i, int(f)) for i, f in enumerate(fold)], "instance_id long, test_fold int")
    fitted = linear.Batched(features, space, classes, folds, kind).fit()
    want = np.array([dense(x[fold != f], np.where(label[fold != f] == c, 1.0, -1.0), kind, 0.01) for f in range(3) for c in range(3)]).T
    assert np.abs(fitted.weights - want).max() < 1e-4
    scores = {(r.fold, r.instance_id, r.label): r.score for r in fitted.scores().collect()}
    assert len(scores) == 3 * n
    for (f, i, c), s in scores.items():
        assert f == fold[i] and abs(s - (np.append(x[i], 1) @ want[:, 3 * f + "abc".index(c)])) < 1e-2
    whole = linear.Batched(features, space, classes, None, kind).fit()
    one = np.array([dense(x, np.where(label == c, 1.0, -1.0), kind, 0.01) for c in range(3)]).T
    assert np.abs(whole.weights - one).max() < 1e-4
    assert {r.feature: round(r.weight, 3) for r in whole.feature_weights().collect()} == {f"f{j}": round(float(np.abs(one[j]).max()), 3) for j in range(d)}


def test_planted_topics(spark):
    rng = random.Random(4)
    own = [[f"t{k}w{i}" for i in range(12)] for k in range(4)]
    docs, rows = {}, []
    for i in range(160):
        docs[i] = i % 4
        cells = {}
        for _ in range(50):
            w = rng.choice(own[i % 4] if rng.random() < 0.9 else own[rng.randrange(4)])
            cells[w] = cells.get(w, 0) + 1
        rows += [(i, w, n) for w, n in cells.items()]
    frame = spark.createDataFrame(rows, "instance_id long, feature string, value long")
    run = lambda parts: {(r.instance_id, r.feature): r.value for r in topics.gibbs_topics(frame.repartition(parts), 4, 25, 0.5).collect()}
    got = run(3)
    assert len(got) == 4 * 160
    best = {}
    for i in docs:
        shares = {t: got[i, f"topic{t}"] for t in range(4)}
        assert abs(sum(shares.values()) - 1) < 1e-9
        best[i] = max(shares, key=shares.get)
    # each planted topic is found as one, and differs from the others
    names = {p: max(set(v := [best[i] for i in docs if docs[i] == p]), key=v.count) for p in range(4)}
    assert len(set(names.values())) == 4 and sum(best[i] == names[docs[i]] for i in docs) >= 152
    assert run(2) == got
    with pytest.raises(ValueError, match="cells"):
        topics.gibbs_topics(frame, topics.MOST_CELLS, 1)


def test_documents_abreast_are_swept_as_one_by_one():
    """All documents go through a cell at once; each draws what it would draw alone, word by word and token by token."""
    rng = np.random.default_rng(5)
    k, words, alpha, beta = 3, 9, 0.5, 0.1
    cells = [np.sort(rng.choice(words, size, replace=False)) for size in (4, 1, 9, 2, 9, 1)]
    counts = [rng.integers(1, 40, len(c)) for c in cells]
    begin, base = np.cumsum([0, *map(len, cells)]), rng.integers(0, 1 << 63, len(cells)).astype(np.uint64)
    w, n = np.concatenate(cells), np.concatenate(counts)
    spread = topics._swept(w, n, begin, np.zeros((len(w), k), np.int64), base, None, alpha, beta)
    assert (spread.sum(axis=1) == n).all()
    table = np.zeros((words, k))
    np.add.at(table, w, spread)
    got = topics._swept(w, n, begin, spread.copy(), base, (table, table.sum(axis=0)), alpha, beta)
    for i, (a, b) in enumerate(zip(begin, begin[1:])):
        own, done, now = spread[a:b].sum(axis=0), 0, spread[a:b].copy()
        rest = table.sum(axis=0) - own + words * beta
        for c in range(b - a):
            own = own - now[c]
            p = np.cumsum((own + alpha) * (table[w[a + c]] - now[c] + beta) / (rest + own))
            now[c] = 0
            for _ in range(n[a + c]):
                now[c, np.searchsorted(p, topics._uniform(base[i : i + 1], np.array([done]))[0] * p[-1], side="right")] += 1
                done += 1
            own = own + now[c]
        assert (now == got[a:b]).all()
    # shares of draws follow the weights
    drawn = topics._drawn(np.array([[1.0, 2.0, 5.0]]), np.array([200_000]), base[:1], np.zeros(1, np.int64))
    assert np.abs(drawn / 200_000 - [[0.125, 0.25, 0.625]]).max() < 0.005
