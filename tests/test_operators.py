"""Hand-computed fixtures and properties of the reference's operators."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import scan, special
from corpusmill.functions import stemming as st
from corpusmill.functions import text as tx
from corpusmill.operators import classes as cl
from corpusmill.operators import classify as cf
from corpusmill.operators import evaluate as ev
from corpusmill.operators import features as fm
from corpusmill.operators import learners as ml
from corpusmill.operators import meta as mt
from corpusmill.operators import metadata as md
from corpusmill.streaming import online
from corpusmill.operators import prototypes as pr
from corpusmill.operators import sequences as sq
from corpusmill.operators import splits as sp
from corpusmill.operators import weights as wt
from corpusmill.operators.ranking import row_numbers
from tests.conftest import SMALL


def column(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr.alias("x")).first().x


@pytest.mark.parametrize("text,n,want", [("", 2, []), ("a", 2, []), ("ab", 2, ["6162"]), ("aé", 1, ["61", "C3", "A9"]), (None, 1, [])])
def test_byte_ngrams(spark, text, n, want):
    assert column(spark, text, tx.byte_ngrams(F.col("text"), n)) == want


def test_tokens(spark):
    assert column(spark, "It's  a\tTest. 42!", tx.number_tokens(tx.bow(F.col("text")))) == ["its", "a", "test", "NUMBER"]
    assert column(spark, "aé b", tx.char_ngrams(F.col("text"), 2)) == ["aé", "é ", " b"]
    assert column(spark, "A1b", tx.perword_ngrams(F.col("text"), (2,))) == ["_a", "ab", "b_"]
    found = column(spark, "aaab", tx.keyword_matches(F.col("text"), ["aa", "ab"]))
    assert [(m.start, m.keyword) for m in found] == [(0, "aa"), (1, "aa"), (2, "ab")]
    assert column(spark, "<p>a<b</p>c", tx.strip_tags(F.col("text"))) == "ac"


@pytest.mark.parametrize("word,stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"),
    ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("triplicate", "triplic"),
    ("hopeful", "hope"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"),
])
def test_porter_stem(word, stem):
    assert st.porter_stem(word) == stem


def test_entities_and_spans(spark):
    assert column(spark, "&lt;&#65;&#x42;&nosuch;", st.decode_entities("text")) == "<AB&nosuch;"
    row = st.stem_spans(spark.createDataFrame([("Running cats",)], "text string")).first().spans
    assert [(s.word, s.start, s.end, s.stem) for s in row] == [("Running", 0, 7, "run"), ("cats", 8, 12, "cat")]


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_byte_grams_as_numbers(spark, n):
    texts = [(1, "abcabcab"), (2, None), (3, ""), (4, "é😀x" * 50), (1, "abcabcab"), (5, "a" * 6), (None, "abababab")]
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = fm.byte_gram_counts(rows, n)
    want = fm.feature_counts(rows, tx.byte_ngrams(F.col("text"), n))
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # no row of a single place is made
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_naive_bayes_joins_features_once(spark):
    features = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "b", 3), (3, "q", 7)], "instance_id long, feature string, value long")
    classes = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (9, "w")], "instance_id long, label string")
    model = cf.nb_model(features, classes)
    test = spark.createDataFrame([(5, "a", 1), (5, "b", 2), (5, "new", 9), (6, "new", 1), (7, "q", 4)], "instance_id long, feature string, value long")
    scores = cf.nb_predict(model, test)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 0
    # V counts a, b and q; q has no class, so it isn't known
    n = {"w": {}, "x": {"a": 2, "b": 1}, "y": {"b": 3}, "z": {"b": 3}}
    own = {5: {"a": 1, "b": 2}, 6: {}, 7: {}}
    want = {(i, c): sum(v * math.log(1 + k.get(f, 0)) for f, v in d.items()) - sum(d.values()) * math.log(3 + sum(k.values())) for i, d in own.items() for c, k in n.items()}
    assert {(r.instance_id, r.label): pytest.approx(r.score) for r in scores.collect()} == want
    texts = spark.createDataFrame([(5, "t"), (6, ""), (8, None)], "doc_id long, text string")
    assert {r.instance_id for r in online.classify_texts(model, texts, None, counts=test.where("instance_id < 7")).collect()} == {5, 6, 8}


def test_tasks_join_test_features_once(spark):
    train = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "b", 3), (3, "c", 1)], "instance_id long, feature string, value long")
    classes = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "instance_id long, label string")
    branches = [("n", "x", "left"), ("n", "y", "right"), ("m", "y", "left"), ("m", "z", "right")]
    test = spark.createDataFrame([(7, "a", 2), (7, "b", 1), (7, "c", 5), (8, "new", 1)], "instance_id long, feature string, value long")
    at = spark.createDataFrame([(7, "n"), (7, "m"), (8, "m")], "instance_id long, node string")
    found = cf.nb_nodes(train, classes, spark.createDataFrame(branches, "node string, label string, branch string"), test, at)
    # no row of a test feature is multiplied by nodes or branches
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    counts = {("n", "left"): {"a": 2, "b": 1}, ("n", "right"): {"b": 3}, ("m", "left"): {"b": 3}, ("m", "right"): {"c": 1}}
    known = {"n": {"a": 2, "b": 1}, "m": {"b": 1, "c": 5}}
    want = {}
    for i, n in ((7, "n"), (7, "m"), (8, "m")):
        own = known[n] if i == 7 else {}
        for b in ("left", "right"):
            c = counts[n, b]
            want[i, n, b] = pytest.approx(sum(v * math.log(1 + c.get(f, 0)) for f, v in own.items()) - sum(own.values()) * math.log(3 + sum(c.values())))
    assert {(r.instance_id, r.node, r.branch): r.score for r in found.collect()} == want


def test_learners_share_folds_and_counts(spark):
    rng = random.Random(6)
    features = spark.createDataFrame([(i, f"w{w}", rng.randrange(1, 4)) for i in range(30) for w in rng.sample(range(12), 4)], "instance_id long, feature string, value long")
    classes = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(28)], "instance_id long, label string")
    folds = spark.createDataFrame([(i, i % 4) for i in range(30)], "instance_id long, test_fold int")
    shared = cf.in_folds(features, folds).cache()
    both = cf.nb_counts_of_both(shared, classes).cache()
    for boolean, name in ((False, "n"), (True, "b")):
        scores = lambda f, counts: {(r.fold, r.instance_id, r.label): pytest.approx(r.score) for r in cf.naive_bayes_cv(f, classes, folds, boolean, counts=counts).collect()}
        got = scores(shared, both.select("test_fold", "label", "feature", F.col(name).alias("n")))
        assert len(got) == 90 and got == {k: v.expected for k, v in scores(features, None).items()}


def test_grams_of_words_as_arrays(spark, monkeypatch):
    """Words are cut as arrays of bytes; before, they were cut one by one by Spark's lambdas."""
    monkeypatch.setattr(st, "SLICE", 50)
    texts = [None, "", " \t ", "A1b 12 it's  ÉCOLE", "x\u00a0y 😀 𝒳𝒴z_", "ΑΣ_Β ΣΑΣ2 İ 1Σ", "a-" * 400, *["Straße und so"] * 30, "12", "end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    words = rows.select("doc_id", tx.perword_words("text").alias("w"), "text")
    each = F.transform(tx.whitespace_tokens("text"), lambda w: F.concat(F.lit("_"), F.lower(F.regexp_replace(w, r"[^\p{L}]", "")), F.lit("_")))
    assert words.select("w").collect() == rows.select(each.alias("w")).collect()
    got = st.with_word_grams(words, "w", (2, 3))
    want = [[w[i : i + n] for w in r.w for n in (2, 3) for i in range(len(w) - n + 1)] for r in words.collect()]
    assert [(r.doc_id, r.w, r.text) for r in got.collect()] == [(i, w, t) for i, (w, t) in enumerate(zip(want, texts))]
    assert [r.w for r in rows.select(tx.perword_ngrams(F.col("text")).alias("w")).collect()] == want
    assert st.with_word_grams(words.limit(0), "w").count() == 0


def test_spans_of_a_batch_are_held_in_slices(monkeypatch):
    rng = random.Random(4)
    texts = [None, "", "  ", "Éa_1 x" * 3000] + [" ".join(rng.choices(["Running", "cats", "ponies", "Straße", "a-b"], k=rng.randrange(900))) for _ in range(300)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(st, "SLICE", 10_000)
    tracemalloc.start()
    rows, most = [], 0
    for batch in st.span_batches(iter([whole, whole.slice(0, 0)]), 1):
        assert batch.num_rows == 1 or sum(len(t or "") for t in batch.column(1).to_pylist()) < 2 * 10_000
        most = max(most, tracemalloc.get_traced_memory()[1])
        rows.extend((r["doc_id"], len(r["spans"]), [tuple(x.values()) for x in r["spans"][:50]]) for r in batch.to_pylist())
        tracemalloc.reset_peak()
    tracemalloc.stop()
    want = [[(m[0], m.start(), m.end(), st.porter_stem(m[0].lower())) for m in re.finditer(r"\w+", t or "")] for t in texts]
    assert rows == [(i, len(w), w[:50]) for i, w in enumerate(want)]
    assert most < 30 << 20



def test_multisets(spark):
    bag = lambda s: spark.createDataFrame(list(Counter(s).items()), "key string, n long")
    got = {how: {r.key: r.n for r in fm.multiset(bag(a), bag(b), how).collect()} for how, a, b in (("add", "abbb", "bcc"), ("subtract", "abbbc", "bccd"), ("union", "abbb", "bcc"), ("intersect", "abbb", "bcc"))}
    assert got == {"add": {"a": 1, "b": 4, "c": 2}, "subtract": {"a": 1, "b": 2}, "union": {"a": 1, "b": 3, "c": 2}, "intersect": {"b": 1}}
    assert [(r.key, r.n) for r in fm.most_common(bag("abracadabra"), 3).collect()] == [("a", 5), ("b", 2), ("r", 2)]


@pytest.mark.parametrize("sizes", [[1, 3, 10, 11]])
def test_partition_is_exact(spark, sizes):
    rows = [(f"{s}-{i}", f"s{s}") for s in sizes for i in range(s)]
    strata = spark.createDataFrame(rows, "instance_id string, stratum string")
    got = sp.allocate(strata, [1.0] * 10, "x").collect()
    assert sorted(r.instance_id for r in got) == sorted(r[0] for r in rows)
    for s in sizes:
        parts = Counter(r.part for r in got if r.stratum == f"s{s}")
        assert max(parts.values()) - min([parts.get(i, 0) for i in range(10)]) <= 1
    again = sp.allocate(strata.repartition(7), [1.0] * 10, "x").collect()
    assert {r.instance_id: r.part for r in again} == {r.instance_id: r.part for r in got}


def test_split_shapes():
    assert sp.validate_split(["train", "test", "unused"]) == "traintest"
    assert sp.validate_split(["fold0", "fold1"]) == "crossvalidation"
    assert sp.validate_split(["learncurveT", "learncurve0"]) == "learningcurve"
    with pytest.raises(ValueError):
        sp.validate_split(["train", "fold0"])


def test_information_gain(spark):
    features = spark.createDataFrame([(0, "perfect", 1), (1, "perfect", 2)] + [(i, "constant", 1) for i in range(4)], "instance_id int, feature string, value int")
    classes = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y"), (3, "y")], "instance_id int, label string")
    got = {r.feature: r.weight for r in wt.info_gain(features, classes, classes.select("instance_id")).collect()}
    assert math.isclose(got["perfect"], math.log(2)) and abs(got["constant"]) < 1e-12


def test_lang_domain_against_brute_force(spark):
    docs = [(i, "xy"[i % 2], "dA dB dC".split()[i % 3], i % 4) for i in range(48)]
    has = {(i, f): (i * 7 + len(f) * 3 + ord(f[-1]) * i) % 5 < 2 for i, *_ in docs for f in ("fa", "fb", "fc", "fdd")}
    features = spark.createDataFrame([(i, f, 1) for (i, f), v in has.items() if v], "instance_id int, feature string, value int")
    frame = lambda k: spark.createDataFrame([(d[0], d[k]) for d in docs], "instance_id int, label string")
    folds = spark.createDataFrame([(d[0], d[3]) for d in docs], "instance_id int, test_fold int")

    def entropy(labels):
        return -sum(n / len(labels) * math.log(n / len(labels)) for n in Counter(labels).values()) if labels else 0.0

    def gain(ids, feature, label):
        one, zero = [label[i] for i in ids if has[i, feature]], [label[i] for i in ids if not has[i, feature]]
        return entropy(one + zero) - (len(one) * entropy(one) + len(zero) * entropy(zero)) / len(ids)

    want = {}
    for fold in range(4):
        ids = [d[0] for d in docs if d[3] != fold]
        lang, domain = {d[0]: d[1] for d in docs}, {d[0]: d[2] for d in docs}
        best = {}
        for c in "xy":
            values = []
            for f in ("fa", "fb", "fc", "fdd"):
                if any(has[i, f] and lang[i] == c for i in ids):
                    values.append((-round(gain(ids, f, {i: lang[i] == c for i in ids}) - gain(ids, f, domain), 9), f))
            for r, (_, f) in enumerate(sorted(values)):
                best[f] = min(best.get(f, 99), r)
        want |= {(fold, f): float(r) for f, r in best.items()}
    got = {(r.fold, r.feature): r.weight for r in wt.lang_domain(features, frame(1), frame(2), folds).collect()}
    assert got == want


def test_distances(spark):
    table = lambda rows: spark.createDataFrame(rows, "instance_id string, feature string, value double")
    train = table([("a", "x", 1.0), ("a", "y", 1.0), ("b", "z", 2.0)]).withColumnRenamed("instance_id", "train_id")
    got = {(r.train_id, r.instance_id): r.dist for r in pr.cosine(train, table([("t", "x", 3.0), ("t", "y", 3.0)])).collect()}
    assert set(got) == {("a", "t")} and abs(got["a", "t"]) < 1e-12
    same = {r.instance_id: r.dist for r in pr.skew(train, table([("t", "z", 5.0)])).collect()}
    assert abs(same["t"]) < 1e-12


def test_kl_prototype_against_dense_computation(spark):
    counts = {0: "aaabbc", 1: "aabbbd", 2: "ccddde", 3: "cddeee", 4: "abcd", 5: "eeeda"}
    labels = {0: "p", 1: "p", 2: "q", 3: "q"}
    rows = [(i, f, n) for i, s in counts.items() for f, n in Counter(s).items()]
    frame = lambda ids: spark.createDataFrame([r for r in rows if r[0] in ids], "instance_id int, feature string, value long")
    cm = spark.createDataFrame(list(labels.items()), "instance_id int, label string")
    got = {(r.instance_id, r.label): r.dist for r in cf.kl_prototype(frame({0, 1, 2, 3}), cm, frame({4, 5})).collect()}
    total = Counter("".join(counts[i] for i in labels))
    theta = {f: n / sum(total.values()) for f, n in total.items()}

    def smooth(c):
        n, once = sum(c.values()), sum(v == 1 for v in c.values())
        u = sum(t for f, t in theta.items() if f not in c)
        a = min(max(once, 1) / n, 0.5) if u > 1e-12 else 0.0
        return {f: (1 - a) * c[f] / n if f in c else theta[f] * a / u for f in theta}

    for i in (4, 5):
        q = smooth(Counter(counts[i]))
        for label in "pq":
            p = smooth(Counter("".join(counts[j] for j in labels if labels[j] == label)))
            assert math.isclose(got[i, label], sum(p[f] * math.log(p[f] / q[f]) for f in theta if p[f] > 0), abs_tol=1e-9)


def test_naive_bayes_unknown_features_leave_the_prior(spark):
    features = spark.createDataFrame([(0, "a", 2), (1, "b", 1), (2, "b", 1)], "instance_id int, feature string, value int")
    classes = spark.createDataFrame([(0, "x"), (1, "y"), (2, "y")], "instance_id int, label string")
    scores = cf.nb_predict(cf.nb_model(features, classes), spark.createDataFrame([(9, "zzz", 4)], "instance_id int, feature string, value int"))
    got = {r.label: r.score for r in scores.collect()}
    assert math.isclose(got["x"], 0.0, abs_tol=1e-12) and math.isclose(got["y"], math.log(2))


def test_confusion_and_undefined_metrics(spark):
    g = spark.createDataFrame([(0, 1, "a"), (0, 2, "a"), (0, 3, "b")], "fold int, instance_id int, label string")
    p = spark.createDataFrame([(0, 1, "a"), (0, 2, "c"), (0, 3, "b")], "fold int, instance_id int, label string")
    space = spark.createDataFrame([(x,) for x in "abcd"], "label string")
    cells = ev.confusion(g, p, g.select("fold", "instance_id"), space)
    rows = {r.label: (r.tp, r.fp, r.fn, r.tn) for r in cells.collect()}
    assert rows == {"a": (1, 0, 1, 1), "b": (1, 0, 0, 2), "c": (0, 1, 0, 2), "d": (0, 0, 0, 3)}
    macro = ev.macro(cells).first()
    assert macro.n_ignored == 2 and math.isclose(macro.recall, 0.75)


def test_tails(spark):
    values = [0.0, 1e-9, 0.1, 0.5, 1.0, 1.9, 1.9999, 2.0, 2.0001, 3.0, 6.0, 12.0, 26.0]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", special.erfc(F.col("x")).alias("y")).collect()
    assert all(math.isclose(r.y, math.erfc(r.x), rel_tol=1e-12) for r in got)
    cases = [(n, k) for n in (1, 2, 7, 40, 900) for k in {n // 2 + 1, (2 * n) // 3 + 1, n} if n / 2 < k <= n]
    got = spark.createDataFrame(cases, "n int, k int").select("n", "k", special.fair_coin_tail(F.col("n"), F.col("k")).alias("p")).collect()
    assert all(math.isclose(r.p, float(sum(math.comb(r.n, i) for i in range(r.k, r.n + 1)) / 2**r.n), rel_tol=1e-9) for r in got)


def test_mcnemar_and_randomisation(spark):
    counts = spark.createDataFrame([(0, 0), (5, 0), (40, 61)], "n01 long, n10 long")
    got = {(r.n01, r.n10): (r.statistic, r.p) for r in ev.mcnemar(counts).collect()}
    assert got[0, 0] == (None, 0.0) and math.isclose(got[5, 0][0], 3.2) and math.isclose(got[5, 0][1], math.erfc(math.sqrt(1.6)))
    unequal = counts.where("n01 <> n10")
    trials, exact = ev.randomisation(unequal).collect(), ev.exact_randomisation(unequal).collect()
    assert math.isclose(exact[0].p, 1 / 32)
    for a, b in zip(trials, exact):
        assert abs(a.p - b.p) < 4 * math.sqrt(b.p / 10_000) + 1e-4
    for test in (ev.randomisation, ev.exact_randomisation):
        with pytest.raises(Exception, match="equally good"):
            test(counts).collect()


def test_mcnemar_by_class(spark):
    schema = "fold int, instance_id int, label string"
    gold = {1: "ab", 2: "a", 3: "c", 4: "", 5: "b"}
    one = {1: "a", 2: "a", 3: "b", 4: "c", 5: "b"}
    two = {1: "ab", 2: "c", 3: "c", 4: "", 5: ""}
    frames = [spark.createDataFrame([(0, i, c) for i, cs in x.items() for c in cs], schema) for x in (gold, one, two)]
    got = ev.class_discordant(*frames, spark.createDataFrame([(c,) for c in "abcd"], "label string")).collect()
    right = lambda x, i, c: (c in x[i]) == (c in gold[i])
    want = {c: (sum(right(two, i, c) and not right(one, i, c) for i in gold), sum(right(one, i, c) and not right(two, i, c) for i in gold)) for c in "abcd"}
    assert {r.label: (r.n01, r.n10) for r in got} == want


# A published table of raters.
def test_fleiss_table(spark):
    table = ["0 0 0 0 14", "0 2 6 4 2", "0 0 3 5 6", "0 3 9 2 0", "2 2 8 1 1", "7 7 0 0 0", "3 2 6 3 0", "2 5 3 2 2", "6 5 2 1 0", "0 2 2 3 7"]
    rows = [(s, c, int(n)) for s, line in enumerate(table) for c, n in enumerate(line.split())]
    got = ev.fleiss(spark.createDataFrame(rows, "subject int, category int, n int")).first()
    assert round(got.kappa, 3) == round(got.simple, 3) == 0.210
    # by hand from the definitions
    x = np.array([[int(n) for n in line.split()] for line in table], float)
    n, m = 10, 14
    p = x.sum(axis=0) / (n * m)
    b, c = p * (1 - p), n * m * (m - 1)
    error = math.sqrt(2 * (b.sum() ** 2 - (b * (1 - 2 * p)).sum())) / (b * math.sqrt(c)).sum()
    assert math.isclose(got.z, got.kappa / error, rel_tol=1e-9) and math.isclose(got.p, math.erfc(abs(got.z) / math.sqrt(2)), rel_tol=1e-9)
    short = [r for r in rows if r[2]]
    assert math.isclose(ev.fleiss(spark.createDataFrame(short, "subject int, category int, n int")).first().z, got.z)
    with pytest.raises(Exception, match="different numbers"):
        ev.fleiss(spark.createDataFrame(rows[1:] + [(0, 0, 3)], "subject int, category int, n int")).collect()


def test_sequences(spark):
    rows = [(t, i, x) for t, xs in enumerate([[1, 2, 3], [4, 5], [6, 7, 8, 9, 10, 11, 12]]) for i, x in enumerate(xs)]
    threads = spark.createDataFrame(rows, "thread_id int, pos int, instance_id int")
    edges = sq.to_edges(threads)
    back = {(r.root, r.pos): r.instance_id for r in sq.to_threads(edges).collect()}
    assert back == {(rows[0][2] if t == 0 else 4 if t == 1 else 6, i): x for t, i, x in rows}
    branch = spark.createDataFrame([(1, 2), (1, 3)], "parent int, child int")
    with pytest.raises(ValueError):
        sq.to_threads(branch)
    assert {r.instance_id: r.level for r in sq.topological_levels(branch).collect()} == {1: 0, 2: 1, 3: 1}
    cycle = spark.createDataFrame([(1, 2), (2, 1)], "parent int, child int")
    for f in (sq.to_threads, sq.topological_levels):
        with pytest.raises(ValueError):
            f(cycle)


def test_meta(spark):
    cm = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "instance_id int, label string")
    assert {(r.instance_id, r.label) for r in mt.expand_powerset(mt.powerset(cm)).collect()} == {(1, "a"), (1, "b"), (2, "a")}
    p = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.4)], "instance_id int, ord int, p double")
    got = {r.ord: r.score for r in mt.ordinal_scores(p, 3).collect()}
    assert math.isclose(got[0], 0.1) and math.isclose(got[1], 0.5) and math.isclose(got[2], 0.4)


def test_class_maps(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "instance_id int")
    cm = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "instance_id int, label string")
    assert {r.instance_id: r.stratum for r in cl.strata(ids, cm).collect()} == {1: "a|b", 2: "a", 3: ""}
    assert not cl.is_one_of_m(cm, ids).first().one_of_m
    assert [r.label for r in cl.superfluous(cm, spark.createDataFrame([("a",)], "label string")).collect()] == ["b"]


def test_metadata(spark):
    meta = spark.createDataFrame([("r1", {"a": "1", "date": "x"}), ("r2", {"a": "2"})], "result_id string, meta map<string,string>")
    assert md.find_one(meta, {"a": "2", "date": None}) == "r2"
    with pytest.raises(LookupError):
        md.find_one(meta, {"a": "3"})
    src = spark.createDataFrame([("r3", {"a": "1", "date": "y"}), ("r4", {"a": "9"})], "result_id string, meta map<string,string>")
    assert {r.result_id for r in md.merge(meta, src).collect()} == {"r1", "r2", "r4"}


def test_row_numbers_over_many_ranges(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", (i * 7919) % 101, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(11)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.g, r.v, r.i): r.rn for r in row_numbers(df, [F.desc("v"), F.col("i")], ["g"]).collect()}
        whole = [r.i for r in row_numbers(df, [F.col("v"), F.col("i")]).orderBy("rn").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    for g in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert all(got[r] == k + 1 for k, r in enumerate(order))
    assert whole == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]


def test_class_tree_routes_by_node(spark):
    texts = {1: ("a", "x x p"), 2: ("b", "x x q"), 3: ("c", "y y p"), 4: ("d", "y y q"), 11: ("a", "x p p"), 12: ("d", "y q q")}
    cells = lambda ids: spark.createDataFrame([(i, w, t.split().count(w)) for i, (_, t) in texts.items() if i in ids for w in set(t.split())], "instance_id int, feature string, value int")
    labels = spark.createDataFrame([(i, c) for i, (c, _) in texts.items() if i < 10], "instance_id int, label string")
    got = cf.class_tree(cells(range(10)), labels, cells((11, 12)), {"left": ["a", "b"], "right": ["c", "d"]}).collect()
    assert {(r.instance_id, r.node) for r in got} == {(11, "root"), (11, "left"), (11, "a"), (12, "root"), (12, "right"), (12, "d")}


def test_approximate_neighbours_recall(spark):
    rows = ml.dense(spark.read.parquet(f"{SMALL}/embeddings.parquet")).select("vec_id", "features", "embedding")
    vectors = {r.vec_id: np.array(r.embedding) for r in rows.collect()}
    queries = [i for i in vectors if i % 10 == 0]
    got = {r.test: r.train for r in ml.approximate_nearest(rows.select("vec_id", "features"), rows.where("vec_id % 10 = 0").select("vec_id", "features"), "vec_id", threshold=20.0).collect()}
    best = {i: min((j for j in vectors if j != i), key=lambda j: (np.linalg.norm(vectors[i] - vectors[j]), j)) for i in queries}
    assert sum(got.get(i) == best[i] for i in queries) >= 0.9 * len(queries)


def test_approximate_neighbours_by_blocks_without_a_join(spark, monkeypatch):
    for name, size in (("AT_ONCE", 20), ("QUERIES", 7), ("ROWS", 50), ("PAIRS", 100)):
        monkeypatch.setattr(ml, name, size)
    rows = ml.dense(spark.read.parquet(f"{SMALL}/embeddings.parquet")).select("vec_id", "features")
    rows = rows.union(rows.where("vec_id < 9").selectExpr("vec_id + 100000", "features"))  # ties
    asked = rows.where("vec_id % 10 = 0")
    got = ml.approximate_nearest(rows, asked, "vec_id", threshold=15.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    model = ml.BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=0.5, numHashTables=16, seed=ml.SEED).fit(rows)
    pairs = model.approxSimilarityJoin(asked, rows, 15.0, distCol="dist").selectExpr("datasetA.vec_id AS test", "datasetB.vec_id AS train", "dist").where("test <> train")
    want = pairs.groupBy("test").agg(F.min(F.struct("dist", "train")).alias("b")).collect()
    assert {(r.test, r.train, round(r.dist, 9)) for r in got.collect()} == {(r.test, r.b.train, round(r.b.dist, 9)) for r in want} != set()
    assert ml.approximate_nearest(rows, asked.limit(0), "vec_id").count() == 0


def occurrences(text, keywords):
    return sorted((i, k) for k in set(keywords) if k for i in range(len(text) - len(k) + 1) if text.startswith(k, i))


def test_keyword_automaton(spark, monkeypatch):
    rng = random.Random(8)
    alphabet = "abé😀 "
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in [0, 1, 2, 30, 200, 700, 3000] * 3] + [None, "a" * 2000, "ab" * 900]
    keywords = ["", "a", "aa", "aaa", "ab", "ba", "é", "😀 ", "é😀é", "a" * 150, "never", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 7))) for _ in range(60))]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, keyword string").repartition(3)
    want = sorted((i, s, k) for i, t in enumerate(texts) for s, k in occurrences(t or "", keywords))
    for most in (scan.MOST_CELLS, 400):  # one automaton, or many
        monkeypatch.setattr(scan, "MOST_CELLS", most)
        assert (len(scan.automata([k.encode() for k in keywords if k])) > 1) == (most == 400)
        assert sorted(tuple(r) for r in scan.scan(frame, keywords).collect()) == want
        keywords = keywords[::-1] + ["a"]  # the order doesn't matter, nor do repeats
    few = [k for k in keywords if k]
    present = frame.select("doc_id", F.explode(tx.keyword_matches(F.col("text"), few)).alias("m")).select("doc_id", "m.start", "m.keyword")
    assert sorted(tuple(r) for r in present.collect()) == want
    assert scan.scan(frame, []).count() == 0 and scan.scan(frame.limit(0), ["a"]).count() == 0


def test_fifty_thousand_keywords(spark):
    rng = random.Random(9)
    keywords = list({"".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 12))) for _ in range(55_000)})
    assert len(keywords) > 50_000
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(5000)) for _ in range(20)]
    got = scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keywords).collect()
    known, want = set(keywords), []
    for i, t in enumerate(texts):
        want += [(i, s, t[s : s + n]) for n in range(4, 12) for s in range(len(t) - n + 1) if t[s : s + n] in known]
    assert sorted(tuple(r) for r in got) == sorted(want) and want
