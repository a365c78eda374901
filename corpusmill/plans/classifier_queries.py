"""Queries over prototypes, distances, classifiers and meta-classification."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import classify as cf
from ..operators import evaluate as ev
from ..operators import features as fm
from ..operators import meta as mt
from ..operators import neighbours as nb
from ..operators import prototypes as pr
from ..operators import weights as wt
from .base import FB, FW, LANG, ML, TT, folds_sql, q

R = lambda c, n=6: F.round(c, n).alias(c)


def parts(t, features=None):
    """(train features, train classes, test features) of the stratified split."""
    w, split = t.stored(features if features is not None else t.words()), t.stored(t.train_test())
    train, test = (split.where(F.col("role") == r).select("instance_id") for r in ("train", "test"))
    return w.join(train, "instance_id", "left_semi"), t.langs().join(train, "instance_id", "left_semi"), w.join(test, "instance_id", "left_semi")


STRATA_TT = TT
SPLIT = f"{FW}, {TT}, tr AS (SELECT f.* FROM f JOIN tt USING (instance_id) WHERE role = 'train'), te AS (SELECT f.* FROM f JOIN tt USING (instance_id) WHERE role = 'test'), cm AS (SELECT doc_id AS instance_id, lang AS label FROM documents JOIN tt ON doc_id = instance_id WHERE role = 'train'), nc AS (SELECT label, count(*) AS n_c FROM cm GROUP BY 1)"
PROTO = {
    "mean": "CAST(sum(value) AS DOUBLE) / max(n_c)", "sum": "CAST(sum(value) AS DOUBLE)", "gmean": "exp(sum(ln(value)) / max(n_c))", "hmean": "max(n_c) / sum(1.0::DOUBLE / value)",
}


def proto_sql(how: str) -> str:
    return f"p AS (SELECT label, feature, {PROTO[how]} AS value FROM tr JOIN cm USING (instance_id) JOIN nc USING (label) GROUP BY ALL)"


for _how in PROTO:

    def _prototype(t, how=_how):
        train, classes, _ = parts(t)
        return pr.prototypes(train, classes, how).select("label", "feature", R("value"))

    q(f"pr_{_how}", f"WITH {SPLIT}, {proto_sql(_how)} SELECT label, feature, round(value, 6) AS value FROM p")(_prototype)


def dense_sql(default: float = 0.0) -> str:
    """Whole vectors over the features of both parts: dp(label, feature, value) and dq(instance_id, feature, value)."""
    return f"""u AS (SELECT feature FROM tr UNION SELECT feature FROM te), dp AS (SELECT l.label, u.feature, round(coalesce(p.value, {default!r}::DOUBLE), 9) AS value FROM (SELECT DISTINCT label FROM p) l CROSS JOIN u LEFT JOIN p ON p.label = l.label AND p.feature = u.feature),
    dq AS (SELECT i.instance_id, u.feature, CAST(coalesce(te.value, 0) AS DOUBLE) AS value FROM (SELECT DISTINCT instance_id FROM te) i CROSS JOIN u LEFT JOIN te ON te.instance_id = i.instance_id AND te.feature = u.feature)"""


def rank_sql(table: str, key: str, out: str) -> str:
    return f"{out} AS (SELECT {key}, feature, rank() OVER (PARTITION BY {key} ORDER BY value) + (count(*) OVER (PARTITION BY {key}, value) - 1) / 2 AS r FROM {table})"


#: dist(label, instance_id, dist) from dense vectors, straight from the definitions
DENSE = {
    "cosine": "dist AS (SELECT label, instance_id, 1 - sum(dp.value * dq.value) / (sqrt(sum(dp.value * dp.value)) * sqrt(sum(dq.value * dq.value))) AS dist FROM dp JOIN dq USING (feature) GROUP BY ALL)",
    "skew": "pp AS (SELECT label, feature, value / sum(value) OVER (PARTITION BY label) AS p FROM dp), qq AS (SELECT instance_id, feature, value / sum(value) OVER (PARTITION BY instance_id) AS q FROM dq), dist AS (SELECT label, instance_id, sum(CASE WHEN p > 0 THEN p * ln(p / (0.99::DOUBLE * q + 0.01::DOUBLE * p)) ELSE 0 END) AS dist FROM pp JOIN qq USING (feature) GROUP BY ALL)",
    "oop": f"{rank_sql('dp', 'label', 'rp')}, {rank_sql('dq', 'instance_id', 'rq')}, dist AS (SELECT label, instance_id, CAST(sum(abs(rp.r - rq.r)) AS DOUBLE) AS dist FROM rp JOIN rq USING (feature) GROUP BY ALL)",
    "spearman": f"{rank_sql('dp', 'label', 'rp')}, {rank_sql('dq', 'instance_id', 'rq')}, dist AS (SELECT label, instance_id, 1 - corr(rp.r, rq.r) AS dist FROM rp JOIN rq USING (feature) GROUP BY ALL)",
}
DISTANCES = {"cosine": pr.class_cosine, "skew": pr.class_skew, "oop": pr.out_of_place, "spearman": pr.spearman}


def class_distances(t, distance: str, how: str):
    train, classes, test = parts(t)
    protos = t.stored(pr.prototypes(train, classes, how).withColumn("value", F.round("value", 9)))
    return DISTANCES[distance](protos, test, pr.space_size(train, test), default=pr.DEFAULTS[how])


def distance_sql(distance: str, how: str) -> str:
    return f"{SPLIT}, {proto_sql(how)}, {dense_sql(pr.DEFAULTS[how])}, {DENSE[distance]}"


for _name, _distance, _how in (("ds_cosine", "cosine", "mean"), ("ds_skew", "skew", "sum"), ("ds_outofplace", "oop", "sum"), ("ds_spearman", "spearman", "sum")):

    def _distances(t, distance=_distance, how=_how):
        return class_distances(t, distance, how).select("label", "instance_id", R("dist", 5))

    q(_name, f"WITH {distance_sql(_distance, _how)} SELECT label, instance_id, round(dist, 5) AS dist FROM dist")(_distances)


#: nearest prototypes: every distance with every prototype; the first is clf_nearest_prototype itself
for _distance in ("cosine", "skew", "oop"):
    for _how in ("mean", "gmean", "hmean"):

        def _nearest(t, distance=_distance, how=_how):
            d = class_distances(t, distance, how).withColumn("dist", F.round("dist", 5))
            return pr.nearest(d, "label").select("instance_id", "label", "dist")

        q("clf_nearest_prototype" if (_distance, _how) == ("cosine", "mean") else f"clf_nearest_{_distance}_{_how}", f"WITH {distance_sql(_distance, _how)}, nn AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY round(dist, 5), label) AS rn FROM dist) SELECT instance_id, label, round(dist, 5) AS dist FROM nn WHERE rn = 1")(_nearest)


KL = f"""{SPLIT}, sp AS (SELECT feature, CAST(sum(value) AS DOUBLE) AS t FROM tr GROUP BY 1), th AS (SELECT feature, t / (SELECT sum(t) FROM sp) AS theta FROM sp),
cc AS (SELECT label AS key, feature, CAST(sum(value) AS DOUBLE) AS value FROM tr JOIN cm USING (instance_id) GROUP BY ALL), tc AS (SELECT instance_id AS key, feature, CAST(value AS DOUBLE) AS value FROM te JOIN th USING (feature)),
cs AS (SELECT key, sum(value) AS n, greatest(count(*) FILTER (WHERE value = 1), 1) AS h, 1 - sum(theta) AS u FROM cc JOIN th USING (feature) GROUP BY 1), ts AS (SELECT key, sum(value) AS n, greatest(count(*) FILTER (WHERE value = 1), 1) AS h, 1 - sum(theta) AS u FROM tc JOIN th USING (feature) GROUP BY 1),
pd AS (SELECT s.key AS label, th.feature, CASE WHEN c.value IS NOT NULL THEN (1 - CASE WHEN u > 1e-12 THEN least(h / n, 0.5) ELSE 0 END) * c.value / n ELSE least(h / n, 0.5) * theta / u END AS p FROM cs s CROSS JOIN th LEFT JOIN cc c ON c.key = s.key AND c.feature = th.feature),
qd AS (SELECT s.key AS instance_id, th.feature, CASE WHEN c.value IS NOT NULL THEN (1 - CASE WHEN u > 1e-12 THEN least(h / n, 0.5) ELSE 0 END) * c.value / n ELSE least(h / n, 0.5) * theta / u END AS q FROM ts s CROSS JOIN th LEFT JOIN tc c ON c.key = s.key AND c.feature = th.feature),
dist AS (SELECT label, instance_id, sum(p * ln(p / q)) AS dist FROM pd JOIN qd USING (feature) GROUP BY ALL)"""


@q("ds_kl", f"WITH {KL} SELECT label, instance_id, round(dist, 4) AS dist FROM dist")
def _(t):
    train, classes, test = parts(t)
    return cf.kl_prototype(train, classes, test).select("label", "instance_id", R("dist", 4))


@q("clf_kl_prototype", f"WITH {KL}, nn AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY round(dist, 9), label) AS rn FROM dist) SELECT lang AS gold, label, count(*) AS n FROM nn JOIN documents ON doc_id = instance_id WHERE rn = 1 GROUP BY ALL")
def _(t):
    """Which class is the nearest by smoothed divergence, and is it the right one?"""
    train, classes, test = parts(t)
    best = pr.nearest(cf.kl_prototype(train, classes, test), "label")
    return best.join(t.langs().withColumnRenamed("label", "gold"), "instance_id").groupBy("gold", "label").agg(F.count("*").alias("n"))


def search(t):
    """All instances, and as queries those whose id is divisible by 100."""
    w = t.stored(t.words())
    return w.withColumnRenamed("instance_id", "train_id"), w.where("instance_id % 100 = 0")


def knn(t, kind, furthest):
    train, queries = search(t)
    best = nb.Search(train, queries, kind).nearest().select("instance_id", "train_id", "dist")
    best = pr.with_strangers(best, queries, train.select("train_id").distinct(), furthest)
    return best.join(t.langs().withColumnRenamed("instance_id", "train_id"), "train_id").select("instance_id", "train_id", "label", R("dist"))


SEARCH = f"{FW}, {LANG}, qs AS (SELECT * FROM f WHERE instance_id % 100 = 0), ids AS (SELECT DISTINCT instance_id AS train_id FROM f), grid AS (SELECT i.instance_id, train_id FROM (SELECT DISTINCT instance_id FROM qs) i JOIN ids ON train_id <> i.instance_id)"
NEIGHBOUR = f"{SEARCH}, nrm AS (SELECT instance_id, sqrt(sum(value * value)) AS nr FROM f GROUP BY 1), dots AS (SELECT f.instance_id AS train_id, qs.instance_id, sum(f.value * qs.value) AS dot FROM f JOIN qs USING (feature) GROUP BY ALL), dist AS (SELECT g.instance_id, g.train_id, 1 - coalesce(dot, 0) / (a.nr * b.nr) AS dist FROM grid g JOIN nrm a ON a.instance_id = g.train_id JOIN nrm b ON b.instance_id = g.instance_id LEFT JOIN dots d ON d.instance_id = g.instance_id AND d.train_id = g.train_id)"
SKEWED = f"{SEARCH}, sh AS (SELECT instance_id, feature, value / sum(value) OVER (PARTITION BY instance_id) AS p FROM f), part AS (SELECT a.instance_id AS train_id, b.instance_id, sum(a.p * ln(a.p / (0.99::DOUBLE * b.p + 0.01::DOUBLE * a.p))) AS s, sum(a.p) AS mass FROM sh a JOIN sh b USING (feature) WHERE b.instance_id % 100 = 0 GROUP BY ALL), dist AS (SELECT g.instance_id, g.train_id, coalesce(s, 0) + (1 - coalesce(mass, 0)) * ln(100.0::DOUBLE) AS dist FROM grid g LEFT JOIN part d ON d.instance_id = g.instance_id AND d.train_id = g.train_id)"
FIRST = "nn AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY round(dist, 9), train_id) AS rn FROM dist)"


@q("nn_one", f"WITH {NEIGHBOUR}, {FIRST} SELECT nn.instance_id, train_id, label, round(dist, 6) + 0.0::DOUBLE AS dist FROM nn JOIN cm ON cm.instance_id = train_id WHERE rn = 1")
def _(t):
    return knn(t, "cosine", 1.0)


@q("nn_class_dist", f"WITH {NEIGHBOUR} SELECT dist.instance_id, label, round(min(dist), 6) + 0.0::DOUBLE AS dist FROM dist JOIN cm ON cm.instance_id = train_id GROUP BY ALL")
def _(t):
    train, queries = search(t)
    groups = t.langs().select(F.col("instance_id").alias("train_id"), F.col("label").alias("group"))
    near = nb.Search(train, queries, "cosine", groups).nearest()
    return pr.class_distance(near.select("instance_id", "train_id", "dist"), t.langs(), queries).select("instance_id", "label", R("dist"))


@q("clf_knn", f"WITH {SKEWED}, {FIRST} SELECT nn.instance_id, train_id, label, round(dist, 6) + 0.0::DOUBLE AS dist FROM nn JOIN cm ON cm.instance_id = train_id WHERE rn = 1")
def _(t):
    return knn(t, "skew", math.log(100))


def gram_sql(n: int) -> str:
    return f"SELECT doc_id AS instance_id, substr(h, 2 * i - 1, {2 * n}) AS feature FROM (SELECT doc_id, h, unnest(generate_series(1, len(h) // 2 - {n - 1})) AS i FROM hx)"


TEXTCAT = f"""hx AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), g AS (SELECT instance_id, feature, count(*) AS value FROM ({" UNION ALL ".join(gram_sql(n) for n in range(1, 6))}) GROUP BY ALL),
{STRATA_TT}, cm AS (SELECT doc_id AS instance_id, lang AS label FROM documents JOIN tt ON doc_id = instance_id WHERE role = 'train'),
gs AS (SELECT label, feature, sum(value) AS n FROM g JOIN cm USING (instance_id) GROUP BY ALL), kept AS (SELECT DISTINCT feature FROM (SELECT feature, row_number() OVER (PARTITION BY label ORDER BY n DESC, feature) - 1 AS r FROM gs) WHERE r < 300),
tr AS (SELECT g.* FROM g JOIN tt USING (instance_id) SEMI JOIN kept USING (feature) WHERE role = 'train'), te AS (SELECT g.* FROM g JOIN tt USING (instance_id) SEMI JOIN kept USING (feature) WHERE role = 'test'), nc AS (SELECT label, count(*) AS n_c FROM cm GROUP BY 1)"""


@q("clf_textcat", f"WITH {TEXTCAT}, {proto_sql('sum')}, {dense_sql()}, {DENSE['oop']}, nn AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY round(dist, 5), label) AS rn FROM dist) SELECT instance_id, label, round(dist, 5) AS dist FROM nn WHERE rn = 1", once=True)
def _(t):
    """Profiles of byte 1- to 5-grams: the 300 commonest of each class are the space, ranked out of place."""
    grams = F.concat(*[tx.byte_ngrams(F.col("text"), n) for n in range(1, 6)])
    train, classes, test = parts(t, fm.feature_counts(t.documents, grams))
    kept = F.broadcast(t.stored(wt.less_than(wt.cavnar_trenkle(train, classes), 300)))  # proven bound: 300 features a class
    train, test = t.stored(wt.select(train, kept)), t.stored(wt.select(test, kept))
    d = pr.out_of_place(t.stored(pr.prototypes(train, classes, "sum")), test, pr.space_size(train, test))
    return pr.nearest(d.withColumn("dist", F.round("dist", 5)), "label").select("instance_id", "label", "dist")


def nb_cte(features: str = "b", cell: str = "value", pre: str = "") -> str:
    """CTEs that end in `pre`nb(fold, instance_id, label, score), from a feature table, folds and cm."""
    x = pre
    return f"""{x}cells AS (SELECT test_fold, label, feature, sum({cell}) AS n FROM {features} JOIN cm USING (instance_id) JOIN folds USING (instance_id) GROUP BY ALL),
    {x}ks AS (SELECT DISTINCT test_fold AS fold FROM folds), {x}v AS (SELECT count(DISTINCT feature) AS v FROM {x}cells),
    {x}model AS (SELECT k.fold, label, feature, sum(n) AS n FROM {x}cells, {x}ks k WHERE test_fold <> k.fold GROUP BY ALL),
    {x}cls AS (SELECT k.fold, label, count(*) AS d FROM cm JOIN folds USING (instance_id), {x}ks k WHERE test_fold <> k.fold GROUP BY ALL),
    {x}tot AS (SELECT fold, label, sum(n) AS w FROM {x}model GROUP BY ALL),
    {x}x AS (SELECT test_fold AS fold, instance_id, feature, value FROM {features} JOIN folds USING (instance_id)), {x}ln_ AS (SELECT fold, instance_id, sum(value) AS len FROM {x}x GROUP BY ALL),
    {x}hit AS (SELECT fold, instance_id, label, sum(value * ln(1 + n)) AS s FROM {x}x JOIN {x}model USING (fold, feature) GROUP BY ALL),
    {x}nb AS (SELECT l.fold, l.instance_id, c.label, ln(c.d) + coalesce(s, 0) - len * ln(v.v + coalesce(w, 0)) AS score FROM {x}ln_ l JOIN {x}cls c ON c.fold = l.fold JOIN {x}v v ON true LEFT JOIN {x}tot t ON t.fold = c.fold AND t.label = c.label LEFT JOIN {x}hit h ON h.fold = l.fold AND h.instance_id = l.instance_id AND h.label = c.label)"""


def nb_sql(cell: str = "value") -> str:
    return f"{FB}, {folds_sql()}, {LANG}, {nb_cte(cell=cell)}"


def best_sql(scores: str, out: str = "best") -> str:
    return f"{out} AS (SELECT fold, instance_id, label FROM (SELECT *, row_number() OVER (PARTITION BY fold, instance_id ORDER BY round(score, 9) DESC, label) AS rn FROM {scores}) WHERE rn = 1)"


def nodes_sql(branches, pre: str, train: str = "tr", classes: str = "cm", test: str = "te", at: str = "at0") -> str:
    """CTEs that end in `pre`nb(instance_id, node, branch, score): naive Bayes for the tasks of (node, label, branch)."""
    x, values = pre, ", ".join(f"('{n}', '{l}', '{b}')" for n, l, b in branches)
    return f"""{x}br(node, label, branch) AS (VALUES {values}), {x}rw AS (SELECT DISTINCT instance_id, node, branch FROM {classes} JOIN {x}br USING (label)), {x}v AS (SELECT count(DISTINCT feature) AS v FROM {train}),
    {x}d AS (SELECT node, branch, count(*) AS d FROM {x}rw GROUP BY ALL), {x}c AS (SELECT node, branch, feature, sum(value) AS n FROM {train} JOIN {x}rw USING (instance_id) GROUP BY ALL), {x}w AS (SELECT node, branch, sum(n) AS w FROM {x}c GROUP BY ALL),
    {x}k AS (SELECT instance_id, node, feature, value FROM {test} JOIN {at} USING (instance_id) SEMI JOIN {x}c USING (node, feature)), {x}l AS (SELECT instance_id, node, sum(value) AS len FROM {x}k GROUP BY ALL),
    {x}s AS (SELECT instance_id, node, branch, sum(value * ln(1 + n)) AS s FROM {x}k JOIN {x}c USING (node, feature) GROUP BY ALL),
    {x}nb AS (SELECT a.instance_id, a.node, d.branch, ln(d.d) + coalesce(s, 0) - coalesce(len, 0) * ln(v.v + coalesce(w, 0)) AS score FROM {at} a JOIN {x}d d ON d.node = a.node CROSS JOIN {x}v v LEFT JOIN {x}w w ON w.node = d.node AND w.branch = d.branch
    LEFT JOIN {x}l l ON l.instance_id = a.instance_id AND l.node = a.node LEFT JOIN {x}s s ON s.instance_id = a.instance_id AND s.node = a.node AND s.branch = d.branch)"""


def naive_bayes(t, boolean=False):
    return cf.naive_bayes_cv(t.stored(t.bigrams()), t.langs(), t.folds(), boolean)


@q("clf_nb_multinomial", f"WITH {nb_sql()} SELECT CAST(fold AS INTEGER) AS fold, instance_id, label, round(score, 4) AS score FROM nb")
def _(t):
    return naive_bayes(t).select("fold", "instance_id", "label", R("score", 4))


@q("clf_nb_boolean", f"WITH {nb_sql('1')} SELECT CAST(fold AS INTEGER) AS fold, instance_id, label, round(score, 4) AS score FROM nb")
def _(t):
    return naive_bayes(t, True).select("fold", "instance_id", "label", R("score", 4))


@q("clf_nb_probabilities", f"WITH {nb_sql()}, e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY fold, instance_id)) AS e FROM nb) SELECT CAST(fold AS INTEGER) AS fold, instance_id, label, round(e / sum(e) OVER (PARTITION BY fold, instance_id), 4) AS score FROM e")
def _(t):
    return cf.probabilities(naive_bayes(t), ["fold", "instance_id"]).select("fold", "instance_id", "label", R("score", 4))


BEST = best_sql("nb")


@q("it_highest", f"WITH {nb_sql()}, {BEST} SELECT CAST(fold AS INTEGER) AS fold, instance_id, label FROM best")
def _(t):
    return ev.highest(naive_bayes(t), ["fold", "instance_id"])


@q("entry_language_id", f"""WITH {nb_sql()}, {BEST}, g AS (SELECT test_fold AS fold, instance_id, label FROM cm JOIN folds USING (instance_id)),
cells AS (SELECT l.label, count(*) FILTER (WHERE g.label = l.label AND b.label = l.label) AS tp, count(*) FILTER (WHERE g.label <> l.label AND b.label = l.label) AS fp, count(*) FILTER (WHERE g.label = l.label AND b.label <> l.label) AS fn FROM g JOIN best b USING (fold, instance_id), (SELECT DISTINCT label FROM g) l GROUP BY 1),
c AS (SELECT label, tp / (tp + fn) AS recall, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, 2 * tp / (2 * tp + fn + fp) AS fscore FROM cells)
SELECT 'micro' AS average, round((SELECT sum(tp) / (sum(tp) + sum(fp)) FROM cells), 6) AS precision, round((SELECT sum(tp) / (sum(tp) + sum(fn)) FROM cells), 6) AS recall, round((SELECT 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) FROM cells), 6) AS fscore
UNION ALL SELECT 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(fscore), 6) FROM c""".replace("cells AS (SELECT test_fold", "cells0 AS (SELECT test_fold").replace("FROM cells, ks", "FROM cells0, ks").replace("count(DISTINCT feature) AS v FROM cells)", "count(DISTINCT feature) AS v FROM cells0)"))
def _(t):
    folds, langs = t.folds(), t.langs()
    found = ev.highest(cf.naive_bayes_cv(t.stored(t.bigrams()), langs, folds), ["fold", "instance_id"])
    gold = langs.join(folds, "instance_id").select(F.col("test_fold").alias("fold"), "instance_id", "label")
    cells = ev.confusion(gold, found, gold.select("fold", "instance_id"), langs.select("label").distinct())
    names = ["precision", "recall", "fscore"]
    one = ev.micro(cells).select(F.lit("micro").alias("average"), *[R(c) for c in names])
    return one.unionByName(ev.macro(cells).select(F.lit("macro").alias("average"), *[R(c) for c in names]))


TREE = {"romance": ["es", "fr"], "germanic": ["de", "en"]}
TREE_ROWS = cf.tree_branches(TREE)
TREE_SQL = f"""{SPLIT}, at0 AS (SELECT DISTINCT instance_id, 'root' AS node FROM te), {nodes_sql([r[1:] for r in TREE_ROWS if r[0] == 0], 'na_')},
at1 AS (SELECT instance_id, branch AS node FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY round(score, 9) DESC, branch) AS rn FROM na_nb) WHERE rn = 1),
{nodes_sql([r[1:] for r in TREE_ROWS if r[0] == 1], 'nz_', at='at1')}, at2 AS (SELECT instance_id, branch AS node FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY round(score, 9) DESC, branch) AS rn FROM nz_nb) WHERE rn = 1),
routed AS (SELECT * FROM at0 UNION ALL SELECT * FROM at1 UNION ALL SELECT * FROM at2)"""


@q("clf_class_tree", f"WITH {TREE_SQL} SELECT instance_id, node AS label FROM at2", once=True)
def _(t):
    """Languages by way of their family: the leaf that each text is routed to."""
    train, classes, test = parts(t)
    leaves = sorted({r[2] for r in TREE_ROWS})
    return cf.class_tree(train, classes, test, TREE).where(F.col("node").isin(leaves)).select("instance_id", F.col("node").alias("label"))


@q("clf_class_tree_nodes", f"""WITH {TREE_SQL}, own(node, label) AS (VALUES {", ".join(f"('{r[1]}', '{r[2]}')" for r in TREE_ROWS)}, {", ".join(f"('{x}', '{x}')" for x in sorted({r[2] for r in TREE_ROWS}))}),
gold AS (SELECT DISTINCT instance_id, node FROM (SELECT DISTINCT instance_id FROM te) JOIN documents ON doc_id = instance_id JOIN own ON label = lang)
SELECT node, count(g.instance_id) AS n_gold, count(r.instance_id) AS n_routed, count(*) FILTER (WHERE g.instance_id IS NOT NULL AND r.instance_id IS NOT NULL) AS n_both FROM gold g FULL JOIN routed r USING (instance_id, node) GROUP BY 1""", once=True)
def _(t):
    """For each node of the tree, how many test instances belong there, are routed there, and both."""
    train, classes, test = parts(t)
    own = [(r[1], r[2]) for r in TREE_ROWS] + [(x, x) for x in sorted({r[2] for r in TREE_ROWS})]
    labels = t.langs().join(test.select("instance_id").distinct(), "instance_id", "left_semi")
    gold = labels.join(F.broadcast(t.spark.createDataFrame(own, "node string, label string")), "label").select("instance_id", "node").distinct()
    return cf.node_analysis(gold, cf.class_tree(train, classes, test, TREE))


TEST = f"{TT}, te AS (SELECT instance_id FROM tt WHERE role = 'test'), cm AS (SELECT doc_id AS instance_id, lang AS label FROM documents JOIN tt ON doc_id = instance_id WHERE role = 'train')"


def sides(t):
    split = t.train_test()
    test = split.where("role = 'test'").select("instance_id")
    return test, t.langs().join(split.where("role = 'train'"), "instance_id", "left_semi")


@q("clf_uniform", f"WITH {TEST} SELECT instance_id, label, 0.25::DOUBLE AS score FROM te, (SELECT DISTINCT label FROM cm)")
def _(t):
    test, train = sides(t)
    return cf.uniform(test, train.select("label").distinct())


@q("clf_prior", f"WITH {TEST} SELECT instance_id, label, round(share, 9) AS score FROM te, (SELECT label, count(*) / sum(count(*)) OVER () AS share FROM cm GROUP BY 1)")
def _(t):
    return cf.prior(*sides(t)).select("instance_id", "label", R("score", 9))


@q("clf_majority", f"WITH {TEST} SELECT instance_id, label FROM te, (SELECT label FROM cm GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 2)")
def _(t):
    return cf.majority(*sides(t), 2)


@q("clf_random", f"WITH {TEST}, r AS (SELECT instance_id AS train_id, label, row_number() OVER (ORDER BY md5('random|' || instance_id), instance_id) - 1 AS place, count(*) OVER () AS n FROM cm) SELECT te.instance_id, label FROM te JOIN r ON r.place = CAST(('0x' || substr(md5('random-draw|' || te.instance_id), 1, 8)) AS BIGINT) % r.n")
def _(t):
    return cf.random_label(*sides(t))


# ---- meta-classification


CELLS = f"{FW}, {LANG}, cells AS (SELECT label, feature, sum(value) AS n FROM f JOIN cm USING (instance_id) GROUP BY ALL)"


@q("mt_binary", f"WITH {CELLS} SELECT label AS task, feature, CAST(n AS BIGINT) AS positive, CAST(sum(n) OVER (PARTITION BY feature) - n AS BIGINT) AS negative FROM cells")
def _(t):
    cells = t.words().join(t.langs(), "instance_id").groupBy("label", "feature").agg(F.sum("value").alias("n"))
    return mt.one_vs_rest_counts(cells)


@q("mt_repeat", f"WITH {FW}, {ML} SELECT instance_id || '#' || label AS instance_id, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM f JOIN ml USING (instance_id) GROUP BY 1")
def _(t):
    rows, _labels = mt.repeat_labels(t.words(), t.multilabel())
    return rows.groupBy("instance_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@q("mt_replicate", f"""WITH {FW}, ids AS (SELECT DISTINCT instance_id FROM f), r AS (SELECT instance_id, row_number() OVER (ORDER BY md5('replicate|' || instance_id), instance_id) AS rn, count(*) OVER () AS n FROM ids),
l AS (SELECT instance_id, instance_id AS source FROM ids UNION ALL SELECT a.instance_id, b.instance_id FROM r a JOIN r b ON b.rn = a.rn % a.n + 1) SELECT l.instance_id, feature, CAST(sum(value) AS BIGINT) AS value FROM l JOIN f ON f.instance_id = l.source GROUP BY ALL""")
def _(t):
    return mt.replicate(t.words(), t.langs())[0]


@q("mt_stratified", f"WITH {ML} SELECT instance_id, string_agg(label, '|' ORDER BY label) AS label FROM ml GROUP BY 1")
def _(t):
    return mt.powerset(t.multilabel())


@q("mt_expand", f"WITH {ML} SELECT * FROM ml")
def _(t):
    return mt.expand_powerset(mt.powerset(t.multilabel()))


@q("mt_unknown", "SELECT l.task, doc_id AS instance_id, lang = l.task AS positive FROM documents, (SELECT DISTINCT lang AS task FROM documents WHERE lang <> 'en') l WHERE lang = l.task OR lang = 'en'")
def _(t):
    return mt.known_vs_unknown(t.langs(), "en")


@q("mt_accept", "WITH a AS (SELECT doc_id, lang FROM documents WHERE lang <> 'en' AND substr(md5('a|' || doc_id), 1, 1) < '8') SELECT doc_id AS instance_id, lang AS label FROM a UNION ALL SELECT doc_id, 'en' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a)")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("instance_id"), F.col("lang").alias("task"), ((F.col("lang") != "en") & (F.substring(F.md5(F.concat(F.lit("a|"), F.col("doc_id").cast("string"))), 1, 1) < "8")).alias("accepted"))
    return mt.accept_or_unknown(d, "en")


ALL_AT = "ids0 AS (SELECT DISTINCT instance_id FROM te)"
GOLD_COUNTS = "SELECT lang AS gold, label, count(*) AS n FROM found JOIN documents ON doc_id = instance_id GROUP BY ALL"


def gold_counts(t, found):
    return found.join(t.langs().withColumnRenamed("label", "gold"), "instance_id").groupBy("gold", "label").agg(F.count("*").alias("n"))


UNKNOWN = mt.unknown_branches(["de", "en", "es", "fr"], "en")


@q("mt_unknown_learn", f"""WITH {SPLIT}, {ALL_AT}, at0 AS (SELECT instance_id, node FROM ids0, (VALUES ('de'), ('es'), ('fr')) n(node)), {nodes_sql(UNKNOWN, 'na_')},
yes AS (SELECT instance_id, node AS label FROM na_nb GROUP BY ALL HAVING round(max(score) FILTER (WHERE branch = node) - max(score) FILTER (WHERE branch = 'en'), 9) > 0),
found AS (SELECT * FROM yes UNION ALL SELECT instance_id, 'en' FROM ids0 WHERE instance_id NOT IN (SELECT instance_id FROM yes)) {GOLD_COUNTS}""", once=True)
def _(t):
    """A naive Bayes for each known class against the unknown one; what none accepts is unknown."""
    train, classes, test = parts(t)
    at = test.select("instance_id").distinct().crossJoin(F.broadcast(t.spark.createDataFrame([(x,) for x in ("de", "es", "fr")], "node string")))
    scores = cf.nb_nodes(train, classes, t.spark.createDataFrame(UNKNOWN, "node string, label string, branch string"), test, at)
    lead = F.max(F.when(F.col("branch") == F.col("node"), F.col("score"))) - F.max(F.when(F.col("branch") == "en", F.col("score")))
    decisions = scores.groupBy("instance_id", F.col("node").alias("task")).agg((F.round(lead, 9) > 0).alias("accepted"))
    return gold_counts(t, mt.accept_or_unknown(decisions, "en"))


ORDER = ["de", "en", "es", "fr"]


@q("mt_ordinal_learn", f"""WITH {SPLIT}, {ALL_AT}, at0 AS (SELECT instance_id, node FROM ids0, (VALUES ('0'), ('1'), ('2')) n(node)), {nodes_sql(mt.ordinal_branches(ORDER), 'na_')},
p AS (SELECT instance_id, CAST(node AS INTEGER) AS o, 1 / (1 + exp(greatest(-700, least(700, max(score) FILTER (WHERE branch = 'upto') - max(score) FILTER (WHERE branch = 'after'))))) AS p FROM na_nb GROUP BY ALL),
wide AS (SELECT instance_id, max(p) FILTER (WHERE o = 0) AS a, max(p) FILTER (WHERE o = 1) AS b, max(p) FILTER (WHERE o = 2) AS c FROM p GROUP BY 1)
SELECT instance_id, unnest([0, 1, 2, 3])::INTEGER AS ord, round(unnest([1 - a, a - b, b - c, c]), 5)::DOUBLE + 0.0::DOUBLE AS score FROM wide""", once=True)
def _(t):
    """A naive Bayes for each task whether the class comes after the i-th, put together to class probabilities."""
    train, classes, test = parts(t)
    at = test.select("instance_id").distinct().crossJoin(F.broadcast(t.spark.createDataFrame([("0",), ("1",), ("2",)], "node string")))
    scores = cf.nb_nodes(train, classes, t.spark.createDataFrame(mt.ordinal_branches(ORDER), "node string, label string, branch string"), test, at)
    gap = F.max(F.when(F.col("branch") == "upto", F.col("score"))) - F.max(F.when(F.col("branch") == "after", F.col("score")))
    p = 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), gap))))
    greater = scores.groupBy("instance_id", "node").agg(p.alias("p")).select("instance_id", F.col("node").cast("int").alias("ord"), "p")
    return mt.ordinal_scores(greater, 4).select("instance_id", "ord", (F.round("score", 5) + 0.0).alias("score"))


@q("mt_prototype_learn", f"""WITH {SPLIT}, {proto_sql('mean')}, pt AS (SELECT label AS instance_id, feature, value FROM p), pc AS (SELECT DISTINCT label AS instance_id, label FROM p), at0 AS (SELECT DISTINCT instance_id, 'all' AS node FROM te),
{nodes_sql([("all", x, x) for x in ORDER], 'na_', train='pt', classes='pc')}, found AS (SELECT instance_id, branch AS label FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY round(score, 9) DESC, branch) AS rn FROM na_nb) WHERE rn = 1) {GOLD_COUNTS}""", once=True)
def _(t):
    """Naive Bayes trained on one mean prototype for each class."""
    train, classes, test = parts(t)
    protos = t.stored(pr.prototypes(train, classes, "mean"))
    own = protos.select(F.col("label").alias("instance_id"), "feature", "value")
    labels = protos.select(F.col("label").alias("instance_id"), "label").distinct()
    at = test.select("instance_id").distinct().withColumn("node", F.lit("all"))
    scores = cf.nb_nodes(own, labels, t.spark.createDataFrame([("all", x, x) for x in ORDER], "node string, label string, branch string"), test, at)
    return gold_counts(t, ev.highest(scores.withColumnRenamed("branch", "label"), ["instance_id"]).select("instance_id", "label"))


@q("mt_ordinal", "WITH c AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1), o(label, ord) AS (VALUES ('de', 0), ('en', 1), ('es', 2), ('fr', 3)) SELECT CAST(ord AS INTEGER) AS task, CAST(sum(n) OVER (ORDER BY ord) AS BIGINT) AS negative, CAST(sum(n) OVER () - sum(n) OVER (ORDER BY ord) AS BIGINT) AS positive FROM c JOIN o USING (label) QUALIFY sum(n) OVER () - sum(n) OVER (ORDER BY ord) > 0")
def _(t):
    order = t.spark.createDataFrame([("de", 0), ("en", 1), ("es", 2), ("fr", 3)], "label string, ord int")
    return mt.ordinal_counts(t.langs().groupBy("label").agg(F.count("*").alias("n")), order)


@q("mt_ordinal_scores", "WITH p AS (SELECT doc_id AS instance_id, o, CAST(('0x' || substr(md5(concat_ws('|', 'o', doc_id, o)), 1, 4)) AS BIGINT) / 65536.0 AS p FROM documents, (SELECT unnest([0, 1, 2]) AS o)), s AS (SELECT instance_id, max(p) FILTER (WHERE o = 0) AS a, max(p) FILTER (WHERE o = 1) AS b, max(p) FILTER (WHERE o = 2) AS c FROM p GROUP BY 1) SELECT instance_id, unnest([0, 1, 2, 3])::INTEGER AS ord, round(unnest([1 - a, a - b, b - c, c]), 9)::DOUBLE AS score FROM s")
def _(t):
    rows = t.instances().select("instance_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("ord"))
    p = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("o"), F.col("instance_id").cast("string"), F.col("ord").cast("string"))), 1, 4), 16, 10).cast("double") / 65536
    return mt.ordinal_scores(rows.withColumn("p", p), 4).select("instance_id", "ord", R("score", 9))


@q("mt_prototype", f"WITH {SPLIT}, {proto_sql('sum')} SELECT label, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM p GROUP BY 1")
def _(t):
    train, classes, _ = parts(t)
    return pr.prototypes(train, classes, "sum").groupBy("label").agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("total"))


def entropy_term(n: str, of: str) -> str:
    return f"CASE WHEN {n} > 0 THEN -({n} / ({of})) * ln({n} / ({of})) ELSE 0 END"


#: gains of words over the training part, and the 500 highest
BEST_500 = f"""gn AS (SELECT sum(n_c) AS n FROM nc), fl AS (SELECT feature, label, count(*) AS a FROM tr JOIN cm USING (instance_id) GROUP BY ALL), nf AS (SELECT feature, sum(a) AS nf FROM fl GROUP BY 1), grid AS (SELECT nf.feature, nf, nc.label, n_c, n, coalesce(a, 0) AS a FROM nf CROSS JOIN nc CROSS JOIN gn LEFT JOIN fl ON fl.feature = nf.feature AND fl.label = nc.label),
gain AS (SELECT feature, sum({entropy_term("n_c", "n")}) - (max(nf) * sum({entropy_term("a", "nf")}) + max(n - nf) * sum({entropy_term("(n_c - a)", "n - nf")})) / max(n) AS w FROM grid GROUP BY 1), best500 AS (SELECT feature FROM gain ORDER BY round(w, 9) DESC, feature LIMIT 500)"""


@q("mt_weighted", f"WITH {SPLIT}, {BEST_500}, tr2 AS (SELECT * FROM tr SEMI JOIN best500 USING (feature)), te2 AS (SELECT * FROM te SEMI JOIN best500 USING (feature)), at0 AS (SELECT DISTINCT instance_id, 'all' AS node FROM te2), {nodes_sql([('all', x, x) for x in ('de', 'en', 'es', 'fr')], 'wg_', train='tr2', test='te2')}, found AS (SELECT instance_id, branch AS label FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY round(score, 9) DESC, branch) AS rn FROM wg_nb) WHERE rn = 1) SELECT lang AS gold, label, count(*) AS n FROM found JOIN documents ON doc_id = instance_id GROUP BY ALL", once=True)
def _(t):
    """The 500 features of highest gain, naive Bayes on them: right and wrong by class."""
    train, classes, test = parts(t)
    kept = wt.highest_n(wt.info_gain(train, classes, classes.select("instance_id")), 500)
    model = cf.nb_model(wt.select(train, F.broadcast(kept)), classes)
    best = ev.highest(cf.nb_predict(model, wt.select(test, F.broadcast(kept))), ["instance_id"])
    return best.join(t.langs().withColumnRenamed("label", "gold"), "instance_id").groupBy("gold", "label").agg(F.count("*").alias("n"))


def share_sql(pre: str, name: str) -> str:
    return f"{pre}sh AS (SELECT instance_id, '{name}:' || label AS feature, e / sum(e) OVER (PARTITION BY fold, instance_id) AS value FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY fold, instance_id)) AS e FROM {pre}nb))"


@q("mt_stacking", f"WITH {FB}, {folds_sql()}, {LANG}, {nb_cte(pre='m')}, {nb_cte(cell='1', pre='o')}, {share_sql('m', 'multinomial')}, {share_sql('o', 'boolean')}, st AS (SELECT * FROM msh UNION ALL SELECT * FROM osh), {nb_cte('st', pre='z')}, {best_sql('znb')} SELECT lang AS gold, label, count(*) AS n FROM best JOIN documents ON doc_id = instance_id GROUP BY ALL", once=True)
def _(t):
    """Out-of-fold scores of two learners are the features of a third, cross-validated on the same folds."""
    b, langs, folds = t.stored(t.bigrams()), t.langs(), t.stored(t.folds())
    shares = {name: cf.probabilities(cf.naive_bayes_cv(b, langs, folds, boolean), ["fold", "instance_id"]) for name, boolean in (("multinomial", False), ("boolean", True))}
    stacked = t.stored(mt.stacked_features(shares))
    return gold_counts(t, ev.highest(cf.naive_bayes_cv(stacked, langs, folds), ["fold", "instance_id"]))


@q("mt_feature_stacking", f"WITH {nb_sql()} SELECT instance_id, 'nb:' || label AS feature, round(score, 4) AS value FROM nb")
def _(t):
    return mt.stacked_features({"nb": naive_bayes(t)}).select("instance_id", "feature", R("value", 4))
