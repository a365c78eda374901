"""Queries over feature weights, selection and transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import weights as wt
from .base import FB, FW, LANG, ML, TT, folds_sql, q
from .split_queries import DOMAINS, domain

R = lambda c, n=6: F.round(c, n).alias(c)


def weighted(df):
    return df.select(*[c for c in df.columns if c != "weight"], R("weight"))


TRAIN = f"{FB}, {TT}, tr AS (SELECT b.* FROM b JOIN tt USING (instance_id) WHERE role = 'train'), inst AS (SELECT instance_id FROM tt WHERE role = 'train'), cm AS (SELECT doc_id AS instance_id, lang AS label FROM documents WHERE doc_id IN (SELECT instance_id FROM inst))"


def train(t):
    b = t.stored(wt.of_role(t.bigrams(), t.train_test(), "train").drop("fold"))
    inst = t.train_test().where("role = 'train'").select("instance_id")
    return b, t.langs().join(inst, "instance_id", "left_semi"), inst


def gain_sql(bands: str, ctes: str = "", base: str = "") -> str:
    """`bands`: query of (instance_id, feature, band) with band > 0."""
    return f"""
    WITH {TRAIN}{ctes}, r AS ({bands}), nall AS (SELECT count(*) AS n FROM inst), c AS (SELECT label, count(*) AS n_c FROM cm GROUP BY 1), m AS (SELECT sum(n_c) AS m FROM c),
    cells AS (SELECT feature, band, label, count(*) AS n FROM r JOIN cm USING (instance_id) GROUP BY ALL), held AS (SELECT feature, band, count(*) AS nb FROM r GROUP BY ALL),
    fs AS (SELECT DISTINCT feature FROM tr),
    zero AS (SELECT feature, 0 AS band, c.label, n_c - coalesce((SELECT sum(n) FROM cells x WHERE x.feature = fs.feature AND x.label = c.label), 0) AS n FROM fs, c),
    zheld AS (SELECT feature, 0 AS band, (SELECT n FROM nall) - coalesce((SELECT sum(nb) FROM held x WHERE x.feature = fs.feature), 0) AS nb FROM fs),
    al AS (SELECT * FROM cells UNION ALL SELECT * FROM zero), am AS (SELECT *, sum(n) OVER (PARTITION BY feature, band) AS m FROM al),
    h AS (SELECT feature, band, sum(CASE WHEN n > 0 THEN -(n / m) * ln(n / m) ELSE 0 END) AS h FROM am GROUP BY ALL),
    ins AS (SELECT feature, sum(nb / (SELECT n FROM nall) * h) AS i FROM h JOIN (SELECT * FROM held UNION ALL SELECT * FROM zheld) USING (feature, band) GROUP BY 1)
    SELECT feature, round(((SELECT sum(CASE WHEN n_c > 0 THEN -(n_c / m.m) * ln(n_c / m.m) ELSE 0 END) FROM c, m) - i){base}, 6) AS weight FROM ins"""


@q("w_tf", f"WITH {FW} SELECT feature, CAST(sum(value) AS DOUBLE) AS weight FROM f GROUP BY 1")
def _(t):
    return wt.term_frequency(t.words())


@q("w_df", f"WITH {FW} SELECT feature, CAST(count(*) FILTER (WHERE value > 1) AS DOUBLE) AS weight FROM f GROUP BY 1")
def _(t):
    return wt.document_frequency(t.words(), 1)


@q("w_preset", f"WITH {FW} SELECT DISTINCT feature, CASE feature WHEN 'the' THEN 2.5 WHEN 'der' THEN 1.0 ELSE 0.0 END::DOUBLE AS weight FROM f")
def _(t):
    return wt.preset(t.words(), F.broadcast(t.spark.createDataFrame([("the", 2.5), ("der", 1.0)], "feature string, w double")))


@q("w_cavnar_trenkle", f"WITH {FB}, {LANG}, s AS (SELECT label, feature, sum(value) AS n FROM b JOIN cm USING (instance_id) GROUP BY ALL), r AS (SELECT feature, row_number() OVER (PARTITION BY label ORDER BY n DESC, feature) - 1 AS r FROM s) SELECT feature, CAST(min(r) AS DOUBLE) AS weight FROM r GROUP BY 1")
def _(t):
    return wt.cavnar_trenkle(t.bigrams(), t.langs())


@q("w_infogain", gain_sql("SELECT instance_id, feature, 1 AS band FROM tr"))
def _(t):
    return weighted(wt.info_gain(*train(t)))


@q("w_infogain_log2", gain_sql("SELECT instance_id, feature, 1 AS band FROM tr", base=" / ln(2)"))
def _(t):
    return weighted(wt.info_gain(*train(t), base=2))


@q("w_infogain_uniform", gain_sql("SELECT instance_id, feature, CAST(floor(value * 5 / (top + 1)) AS INTEGER) AS band FROM tr JOIN (SELECT feature, max(value) AS top FROM tr GROUP BY 1) USING (feature) WHERE floor(value * 5 / (top + 1)) > 0"))
def _(t):
    return weighted(wt.info_gain(*train(t), bands="uniform"))


@q("w_infogain_equisize", gain_sql("SELECT instance_id, feature, CAST(floor(((SELECT count(*) FROM inst) - n + p - 1) * 5 / (SELECT count(*) FROM inst)) AS INTEGER) AS band FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value, instance_id) AS p, count(*) OVER (PARTITION BY feature) AS n FROM tr) WHERE floor(((SELECT count(*) FROM inst) - n + p - 1) * 5 / (SELECT count(*) FROM inst)) > 0"))
def _(t):
    return weighted(wt.info_gain(*train(t), bands="equisize"))


def ent(*terms) -> str:
    return " + ".join(f"(CASE WHEN {n} > 0 AND {m} > 0 THEN -({n} / {m}) * ln({n} / {m}) ELSE 0 END)" for n, m in terms)


LD_BASE = f"{FB}, {folds_sql(4)}, {LANG}, dm AS (SELECT doc_id AS instance_id, {DOMAINS} AS label FROM documents), ks AS (SELECT unnest([0, 1, 2, 3]) AS fold)"
TRAINED = """{p}c AS (SELECT k.fold, label, count(*) FILTER (WHERE test_fold <> k.fold) AS n_c FROM {cm} JOIN folds USING (instance_id), ks k GROUP BY ALL),
{p}n AS (SELECT fold, sum(n_c) AS n FROM {p}c GROUP BY 1), {p}x AS (SELECT k.fold, label, feature, count(*) FILTER (WHERE test_fold <> k.fold) AS n_fc FROM b JOIN {cm} USING (instance_id) JOIN folds USING (instance_id), ks k GROUP BY ALL HAVING count(*) FILTER (WHERE test_fold <> k.fold) > 0),
{p}f AS (SELECT fold, feature, sum(n_fc) AS n_f FROM {p}x GROUP BY ALL)"""
CLASS_GAIN = f"cg AS (SELECT x.fold, x.label, x.feature, ({ent(('n_c', 'n'), ('(n - n_c)', 'n'))}) - (n_f * ({ent(('n_fc', 'n_f'), ('(n_f - n_fc)', 'n_f'))}) + (n - n_f) * ({ent(('(n_c - n_fc)', '(n - n_f)'), ('((n - n_f) - (n_c - n_fc))', '(n - n_f)'))})) / n AS g FROM lx x JOIN lc USING (fold, label) JOIN ln_ USING (fold) JOIN lf USING (fold, feature))".replace("ln_", "lnn")
DOMAIN_GAIN = f"dg AS (SELECT fold, feature, max(h0) - (max(n_f) * sum({ent(('coalesce(n_fc, 0)', 'n_f'))}) + (max(n) - max(n_f)) * sum({ent(('(n_c - coalesce(n_fc, 0))', '(n - n_f)'))})) / max(n) AS g FROM df JOIN dc USING (fold) JOIN dn USING (fold) JOIN (SELECT fold, sum({ent(('n_c', 'n'))}) AS h0 FROM dc JOIN dn USING (fold) GROUP BY 1) USING (fold) LEFT JOIN dx USING (fold, feature, label) GROUP BY ALL)"
LCTES = TRAINED.format(p="l", cm="cm").replace("ln AS (SELECT fold, sum", "lnn AS (SELECT fold, sum")
DCTES = TRAINED.format(p="d", cm="dm")


def rank_min(value: str, source: str) -> str:
    return f"v AS (SELECT {value} AS v, fold, label, feature FROM {source}), rk AS (SELECT fold, feature, row_number() OVER (PARTITION BY fold, label ORDER BY v DESC, feature) - 1 AS r FROM v) SELECT fold, feature, CAST(min(r) AS DOUBLE) AS weight FROM rk GROUP BY ALL"


@q("w_langdomain")
def _(t):
    """Rows only: ranks depend on the ninth digit of differences of logarithms (see tests for a brute-force check)."""
    d = t.documents.select(F.col("doc_id").alias("instance_id"), domain().alias("label"))
    return wt.lang_domain(t.stored(t.bigrams()), t.langs(), d, t.folds(4))


@q("w_local_ig")
def _(t):
    return wt.lang_domain(t.stored(t.bigrams()), t.langs(), None, t.folds(4), with_domain=False)


@q("w_domain_gain", f"WITH {LD_BASE}, {DCTES}, {DOMAIN_GAIN} SELECT CAST(fold AS INTEGER) AS fold, feature, round(g, 6) AS weight FROM dg")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("instance_id"), domain().alias("label"))
    return weighted(wt.presence_gain(t.stored(t.bigrams()), d, t.folds(4)))


@q("w_class_gain", f"WITH {LD_BASE}, {LCTES}, {CLASS_GAIN} SELECT CAST(fold AS INTEGER) AS fold, label, feature, round(g, 6) AS weight FROM cg")
def _(t):
    return weighted(wt.presence_gain(t.stored(t.bigrams()), t.langs(), t.folds(4), one_vs_rest=True))


TFW = f"WITH {FW}, wt AS (SELECT feature, CAST(sum(value) AS DOUBLE) AS weight FROM f GROUP BY 1), rk AS (SELECT *, row_number() OVER (ORDER BY weight DESC, feature) AS rn FROM wt)"


@q("w_rank", TFW + " SELECT feature, weight, rn - 1 AS rank FROM rk")
def _(t):
    return wt.rank(wt.term_frequency(t.words()))


@q("w_top_bottom", TFW + " SELECT feature, weight FROM rk WHERE rn <= 25")
def _(t):
    return wt.term_frequency(t.words()).orderBy(F.desc("weight"), "feature").limit(25)


@q("keep_highest_n", TFW + " SELECT feature FROM rk WHERE rn <= 300")
def _(t):
    return wt.highest_n(wt.term_frequency(t.words()), 300)


@q("keep_exceeds", TFW + " SELECT feature FROM wt WHERE weight >= 10")
def _(t):
    return wt.at_least(wt.term_frequency(t.words()), 10)


@q("keep_less_than", TFW + " SELECT feature FROM wt WHERE weight < 3")
def _(t):
    return wt.less_than(wt.term_frequency(t.words()), 3)


@q("keep_nonzero", f"WITH {FW} SELECT feature FROM f GROUP BY 1 HAVING count(*) FILTER (WHERE value > 1) > 0")
def _(t):
    return wt.nonzero(wt.document_frequency(t.words(), 1))


SELECTED = f"{FW}, {TT}, wt AS (SELECT feature, sum(value) AS weight FROM f JOIN tt USING (instance_id) WHERE role = 'train' GROUP BY 1), kept AS (SELECT feature FROM wt ORDER BY weight DESC, feature LIMIT 300)"


@q("fs_select", f"WITH {SELECTED} SELECT role, instance_id, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM f JOIN kept USING (feature) JOIN tt USING (instance_id) GROUP BY ALL")
def _(t):
    w, split = t.words(), t.train_test()
    kept = wt.highest_n(wt.term_frequency(wt.of_role(w, split, "train")), 300)
    return wt.select(w, F.broadcast(kept)).join(split, "instance_id").groupBy("role", "instance_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@q("fs_increment", TFW + " SELECT CAST(fold AS INTEGER) AS fold, feature FROM rk, (VALUES (0, 10), (1, 100), (2, 1000)) s(fold, n) WHERE rn <= n")
def _(t):
    return wt.feature_increment(wt.term_frequency(t.words()), [10, 100, 1000])


@q("ft_tfidf", f"WITH {FW}, d AS (SELECT instance_id, sum(value) AS t FROM f GROUP BY 1), n AS (SELECT feature, count(*) AS df FROM f GROUP BY 1) SELECT instance_id, feature, round(value / t / df, 9) AS value FROM f JOIN d USING (instance_id) JOIN n USING (feature)")
def _(t):
    return wt.tfidf(t.words()).select("instance_id", "feature", R("value", 9))


DFW = f"WITH {FW}, wt AS (SELECT feature, CAST(count(*) FILTER (WHERE value > 1) AS DOUBLE) AS weight FROM f GROUP BY 1)"


@q("ft_weighted", DFW + " SELECT instance_id, feature, value * weight AS value FROM f JOIN wt USING (feature) WHERE weight <> 0")
def _(t):
    w = t.words()
    return wt.apply_weights(w, wt.document_frequency(w, 1))


@q("ft_binary_weighted", DFW + " SELECT instance_id, feature, weight AS value FROM f JOIN wt USING (feature) WHERE weight <> 0")
def _(t):
    w = t.words()
    return wt.apply_weights(w, wt.document_frequency(w, 1), binary=True)


@q("ft_cutoff_weighted", DFW + " SELECT instance_id, feature, value * weight AS value FROM f JOIN wt USING (feature) WHERE weight <> 0 AND value >= 2")
def _(t):
    w = t.words()
    return wt.apply_weights(w, wt.document_frequency(w, 1), cutoff=2)


@q("ft_discretize", f"WITH {FW} SELECT instance_id, feature, CAST(trunc(value * 0.4) AS BIGINT) AS value FROM f WHERE trunc(value * 0.4) <> 0")
def _(t):
    return wt.discretize(t.words(), 0.4)
