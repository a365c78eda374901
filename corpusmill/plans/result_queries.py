"""Queries over sequences, results, metrics, comparisons and metadata.

Two results are made from the documents' languages: where a hash says so, the prediction is wrong.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import special
from ..operators import classify as cf
from ..operators import evaluate as ev
from ..operators import metadata as md
from ..operators import runs as rn
from ..operators import sequences as sq
from .base import q

R = lambda c, n=6: F.round(c, n).alias(c)
FOLD = "CAST(doc_id % 5 AS INTEGER)"


def gold(t):
    return t.documents.select((F.col("doc_id") % 5).cast("int").alias("fold"), F.col("doc_id").alias("instance_id"), F.col("lang").alias("label"))


def predicted(t, seed):
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("doc_id").cast("string"))), 1, 1)
    label = F.when(h < "3", "en").when(h < "4", "fr").otherwise(F.col("lang"))
    return t.documents.select((F.col("doc_id") % 5).cast("int").alias("fold"), F.col("doc_id").alias("instance_id"), label.alias("label"))


def pred_sql(seed: str) -> str:
    h = f"substr(md5('{seed}|' || doc_id), 1, 1)"
    return f"p{seed} AS (SELECT {FOLD} AS fold, doc_id AS instance_id, CASE WHEN {h} < '3' THEN 'en' WHEN {h} < '4' THEN 'fr' ELSE lang END AS label FROM documents)"


BASE = f"g AS (SELECT {FOLD} AS fold, doc_id AS instance_id, lang AS label FROM documents), {pred_sql('a')}, {pred_sql('b')}, sp AS (SELECT DISTINCT label FROM g), fo AS (SELECT DISTINCT fold FROM g)"
CONF = f"{BASE}, c AS (SELECT fo.fold, sp.label, count(*) FILTER (WHERE g.label = sp.label AND pa.label = sp.label) AS tp, count(*) FILTER (WHERE g.label <> sp.label AND pa.label = sp.label) AS fp, count(*) FILTER (WHERE g.label = sp.label AND pa.label <> sp.label) AS fn, count(*) FILTER (WHERE g.label <> sp.label AND pa.label <> sp.label) AS tn FROM fo JOIN g USING (fold) JOIN pa USING (instance_id), sp GROUP BY ALL)"
METRICS = "CASE WHEN tp + fn = 0 THEN NULL WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN NULL ELSE tp / (tp + fn) END AS recall, CASE WHEN tp + fn = 0 THEN NULL WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fn + fp) END AS fscore"
ROUNDED = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(fscore, 6) AS fscore"
SUMS = "CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn"


def conf(t, seed="a"):
    g = gold(t)
    return ev.confusion(g, predicted(t, seed), g.select("fold", "instance_id"), g.select("label").distinct())


def three(df, *keys):
    return df.select(*keys, R("precision"), R("recall"), R("fscore"))


# ---- sequences


def threads(t):
    name = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return t.conversations.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("pos"), name.alias("instance_id"))


THREADS = "th AS (SELECT conv_id AS thread_id, turn AS pos, conv_id || '-' || turn AS instance_id, role FROM conversations), many AS (SELECT thread_id FROM th GROUP BY 1 HAVING count(*) > 1)"
EDGES = f"{THREADS}, e AS (SELECT * FROM (SELECT instance_id AS parent, lead(instance_id) OVER (PARTITION BY thread_id ORDER BY pos) AS child FROM th WHERE thread_id IN (SELECT thread_id FROM many)) WHERE child IS NOT NULL)"


def edges(t):
    rows = threads(t)
    many = rows.groupBy("thread_id").count().where("count > 1")
    return sq.to_edges(rows.join(many, "thread_id", "left_semi"))


@q("sq_to_edges", f"WITH {EDGES} SELECT * FROM e")
def _(t):
    return edges(t)


@q("sq_from_edges", f"WITH {THREADS} SELECT first(instance_id) OVER (PARTITION BY thread_id ORDER BY pos) AS root, row_number() OVER (PARTITION BY thread_id ORDER BY pos) - 1 AS pos, instance_id FROM th WHERE thread_id IN (SELECT thread_id FROM many)")
def _(t):
    t.checkpointing()
    return sq.to_threads(edges(t))


@q("sq_toposort", f"WITH {THREADS} SELECT instance_id, CAST(row_number() OVER (PARTITION BY thread_id ORDER BY pos) - 1 AS INTEGER) AS level FROM th WHERE thread_id IN (SELECT thread_id FROM many)")
def _(t):
    t.checkpointing()
    return sq.topological_levels(edges(t))


SKIPS = "sk AS (SELECT parent, child FROM e UNION SELECT * FROM (SELECT instance_id AS parent, lead(instance_id, 2) OVER (PARTITION BY thread_id ORDER BY pos) AS child FROM th) WHERE child IS NOT NULL AND substr(md5('skip|' || parent), 1, 1) < '8')"


def skipping(t):
    """Threads in which half of the turns also follow the turn before the last."""
    w = Window.partitionBy("thread_id").orderBy("pos")
    more = threads(t).select(F.col("instance_id").alias("parent"), F.lead("instance_id", 2).over(w).alias("child")).where("child IS NOT NULL")
    return edges(t).union(more.where(F.substring(F.md5(F.concat(F.lit("skip|"), "parent")), 1, 1) < "8"))


@q("sq_toposort_graph", f"WITH RECURSIVE {EDGES}, {SKIPS}, ways AS (SELECT instance_id, 0 AS level FROM th WHERE thread_id IN (SELECT thread_id FROM many) AND instance_id NOT IN (SELECT child FROM sk) UNION SELECT child, level + 1 FROM ways JOIN sk ON parent = instance_id) SELECT instance_id, CAST(max(level) AS INTEGER) AS level FROM ways GROUP BY 1")
def _(t):
    """Longest ways in a graph that branches and joins."""
    return sq.topological_levels(skipping(t))


@q("sq_slice", f"WITH {EDGES}, k AS (SELECT instance_id FROM th WHERE substr(md5('slice|' || instance_id), 1, 1) < 'c') SELECT * FROM e WHERE parent IN (SELECT instance_id FROM k) AND child IN (SELECT instance_id FROM k)")
def _(t):
    kept = threads(t).where(F.substring(F.md5(F.concat(F.lit("slice|"), "instance_id")), 1, 1) < "c").select("instance_id")
    return sq.slice_edges(edges(t), kept)


@q("sq_markov_features", f"WITH {THREADS}, x AS (SELECT instance_id, lag(role) OVER w AS a, lag(role, 2) OVER w AS b FROM th WINDOW w AS (PARTITION BY thread_id ORDER BY pos)) SELECT instance_id, 'prev1:' || coalesce(a, 'START') AS feature, CAST(1 AS BIGINT) AS value FROM x UNION ALL SELECT instance_id, 'prev2:' || coalesce(b, 'START'), 1 FROM x")
def _(t):
    name = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    labels = t.conversations.select(name.alias("instance_id"), F.col("role").alias("label"))
    return sq.markov_features(threads(t), labels, 2)


SIZES = "fs AS (SELECT conv_id || '-' || turn AS instance_id, 'size' || length(CAST(length(coalesce(text, '')) AS VARCHAR)) AS feature, 1 AS value FROM conversations)"


def sizes(t):
    """One feature of a turn: how many digits its length has."""
    name = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    size = F.concat(F.lit("size"), F.length(F.length(F.coalesce("text", F.lit(""))).cast("string")).cast("string"))
    return t.conversations.select(name.alias("instance_id"), size.alias("feature"), F.lit(1).cast("long").alias("value"))


def turns(t):
    name = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return t.conversations.select("conv_id", name.alias("instance_id"), F.col("role").alias("label"))


@q("sq_markov_graph", f"WITH {EDGES}, {SKIPS}, {SIZES}, up1 AS (SELECT child AS instance_id, parent AS b FROM sk), up2 AS (SELECT DISTINCT x.instance_id, y.b FROM up1 x JOIN up1 y ON y.instance_id = x.b), rl AS (SELECT instance_id, role FROM th) SELECT instance_id, 'own:' || feature AS feature, CAST(value AS BIGINT) AS value FROM fs UNION ALL SELECT u.instance_id, 'above:' || feature, CAST(sum(value) AS BIGINT) FROM up1 u JOIN fs ON fs.instance_id = b GROUP BY 1, 2 UNION ALL SELECT u.instance_id, 'prev1:' || role, count(*) FROM up1 u JOIN rl ON rl.instance_id = b GROUP BY 1, 2 UNION ALL SELECT u.instance_id, 'prev2:' || role, count(*) FROM up2 u JOIN rl ON rl.instance_id = b GROUP BY 1, 2 UNION ALL SELECT instance_id, 'prev1:START', 1 FROM th WHERE instance_id NOT IN (SELECT instance_id FROM up1) UNION ALL SELECT instance_id, 'prev2:START', 1 FROM th WHERE instance_id NOT IN (SELECT instance_id FROM up2)")
def _(t):
    """Training side: own and predecessors' features, and gold classes one and two steps before."""
    every = turns(t)
    return sq.graph_markov_features(sizes(t), skipping(t), every.select("instance_id", "label"), every, 2)


@q("sq_markov_classify")
def _(t):
    """Roles of every fifth conversation's turns, by naive Bayes with the predicted roles before them; learned from the others."""
    every, features, graph = turns(t), t.stored(sizes(t)), t.stored(skipping(t))
    train, test = every.where("conv_id % 5 > 0"), every.where("conv_id % 5 = 0")
    gold = train.select("instance_id", "label")
    model = [t.stored(x) for x in cf.nb_model(sq.graph_markov_features(features, sq.slice_edges(graph, train), gold, train, 2), gold)]
    found = sq.markov_classify(features, graph, test, lambda rows: ev.highest(cf.nb_predict(tuple(model), rows), ["instance_id"]), 2)
    return found.join(test.select("instance_id", F.col("label").alias("gold")), "instance_id").groupBy("gold", "label").agg(F.count("*").alias("n"))


DECODE = """WITH RECURSIVE n AS (SELECT conv_id, conv_id || '-' || turn AS instance_id, length(coalesce(text, '')) / 200 AS a, 1 - length(coalesce(text, '')) / 200 AS u, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
d AS (SELECT conv_id, rn, instance_id, CASE WHEN a >= u + 1 THEN 'assistant' ELSE 'user' END AS label FROM n WHERE rn = 1
UNION ALL SELECT n.conv_id, n.rn, n.instance_id, CASE WHEN a + CASE WHEN label = 'user' THEN 1 ELSE 0 END >= u + CASE WHEN label = 'assistant' THEN 1 ELSE 0 END THEN 'assistant' ELSE 'user' END FROM d JOIN n ON n.conv_id = d.conv_id AND n.rn = d.rn + 1)
SELECT instance_id, label FROM d"""


@q("sq_markov_decode", DECODE)
def _(t):
    """Roles of turns from text length and the role before, decided turn by turn."""
    roles = ["assistant", "user"]
    score = F.when(F.col("label") == "assistant", F.length("text") / 200).otherwise(1 - F.length("text") / 200)
    name = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = t.conversations.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("pos"), name.alias("instance_id"), F.coalesce("text", F.lit("")).alias("text"), F.explode(F.array(*[F.lit(r) for r in roles])).alias("label"))
    steps = {("START", "user"): 1.0, ("user", "assistant"): 1.0, ("assistant", "user"): 1.0}
    return sq.markov_decode(rows.select("thread_id", "pos", "instance_id", "label", score.alias("score")), steps, roles)


# ---- interpretation, confusion, metrics


SCORES = "s AS (SELECT doc_id AS instance_id, label, CAST(('0x' || substr(md5(concat_ws('|', 's', doc_id, label)), 1, 4)) AS BIGINT) / 65536.0 AS score FROM documents, (SELECT DISTINCT lang AS label FROM documents))"


def scores(t):
    rows = t.instances().select("instance_id", F.explode(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])).alias("label"))
    return rows.withColumn("score", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("s"), F.col("instance_id").cast("string"), "label")), 1, 4), 16, 10).cast("double") / 65536)


@q("it_lowest", f"WITH {SCORES} SELECT instance_id, label FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY score, label) AS rn FROM s) WHERE rn = 1")
def _(t):
    return ev.highest(scores(t), ["instance_id"], descending=False)


@q("it_nonzero", f"WITH {SCORES} SELECT instance_id, label FROM s WHERE score - 0.5 > 0")
def _(t):
    return ev.nonzero(scores(t).withColumn("score", F.col("score") - 0.5), ["instance_id"])


@q("rs_confusion", f"WITH {CONF} SELECT * FROM c")
def _(t):
    return conf(t)


MATRIX = f"{BASE}, m AS (SELECT g.label AS gold, pa.label AS pred, count(*) AS n FROM g JOIN pa USING (instance_id) WHERE EXISTS (SELECT 1 FROM pa x WHERE x.fold = g.fold AND x.label = g.label) AND EXISTS (SELECT 1 FROM g x WHERE x.fold = pa.fold AND x.label = pa.label) GROUP BY ALL)"


def matrix(t):
    return ev.class_matrix(gold(t), predicted(t, "a"))


@q("rs_class_matrix", f"WITH {MATRIX} SELECT * FROM m")
def _(t):
    return matrix(t)


@q("rs_classpairs", f"WITH {BASE}, n AS (SELECT g.label AS gold, pa.label AS pred, instance_id, row_number() OVER (PARTITION BY g.label, pa.label ORDER BY instance_id) AS rn FROM g JOIN pa USING (instance_id)) SELECT gold, pred, CAST(floor((rn - 1) / 100) AS INTEGER) AS part, count(*) AS n, md5(string_agg(instance_id::VARCHAR, ',' ORDER BY instance_id)) AS digest FROM n GROUP BY ALL")
def _(t):
    """Lists of a hundred instances at most."""
    pairs = ev.pair_lists(gold(t), predicted(t, "a"), 100)
    return pairs.select("gold", "pred", "part", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).alias("digest"))


@q("rs_pair_list", f"WITH {MATRIX} SELECT gold, pred, n, CAST(sum(n) OVER (PARTITION BY gold) AS BIGINT) AS gold_errors, CAST(sum(n) OVER (PARTITION BY pred) AS BIGINT) AS pred_errors FROM m WHERE gold <> pred")
def _(t):
    off = matrix(t).where("gold <> pred")
    total = lambda c: F.sum("n").over(Window.partitionBy(c)).cast("long")
    return off.select("gold", "pred", "n", total("gold").alias("gold_errors"), total("pred").alias("pred_errors"))


@q("rs_matrix_threshold", f"WITH {MATRIX}, k AS (SELECT gold AS label FROM m WHERE gold <> pred AND n >= 20 UNION SELECT pred FROM m WHERE gold <> pred AND n >= 20) SELECT * FROM m WHERE gold IN (SELECT label FROM k) AND pred IN (SELECT label FROM k)")
def _(t):
    m = matrix(t)
    keep = m.where("gold <> pred AND n >= 20").select(F.explode(F.array("gold", "pred")).alias("label")).distinct()
    return m.join(keep.toDF("gold"), "gold", "left_semi").join(keep.toDF("pred"), "pred", "left_semi").select("gold", "pred", "n")


@q("rs_classpair_docs", f"WITH {BASE} SELECT instance_id, n_chars FROM g JOIN pa USING (instance_id) JOIN documents ON doc_id = instance_id WHERE g.label = 'en' AND pa.label = 'fr'")
def _(t):
    pairs = ev.class_pairs(gold(t), predicted(t, "a")).where("gold = 'en' AND pred = 'fr'").select("instance_id")
    return t.documents.select(F.col("doc_id").alias("instance_id"), "n_chars").join(pairs, "instance_id", "left_semi")


@q("rs_correct", f"WITH {BASE} SELECT g.fold, instance_id, g.label = pa.label AS correct FROM g JOIN pa USING (instance_id)")
def _(t):
    g = gold(t)
    return ev.correct(g, predicted(t, "a"), g.select("fold", "instance_id"))


@q("rs_overall", f"WITH {SCORES} SELECT instance_id, label, round(sum(score), 6) AS score FROM (SELECT * FROM s UNION ALL SELECT instance_id, label, score FROM s WHERE label < 'es') GROUP BY ALL")
def _(t):
    s = scores(t)
    return ev.overall(s.unionByName(s.where("label < 'es'"))).select("instance_id", "label", R("score"))


RMETA = f"{BASE}, u AS (SELECT 'a' AS result_id, pa.* FROM pa UNION ALL SELECT 'b', pb.* FROM pb), rm AS (SELECT result_id, unnest(['instances', 'folds', 'right']) AS key, unnest([count(*)::VARCHAR, count(DISTINCT u.fold)::VARCHAR, count(*) FILTER (WHERE u.label = g.label)::VARCHAR]) AS value FROM u JOIN g USING (instance_id) GROUP BY result_id), same AS (SELECT key, min(value) AS value FROM rm GROUP BY 1 HAVING count(*) = 2 AND min(value) = max(value))"


def two_results(t):
    """Two results, and what is known about each: how many instances and folds, how many are right."""
    results = {k: predicted(t, k) for k in "ab"}
    out = None
    for k, rows in results.items():
        both = rows.join(gold(t).withColumnRenamed("label", "gold"), ["fold", "instance_id"])
        known = both.agg(F.count("*").alias("n"), F.countDistinct("fold").alias("f"), F.count(F.when(F.col("label") == F.col("gold"), 1)).alias("r"))
        entries = F.create_map(*[x for key, c in (("instances", "n"), ("folds", "f"), ("right", "r")) for x in (F.lit(key), F.col(c).cast("string"))])
        row = known.select(F.lit(k).alias("result_id"), entries.alias("meta"))
        out = row if out is None else out.unionByName(row)
    return results, out


@q("rs_vstack", f"WITH {RMETA} SELECT result_id, fold, count(*) AS n, (SELECT string_agg(key || '=' || value, ';' ORDER BY key) FROM same) AS shared FROM u GROUP BY ALL")
def _(t):
    """Two results one below the other, and the metadata that both have."""
    rows, same = ev.stacked(*two_results(t))
    shared = same.agg(F.array_join(F.array_sort(F.collect_list(F.concat("key", F.lit("="), "value"))), ";").alias("shared"))  # a few keys
    return rows.groupBy("result_id", "fold").agg(F.count("*").alias("n")).crossJoin(F.broadcast(shared))


@q("cmp_metadata", f"WITH {RMETA} SELECT key, result_id, value FROM rm WHERE key NOT IN (SELECT key FROM same)")
def _(t):
    """Where two results differ."""
    return md.differing(two_results(t)[1])


@q("rs_equal", f"WITH {BASE} SELECT (SELECT count(*) FROM (SELECT * FROM pa EXCEPT ALL SELECT * FROM pb)) AS only_a, (SELECT count(*) FROM (SELECT * FROM pb EXCEPT ALL SELECT * FROM pa)) AS only_b")
def _(t):
    a, b = predicted(t, "a"), predicted(t, "b")
    return a.exceptAll(b).agg(F.count("*").alias("only_a")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_b")))


@q("mx_precision_recall_fscore", f"WITH {CONF} SELECT fold, label, {METRICS.replace(' AS precision', ' AS pr').replace(' AS recall', ' AS re').replace(' AS fscore', ' AS fs')} FROM c".replace("SELECT fold, label,", "SELECT fold, label, round(pr, 6) AS precision, round(re, 6) AS recall, round(fs, 6) AS fscore FROM (SELECT fold, label,") + ")")
def _(t):
    c = [F.col(x) for x in ("tp", "fp", "fn")]
    return conf(t).select("fold", "label", F.round(ev.precision(*c), 6).alias("precision"), F.round(ev.recall(*c), 6).alias("recall"), F.round(ev.fscore(*c), 6).alias("fscore"))


@q("mx_prf", f"WITH {CONF} SELECT fold, label, round(CASE WHEN tp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fn + fp) END, 6) AS fscore FROM c")
def _(t):
    p, r, f = ev.prf(*[F.col(x) for x in ("tp", "fp", "fn")])
    return conf(t).select("fold", "label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("fscore"))


@q("mx_mcc", f"WITH {CONF}, x AS (SELECT label, {SUMS} FROM c GROUP BY 1), y AS (SELECT *, (tp::DOUBLE + fp) * (tp + fn) * (tn + fp) * (tn + fn) AS y FROM x) SELECT label, round(CASE WHEN y = 0 THEN NULL ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt(y) END, 6) AS mcc FROM y")
def _(t):
    rows = ev.summed(conf(t), ["label"])
    return rows.select("label", F.round(ev.mcc(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]), 6).alias("mcc"))


@q("mx_micro", f"WITH {CONF}, x AS (SELECT {SUMS} FROM c), y AS (SELECT {METRICS} FROM x) SELECT {ROUNDED} FROM y")
def _(t):
    return three(ev.micro(conf(t)))


@q("mx_macro", f"WITH {CONF}, x AS (SELECT label, {SUMS} FROM c GROUP BY 1), y AS (SELECT tp, fn, {METRICS} FROM x) SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(fscore), 6) AS fscore, count(*) FILTER (WHERE tp + fn = 0) AS n_ignored FROM y")
def _(t):
    return ev.macro(conf(t)).select(R("precision"), R("recall"), R("fscore"), "n_ignored")


@q("mx_class_prf", f"WITH {CONF}, x AS (SELECT label, {SUMS} FROM c WHERE label = 'fr' GROUP BY 1), y AS (SELECT label, {METRICS} FROM x) SELECT label, {ROUNDED} FROM y")
def _(t):
    return three(ev.micro(conf(t).where("label = 'fr'"), ("label",)), "label")


@q("mx_perfold", f"WITH {CONF}, x AS (SELECT fold, {SUMS} FROM c GROUP BY 1), y AS (SELECT fold, {METRICS} FROM x) SELECT fold, {ROUNDED} FROM y")
def _(t):
    return three(ev.micro(conf(t), ("fold",)), "fold")


@q("mx_perfold_box", f"WITH {CONF}, y AS (SELECT fold, {METRICS} FROM c WHERE label = 'en') SELECT round(min(fscore), 6) AS low, round(quantile_cont(fscore, 0.25), 6) AS q1, round(quantile_cont(fscore, 0.5), 6) AS median, round(quantile_cont(fscore, 0.75), 6) AS q3, round(max(fscore), 6) AS high, round(avg(fscore), 6) AS mean FROM y")
def _(t):
    f = conf(t).where("label = 'en'").select(ev.fscore(*[F.col(x) for x in ("tp", "fp", "fn")]).alias("f"))
    cols = [F.min("f").alias("low"), *[F.percentile("f", F.lit(p)).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))], F.max("f").alias("high"), F.avg("f").alias("mean")]
    return f.agg(*cols).select(*[R(c) for c in ("low", "q1", "median", "q3", "high", "mean")])


@q("mx_rms_mae", f"WITH {MATRIX}, o(label, k) AS (VALUES ('de', 0), ('en', 1), ('es', 2), ('fr', 3)) SELECT round(sqrt(sum(n * (a.k - b.k) * (a.k - b.k)) / sum(n)), 6) AS rms, round(sum(n * abs(a.k - b.k)) / sum(n), 6) AS mae FROM m JOIN o a ON a.label = gold JOIN o b ON b.label = pred")
def _(t):
    order = t.spark.createDataFrame([("de", 0), ("en", 1), ("es", 2), ("fr", 3)], "label string, ord int")
    return ev.ordinal_errors(matrix(t), order).select(R("rms"), R("mae"))


@q("mx_times", "SELECT CAST(user_id % 10 AS INTEGER) AS result_id, round(avg(learn), 6) AS avg_learn, round(avg(classify), 6) AS avg_classify FROM (SELECT user_id, sum(value) FILTER (WHERE event_id % 2 = 0) AS learn, sum(value) FILTER (WHERE event_id % 2 = 1) AS classify FROM events GROUP BY user_id) GROUP BY 1")
def _(t):
    """A user's events as the times of a fold, of a tenth of the users as a result's."""
    part = lambda r: F.sum(F.when(F.col("event_id") % 2 == r, F.col("value")))
    folds = t.events.groupBy("user_id").agg(part(0).alias("learn_time"), part(1).alias("classify_time"))
    found = ev.mean_times(folds.select((F.col("user_id") % 10).cast("int").alias("result_id"), F.col("user_id").alias("fold"), "learn_time", "classify_time"))
    return found.select("result_id", R("avg_learn"), R("avg_classify"))


@q("mx_is_prob", f"WITH {SCORES} SELECT min(score) >= 0 AND max(score) <= 1 AND bool_or(score > 0 AND score < 1) AS is_probability FROM s")
def _(t):
    return ev.is_probability(scores(t))


# ---- significance and comparison


DISC = f"{BASE}, d AS (SELECT count(*) FILTER (WHERE g.label <> pa.label AND g.label = pb.label) AS n01, count(*) FILTER (WHERE g.label = pa.label AND g.label <> pb.label) AS n10 FROM g JOIN pa USING (instance_id) JOIN pb USING (instance_id))"


def discordant(t):
    g = gold(t)
    ids = g.select("fold", "instance_id")
    return ev.discordant(ev.correct(g, predicted(t, "a"), ids), ev.correct(g, predicted(t, "b"), ids))


STAT = "CASE WHEN n01 + n10 > 0 THEN (abs(n01 - n10) - 1) ** 2 / (n01 + n10) END"


@q("st_discordant", f"WITH {DISC} SELECT *, round({STAT}, 6) AS statistic FROM d")
def _(t):
    return ev.mcnemar(discordant(t)).select("n01", "n10", R("statistic"))


def mcnemar_sql(table: str, keys: str = "") -> str:
    return f"x AS (SELECT *, {STAT} AS statistic FROM {table}), r AS (SELECT *, sqrt(statistic / 2) AS h FROM x) SELECT {keys}n01, n10, round(statistic, 6) AS statistic, round(coalesce({special.erfc_sql('h')}, 0), 9) AS p FROM r"


@q("st_mcnemar", f"WITH {DISC}, {mcnemar_sql('d')}")
def _(t):
    return ev.mcnemar(discordant(t)).select("n01", "n10", R("statistic"), R("p", 9))


@q("st_mcnemar_class", f"WITH {BASE}, j AS (SELECT g.label AS g, pa.label AS a, pb.label AS b FROM g JOIN pa USING (instance_id) JOIN pb USING (instance_id)), dc AS (SELECT label, count(*) FILTER (WHERE (g = label) <> (a = label) AND (g = label) = (b = label)) AS n01, count(*) FILTER (WHERE (g = label) = (a = label) AND (g = label) <> (b = label)) AS n10 FROM j, (SELECT label FROM sp UNION ALL SELECT 'unused') GROUP BY 1), {mcnemar_sql('dc', 'label, ')}")
def _(t):
    """By class; a class that nobody uses has p 0."""
    classes = t.langs().select("label").distinct().union(t.spark.range(1).select(F.lit("unused")))
    return ev.mcnemar(ev.class_discordant(gold(t), predicted(t, "a"), predicted(t, "b"), classes)).select("label", "n01", "n10", R("statistic"), R("p", 9))


@q("st_randomisation")
def _(t):
    return ev.randomisation(discordant(t))


@q("st_randomisation_exact", f"WITH {DISC}, k AS (SELECT n01, n10, n01 + n10 AS n, unnest(generate_series(greatest(n01, n10), n01 + n10)) AS k FROM d) SELECT n01, n10, round(sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))), 9) AS p FROM k GROUP BY ALL")
def _(t):
    return ev.exact_randomisation(discordant(t)).select("n01", "n10", R("p", 9))


@q("st_fleiss", f"""WITH r AS (SELECT lang AS subject, CASE WHEN substr(md5('r|' || doc_id), 1, 1) < '8' THEN 'x' WHEN lang IN ('en', 'de') THEN 'y' ELSE 'z' END AS category, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents),
least AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM r GROUP BY subject)), c AS (SELECT subject, category, count(*) FILTER (WHERE k <= m) AS n FROM (SELECT * FROM (SELECT DISTINCT subject FROM r), (SELECT DISTINCT category FROM r), least) g LEFT JOIN r USING (subject, category) GROUP BY ALL),
o AS (SELECT count(DISTINCT subject) AS s, (SELECT m FROM least) AS m FROM c), j AS (SELECT category, sum(n) / (s * m) AS pj, sum(n * (m - n)) AS xs, s * m * (m - 1) AS cc FROM c, o GROUP BY category, s, m), b AS (SELECT *, pj * (1 - pj) AS bj FROM j), kj AS (SELECT *, 1 - xs / (cc * bj) AS kj FROM b),
k AS (SELECT sum(bj * kj) / sum(bj) AS kappa, sqrt(2 * (sum(bj) ** 2 - sum(bj * (1 - 2 * pj)))) / sum(bj * sqrt(cc)) AS sek FROM kj),
pi AS (SELECT sum(n * n) AS q FROM c GROUP BY subject), w AS (SELECT (SELECT avg((q - m) / (m * (m - 1))) FROM pi, o) AS pbar, (SELECT sum(pj * pj) FROM j) AS pe), z AS (SELECT kappa, kappa / sek AS z, abs(kappa / sek) / sqrt(2) AS h FROM k)
SELECT round(kappa, 6) AS kappa, round((pbar - pe) / (1 - pe), 6) AS simple, round(z, 4) AS z, round({special.erfc_sql('h')}, 9) AS p FROM z, w""")
def _(t):
    """Subjects: languages; raters: as many documents of each as the rarest language has."""
    h = F.substring(F.md5(F.concat(F.lit("r|"), F.col("doc_id").cast("string"))), 1, 1)
    category = F.when(h < "8", "x").when(F.col("lang").isin("en", "de"), "y").otherwise("z")
    rows = t.documents.select(F.col("lang").alias("subject"), category.alias("category"), F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).alias("k"))
    least = rows.groupBy("subject").agg(F.count("*").alias("n")).agg(F.min("n").alias("m"))
    counts = rows.crossJoin(F.broadcast(least)).where("k <= m").groupBy("subject", "category").agg(F.count("*").alias("n"))
    return ev.fleiss(counts).select(R("kappa"), R("simple"), R("z", 4), R("p", 9))


@q("cmp_results", f"WITH {BASE} SELECT g.label AS gold, pa.label AS pred_a, pb.label AS pred_b, count(*) AS n FROM g JOIN pa USING (instance_id) JOIN pb USING (instance_id) WHERE NOT (g.label = pa.label AND g.label = pb.label) GROUP BY ALL")
def _(t):
    rows = ev.class_pairs(gold(t), predicted(t, "a")).withColumnRenamed("pred", "pred_a")
    rows = rows.join(predicted(t, "b").withColumnRenamed("label", "pred_b"), ["fold", "instance_id"])
    return rows.where("NOT (gold = pred_a AND gold = pred_b)").groupBy("gold", "pred_a", "pred_b").agg(F.count("*").alias("n"))


# ---- metadata: a result for each (source, language)


META = "me AS (SELECT source || '/' || lang AS result_id, source, lang, CAST(count(*) AS VARCHAR) AS docs FROM documents GROUP BY source, lang)"


def meta(t):
    rows = t.documents.groupBy("source", "lang").agg(F.count("*").cast("string").alias("docs"))
    entries = F.create_map(F.lit("source"), "source", F.lit("lang"), "lang", F.lit("docs"), "docs", F.lit("learner"), F.lit("nb"))
    return rows.select(F.concat_ws("/", "source", "lang").alias("result_id"), F.map_filter(entries, lambda k, v: ~((k == "docs") & (v == "1"))).alias("meta"))


@q("md_find", f"WITH {META} SELECT result_id FROM me WHERE lang = 'fr'")
def _(t):
    return md.find(meta(t), {"lang": "fr", "classifier": None}).select("result_id")


@q("md_value_counts", f"WITH {META}, x AS (SELECT unnest(['source', 'lang', 'docs', 'learner']) AS key, unnest([source, lang, CASE WHEN docs <> '1' THEN docs END, 'nb']) AS value FROM me) SELECT key, value, count(*) AS n FROM x WHERE value IS NOT NULL AND key IN (SELECT key FROM x WHERE value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT value) BETWEEN 2 AND 10) GROUP BY ALL")
def _(t):
    return md.value_counts(meta(t))


@q("md_shared", f"WITH {META}, en AS (SELECT result_id, unnest(['source', 'lang', 'docs', 'learner']) AS key, unnest([source, lang, CASE WHEN docs <> '1' THEN docs END, 'nb']) AS value FROM me) SELECT key, value FROM en GROUP BY ALL HAVING count(value) = (SELECT count(*) FROM me)")
def _(t):
    return md.shared(meta(t))


@q("md_summary_table", f"WITH {META} SELECT result_id, lang AS language, coalesce(CASE WHEN docs <> '1' THEN docs END, 'UNKNOWN') AS docs FROM me")
def _(t):
    m = lambda k: F.try_element_at("meta", F.lit(k))
    return meta(t).select("result_id", m("lang").alias("language"), F.coalesce(m("docs"), F.lit("UNKNOWN")).alias("docs"))


@q("md_catalog", f"WITH {META} SELECT source AS dataset, CAST(sum(docs::BIGINT) AS BIGINT) AS n_instances, count(DISTINCT lang) AS n_classes FROM me GROUP BY 1")
def _(t):
    return t.documents.groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("n_instances"), F.countDistinct("lang").alias("n_classes"))


@q("md_delete", f"WITH {META} SELECT result_id FROM me WHERE lang <> 'fr'")
def _(t):
    m = meta(t)
    return m.join(md.find(m, {"lang": "fr"}).select("result_id"), "result_id", "left_anti").select("result_id")


@q("md_format", f"WITH {META} SELECT result_id, format('{{:.4f}}', CAST(docs AS DOUBLE) / 7) AS value FROM me")
def _(t):
    docs = F.coalesce(F.try_element_at("meta", F.lit("docs")), F.lit("1")).cast("double")
    return meta(t).select("result_id", F.format_string("%.4f", docs / 7).alias("value"))


@q("md_featuresets", f"WITH {META} SELECT source, CAST(count(*) AS BIGINT) AS n_sets, bool_or(lang = 'de') AS has_de FROM me GROUP BY 1")
def _(t):
    m = meta(t).select(F.col("meta.source").alias("source"), F.col("meta.lang").alias("lang"))
    return m.groupBy("source").agg(F.count("*").alias("n_sets"), F.bool_or(F.col("lang") == "de").alias("has_de"))


@q("md_merge_results", f"WITH {META} SELECT result_id FROM me WHERE source < 'src5' UNION ALL SELECT 'new/' || result_id FROM me WHERE source >= 'src5'")
def _(t):
    m = meta(t)
    src = m.select(F.concat(F.lit("new/"), "result_id").alias("result_id"), F.map_concat("meta", F.create_map(F.lit("uuid"), "result_id")).alias("meta"))
    return md.merge(m.where("meta.source < 'src5'"), src).select("result_id")


@q("md_missing", f"WITH {META} SELECT result_id FROM me WHERE lang = 'es'")
def _(t):
    m = meta(t)
    return md.missing(m, m.where("meta.lang <> 'es'")).select("result_id")


@q("md_reuse", "SELECT lang, source, count(*) AS n, CAST(1 AS BIGINT) AS times_run, CAST(CASE WHEN lang = 'es' THEN 0 ELSE 1 END AS BIGINT) AS times_reused FROM documents GROUP BY lang, source")
def _(t):
    """Four experiments, three of which were run before: those are read, the fourth runs."""
    folder = t.scratch()
    first, then = rn.Runs(t.spark, folder), rn.Runs(t.spark, folder)

    def experiment(runs, lang):
        meta_ = {"dataset": "documents", "class": lang, "uuid": str(id(runs))}
        return runs.result(meta_, lambda: t.documents.where(F.col("lang") == lang).groupBy("lang", "source").agg(F.count("*").alias("n"))), runs.key(meta_)

    for lang in ("de", "en", "fr"):
        experiment(first, lang)
    out = None
    for lang in ("de", "en", "es", "fr"):
        rows, key = experiment(then, lang)
        rows = rows.select("*", F.lit((first.ran + then.ran).count(key)).cast("long").alias("times_run"), F.lit((first.reused + then.reused).count(key)).cast("long").alias("times_reused"))
        out = rows if out is None else out.unionByName(rows)
    return out.join(then.committed().select(F.col("meta.class").alias("lang")), "lang", "left_semi")
