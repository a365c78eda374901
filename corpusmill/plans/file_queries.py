"""Queries over sources, sinks, pyspark.ml learners and online scoring.  Files are made from the tables in the shared folder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import classify as cf
from ..operators import evaluate as ev
from ..operators import features as fm
from ..operators import learners as ml
from ..operators import linear as ln
from ..operators import topics as tp
from ..operators import weights as wt
from ..sources import archives as ar
from ..sources import readers as rd
from ..sources import writers as wr
from ..streaming import online
from .base import FB, FW, LANG, ML, TT, folds_sql, q
from .classifier_queries import best_sql, nb_cte, nodes_sql



def one_line():
    return F.regexp_replace(F.coalesce("text", F.lit("")), r"[\n\t;]", " ")


FLAT = r"regexp_replace(coalesce(text, ''), '[\n\t;]', ' ', 'g')"


def by_class(t, fmt="text", *columns):
    path = t.scratch()
    t.documents.select(*(columns or ("lang",)), one_line().alias("value")).write.partitionBy(*(columns or ("lang",))).text(path)
    return path


LINES = f"SELECT lang AS label, count(*) AS n, CAST(sum(strlen({FLAT})) AS BIGINT) AS n_bytes FROM documents WHERE {FLAT} <> '' GROUP BY 1"


def counted(rows, label="label", text="text"):
    return rows.where(F.col(text) != "").groupBy(label).agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).cast("long").alias("n_bytes"))


def decoded(files):
    return files.select("*", F.explode(F.split(F.decode("bytes", "UTF-8"), "\n")).alias("text"))


@q("src_single_dir", f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(strlen({FLAT})) AS BIGINT) AS n_bytes FROM documents WHERE {FLAT} <> ''")
def _(t):
    path = t.scratch()
    t.documents.select(one_line().alias("value")).write.text(path)
    return decoded(rd.read_dir(t.spark, path)[0]).where("text <> ''").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))


@q("src_dir_per_class", LINES)
def _(t):
    texts, maps = rd.read_dir(t.spark, by_class(t), "classes")
    return counted(decoded(texts.join(maps["class"], "instance_id")).withColumn("label", F.replace("label", F.lit("lang="), F.lit(""))))


@q("src_file_per_class", f"SELECT lang || '-' || (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) AS instance_id, lang AS label, md5({FLAT}) AS digest FROM documents QUALIFY {FLAT} <> ''")
def _(t):
    """A folder of text files for each class, lines in order of doc_id over its parts."""
    path = t.scratch()
    wr.write_sorted(t.documents.select("lang", "doc_id", one_line().alias("value")), path, ["lang", "doc_id"], ["lang"])
    found = rd.read_lines_by_class(t.spark, path, folders=True)
    plain = lambda c: F.replace(c, F.lit("lang="), F.lit(""))
    return found.select(plain("instance_id").alias("instance_id"), plain("label").alias("label"), F.md5("text").alias("digest"))


@q("src_domain_category", f"SELECT source || '-' || lang AS label, count(*) AS n, CAST(sum(strlen({FLAT})) AS BIGINT) AS n_bytes FROM documents WHERE {FLAT} <> '' GROUP BY 1")
def _(t):
    texts, maps = rd.read_dir(t.spark, by_class(t, "text", "source", "lang"), "domains")
    return counted(decoded(texts.join(maps["domain_category"], "instance_id")).withColumn("label", F.regexp_replace("label", "(source|lang)=", "")))


@q("src_tar", "SELECT source || '/' || lang || '/' || doc_id || '.txt' AS instance_id, source || '/' || lang AS label, md5(coalesce(text, '')) AS digest FROM documents")
def _(t):
    """Archives of bounded size, written by tasks, indexed by their headers and read by ranges."""
    path = t.scratch()
    name = F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".txt"))
    ar.write_tar(t.documents.select(name.alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes")), path, 1 << 20)
    return ar.read_tar(t.spark, path, 1 << 18).select("instance_id", "label", F.md5("bytes").alias("digest"))


@q("src_jsonl", f"WITH {ML}, n AS (SELECT doc_id, text, 'lines.jsonl-' || (row_number() OVER (ORDER BY doc_id) - 1) AS instance_id FROM documents SEMI JOIN ml ON ml.instance_id = doc_id) SELECT n.instance_id, label, md5(text) AS digest FROM n JOIN ml ON ml.instance_id = doc_id")
def _(t):
    path = f"{t.scratch()}/lines.jsonl"
    labels = t.multilabel().groupBy("instance_id").agg(F.array_sort(F.collect_list("label")).alias("l"))
    rows = t.documents.select("doc_id", "text").join(labels, F.col("doc_id") == F.col("instance_id"))
    one = F.to_json(F.struct("text", F.col("l").alias("class")))
    scalar = F.to_json(F.struct("text", F.get("l", F.lit(0)).alias("class")))
    wr.write_sorted(rows.select("doc_id", F.when(F.size("l") == 1, scalar).otherwise(one).alias("value")), path, ["doc_id"])
    texts, classes = rd.read_jsonl(t.spark, path, "text", "class", folders=True)
    return texts.join(classes, "instance_id").select("instance_id", "label", F.md5("text").alias("digest"))


@q("src_csv_meta", "SELECT lang AS label, source AS part, count(*) AS n FROM documents GROUP BY ALL")
def _(t):
    path = t.scratch()
    t.documents.select("doc_id", F.lit("utf-8").alias("enc"), "lang", "source").write.csv(path, sep="\t")
    side = rd.read_side_file(t.spark, path, "instance_id long, encoding string, label string, part string")
    return side.join(t.instances(), "instance_id").groupBy("label", "part").agg(F.count("*").alias("n"))


@q("src_delimited_text", f"SELECT doc_id::VARCHAR AS instance_id, lang AS label, md5({FLAT} || ';x') AS digest FROM documents")
def _(t):
    path = t.scratch()
    t.documents.select(F.concat_ws(";", F.col("doc_id").cast("string"), "lang", F.concat(one_line(), F.lit(";x")))).write.text(path)
    rows = rd.read_delimited(t.spark.read.text(path), ";", ["instance_id", "label", "text"])
    return rows.select("instance_id", "label", F.md5("text").alias("digest"))


@q("src_path_list", "SELECT source AS domain, lang, count(*) AS n FROM documents GROUP BY ALL")
def _(t):
    path = t.scratch()
    t.documents.select(F.concat_ws("/", F.lit("corpus"), "source", "lang", F.col("doc_id").cast("string"))).write.text(path)
    return rd.read_paths(t.spark.read.text(path)).groupBy("domain", "lang").agg(F.count("*").alias("n"))


@q("src_tagged_records", f"WITH {ML} SELECT CAST(doc_id AS VARCHAR) AS instance_id, coalesce(label, '-') AS label, CASE WHEN doc_id % 3 = 0 THEN 'test' WHEN doc_id % 3 = 1 THEN 'train' ELSE '-' END AS role, md5(translate(coalesce(text, ''), '<>', '  ')) AS digest FROM documents LEFT JOIN ml ON ml.instance_id = doc_id")
def _(t):
    """Records of many lines, in files that are read in parts."""
    path = t.scratch()
    labels = t.multilabel().groupBy("instance_id").agg(F.collect_list("label").alias("l"))
    rows = t.documents.select("doc_id", F.translate(F.coalesce("text", F.lit("")), "<>", "  ").alias("text")).join(labels, F.col("doc_id") == F.col("instance_id"), "left")
    topics = F.concat(F.lit("<TOPICS>"), F.coalesce(F.array_join(F.transform("l", lambda x: F.concat(F.lit("<D>"), x, F.lit("</D>"))), ""), F.lit("")), F.lit("</TOPICS>"))
    part = F.when(F.col("doc_id") % 3 == 0, "TEST").when(F.col("doc_id") % 3 == 1, "TRAIN").otherwise("NOT-USED")
    value = F.concat(F.lit('<REUTERS newid="'), F.col("doc_id").cast("string"), F.lit('" lewissplit="'), part, F.lit('">\n'), topics, F.lit("\n<TEXT>"), "text", F.lit("</TEXT>\n</REUTERS>"))
    rows.select(value.alias("value")).write.text(path)
    texts, classes, split = rd.read_tagged(t.spark, path)
    both = texts.join(classes, "instance_id", "left").join(split, "instance_id", "left")
    return both.select("instance_id", F.coalesce("label", F.lit("-")).alias("label"), F.coalesce("role", F.lit("-")).alias("role"), F.md5("text").alias("digest"))


@q("src_xml_index", "SELECT lang AS label, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY 1")
def _(t):
    path = t.scratch()
    t.documents.select(F.col("doc_id").alias("_id"), F.when(F.col("lang") == "en", " ").otherwise(F.col("lang")).alias("_lang"), F.col("source").alias("_src")).write.format("xml").option("rowTag", "doc").option("rootTag", "index").save(path)
    return rd.read_xml_index(t.spark, path, "doc", ["lang", "src"])["lang"].groupBy("label").agg(F.count("*").alias("n"))


@q("src_numeric_csv", "WITH x AS (SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax]::DOUBLE[]) AS value FROM lineitem) SELECT feature, count(*) AS n, round(sum(value), 2) AS total FROM x WHERE value <> 0 GROUP BY 1")
def _(t):
    path = t.scratch()
    t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_quantity", "l_discount", "l_tax").write.csv(path)
    rows = t.spark.read.csv(path, schema="id string, l_quantity double, l_discount double, l_tax double")
    found = rd.numeric_features(rows, "id", ["l_quantity", "l_discount", "l_tax"])
    return found.groupBy("feature").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@q("src_synthetic", f"WITH {FW}, v AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS i FROM (SELECT DISTINCT feature FROM f)) SELECT 'class' || i AS label, CAST(5 AS BIGINT) AS n, CAST(15 * (length(feature) + 1) AS BIGINT) AS chars FROM v")
def _(t):
    words = fm.index_features(t.words()).select(F.col("feature").alias("word"), F.col("idx").alias("i"))
    return rd.repeated_words(words, 5).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


# ---- sinks


def spaces(t):
    w = t.stored(t.words())
    return w, t.stored(fm.index_features(w)), fm.index_features(t.langs().select(F.col("label").alias("feature"))).select(F.col("feature").alias("label"), "idx")


SPACE = f"{FW}, s AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx FROM (SELECT DISTINCT feature FROM f)), c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT lang AS label FROM documents))"
#: what a line's cells sum to, as read back
SUMS = "totals AS (SELECT instance_id, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total, CAST(sum(idx * value) AS DOUBLE) AS places FROM f JOIN s USING (feature) GROUP BY 1)"
OF_LINE = "coalesce(n, 0) AS n, coalesce(total, 0) AS total, coalesce(places, 0) AS places"
ROW = "CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS line"


def cell_rows(sep: str, base: int, between: str = " ") -> str:
    return f"cells AS (SELECT instance_id, string_agg((idx + {base}) || '{sep}' || value, '{between}' ORDER BY idx) AS cells FROM f JOIN s USING (feature) GROUP BY 1)"


def sums_of_cells():
    total = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["value"])
    places = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["idx"] * c["value"])
    return [F.size("cells").cast("long").alias("n"), total.alias("total"), places.alias("places")]


@q("snk_libsvm", f"WITH {SPACE}, {ML}, {cell_rows(':', 1)}, {SUMS}, mc AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT label FROM ml)), l AS (SELECT instance_id, string_agg(idx, ',' ORDER BY idx) AS l FROM ml JOIN mc USING (label) GROUP BY 1) SELECT {ROW}, coalesce(l, '-1') AS labels, {OF_LINE}, md5(rtrim(coalesce(l, '-1') || ' ' || coalesce(cells, ''))) AS digest FROM documents LEFT JOIN cells c ON c.instance_id = doc_id LEFT JOIN totals t ON t.instance_id = doc_id LEFT JOIN l ON l.instance_id = doc_id")
def _(t):
    """Several labels and none, written by ranges of instances, read back and parsed."""
    path = t.scratch()
    w, space, _c = spaces(t)
    classes = fm.index_features(t.multilabel().select(F.col("label").alias("feature"))).select(F.col("feature").alias("label"), "idx")
    wr.write_sorted(wr.libsvm_rows(t.instances(), w, space, t.multilabel(), classes), path, ["instance_id"])
    lines = rd.sorted_lines(t.spark, path)
    found = rd.read_libsvm(lines).join(lines.select("line", F.md5("value").alias("digest")), "line")
    labels = F.when(F.size("labels") == 0, "-1").otherwise(F.array_join(F.transform("labels", lambda x: x.cast("string")), ","))
    return found.select("line", labels.alias("labels"), *sums_of_cells(), "digest")


@q("snk_vw", f"WITH {SPACE}, {cell_rows(':', 0)}, {SUMS} SELECT {ROW}, k.idx AS label, {OF_LINE}, md5(rtrim((k.idx + 1) || ' | ' || coalesce(cells, ''))) AS digest FROM documents JOIN c k ON label = lang LEFT JOIN cells c ON c.instance_id = doc_id LEFT JOIN totals t ON t.instance_id = doc_id")
def _(t):
    path = t.scratch()
    w, space, classes = spaces(t)
    wr.write_sorted(wr.vw_rows(t.instances(), w, space, t.langs(), classes), path, ["instance_id"])
    lines = rd.sorted_lines(t.spark, path)
    found = rd.read_vw(lines).join(lines.select("line", F.md5("value").alias("digest")), "line")
    return found.select("line", "label", *sums_of_cells(), "digest")


QUOTED = "chr(39) || replace(replace(feature, chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39)) || chr(39)"


def arff_sql(data: str) -> str:
    """Every line of the file, numbered, by digest."""
    head = f"SELECT 0 AS section, -3 AS i, '@RELATION ' || chr(39) || 'corpus' || chr(39) AS value UNION ALL SELECT 0, -2, '' UNION ALL SELECT 0, -1, '@ATTRIBUTE class {{' || string_agg(label, ',' ORDER BY label) || '}}' FROM c UNION ALL SELECT 0, idx, '@ATTRIBUTE ' || {QUOTED} || ' NUMERIC' FROM s UNION ALL SELECT 1, 0, '' UNION ALL SELECT 1, 1, '@DATA'"
    return f"SELECT CAST(row_number() OVER (ORDER BY section, i) - 1 AS BIGINT) AS line, md5(value) AS digest FROM ({head} UNION ALL {data})"


@q("snk_arff", f"WITH {SPACE}, {cell_rows(' ', 1, ', ')} " + arff_sql("SELECT 2, doc_id, '{0 ' || lang || coalesce(', ' || cells, '') || '}' FROM documents LEFT JOIN cells ON instance_id = doc_id"))
def _(t):
    """All lines of the file, header first; word counts are sparse."""
    path = t.scratch()
    w, space, classes = spaces(t)
    wr.write_arff(t.instances(), w, space, t.langs(), classes, path)
    return rd.sorted_lines(t.spark, path).select("line", F.md5("value").alias("digest"))


DENSE_CELLS = "e AS (SELECT vec_id, 'd' || lpad(CAST(i AS VARCHAR), 4, '0') AS feature, CAST(floor(64 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS value FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)), s AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx FROM (SELECT DISTINCT feature FROM e WHERE value <> 0)), c AS (SELECT DISTINCT 'l' || label AS label FROM embeddings)"


@q("snk_arff_dense", f"WITH {DENSE_CELLS}, cells AS (SELECT vec_id, string_agg(value, ',' ORDER BY idx) AS cells FROM e JOIN s USING (feature) GROUP BY 1) " + arff_sql("SELECT 2, vec_id, 'l' || label || coalesce(',' || cells, '') FROM embeddings LEFT JOIN cells USING (vec_id)"))
def _(t):
    """Embeddings as whole numbers: dense rows, since more than a tenth of the cells aren't zero."""
    path = t.scratch()
    rows = t.embeddings.select(F.col("vec_id").alias("instance_id"), F.posexplode("embedding").alias("i", "x"))
    name = F.concat(F.lit("d"), F.lpad((F.col("i") + 1).cast("string"), 4, "0"))
    cells = t.stored(rows.select("instance_id", name.alias("feature"), F.floor(64 * F.col("x").cast("double")).cast("long").alias("value")).where("value <> 0"))
    labels = t.embeddings.select(F.col("vec_id").alias("instance_id"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("label"))
    wr.write_arff(labels.select("instance_id"), cells, fm.index_features(cells), labels, labels.select("label").distinct(), path)
    return rd.sorted_lines(t.spark, path).select("line", F.md5("value").alias("digest"))


#: the header's lines in order of section and i, with idx and name of the attributes that aren't the class
HEAD = f"SELECT 0 AS section, -3 AS i, '@RELATION ' || chr(39) || 'corpus' || chr(39) AS value, NULL AS idx, NULL AS name UNION ALL SELECT 0, -2, '', NULL, NULL UNION ALL SELECT 0, -1, '@ATTRIBUTE class {{' || string_agg(label, ',' ORDER BY label) || '}}', NULL, NULL FROM c UNION ALL SELECT 0, idx, '@ATTRIBUTE ' || {QUOTED} || ' NUMERIC', idx, feature FROM s UNION ALL SELECT 1, 0, '', NULL, NULL UNION ALL SELECT 1, 1, '@DATA', NULL, NULL"


@q("snk_arff_header", f"WITH {SPACE}, h AS ({HEAD}) SELECT CAST(row_number() OVER (ORDER BY section, i) - 1 AS BIGINT) AS line, value, CAST(idx AS BIGINT) AS idx, CAST(name AS VARCHAR) AS name FROM h")
def _(t):
    """Every line of the header as read back from a whole file, the class's too, with the attributes parsed from it."""
    path = t.scratch()
    w, space, classes = spaces(t)
    wr.write_arff(t.instances(), w, space, t.langs(), classes, path)
    return rd.read_arff_header(rd.sorted_lines(t.spark, path))


@q("snk_density", f"WITH {FW} SELECT round(count(*) / ((SELECT count(*) FROM documents) * count(DISTINCT feature)), 9) AS density FROM f")
def _(t):
    return wr.density(t.instances(), t.words()).select(F.round("density", 9).alias("density"))


@q("snk_bow_rows", f"WITH {SPACE}, {ML}, cells AS (SELECT instance_id, string_agg('feat' || idx || ' ' || value, ' ' ORDER BY idx) AS cells FROM f JOIN s USING (feature) GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY instance_id, label) - 1 AS BIGINT) AS line, CAST(instance_id AS VARCHAR) AS instance_id, label, md5(instance_id || ' ' || label || '  ' || cells) AS digest FROM cells JOIN ml USING (instance_id)")
def _(t):
    path = t.scratch()
    w, space, _c = spaces(t)
    wr.write_sorted(wr.bow_rows(w, space, t.multilabel()), path, ["instance_id", "label"])
    pieces = F.split("value", " ", 3)
    return rd.sorted_lines(t.spark, path).select("line", F.get(pieces, F.lit(0)).alias("instance_id"), F.get(pieces, F.lit(1)).alias("label"), F.md5("value").alias("digest"))


@q("snk_sequence_rows", "WITH x AS (SELECT conv_id, 0 AS ended, turn, turn || ' ' || length(coalesce(text, '')) || ' ' || role AS value FROM conversations UNION ALL SELECT conv_id, 1, max(turn), '' FROM conversations GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY conv_id, ended, turn) - 1 AS BIGINT) AS line, value FROM x")
def _(t):
    """Every line as read back; blank lines end threads."""
    path = t.scratch()
    rows = t.conversations.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("pos"), "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"), "role")
    wr.write_sorted(wr.sequence_rows(rows, ["turn", "n"], "role"), path, ["thread_id", "end", "pos"])
    return rd.sorted_lines(t.spark, path)


@q("snk_summary_csv", "SELECT source, coalesce(CASE WHEN lang <> 'en' THEN lang END, 'UNKNOWN') AS lang, CAST(count(*) AS VARCHAR) AS n FROM documents GROUP BY ALL")
def _(t):
    path = t.scratch()
    table = t.documents.groupBy("source", F.when(F.col("lang") != "en", F.col("lang")).alias("lang")).agg(F.count("*").alias("n"))
    wr.write_summary(table, path, ["source", "lang", "n"])
    return t.spark.read.csv(path, header=True, schema="source string, lang string, n string")


@q("snk_features", f"WITH {FW} SELECT 'documents' AS dataset, 'word' AS space, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM f")
def _(t):
    path = t.scratch()
    wr.write_features(t.words(), path, "documents", "word")
    return t.spark.read.parquet(path).groupBy("dataset", "space").agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("total"))


@q("snk_results", f"WITH {LANG} SELECT 'r1' AS result_id, label, count(*) AS n FROM cm GROUP BY ALL")
def _(t):
    path = t.scratch()
    gold = t.langs().withColumn("result_id", F.lit("r1"))
    wr.write_results(gold.withColumn("score", F.lit(1.0)), gold, path)
    return t.spark.read.parquet(f"{path}/gold").groupBy("result_id", "label").agg(F.count("*").alias("n"))


# ---- learners that iterate (rows only: no SQL form)


def frequent(t, n=400):
    """Words in most documents, and their space."""
    w = t.stored(t.words())
    kept = w.join(F.broadcast(wt.highest_n(wt.document_frequency(w), n)), "feature", "left_semi")  # proven bound: n features
    return kept, t.stored(fm.index_features(kept))


def vectors(t, n=400):
    w, space = frequent(t, n)
    return ml.to_vectors(w, space, n), space


def against_gold(t, found):
    return found.join(t.langs().withColumnRenamed("label", "gold"), "instance_id").groupBy("gold", "label").agg(F.count("*").alias("n"))


def learned(t, kind, n=400):
    v, _ = vectors(t, n)
    split = t.train_test()
    train, test = (v.join(split.where(F.col("role") == r), "instance_id", "left_semi") for r in ("train", "test"))
    return against_gold(t, ml.fit_predict(kind, ml.labelled(train, t.langs()), test, n, 4))


for _name, _kind, _n in (("clf_maxent_l1", "logistic_l1", 200), ("clf_trees", "tree", 200), ("clf_forest", "forest", 200), ("clf_mlp", "mlp", 100)):
    q(_name)(lambda t, kind=_kind, n=_n: learned(t, kind, n))


def linear(t, kind):
    """Learned on the training part, all classes at once; the test part's best classes."""
    w, space = frequent(t)
    part = t.train_test().select("instance_id", F.when(F.col("role") == "test", 0).alias("test_fold"))
    found = ln.Batched(w, space, t.langs(), part, kind).fit(rounds=40, tolerance=1e-3).scores()
    return against_gold(t, ev.highest(found, ["instance_id"]))


for _name, _kind in (("clf_linear", "svm"), ("clf_maxent", "logistic")):
    q(_name)(lambda t, kind=_kind: linear(t, kind))


@q("ex_run_linear")
def _(t):
    """Ten folds and all classes in one optimisation: correct predictions by fold."""
    w, space = frequent(t, 200)
    found = ln.Batched(w, space, t.langs(), t.folds(), "svm").fit(rounds=25, tolerance=1e-3).scores()
    best = ev.highest(found, ["fold", "instance_id"]).join(t.langs().withColumnRenamed("label", "gold"), "instance_id")
    return best.groupBy("fold").agg(F.count(F.when(F.col("gold") == F.col("label"), 1)).alias("right"), F.count("*").alias("n"))


@q("w_linear_svm")
def _(t):
    w, space = frequent(t)
    return ln.Batched(w, space, t.langs()).fit(rounds=40, tolerance=1e-3).feature_weights()


@q("ft_lda")
def _(t):
    return tp.gibbs_topics(frequent(t, 300)[0], k=20, sweeps=8)


@q("pr_kmeans")
def _(t):
    return ml.class_centroids(ml.dense(t.embeddings), 2)


@q("clf_ann")
def _(t):
    """The nearest other vector of every hundredth one, among all."""
    rows = ml.dense(t.embeddings).select("vec_id", "features")
    return ml.approximate_nearest(rows, rows.where("vec_id % 100 = 0"), "vec_id", threshold=20.0)


# ---- experiments and online scoring


def model_of(t, bigrams=None):
    split = t.train_test().where("role = 'train'")
    b = (t.stored(t.bigrams()) if bigrams is None else bigrams).join(split, "instance_id", "left_semi")
    return cf.nb_model(b, t.langs().join(split, "instance_id", "left_semi"))


ONLINE = f"{FB}, {TT}, {LANG}, tr AS (SELECT b.* FROM b JOIN tt USING (instance_id) WHERE role = 'train'), cmt AS (SELECT cm.* FROM cm JOIN tt USING (instance_id) WHERE role = 'train'), at0 AS (SELECT doc_id AS instance_id, 'all' AS node FROM documents), {nodes_sql([('all', x, x) for x in ('de', 'en', 'es', 'fr')], 'na_', classes='cmt', test='b')}, found AS (SELECT instance_id, branch AS label FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY round(score, 9) DESC, branch) AS rn FROM na_nb) WHERE rn = 1)"


@q("on_classify_batch", f"WITH {ONLINE} SELECT lang AS gold, label, count(*) AS n FROM found JOIN documents ON doc_id = instance_id GROUP BY ALL", once=True)
def _(t):
    b = t.stored(t.bigrams())
    found = online.classify_texts(model_of(t, b), t.documents, tx.byte_ngrams(F.col("text"), 2), counts=b)
    return found.join(t.langs().withColumnRenamed("label", "gold"), "instance_id").groupBy("gold", "label").agg(F.count("*").alias("n"))


@q("on_stream", f"WITH {ONLINE} SELECT label, count(*) AS n FROM found GROUP BY 1", once=True)
def _(t):
    """All documents as a stream of files, scored with a stored model."""
    path = t.scratch()
    online.save_model(model_of(t), f"{path}/model")
    t.documents.select("doc_id", "text").write.parquet(f"{path}/in")
    stream = t.spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 64).parquet(f"{path}/in")
    online.classify_stream(f"{path}/model", stream, tx.byte_ngrams(F.col("text"), 2), f"{path}/out", f"{path}/state").awaitTermination()
    return t.spark.read.parquet(f"{path}/out").groupBy("label").agg(F.count("*").alias("n"))


@q("ex_run", f"WITH {FW}, {folds_sql()}, {LANG}, {nb_cte('f')}, {best_sql('nb')} SELECT CAST(fold AS INTEGER) AS fold, count(*) FILTER (WHERE lang = label) AS \"right\", count(*) AS n FROM best JOIN documents ON doc_id = instance_id GROUP BY 1", once=True)
def _(t):
    """Ten folds in one job: correct predictions by fold."""
    folds = t.folds()
    best = ev.highest(cf.naive_bayes_cv(t.stored(t.words()), t.langs(), folds), ["fold", "instance_id"])
    return best.join(t.langs().withColumnRenamed("label", "gold"), "instance_id").groupBy("fold").agg(F.count(F.when(F.col("gold") == F.col("label"), 1)).alias("right"), F.count("*").alias("n"))


def grid_sql() -> str:
    cells = [(space, learner, f"{space}_{learner}_") for space in ("word", "byte2") for learner in ("multinomial", "boolean")]
    ctes = ", ".join(f"{nb_cte('f' if space == 'word' else 'b', '1' if learner == 'boolean' else 'value', x)}, {best_sql(x + 'nb', x + 'best')}" for space, learner, x in cells)
    rows = " UNION ALL ".join(f"SELECT '{space}' AS space, '{learner}' AS learner, round(avg((lang = label)::INT), 9) AS accuracy FROM {x}best JOIN documents ON doc_id = instance_id" for space, learner, x in cells)
    return f"WITH {FW}, {FB}, {folds_sql(5)}, {LANG}, {ctes} {rows}"


@q("ex_grid", grid_sql(), once=True)
def _(t):
    """Feature space x learner into one table of accuracies; a small list of experiments is looped over on the driver."""
    folds, langs, out = t.stored(t.folds(5)), t.langs(), None
    for space, features in (("word", t.words()), ("byte2", t.bigrams())):
        # both learners read one table with folds, and one of counts
        features = t.stored(cf.in_folds(features, folds))
        counts = t.stored(cf.nb_counts_of_both(features, langs))
        for boolean in (False, True):
            own = counts.select("test_fold", "label", "feature", F.col("b" if boolean else "n").alias("n"))
            best = ev.highest(cf.naive_bayes_cv(features, langs, folds, boolean, counts=own), ["fold", "instance_id"])
            row = best.join(langs.withColumnRenamed("label", "gold"), "instance_id").agg(F.round(F.avg((F.col("gold") == F.col("label")).cast("double")), 9).alias("accuracy"))
            row = row.select(F.lit(space).alias("space"), F.lit("boolean" if boolean else "multinomial").alias("learner"), "accuracy")
            out = row if out is None else out.unionByName(row)
    return out


@q("ex_text_classifier", "SELECT lang AS gold, CASE WHEN text LIKE '%ß%' OR text LIKE '%ü%' THEN 'German' WHEN text LIKE '%ñ%' OR text LIKE '%ó%' THEN 'Spanish' WHEN text LIKE '%è%' OR text LIKE '%ç%' THEN 'French' ELSE 'UNKNOWN' END AS label, count(*) AS n FROM documents GROUP BY ALL")
def _(t):
    """Any text -> label function, with its labels mapped to the class space."""

    @F.pandas_udf("string")
    def guess(texts: pd.Series) -> pd.Series:
        def one(x):
            return next((k for k, marks in (("de", "ßü"), ("es", "ñó"), ("fr", "èç")) if any(m in (x or "") for m in marks)), "xx")

        return texts.map(one)

    names = t.spark.createDataFrame([("de", "German"), ("es", "Spanish"), ("fr", "French")], "label string, name string")
    rows = t.documents.select(F.col("lang").alias("gold"), guess("text").alias("label")).join(F.broadcast(names), "label", "left")
    return rows.groupBy("gold", F.coalesce("name", F.lit("UNKNOWN")).alias("label")).agg(F.count("*").alias("n"))
