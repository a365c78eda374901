"""Queries over feature maps and class maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import classes as cl
from ..operators import features as fm
from .base import FB, FW, LANG, ML, W, q
from .text_queries import grams_sql

COLUMN = "text"


def counts_sql(tokens: str, ctes: str = W, source: str = "w") -> str:
    return f"WITH {ctes}, x AS (SELECT doc_id, unnest({tokens}) AS feature FROM {source}) SELECT doc_id AS instance_id, feature, count(*) AS value FROM x GROUP BY ALL"


@q("fm_ngram_count", counts_sql(grams_sql("w", 2, "-")))
def _(t):
    return fm.feature_counts(t.documents, tx.ngrams(tx.bow(COLUMN), 2, "-"))


@q("fm_unordered_ngram", counts_sql("list_transform(generate_series(1, len(w) - 1), lambda i: array_to_string(list_sort(w[i:i + 1]), '-'))"))
def _(t):
    def pairs(w):
        return F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.array_join(F.sort_array(F.slice(w, i, 2)), "-"))).otherwise(F.array().cast("array<string>"))

    return fm.feature_counts(t.documents, tx.let(tx.bow(COLUMN), pairs))


@q("fm_from_stream", f"WITH {W}, x AS (SELECT doc_id, unnest([len(w), len(list_distinct(w)), CASE WHEN len(w) > 0 THEN list_max(list_transform(w, lambda t: length(t))) ELSE 0 END]) AS value, unnest([1, 2, 3]) AS p FROM w) SELECT doc_id AS instance_id, 'feat' || p AS feature, CAST(value AS DOUBLE) AS value FROM x WHERE value <> 0")
def _(t):
    d = t.documents.select("doc_id", tx.bow(COLUMN).alias("w"))
    longest = F.coalesce(F.array_max(F.transform("w", lambda x: F.length(x))), F.lit(0))
    return fm.feature_sequence(d, F.array(F.size("w"), F.size(F.array_distinct("w")), longest))


@q("fm_index", f"""WITH {FB}, old AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx FROM (SELECT DISTINCT feature FROM b JOIN documents ON doc_id = instance_id WHERE lang = 'en')),
new AS (SELECT feature, (SELECT max(idx) FROM old) + row_number() OVER (ORDER BY feature) AS idx FROM (SELECT DISTINCT feature FROM b WHERE feature NOT IN (SELECT feature FROM old)))
SELECT feature, CAST(idx AS BIGINT) AS idx FROM old UNION ALL SELECT feature, CAST(idx AS BIGINT) FROM new""")
def _(t):
    b = t.bigrams()
    english = b.join(t.langs().where("label = 'en'"), "instance_id", "left_semi")
    return fm.index_features(b, fm.index_features(english))


@q("fm_cull_top", f"WITH {FW}, top AS (SELECT feature FROM f GROUP BY feature ORDER BY sum(value) DESC, feature LIMIT 500) SELECT f.* FROM f JOIN top USING (feature)")
def _(t):
    return fm.cull(t.words(), 500)


@q("fm_union", f"WITH {FW}, {FB}, u AS (SELECT instance_id, 'byte2:' || feature AS feature, value FROM b UNION ALL SELECT instance_id, 'word:' || feature, value FROM f) SELECT instance_id, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total, min(feature) AS first, max(feature) AS last FROM u GROUP BY 1")
def _(t):
    u = fm.union_spaces({"word": t.words(), "byte2": t.bigrams()})
    return u.groupBy("instance_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("feature").alias("first"), F.max("feature").alias("last"))


@q("fm_stack", f"WITH {FW}, u AS (SELECT lang || '-' || instance_id AS instance_id, feature, value FROM f JOIN documents ON doc_id = instance_id) SELECT instance_id, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM u GROUP BY 1")
def _(t):
    w = t.words().join(t.langs(), "instance_id")
    parts = {x: w.where(F.col("label") == x).drop("label") for x in ("de", "en", "es", "fr")}
    return fm.stack(parts).groupBy("instance_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@q("fm_merge", f"""WITH {FW}, l AS (SELECT DISTINCT feature, lang FROM f JOIN documents ON doc_id = instance_id), d AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx FROM (SELECT DISTINCT feature FROM l WHERE lang = 'fr')),
s AS (SELECT feature, (SELECT max(idx) FROM d) + row_number() OVER (ORDER BY feature) AS idx FROM (SELECT DISTINCT feature FROM l WHERE lang <> 'fr' AND feature NOT IN (SELECT feature FROM d)))
SELECT feature, CAST(idx AS BIGINT) AS idx FROM d UNION ALL SELECT feature, CAST(idx AS BIGINT) FROM s""")
def _(t):
    w = t.words().join(t.langs(), "instance_id")
    return fm.merge_spaces(fm.index_features(w.where("label = 'fr'")), w.where("label <> 'fr'"))


@q("fm_check_ids", f"WITH {FW} SELECT doc_id AS instance_id, 'instances' AS side FROM documents WHERE doc_id NOT IN (SELECT instance_id FROM f)")
def _(t):
    return fm.id_differences(t.words(), t.instances())


BAGS = "x AS (SELECT event_type AS key, count(*) AS na FROM events WHERE user_id % 2 = 0 GROUP BY 1), y AS (SELECT event_type AS key, count(*) AS nb FROM events WHERE user_id % 3 = 0 GROUP BY 1), z AS (SELECT coalesce(x.key, y.key) AS key, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM x FULL JOIN y USING (key))"


def bags(t):
    count = lambda e: e.groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("n"))
    return count(t.events.where("user_id % 2 = 0")), count(t.events.where("user_id % 3 = 0"))


@q("fm_multiset", f"WITH {BAGS} SELECT * FROM (SELECT 'add' AS how, key, CAST(na + nb AS BIGINT) AS n FROM z UNION ALL SELECT 'subtract', key, na - nb FROM z UNION ALL SELECT 'union', key, greatest(na, nb) FROM z UNION ALL SELECT 'intersect', key, least(na, nb) FROM z) WHERE n > 0")
def _(t):
    a, b = bags(t)
    parts = [fm.multiset(a, b, how).select(F.lit(how).alias("how"), "key", "n") for how in ("add", "subtract", "union", "intersect")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@q("fm_most_common", f"WITH {FW} SELECT feature AS key, CAST(sum(value) AS BIGINT) AS n FROM f GROUP BY 1 ORDER BY n DESC, key LIMIT 20")
def _(t):
    return fm.most_common(t.words().groupBy(F.col("feature").alias("key")).agg(F.sum("value").alias("n")), 20)


@q("fm_invert", f"WITH {W}, x AS (SELECT DISTINCT doc_id, unnest(w) AS value FROM w), y AS (SELECT *, CAST((row_number() OVER (PARTITION BY value ORDER BY doc_id) - 1) // 100000 AS INTEGER) AS part FROM x) SELECT value, part, count(*) AS n, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS digest FROM y GROUP BY 1, 2")
def _(t):
    inverted = fm.invert(t.documents.select("doc_id", tx.bow(COLUMN).alias("w")), "doc_id", "w")
    return inverted.select("value", "part", F.size("keys").cast("long").alias("n"), F.md5(F.array_join(F.transform("keys", lambda x: x.cast("string")), ",")).alias("digest"))


@q("fm_stats", f"WITH {FW}, ft AS (SELECT sum(value) AS t FROM f GROUP BY feature), dt AS (SELECT coalesce(sum(value), 0) AS t FROM documents LEFT JOIN f ON doc_id = instance_id GROUP BY doc_id) SELECT (SELECT count(*) FROM ft) AS n_features, round((SELECT avg(t) FROM ft), 6) AS feature_mean, round((SELECT stddev_pop(t) FROM ft), 4) AS feature_std, (SELECT count(*) FROM dt) AS n_docs, round((SELECT avg(t) FROM dt), 6) AS doc_mean, round((SELECT stddev_pop(t) FROM dt), 4) AS doc_std, (SELECT count(*) FROM f) AS n_nonzero")
def _(t):
    s = fm.stats(t.words(), t.instances())
    return s.select("n_features", F.round("feature_mean", 6).alias("feature_mean"), F.round("feature_std", 4).alias("feature_std"), "n_docs", F.round("doc_mean", 6).alias("doc_mean"), F.round("doc_std", 4).alias("doc_std"), "n_nonzero")


@q("fm_histogram", f"WITH {FW}, ft AS (SELECT CAST(sum(value) AS DOUBLE) AS t FROM f GROUP BY feature), e AS (SELECT min(t) AS lo, max(t) AS hi FROM ft) SELECT CAST(CASE WHEN hi > lo THEN least(99, floor((t - lo) * 100 / (hi - lo))) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM ft, e GROUP BY 1")
def _(t):
    return fm.totals_histogram(t.words())


@q("fm_size_histogram", f"WITH {FW}, dt AS (SELECT CAST(sum(value) AS DOUBLE) AS t FROM f GROUP BY instance_id), e AS (SELECT min(t) AS lo, max(t) AS hi FROM dt) SELECT CAST(CASE WHEN hi > lo THEN least(99, floor((t - lo) * 100 / (hi - lo))) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM dt, e GROUP BY 1")
def _(t):
    """Sizes of documents."""
    return fm.totals_histogram(t.words(), by="instance_id")


@q("fm_instance", f"WITH {FW} SELECT feature, value FROM f WHERE instance_id = 7")
def _(t):
    one = t.documents.where("doc_id = 7")  # the filter reaches the scan: one document is tokenised
    return fm.feature_counts(one, tx.bow(COLUMN)).select("feature", "value")


# ---- class maps


@q("cm_to_matrix", f"WITH {ML} SELECT doc_id AS instance_id, CAST(coalesce(max(CASE WHEN label = 'quality' THEN 1 END), 0) AS INTEGER) AS quality, CAST(coalesce(max(CASE WHEN label = 'toxic' THEN 1 END), 0) AS INTEGER) AS toxic FROM documents LEFT JOIN ml ON doc_id = instance_id GROUP BY 1")
def _(t):
    return cl.to_indicator(t.multilabel(), t.instances(), ["quality", "toxic"])


@q("cm_from_matrix", f"WITH {ML} SELECT * FROM ml")
def _(t):
    return cl.from_indicator(t.labels.select(F.col("doc_id").alias("instance_id"), "quality", "toxic"), ["quality", "toxic"])


@q("cm_validate", "SELECT DISTINCT lang AS label FROM documents WHERE lang NOT IN ('de', 'en', 'fr')")
def _(t):
    return cl.superfluous(t.langs(), t.spark.createDataFrame([("de",), ("en",), ("fr",)], "label string"))


@q("cm_dist", "SELECT label, count(lang) AS n FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) s(label) LEFT JOIN documents ON lang = label GROUP BY 1")
def _(t):
    return cl.distribution(t.langs(), t.spark.createDataFrame([(x,) for x in ("de", "en", "es", "fr", "it")], "label string"))


@q("cm_members", "SELECT doc_id AS instance_id FROM documents WHERE lang = 'fr'")
def _(t):
    return t.langs().where("label = 'fr'").select("instance_id")


@q("cm_recode", "SELECT doc_id AS instance_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE 'UNKNOWN' END AS label FROM documents")
def _(t):
    return cl.recode(t.langs(), F.broadcast(t.spark.createDataFrame([("en", "English"), ("de", "German")], "label string, new string")))


@q("cm_recode_pattern", "SELECT doc_id AS instance_id, CASE WHEN lang = 'es' THEN 'UNKNOWN' ELSE lang END AS label FROM documents")
def _(t):
    variants = F.when(F.col("label") == "en", "en-GB").when(F.col("label") == "es", "spanish").otherwise(F.col("label"))
    return cl.recode_pattern(t.langs().withColumn("label", variants))


@q("cm_min_size", "SELECT doc_id AS instance_id, source AS label FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING count(*) >= 50)")
def _(t):
    return cl.drop_small(t.sources(), 50)


@q("cm_is_1ofM", f"WITH {ML}, m AS (SELECT doc_id, count(label) AS k FROM documents LEFT JOIN ml ON instance_id = doc_id GROUP BY 1), s AS (SELECT doc_id, count(lang) AS k FROM documents GROUP BY 1) SELECT (SELECT bool_and(k = 1) FROM m) AS multi, (SELECT bool_and(k = 1) FROM s) AS single")
def _(t):
    one = cl.is_one_of_m(t.langs(), t.instances()).withColumnRenamed("one_of_m", "single")
    return cl.is_one_of_m(t.multilabel(), t.instances()).withColumnRenamed("one_of_m", "multi").crossJoin(one)


@q("cm_stratify", f"WITH {ML} SELECT doc_id AS instance_id, coalesce(string_agg(label, '|' ORDER BY label), '') AS stratum FROM documents LEFT JOIN ml ON doc_id = instance_id GROUP BY 1")
def _(t):
    return cl.strata(t.instances(), t.multilabel())
