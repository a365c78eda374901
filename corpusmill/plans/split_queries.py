"""Queries over splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as sm
from ..operators import splits as sp
from .base import STRATA, TT, alloc_sql, folds_sql, q

ROLE = "CASE WHEN {} THEN 'train' ELSE 'test' END AS role"


@q("sp_partition", f"WITH strata AS (SELECT doc_id AS instance_id, 'all' AS stratum FROM documents), {alloc_sql([5, 3, 2], 'part')} SELECT instance_id, part FROM alloc")
def _(t):
    return sp.allocate(t.instances().withColumn("stratum", F.lit("all")), [5, 3, 2], "part").select("instance_id", "part")


@q("sp_partition_prob", "SELECT doc_id AS instance_id, CAST(CASE WHEN substr(md5('prob|' || doc_id), 1, 8) < '80000000' THEN 0 WHEN substr(md5('prob|' || doc_id), 1, 8) < 'c0000000' THEN 1 ELSE 2 END AS INTEGER) AS part FROM documents")
def _(t):
    return sp.allocate_probably(t.instances(), [2, 1, 1], "prob")


@q("sp_allocate", f"WITH {STRATA}, {alloc_sql([6, 3, 1], 'alloc')} SELECT instance_id, stratum, part FROM alloc")
def _(t):
    return sp.allocate(t.strata(), [6, 3, 1], "alloc")


@q("sp_traintest", f"WITH {TT} SELECT CAST(fold AS INTEGER) AS fold, instance_id, role FROM tt")
def _(t):
    return t.train_test()


@q("sp_crossval", f"WITH {folds_sql()} SELECT CAST(fold AS INTEGER) AS fold, instance_id, CASE WHEN fold = test_fold THEN 'test' ELSE 'train' END AS role FROM folds, (SELECT unnest(generate_series(0, 9)) AS fold)")
def _(t):
    return sp.expand_folds(t.folds(), 10)


LC = [0.1] + [0.9 / 10] * 10


@q("sp_learncurve", f"WITH {STRATA}, {alloc_sql(LC, 'lc')} SELECT CAST(fold AS INTEGER) AS fold, instance_id, CASE WHEN part = 0 THEN 'test' ELSE 'train' END AS role FROM alloc, (SELECT unnest(generate_series(0, 9)) AS fold) WHERE fold >= greatest(part - 1, 0)")
def _(t):
    return sp.learning_curve(t.strata())


@q("sp_preset", "SELECT CAST(0 AS INTEGER) AS fold, doc_id AS instance_id, CASE WHEN source IN ('src0', 'src1') THEN 'test' ELSE 'train' END AS role FROM documents WHERE source <> 'src2'")
def _(t):
    given = t.documents.select(F.col("doc_id").alias("instance_id"), F.when(F.col("source").isin("src0", "src1"), "test").when(F.col("source") == "src2", "unused").otherwise("train").alias("role"))
    return given.where("role <> 'unused'").select(F.lit(0).alias("fold"), "instance_id", "role")


@q("sp_validate", "SELECT event_type, count(*) AS n, 'traintest' AS shape FROM events GROUP BY 1")
def _(t):
    shape = sp.validate_split(["train", "test", "unused"])
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("shape", F.lit(shape))


@q("sp_proportion", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('prop|' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents), s AS (SELECT *, floor(0.3 * n + 1e-9) AS a, floor(0.2 * n + 1e-9) AS b FROM r) SELECT doc_id AS instance_id, CAST(CASE WHEN rn <= n - a - b THEN 0 WHEN rn <= n - b THEN 1 ELSE 2 END AS INTEGER) AS chunk FROM s")
def _(t):
    return sm.proportions(t.instances(), [0.5, 0.3, 0.2], "prop")


DOMAINS = "concat('d', CAST(CAST(substr(source, 4) AS INTEGER) % 4 AS VARCHAR))"


def domain():
    return F.concat(F.lit("d"), (F.substring("source", 4, 9).cast("int") % 4).cast("string"))


@q("sp_leave_one_domain_out", f"WITH d AS (SELECT doc_id AS instance_id, {DOMAINS} AS domain FROM documents) SELECT f.domain AS fold, instance_id, CASE WHEN d.domain = f.domain THEN 'test' ELSE 'train' END AS role FROM d, (SELECT DISTINCT domain FROM d) f")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("instance_id"), domain().alias("domain"))
    return sp.leave_one_domain_out(d, F.col("domain"), F.broadcast(d.select("domain").distinct()))


@q("sp_cross_domain", f"WITH {STRATA} SELECT CAST(0 AS INTEGER) AS fold, doc_id AS instance_id, CASE WHEN {DOMAINS} = 'd0' THEN 'train' ELSE 'test' END AS role FROM documents WHERE {DOMAINS} IN ('d0', 'd1')")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("instance_id"), domain().alias("domain"))
    return sp.cross_domain(d.where("domain = 'd0'"), d.where("domain = 'd1'"))


@q("sp_test_class_only", f"WITH {TT}, cm AS (SELECT doc_id AS instance_id, source AS label FROM documents), seen AS (SELECT DISTINCT label FROM tt JOIN cm USING (instance_id) WHERE role = 'test') SELECT CAST(fold AS INTEGER) AS fold, instance_id, role FROM tt JOIN cm USING (instance_id) WHERE role = 'test' OR label IN (SELECT label FROM seen)")
def _(t):
    return sp.test_class_only(t.train_test(), t.sources())


@q("sp_membership", f"WITH {TT} SELECT doc_id AS instance_id, doc_id IN (SELECT instance_id FROM tt WHERE role = 'test') AS member FROM documents")
def _(t):
    test = t.train_test().where("role = 'test'").select("instance_id", F.lit(True).alias("m"))
    return t.instances().join(test, "instance_id", "left").select("instance_id", F.col("m").isNotNull().alias("member"))


@q("sp_task", f"WITH {TT}, {folds_sql().replace(STRATA + ', ', '').replace('alloc', 'cva')} SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents JOIN tt ON doc_id = instance_id GROUP BY 1")
def _(t):
    """Instances and text of one fold's two roles."""
    rows = t.documents.select(F.col("doc_id").alias("instance_id"), "text").join(t.train_test(), "instance_id")
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


def draw(name: str) -> str:
    return f"CAST(('0x' || substr(md5('{name}|' || draw), 1, 8)) AS BIGINT) / 4294967296.0"


@q("smp_weighted_choice", f"""WITH i AS (SELECT source AS item, CAST(sum(n_chars) AS DOUBLE) AS w FROM documents GROUP BY 1), c AS (SELECT item, (sum(w) OVER (ORDER BY item) - w) / sum(w) OVER () AS lo0, w / sum(w) OVER () AS s FROM i),
b AS (SELECT item, round(lo0 + s, 12) AS hi, round(lo0, 12) AS lo FROM c), d AS (SELECT draw, CAST(('0x' || substr(md5('wc|' || draw), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM (SELECT unnest(generate_series(0, 1999)) AS draw))
SELECT draw, item FROM d JOIN b ON u >= lo AND u < hi""")
def _(t):
    items = t.documents.groupBy(F.col("source").alias("item")).agg(F.sum("n_chars").cast("double").alias("w"))
    return sp.weighted_choice(items, 2000, "wc")


@q("smp_ceil_half", "SELECT doc_id AS instance_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('half|' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE rn <= ceil(n / 2)")
def _(t):
    return sm.ceil_half(t.instances(), "half")


@q("smp_bootstrap_ci", """WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i FROM (SELECT CAST(count(*) AS DOUBLE) AS value FROM documents GROUP BY source)), n AS (SELECT count(*) AS n FROM v),
d AS (SELECT b, k, CAST(floor(CAST(('0x' || substr(md5('boot|' || b || '|' || k), 1, 8)) AS BIGINT) / 4294967296.0 * n) AS BIGINT) AS i FROM (SELECT unnest(generate_series(0, 499)) AS b), (SELECT i AS k FROM v), n),
s AS (SELECT b, sum(value) AS s FROM d JOIN v USING (i) GROUP BY b), r AS (SELECT s, row_number() OVER (ORDER BY s) AS rn FROM s)
SELECT (SELECT s FROM r WHERE rn = 13) AS low, (SELECT s FROM r WHERE rn = 488) AS high""")
def _(t):
    values = t.documents.groupBy("source").agg(F.count("*").cast("double").alias("value"))
    return sm.bootstrap_ci(values, "value", "sum", alpha=0.05, b=500, seed="boot")


@q("smp_bootstrap_pmf", """WITH p AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1), c AS (SELECT label, sum(n) OVER (ORDER BY label) AS hi, sum(n) OVER (ORDER BY label) - n AS lo, sum(n) OVER () AS total FROM p),
d AS (SELECT unnest(generate_series(0, (SELECT max(total) FROM c)::BIGINT - 1)) AS draw), u AS (SELECT draw, floor(CAST(('0x' || substr(md5('pmf|' || draw), 1, 8)) AS BIGINT) / 4294967296.0 * (SELECT max(total) FROM c)) AS x FROM d)
SELECT label, count(*) AS n FROM u JOIN c ON x >= lo AND x < hi GROUP BY 1""")
def _(t):
    return sm.resample_pmf(t.langs().groupBy("label").agg(F.count("*").alias("n")), "pmf")


@q("smp_bootstrap_histogram")
def _(t):
    """Interval of the mean text length over 200 resamples, drawn from the histogram of lengths."""
    lengths = t.documents.groupBy(F.length(F.coalesce("text", F.lit(""))).cast("long").alias("label")).agg(F.count("*").alias("n"))
    return sm.bootstrap_histogram(lengths, b=200)


@q("smp_bootstrap_large")
def _(t):
    """A thousand million draws by the sources' and languages' shares: no row for a draw."""
    return sm.resample_histogram(t.documents.groupBy(F.concat_ws("/", "source", "lang").alias("label")).agg(F.count("*").alias("n")), "large", 1, 10**9)
