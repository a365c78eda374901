"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1.  Each source s has a weight schedule, here a straight line
w_s(t) = T_s * (1 + a_s * (1 - 2t)) with a slope a_s in [-1, 1]: sources with a_s > 0 are taken
more at the start, those with a_s < 0 more at the end.  Its integral D_s(t) is the source's
cumulative token demand, and D_s(1) = T_s is its target.

A source supplies its documents in hash order, one pass after another.  The copy of a document
that begins after c words of supply is taken at the time when the demand reaches c, so its
training position is the inverse D_s^-1(c).  Documents are range-sorted by position.

The running word counts are two-level: sums per (source, hash bucket), a running sum over the
buckets, and a window inside one bucket only.  A source that holds a third of all rows is thus
dealt over thousands of window groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SEPARATORS, cut, table

#: hex digits of the order hash that name a bucket: 16**3 buckets for each source
BUCKET_DIGITS = 3
MAX_REPEATS = 3


def n_words(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    # separators at either end leave one empty piece each
    pieces = F.split(whole, SEPARATORS)
    blank = (F.get(pieces, F.lit(0)) == "").cast("int") + ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")
    return (F.size(pieces) - blank).cast("long")


def source_targets(sizes: DataFrame, weights: Column, total_share: float = 1.0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Target of each source: its weight's share of all words, at most `max_repeats` times its size.

    `sizes` has (source, source_size), one row for each source (null is a source).  `weights` is a
    column over it that may use `_n`, the source's number in code-point order from 0, null last.
    What sources at their bound can't take goes to the others by weight, until none is above: with
    sources ordered by bound/weight, the bounded ones are a prefix, found by running sums in one
    window over the (small, aggregated) source table.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = sizes.withColumn("source_size", F.col("source_size").cast("long")).withColumn("_n", F.row_number().over(by_name) - 1).withColumn("_w", weights.cast("double"))
    w = w.withColumn("_cap", (F.col("source_size") * max_repeats).cast("double"))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    w = (
        w.withColumn("_total", F.sum("source_size").over(every) * F.lit(float(total_share)))
        .withColumn("_caps", F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        # the water level if all before this source are at their bound and none from it on; it only falls
        # once it is in reach, so the largest one in reach is the level
        .withColumn("_level", (F.col("_total") - F.col("_caps")) / F.col("_rest"))
        .withColumn("_open", F.col("_level") * F.col("_w") <= F.col("_cap"))
        .withColumn("_first", F.max(F.when(F.col("_open"), F.col("_level"))).over(every))
    )
    return w.select(
        *sizes.columns, "_n",
        F.least(F.col("_cap"), F.coalesce(F.col("_first") * F.col("_w"), F.col("_cap"))).alias("target"),
    )


def position(demand: Column, target: Column, slope: Column) -> Column:
    """The time at which T*(t + a*(t - t*t)) reaches `demand`: the smaller root of a quadratic."""
    x = F.least(F.lit(1.0), F.when(target > 0, demand / target).otherwise(F.lit(0.0)))
    b = 1 + slope
    # stable form, also right for slope 0
    return F.when(x <= 0, F.lit(0.0)).otherwise(2 * x / (b + F.sqrt(F.greatest(F.lit(0.0), b * b - 4 * slope * x))))


def mix(docs: DataFrame, weights: Column, slopes: Column, size: Column | None = None, total_share: float = 1.0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """`docs` (doc_id, source, text or a given `size`) with the mix's decision for each row.

    Added columns: size, source_size, target, taken (words that the mix takes, repeats counted; at
    most `max_repeats` times the size), passes (copies, the last one maybe in part), first_position
    (training position of the first copy; null if nothing is taken) and positions (an array with the
    position of each copy).  `weights` and `slopes` are columns over the source table and may
    use `_n`, the source's number, and `source`.

    A source's taken words equal its target, rounded.  Order within a source is by MD5 of doc_id,
    then doc_id, then size, so reruns and any partitioning agree.  Null texts have size 0 and null
    sources are a source of their own, last in order; rows with null doc_id are kept and stand where
    the empty string's hash stands.  Repeated rows are rows of their own.  Other columns pass
    through, but are replaced if they have an added column's name.  An empty table gives an empty
    result.
    """
    added = ("size", "source_size", "target", "taken", "passes", "first_position", "positions")
    rest = [c for c in docs.columns if c not in added]
    rows = docs.select(*rest, (n_words(F.col("text")) if size is None else size).cast("long").alias("size"))
    rows = rows.withColumn("_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # a key that is never null: then the window and the join share one partitioning
    rows = rows.withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    buckets = rows.groupBy("_s", "_b").agg(F.sum("size").alias("_words"), F.first("source").alias("source"))
    targets = source_targets(buckets.groupBy("_s").agg(F.sum("_words").alias("source_size"), F.first("source").alias("source")), weights, total_share, max_repeats)
    targets = targets.withColumn("_slope", slopes.cast("double")).drop("_n", "source")
    before = F.sum("_words").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = buckets.select("_s", "_b", F.coalesce(before, F.lit(0)).alias("_before")).join(targets, "_s")
    inner = Window.partitionBy("_s", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_in", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(starts, ["_s", "_b"])
    start = F.col("_before") + F.col("_in")
    begins = [start + k * F.col("source_size") for k in range(max_repeats)]
    parts = [F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("long") - b)) for b in begins]
    at = [F.when(p > 0, F.round(position(b.cast("double"), F.col("target"), F.col("_slope")), 9)) for p, b in zip(parts, begins)]
    out = out.select(
        *rest, "size", "source_size", "target",
        sum(parts[1:], parts[0]).cast("long").alias("taken"),
        F.filter(F.array(*at), lambda x: x.isNotNull()).alias("positions"),
    )
    return out.select("*", F.size("positions").alias("passes"), F.get("positions", F.lit(0)).alias("first_position"))


def in_training_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row of `columns` for each copy that the mix takes, range-sorted by training position."""
    copies = mixed.select(*columns, F.explode("positions").alias("_position"))
    return copies.orderBy("_position", "doc_id").select(*columns)


def weights() -> Column:
    """1, 2, 3, repeating by the sources' order."""
    return F.col("_n") % 3 + 1


def slopes() -> Column:
    """Early, even and late curricula, repeating by the sources' order."""
    return (1 - F.col("_n") % 3) * 0.5


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sizes are needed for the targets, the buckets and the rows: texts are read once
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return mix(docs, weights(), slopes(), size=F.col("size")).drop("positions").orderBy("first_position", "doc_id")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS n
  FROM d GROUP BY source
), c AS (
  SELECT *, CAST(n % 3 + 1 AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c
), f AS (
  SELECT *, max(CASE WHEN level * w <= cap THEN level END) OVER () AS first FROM l
), t AS (
  SELECT source, source_size, least(cap, coalesce(first * w, cap)) AS target, (1 - n % 3) * 0.5 AS a FROM f
), o AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d
), x AS (
  SELECT o.doc_id, o.source, size, source_size, target, a, start, CAST(round(target) AS BIGINT) AS whole
  FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, greatest(0, least(size, whole - start)) AS p0, greatest(0, least(size, whole - start - source_size)) AS p1,
         greatest(0, least(size, whole - start - 2 * source_size)) AS p2
  FROM x
), y AS (
  SELECT *, CAST(p0 + p1 + p2 AS BIGINT) AS taken,
         CAST((p0 > 0)::INT + (p1 > 0)::INT + (p2 > 0)::INT AS INTEGER) AS passes,
         least(1.0, CASE WHEN target > 0 THEN start / target ELSE 0 END) AS v, 1 + a AS b
  FROM p
)
SELECT doc_id, source, size, source_size, target, taken, passes,
       CASE WHEN taken > 0 THEN round(CASE WHEN v <= 0 THEN 0 ELSE 2 * v / (b + sqrt(greatest(0, b * b - 4 * a * v))) END, 9) END AS first_position
FROM y"""

QUERIES = {"op3_mixing": query}
ORACLES = {"op3_mixing": SQL}
