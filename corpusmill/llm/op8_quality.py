"""Quality rules: a threshold table compiled into one Spark projection.

All counts come from built-in array functions inside the row, so there is no shuffle, no user
function and no state beyond one document: the work is one pass over the text at any scale.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, words

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from has have he in is it its not of on or that the this to was were which with you "
    "au aux ce dans de des du elle en est et il la le les leur mais ou par pas pour qui que se son sur un une "
    "als auf aus bei das dem den der des die ein eine er es für im ist mit nicht sich sie und von wie zu zum "
    "al como con del el ella es está ha lo los las más no para pero por sin su sus una y"
).split()

WINDOW = 8


class Rule(NamedTuple):
    """A document fails if the measure is below `low` or above `high`; texts under `min_words` are exempt."""

    name: str
    numerator: str
    denominator: str
    low: float | None
    high: float | None
    min_words: int = 0


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.1),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.01, None, 60),
)
MIN_WORDS = 20
REPEAT_PERCENT = 30


def repeat_words(w):
    """Number of words in 8-word windows that occur at least twice in the array `w`."""

    def of_hashes(h):
        def of_sorted(s):
            again = F.filter(
                s,
                lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            )
            starts = F.sort_array(F.transform(again, lambda x: x["p"]))
            # each window start adds its 8 words less those that the next start covers too
            return let(
                starts,
                lambda p: F.aggregate(
                    F.sequence(F.lit(0), F.size(p) - 1),
                    F.lit(0).cast("long"),
                    lambda total, i: total + F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - F.get(p, i), F.lit(WINDOW))),
                ),
            )

        entries = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(entries, of_sorted))

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, of_hashes))


def measures(text):
    """Struct of the counts of one text.  A null text counts as an empty one."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    def both(m):
        return let(lines, lambda x: F.struct(
            *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_stop_words")],
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ))

    return let(let(words(text), of), both)


def compile_rules(rules=RULES):
    """One boolean column over the measures: true if every rule of the table holds."""
    verdict = F.lit(True)
    for r in rules:
        if r.numerator == r.denominator:
            raise ValueError(f"{r.name} compares a measure with itself")
        ok = F.lit(True)
        # ratios are compared as products, so that a zero denominator needs no special case
        if r.low is not None:
            ok = ok & (F.col(r.numerator) >= F.lit(r.low) * F.col(r.denominator))
        if r.high is not None:
            ok = ok & (F.col(r.numerator) <= F.lit(r.high) * F.col(r.denominator))
        verdict = verdict & (ok if not r.min_words else ((F.col("n_words") < r.min_words) | ok))
    return verdict


def assess(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """`docs` with the measures, base_failed and kept.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that
    equal an earlier line), n_repeat_words (words in 8-word windows found twice or more),
    n_stop_words and n_lines are whole counts over the whole text.  base_failed: fewer than 20
    words, or over 30 % of them in repeated windows.  kept: not base_failed, and every rule holds.

    Null and empty texts have all counts 0 and fail.  Very long texts are counted whole.  Repeated
    rows are judged each for itself; an empty table gives an empty result.  Other columns pass
    through; columns that have the name of a measure are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines"]
    rest = [c for c in docs.columns if c not in {*names, "_m", "base_failed", "kept"}]
    measured = docs.withColumn("_m", measures(docs[text])).select(*rest, "_m")
    counted = measured.select(*rest, *[F.col(f"_m.{c}").alias(c) for c in names])
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return counted.select("*", base.alias("base_failed"), (~base & compile_rules(rules)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assess(docs).drop("text")


_STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
_BAND_SQL = " AND ".join(
    "(" + " AND ".join(
        ([f"{r.numerator} >= CAST({r.low} AS DOUBLE) * {r.denominator}"] if r.low is not None else [])
        + ([f"{r.numerator} <= CAST({r.high} AS DOUBLE) * {r.denominator}"] if r.high is not None else [])
    ) + (f" OR n_words < {r.min_words}" if r.min_words else "") + ")"
    for r in RULES
)
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w WHERE len(w) >= 8)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), covered AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM again) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL}))) AS BIGINT) AS n_stop_words,
         CAST(len(lines) AS BIGINT) AS n_lines
  FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m
)
SELECT *, NOT base_failed AND {_BAND_SQL} AS kept FROM b"""

QUERIES = {"op8_quality": query}
ORACLES = {"op8_quality": SQL}
