"""Queries over token streams and scalar text functions (a digest of each document's stream)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scan
from ..functions import stemming as st
from ..functions import text as tx
from .base import BOW, P, W, q, split_sql

COLUMN = "text"


def digest(t, tokens):
    d = t.documents.select("doc_id", tokens.alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", "\x01")).alias("digest"))


def digest_sql(tokens: str, ctes: str = "", source: str = "documents") -> str:
    return f"WITH {ctes + ', ' if ctes else ''}x AS (SELECT doc_id, {tokens} AS w FROM {source}) SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, chr(1))) AS digest FROM x"


def grams_sql(w: str, n: int, sep: str = "_") -> str:
    joined = f" || '{sep}' || ".join(f"{w}[i + {k}]" for k in range(n)) if sep else " || ".join(f"{w}[i + {k}]" for k in range(n))
    return f"list_transform(generate_series(1, len({w}) - {n - 1}), lambda i: {joined})"


def chars_sql(t: str, n: int) -> str:
    return f"list_transform(generate_series(1, length({t}) - {n - 1}), lambda i: substr({t}, i, {n}))"


CHARS = "w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s).') AS w FROM documents)"
BYTES = "w AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS w FROM documents)"


WS = split_sql("coalesce(text, '')")
NUMBERED = "list_transform({}, lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN 'NUMBER' ELSE t END)"


@q("txt_strip_html", "SELECT page_id, md5(regexp_replace(coalesce(html, ''), '(?s)<[^>]*>', '', 'g')) AS digest FROM pages")
def _(t):
    return t.pages.select("page_id", F.md5(tx.strip_tags(F.col("html"))).alias("digest"))


@q("txt_entities")
def _(t):
    return t.pages.select("page_id", st.decode_entities(tx.strip_tags(F.col("html"))).alias("text")).select("page_id", F.md5("text").alias("digest"), F.length("text").alias("n"))


@q("txt_strip_punct", f"SELECT doc_id, md5(translate(coalesce(text, ''), '{P}', '')) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.strip_punct(COLUMN)).alias("digest"))


@q("txt_decode", "SELECT doc_id, md5(text) AS digest FROM documents")
def _(t):
    """Texts encoded by language and decoded again, each by its own encoding."""
    enc = F.when(F.col("lang") == "en", "utf-8").when(F.col("lang") == "de", "utf-16-le").otherwise("utf-16-be")
    data = F.when(F.col("enc") == "utf-8", F.encode("text", "UTF-8")).when(F.col("enc") == "utf-16-le", F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "UTF-16BE"))
    rows = t.documents.select("doc_id", "text", enc.alias("enc")).withColumn("data", data).drop("text")
    return st.decode_bytes(rows, "data", "enc").select("doc_id", F.md5("text").alias("digest"))


@q("cls_encoding", "SELECT lang, CASE lang WHEN 'en' THEN 'ascii' WHEN 'de' THEN 'latin_1' WHEN 'fr' THEN 'latin_1' ELSE 'UNKNOWN' END AS encoding, count(*) AS n FROM documents GROUP BY ALL")
def _(t):
    alias = t.spark.createDataFrame([("en", "ascii"), ("de", "latin_1"), ("fr", "latin_1")], "lang string, encoding string")
    return t.documents.join(F.broadcast(alias), "lang", "left").groupBy("lang", F.coalesce("encoding", F.lit("UNKNOWN")).alias("encoding")).agg(F.count("*").alias("n"))


@q("tok_whitespace", digest_sql(WS))
def _(t):
    return digest(t, tx.whitespace_tokens(COLUMN))


@q("tok_bow", digest_sql(BOW))
def _(t):
    return digest(t, tx.bow(COLUMN))


@q("tok_number", digest_sql(NUMBERED.format(WS)))
def _(t):
    return digest(t, tx.number_tokens(tx.whitespace_tokens(COLUMN)))


@q("tok_dotw", f"WITH p AS (SELECT page_id AS doc_id, regexp_replace(coalesce(html, ''), '(?s)<[^>]*>', '', 'g') AS text FROM pages), x AS (SELECT doc_id, {NUMBERED.format(BOW)} AS w FROM p) SELECT doc_id AS page_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, chr(1))) AS digest FROM x")
def _(t):
    d = t.pages.select("page_id", tx.day_of_the_week_tokens(F.col("html")).alias("w"))
    return d.select("page_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", "\x01")).alias("digest"))


@q("tok_len_cap", digest_sql(f"list_filter({WS}, lambda t: length(t) <= 10)"))
def _(t):
    return digest(t, tx.cap_length(tx.whitespace_tokens(COLUMN), 10))


@q("tok_stem")
def _(t):
    """Documents' stems: the distinct vocabulary is stemmed and joined back."""
    tokens = t.documents.select("doc_id", F.explode(tx.bow(COLUMN)).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    stems = st.stem_vocabulary(tokens)
    return tokens.join(stems, "token").groupBy("doc_id", "stem").agg(F.sum("n").alias("n"))


@q("tok_stem_spans")
def _(t):
    rows = st.stem_spans(t.documents.select("doc_id", "text"))
    return rows.select("doc_id", F.size("spans").alias("n"), F.md5(F.to_json("spans")).alias("digest"))


@q("tok_perword_ngram", f"""
WITH x AS (SELECT doc_id, list_transform({WS}, lambda w: '_' || lower(regexp_replace(w, '[^\\p{{L}}]', '', 'g')) || '_') AS w FROM documents),
y AS (SELECT doc_id, flatten(list_transform(w, lambda t: list_concat({chars_sql("t", 2)}, {chars_sql("t", 3)}))) AS w FROM x)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, chr(1))) AS digest FROM y""")
def _(t):
    d = st.with_word_grams(t.documents.select("doc_id", tx.perword_words(COLUMN).alias("w")), "w")
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", "\x01")).alias("digest"))


@q("tok_word_ngram", digest_sql(f"list_concat({grams_sql('w', 2)}, {grams_sql('w', 3)})", W, "w"))
def _(t):
    return digest(t, tx.mixed_ngrams(tx.bow(COLUMN), (2, 3)))


@q("tok_stream_ngram", digest_sql(f"list_concat(w, {grams_sql('w', 2)})", W, "w"))
def _(t):
    return digest(t, tx.mixed_ngrams(tx.bow(COLUMN), (1, 2)))


@q("tok_byte_ngram", digest_sql(grams_sql("w", 3, ""), BYTES, "w"))
def _(t):
    return digest(t, tx.byte_ngrams(COLUMN, 3))


@q("tok_codepoint_ngram", digest_sql(f"list_concat(w, {grams_sql('w', 2, '')})", CHARS, "w"))
def _(t):
    return digest(t, F.concat(tx.char_ngrams(COLUMN, 1), tx.char_ngrams(COLUMN, 2)))


KEYWORDS = ["anea", "nea", "ion", "que", "sch"]


@q("tok_keyword_scan", f"WITH {CHARS}, s AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM w), g AS (SELECT doc_id, i, w[i] || w[i + 1] || w[i + 2] AS g3, w[i] || w[i + 1] || w[i + 2] || w[i + 3] AS g4 FROM s), m AS (SELECT doc_id, i, unnest([g3, g4]) AS keyword FROM g) SELECT doc_id, keyword, count(*) AS n, CAST(sum(i - 1) AS BIGINT) AS starts FROM m WHERE keyword IN ('anea', 'nea', 'ion', 'que', 'sch') GROUP BY ALL")
def _(t):
    rows = t.documents.select("doc_id", F.explode(tx.keyword_matches(COLUMN, KEYWORDS)).alias("m"))
    return rows.groupBy("doc_id", F.col("m.keyword").alias("keyword")).agg(F.count("*").alias("n"), F.sum("m.start").alias("starts"))


#: the grams of 4 to 15 characters at each place, each made from the one before
GRAMS = "w[i] || w[i + 1] || w[i + 2] || w[i + 3] AS g4, " + ", ".join(f"g{n - 1} || w[i + {n - 1}] AS g{n}" for n in range(5, 16))
EACH = ", ".join(f"g{n}" for n in range(4, 16))


@q("tok_keyword_many", f"WITH {CHARS}, bw AS MATERIALIZED (SELECT DISTINCT k FROM (SELECT unnest(regexp_split_to_array(coalesce(text, ''), ' ')) AS k FROM benchmark) WHERE length(k) BETWEEN 4 AND 15), s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 3)) AS i FROM w), g AS (SELECT doc_id, i, {GRAMS} FROM s), m AS (SELECT doc_id, i, unnest([{EACH}]) AS k FROM g) SELECT doc_id, count(*) AS n, count(DISTINCT k) AS n_keywords, CAST(sum(i - 1) AS BIGINT) AS starts FROM m JOIN bw USING (k) GROUP BY 1")
def _(t):
    """Every word of 4 to 15 characters of the benchmark, wherever it stands in a document."""
    words = t.benchmark.select(F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("k")).where("length(k) BETWEEN 4 AND 15").distinct()
    # a benchmark is small; the scan refuses a set that isn't
    found = scan.scan(t.documents, [r.k for r in words.collect()])
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("keyword").alias("n_keywords"), F.sum("start").alias("starts"))


@q("tok_map_stream", digest_sql("list_transform(" + BOW + ", lambda t: reverse(t))"))
def _(t):
    return digest(t, F.transform(tx.bow(COLUMN), F.reverse))
