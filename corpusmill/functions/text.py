"""Token streams as Column functions: each takes a string column (or an array of tokens) and returns an array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: ASCII punctuation
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BLANKS = r"[ \t\n\r\f\x0B]+"


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and use it many times inside `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip_tags(text: Column) -> Column:
    """Markup tags go; what stands between them stays, contents of scripts too."""
    return F.regexp_replace(text_or_empty(text), r"(?s)<[^>]*>", "")


def strip_punct(text: Column) -> Column:
    """ASCII punctuation is deleted, not replaced by blanks."""
    return F.translate(text_or_empty(text), PUNCTUATION, "")


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text_or_empty(text), BLANKS), lambda t: t != "")


def bow(text: Column) -> Column:
    """Lower case, without punctuation, split at blanks."""
    return whitespace_tokens(strip_punct(F.lower(text)))


def number_tokens(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]+$"), F.lit("NUMBER")).otherwise(t))


def day_of_the_week_tokens(text: Column) -> Column:
    """Tags stripped, bag of words, numbers folded."""
    return number_tokens(bow(strip_tags(text)))


def cap_length(tokens: Column, most: int = 100) -> Column:
    return F.filter(tokens, lambda t: F.length(t) <= most)


def ngrams(tokens: Column, n: int, sep: str = "_") -> Column:
    """n-grams of a token array, joined; none if there are fewer tokens than n."""
    empty = F.array().cast("array<string>")
    return let(
        tokens,
        lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), sep))).otherwise(empty),
    )


def mixed_ngrams(tokens: Column, sizes, sep: str = "_") -> Column:
    return let(tokens, lambda w: F.concat(*[ngrams(w, n, sep) for n in sizes]))


def characters(text: Column) -> Column:
    """Code points of a text."""
    return F.filter(F.split(text_or_empty(text), ""), lambda c: c != "")


def char_ngrams(text: Column, n: int) -> Column:
    """Code-point n-grams.  Over an array of characters: finding a place in a string is linear in it."""
    return characters(text) if n == 1 else ngrams(characters(text), n, "")


def byte_ngrams(text: Column, n: int) -> Column:
    """Byte n-grams of the UTF-8 form, as upper-case hex.  Pieces of a binary are cut without searching their place."""
    empty = F.array().cast("array<string>")
    return let(
        F.encode(text_or_empty(text), "UTF-8"),
        lambda b: F.when(F.octet_length(b) >= n, F.transform(F.sequence(F.lit(1), F.octet_length(b) - n + 1), lambda i: F.hex(F.substring(b, i, n)))).otherwise(empty),
    )


def perword_words(text: Column) -> Column:
    """The blank-separated words: letters only, in lower case, between two underscores.  Letters are kept in the text as a whole, not word by word."""
    mark = "_"  # stands for what a word has besides letters, so that a word without any stays one
    marked = F.regexp_replace(text_or_empty(text), r"[^\p{L} \t\n\r\f\x0B]+", mark)
    kept = F.lower(F.regexp_replace(marked, r"(?<=[^ \t\n\r\f\x0B])_|_(?=[^ \t\n\r\f\x0B])", ""))
    return F.transform(whitespace_tokens(kept), lambda w: F.when(w == mark, F.lit("__")).otherwise(F.concat(F.lit("_"), w, F.lit("_"))))


def perword_ngrams(text: Column, sizes=(2, 3)) -> Column:
    """Character n-grams of each of perword_words.  For many texts, stemming.with_word_grams makes the same of these words sooner."""

    def of_word(word):
        return F.concat(*[char_ngrams(word, n) for n in sizes])

    return F.flatten(F.transform(perword_words(text), of_word))


def keyword_matches(text: Column, keywords: list[str]) -> Column:
    """All occurrences of keywords, overlapping ones too: an array of (start from 0, keyword), sorted.

    One pass over the n-grams for each distinct keyword length.
    """
    by_length: dict[int, list[str]] = {}
    for k in sorted(set(keywords)):
        if k:
            by_length.setdefault(len(k), []).append(k)

    def one_of(own):
        return lambda m: m["keyword"].isin(*own)

    def of(chars):
        found = []
        for n, own in by_length.items():
            grams = F.transform(ngrams(chars, n, ""), lambda g, i: F.struct(i.alias("start"), g.alias("keyword")))
            found.append(F.filter(grams, one_of(own)))
        return F.array_sort(F.concat(*found))

    return let(characters(text), of)
