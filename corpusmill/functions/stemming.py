"""Helpers that need Python: stems, HTML entities, codecs.  All run in Arrow batches."""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOWELS = "aeiou"
WORD = re.compile(r"\w+")
#: characters of texts whose spans are made at once, and stems that a task keeps
SLICE = 1 << 19
MOST_STEMS = 1 << 16

# Suffix pairs of the published stemming algorithm (Porter 1980), steps 2, 3 and 4.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: the longest suffixes first
LONGEST = [sorted(pairs, key=lambda p: -len(p[0])) for pairs in (STEP2, STEP3)]
LONGEST4 = sorted(STEP4, key=len, reverse=True)


def _shape(word: str) -> str:
    """v for vowels and c for consonants; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in VOWELS or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def porter_stem(word: str) -> str:
    """Stem of a lower-case word by the published rules."""
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word[-1:] == word[-2:-1] and _shape(word)[-1:] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for pairs in LONGEST:
        for end, new in pairs:
            if word.endswith(end):
                if _measure(word[: -len(end)]) > 0:
                    word = word[: -len(end)] + new
                break
    for end in LONGEST4:
        if word.endswith(end):
            stem = word[:-3] if end in ("sion", "tion") else word[: -len(end)]
            if _measure(stem) > 1:
                word = stem
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stem_vocabulary(words: DataFrame, column: str = "token") -> DataFrame:
    """(token, stem) of the distinct tokens: Python sees each word once, not once an occurrence."""

    @F.pandas_udf(StringType())
    def stem(tokens: pd.Series) -> pd.Series:
        return tokens.map(porter_stem)

    return words.select(F.col(column).alias("token")).distinct().select("token", stem("token").alias("stem"))


def span_batches(batches, at: int):
    """Arrow batches with spans as last column; `at`: place of the text.

    A batch goes on in slices of SLICE characters or one text, and spans are flat columns, so what is held at once doesn't grow with
    the rows of a batch; stems of the commonest words are looked up.
    """
    stems: dict[str, str] = {}
    for whole in batches:
        long = pc.fill_null(pc.utf8_length(whole.column(at)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(long) // SLICE
        edges = np.append(np.unique(piece, return_index=True)[1], whole.num_rows)
        for first, last in zip(edges, edges[1:]):
            batch = whole.slice(first, last - first)
            words, starts, ends, found, offsets = [], [], [], [], [0]
            for text in batch.column(at):
                for m in WORD.finditer(text.as_py() or ""):
                    word = m[0]
                    lower = word.lower()
                    if (stem := stems.get(lower)) is None:
                        if len(stems) >= MOST_STEMS:
                            stems.clear()
                        stem = stems[lower] = porter_stem(lower)
                    words.append(word)
                    starts.append(m.start())
                    ends.append(m.end())
                    found.append(stem)
                offsets.append(len(words))
            columns = [pa.array(words, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(found, pa.string())]
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["word", "start", "end", "stem"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], [*batch.schema.names, "spans"])


def stem_spans(texts: DataFrame, text: str = "text") -> DataFrame:
    """`texts` with spans: an array of (word, start, end, stem) of its \\w+ words."""
    kind = "array<struct<word:string,start:int,end:int,stem:string>>"
    at = texts.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + f", spans {kind}"
    return texts.mapInArrow(lambda batches: span_batches(batches, at), schema)


def cut_words(words: pa.StringArray, sizes) -> tuple[pa.StringArray, np.ndarray]:
    """The n-grams of code points of all words, a word's in order of size and place, and how many each word has."""
    words = pc.cast(words, pa.large_string())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset :][: len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    at = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))  # where characters begin
    own = np.searchsorted(at, ends - ends[0])
    counts = np.maximum(0, np.diff(own)[:, None] - np.array(sizes) + 1)
    each = counts.ravel()

    def counting(n):
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    first = counting(each) + np.repeat(np.repeat(own[:-1], len(sizes)), each)
    begin, end = at[first], at[first + np.repeat(np.tile(sizes, len(words)), each)]
    long = end - begin
    made = data[counting(long) + np.repeat(begin, long)]
    offsets = np.append(0, np.cumsum(long)).astype(np.int32)
    return pa.StringArray.from_buffers(len(long), pa.py_buffer(offsets), pa.py_buffer(made)), counts.sum(axis=1)


def gram_batches(batches, at: int, sizes=(2, 3)):
    """Arrow batches with the n-grams of words in place of the words, an array of strings at place `at`; in slices of SLICE characters or one text."""
    for whole in batches:
        words = whole.column(at)
        ends = words.offsets.to_numpy().astype(np.int64)
        flat = words.values.slice(ends[0], ends[-1] - ends[0])
        ends = ends - ends[0]
        long = np.append(0, np.cumsum(pc.utf8_length(flat).to_numpy(zero_copy_only=False)))[ends]
        edges = np.append(np.unique(long[1:] // SLICE, return_index=True)[1], whole.num_rows)
        for first, last in zip(edges, edges[1:]):
            grams, counts = cut_words(flat.slice(ends[first], ends[last] - ends[first]), sizes)
            # a text's grams end where those of its last word do
            offsets = np.append(0, np.cumsum(counts))[ends[first : last + 1] - ends[first]].astype(np.int32)
            batch = whole.slice(first, last - first)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), grams) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)


def with_word_grams(rows: DataFrame, words: str, sizes=(2, 3)) -> DataFrame:
    """`rows` with the character n-grams of its array of words in place of it; no array may be null."""
    at = rows.columns.index(words)
    return rows.mapInArrow(lambda batches: gram_batches(batches, at, sizes), rows.schema)


@F.pandas_udf(StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    """Numeric and named entities become characters; unknown ones stay."""
    return texts.map(lambda t: t if t is None else re.sub(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", lambda m: html.unescape(m[0]), t))


def decode_bytes(frame: DataFrame, data: str, encoding: str, out: str = "text", errors: str = "strict") -> DataFrame:
    """`frame` with its byte column decoded by each row's encoding; `errors`: strict (the job fails) or replace (U+FFFD)."""

    @F.pandas_udf(StringType())
    def decode(values: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else bytes(v).decode(n or "utf-8", errors) for v, n in zip(values, names)], dtype=object)

    return frame.withColumn(out, decode(F.col(data), F.col(encoding)))
