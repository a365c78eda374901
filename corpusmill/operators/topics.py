"""Topics by collapsed Gibbs sampling, a sweep for each pass over the documents.

A cell is a word of a document with its count; its tokens are spread over topics.  A sweep takes
each document's cells in turn: the cell's tokens are taken out, and drawn anew by
(topic's share of the document + alpha) * (word's share of the topic + beta).  The document's own
counts are up to date at each draw; those of words and topics over all documents are the ones that
the sweep began with, less what the document itself had.  After a sweep they are added up again.

So documents don't wait for each other, and a document's draws depend on the seed, the sweep and its
id only: results don't depend on partitioning, and a lost task draws the same again.  The table of
words and topics is broadcast; its size is checked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stored
from .features import index_features

#: words times topics
MOST_CELLS = 50_000 * 200
#: numbers of words and topics that documents swept together have; tokens drawn at once
CELLS, TOKENS = 1 << 21, 1 << 16
STATE = "id string, w array<int>, n array<int>, t array<int>, k array<int>"


def _uniform(base: np.ndarray, number: np.ndarray) -> np.ndarray:
    """In [0, 1): the draw of that number in the stream of each base (SplitMix64, whose state is a counter)."""
    with np.errstate(over="ignore"):
        z = base + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((z ^ z >> np.uint64(31)) >> np.uint64(11)) * 2.0**-53


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and where each list begins, the last one's end included."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


def _drawn(p: np.ndarray, n: np.ndarray, base: np.ndarray, before: np.ndarray) -> np.ndarray:
    """n tokens of each row spread over topics by the row's weights p; the row's stream `base` goes on after `before` draws."""
    k = p.shape[1]
    steps = np.cumsum(p, axis=1)
    out = np.zeros(p.size, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    for s in range(0, len(row), TOKENS):
        r = row[s : s + TOKENS]
        u = _uniform(base[r], before[r] + inside[s : s + TOKENS]) * steps[r, -1]
        out += np.bincount(r * k + np.minimum((steps[r] <= u[:, None]).sum(axis=1), k - 1), minlength=p.size)
    return out.reshape(p.shape)


def _swept(w, n, begin, spread, base, model, alpha: float, beta: float) -> np.ndarray:
    """`spread` (cell, topic) of documents drawn anew, each document's cells in turn, all documents abreast.  `begin`: where each one's cells begin, and the end."""
    long = np.diff(begin)
    order = np.argsort(-long, kind="stable")  # those that still have cells come first
    first, long, base = begin[:-1][order], long[order], base[order]
    before = np.cumsum(n) - n
    before = before - np.repeat(before[begin[:-1]], np.diff(begin))
    own = np.add.reduceat(spread, begin[:-1], axis=0)[order].astype(np.float64)
    if model is not None:
        words, totals = model
        rest = totals - own + words.shape[0] * beta
    for c in range(int(long[0])):
        m = int(np.searchsorted(-long, -c, side="left"))  # documents of more than c cells
        cell = first[:m] + c
        if model is None:
            p = np.ones((m, spread.shape[1]))
        else:
            old = spread[cell]
            own[:m] -= old
            p = (own[:m] + alpha) * (words[w[cell]] - old + beta) / (rest[:m] + own[:m])
        spread[cell] = new = _drawn(p, n[cell], base[:m], before[cell])
        if model is not None:
            own[:m] += new
    return spread


def _sweep(state: DataFrame, counts: np.ndarray | None, k: int, alpha: float, beta: float, seed: str, number: int) -> DataFrame:
    """The next state of all documents: id; words w with counts n; and, for each word in turn, n spread over topics (t, k: topic and tokens, a cell after the other)."""
    spark = state.sparkSession
    shared = None if counts is None else spark.sparkContext.broadcast((counts, counts.sum(axis=0)))

    def run(batches):
        model = None if shared is None else shared.value
        for whole in batches:
            # documents that are swept together: some CELLS of word and topic
            piece = np.diff(whole.column(1).offsets.to_numpy()).astype(np.int64).cumsum() * k // CELLS
            edges = np.append(np.unique(piece, return_index=True)[1], whole.num_rows)
            for start, stop in zip(edges, edges[1:]):
                batch = whole.slice(start, stop - start)
                (w, begin), (n, _), (t, _), (held, _) = (_flat(batch.column(c)) for c in (1, 2, 3, 4))
                spread = np.zeros((len(w), k), np.int64)
                if model is not None:
                    # t and held list each cell's topics; cells follow each other
                    spread[np.searchsorted(np.cumsum(n, dtype=np.int64), np.cumsum(held, dtype=np.int64) - 1, side="right"), t] = held
                keys = b"".join(hashlib.md5(f"{seed}|{number}|{key}".encode()).digest() for key in batch.column(0).to_pylist())
                base = np.bitwise_xor.reduce(np.frombuffer(keys, "<u8").reshape(-1, 2), axis=1)
                spread = _swept(w, n.astype(np.int64), begin, spread, base, model, alpha, beta)
                at, topic = np.nonzero(spread)
                ends = pa.array(np.searchsorted(at, begin).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (topic, spread[at, topic])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], ["id", "w", "n", "t", "k"])

    return state.mapInArrow(run, STATE)


def _counts(state: DataFrame, k: int, size: int) -> np.ndarray:
    """Tokens by word and topic over all documents: size * k numbers, whatever the number of documents."""

    def run(batches):
        total = np.zeros((size, k), np.int64)
        for batch in batches:
            w, n, t, held = (_flat(batch.column(c))[0] for c in (1, 2, 3, 4))
            cell = np.searchsorted(np.cumsum(n, dtype=np.int64), np.cumsum(held, dtype=np.int64) - 1, side="right")
            np.add.at(total.reshape(-1), w[cell].astype(np.int64) * k + t, held.astype(np.int64))
        word, topic = np.nonzero(total)
        for s in range(0, len(word), 1 << 16):
            a, b = word[s : s + (1 << 16)], topic[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], ["word", "topic", "n"])

    sums = state.mapInArrow(run, "word int, topic int, n long").groupBy("word", "topic").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((size, k), np.float64)
    out[sums["word"], sums["topic"]] = sums["n"]
    return out


def gibbs_topics(features: DataFrame, k: int = 100, sweeps: int = 100, alpha: float | None = None, beta: float = 0.1, seed: str = "topics") -> DataFrame:
    """(instance_id, feature, value): topic proportions in place of features (instance_id, feature, value), values whole and positive.

    alpha is 50 / k unless given.  Instances without features have no topics.  Cull the features
    first: the space times k is bounded.
    """
    alpha = 50 / k if alpha is None else alpha
    space = stored(index_features(features))
    size = space.count()
    if size * k > MOST_CELLS:
        raise ValueError(f"{size} features and {k} topics make a table of more than {MOST_CELLS} cells")
    kind = dict(features.dtypes)["instance_id"]
    cells = features.join(F.broadcast(space), "feature").select("instance_id", F.struct(F.col("idx").cast("int").alias("w"), F.col("value").cast("int").alias("n")).alias("c"))
    docs = cells.groupBy("instance_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    none = F.array().cast("array<int>")
    state = docs.select(F.col("instance_id").cast("string").alias("id"), F.col("c.w").alias("w"), F.col("c.n").alias("n"), none.alias("t"), none.alias("k"))
    counts = None
    for number in range(sweeps + 1):
        state = stored(_sweep(state, counts, k, alpha, beta, seed, number))
        if number < sweeps:
            counts = _counts(state, k, size)
    # shares of topics: tokens by topic, smoothed
    zeros = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(i.cast("int").alias("t"), F.lit(0).alias("k")))
    every = state.select("id", F.explode(F.concat(F.arrays_zip("t", "k"), zeros)).alias("x")).groupBy("id", F.col("x.t").alias("topic")).agg(F.sum("x.k").alias("n"))
    size_of = state.select("id", F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + x).alias("len"))
    share = (F.col("n") + alpha) / (F.col("len") + k * alpha)
    return every.join(size_of, "id").select(F.col("id").cast(kind).alias("instance_id"), F.concat(F.lit("topic"), F.col("topic").cast("string")).alias("feature"), share.alias("value"))
