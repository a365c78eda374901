"""Benchmark decontamination by spaced seeds.

Tokens are hashed.  A seed is a fixed mask over consecutive tokens that reads some positions and
ignores the others, so a substituted word under an ignored position doesn't hide a match.  The
benchmark's seed hashes fill a bitmap of fixed size, which every task gets; a document's seeds that
pass the bitmap are joined with the benchmark's by an ordinary equi-join.  Each hit names a
diagonal (document position less item position), along which the best overlap is found among all
stretches that are identical enough.

The documents are read once and only those with a hit are kept, as token hashes; the benchmark may
be of any size, since the bitmap is a filter and the join decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .tokens import groups, seeds, signed32, token_hashes

#: fixed masks: 1 reads a token, 0 ignores it.  Every overlap of 10 matches and 80 % has a hit of one of these
MASKS = ("111101", "11001101")
MIN_MATCHES = 10
MIN_IDENTITY = 0.8
#: MIN_IDENTITY as a fraction, so that stretches are compared in integers
NUMERATOR, DENOMINATOR = 4, 5
BITMAP_BITS = 24


def _lists(values: np.ndarray, bounds: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def item_seeds(items: DataFrame, text: str, key: str) -> DataFrame:
    """(item, tokens, pos, seed): a row for each text, with its token hashes and arrays of its seeds."""

    def run(batches):
        for keys, texts in groups(batches):
            hashes, at = token_hashes(texts)
            pos, seed, bounds = [], [], [0]
            for i in range(len(texts)):
                own = hashes[at[i] : at[i + 1]]
                for m in MASKS:
                    s = seeds(own, m)
                    seed.append(s)
                    pos.append(np.arange(len(s)))
                bounds.append(bounds[-1] + sum(map(len, seed[-len(MASKS) :])))
            seed, pos, bounds = np.concatenate(seed), np.concatenate(pos), np.array(bounds)
            yield pa.RecordBatch.from_arrays(
                [keys, _lists(signed32(hashes), at, pa.int32()), _lists(pos, bounds, pa.int32()), _lists(seed.view(np.int64), bounds, pa.int64())],
                ["item", "tokens", "pos", "seed"],
            )

    kind = items.schema[key].dataType.simpleString()
    rows = items.where(items[key].isNotNull()).select(items[key].alias("id"), items[text].alias("text"))
    return rows.mapInArrow(run, f"item {kind}, tokens array<int>, pos array<int>, seed array<long>")


def _probes(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << BITMAP_BITS) - 1)
    return (seed & mask).astype(np.int64), (seed >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _bitmap(item_rows: DataFrame) -> np.ndarray:
    """Bits of all seeds of the benchmark.  At most 2**BITMAP_BITS numbers reach the driver, whatever the benchmark's size."""
    mask, shift = (1 << BITMAP_BITS) - 1, 64 - BITMAP_BITS
    seed = item_rows.select(F.explode("seed").alias("s"))
    probes = seed.select(F.explode(F.array(F.col("s").bitwiseAND(mask).cast("int"), F.shiftrightunsigned("s", shift).cast("int"))).alias("bit"))
    bits = np.zeros(1 << BITMAP_BITS, dtype=bool)
    bits[probes.distinct().toPandas()["bit"].to_numpy(dtype=np.int64)] = True
    return np.packbits(bits)


def document_hits(docs: DataFrame, bitmap: np.ndarray, text: str, key: str) -> DataFrame:
    """(doc, tokens, pos, seed) of the documents with a seed that passes the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # proven bound: 2 MB

    def run(batches):
        bits = np.unpackbits(shared.value).astype(bool)
        for keys, texts in groups(batches):
            hashes, at = token_hashes(texts)
            pos, seed = [], []
            for m in MASKS:
                s = seeds(hashes, m)
                p = np.flatnonzero(bits[(s & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)])
                p = p[bits[_probes(s[p])[1]]]
                # a seed must lie in one text
                p = p[np.searchsorted(at, p, side="right") == np.searchsorted(at, p + len(m) - 1, side="right")]
                pos.append(p)
                seed.append(s[p])
            pos, seed = np.concatenate(pos), np.concatenate(seed)
            order = np.argsort(pos, kind="stable")
            pos, seed = pos[order], seed[order]
            owner = np.searchsorted(at, pos, side="right") - 1
            found = np.unique(owner)
            if not len(found):
                continue
            bounds = np.append(np.searchsorted(owner, found), len(owner))
            own = [hashes[at[i] : at[i + 1]] for i in found]
            tokens = _lists(signed32(np.concatenate(own)), np.cumsum([0, *map(len, own)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(found)), tokens, _lists(pos - at[owner], bounds, pa.int32()), _lists(seed.view(np.int64), bounds, pa.int64())],
                ["doc", "tokens", "pos", "seed"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.where(docs[key].isNotNull()).select(docs[key].alias("id"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"doc {kind}, tokens array<int>, pos array<int>, seed array<long>")


def best_overlap(a: np.ndarray, b: np.ndarray, diagonal: int) -> tuple[int, int, int, int]:
    """(start in a, start in b, length, matches) of the stretch of a[i + diagonal] against b[i] with most matches among those identical enough.

    Ties go to the shortest, then the earliest stretch.  All zeros if nothing matches.
    """
    first, last = max(0, -diagonal), min(len(b), len(a) - diagonal)
    if first >= last:
        return 0, 0, 0, 0
    equal = a[first + diagonal : last + diagonal] == b[first:last]
    at = np.flatnonzero(equal)
    if not len(at):
        return 0, 0, 0, 0
    # the best stretch starts and ends with a match.  From match i to match j there are j - i + 1 of
    # at[j] - at[i] + 1 words: enough if up[j] >= down[i], so the first such i is the best for j
    k = np.arange(len(at))
    scaled = DENOMINATOR * k - NUMERATOR * at
    up, down = scaled + DENOMINATOR - NUMERATOR, scaled
    start = np.searchsorted(-np.minimum.accumulate(down), -up)
    matches = k - start + 1
    length = at - at[start] + 1
    end = int(np.lexsort((length, -matches))[0])
    i = int(at[start[end]])
    return first + diagonal + i, first + i, int(length[end]), int(matches[end])


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """(key, item key, doc_start, item_start, n_words, n_matches): the best overlap of each pair that has one.

    An overlap has at least 10 matching tokens, at least 80 % of its length; positions count tokens
    from 0.  Pairs without one, and so clean documents, are absent.  Null and empty texts, and texts
    or items shorter than a mask, match nothing; rows with a null key are left out; very long texts
    are searched whole.  Of repeated rows of one key the best overlap counts.  Ties go to the
    earliest start.  Extra columns are ignored; empty tables give an empty result.
    """
    item_rows = cut(item_seeds(items, item_text, item_key))
    hits = cut(document_hits(docs, _bitmap(item_rows), text, key))
    hits = hits.withColumn("row", F.xxhash64("doc", "tokens"))
    marks = hits.select("doc", "row", F.explode(F.arrays_zip("pos", "seed")).alias("h")).select("doc", "row", F.col("h.pos").alias("p"), F.col("h.seed").alias("seed"))
    known = item_rows.select("item", F.explode(F.arrays_zip("pos", "seed")).alias("h")).select("item", F.col("h.pos").alias("q"), F.col("h.seed").alias("seed"))
    diagonals = marks.join(known, "seed").select("doc", "row", "item", (F.col("p") - F.col("q")).alias("diagonal")).distinct()
    pairs = diagonals.join(hits.select("doc", "row", F.col("tokens").alias("a")), ["doc", "row"]).join(item_rows.select("item", F.col("tokens").alias("b")), "item")

    def run(batches):
        for batch in batches:
            doc, item, diagonal, a, b = batch.columns
            found = []
            for i in range(batch.num_rows):
                found.append(best_overlap(a[i].values.to_numpy(), b[i].values.to_numpy(), diagonal[i].as_py()))
            rows = np.array(found, dtype=np.int64).reshape(-1, 4)
            good = np.flatnonzero((rows[:, 3] >= MIN_MATCHES) & (DENOMINATOR * rows[:, 3] >= NUMERATOR * rows[:, 2]))
            take = pa.array(good)
            yield pa.RecordBatch.from_arrays([doc.take(take), item.take(take), *[pa.array(rows[good, k]) for k in range(4)]], ["doc", "item", "p", "q", "n", "m"])

    kinds = f"doc {hits.schema['doc'].dataType.simpleString()}, item {item_rows.schema['item'].dataType.simpleString()}"
    scored = pairs.select("doc", "item", "diagonal", "a", "b").mapInArrow(run, f"{kinds}, p long, q long, n long, m long")
    best = scored.groupBy("doc", "item").agg(F.min(F.struct((-F.col("m")).alias("m"), "n", "p", "q")).alias("x"))
    return best.select(
        F.col("doc").alias(key), F.col("item").alias(item_key), F.col("x.p").alias("doc_start"), F.col("x.q").alias("item_start"),
        F.col("x.n").alias("n_words"), (-F.col("x.m")).alias("n_matches"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontaminate": query}
ORACLES: dict[str, str] = {}
