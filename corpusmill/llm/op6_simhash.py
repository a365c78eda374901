"""SimHash near-duplicates, found with Golay-code fuzzy hashing.

1. Each text becomes a 64-bit fingerprint of its 3-word shingles.
2. Equal fingerprints form a class (one aggregation with partial sums, so a huge group of copies
   is one row from each task).
3. Classes get keys.  A fingerprint is cut into segments A and B of 23 bits and C of 18 bits; A and
   B are decoded to the Golay codewords near them.  By the pigeonhole principle, two fingerprints
   with at most 3 differing bits agree on at least one of these keys (numbers of differing bits in
   A, B, C in brackets):
     (C, codeword of A) and (C, codeword of B)        C equal: one of A, B has at most 1
     (A, codeword of B) and (B, codeword of A)        C differs, one of A, B equal: the other at most 2
     (codeword of A, half of B, half of C)            1, 1, 1: one half of each is equal
   Every key holds at least 30 bits of the fingerprint.
4. Classes that share a key are joined and verified by their exact distance inside the join, so
   only true links leave it: a key's pairs are compared, but never materialised.
5. Connected components over the links, then back to the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import golay
from .common import components, cut, table

SHINGLE = 3
SEED = 42
DISTANCE = 3
CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """64-bit fingerprint of one text; a bit is 1 if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII blanks split
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n < SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), dtype=np.uint64, count=n - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("id"), docs[text].alias("text")).mapInArrow(run, f"id {kind}, fp long")


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the fingerprint of each row's text, a signed long, as last column _fp."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(at)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], [*batch.schema.names, "_fp"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_fp", LongType())]))


def golay_keys(fps: np.ndarray, made) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of unsigned fingerprints.  `made`: golay.tables()."""
    a, b, c = (fps & 0x7FFFFF).astype(np.int64), (fps >> 23 & 0x7FFFFF).astype(np.int64), (fps >> 46).astype(np.int64)
    near_a, near_b = golay.keys(a, made), golay.keys(b, made)
    made = [(near_a, c), (near_b, c), (near_b, a), (near_a, b)]
    for half_b in (b & 0xFFF, b >> 12 | 1 << 12):
        for half_c in (c & 0x1FF, c >> 9 | 1 << 9):
            made.append((near_a, half_b << 10 | half_c))
    rows, keys = [], []
    for kind, (codeword, exact) in enumerate(made):
        row, at = np.nonzero(codeword >= 0)
        rows.append(row)
        keys.append(np.int64(kind) << 40 | codeword[row, at] << 23 | exact[row])
    return np.concatenate(rows), np.concatenate(keys)


def class_links(classes: DataFrame) -> DataFrame:
    """(a, b): all pairs of classes (rep, fp), of different fp, whose fp differ in at most 3 bits."""

    def run(batches):
        made = golay.tables()
        for batch in batches:
            reps, fps = batch.column(0), batch.column(1)
            for i in range(0, batch.num_rows, 4096):
                rep, fp = reps.slice(i, 4096), fps.slice(i, 4096)
                row, key = golay_keys(fp.to_numpy(zero_copy_only=False).view(np.uint64), made)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(key), rep.take(row), fp.take(row)], ["key", "rep", "fp"])

    kind = classes.schema["rep"].dataType.simpleString()
    keys = classes.select("rep", "fp").mapInArrow(run, f"key long, rep {kind}, fp long")
    one, two = keys.toDF("key", "a", "fa"), keys.toDF("key", "b", "fb")
    close = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= DISTANCE
    # a class has some 40 keys, but Spark sizes their table by the classes' file and would broadcast it
    return one.hint("merge").join(two, "key").where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id), one row for each row of `docs`.

    fingerprint: 16 lowercase hex digits.  component_id: the smallest key that can be reached over
    links of at most 3 differing bits, itself included.  Null and empty texts have fingerprint zero
    and link like any other; texts of fewer words than a shingle are one shingle; very long texts
    are hashed whole.  Rows whose key is null have a fingerprint but no component and link nothing.
    Repeated rows share their component.  Extra columns are ignored; an empty table gives an empty
    result.
    """
    fps = cut(fingerprints(docs, text, key))
    classes = cut(fps.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep")))
    moved = components(class_links(classes))
    final = classes.join(moved, classes.rep == moved.node, "left").select(classes.fp.alias("fp_"), F.coalesce("component", "rep").alias("component_id"))
    found = fps.join(final, F.col("fp") == F.col("fp_"), "left")
    return found.select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def firsts(fps: DataFrame) -> DataFrame:
    """(id, fp) of the first row, by id and then fp, of each near-duplicate group of rows (id, fp).

    Groups are of fingerprints, so rows that share an id without being alike are in different groups.
    """
    classes = cut(fps.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("id")))
    moved = components(class_links(classes.select(F.col("fp").alias("rep"), "fp")))
    groups = classes.join(moved, classes.fp == moved.node, "left").select("id", "fp", F.coalesce("component", "fp").alias("group"))
    return groups.groupBy("group").agg(F.min(F.struct("id", "fp")).alias("first")).select("first.id", "first.fp")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash": query}
ORACLES: dict[str, str] = {}
