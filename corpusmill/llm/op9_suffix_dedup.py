"""Exact substring dedup by a distributed merge sort of suffixes.

A byte goes if a 100-byte string that covers it also starts earlier.  Sorting all suffixes would
move a hundred times the text; equal 100-byte windows can be found from few of them:

1. Every window has an anchor: the 40-byte string in it with the smallest hash (leftmost of equal
   ones).  Equal windows have the same anchor at the same place, and neighbouring windows mostly
   share one, so there is one anchor in about 31 bytes.  An anchor's item holds the range of
   windows that chose it.
2. Anchors' hashes are exchanged, packed; those that occur once in the corpus can't lie in a
   repeated window and end here.  Repeats inside one task are known there, and only one of them
   travels.
3. For the rest, each task sorts the suffixes that start at its anchors (cut at the end of the
   anchor's last window), drops those whose whole context it has already, front-codes the sorted
   run, and sends it by the hash of the suffix's first 40 bytes.
4. The runs of a bucket are merged with a loser tree that never compares a known common prefix
   again, which also yields the common prefix of neighbours.  With it, and the order of the bytes
   before each anchor, windows at offset d before the anchor are equal if the d bytes before it and
   the 100 - d bytes from it on are: two running counts name both classes, for all suffixes at
   once.  In each class all but the earliest window go.
5. Back to the documents: the union of the removed windows.

Matches are verified byte by byte, hashes only choose what to compare.  A passage that occurs in a
third of all documents gives one suffix for each task and distinct context, not one for each
document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .suffixes import byte_order, common_prefixes, front_code, merge_runs

LENGTH = 100
ANCHOR = 40
SPAN = LENGTH - ANCHOR + 1
#: windows of a text that are hashed together; longer texts are hashed in overlapping blocks
BLOCK = 1 << 20
POSITION = np.uint64((1 << 24) - 1)
ITEMS_AT_ONCE = 1 << 19
MARK = 0xFFFFFFFF
RUN_ITEMS = 1 << 17

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(29))


def anchors(chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray, powers=None) -> tuple[np.ndarray, ...]:
    """Items of the pieces of a byte array: (piece, anchor, first window, last window, hash of the anchor's bytes)."""
    n = len(chars)
    powers = powers if powers is not None else power_tables(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(chars * powers[0][:n], out=sums[1:])
    hashes = _mix((sums[ANCHOR:] - sums[:-ANCHOR]) * powers[1][: n - ANCHOR + 1])
    low = (hashes & ~POSITION) | np.arange(len(hashes), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: -(SPAN - 32)], low[SPAN - 32 :])
    anchor = (low & POSITION).astype(np.int64)
    valid = np.zeros(len(anchor) + 2, dtype=np.int8)
    valid[starts + 1] += 1
    valid[starts + lengths - LENGTH + 2] -= 1
    valid = np.cumsum(valid[1:-1], dtype=np.int8).astype(bool)
    changes = anchor[1:] != anchor[:-1]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | changes
    last = valid.copy()
    last[:-1] &= ~valid[1:] | changes
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    at = anchor[first]
    return np.searchsorted(starts, first, side="right") - 1, at, first, last, hashes[at]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(1, np.uint64)
    return np.concatenate((ones, np.cumprod(np.full(n, _P)))), np.concatenate((ones, np.cumprod(np.full(n, _P_INVERSE))))


def _items(texts):
    """(number of the text, item, hash of the anchor's bytes) of byte strings, a few texts at once, in order.

    An item: anchor's byte in the text << 16 | its distance from the first window << 8 | from the
    last one.  A text's items depend on that text only, and are never dealt over two results.
    """
    powers = power_tables(2 * BLOCK + 4 * LENGTH)
    pieces: list[bytes] = []
    owners: list[tuple[int, int]] = []
    made: list[tuple[np.ndarray, ...]] = []
    size = count = 0

    def hashed():
        lengths = np.array([len(p) for p in pieces])
        starts = np.cumsum(lengths) - lengths
        piece, at, first, last, h = anchors(np.frombuffer(b"".join(pieces), np.uint8), starts, lengths, powers)
        own = np.array(owners, dtype=np.int64)
        return own[piece, 0], (at - starts[piece] + own[piece, 1]) << 16 | (at - first) << 8 | (at - last), h

    for number, data in enumerate(texts):
        for begin in range(0, len(data) - LENGTH + 1, BLOCK):
            pieces.append(data[begin : begin + BLOCK + LENGTH - 1])
            owners.append((number, begin))
            size += len(pieces[-1])
            if size >= BLOCK:
                made.append(hashed())
                count += len(made[-1][0])
                pieces, owners, size = [], [], 0
        if made and not pieces and count >= ITEMS_AT_ONCE:
            yield tuple(map(np.concatenate, zip(*made)))
            made, count = [], 0
    if pieces:
        made.append(hashed())
    if made:
        yield tuple(map(np.concatenate, zip(*made)))


def _ordinals(number: np.ndarray) -> np.ndarray:
    """Place of each item among those of its text."""
    first = np.flatnonzero(np.append(True, number[1:] != number[:-1])[: len(number)])
    return np.arange(len(number)) - np.repeat(first, np.diff(np.append(first, len(number))))


def _planes(values: np.ndarray, n: int) -> bytes:
    """The n low bytes of each number, all first bytes first: high ones hardly vary and compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(n, -1).T
    return out.reshape(-1).view(np.int64)


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _by_bucket(batches):
    """(bucket, list of rows) for rows that are sorted by their first column."""
    bucket, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != bucket and rows:
                yield bucket, rows
                rows = []
            bucket = row[0]
            rows.append(row)
    if rows:
        yield bucket, rows


def _spread(doc: np.ndarray, buckets: int) -> np.ndarray:
    return -1 - (_mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def repeated_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc, ordinal): the items whose anchor's hash occurs elsewhere too.  `docs`: (doc, text).

    48 bits of the hash travel: a stray equal one only makes a candidate that finds no match.
    """

    def pack(batches):
        ids: list[int] = []

        def texts():
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids.append(doc)
                    yield text.as_py().encode("utf-8", "surrogatepass")

        def rows(bucket, h, doc, ordinal):
            order = np.argsort(bucket, kind="stable")
            keys, starts = np.unique(bucket[order], return_index=True)
            out = [[], [], []]
            for s, e in zip(starts, np.append(starts[1:], len(order))):
                own = order[s:e]
                out[0].append(_planes(h[own].view(np.int64), 6))
                out[1].append(_squeeze(_planes(np.diff(doc[own], prepend=0), 8)))
                out[2].append(_squeeze(_planes(ordinal[own], 4)))
            for i in range(0, len(keys), 64):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 64].astype(np.int32)), *[pa.array(c[i : i + 64], pa.binary()) for c in out]], ["bucket", "h", "doc", "ordinal"])

        for number, _, h in _items(texts()):
            ordinal, doc = _ordinals(number), np.array(ids, dtype=np.int64)[number]
            h = h >> np.uint64(16)
            order = np.argsort(h, kind="stable")
            same = np.append(h[order][1:] == h[order][:-1], False)
            first = np.append(True, ~same[:-1])
            known, once = np.zeros(len(h), bool), np.zeros(len(h), bool)
            # of repeats in this task one goes on, marked: others need to hear of it, it needs to hear nothing
            known[order] = same | np.append(False, same[:-1])
            once[order] = first
            yield from rows(_spread(doc[known], buckets), h[known], doc[known], ordinal[known])
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            yield from rows(bucket[once], h[once], doc[once], np.where(known, MARK, ordinal)[once])

    def find(batches):
        for bucket, rows in _by_bucket(batches):
            doc = np.concatenate([np.cumsum(_from_planes(_unsqueeze(r[2]), 8)) for r in rows])
            ordinal = np.concatenate([_from_planes(_unsqueeze(r[3]), 4) for r in rows])
            if bucket >= 0:
                h = np.concatenate([_from_planes(r[1], 6) for r in rows])
                order = np.argsort(h, kind="stable")
                same = np.append(h[order][1:] == h[order][:-1], False)
                again = order[same | np.append(False, same[:-1])]
                again = again[ordinal[again] != MARK]
                doc, ordinal = doc[again], ordinal[again]
            for i in range(0, len(doc), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(ordinal[s].astype(np.int32))], ["doc", "ordinal"])

    packed = docs.mapInArrow(pack, "bucket int, h binary, doc binary, ordinal binary")
    return _dealt(packed).mapInArrow(find, "doc long, ordinal int")


def _dealt(packed: DataFrame) -> DataFrame:
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket")


def _mask(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Bits last..first set: the windows at these distances before the anchor."""
    one = np.uint64(1)
    return ((one << (first + 1).astype(np.uint64)) - one) & ~((one << last.astype(np.uint64)) - one)


def _contexts(data: bytes, at: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes from each anchor `at` on (100 wide) and before it, backwards (60 wide), zeros beyond its windows."""
    padded = np.frombuffer(bytes(SPAN) + data + bytes(LENGTH), np.uint8)
    right = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)[at + SPAN]
    right *= np.arange(LENGTH) < (LENGTH - (item & 0xFF))[:, None]
    left = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, SPAN - 1)[at + 1][:, ::-1])
    left *= np.arange(SPAN - 1) < (item >> 8 & 0xFF)[:, None]
    return right, left


def _run(doc, th, item, right, left):
    """Sort one run; (keep, gone): indices in suffix order, and those whose whole context an earlier document here has."""
    order = np.lexsort((item, th, doc))
    whole = np.concatenate((right[order], left[order], (item[order] & 0xFFFF)[:, None].astype(">u2").view(np.uint8)), axis=1)
    by_bytes = byte_order(whole)
    repeat = common_prefixes(whole[by_bytes]) == whole.shape[1]
    return order[by_bytes[~repeat]], order[by_bytes[repeat]]


def repeated_windows(found: DataFrame, buckets: int) -> DataFrame:
    """(doc, th, at, mask): windows that also start earlier; bit d of mask is the one d bytes before `at`.

    `found`: (doc, th, text, ordinals).
    """

    def sort(batches):
        names = ["bucket", "doc", "th", "item", "shared", "rest", "left"]
        held: list[tuple] = []
        count = 0

        def flush():
            doc, th, item, right, left = map(np.concatenate, zip(*held))
            keep, gone = _run(doc, th, item, right, left)
            mask = _mask(item[gone] >> 8 & 0xFF, item[gone] & 0xFF)
            bucket = _spread(doc[gone], buckets)
            for b in np.unique(bucket):
                own = gone[bucket == b]
                parts = (_planes(doc[own], 8), _planes(th[own], 8), _planes(item[own], 8), mask[bucket == b].tobytes(), b"", b"")
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32())] + [pa.array([_squeeze(x)], pa.binary()) for x in parts], names)
            doc, th, item, right, left = doc[keep], th[keep], item[keep], right[keep], left[keep]
            weights = np.cumprod(np.full(ANCHOR, _P))
            bucket = (_mix((right[:, :ANCHOR].astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)) % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(bucket):
                own = np.flatnonzero(bucket == b)
                shared, rest = front_code(right[own], LENGTH - (item[own] & 0xFF))
                before = left[own][np.arange(SPAN - 1) < (item[own] >> 8 & 0xFF)[:, None]].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32())] + [pa.array([_squeeze(x)], pa.binary()) for x in (_planes(doc[own], 8), _planes(th[own], 8), _planes(item[own], 8), shared.tobytes(), rest, before)], names
                )

        waiting: list[tuple] = []

        def texts():
            for batch in batches:
                for d, t, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                    data = text.as_py().encode("utf-8", "surrogatepass")
                    waiting.append((d, t, data, own.values.to_numpy()))
                    yield data

        done = 0  # texts that are gone from `waiting`
        for number, item, _ in _items(texts()):
            number, ordinal = number - done, _ordinals(number)
            last = int(number[-1])
            wanted = np.concatenate([np.int64(i) << 32 | w[3].astype(np.int64) for i, w in enumerate(waiting[: last + 1])])
            own = np.flatnonzero(np.isin(number << 32 | ordinal, wanted))
            number, item = number[own], item[own]
            starts = np.cumsum([0, *(len(w[2]) for w in waiting[: last + 1])])
            data = b"".join(w[2] for w in waiting[: last + 1])
            doc, th = (np.array([w[c] for w in waiting[: last + 1]], dtype=np.int64)[number] for c in (0, 1))
            for i in range(0, len(item), RUN_ITEMS):
                s = slice(i, i + RUN_ITEMS)
                held.append((doc[s], th[s], item[s], *_contexts(data, starts[number[s]] + (item[s] >> 16), item[s])))
                count += len(held[-1][0])
                if count >= RUN_ITEMS:
                    yield from flush()
                    held, count = [], 0
            del waiting[: last + 1]
            done += last + 1
        if held:
            yield from flush()

    def merge(batches):
        for bucket, rows in _by_bucket(batches):
            arrays = [[_from_planes(_unsqueeze(r[c]), 8) for r in rows] for c in (1, 2, 3)]
            doc, th, item = map(np.concatenate, arrays)
            if bucket < 0:
                mask = np.concatenate([np.frombuffer(_unsqueeze(r[4]), np.uint64) for r in rows])
            else:
                runs = [(np.frombuffer(_unsqueeze(r[4]), np.uint8), LENGTH - (i & 0xFF), _unsqueeze(r[5])) for r, i in zip(rows, arrays[2])]
                run, shared, rank = merge_runs(runs, LENGTH)
                order = (np.cumsum([0, *map(len, arrays[0])])[run] + rank) if len(run) else np.zeros(0, np.int64)
                before = item >> 8 & 0xFF
                left = np.zeros((len(item), SPAN - 1), np.uint8)
                left[np.arange(SPAN - 1) < before[:, None]] = np.frombuffer(b"".join(_unsqueeze(r[6]) for r in rows), np.uint8)
                mask = np.zeros(len(item), np.uint64)
                mask[order] = later_windows(shared, left[order], doc[order], th[order], item[order])
            some = np.flatnonzero(mask)
            for i in range(0, len(some), 1 << 16):
                s = some[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(th[s]), pa.array(item[s] >> 16), pa.array(mask[s].view(np.int64))], ["doc", "th", "at", "mask"])

    packed = found.mapInArrow(sort, "bucket int, doc binary, th binary, item binary, shared binary, rest binary, left binary")
    return _dealt(packed).mapInArrow(merge, "doc long, th long, at long, mask long")


def later_windows(shared: np.ndarray, left: np.ndarray, doc: np.ndarray, th: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Mask of each suffix's windows that an earlier suffix has too; the arrays are in suffix order.

    `shared`: common prefix of each suffix with the one before.  `left`: the bytes before it, backwards.
    """
    mask = np.zeros(len(item), np.uint64)
    group = shared >= ANCHOR
    use = np.flatnonzero(group | np.append(group[1:], False))
    if not len(use):
        return mask
    # dropping a suffix that is alone in its group leaves a break on either side of it
    shared, left = np.where(group[use], shared[use], 0), left[use]
    by_left = byte_order(left)
    left_shared = common_prefixes(left[by_left])
    early = np.lexsort((item[use] >> 16, th[use], doc[use]))
    first, last = item[use] >> 8 & 0xFF, item[use] & 0xFF
    found = np.zeros(len(use), np.uint64)
    left_class = np.empty(len(use), np.int64)
    for d in range(SPAN):
        own = early[(first[early] >= d) & (last[early] <= d)]
        if len(own) < 2:
            continue
        right_class = np.cumsum(shared < LENGTH - d)
        left_class[by_left] = np.cumsum(left_shared < d)
        _, earliest = np.unique(right_class[own] * np.int64(len(use) + 1) + left_class[own], return_index=True)
        later = np.ones(len(own), bool)
        later[earliest] = False
        found[own[later]] |= np.uint64(1) << np.uint64(d)
    mask[use] = found
    return mask


def remove(data: np.ndarray, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which bytes of a text go."""
    bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, d = np.nonzero(bits)
    starts = at[row] - d
    steps = np.zeros(len(data) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + LENGTH, -1)
    return np.cumsum(steps[:-1]) > 0


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of `docs`; on request kept_text too.

    kept_text is the kept bytes as UTF-8, with U+FFFD where a character was cut in two.

    Null and empty texts have no bytes; texts under 100 bytes lose nothing; very long texts are
    treated whole.  Earlier means a smaller key, or in one text an earlier start.  Rows that repeat
    key and text are one document, and each gets its result; rows with one key and different texts
    are ordered by a hash of the text.  Rows with a null key keep all bytes and cause no removal.
    Extra columns are ignored; an empty table gives an empty result.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[key].cast("long").alias("doc"), F.xxhash64(docs[text]).alias("th"), F.coalesce(docs[text], F.lit("")).alias("text"))
    # both joins are by document alone, over the same rows: the texts are shuffled once and used twice
    rows, others = rows.where("doc IS NOT NULL"), rows.where("doc IS NULL")
    again = repeated_anchors(rows.select("doc", "text"), 4 * parts).groupBy("doc").agg(F.collect_list("ordinal").alias("ordinals"))
    windows = repeated_windows(rows.join(again, "doc").select("doc", "th", "text", "ordinals"), 4 * parts)
    windows = windows.groupBy("doc").agg(F.collect_list(F.struct("th", "at", "mask")).alias("w"))
    kind = docs.schema[key].dataType.simpleString()

    def finish(batches):
        for batch in batches:
            out = []
            for data, at, mask in zip(batch.column(1), batch.column(2), batch.column(3)):
                chars = np.frombuffer(data.as_py().encode("utf-8", "surrogatepass"), np.uint8)
                if at.is_valid and len(at.values):
                    gone = remove(chars, at.values.to_numpy(), mask.values.to_numpy().view(np.uint64))
                else:
                    gone = np.zeros(len(chars), bool)
                kept = chars[~gone].tobytes()
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
                out.append((len(chars), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            columns = list(zip(*out)) if out else [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    own = F.filter("w", lambda x: x["th"] == F.col("th"))
    joined = rows.join(windows, "doc", "left").withColumn("w", own).select("doc", "text", F.col("w.at").alias("at"), F.col("w.mask").alias("mask"))
    joined = joined.unionByName(others.select("doc", "text"), allowMissingColumns=True)
    done = joined.mapInArrow(finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    out = done.select(F.col("id").cast(kind).alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
    return out if with_text else out.drop("kept_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op9_suffix_dedup": query}
ORACLES: dict[str, str] = {}
