"""Byte-level BPE: texts to token ids and back, with the tokenizers library over Arrow batches.

Vocabulary and merges come from a rank file (base64 of a token's bytes, and its rank, on each line),
whose path is a parameter.  The library works on characters, so each byte is shown as one: printable
bytes as themselves, the others as characters from 256 on.  A pair of tokens may be merged if its
bytes are a token; where several pairs make one token, the library ranks the pairs one by one, the
rank file all alike.  This matters only where such pairs overlap, in a run such as `0` `00` `0`: pieces that
hold one of these strings (some hundreds, found from the vocabulary by an automaton) are merged by a
heap of (rank, place) instead.

Texts are split by the pattern.  A task encodes each piece once and remembers a bounded number of
them, as bytes of little-endian numbers; so ids of a text are a join of byte strings.  Offsets come
from the tokens' lengths in bytes and the map from bytes to characters: a token that begins or ends
inside a character covers all of it.  Decoding reverses the byte table; characters split between tokens are whole
again once their bytes are joined.
"""

from __future__ import annotations

import base64
import heapq
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: pieces that a worker remembers, in two generations; longer ones are encoded anew each time
REMEMBERED, LONGEST = 1 << 18, 64
BYTES_AT_ONCE = 2 << 20


def byte_characters() -> list[str]:
    """The character that shows each byte."""
    itself = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in itself else next(others)) for b in range(256)]


def parsed(rank_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines()) if token}


def shared_middles(ranks: dict[bytes, int]) -> set[bytes]:
    """x + y + z of all tokens with x + y and y + z the same token and x + y, y + z different pairs of tokens."""
    found = set()
    for t in ranks:
        pairs = [(t[:i], t[i:]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        tails = {}
        for y, z in pairs:
            tails.setdefault(y, []).append(z)
        found |= {x + y + z for x, y in pairs for z in tails.get(y, ()) if (x, y) != (y, z)}
    return found


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: of all neighbours that make a token the lowest rank is merged first, then the leftmost."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # of the token that starts here; 0 if none does
    before = list(range(-1, n - 1))
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two has been merged since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if (j := before[i]) >= 0 and (rank := ranks.get(piece[j:stop])) is not None:
            heapq.heappush(heap, (rank, j, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes with one rank file and pattern; a worker keeps it between tasks."""

    def __init__(self, rank_file: bytes, pattern: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.ranks = parsed(rank_file)
        self.split = regex.compile(pattern).findall
        characters = byte_characters()
        shown = {t: t.decode("latin-1").translate(characters) for t in self.ranks}
        vocabulary = {shown[t]: r for t, r in self.ranks.items()}
        merges = [(s[:i], s[i:]) for s in sorted(vocabulary, key=vocabulary.get) for i in range(1, len(s)) if s[:i] in vocabulary and s[i:] in vocabulary]
        self.library = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
        # pieces come split already
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.unsure = ahocorasick.Automaton()
        for s in shared_middles(self.ranks):
            self.unsure.add_word(s.decode("latin-1"), True)
        self.unsure.make_automaton()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # decoding: the library's own strings, back through the byte table
        byte_of = {ord(c): b for b, c in enumerate(characters)}
        self.tokens = {i: s.translate(byte_of).encode("latin-1") for s, i in self.library.get_vocab().items()}
        size = max(self.tokens) + 1
        self.lengths = np.zeros(size, np.int64)
        self.lengths[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)

    @staticmethod
    def kept(rank_file: bytes, pattern: str) -> Codec:
        # functions are shipped by value, so their globals are new in each task; a module of its own stays
        here = sys.modules.setdefault("_byte_bpe_of_this_worker", types.ModuleType("_byte_bpe_of_this_worker"))
        if getattr(here, "made_of", None) != (rank_file, pattern):
            here.made_of, here.codec = (rank_file, pattern), Codec(rank_file, pattern)
        return here.codec

    def packed(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, as little-endian 32-bit numbers."""
        out = []
        for piece, found in zip(pieces, self.library.encode_batch_fast(pieces, add_special_tokens=False)):
            ids = found.ids
            if len(ids) > 1:
                raw = piece.encode()
                if next(self.unsure.iter(raw.decode("latin-1")), None) is not None:
                    ids = merged(raw, self.ranks)
            out.append(np.array(ids, "<u4").tobytes())
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        found: dict[str, bytes] = {}
        unknown = []
        for piece in set().union(*split):
            ids = self.young.get(piece)
            if ids is None:
                ids = self.old.get(piece)
                if ids is None:
                    unknown.append(piece)
                    continue
                self.young[piece] = ids
            found[piece] = ids
        for at in range(0, len(unknown), 4096):
            some = unknown[at : at + 4096]
            for piece, ids in zip(some, self.packed(some)):
                found[piece] = ids
                if len(piece) <= LONGEST:
                    self.young[piece] = ids
        if len(self.young) >= REMEMBERED:
            self.young, self.old = {}, self.young
        return [b"".join(map(found.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (int(ids.max()) >= len(self.lengths) or int(ids.min()) < 0 or not self.lengths[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.bytes[at + np.arange(len(at))].tobytes()

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token's, and the one after its last."""
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        return character[starts], character[ends - 1] + 1


def read_file(path: str) -> bytes:
    """A rank file: a fixed, small size, so tasks get its bytes with their code; they need not have the file."""
    with open(path, "rb") as f:
        return f.read()


def default_ranks() -> tuple[bytes, str]:
    import public_tokenizers

    return read_file(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def groups(column, size_of):
    """Row ranges of an Arrow column of about BYTES_AT_ONCE each."""
    start = size = 0
    for i, n in enumerate(size_of(column).to_pylist()):
        size += n or 0
        if size >= BYTES_AT_ONCE:
            yield start, i + 1 - start
            start, size = i + 1, 0
    if start < len(column):
        yield start, len(column) - start


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", ranks: tuple[bytes, str] | None = None, form: str = "packed") -> DataFrame:
    """Token ids of each row's whole text.

    `form`: "packed" gives (key, ids) with ids a binary of little-endian unsigned 32-bit numbers;
    "arrays" gives (key, ids, starts, ends), arrays of integers, where a token covers the characters
    starts to ends - 1 of the text, a split character being covered by each of its tokens.

    No special tokens: their strings are ordinary text.  Null and empty texts have no ids; very long
    ones are encoded whole.  Rows are encoded each for itself, so null, equal or repeated keys all
    come back.  Extra columns are ignored; an empty table gives an empty result.
    """
    rank_file, pattern = ranks or default_ranks()
    kind = dict(docs.dtypes)[key]
    arrays = form == "arrays"

    def run(batches):
        codec = Codec.kept(rank_file, pattern)
        for batch in batches:
            for start, count in groups(batch.column(1), pc.binary_length):
                texts = [t or "" for t in batch.column(1).slice(start, count).to_pylist()]
                found = codec.encode(texts)
                columns = [batch.column(0).slice(start, count)]
                if arrays:
                    ids = [np.frombuffer(f, "<u4") for f in found]
                    spans = [codec.offsets(t, i) for t, i in zip(texts, ids)]
                    columns += [pa.array([v.astype(np.int32) for v in c], pa.list_(pa.int32())) for c in (ids, *(zip(*spans)))]
                else:
                    columns.append(pa.array(found, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [key, "ids", "starts", "ends"][: len(columns)])

    rest = "ids array<int>, starts array<int>, ends array<int>" if arrays else "ids binary"
    return docs.select(docs[key], docs[text].cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, {rest}")


def decode(rows: DataFrame, ids: str = "ids", key: str = "doc_id", ranks: tuple[bytes, str] | None = None) -> DataFrame:
    """(key, ids, bytes): what the ids of each row stand for; cast bytes to a string for its text.

    ids are packed or an array; null ones and none decode to nothing.  An id that isn't in the
    vocabulary, or a null in an array, is an error.  Bytes are joined before anyone reads characters from them, so characters
    that several tokens share are whole.  Cases are else as in `encode`.
    """
    rank_file, pattern = ranks or default_ranks()
    kinds = dict(rows.dtypes)

    def run(batches):
        codec = Codec.kept(rank_file, pattern)
        for batch in batches:
            packed = not pa.types.is_list(batch.column(1).type)
            for start, count in groups(batch.column(1), pc.binary_length if packed else pc.list_value_length):
                part = batch.slice(start, count)
                values = part.column(1).to_pylist()
                numbers = [np.frombuffer(v or b"", "<u4").astype(np.int64) if packed else np.array(v or [], np.int64) for v in values]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([codec.decode(n) for n in numbers], pa.binary())], [key, ids, "bytes"])

    return rows.select(key, ids).mapInArrow(run, f"`{key}` {kinds[key]}, `{ids}` {kinds[ids]}, bytes binary")


def round_trip(docs: DataFrame, text: str = "text", key: str = "doc_id", ranks: tuple[bytes, str] | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of texts encoded and decoded again; cases as in `encode`."""
    ranks = ranks or default_ranks()
    found = decode(encode(docs, text, key, ranks), "ids", key, ranks)
    return found.select(
        key, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op12_byte_bpe": query}
ORACLES: dict[str, str] = {}
