"""All occurrences of many keywords: an Aho-Corasick automaton in flat arrays, stepped over many texts at once.

The automaton works on UTF-8 bytes.  Bytes that no keyword has are one symbol, so the table of next
states (a row for each state) is narrow; failures are resolved in it level by level, and a second
array links each state to the next shorter keyword that ends there.  A batch's texts are cut into
stretches of equal length, each begun early enough for the longest keyword, and all stretches take a
step together: the loop in Python is as long as a stretch, whatever the number of texts.

The keyword set is a parameter: its automata are bounded by MOST_CELLS each and built in the workers.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: cells of a table of next states; more keywords make another automaton
MOST_CELLS = 1 << 25
#: bytes of all keywords; what is larger isn't a parameter but a table
MOST_BYTES = 64 << 20
STRETCH = 256
BYTES_AT_ONCE = 4 << 20


class Automaton:
    """Next states, failures resolved; for each state the keyword that ends there (or -1), and the next state to look at for shorter ones (or 0)."""

    def __init__(self, keywords: list[bytes]):
        used = sorted(set(b"".join(keywords)))
        self.symbol = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)
        self.symbol[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        # a trie by levels: keywords sorted, so equal prefixes are neighbours
        words = sorted(set(keywords))
        self.longest = max(map(len, words))
        lengths = np.array([len(w) for w in words])
        padded = np.zeros((len(words), self.longest), np.uint16)
        for i, w in enumerate(words):
            padded[i, : len(w)] = self.symbol[np.frombuffer(w, np.uint8)]
        at = np.zeros(len(words), np.int64)  # each word's state so far
        levels, states = [], 1
        ends = np.full(len(words), -1, np.int64)
        for depth in range(self.longest):
            alive = np.flatnonzero(lengths > depth)
            parent, letter = at[alive], padded[alive, depth]
            new = np.append(True, (parent[1:] != parent[:-1]) | (letter[1:] != letter[:-1]))
            state = states - 1 + np.cumsum(new)
            levels.append((parent[new], letter[new], state[new]))
            at[alive] = state
            states += int(new.sum())
            ends[alive[lengths[alive] == depth + 1]] = state[lengths[alive] == depth + 1]
        self.keyword = np.full(states, -1, np.int32)
        self.keyword[ends] = np.arange(len(words), dtype=np.int32)
        self.words, self.lengths = words, lengths
        self.next = np.zeros((states, width), np.int32)
        self.shorter = np.zeros(states, np.int32)
        fail = np.zeros(states, np.int32)
        for depth, (parent, letter, child) in enumerate(levels):
            # a state's row is its failure's but for its own children; failures are less deep, so theirs is ready
            fail[child] = self.next[fail[parent], letter] if depth else 0
            self.next[parent, letter] = child
            self.next[child] = self.next[fail[child]]
            self.shorter[child] = np.where(self.keyword[fail[child]] >= 0, fail[child], self.shorter[fail[child]])
        self.any = (self.keyword >= 0) | (self.shorter > 0)

    @staticmethod
    def cells(keywords: list[bytes]) -> int:
        """An upper bound of the size of the table."""
        return (sum(map(len, keywords)) + 1) * (len(set(b"".join(keywords))) + 1)

    def scan(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, keyword) of all occurrences in an array of bytes, in no order; end is the place of the last byte."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        early = self.longest - 1
        stretch = max(STRETCH, 4 * early)
        starts = np.arange(0, n, stretch)
        symbols = np.zeros(early + len(starts) * stretch, self.symbol.dtype)
        symbols[early : early + n] = self.symbol[data]
        state = np.zeros(len(starts), np.int32)
        found_end, found_state = [], []
        flat, width = self.next.ravel(), self.next.shape[1]
        for step in range(early + stretch):
            state = flat[state.astype(np.int64) * width + symbols[starts + step]]
            if step >= early:
                hit = np.flatnonzero(self.any[state])
                if len(hit):
                    found_end.append(starts[hit] + (step - early))
                    found_state.append(state[hit])
        ends, keywords = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        if found_end:
            end, state = np.concatenate(found_end), np.concatenate(found_state)
            while len(end):
                own = self.keyword[state]
                ends.append(end[own >= 0])
                keywords.append(own[own >= 0])
                state = self.shorter[state]
                end, state = end[state > 0], state[state > 0]
        return np.concatenate(ends), np.concatenate(keywords)


def automata(keywords: list[bytes]) -> list[Automaton]:
    """One automaton, or several where one would be too large."""
    if len(keywords) > 1 and Automaton.cells(keywords) > MOST_CELLS:
        half = len(keywords) // 2
        return automata(keywords[:half]) + automata(keywords[half:])
    return [Automaton(keywords)] if keywords else []


def _kept(keywords: tuple[bytes, ...]) -> list[Automaton]:
    # functions are shipped by value, so their globals are new in each task; a module of its own stays
    here = sys.modules.setdefault("_automata_of_this_worker", types.ModuleType("_automata_of_this_worker"))
    if getattr(here, "made_of", None) != keywords:
        here.made_of, here.automata = keywords, automata(list(keywords))
    return here.automata


def scan(texts: DataFrame, keywords: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start, keyword): all occurrences of the keywords, overlapping ones too; start counts code points from 0.

    Null and empty texts have none; empty keywords are ignored; a keyword never crosses texts.
    """
    own = tuple(sorted({k.encode() for k in keywords if k}))
    if sum(map(len, own)) > MOST_BYTES:
        raise ValueError(f"more than {MOST_BYTES} bytes of keywords: join n-grams with a table of them instead")
    kind = dict(texts.dtypes)[key]

    def run(batches):
        machines = _kept(own)
        for batch in batches:
            start = size = 0
            parts: list[bytes] = []
            for i, t in enumerate(batch.column(1)):
                parts.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(parts[-1])
                if size >= BYTES_AT_ONCE or i == batch.num_rows - 1:
                    yield from found(machines, batch.column(0).slice(start, len(parts)), parts)
                    start, size, parts = i + 1, 0, []

    def found(machines, keys, parts):
        joined = np.frombuffer(b"".join(parts), np.uint8)
        begins = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        points = np.cumsum((joined & 0xC0) != 0x80)  # code points up to each byte
        for machine in machines:
            end, keyword = machine.scan(joined)
            first = end - machine.lengths[keyword] + 1
            row = np.searchsorted(begins, end, side="right") - 1
            inside = first >= begins[row]
            first, row, keyword = first[inside], row[inside], keyword[inside]
            place = points[first] - 1 - np.concatenate(([0], points))[begins[row]]
            words = pa.array([w.decode("utf-8", "surrogatepass") for w in machine.words])
            for s in range(0, len(row), 1 << 16):
                some = slice(s, s + (1 << 16))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[some])), pa.array(place[some]), words.take(pa.array(keyword[some]))], [key, "start", "keyword"])

    return texts.select(texts[key], texts[text].cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, start long, keyword string")
