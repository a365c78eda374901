"""Sorted suffix runs: front coding, and merging with a loser tree that knows common prefixes."""

from __future__ import annotations

import numpy as np


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of a byte matrix with the row before (0 for the first)."""
    out = np.zeros(len(rows), dtype=np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def byte_order(rows: np.ndarray) -> np.ndarray:
    """Stable lexicographic order of the rows of a byte matrix."""
    rows = np.ascontiguousarray(rows)
    return np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable") if len(rows) else np.zeros(0, np.int64)


def front_code(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Common prefix of each row with the one before, and the concatenated rests of the rows.

    `rows`: sorted byte matrix, padded with zeros beyond `lengths`.
    """
    shared = np.minimum(common_prefixes(rows), lengths)
    at = np.arange(rows.shape[1])
    return shared.astype(np.uint8), rows[(at >= shared[:, None]) & (at < lengths[:, None])].tobytes()


def _prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings of one length that agree in the first `known` bytes."""
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return len(a) - (x.bit_length() + 7) // 8


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray, bytes]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge front-coded sorted runs; returns for each string of the result its run, and its common prefix with the one before.

    A run is (shared, lengths, rests), as from front_code; strings count as padded with zeros to
    `width`.  A head string's known prefix is relative to the last string that went out: for the
    winner's run it is the run's own front code, for all others what they lost by.  The longer known
    prefix wins without looking at bytes; only equal ones compare bytes, from the known prefix on.
    Third result: the rank in its run.
    """
    sources = [(s.tolist(), (n - s).tolist(), r) for s, n, r in ((s.astype(np.int64), n.astype(np.int64), r) for s, n, r in runs)]
    k = 1
    while k < len(sources):
        k *= 2
    head: list[bytes | None] = [None] * k
    at, offset = [0] * k, [0] * k
    known = [-1] * k

    def advance(i: int) -> None:
        shared, rest, data = sources[i]
        j = at[i]
        if j == len(shared):
            head[i], known[i] = None, -1
            return
        s, o = shared[j], offset[i]
        e = o + rest[j]
        before = head[i]
        head[i] = (before[:s] + data[o:e] if s else data[o:e]).ljust(width, b"\0")
        # padding may agree further than the coded prefix says
        if before is not None and s + e - o < width and head[i][s:] == before[s:]:
            s = width
        elif before is not None:
            s = _prefix(head[i], before, s)
        known[i] = s
        offset[i], at[i] = e, j + 1

    for i in range(len(sources)):
        advance(i)
        if head[i] is not None:
            known[i] = 0

    def better(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes relative to the winner."""
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        if ka < 0:
            return a, b
        x, y = head[a], head[b]
        n = _prefix(x, y, ka)
        if x < y or (n == width and a < b):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    tree = [0] * (2 * k)
    best = [*range(k)]
    level = k
    while level > 1:
        level //= 2
        nxt = []
        for j in range(level):
            w, loser = better(best[2 * j], best[2 * j + 1])
            tree[level + j] = loser
            nxt.append(w)
        best = nxt
    w = best[0]
    total = sum(len(s[0]) for s in sources)
    out_run, out_known, out_rank = [0] * total, [0] * total, [0] * total
    for t in range(total):
        out_run[t], out_known[t], out_rank[t] = w, known[w], at[w] - 1
        advance(w)
        node = (w + k) // 2
        while node:
            o = tree[node]
            kw, ko = known[w], known[o]
            if kw > ko:
                pass
            elif kw < ko:
                tree[node], w = w, o
            elif kw >= 0:
                w, tree[node] = better(w, o)
            node //= 2
    return np.array(out_run, dtype=np.int64), np.array(out_known, dtype=np.int64), np.array(out_rank, dtype=np.int64)
