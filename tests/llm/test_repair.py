"""Conversation repair against brute force."""

import hashlib
import random
import re
import sys
import zlib
from functools import cache

from corpusmill.llm import op11_repair as op
from tests.conftest import SMALL

STATES = {"": "", "s": "s", "u": "u", "a": ""}
sys.setrecursionlimit(20_000)
FIT = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """(cost, audit) by trying every edit from the end; no bounds, no order of search."""

    @cache
    def rest(i, last, inserted):
        # last: initial of the last row kept, "" at the start
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, ""))
        wanted = "a" if last == "u" else "u"

        def go(cost, letter, tail):
            if tail is not None:
                found.append((cost + tail[0], letter + tail[1]))

        if inserted < 3:
            go(5, "I", rest(i, wanted, inserted + 1))
        if i < len(rows):
            role, gone, cut = rows[i]
            go(2, "D", rest(i + 1, last, 0))
            if not gone:
                if role == wanted or role == "s" and last == "":
                    go(5 * cut, "K", rest(i + 1, role, 0))
                go(1 + 5 * cut, "R", rest(i + 1, wanted, 0))
        return min(found, default=None)

    return rest(0, "", 0)


def solve(rows):
    s = op.Searcher()
    for r in rows:
        s.add(*r)
    return s.end()


def test_search_is_exact():
    rng = random.Random(4)
    for n in [*range(9)] * 60:
        rows = [(rng.choice("suaaux"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]
        assert solve(rows) == cheapest(rows), rows
    assert solve([]) == (0, "") and solve([("", False, False)]) == cheapest([("", False, False)])


def test_long_conversations_go_by_blocks(monkeypatch):
    rng = random.Random(5)
    for block in (1, 2, 7, 128):
        monkeypatch.setattr(op, "BLOCK", block)
        for n in (1, 5, 40, 150):
            for noise in (0.05, 0.6):
                rows = []
                for i in range(n):
                    role = "ua"[i % 2] if rng.random() > noise else rng.choice("suatx")
                    rows.append((role, rng.random() < noise / 3, rng.random() < noise / 3))
                assert solve(rows) == cheapest(rows)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        role, text, what = show(role), show(text), zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if what == 0:
            continue
        if what == 1:
            text = ""
        if what == 2:
            text = re.sub("[.!?]", "", text)
        if what == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if what == 3 else 1)
    return out


def expected(rows):
    by = {c: [] for c, *_ in rows}
    for conv, turn, role, text in damaged(rows):
        by[conv].append((turn, role, text))
    found = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, counts, symbols = set(), [0, 0, 0], []
        for _, role, text in own:
            end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = 0 if not end else 1 if (role, text) in seen else 2 if end not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            symbols.append((role[:1], fault in (0, 1), fault == 2))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        turns = {t for t, *_ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = cheapest(tuple(symbols))
        lines, state, left = [], "", iter(own)
        for edit in audit:
            wanted = "a" if state == "u" else "u"
            _, role, text = (None, None, "") if edit == "I" else next(left)
            if edit == "D":
                continue
            if edit in "IR":
                role = {"u": "user", "a": "assistant"}[wanted]
            state = role[0]
            lines.append(f"{role}:{text}")
        assert FIT.match("".join(x[0] for x in lines))
        found[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def got(frame):
    return {r[0]: tuple(r[1:]) for r in frame.collect()}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op.query(spark, SMALL)) == expected(rows)


def test_awkward_conversations(spark):
    rng = random.Random(6)
    rows = [(None, 1, "user", "Null id."), (None, None, None, None), (1, None, "user", None), (1, 3, None, "No role."), (1, -5, "system", "First."), (2, 0, "user", ""), (3, 7, "tool", " \t"), (3, 7, "", "Empty role.")]
    rows += [(4, t, r, x) for t in (1, 1, 2, None) for r in ("user", "assistant") for x in ("Tied.", "Tied too.", "Tied.")]
    rows += [(5, t, "ua"[t % 2] + "x", "word " * 50_000 + ".") for t in range(4)]
    rows += [(6, t, rng.choice(["user", "assistant", "system", "é"]), rng.choice(["One.", "Two!", "three", "", "Four? "])) for t in range(700)]
    rows += [(7, t, "user", "Again and again.") for t in range(300)]
    rows += [(c, 0, "user", "May be dropped.") for c in range(100, 180)]
    rows += [(8, -(2**63), "user", "Early."), (8, 2**63 - 1, "assistant", "Late.")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, audit string")
    want = expected(rows)
    want[8] = (min(want[8][0], 2**63 - 1), *want[8][1:])
    for parts in (1, 5):
        assert got(op.damaged_and_repaired(frame.repartition(parts))) == want
    none = frame.limit(0)
    assert op.damaged_and_repaired(none).count() == 0 and op.repaired(none).count() == 0
    texts = op.repaired(op.damage(frame)).collect()
    assert {r.edit for r in texts} >= {"K", "R"} and all(FIT.match("".join(x.role[0] for x in sorted((t for t in texts if t.conv_id == c), key=lambda t: t.position))) for c in (1, 4, 6))
