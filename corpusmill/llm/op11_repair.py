"""Repair of conversation structure by depth-first branch and bound.

A well-formed conversation is nothing, or user and assistant in turn, ended by the assistant, with
one system row before them at most.  Rows may be kept, given another role or deleted, and rows may
be inserted; each edit has a cost, and the cheapest edits are searched, ties going to the
ASCII-least string of their initials (the audit).

1. A row's faults are found where rows are narrow: no text is shuffled.  A role and text that stand
   on several turns are found by an aggregation, so a row that is repeated very often is no hot spot.
2. The rows of a conversation, a byte or two each, meet in order in a task.  It searches with an
   explicit stack: a node is (row, state of the pattern).  Each node's table entry is the best
   (cost, audit) that has reached it, which eliminates worse prefixes; a lower bound on what the rest
   must cost and the incumbent (cost, audit) cut off the others.  When the stack is empty, the
   incumbent is proved best.  Long conversations are searched by blocks of rows: a block's table at
   its end (four states at most) is where the next one starts, so memory doesn't grow with them.
3. Texts are shuffled once, by conversation; the audit stands before a conversation's rows, and the
   repaired rows are written as they pass.  SHA-256 is sequential by nature: the bytes of one
   conversation pass one task, row by row.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLANKS = " \t\n\x0b\x0c\r"
#: costs of edits, and what a truncated row costs that isn't deleted
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: rows of a conversation that are searched together
BLOCK = 16
#: solved role sequences that a task remembers
REMEMBERED = 1 << 16
OUT_BYTES = 4 << 20

#: state: what the rows so far are: nothing, a system row, an open user row, or answered ones
START, SYSTEM, ASKED, ANSWERED = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): ASKED, (SYSTEM, "u"): ASKED, (ANSWERED, "u"): ASKED, (ASKED, "a"): ANSWERED}
WANTED = {START: "u", SYSTEM: "u", ANSWERED: "u", ASKED: "a"}
ROLE = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: with two rows inserted, or a system row deleted and one inserted, any state does what another can
ANY_STATE = 2 * INSERT


def lower_bounds(rows: list[tuple[str, bool, bool]]) -> list[int]:
    """What rows[i:] cost at least, for each i: each its cheapest edit, or one edit for two neighbours that can't both stay as they are."""
    n = len(rows)
    least = [DELETE if gone or cut else 0 if role in "sua" and role else REROLE for role, gone, cut in rows]
    bounds = [0] * (n + 1)
    follower, between = n, 0  # the next row that needn't go, and the cost of those before it
    for i in range(n - 1, -1, -1):
        bounds[i] = least[i] + bounds[i + 1]
        if rows[i][1]:
            between += DELETE
            continue
        if follower < n and not least[i] and not least[follower] and rows[i][0] + rows[follower][0] not in LEGAL:
            bounds[i] = max(bounds[i], REROLE + between + bounds[follower + 1])
        follower, between = i, 0
    return bounds


def search(rows: list[tuple[str, bool, bool]], roots: list[tuple[int, int]], last: bool):
    """Branch and bound over `rows` (initial of the role, must go, truncated).

    `roots` are (cost, state) of prefixes, in order of their audits, of which none begins another.
    With `last`: (cost, root, audit) of the best whole repair.  Else {state: (cost, root, audit)} of
    the prefixes at the end of the rows that may still lead to it.
    """
    n, bounds = len(rows), lower_bounds(rows)
    tables: list[dict[int, tuple[int, int, str]]] = [{} for _ in range(n + 1)]
    best: tuple[int, int, str] | None = None  # the incumbent
    room = 0 if last else ANY_STATE
    stack = []
    for number, (cost, state) in enumerate(roots):
        tables[0][state] = (cost, number, "")
        stack.append((cost, number, "", 0, state))
    stack.sort(reverse=True)
    while stack:
        cost, root, audit, i, state = stack.pop()
        if tables[i][state] != (cost, root, audit):
            continue  # a better prefix has come to this node
        if best is not None:
            bound = cost + bounds[i]
            if bound > best[0] + room:
                continue
            if last and bound == best[0] and (root, audit) > (best[1], best[2][: len(audit)]):
                continue
        if i == n:
            if last and state in (START, ANSWERED):
                best = (cost, root, audit) if best is None else min(best, (cost, root, audit))
                continue
            if not last:
                best = (cost, root, audit) if best is None else min(best, (cost, root, audit))
                continue
        nexts = []
        if i < n:
            role, gone, cut = rows[i]
            nexts.append((cost + DELETE, "D", i + 1, state))
            if not gone:
                stay = cost + TRUNCATED * cut
                if (state, role) in STEP:
                    nexts.append((stay, "K", i + 1, STEP[state, role]))
                nexts.append((stay + REROLE, "R", i + 1, STEP[state, WANTED[state]]))
        nexts.append((cost + INSERT, "I", i, STEP[state, WANTED[state]]))
        # the most promising goes on top of the stack
        nexts.sort(key=lambda x: (x[0] + bounds[x[2]], x[1]), reverse=True)
        for cost_, letter, j, to in nexts:
            found = (cost_, root, audit + letter)
            if to not in tables[j] or found < tables[j][to]:
                tables[j][to] = found
                stack.append((*found, j, to))
    if last:
        return best
    return {state: x for state, x in tables[n].items() if x[0] <= best[0] + ANY_STATE}


class Searcher:
    """The cheapest edits of one conversation after the other; rows come one by one."""

    def __init__(self):
        self.known: dict[tuple, tuple[int, str]] = {}
        self.begin()

    def begin(self):
        self.rows: list[tuple[str, bool, bool]] = []
        self.front: list[tuple[str, int, int]] = [("", 0, START)]  # (audit, cost, state), by audit

    def add(self, role: str, gone: bool, cut: bool):
        if len(self.rows) == BLOCK:
            found = search(self.rows, [(c, s) for _, c, s in self.front], False)
            # a prefix that ends with inserted rows is reached again by the next block's inserts
            ends = [(self.front[root][0] + audit, cost, state) for state, (cost, root, audit) in found.items() if not audit.endswith("I")]
            self.front, self.rows = sorted(ends), []
        self.rows.append((role, gone, cut))

    def end(self) -> tuple[int, str]:
        short = len(self.front) == 1 and not self.front[0][0]
        key = tuple(self.rows) if short else None
        found = self.known.get(key) if short else None
        if found is None:
            cost, root, audit = search(self.rows, [(c, s) for _, c, s in self.front], True)
            found = cost, self.front[root][0] + audit
            if short:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[key] = found
        self.begin()
        return found


def applied(audit: str, rows):
    """(edit, role, text) of each row of a repaired conversation; `rows` gives (role, text) in order."""
    state, rows = START, iter(rows)
    for edit in audit:
        if edit == "I":
            role, text = ROLE[WANTED[state]], ""
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            if edit == "R":
                role = ROLE[WANTED[state]]
        state = STEP[state, role[:1]]
        yield edit, role, text


# ---------------------------------------------------------------- on Spark

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
PLAN = "conv_id {id}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string"


def normal(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text (null: one space), and _d, a digest of role and text."""
    role, text = (F.coalesce(rows[c].cast("string"), F.lit(" ")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), digest.alias("_d"))


def in_order(rows: DataFrame, *more: str) -> DataFrame:
    """Each conversation in one task, in order: by turn (null first), then role, then digest."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *more, F.asc_nulls_first("turn"), "role", "_d")


def plans(rows: DataFrame) -> DataFrame:
    """The cheapest edits of each conversation, from rows (conv_id, turn, role, text).

    conv_id; gaps (turns missing between the first and the last); blank, duplicate and truncated
    (rows by their first fault), illegal (neighbours whose roles can't follow each other); cost and
    audit (an initial for each edit: Delete, Insert, Keep, Rerole).

    Conversations with a null id are one conversation.  Null turns come first and make no gaps; null
    roles and texts are one space.  Rows that share a turn stand by role, then by a digest of role and
    text; equal rows are duplicates but for the first.  Roles count by their first character, texts by
    whole length.  Extra columns are ignored; an empty table gives an empty result.  gaps is at most
    the largest long.
    """
    own = normal(rows)
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    narrow = own.select("conv_id", "turn", "role", "_d", (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"))
    # role and text of several turns; a struct orders null turns first and isn't null itself
    spread = own.groupBy("conv_id", "_d").agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("final"))
    spread = spread.where("first <> final").select(F.col("conv_id").alias("_c"), F.col("_d").alias("_e"), "first")
    marked = narrow.join(spread, narrow.conv_id.eqNullSafe(spread["_c"]) & (narrow["_d"] == spread["_e"]), "left")
    marked = marked.select("conv_id", "turn", "role", "_d", "blank", "cut", F.coalesce(F.struct("turn") > F.col("first"), F.lit(False)).alias("again"))
    kind, id_type = dict(rows.dtypes)["conv_id"], _arrow_type(rows)
    names = ["conv_id", *COUNTS, "audit"]

    def run(batches):
        searcher, out, held = Searcher(), [], 0
        now = before = low = high = None  # conversation; turn, role and digest of the row before; turns
        turns, counts = 0, [0, 0, 0, 0]

        def done():
            gaps = high - low + 1 - turns if turns else 0
            return (now[0], min(gaps, (1 << 63) - 1), *counts, *searcher.end())

        def batch_of(rows):
            kinds = [id_type, *[pa.int64()] * len(COUNTS), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for conv, turn, role, digest, blank, cut, again in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (conv,):
                    if now is not None:
                        out.append(done())
                        held += len(out[-1][-1])
                        if len(out) >= 4096 or held > OUT_BYTES:
                            yield batch_of(out)
                            out, held = [], 0
                    now, before, low, high, turns, counts = (conv,), None, None, None, 0, [0, 0, 0, 0]
                duplicate = again or before is not None and before[0] == turn and before[2] == digest
                fault = 0 if blank else 1 if duplicate else 2 if cut else None
                if fault is not None:
                    counts[fault] += 1
                if before is not None and before[1][:1] + role[:1] not in LEGAL:
                    counts[3] += 1
                if turn is not None and turn != high:
                    low, high, turns = turn if low is None else low, turn, turns + 1
                before = turn, role, digest
                searcher.add(role[:1], fault in (0, 1), fault == 2)
        if now is not None:
            out.append(done())
        if out:
            yield batch_of(out)

    return in_order(marked).mapInArrow(run, PLAN.format(id=kind))


def _repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of repaired conversations in order, each conversation after a row of its plan, whose position is null."""
    kind = dict(rows.dtypes)["conv_id"]
    none = [F.lit(None).cast("long").alias(c) for c in COUNTS]
    texts = normal(rows).select("conv_id", F.lit(1).alias("_k"), "turn", "role", "text", "_d", *none, F.lit(None).cast("string").alias("audit"))
    heads = plan.select(
        "conv_id", F.lit(0).alias("_k"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("_d"), *COUNTS, "audit",
    )
    names = ["conv_id", "position", "edit", "role", "text", *COUNTS, "audit"]

    def run(batches):
        def rows_of():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def conversations():
            """(head, rows) of each conversation; its rows are read as they come."""
            stream = rows_of()
            head = next(stream, None)
            while head is not None:
                following = []

                def own():
                    for row in stream:
                        if row[1] == 0:
                            following.append(row)
                            return
                        yield row[3], row[4]

                rest = own()
                yield head, rest
                for _ in rest:  # deleted rows at the end
                    pass
                head = following[0] if following else None

        out, held = [], 0
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * len(COUNTS), pa.string()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for head, rest in conversations():
            out.append((head[0], None, None, None, None, *head[6:]))
            held += len(head[-1])
            for position, (edit, role, text) in enumerate(applied(head[-1], rest)):
                out.append((head[0], position, edit, role, text, *[None] * (len(COUNTS) + 1)))
                held += len(text)
                if len(out) >= 4096 or held > OUT_BYTES:
                    yield batch_of(out)
                    out, held = [], 0
        if out:
            yield batch_of(out)

    id_type = _arrow_type(rows)
    schema = f"conv_id {kind}, position long, edit string, role string, text string, " + PLAN.format(id=kind).split(", ", 1)[1]
    return in_order(heads.unionByName(texts), "_k").mapInArrow(run, schema)


def _arrow_type(rows: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["conv_id"].dataType)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, position, edit (Insert, Keep or Rerole), role and text of the rows of repaired conversations.

    Cases are as in `plans`; a conversation all of whose rows are deleted has none.
    """
    return _repaired(rows, plans(rows)).where("position IS NOT NULL").select("conv_id", "position", "edit", "role", "text")


def repairs(rows: DataFrame) -> DataFrame:
    """The plan of each conversation, and the SHA-256 of its repaired rows (`role:text`, joined by newlines)."""
    whole = _repaired(rows, plans(rows))
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    id_type = _arrow_type(rows)

    def run(batches):
        head = digest = None
        kinds = [id_type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for conv, position, _, role, text, *plan in zip(*columns):
                if position is None:
                    if head is not None:
                        out.append((*head, digest.hexdigest()))
                    head, digest = (conv, *plan), hashlib.sha256()
                else:
                    digest.update((("\n" if position else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            if out:
                yield batch_of(out)
        if head is not None:
            yield batch_of([(*head, digest.hexdigest())])

    return whole.mapInArrow(run, PLAN.format(id=dict(rows.dtypes)["conv_id"]) + ", repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults, by the CRC-32 of `conv_id:turn`: dropped, emptied, without sentence ends, repeated, or the user's."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    what = F.crc32(F.concat_ws(":", *shown[:2])) % 20
    rows = conversations.select("conv_id", "turn", shown[2].alias("role"), shown[3].alias("text"), what.alias("_w")).where("_w <> 0")
    role = F.when(F.col("_w") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("_w") == 1, "").when(F.col("_w") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_w") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_t")).drop("_t")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """`repairs` of all conversations after `damage`; one that has lost all its rows has zeros, no audit and the empty string's digest."""
    found = repairs(damage(conversations)).withColumnRenamed("conv_id", "_c")
    ids = conversations.select("conv_id").distinct()
    whole = ids.join(found, ids.conv_id.eqNullSafe(found["_c"]), "left")
    zero: list[Column] = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in COUNTS]
    empty = hashlib.sha256().hexdigest()
    return whole.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_and_repaired(table(spark, sf_dir, "conversations"))


QUERIES = {"op11_repair": query}
ORACLES: dict[str, str] = {}
