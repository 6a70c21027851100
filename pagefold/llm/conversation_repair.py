"""Conversation structure repair by Hirschberg's divide and conquer (operator 12).

A repaired conversation has the roles ``(system? (user assistant)+)?``.  Four states say what came
last: 0 nothing, 1 system, 2 user, 3 assistant.  A row's token is its inserts, then its edit
(``D``elete, ``K``eep or ``R``erole).  No token begins another, so two audits of the same rows are
ordered by their first different token, and the least audit of a prefix stays the least whatever
follows.  A forward vector holds, per state, the cost of the best edits up to a row and the order of
their audits; a backward vector holds the cost of what is left.  They meet in the middle; the
audit-least state of minimal sum is the crossing, and both halves are solved the same way.

Across tasks: rows are range-partitioned in order and each task solves the conversations that lie
inside its range.  One that crosses ranges (or is very long) is open: each of its segments is
summed up as a four by four matrix, the same divide and conquer picks the crossings between
segments, and each segment is then solved alone.  Only the final digest of an open conversation
reads its texts one after another (a SHA-256 has to), as a stream.

Rows are taken by turn (nulls first), then role, then MD5 of the text; equal rows are
interchangeable.  Null roles and texts count as one space.  An initial is a role's first character;
a role without one, or of another initial than ``s``, ``u`` or ``a``, can't be kept.  A null conversation
id is a conversation of its own; a conversation of which all rows are dropped has zeros and an
empty audit; texts of any length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import frugal, stage

#: Costs of an edit, and of an undeleted truncated row (fixed values of the task).
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A conversation of more characters is open, whatever range its rows lie in.
MOST_HELD = 32 << 20
#: Bytes that count as blank (fixed values): U+0020 and U+0009 to U+000D.
BLANK = " \t\n\x0b\f\r"

INF = 1 << 60
#: State after the next insert; the role that a state stands for.
NEXT = (2, 2, 3, 2)
ROLE = ("", "system", "user", "assistant")
#: Inserts behind the last row, by state.
TAIL = ("", "II", "I", "")

COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


# ---- one row: what its tokens cost between states -------------------------------------------

def _step(code: int) -> tuple:
    """``step[s][t]`` is (cost, least token) of a row from state ``s`` to ``t``, or None.  ``code`` 0 is a row
    that has to go; else 1 + 2 * initial (s, u, a, other) + 1 if truncated."""
    initial, cut = divmod(code - 1, 2)
    out = []
    for s in range(4):
        best: list = [None] * 4
        at, seen, inserts = s, set(), ""
        while at not in seen:
            seen.add(at)
            paid = INSERT * len(inserts)
            tries = [(at, paid + DELETE, inserts + "D")]
            if code:
                paid += TRUNCATED * cut
                tries.append((NEXT[at], paid + REROLE, inserts + "R"))
                if (initial == 0 and at == 0) or (initial in (1, 2) and NEXT[at] == initial + 1):
                    tries.append((initial + 1, paid, inserts + "K"))
            for t, cost, token in tries:
                if best[t] is None or (cost, token) < best[t]:
                    best[t] = (cost, token)
            at, inserts = NEXT[at], inserts + "I"
        out.append(tuple(best))
    return tuple(out)


STEPS = tuple(_step(c) for c in range(9))


# ---- vectors -----------------------------------------------------------------------------------

def begin(state: int) -> tuple:
    return tuple(0 if s == state else INF for s in range(4)), (0, 0, 0, 0)


def advance(vector: tuple, element: tuple) -> tuple:
    """The forward vector (costs, audit order) behind an element: a row, or a whole segment."""
    costs, order = vector
    found = []
    for t in range(4):
        ways = [(costs[s] + element[s][t][0], order[s], element[s][t][1]) for s in range(4) if costs[s] < INF and element[s][t]]
        found.append(min(ways, default=None))
    audits = sorted({x[1:] for x in found if x})
    return tuple(x[0] if x else INF for x in found), tuple(audits.index(x[1:]) if x else 9 for x in found)


def retreat(costs: tuple, element: tuple) -> tuple:
    """The backward costs in front of an element."""
    return tuple(min((x[0] + costs[t] for t, x in enumerate(element[s]) if x and costs[t] < INF), default=INF) for s in range(4))


@lru_cache(maxsize=1 << 16)
def _advance_row(costs: tuple, order: tuple, code: int) -> tuple:
    return advance((costs, order), STEPS[code])


@lru_cache(maxsize=1 << 16)
def _retreat_row(costs: tuple, code: int) -> tuple:
    return retreat(costs, STEPS[code])


def forward(elements, lo: int, hi: int, vector: tuple) -> tuple:
    """The forward vector over rows (codes) or segments (matrices)."""
    base, (costs, order) = 0, vector
    for e in elements[lo:hi]:
        low = min(costs)
        if low:  # keep the vectors small, so that few different ones occur
            base, costs = base + low, tuple(c - low if c < INF else INF for c in costs)
        costs, order = _advance_row(costs, order, e) if isinstance(e, int) else advance((costs, order), e)
    return tuple(c + base if c < INF else INF for c in costs), order


def backward(elements, lo: int, hi: int, costs: tuple) -> tuple:
    base = 0
    for i in range(hi - 1, lo - 1, -1):
        low = min(costs)
        if low:
            base, costs = base + low, tuple(c - low if c < INF else INF for c in costs)
        e = elements[i]
        costs = _retreat_row(costs, e) if isinstance(e, int) else retreat(costs, e)
    return tuple(c + base if c < INF else INF for c in costs)


def crossing(vector: tuple, costs: tuple) -> int:
    """The audit-least state among those of minimal sum."""
    return min((c + d, order, s) for s, (c, order, d) in enumerate(zip(*vector, costs)) if c < INF and d < INF)[2]


def solve(elements, p: int, q: int) -> list[tuple[int, int]]:
    """States in front of and behind each element on the audit-least best path from ``p`` to ``q``."""
    out: list = [None] * len(elements)
    todo = [(0, len(elements), p, q)]
    while todo:
        lo, hi, a, b = todo.pop()
        if hi - lo == 1:
            out[lo] = (a, b)
        elif hi > lo:
            mid = (lo + hi) // 2
            s = crossing(forward(elements, lo, mid, begin(a)), backward(elements, mid, hi, begin(b)[0]))
            todo += [(lo, mid, a, s), (mid, hi, s, b)]
    return out


def finish(elements) -> tuple[int, int]:
    """Minimal cost and last state of a whole conversation."""
    vector = forward(elements, 0, len(elements), begin(0))
    end = tuple(INSERT * len(t) for t in TAIL)
    q = crossing(vector, end)
    return vector[0][q] + end[q], q


def summary(codes) -> tuple:
    """A segment as an element: cost and audit order between states."""
    out = []
    for s in range(4):
        costs, order = forward(codes, 0, len(codes), begin(s))
        out.append(tuple((c, o) if c < INF else None for c, o in zip(costs, order)))
    return tuple(out)


def tokens(codes, p: int, q: int) -> list[str]:
    return [STEPS[c][a][b][1] for c, (a, b) in zip(codes, solve(codes, p, q))]


# ---- texts -------------------------------------------------------------------------------------

class Repaired:
    """Streams a conversation's rows with their tokens into its audit, digest and messages."""

    def __init__(self, keep: bool) -> None:
        self.state, self.audit, self.sha, self.n = 0, [], hashlib.sha256(), 0
        self.messages: list | None = [] if keep else None

    def _say(self, edit: str, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.n else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        if self.messages is not None:
            self.messages.append((self.n, edit, role, text))
        self.n += 1

    def add(self, token: str, role: str = "", text: str = "") -> None:
        self.audit.append(token)
        for edit in token:
            if edit == "D":
                continue
            if edit == "K":
                self.state = " sua".index(role[:1])
                self._say(edit, role, text)
            else:
                self.state = NEXT[self.state]
                self._say(edit, ROLE[self.state], text if edit == "R" else "")


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


# ---- the job -----------------------------------------------------------------------------------

ROW = "i long, turn long, role string, text string, digest string, fault int, initial int"


def _described(rows: DataFrame, conv: str) -> DataFrame:
    """Rows with what a row's code needs: ``fault`` 0 none, 1 blank, 2 truncated, 3 dropped; ``initial`` of the role."""
    last = F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1))
    fault = (F.when(F.col("dropped"), 3).when(F.ltrim("text", F.lit(BLANK)) == "", 1)
             .when(~last.isin(".", "!", "?"), 2).otherwise(0))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return rows.select(F.col(conv).alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text", F.md5("text").alias("digest"),
                       fault.cast("int").alias("fault"), initial.cast("int").alias("initial"))


def _code(fault: int, initial: int, seen: bool) -> int:
    return 0 if fault == 1 or seen else 1 + 2 * initial + (fault == 2)


def _whole(rows: list[tuple], keep: bool) -> tuple[list, Repaired]:
    """Counts and repaired texts of a conversation whose rows ``(turn, role, text, digest, fault, initial)`` are at hand."""
    rows = [r for r in rows if r[4] != 3]
    seen: set = set()
    codes, faults = [], [0, 0, 0]
    for turn, role, text, digest, fault, initial in rows:
        again = (role, digest) in seen
        seen.add((role, digest))
        codes.append(_code(fault, initial, again))
        if fault == 1 or again or fault == 2:
            faults[0 if fault == 1 else 1 if again else 2] += 1
    cost, q = finish(codes)
    out = Repaired(keep)
    for token, r in zip(tokens(codes, 0, q), rows):
        out.add(token, r[1], r[2])
    out.add(TAIL[q])
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return [gaps, *faults, _illegal([r[1][:1] for r in rows]), cost], out


DONE = f"kind string, conv {{kind}}, seg int, {ROW}, {COUNTS}, audit string, repaired_sha256 string"


def _batches(rows: Iterable[dict], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 200 + len(r.get("text") or "") + len(r.get("audit") or "")
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _cut(schema: pa.Schema, keep: bool, most_held: int):
    """Solves the conversations inside a range; hands on the rows of those that may cross its ends."""
    names = ("turn", "role", "text", "digest", "fault", "initial")

    def result(conv, rows: list[tuple]) -> Iterator[dict]:
        counts, out = _whole(rows, keep)
        yield {"kind": "done", "conv": conv, "audit": "".join(out.audit), "repaired_sha256": out.sha.hexdigest(),
               **dict(zip(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), counts))}
        for n, edit, role, text in out.messages or ():
            yield {"kind": "message", "conv": conv, "i": n, "role": role, "text": text, "digest": edit}

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seg = TaskContext.get().partitionId()
        conv, rows, size, is_open, i, started = None, [], 0, True, 0, False
        opened = lambda r, i: {"kind": "open", "conv": conv, "seg": seg, "i": i, **dict(zip(names, r))}
        for batch in batches:
            for c, *r in zip(*(batch.column(x).to_pylist() for x in ("conv", *names))):
                if not started:
                    conv, started = c, True
                elif c != conv:
                    if not is_open:
                        yield from result(conv, rows)
                    conv, rows, size, is_open = c, [], 0, False
                if not is_open:
                    rows.append(tuple(r))
                    size += len(r[2])
                    if size > most_held:
                        is_open = True
                        for x in rows:
                            yield opened(x, i)
                            i += 1
                        rows = []
                    continue
                yield opened(r, i)
                i += 1
        for x in rows:  # the next range may go on with it
            yield opened(x, i)
            i += 1

    return frugal(lambda batches: _batches(stream(batches), schema))


def _segment(table: pa.Table, kind: pa.DataType) -> pa.Table:
    """One row for a segment: its matrix, its counts and what its neighbours need."""
    t = table.sort_by("i").to_pydict()
    codes = [_code(f, n, a) for f, n, a in zip(t["fault"], t["initial"], t["again"])]
    turns = [x for x in t["turn"] if x is not None]
    initials = [r[:1] for r in t["role"]]
    faults = [0 if f == 1 else 1 if a else 2 if f == 2 else 3 for f, a in zip(t["fault"], t["again"])]
    matrix = [x for row in summary(codes) for cell in row for x in (cell or (-1, -1))]
    one = {"conv": t["conv"][0], "seg": t["seg"][0], "matrix": matrix, "blank": faults.count(0), "duplicate": faults.count(1),
           "truncated": faults.count(2), "illegal": _illegal(initials), "first": initials[0], "last": initials[-1],
           "low": min(turns, default=None), "high": max(turns, default=None), "distinct": len(set(turns))}
    return pa.Table.from_pylist([one], pa.schema([("conv", kind), ("seg", pa.int32()), ("matrix", pa.list_(pa.int64())), *(
        (x, pa.int64()) for x in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string()),
        ("low", pa.int64()), ("high", pa.int64()), ("distinct", pa.int64())]))


SEGMENT = ("conv {kind}, seg int, matrix array<long>, blank long, duplicate long, truncated long, illegal long, first string, "
           "last string, low long, high long, distinct long")


def _meet(table: pa.Table, kind: pa.DataType) -> pa.Table:
    """The crossings between the segments of one conversation, and its counts (on its first segment)."""
    rows = table.sort_by("seg").to_pylist()
    elements = []
    for r in rows:
        pairs = [None if c < 0 else (c, o) for c, o in zip(r["matrix"][::2], r["matrix"][1::2])]
        elements.append(tuple(tuple(pairs[4 * s:4 * s + 4]) for s in range(4)))
    cost, q = finish(elements)
    total = {x: sum(r[x] for r in rows) for x in ("blank", "duplicate", "truncated", "illegal", "distinct")}
    total["illegal"] += _illegal_between(rows)
    high = None
    for r in rows:
        if r["low"] is not None:
            total["distinct"] -= r["low"] == high  # rows are in order, so only a turn at the seam counts twice
            high = r["high"]
    lows = [r["low"] for r in rows if r["low"] is not None]
    gaps = high - min(lows) + 1 - total["distinct"] if lows else 0
    counts = {"gaps": gaps, **{x: total[x] for x in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost}
    out = [{"conv": r["conv"], "seg": r["seg"], "p": p, "q": s, "tail": TAIL[q] if r is rows[-1] else "", **(counts if r is rows[0] else {})}
           for r, (p, s) in zip(rows, solve(elements, 0, q))]
    return pa.Table.from_pylist(out, pa.schema([("conv", kind), ("seg", pa.int32()), ("p", pa.int32()), ("q", pa.int32()), ("tail", pa.string()), *(
        (x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))]))


def _illegal_between(rows: list[dict]) -> int:
    return sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))


def _edited(table: pa.Table, kind: pa.DataType) -> pa.Table:
    """The token of each row of a segment whose ends are known."""
    table = table.sort_by("i")
    t = table.select(["fault", "initial", "again"]).to_pydict()
    codes = [_code(f, n, a) for f, n, a in zip(t["fault"], t["initial"], t["again"])]
    found = tokens(codes, table.column("p")[0].as_py(), table.column("q")[0].as_py())
    found[-1] += table.column("tail")[0].as_py()
    return pa.table({"conv": table.column("conv").cast(kind), "seg": table.column("seg").cast(pa.int32()), "i": table.column("i"), "token": found})


def _read_in_order(schema: pa.Schema, keep: bool):
    """Streams open conversations in order into their audits, digests and messages."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out, conv = None, None

        def close() -> Iterator[dict]:
            yield {"kind": "done", "conv": conv, "audit": "".join(out.audit), "repaired_sha256": out.sha.hexdigest()}

        for batch in batches:
            for c, token, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "token", "role", "text"))):
                if out is None or c != conv:
                    if out is not None:
                        yield from close()
                    out, conv = Repaired(keep), c
                tail = token.lstrip("I")[1:]  # inserts behind the last row
                out.add(token[:len(token) - len(tail)], role, text)
                if tail:
                    out.add(tail)
                if out.messages:
                    for n, edit, r, t in out.messages:
                        yield {"kind": "message", "conv": c, "i": n, "role": r, "text": t, "digest": edit}
                    out.messages.clear()
        if out is not None:
            yield from close()

    return frugal(lambda batches: _batches(stream(batches), schema))


def repair(rows: DataFrame, conv_col: str = "conv_id", messages: bool = False, most_held: int = MOST_HELD) -> tuple[DataFrame, DataFrame | None]:
    """Repairs ``rows(conv_col, turn, role, text[, dropped])``.

    Returns ``(conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``, one row
    per conversation, and with ``messages`` also the repaired rows ``(conv_col, i, edit, role, text)``.  A
    row with ``dropped`` true only says that its conversation exists.
    """
    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

    kind, arrow = dict(rows.dtypes)[conv_col], to_arrow_type(rows.schema[conv_col].dataType)
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    rows = rows.select(conv_col, "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), dropped.alias("dropped"))
    order = ["conv", "turn", "role", "digest"]
    done = DONE.format(kind=kind)
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], done).schema)
    ranged = _described(rows, conv_col).repartitionByRange(*order).sortWithinPartitions(*order)
    first = stage(ranged.mapInArrow(_cut(schema, messages, most_held), done), "repair-ranges")

    opened = first.filter("kind = 'open'").select("conv", "seg", *(c.split()[0] for c in ROW.split(", ")))
    live = opened.filter("fault <> 3")
    here = F.struct("seg", "i")
    repeated = (live.groupBy("conv", "role", "digest").agg(F.min(here).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    a, b = live.drop("text").alias("a"), repeated.alias("b")
    same = F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.digest") == F.col("b.digest"))
    coded = stage(a.join(b, same, "left").select("a.*", (F.col("first").isNotNull() & (F.struct("a.seg", "a.i") > F.col("first"))).alias("again")), "repair-codes")
    segments = stage(coded.groupBy("conv", "seg").applyInArrow(lambda t: _segment(t, arrow), SEGMENT.format(kind=kind)), "repair-segments")
    path = stage(segments.groupBy("conv").applyInArrow(
        lambda t: _meet(t, arrow), f"conv {kind}, seg int, p int, q int, tail string, {COUNTS}"), "repair-path")
    ends = path.select(F.col("conv").alias("c"), F.col("seg").alias("s"), "p", "q", "tail")
    edited = (coded.join(ends, F.col("conv").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s"))).groupBy("conv", "seg")
              .applyInArrow(lambda t: _edited(t, arrow), f"conv {kind}, seg int, i long, token string")
              .select(F.col("seg").alias("s"), F.col("i").alias("at"), "token"))
    texts = (live.join(edited, (F.col("seg") == F.col("s")) & (F.col("i") == F.col("at"))).select("conv", "seg", "i", "token", "role", "text")
             .repartition("conv").sortWithinPartitions("conv", "seg", "i"))
    read = stage(texts.mapInArrow(_read_in_order(schema, messages), done), "repair-open")

    names = [c.split()[0] for c in COUNTS.split(", ")]
    counted = path.filter("cost is not null").select(F.col("conv").alias("c"), *names)
    audits = read.filter("kind = 'done'").select("conv", "audit", "repaired_sha256")
    found = audits.join(counted, F.col("conv").eqNullSafe(F.col("c")), "left")
    # open conversations of which no row is left
    all_dropped = opened.groupBy("conv").agg(F.min((F.col("fault") == 3).cast("int")).alias("x")).filter("x = 1")
    empty = all_dropped.select("conv", *(F.lit(0).cast("long").alias(x) for x in names), F.lit("").alias("audit"),
                               F.sha2(F.lit("").cast("binary"), 256).alias("repaired_sha256"))
    columns = ["conv", *names, "audit", "repaired_sha256"]
    result = first.filter("kind = 'done'").select(columns).unionAll(found.select(columns)).unionAll(empty.select(columns))
    said = None
    if messages:
        said = (first.unionAll(read).filter("kind = 'message'")
                .select(F.col("conv").alias(conv_col), "i", F.col("digest").alias("edit"), "role", "text"))
    return result.withColumnRenamed("conv", conv_col), said


def damage(rows: DataFrame) -> DataFrame:
    """The damage that the repair is tried on: by crc32 of ``conv_id:turn`` modulo 20, 0 drops a row (it stays
    as ``dropped``), 1 empties its text, 2 removes its full stops, 3 repeats it, 4 makes its role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
                       F.when(kind == 1, "").when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
                       (kind == 0).alias("dropped"), F.when(kind == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")
