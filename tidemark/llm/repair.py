"""Repair of the structure of conversations by the cheapest edits.

A conversation is sound if the initials of its roles are an optional s and then pairs of u and a, or nothing. Rows
can be kept as they are (0), get the role user or assistant (3), or go (4); rows of these roles with an empty text can
be put in anywhere (3). Blank rows, and rows whose role and text were seen before in the conversation, must go; a
truncated row that stays costs 3 more. Of the cheapest edits those count whose initials in order (D, I, K, R) are
least as ASCII text: the audit.

Method, run-length dynamic programming: a row is a symbol (initial and fault), the states are what a sound
conversation may have ended with so far (nothing, s, u, a), and a symbol's transition is a min-plus matrix of costs.
Equal consecutive symbols are a run; a run's matrix is its length's product of cached binary powers. Costs to go are
advanced through the runs from the end, and the choices are then unrolled from the start: in each state the least
letter that keeps the cost.

Spark's part: rows are numbered along their order without gathering a conversation (``running_count``), and cut into
segments of ``SEGMENT`` rows, which are what one task holds. A conversation of one segment is solved at once. Of a
longer one each segment gives its matrix; one row per segment meets to get the costs to go behind each; each segment
then tells which state it ends in for each state it may begin in, and these are put together to the state it begins
in. So a conversation that holds a third of all rows is worked on by many tasks; only its audit, which is one value,
and its digest, which is one chain, are not.

Defined results: rows are ordered by turn, nulls first, and rows of the same turn by role and text; equal rows can't
be told apart, and all but one of them are duplicates. A null role or text is one space. A null ``conv_id`` is a
conversation of its own. Texts may be of any length, and are looked at whole. Other columns take no part. An empty
table gives empty tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.components import written
from tidemark.operators.counting import running_count

SEGMENT = 50_000

# Costs, faults, white space, and the characters a text may end with.
RECAST, DELETE, INSERT, TRUNCATED_STAYS = 3, 4, 3, 3
FAULTS = ("", "blank", "duplicate", "truncated")
INITIALS = "sua?"
LEGAL = ("su", "ua", "au")
INK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

STATES = range(4)  # nothing yet, s, u, a
FAR = 1 << 40
_KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "?": {}}
_PLACE = {0: 2, 1: 2, 2: 3, 3: 2}  # the state after a row that is put in, or given a fitting role
_ROLE = {2: "u", 3: "a"}
FULL = {"u": "user", "a": "assistant"}


def at_the_end(state: int) -> str:
    """Initials of the rows that must still be put in."""
    return {0: "", 1: "ua", 2: "a", 3: ""}[state]


END = tuple(INSERT * len(at_the_end(s)) for s in STATES)


def letter(initial: str, fault: int) -> str:
    return chr(65 + 4 * INITIALS.index(initial) + fault)


def _choices(symbol: str) -> list[list[tuple[str, int, int, str]]]:
    """For each state what can be done with a row: (edit, cost, next state, new role's initial)."""
    code = ord(symbol) - 65
    initial, fault = INITIALS[code // 4], FAULTS[code % 4]
    out: list[list[tuple[str, int, int, str]]] = [[("D", DELETE, s, "")] for s in STATES]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED_STAYS if fault == "truncated" else 0
        for s in STATES:
            if s in _KEEP[initial]:
                out[s].append(("K", more, _KEEP[initial][s], ""))
            out[s].append(("R", RECAST + more, _PLACE[s], _ROLE[_PLACE[s]]))
    return out


@lru_cache(maxsize=None)
def transition(symbol: str) -> np.ndarray:
    """Least cost from a state before a row to a state after it, rows put in before it included."""
    cost = np.full((4, 4), FAR, np.int64)
    for s, options in enumerate(_choices(symbol)):
        for _, c, after, _ in options:
            cost[s, after] = min(cost[s, after], c)
    for _ in STATES:  # a row put in first
        for s in STATES:
            cost[s] = np.minimum(cost[s], INSERT + cost[_PLACE[s]])
    return np.minimum(cost, FAR)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of a matrix with a matrix or a vector."""
    if b.ndim == 1:
        return np.minimum((a + b[None, :]).min(1), FAR)
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


@lru_cache(maxsize=None)
def doubled(symbol: str, k: int) -> np.ndarray:
    """The transition of ``2**k`` equal rows."""
    half = transition(symbol) if k == 0 else doubled(symbol, k - 1)
    return half if k == 0 else times(half, half)


def through(symbol: str, length: int, after: np.ndarray) -> np.ndarray:
    """Costs before a run of rows from those after it (a vector, or a matrix of them)."""
    for k in range(length.bit_length()):
        if length >> k & 1:
            after = times(doubled(symbol, k), after)
    return after


def runs(letters: str) -> list[tuple[str, int]]:
    return [(symbol, sum(1 for _ in group)) for symbol, group in groupby(letters)]


def matrix(letters: str) -> np.ndarray:
    """The transition of a whole segment."""
    out = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
    for symbol, length in reversed(runs(letters)):
        out = through(symbol, length, out)
    return out


def _relative(costs: np.ndarray) -> tuple[int, ...]:
    return tuple(np.minimum(costs - costs.min(), FAR).tolist())


@lru_cache(maxsize=100_000)
def _before(symbol: str, length: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a run, relative to the least, from those after it."""
    return _relative(through(symbol, length, np.array(after, np.int64)))


@lru_cache(maxsize=100_000)
def _best(symbol: str, after: tuple[int, ...]) -> tuple[tuple[str, str, str, int], ...]:
    """For each state before a row: initials of rows put in, edit, new role's initial, and the state after it."""
    options = _choices(symbol)
    cost = times(transition(symbol), np.array(after, np.int64)).tolist()
    out = []
    for s in STATES:
        put = ""
        while True:
            fitting = [(e, nxt, role) for e, c, nxt, role in options[s] if c + after[nxt] == cost[s]]
            if INSERT + cost[_PLACE[s]] == cost[s]:
                fitting.append(("I", _PLACE[s], _ROLE[_PLACE[s]]))
            edit, nxt, role = min(fitting)
            if edit != "I":
                break
            put, s = put + role, nxt
        out.append((put, edit, role, nxt))
    return tuple(out)


def unroll(letters: str, after: Iterable[int], entry: int) -> tuple[list[tuple[str, str, str]], int]:
    """Per row the initials of rows put in before it, its edit, and its new role's initial; and the last state.

    The costs to go are advanced run by run; within a run row by row. They are relative to the least, so that there
    are few of them and what follows from each is remembered.
    """
    ends = [_relative(np.array(list(after), np.int64))]
    cut = runs(letters)
    for symbol, length in reversed(cut[1:]):
        ends.append(_before(symbol, length, ends[-1]))
    out, state = [], entry
    for (symbol, length), costs in zip(cut, reversed(ends), strict=True):
        ways = []
        for _ in range(length):
            ways.append(_best(symbol, costs))
            costs = _before(symbol, 1, costs)
        for way in reversed(ways):
            put, edit, role, state = way[state]
            out.append((put, edit, role))
    return out, state


# --- Spark ---------------------------------------------------------------------


def ordered(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``seq``, the number of a row in its conversation; written."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    plain = rows.select("conv_id", "turn", space("role"), space("text"))
    return written(running_count(plain, "conv_id", ["turn", "role", "text"]), "turns")


def _symbols(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``seq`` and the symbol of each row."""
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    first = F.substring("role", 1, 1)
    initial = F.coalesce(*[F.when(first == c, i) for i, c in enumerate(INITIALS[:3])], F.lit(3))
    signs = turns.select(
        "conv_id", "seq", same.alias("same"), initial.alias("initial"), (~F.col("text").rlike(INK)).alias("blank"), F.col("text").rlike(ENDED).alias("ended")
    )
    # Few rows come more than once, so what is joined is small; where it isn't, the join is by row and conversation.
    often = signs.groupBy("conv_id", "same").agg(F.min("seq").alias("earliest"), F.count("*").alias("times")).where("times > 1")
    often = often.select(F.col("conv_id").alias("its_conv"), F.col("same").alias("its_same"), "earliest")
    on = signs["conv_id"].eqNullSafe(often["its_conv"]) & (signs["same"] == often["its_same"])
    fault = F.when(F.col("blank"), 1).when(F.col("seq") > F.col("earliest"), 2).when(~F.col("ended"), 3).otherwise(0)
    code = F.chr((65 + 4 * F.col("initial") + fault).cast("long"))
    return signs.join(often, on, "left").select("conv_id", "seq", code.alias("symbol"))


def _segments(turns: DataFrame, segment: int) -> DataFrame:
    """``conv_id``, ``seg``, the symbols of its rows as ``letters``, and the number of segments (``parts``); written."""
    number = F.floor((F.col("seq") - 1) / segment).cast("long").alias("seg")
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "symbol"))), lambda r: r["symbol"]), "")
    cut = _symbols(turns).groupBy("conv_id", number).agg(letters.alias("letters"))
    length = turns.groupBy("conv_id").agg(F.ceil(F.max("seq") / segment).cast("long").alias("parts"))
    parts = length.where("parts > 1").select(F.col("conv_id").alias("its_conv"), "parts")
    found = cut.join(parts, cut["conv_id"].eqNullSafe(parts["its_conv"]), "left")
    return written(found.select("conv_id", "seg", "letters", F.coalesce("parts", F.lit(1)).alias("parts")), "segments")


def _mapped(df: DataFrame, added: str, work) -> DataFrame:
    """``df`` with columns that ``work(*row)`` gives for each row."""
    schema = df.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in (a.split(" ", 1) for a in added.split("; "))]).schema
    names = [a.split(" ", 1)[0] for a in added.split("; ")]
    fields = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                made = [work(*row) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                columns = list(zip(*made, strict=True)) if made else [[]] * len(names)
                arrays = [*part.columns, *(pa.array(list(c), fields.field(n).type) for n, c in zip(names, columns, strict=True))]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, fields, strict=True)], schema=fields)

    return df.mapInArrow(run, schema)


def _per_conversation(df: DataFrame, added: str, work) -> DataFrame:
    """A row per segment with what ``work`` makes of all segments of its conversation, which are one row each."""
    name, kind = added.split(" ", 1)
    others = [c for c in df.columns if c != "conv_id"]
    gathered = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*others))).alias("all"))
    found = _mapped(gathered, f"{name} array<{kind}>", lambda _, rows: (work(rows),))
    one = F.explode(F.arrays_zip("all", name)).alias("one")
    return found.select("conv_id", one).select("conv_id", *[F.col(f"one.all.{c}").alias(c) for c in others], F.col(f"one.{name}").alias(name))


def _suffixes(rows: list[dict]) -> list[list[int]]:
    """The costs to go behind each segment."""
    out, costs = [], np.array(END, np.int64)
    for row in reversed(rows):
        out.append(costs.tolist())
        costs = times(np.array(row["costs"], np.int64).reshape(4, 4), costs)
    return out[::-1]


def _entries(rows: list[dict]) -> list[int]:
    """The state each segment begins in."""
    out, state = [], 0
    for row in rows:
        out.append(state)
        state = row["leaves"][state]
    return out


def _solved(letters: str, after: list[int], entry: int, last: bool) -> tuple:
    rows, state = unroll(letters, after, entry)
    end = at_the_end(state) if last else ""
    audit = "".join("I" * len(put) + edit for put, edit, _ in rows) + "I" * len(end)
    cost = INSERT * audit.count("I") + RECAST * audit.count("R") + DELETE * audit.count("D")
    codes = [ord(c) - 65 for c in letters]
    cost += sum(TRUNCATED_STAYS for c, (_, edit, _) in zip(codes, rows, strict=True) if c % 4 == 3 and edit != "D")
    initials = "".join(INITIALS[c // 4] for c in codes)
    illegal = sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))
    faults = [sum(c % 4 == k for c in codes) for k in (1, 2, 3)]
    edits = [{"put": p, "edit": e, "role": r} for p, e, r in rows]
    return audit, cost, *faults, illegal, initials[0], initials[-1], edits, end


def solve(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The edits of ordered rows (``ordered``), by segment; written.

    ``conv_id``, ``seg``, ``audit``, ``cost``, ``blank``, ``duplicate``, ``truncated``, ``illegal`` (within the
    segment), ``first`` and ``last`` initial, ``edits`` (per row: initials of rows put in before it, edit, new role's
    initial), and ``tail``: initials of rows put in behind the last one.
    """
    segments = _segments(turns, segment)
    begins = segments.where("parts = 1").withColumns({"after": F.array(*map(F.lit, END)).cast("array<long>"), "entry": F.lit(0).cast("long")})
    long = segments.where("parts > 1")
    if long.head(1):
        costs = _mapped(long, "costs array<bigint>", lambda conv, seg, letters, parts: (matrix(letters).ravel().tolist(),))
        behind = _per_conversation(costs.select("conv_id", "seg", "costs"), "after array<bigint>", _suffixes)
        joined = _joined(long, behind.select("conv_id", "seg", "after"))
        leaves = _mapped(joined, "leaves array<bigint>", lambda conv, seg, letters, parts, after: ([unroll(letters, after, s)[1] for s in STATES],))
        entry = _per_conversation(leaves.select("conv_id", "seg", "leaves"), "entry bigint", _entries)
        begins = begins.unionByName(_joined(joined, entry.select("conv_id", "seg", "entry")))
    added = (
        "audit string; cost bigint; blank bigint; duplicate bigint; truncated bigint; illegal bigint; first string; last string; "
        "edits array<struct<put: string, edit: string, role: string>>; tail string"
    )
    asked = begins.select("conv_id", "seg", "letters", "parts", "after", "entry")
    found = _mapped(asked, added, lambda conv, seg, letters, parts, after, entry: _solved(letters, after, entry, seg + 1 == parts))
    return written(found.drop("letters", "parts", "after", "entry"), "repairs")


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """By conversation and segment; a null conversation is one like any other."""
    right = right.withColumnsRenamed({"conv_id": "its_conv", "seg": "its_seg"})
    on = left["conv_id"].eqNullSafe(right["its_conv"]) & (left["seg"] == right["its_seg"])
    return left.join(right, on).drop("its_conv", "its_seg")


def reports(solved: DataFrame) -> DataFrame:
    """``conv_id``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit`` of each conversation."""
    parts = F.array_sort(F.collect_list(F.struct("seg", "audit", "first", "last")))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    per = solved.groupBy("conv_id").agg(*sums, parts.alias("parts"))
    pair = lambda p, i: F.concat(F.get(F.col("parts"), i - 1)["last"], p["first"])
    seams = F.filter("parts", lambda p, i: (i > 0) & ~pair(p, i).isin(*LEGAL))
    audit = F.array_join(F.transform("parts", lambda p: p["audit"]), "")
    return per.select("conv_id", "blank", "duplicate", "truncated", (F.col("illegal") + F.size(seams)).alias("illegal"), "cost", audit.alias("audit"))


def repaired(turns: DataFrame, solved: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The rows of the sound conversations: ``conv_id``, ``seq`` and ``sub`` (their order), ``edit``, ``role``, ``text``."""
    spread = solved.select("conv_id", "seg", F.posexplode("edits").alias("at", "e"))
    edits = spread.select(
        F.col("conv_id").alias("its_conv"), (F.col("seg") * segment + F.col("at") + 1).alias("its_seq"), F.col("e.put"), F.col("e.edit"), F.col("e.role").alias("new")
    )
    on = turns["conv_id"].eqNullSafe(edits["its_conv"]) & (turns["seq"] == edits["its_seq"])
    both = turns.join(edits, on).select("conv_id", "seq", "put", "edit", "new", "role", "text")
    tails = solved.where("tail <> ''").select("conv_id", (F.col("seg") * segment + F.size("edits") + 1).alias("seq"), F.col("tail").alias("put"), F.lit("I").alias("edit"))
    both = both.unionByName(tails, allowMissingColumns=True)
    full = lambda c: F.when(c == "u", FULL["u"]).when(c == "a", FULL["a"])
    row = lambda edit, role, text: F.struct(edit.alias("edit"), role.alias("role"), text.alias("text"))
    put = F.transform(F.filter(F.split("put", ""), lambda c: c != ""), lambda c: row(F.lit("I"), full(c), F.lit("")))
    own = row(F.col("edit"), F.when(F.col("edit") == "R", full(F.col("new"))).otherwise(F.col("role")), F.col("text"))
    stays = F.when(F.col("edit").isin("K", "R"), F.array(own)).otherwise(F.array().cast("array<struct<edit: string, role: string, text: string>>"))
    out = both.select("conv_id", "seq", F.posexplode(F.concat(put, stays)).alias("sub", "row"))
    return out.select("conv_id", "seq", "sub", "row.edit", "row.role", "row.text")


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id`` and the SHA-256 of its ``role:text``, joined by line feeds, in the order of ``seq`` and ``sub``.

    A conversation is one chain of hashing, so one task reads it, a batch of rows at a time.
    """
    schema = rows.select("conv_id", F.lit("").alias("sha256")).schema
    lined = rows.select("conv_id", "seq", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    lined = lined.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "sub").select("conv_id", "line")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, key, chain = False, None, None
        for batch in batches:
            done: list[tuple] = []
            for conv, line in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                if open_ and conv == key:
                    chain.update(b"\n")
                else:
                    if open_:
                        done.append((key, chain.hexdigest()))
                    open_, key, chain = True, conv, hashlib.sha256()
                chain.update(line.encode())
            yield _rows(done, batch.schema)
        if open_:
            yield _rows([(key, chain.hexdigest())], batch.schema)

    def _rows(done: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
        kinds = [fields.field(0).type, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=["conv_id", "sha256"])

    return lined.mapInArrow(run, schema)


def gaps(turns: DataFrame) -> DataFrame:
    """``conv_id`` and the number of turns that are missing between its first and last one."""
    per_turn = turns.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    missing = F.max("turn") - F.min("turn") + 1 - F.count("*")
    return per_turn.groupBy("conv_id").agg(missing.cast("long").alias("gaps"))


def null_safe(left: DataFrame, right: DataFrame, key: str = "conv_id") -> DataFrame:
    """``left`` with the columns of ``right``, by a key that may be null; rows without a partner stay."""
    right = right.withColumnRenamed(key, "its_key")
    return left.join(right, left[key].eqNullSafe(right["its_key"]), "left").drop("its_key")


def column_or(name: str, other) -> Column:
    return F.coalesce(F.col(name), F.lit(other)).alias(name)
