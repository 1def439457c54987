"""The sequential cut of ordered features into parts, as a parallel prefix scan.

A part is closed before a row that would take it past its target, or after the row that reaches it.  So where a range of rows is cut depends on
the part that comes in from the left, but on nothing of it other than its bytes and rows; and it can only end within the range's first part.  A range
therefore tells, for each place where that part may end, how the rest is cut: a map from what comes in to what goes out.  Two neighbouring maps
make one of the same form and of bounded size (a part has at most so many rows), so ranges are composed FAN at a time, level by level, and what comes
in is handed down the same tree.  No task reads more than FAN maps, or more than one range."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from plotwise.operators.sequences import in_ranges, range_count
from plotwise.storage import bucketed, saved

#: Maps that one task composes.
FAN = 16
#: Stored bytes that a range stands for.  A range is held by a Python task with all its columns, which may be made from far fewer bytes than they take.
_CUT_BYTES = 2 << 20
_NEVER = np.iinfo(np.int64).max // 4


@dataclass(frozen=True)
class CutPolicy:
    target_bytes: int = 1 << 20
    max_rows: int = 8192
    max_feature_bytes: int = 4 << 20


def part_end(before: np.ndarray, guess: np.ndarray, n: int, at: int, used: int, rows: int, policy: CutPolicy) -> tuple[int, str | None]:
    """Where the part that goes on at this row ends, and why; None if it is still open after the last row.

    before: bytes before each row; guess: bytes with it, as it is taken for before it is decoded; used, rows: what the part has already."""
    room = policy.target_bytes - used + int(before[at])
    full = max(int(np.searchsorted(before, room)), at + 1)  # bytes reached by the row before
    ceiling = at + policy.max_rows - rows
    first, last = at + (rows == 0), min(full, ceiling, n)
    over = np.flatnonzero(guess[first:last] > room)  # a row that would pass the target
    if len(over):
        return first + int(over[0]), "size-target"
    if min(full, ceiling) > n:
        return n, None
    return (full, "size-target") if full <= ceiling else (ceiling, "row-ceiling")


class _Range:
    """The sizes of a range's rows, in order, and where parts end in it."""

    def __init__(self, table: pa.Table, policy: CutPolicy):
        table = table.sort_by("_place")
        self.policy, self.rows = policy, table.num_rows
        verts, wkb, attrs = (table.column(c).to_numpy().astype(np.int64) for c in ("verts", "wkb_len", "attr_bytes"))
        row = 20 * verts + 12 + attrs  # 16 and 4 bytes a vertex, 8 and 4 a row
        self.before = np.concatenate(([0], np.cumsum(row)))
        self.guess = np.append(self.before[:-1] + 20 * (wkb // 16) + 12 + attrs, _NEVER)
        self.table, self.oversize = table, wkb > policy.max_feature_bytes

    def end(self, at: int, used: int = 0, rows: int = 0) -> tuple[int, str | None]:
        return part_end(self.before, self.guess, self.rows, at, used, rows, self.policy)

    def chain(self, at: int) -> list[tuple[int, str | None]]:
        """Ends of the parts from a row on, at which a new one begins."""
        found = []
        while at < self.rows:
            at, why = self.end(at)
            found.append((at, why))
        return found


@dataclass
class CutMap:
    """What some ranges do to the part that comes in. The arrays go as far as a part that begins with the first row.

    closed, size, rows: for each place where the part may end, the parts closed from there on, and what the one open at last holds."""

    n: int
    total: int
    open: bool  # a part that begins with the first row is open after the last one
    before: np.ndarray
    guess: np.ndarray
    closed: np.ndarray
    size: np.ndarray
    rows: np.ndarray

    def first_end(self, used: int, rows: int, policy: CutPolicy) -> tuple[int, str | None]:
        reach = len(self.before) - 1
        at, why = part_end(self.before, self.guess, reach, 0, used, rows, policy)
        if why is None and not self.open:  # cut before the row that a part from the first row on would have ended with
            return reach, "size-target"
        return at, why

    def after(self, used: int, rows: int, policy: CutPolicy) -> tuple[int, int, int, str | None]:
        """Parts closed, bytes and rows of the open one, and why the one that came in was closed (None: it wasn't, or none came in)."""
        if not rows:
            return int(self.closed[0]), int(self.size[0]), int(self.rows[0]), None
        at, why = self.first_end(used, rows, policy)
        if why is None:
            return 0, used + self.total, rows + self.n, None
        return 1 + int(self.closed[at]), int(self.size[at]), int(self.rows[at]), why

    def then(self, other: CutMap, policy: CutPolicy) -> CutMap:
        """This map and then the other, as one."""
        known: dict[tuple[int, int], tuple] = {}
        out = np.empty((3, len(self.closed)), np.int64)
        for k, state in enumerate(zip(self.size.tolist(), self.rows.tolist(), strict=True)):
            if state not in known:
                known[state] = other.after(*state, policy)
            more, size, rows, _ = known[state]
            out[:, k] = self.closed[k] + more, size, rows
        before, guess, open_ = self.before, self.guess, False
        if self.open:  # a part from the first row on goes on in the other
            at, why = other.first_end(self.total, self.n, policy)
            open_ = why is None
            before = np.concatenate((before, self.total + other.before[1 : at + 1]))
            guess = np.concatenate((guess[: self.n], np.minimum(self.total + other.guess[: at + 1], _NEVER)))
            out = np.concatenate((out, np.stack((other.closed, other.size, other.rows))[:, 1 : at + 1]), axis=1)
        return CutMap(self.n + other.n, self.total + other.total, open_, before, guess, *out)


def range_map(r: _Range) -> CutMap:
    reach, why = r.end(0)
    known: dict[int, tuple[int, int, int]] = {r.rows: (0, 0, 0)}  # first row of a part: parts closed from there on, bytes and rows of the open one
    for start in range(reach, -1, -1):
        path, at = [], start
        while at not in known:
            to, ended = r.end(at)
            if ended is None:
                known[at] = (0, int(r.before[-1] - r.before[at]), r.rows - at)
            else:
                path.append(at)
                at = to
        for at in reversed(path):
            n, size, rows = known[r.end(at)[0]]
            known[at] = (n + 1, size, rows)
    columns = np.array([known[k] for k in range(reach + 1)], np.int64).T
    return CutMap(r.rows, int(r.before[-1]), why is None, r.before[: reach + 1], r.guess[: reach + 1], *columns)


_LISTS = ("before", "guess", "closed", "size", "rows")
_MAPS = "node long, n long, total long, open boolean, nulls long, negatives long, repeats long, refused long, " + ", ".join(f"{c} array<long>" for c in _LISTS)
_CHECKS = ("nulls", "negatives", "repeats", "refused")
_CODES = ("identity_null", "identity_negative", "identity_duplicate", "geometry_refused")


def _row(node: int, m: CutMap, checks: list[int]) -> pa.Table:
    counts = {c: pa.array([v], pa.int64()) for c, v in zip(_CHECKS, checks, strict=True)}
    lists = {c: pa.array([getattr(m, c)], pa.list_(pa.int64())) for c in _LISTS}
    return pa.table({"node": pa.array([node], pa.int64()), "n": pa.array([m.n], pa.int64()), "total": pa.array([m.total], pa.int64()), "open": pa.array([m.open]), **counts, **lists})


def _maps(table: pa.Table) -> tuple[list[int], list[CutMap]]:
    table = table.sort_by("node")
    lists = [[np.array(x, np.int64) for x in table.column(c).to_pylist()] for c in _LISTS]
    facts = (table.column(c).to_pylist() for c in ("n", "total", "open"))
    return table.column("node").to_pylist(), [CutMap(*values) for values in zip(*facts, *lists, strict=True)]


def _told(policy: CutPolicy):
    def run(table: pa.Table) -> pa.Table:
        """A range's map; and of its ids, which are in order, how many are null, negative, or equal to the one before; and the shapes refused."""
        r = _Range(table, policy)
        ids = r.table.column("id")
        known = ids.drop_null().to_numpy()
        checks = [ids.null_count, (known < 0).sum(), (known[1:] == known[:-1]).sum(), (r.table.column("verts").to_numpy() < 0).sum()]
        return _row(table.column("_range")[0].as_py(), range_map(r), [int(n) for n in checks])

    return run


def _composed(policy: CutPolicy):
    def run(table: pa.Table) -> pa.Table:
        nodes, maps = _maps(table)
        whole = maps[0]
        for m in maps[1:]:
            whole = whole.then(m, policy)
        return _row(nodes[0] // FAN, whole, [sum(table.column(c).to_pylist()) for c in _CHECKS])

    return run


_STATES = "node long, used long, rows long, part long, last_why string"
_STATE = pa.schema([("node", pa.int64()), ("used", pa.int64()), ("rows", pa.int64()), ("part", pa.int64()), ("last_why", pa.string())])


def _handed_down(policy: CutPolicy):
    def run(table: pa.Table, parent: pa.Table) -> pa.Table:
        """What comes into each child: bytes and rows of the open part, its number; and why the part that is open after the child ends."""
        if not table.num_rows:
            return _STATE.empty_table()
        nodes, maps = _maps(table)
        state = parent.to_pylist()[0]
        used, rows, part = state["used"], state["rows"], state["part"]
        entered, why = [], []
        for m in maps:
            entered.append((used, rows, part))
            closed, used, rows, ended = m.after(used, rows, policy)
            why.append(ended)
            part += closed
        last = [state["last_why"]] * len(maps)
        for k in range(len(maps) - 2, -1, -1):
            last[k] = why[k + 1] or last[k + 1]
        return pa.table([pa.array(nodes, pa.int64()), *(pa.array([e[k] for e in entered], pa.int64()) for k in range(3)), pa.array(last, pa.string())], schema=_STATE)

    return run


class Cut:
    """Features (id, verts, wkb_len, attr_bytes and any other columns), in the order of their ids and cut into parts."""

    def __init__(self, features: DataFrame, policy: CutPolicy = CutPolicy(), partitions: int | None = None):
        self.policy, self.columns = policy, features.columns
        self.ranges = partitions or range_count(features, _CUT_BYTES)
        self.schema = features.schema
        #: All columns are written once, in ranges of ids; what follows reads them there.
        self.dealt = bucketed(in_ranges(features, ["id"], self.ranges), "cut-ranges", self.ranges, "_range")
        sizes = self.dealt.select("id", "_range", "_place", *(F.col(c).cast("long").alias(c) for c in ("verts", "wkb_len", "attr_bytes")))
        self.levels = [saved(sizes.groupBy("_range").applyInArrow(_told(policy), _MAPS), "cut-maps")]
        width = 1 + (self.levels[0].agg(F.max("node")).first()[0] or 0)
        while width > 1:
            nodes = self.levels[-1].withColumn("parent", F.expr(f"node div {FAN}"))
            self.levels.append(saved(nodes.groupBy("parent").applyInArrow(_composed(policy), _MAPS), "cut-maps"))
            width = -(-width // FAN)

    def refusal(self) -> tuple[int, str | None]:
        """The rows, and the first thing that is wrong with any of them: identity_null, identity_negative, identity_duplicate, geometry_refused."""
        top = self.levels[-1].select("n", *_CHECKS).first()  # one row: the root, or none
        if top is None:
            return 0, None
        return top["n"], next((code for code, c in zip(_CODES, _CHECKS, strict=True) if top[c]), None)

    def states(self) -> DataFrame:
        """What comes into each range."""
        spark = self.dealt.sparkSession
        states = spark.createDataFrame([(0, 0, 0, 0, "stream-end")], _STATES)
        for maps in reversed(self.levels[:-1] if len(self.levels) > 1 else []):
            children = maps.withColumn("parent", F.expr(f"node div {FAN}")).groupBy("parent")
            above = states.withColumnRenamed("node", "parent").groupBy("parent")
            states = children.cogroup(above).applyInArrow(_handed_down(self.policy), _STATES)
        return states

    def rows(self) -> DataFrame:
        """The features with part, cut_by and oversize, each range's rows in order."""
        own = self.dealt.select(*self.columns, "_range", "_place")
        kinds = StructType([*self.schema, StructField("part", LongType()), StructField("cut_by", StringType()), StructField("oversize", BooleanType())])
        states = self.states().withColumnRenamed("node", "_range")
        return own.groupBy("_range").cogroup(states.groupBy("_range")).applyInArrow(_cut(self.policy, self.columns, to_arrow_schema(kinds)), kinds)


def _cut(policy: CutPolicy, columns: list[str], schema: pa.Schema):
    def run(table: pa.Table, states: pa.Table) -> pa.Table:
        """A range's rows with the numbers of their parts."""
        if not table.num_rows:
            return schema.empty_table()
        r, state = _Range(table, policy), states.to_pylist()[0]
        first = [r.end(0, state["used"], state["rows"])] if state["rows"] else []
        ends = first + r.chain(first[0][0] if first else 0)
        size = np.diff([0, *(e for e, _ in ends)])
        part = np.repeat(state["part"] + np.arange(len(ends)), size)
        why = np.repeat(np.array([w or state["last_why"] for _, w in ends], object), size)
        found = [r.table.column(c) for c in columns] + [pa.array(part), pa.array(why, pa.string()), pa.array(r.oversize)]
        return pa.table(found, names=schema.names).cast(schema)

    return run


def cut_partitions(rows: DataFrame, policy: CutPolicy = CutPolicy(), partitions: int | None = None) -> DataFrame:
    """(id, part, cut_by, oversize) of each feature: rows (id, verts, wkb_len, attr_bytes) in id order, cut before a part grows past the target."""
    return Cut(rows.select("id", "verts", "wkb_len", "attr_bytes"), policy, partitions).rows().select("id", "part", "cut_by", "oversize")
