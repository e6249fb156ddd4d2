"""Choice among candidate readings along the record order of each source.

Each record has an array of candidate readings. The chosen path through a source's records
minimises the conventions broken, then format switches and backward time jumps (Viterbi).

The order is cut into range partitions, so a source with most of the rows is spread over many
tasks. A first pass reduces each partition's part of a source to the cost of getting from each
candidate of its first record to each of its last (a min-plus matrix of a few numbers); the driver
chains these, one or two small rows per partition, never per record; a second pass solves each part
between its fixed ends. The result costs what a single pass over the whole order would cost.

Both passes stream: a record with a single candidate decouples what lies on its two sides, so only
the records since the last such one are held, whatever the size of the partition.

For sources without stated conventions. Those of problem 1 leave nothing to choose, so no query runs it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reliable, ship

BREAK, SWITCH, BACKWARD = 1_000_000, 1, 2

Cands = list[tuple[int, int, int]]


class _Rows:
    """A batch's candidates; records without one are passed over."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        cands = batch.column(batch.schema.get_field_index("_cands"))
        offsets = cands.offsets.to_numpy().astype(np.int64)
        flat = cands.values
        self.off = offsets - offsets[0]
        take = lambda i: flat.field(i).to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        self.form, self.at, self.cost = take(0), take(1), take(2).astype(np.int64) * BREAK
        sizes = np.diff(self.off)
        self.group = batch.column(batch.schema.get_field_index("_group"))
        changed = pc.fill_null(pc.not_equal(self.group[1:], self.group[:-1]), False).to_numpy(zero_copy_only=False) if len(sizes) > 1 else np.zeros(0, dtype=bool)
        self.rows = np.flatnonzero(sizes)
        #: Of the rows with candidates: whether there are several, and which group within the batch.
        self.many = sizes[self.rows] > 1
        self.part = np.r_[0, np.cumsum(changed)][self.rows] if len(sizes) else self.rows
        self.picked = np.where(sizes > 0, 0, -1)

    def cands(self, k: int) -> Cands:
        """Candidates of the k-th row that has any."""
        r = self.rows[k]
        s = slice(self.off[r], self.off[r + 1])
        return list(zip(self.form[s].tolist(), self.at[s].tolist(), self.cost[s].tolist(), strict=True))

    def name(self, k: int) -> str:
        return self.group[int(self.rows[k])].as_py()

    def fresh(self) -> np.ndarray:
        """Whether a row with candidates is the first of its group in the batch."""
        return np.r_[True, self.part[1:] != self.part[:-1]]

    def telling(self, fresh: np.ndarray) -> list[int]:
        """Ambiguous rows and those next to one, the ends of the batch and of groups: all others follow
        and precede a certain row, so they are as they are and cost every path the same."""
        look = self.many | fresh | np.r_[fresh[1:], False]
        look[1:] |= self.many[:-1]
        look[:-1] |= self.many[1:]
        look[[0, -1]] = True
        return np.flatnonzero(look).tolist()

    def result(self, names: list[str], out: str) -> pa.RecordBatch:
        """The columns ``names`` and the chosen candidates."""
        none = self.picked < 0
        at = np.where(none, 0, self.off[:-1] + self.picked)
        col = lambda v, t: pa.array(v[at] if len(v) else np.zeros(len(at), dtype=np.int64), type=t, mask=none)
        chosen = pa.StructArray.from_arrays(
            [col(self.form, pa.int32()), col(self.at, pa.int64()), col(self.cost // BREAK, pa.int32())], names=["form", "at", "breaks"], mask=pa.array(none)
        )
        kept = [self.batch.column(self.batch.schema.get_field_index(c)) for c in names]
        return pa.RecordBatch.from_arrays([*kept, chosen], names=[*names, out])


def _move(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
    """Cost of going from one reading to the next, the cost of the reading moved to included."""
    return b[2] + SWITCH * (a[0] != b[0]) + BACKWARD * (b[1] < a[1])


def _solve(path: list[Cands], first: int | None, last: int | None) -> list[int]:
    """Chosen candidate of each record; the first and the last may be fixed."""
    far = 1 << 60
    d = [c[2] + (0 if first is None or i == first else far) for i, c in enumerate(path[0])]
    back: list[list[int]] = []
    for prev, cur in zip(path, path[1:], strict=False):
        best = [min((d[i] + _move(a, c), i) for i, a in enumerate(prev)) for c in cur]
        back.append([i for _, i in best])
        d = [x for x, _ in best]
    at = min(range(len(d)), key=d.__getitem__) if last is None else last
    out = [at]
    for pick in reversed(back):
        at = pick[at]
        out.append(at)
    return out[::-1]


_SUMMARY = T.StructType([
    T.StructField("block", T.IntegerType()), T.StructField("place", T.StringType()), T.StructField("grp", T.StringType()),
    T.StructField("form_a", T.ArrayType(T.LongType())), T.StructField("at_a", T.ArrayType(T.LongType())), T.StructField("cost_a", T.ArrayType(T.LongType())),
    T.StructField("form_b", T.ArrayType(T.LongType())), T.StructField("at_b", T.ArrayType(T.LongType())),
    T.StructField("matrix", T.ArrayType(T.ArrayType(T.LongType()))),
])


class _Part:
    """A group's part of a partition, reduced as its rows go by: the candidates of its first and last
    row and the least cost from each of the first (its own cost left out) to each of the last."""

    def __init__(self, group: str, cands: Cands):
        self.group, self.first, self.last = group, cands, cands
        self.matrix = [[0 if i == j else 1 << 60 for j in range(len(cands))] for i in range(len(cands))]

    def go(self, cands: Cands) -> None:
        cost = [[_move(a, b) for b in cands] for a in self.last]
        self.matrix = [[min(x + c[j] for x, c in zip(row, cost, strict=True)) for j in range(len(cands))] for row in self.matrix]
        self.last = cands

    def summary(self, place: str) -> dict:
        turn = lambda cands, i: [c[i] for c in cands]
        return {
            "block": TaskContext.get().partitionId(), "place": place, "grp": self.group, "form_a": turn(self.first, 0), "at_a": turn(self.first, 1),
            "cost_a": turn(self.first, 2), "form_b": turn(self.last, 0), "at_b": turn(self.last, 1), "matrix": self.matrix,
        }


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's first and last group: at most two rows."""
    head: _Part | None = None
    part: _Part | None = None
    for batch in batches:
        rows = _Rows(batch)
        n = len(rows.rows)
        if not n:
            continue
        # Between two records with one candidate each every path pays the same: nothing to compare.
        fresh = rows.fresh()
        for k in rows.telling(fresh):
            c = rows.cands(k)
            if part is None or (fresh[k] and rows.name(k) != part.group):
                head = head or part
                part = _Part(rows.name(k), c)
            else:
                part.go(c)
    if part is None:
        return
    out = [part.summary("whole")] if head is None else [head.summary("head"), part.summary("tail")]
    yield pa.RecordBatch.from_pylist(out, schema=_ARROW_SUMMARY)


_ARROW_SUMMARY = pa.schema([
    ("block", pa.int32()), ("place", pa.string()), ("grp", pa.string()), ("form_a", pa.list_(pa.int64())), ("at_a", pa.list_(pa.int64())),
    ("cost_a", pa.list_(pa.int64())), ("form_b", pa.list_(pa.int64())), ("at_b", pa.list_(pa.int64())), ("matrix", pa.list_(pa.list_(pa.int64()))),
])


def _step(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """Cost of each move, the cost of the reading moved to included."""
    return b[2][None, :] + SWITCH * (a[0][:, None] != b[0][None, :]) + BACKWARD * (b[1][None, :] < a[1][:, None])


def _chain(rows: list[dict]) -> dict[tuple[int, str], tuple[int, int]]:
    """For each segment of a group that runs over several blocks: its first and last choice."""
    fixed: dict[tuple[int, str], tuple[int, int]] = {}
    rows = sorted(rows, key=lambda r: (r["block"], r["place"] == "tail"))
    i = 0
    while i < len(rows):
        j = i
        while j + 1 < len(rows) and rows[j + 1]["grp"] == rows[j]["grp"] and rows[j]["place"] != "head":
            j += 1
        run = rows[i : j + 1]
        if len(run) > 1:
            d = None
            trace = []
            for k, r in enumerate(run):
                a = tuple(np.array(r[x], dtype=np.int64) for x in ("form_a", "at_a", "cost_a"))
                if d is None:
                    enter, pick = a[2], None
                else:
                    m = d[:, None] + _step(prev, a)  # noqa: F821
                    pick = m.argmin(axis=0)
                    enter = m.min(axis=0)
                through = enter[:, None] + np.array(r["matrix"], dtype=np.int64)
                trace.append((pick, through.argmin(axis=0)))
                d = through.min(axis=0)
                prev = (np.array(r["form_b"], dtype=np.int64), np.array(r["at_b"], dtype=np.int64), None)
            end = int(d.argmin())
            for r, (pick, first_of) in zip(reversed(run), reversed(trace), strict=True):
                first = int(first_of[end])
                fixed[(r["block"], r["place"])] = (first, end)
                end = int(pick[first]) if pick is not None else 0
        i = j + 1
    return fixed


def choose_path(
    df: DataFrame, group: str, order: list[str], candidates: str, out: str = "chosen",
    generate: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``df`` plus ``out``: the chosen candidate struct of each record, null if it has none.

    ``group`` separates the sources, ``order`` is the record order in each, ``candidates`` an
    array of ``struct(form, at, breaks)``. ``generate`` adds that column after the range
    partitioning (so sampling for the ranges does not compute it); it must keep rows in place.
    Records without a candidate do not influence their neighbours. A null group is a source of
    its own. Empty input gives an empty result; other columns pass through.
    """
    keyed = df.withColumn("_group", F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("n")))
    keys = [F.col("_group"), *[F.col(c) for c in order]]
    # A stated number keeps small inputs spread: making candidates is the costly part, not the rows.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    made = generate(ranged) if generate else ranged
    schema = T.StructType([*made.drop("_group").schema.fields, T.StructField(out, made.schema[candidates].dataType.elementType)])
    names = [f.name for f in schema.fields if f.name != out]
    ship(df.sparkSession)
    blocks = reliable(made.withColumn("_cands", F.coalesce(candidates, F.array().cast(made.schema[candidates].dataType))))
    # One or two small rows per block: their number is the number of partitions.
    fixed = _chain([r.asDict(recursive=True) for r in blocks.select("_group", "_cands").mapInArrow(_summaries, _SUMMARY).collect()])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = TaskContext.get().partitionId()
        enter = next((fixed[me, p][0] for p in ("whole", "head") if (me, p) in fixed), None)
        leave = next((fixed[me, p][1] for p in ("whole", "tail") if (me, p) in fixed), None)
        walk = _Walk(enter)
        for batch in batches:
            for rows in walk.take(_Rows(batch)):
                yield rows.result(names, out)
        for rows in walk.end(leave):
            yield rows.result(names, out)

    return blocks.mapInArrow(finish, schema)


class _Walk:
    """Solves the runs of ambiguous records as they go by, each between the certain ones around it."""

    def __init__(self, enter: int | None):
        self.enter = enter
        self.group: str | None = None
        self.before: Cands | None = None  # the last record, if it is certain and of the group at hand
        self.run: list[tuple[_Rows, int, Cands]] = []
        self.begun = False
        self.waiting: list[_Rows] = []

    def _close(self, after: Cands | None, last: int | None = None) -> None:
        if not self.run:
            return
        path = [c for _, _, c in self.run]
        lead = [self.before] if self.before else []
        picked = _solve(lead + path + ([after] if after else []), None if lead else self.enter_here, None if after else last)
        for (rows, r, _), i in zip(self.run, picked[len(lead) :], strict=False):
            rows.picked[r] = i
        self.run = []

    def take(self, rows: _Rows) -> list[_Rows]:
        """The batches that are solved once this one has been seen."""
        self.waiting.append(rows)
        n = len(rows.rows)
        if n:
            fresh = rows.fresh()
            for k in rows.telling(fresh):
                new = fresh[k] and rows.name(k) != self.group
                if new:
                    self._close(None)
                    self.group, self.before = rows.name(k), None
                if rows.many[k]:
                    if not self.run and self.before is None:
                        # Only the very first record of a partition has its choice fixed from outside.
                        self.enter_here = None if self.begun else self.enter
                    self.run.append((rows, int(rows.rows[k]), rows.cands(k)))
                else:
                    c = rows.cands(k)
                    self._close(c)
                    self.before = c
                self.begun = True
        first = self.run[0][0] if self.run else None
        cut = self.waiting.index(first) if first is not None else len(self.waiting)
        done, self.waiting = self.waiting[:cut], self.waiting[cut:]
        return done

    def end(self, leave: int | None) -> list[_Rows]:
        self._close(None, leave)
        return self.waiting
