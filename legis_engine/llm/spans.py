"""Long exact spans shared between records.

A suffix tree of the whole corpus would hold every position of every text. Here it holds only
suffixes that start at anchors: in each window of the least span length the position whose
``SEED``-character content has the least hash. The choice depends on that content alone, so a
span shared by two records has the same anchors in both, and at least one.

1. Anchors are partitioned by the prefix of their suffix (its first ``SEED`` characters, as a
   hash). Prefixes seen in one record only are dropped before any text is moved.
2. The suffixes of a prefix form one subtree, built as sorted suffixes with the lengths of
   common prefixes; a twin order sorts the text before the anchors, read backwards. Partitions
   above ``GROUP`` suffixes are split by longer prefixes until they fit (``_split``): suffixes
   with equal text all round count once, the rest is divided by how far a repeat may reach behind
   the anchor, each band by as many characters on both sides as a repeat in it must share.
   Characters are compared in every form; hashes only bring candidates together.
3. Each internal node of a subtree is visited deepest first. Its depth plus the longest common
   text before the anchors of two of its suffixes from different records is a repeat; if that
   is long enough it extends the record's stretch around the anchor.

Context up to one span length on either side is enough: the anchors of a longer shared span lie
closer together than that, so their stretches join up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, ship

SPAN = 400
SEED = 100
GROUP = 5000
BAND = 50
BUCKETS = 1 << 20
_PIECE = 1 << 20
_ROWS = 20_000

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of them."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.ones(1, dtype=np.uint64)
            while len(p) < n:
                p = np.concatenate([p, p * np.uint64(pow(b, len(p), 1 << 64))])
            out.append(p)
        got = _POWERS[base] = (out[0], out[1])
    return got


def _mix(x: np.ndarray, c: int) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(c)
    x ^= x >> np.uint64(29)
    return x


def _rolling(codes: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Hash of each stretch of ``width`` characters; equal stretches have equal hashes."""
    n = len(codes)
    power, inverse = _powers(base, n + 1)
    x = _mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD), 0xC4CEB9FE1A85EC53)
    x *= power[:n]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(x, out=total[1:])
    h = total[width:] - total[:-width]
    h *= inverse[: len(h)]
    return _mix(h, 0xBF58476D1CE4E5B9)


def _slide(x: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over each window of w values, in two passes over blocks."""
    n = len(x)
    m = -(-n // w) * w
    padded = np.full(m, fill, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    head = op.accumulate(blocks, axis=1).ravel()
    tail = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tail[: n - w + 1], head[w - 1 : n])


def find_anchors(codes: np.ndarray, starts: np.ndarray, span: int = SPAN, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions and prefix hashes in texts laid end to end; ``starts`` of each text.

    Windows that run over the end of a text choose nothing. All positions of a tie are anchors.
    """
    if len(codes) < span:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = np.maximum(_rolling(codes, seed), np.uint64(1))
    w = span - seed + 1
    least = _slide(h, w, np.minimum, np.iinfo(np.uint64).max)
    ends = np.append(starts[1:], len(codes))
    inside = np.zeros(len(least) + 1, dtype=np.int32)
    ok = ends - starts >= span
    np.add.at(inside, starts[ok], 1)
    np.add.at(inside, np.minimum(ends[ok] - span + 1, len(least)), -1)
    least[np.cumsum(inside[:-1]) == 0] = 0
    padded = np.zeros(len(h) + w - 1, dtype=np.uint64)
    padded[w - 1 : w - 1 + len(least)] = least
    at = np.flatnonzero(_slide(padded, w, np.maximum, 0) == h)
    return at, h[at]


def _pieces(rows: list[tuple[int, int, str]], span: int) -> Iterator[list[tuple[int, int, int, str]]]:
    """(doc, row key, offset, text) in lists of about a million characters; a longer text is cut
    into pieces that overlap so that no window of the span length is lost."""
    held: list[tuple[int, int, int, str]] = []
    size = 0
    for doc, key, text in rows:
        if text is None or len(text) < span:
            continue
        for o in range(0, max(len(text) - span + 1, 1), _PIECE):
            part = text[o : o + _PIECE + span - 1] if len(text) > _PIECE else text
            held.append((doc, key, o, part))
            size += len(part)
            if size >= _PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


_ANCHOR = T.StructType([
    T.StructField("h", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("v", T.LongType()), T.StructField("pos", T.LongType()),
])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _rows(batch: pa.RecordBatch) -> list[tuple[int, int, str]]:
    return list(zip(*(c.to_pylist() for c in batch.columns), strict=True))


def anchors(docs: DataFrame, span: int, seed: int) -> DataFrame:
    """``h, doc_id, v, pos`` of each anchor; ``docs``: doc_id, v, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in _pieces(_rows(batch), span):
                sizes = np.array([len(t) for *_, t in held])
                starts = np.cumsum(sizes) - sizes
                at, h = find_anchors(_codes("".join(t for *_, t in held)), starts, span, seed)
                owner = np.searchsorted(starts, at, "right") - 1
                pick = lambda k: np.array([p[k] for p in held], dtype=np.int64)[owner]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(pick(0)), pa.array(pick(1)), pa.array(at - starts[owner] + pick(2))],
                    names=["h", "doc_id", "v", "pos"],
                )

    return docs.mapInArrow(run, _ANCHOR)


_CONTEXT = T.StructType([
    T.StructField("h", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("pos", T.LongType()),
    T.StructField("before", T.StringType()), T.StructField("after", T.StringType()),
])


def contexts(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """The text on either side of each wanted anchor, one span length at most.

    Texts without a wanted anchor are mostly set aside before anything is shuffled: by a list of the
    hash buckets that hold one, which has at most ``BUCKETS`` numbers however large the corpus is
    (with more such texts than buckets it lets more through, and the join decides).
    """
    # Per text its own anchors only: bounded by the text itself.
    per = wanted.groupBy("doc_id", "v").agg(F.collect_set(F.struct("pos", "h")).alias("at"))
    bucket = F.pmod(F.xxhash64("doc_id", "v"), F.lit(BUCKETS))
    docs = docs.withColumn("_b", bucket).join(F.broadcast(wanted.select(bucket.alias("_b")).distinct()), "_b", "left_semi").drop("_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, at in _rows(batch):
                for i in range(0, len(at), 2000):
                    some = at[i : i + 2000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([x["h"] for x in some], pa.int64()), pa.array([doc] * len(some), pa.int64()),
                            pa.array([x["pos"] for x in some], pa.int64()),
                            pa.array([text[max(0, x["pos"] - span) : x["pos"]] for x in some], pa.string()),
                            pa.array([text[x["pos"] : x["pos"] + span] for x in some], pa.string()),
                        ],
                        names=["h", "doc_id", "pos", "before", "after"],
                    )

    return docs.join(per, ["doc_id", "v"]).select("doc_id", "text", "at").mapInArrow(run, _CONTEXT)


def _common(order: np.ndarray, group: np.ndarray, texts: list[str], span: int) -> np.ndarray:
    """Common prefix length of neighbours in ``order``; -1 across groups."""
    out = np.full(max(len(order) - 1, 0), -1, dtype=np.int64)
    for lo in range(0, len(out), 4096):
        part = order[lo : lo + 4097]
        m = np.zeros((len(part), span), dtype=np.uint32)
        for r, i in enumerate(part):
            c = _codes(texts[i])
            m[r, : len(c)] = c + 1
        # The end of a text equals nothing.
        differ = (m[1:] != m[:-1]) | (m[1:] == 0)
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), span)
        out[lo : lo + len(part) - 1] = np.where(group[part[1:]] == group[part[:-1]], first, -1)
    return out


class _RangeMin:
    """Least value of any stretch, by a table of powers of two."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while (1 << len(self.rows)) <= len(x):
            half, p = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(p[:-half], p[half:]))
        self.level = np.zeros(len(x) + 2, dtype=np.int64)
        for i in range(2, len(self.level)):
            self.level[i] = self.level[i // 2] + 1

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Over [a, b), b > a."""
        out = np.empty(len(a), dtype=np.int64)
        k = self.level[b - a]
        for lv in np.unique(k):
            s = k == lv
            out[s] = np.minimum(self.rows[lv][a[s]], self.rows[lv][b[s] - (1 << lv)])
        return out


def subtree_repeats(h: np.ndarray, doc: np.ndarray, before: list[str], after: list[str], span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix how far a long enough repeat reaches before and behind its anchor (-1: none).

    Rows with equal ``h`` form one subtree; all subtrees of the call are worked level by level.
    """
    n = len(h)
    reach_l, reach_r = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    if n < 2:
        return reach_l, reach_r
    group = np.unique(h, return_inverse=True)[1]
    back = [t[::-1] for t in before]
    g = group.tolist()
    right = np.array(sorted(range(n), key=lambda i: (g[i], after[i])))
    left = np.array(sorted(range(n), key=lambda i: (g[i], back[i])))
    depth = _common(right, group, after, span)
    rank = np.empty(n, dtype=np.int64)
    rank[left] = np.arange(n)
    common_left = _RangeMin(_common(left, group, back, span))
    for d in np.unique(depth)[::-1]:
        if d <= 0:
            break
        # Nodes of this depth: stretches of neighbours at least this deep, one exactly so.
        joined = np.r_[False, depth >= d]
        node = np.cumsum(~joined)
        exact = np.unique(node[1:][depth == d])
        member = np.flatnonzero(np.isin(node, exact))
        who = right[member]
        by = np.lexsort((rank[who], node[member]))
        who, nd = who[by], node[member][by]
        # Next suffix of another record in the order of the text before the anchors.
        change = np.r_[True, (doc[who[1:]] != doc[who[:-1]]) | (nd[1:] != nd[:-1])]
        run = np.cumsum(change) - 1
        run_start = np.flatnonzero(change)
        run_end = np.r_[run_start[1:], len(who)]
        for other in (run_start[run] - 1, run_end[run]):
            ok = (other >= 0) & (other < len(who))
            ok[ok] &= nd[other[ok]] == nd[ok]
            i, j = who[ok], who[other[ok]]
            a, b = np.minimum(rank[i], rank[j]), np.maximum(rank[i], rank[j])
            lcp = common_left(a, b) if len(a) else np.zeros(0, dtype=np.int64)
            long = lcp + d >= span
            reach_l[i[long]] = np.maximum(reach_l[i[long]], lcp[long])
            reach_r[i[long]] = np.maximum(reach_r[i[long]], d)
    return reach_l, reach_r


_SPAN = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType())])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by ``h`` in tables of about ``_ROWS`` rows that never cut a group in two."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < _ROWS:
            continue
        # All prefixes but the last are complete.
        table = pa.Table.from_batches(held)
        h = table["h"].to_numpy()
        whole = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
        if whole:
            yield table.slice(0, whole)
        held, count = table.slice(whole).to_batches(), table.num_rows - whole
    if count:
        yield pa.Table.from_batches(held)


def _reaches(table: pa.Table, span: int) -> tuple[np.ndarray, np.ndarray]:
    return subtree_repeats(table["h"].to_numpy(), table["doc_id"].to_numpy(), table["before"].to_pylist(), table["after"].to_pylist(), span)


def _subtrees(ctx: DataFrame, span: int) -> DataFrame:
    """Stretches from all subtrees: each prefix in one task, a bounded number of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            lo, hi = _reaches(table, span)
            ok = hi >= 0
            doc, pos = (table[c].to_numpy()[ok] for c in ("doc_id", "pos"))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pos - lo[ok]), pa.array(pos + hi[ok])], names=["doc_id", "start_pos", "end_pos"])

    return ctx.repartition("h").sortWithinPartitions("h").mapInArrow(run, _SPAN)


_REACH = T.StructType([T.StructField("cid", T.LongType()), T.StructField("l", T.LongType()), T.StructField("r", T.LongType())])


def _class_trees(rows: DataFrame, span: int) -> DataFrame:
    """How far classes reach in subtrees of their band: ``cid, l, r``; rows without a class are partners only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            lo, hi = _reaches(table, span)
            cid = table["cid"].to_numpy()
            ok = (hi >= 0) & (cid >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(cid[ok]), pa.array(lo[ok]), pa.array(hi[ok])], names=["cid", "l", "r"])

    shaped = rows.select(F.col("k").alias("h"), "doc_id", F.coalesce("cid", F.lit(-1)).alias("cid"), F.col("b").alias("before"), F.col("a").alias("after"))
    return shaped.repartition("h").sortWithinPartitions("h").mapInArrow(run, _REACH)


def _split(ctx: DataFrame, span: int, seed: int, group: int) -> DataFrame:
    """Stretches of prefixes with too many suffixes for one subtree, by prefixes of variable length.

    1. Suffixes with the same text on both sides form one class. A class of several records is a
       repeat as far as its text goes, so copies never meet each other; it takes part in the rest
       as a partner only, by two of its records.
    2. A repeat that reaches d characters behind the anchor, d from s to t, has s characters behind
       and ``span`` - t before it in common. For each band of d those characters are the prefix; a
       class keeps t characters behind and ``span`` - s before the anchor in it, more it cannot need.
    3. A band's group is a subtree if it fits. If not, records that agree in all the band keeps are
       repeats throughout it, and two of them stay as partners for the rest. The rest goes on in
       the two halves of the band. A band of one d has nothing left to split: there the prefix is
       a whole window of the span length, and sharing it is the repeat.
    """
    same = ["h", "before", "after"]
    ctx = materialize(ctx, "popular_contexts")
    classes = ctx.groupBy(*same).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    several = F.col("lo") < F.col("hi")
    reaches = [classes.where(several).select("cid", F.length("before").cast("bigint").alias("l"), F.length("after").cast("bigint").alias("r"))]
    one = classes.select(F.when(~several, F.col("cid")).alias("cid"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("doc_id"), F.col("before").alias("b"), F.col("after").alias("a"))
    bands = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(min(s + BAND, span + 1) - 1).alias("t")) for s in range(seed, span + 1, BAND)])
    node = ["s", "t", "a", "b"]

    def cut(rows: DataFrame, into: Column) -> DataFrame:
        """Rows in narrower bands, as far as their text is long enough for them."""
        fits = F.filter(into, lambda x: (F.length("a") >= x["s"]) & (F.length("b") >= F.lit(span) - x["t"]))
        return rows.withColumn("x", F.explode(fits)).select("cid", "doc_id", "x.s", "x.t", F.expr("left(a, x.t)").alias("a"), F.expr(f"right(b, {span} - x.s)").alias("b")).distinct()

    rows = materialize(cut(one, bands), "bands")
    while True:
        keyed = rows.withColumn("k", F.xxhash64("s", "t", F.expr("left(a, s)"), F.expr(f"right(b, {span} - t)")))
        sized = keyed.groupBy("k").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"), F.count(F.lit(1)).alias("_n"), F.count("cid").alias("_open"))
        met = materialize(keyed.join(sized.where("_lo < _hi and _open > 0").select("k", "_n"), "k"), "banded")
        reaches.append(_class_trees(met.where(F.col("_n") <= group), span))
        hot = met.where((F.col("_n") > group))
        if not hot.limit(1).count():
            break
        shared = materialize(hot.groupBy(*node).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi"), "agreeing")
        asked = hot.where("cid is not null").select("cid", "doc_id", *node)
        reaches.append(asked.join(shared.select(*node), node, "left_semi").select("cid", F.length("b").cast("bigint").alias("l"), F.length("a").cast("bigint").alias("r")))
        partners = shared.select(F.lit(None).cast("bigint").alias("cid"), F.explode(F.array("lo", "hi")).alias("doc_id"), *node)
        rest = asked.join(shared.select(*node), node, "left_anti").unionByName(partners).where("s < t")
        half = F.floor((F.col("s") + F.col("t")) / 2).cast("int")
        rows = materialize(cut(rest, F.array(F.struct(F.col("s").alias("s"), half.alias("t")), F.struct((half + 1).alias("s"), F.col("t").alias("t")))), "bands")
    reach = reaches[0]
    for more in reaches[1:]:
        reach = reach.unionByName(more)
    reach = reach.groupBy("cid").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    members = ctx.join(classes.join(reach, "cid").select(*same, "l", "r"), same)
    return members.select("doc_id", (F.col("pos") - F.col("l")).alias("start_pos"), (F.col("pos") + F.col("r")).alias("end_pos"))


def merge_runs(spans: DataFrame) -> DataFrame:
    """Overlapping or touching stretches of a document joined into maximal runs."""
    w = Window.partitionBy("doc_id").orderBy("start_pos", "end_pos")
    reach = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(reach.isNull() | (F.col("start_pos") > reach), 1).otherwise(0)).over(w)
    return (
        spans.distinct().withColumn("_run", run).groupBy("doc_id", "_run")
        .agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("_run")
    )


def shared_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, seed: int = SEED, group: int = GROUP
) -> DataFrame:
    """Problem 8: ``doc_id, start_pos, end_pos`` of each maximal run of positions that lie in a
    stretch of at least ``span`` characters found in another document too.

    Characters are code points and compare exactly. Null, empty and shorter texts share nothing;
    rows of one id are one document (repeated rows count once); rows without an id are no
    documents. ``group`` is the largest subtree built in a task; larger ones are split by longer
    prefixes, with the same result.
    """
    if not 0 < seed < span:
        raise ValueError("the seed must be shorter than the span")
    ship(df.sparkSession)
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("v"), F.col(text_col).alias("text")).where(
        F.col(id_col).isNotNull() & (F.length(text_col) >= span)
    )
    found = materialize(anchors(docs, span, seed), "anchors")
    prefixes = found.groupBy("h").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"), F.count(F.lit(1)).alias("_n")).where("_lo < _hi")
    wanted = materialize(found.join(prefixes.select("h", "_n"), "h"), "shared_anchors")
    spans = _subtrees(contexts(docs, wanted.where(F.col("_n") <= group), span), span)
    hot = wanted.where(F.col("_n") > group)
    if hot.limit(1).count():
        spans = spans.unionByName(_split(contexts(docs, hot, span), span, seed, group))
    return merge_runs(spans)
