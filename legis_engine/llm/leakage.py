"""Evaluation texts leaking into training text.

The test items are indexed once: an inverted index with BM25 weights, its items in blocks with
the largest weight of each term per block (block-max). Its terms are pairs of neighbouring words:
in legal wording single words are so common that most passages would reach most items (a
one-word item has its word as its term). Every training text is cut into passages
of words that overlap so far that each run of ``RUN`` words lies whole in one of them. A passage
is a query: blocks whose upper bound stays below the least threshold of their items are skipped
without looking at the items (WAND), the others are scored item by item.

The threshold of an item is the least BM25 weight that ``RUN`` of its consecutive words can have
together, so a passage holding such a run always reaches it and the retrieval loses nothing. All
retrieved pairs are then verified on the words themselves.

Words are maximal runs of letters or digits after composing accents, compared by case folding.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

RUN = 12
PASSAGE = 64
BLOCK = 16
K1, B = 1.2, 0.75
#: Items and characters of one index. More items than that are searched index by index.
MAX_ITEMS, MAX_CHARS = 20_000, 4_000_000
#: Indexes that one scan of the corpus asks, so that no worker holds more.
PER_PASS = 2

_WORD = regex.compile(r"[\p{L}\p{N}]+")


# ASCII text: letters to lower case, all but letters and digits to blanks.
_FOLD = bytes(ord(c.lower()) if (c := chr(i)).isascii() and c.isalnum() else 32 for i in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text, folded, as UTF-8."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_FOLD).split()
    return [w.casefold().encode() for w in _WORD.findall(unicodedata.normalize("NFC", text))]


class ItemIndex:
    """BM25 inverted index of test items with block maxima; bounded by MAX_ITEMS and MAX_CHARS."""

    def __init__(self, items: list[tuple[int, str | None]], run: int = RUN, block: int = BLOCK):
        self.run = run
        rows = sorted({(i, tuple(w)) for i, t in items if i is not None and (w := words(t))})
        self.ids = np.array([i for i, _ in rows], dtype=np.int64)
        self.vocab: dict[bytes, int] = {}
        self.items = [np.array([self.vocab.setdefault(w, len(self.vocab)) for w in ws], dtype=np.int64) for _, ws in rows]
        n = len(rows)
        self.blocks = max(1, math.ceil(n / block))
        self.block = block
        # Terms of an item in order, as codes; then the sorted codes number the terms.
        coded = [self.pairs(x) if len(x) > 1 else x for x in self.items]
        self.codes = np.unique(np.concatenate(coded)) if n else np.zeros(0, dtype=np.int64)
        coded = [np.searchsorted(self.codes, x) for x in coded]
        v = len(self.codes)
        self.single = np.array(sorted({int(x[0]) for x in self.items if len(x) == 1}), dtype=np.int64)
        df = np.zeros(v, dtype=np.int64)
        for x in coded:
            df[np.unique(x)] += 1
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        mean = sum(map(len, coded)) / max(n, 1)
        # Postings by item, then turned round: term -> (item, weight).
        term, item, weight = [], [], []
        self.threshold = np.zeros(n)
        for k, x in enumerate(coded):
            t, tf = np.unique(x, return_counts=True)
            w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x) / mean))
            term.append(t), item.append(np.full(len(t), k)), weight.append(w)
            by = dict(zip(t.tolist(), w.tolist(), strict=True))
            m = max(min(run, len(self.items[k])) - 1, 1)
            # A run of the item's words holds each of its distinct terms at least once.
            self.threshold[k] = min(sum(by[y] for y in set(x[i : i + m].tolist())) for i in range(len(x) - m + 1)) - 1e-9
        cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, dtype=t)
        term, item, weight = cat(term, np.int64), cat(item, np.int64), cat(weight, float)
        order = np.lexsort((item, term))
        self.post_item, self.post_weight = item[order], weight[order]
        self.post_start = np.searchsorted(term[order], np.arange(v + 1))
        # Block maxima per term in the same inverted form: term -> (block, largest weight in it).
        bt, bb = term[order], item[order] // block
        new = np.flatnonzero(np.r_[True, (np.diff(bt) != 0) | (np.diff(bb) != 0)]) if len(bt) else np.zeros(0, dtype=np.int64)
        self.max_block, self.max_weight = bb[new], np.maximum.reduceat(weight[order], new) if len(new) else np.zeros(0)
        self.max_start = np.searchsorted(bt[new], np.arange(v + 1))
        pad = np.full(self.blocks * block, np.inf)
        pad[:n] = self.threshold
        self.block_threshold = pad.reshape(self.blocks, block).min(axis=1)
        # The least and the largest of all: the first bound, before any block is looked at.
        self.term_max = np.maximum.reduceat(self.post_weight, self.post_start[:-1]) if v else np.zeros(0)
        self.least = float(self.threshold.min()) if n else math.inf
        # Every run of every item, to verify by the words themselves.
        self.grams: dict[bytes, list[int]] = {}
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for k, x in enumerate(self.items):
            m = min(run, len(x))
            into = self.grams if m == run else self.short.setdefault(m, {})
            for i in range(len(x) - m + 1):
                into.setdefault(x[i : i + m].tobytes(), []).append(k)

    def pairs(self, ids: np.ndarray) -> np.ndarray:
        """Codes of neighbouring words; negative where one is unknown. Above those of single words."""
        code = (ids[:-1] + 1) * (1 << 31) + ids[1:]
        return np.where((ids[:-1] < 0) | (ids[1:] < 0), -1, code)

    def terms_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and numbers of the index terms in the words ``ids``."""
        code = self.pairs(ids)
        at = np.flatnonzero(code >= 0)
        code = code[at]
        if len(self.single):
            one = np.flatnonzero(np.isin(ids, self.single))
            at, code = np.concatenate([at, one]), np.concatenate([code, ids[one]])
        k = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        ok = self.codes[k] == code if len(self.codes) else np.zeros(len(code), dtype=bool)
        return at[ok], k[ok]

    def _expand(self, start: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the terms' postings and which query term each is of."""
        n = start[terms + 1] - start[terms]
        owner = np.repeat(np.arange(len(terms)), n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + start[terms][owner]
        return at, owner

    def retrieve(self, passage: np.ndarray, term: np.ndarray, n_passages: int) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) pairs at or above the item's threshold.

        ``passage, term``: the distinct known terms of each passage.
        """
        # Upper bound per passage over all items.
        reach = np.bincount(passage, self.term_max[term], n_passages) >= self.least
        if not reach.any():
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        some = np.flatnonzero(reach)
        if len(some) < n_passages:
            name = np.full(n_passages, -1)
            name[some] = np.arange(len(some))
            keep = reach[passage]
            p, k = self.retrieve(name[passage[keep]], term[keep], len(some))
            return some[p], k
        # Upper bounds per passage and block.
        at, owner = self._expand(self.max_start, term)
        bound = np.bincount(passage[owner] * self.blocks + self.max_block[at], self.max_weight[at], n_passages * self.blocks)
        alive = bound.reshape(n_passages, self.blocks) >= self.block_threshold[None, :]
        hit = alive.any(axis=1)
        if not hit.any():
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        # Exact scores, of the surviving blocks only.
        few = np.flatnonzero(hit)
        name = np.full(n_passages, -1)
        name[few] = np.arange(len(few))
        keep = hit[passage]
        p, t = name[passage[keep]], term[keep]
        at, owner = self._expand(self.post_start, t)
        item, p = self.post_item[at], p[owner]
        live = alive[few][p, item // self.block]
        n = len(self.items)
        key = p[live].astype(np.int64) * n + item[live]
        if len(few) * n <= 4_000_000:
            dense = np.bincount(key, self.post_weight[at][live], len(few) * n)
            pairs = np.flatnonzero(dense)
            score = dense[pairs]
        else:
            pairs, inverse = np.unique(key, return_inverse=True)
            score = np.bincount(inverse, self.post_weight[at][live], len(pairs))
        ok = score >= self.threshold[pairs % n]
        return few[pairs[ok] // n], pairs[ok] % n

    def verify(self, ids: np.ndarray, found: set[int]) -> set[int]:
        """Which of the found items really have a run (all words if fewer) in the words ``ids``."""
        out: set[int] = set()
        raw, w = ids.tobytes(), ids.itemsize
        unknown = np.cumsum(np.r_[0, ids < 0])
        for m, table in [(self.run, self.grams), *self.short.items()]:
            if len(ids) < m:
                continue
            for i in np.flatnonzero(unknown[m:] == unknown[:-m]).tolist():
                for k in table.get(raw[i * w : (i + m) * w], ()):
                    if k in found:
                        out.add(k)
        return out


def search_batch(index: ItemIndex, docs: list[tuple[int, str | None]], length: int = PASSAGE) -> list[tuple[int, int]]:
    """(doc_id, item_id) of every item a document contains.

    Passage j of a document is its words from j * step on, ``length`` of them; with
    step = length - run + 1 each run lies whole in one.
    """
    get = index.vocab.get
    step = length - index.run + 1
    coded = [[get(w, -1) for w in words(t)] for _, t in docs]
    sizes = np.array([len(x) + 1 for x in coded])
    # All documents in one array, an unknown word between them.
    ids = np.full(int(sizes.sum()), -1, dtype=np.int64)
    start = np.cumsum(sizes) - sizes
    for x, a in zip(coded, start.tolist(), strict=True):
        ids[a : a + len(x)] = x
    at, term = index.terms_of(ids)
    if not len(at):
        return []
    doc = np.searchsorted(start, at, "right") - 1
    pos = at - start[doc]
    # A term belongs to the passage it starts in and, near its start, to the one before as well.
    j = pos // step
    early = (j > 0) & (pos + 2 <= (j - 1) * step + length)
    doc, j, term = np.concatenate([doc, doc[early]]), np.concatenate([j, j[early] - 1]), np.concatenate([term, term[early]])
    wide = int(sizes.max()) // step + 2
    # Both come in document order, so passages are numbered without sorting all terms.
    order = np.argsort(doc * wide + j, kind="stable")
    name, term = (doc * wide + j)[order], term[order]
    fresh = np.r_[True, name[1:] != name[:-1]]
    passage, p = name[fresh], np.cumsum(fresh) - 1
    # A passage whose terms, repeats included, stay below the first bound is not looked at again.
    reach = np.bincount(p, index.term_max[term], len(passage)) >= index.least
    key = np.unique((p * len(index.codes) + term)[reach[p]])
    hit, item = index.retrieve(key // len(index.codes), key % len(index.codes), len(passage))
    found: dict[int, set[int]] = {}
    for h, k in zip(hit.tolist(), item.tolist(), strict=True):
        found.setdefault(h, set()).add(k)
    out: set[tuple[int, int]] = set()
    for h, ks in found.items():
        d, j0 = divmod(int(passage[h]), wide)
        a = int(start[d]) + j0 * step
        got = index.verify(ids[a : min(a + length, int(start[d] + sizes[d]) - 1)], ks)
        out |= {(docs[d][0], int(index.ids[k])) for k in got}
    return sorted(out, key=lambda x: (x[0] is None, x))


def _shards(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str | None]]]:
    """The items one shard at a time, each of a size that fits one index; never more than one shard
    is held here. The held-out set is what is asked, not the corpus."""
    shard: list[tuple[int, str | None]] = []
    chars = 0
    for r in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).distinct().toLocalIterator():
        if shard and (len(shard) >= MAX_ITEMS or chars + len(r[1]) > MAX_CHARS):
            yield shard
            shard, chars = [], 0
        shard.append((r[0], r[1]))
        chars += len(r[1])
    yield shard


_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType())])


def _searcher(sent: list, passage: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [b.value for b in sent]
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for i in range(0, len(rows), 1000):
                got = [x for index in indexes for x in search_batch(index, rows[i : i + 1000], passage)]
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d for d, _ in got], pa.int64()), pa.array([k for _, k in got], pa.int64())], names=["doc_id", "item_id"]
                    )

    return search


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
    item_text: str = "text", run: int = RUN, passage: int = PASSAGE,
) -> DataFrame:
    """Problem 7: ``doc_id, item_id`` for each document that holds ``run`` consecutive words of an
    item (all its words if it has fewer).

    Null and blank texts and items without words give nothing; repeated rows count once. The
    index of a shard of items (bounded by MAX_ITEMS and MAX_CHARS) is built once and goes to the
    workers; one scan of the corpus asks up to PER_PASS shards, a larger set takes further scans.
    Documents are not shuffled.
    """
    if passage < 2 * run:
        raise ValueError("a passage must hold at least two runs")
    spark = docs.sparkSession
    ship(spark)
    # Built once per shard; workers unpack a ready index, and keep it while they live.
    sent = [spark.sparkContext.broadcast(ItemIndex(shard, run)) for shard in _shards(items, item_id, item_text)]
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(doc_text).alias("text")).where(F.col("text").isNotNull())
    out = None
    for i in range(0, len(sent), PER_PASS):
        part = texts.mapInArrow(_searcher(sent[i : i + PER_PASS], passage), _SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out.distinct()
