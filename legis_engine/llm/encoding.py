"""Encoding of a corpus with a public byte-level BPE vocabulary.

A text is encoded as a tree: halves are encoded recursively down to leaves, and two neighbours
are joined by encoding again a window around their boundary. The window grows on either side to
the nearest stable cut, and everything outside it provably keeps its tokens:

The vocabulary's pattern splits a text into pieces that are encoded one by one. Each piece is an
optional blank with a run of letters, digits or other signs, or a contraction, or white space
only. A blank or line feed after a character that is not white space therefore always begins a
piece, whatever stands before or after: no piece has white space after another character. The
text before such a cut ends with a character that is not white space, so no piece before it looks
beyond it. An ASCII digit next to an ASCII letter is such a cut as well, as no piece has both.

So encode(a + b) = encode(a up to its last cut) + encode(window) + encode(b from its first cut),
and the join is associative. Where a half has no cut the window takes the whole half.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship

LEAF_CHARS = 4096

_CUT = re.compile(r"(?<=[^\s])[ \n](?=[^\s]|$)|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_ENCODERS: dict[str, tuple[Callable[[str], list[int]], list[int]]] = {}


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Default place of the installed vocabulary; a parameter of every operator here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_encoder(path: str) -> tuple[Callable[[str], list[int]], list[int]]:
    """Plain encoder of a vocabulary file and the byte length of each token."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        lengths = [0] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            lengths[v] = len(k)
        _ENCODERS[path] = (own.encode_ordinary, lengths)
    return _ENCODERS[path]


def _last_cut(s: str, lo: int, hi: int, step: int = 64) -> int:
    """Start of the last stable piece of s[lo:hi], lo if there is none; looks at growing windows."""
    while True:
        start = max(lo, hi - step)
        found = [m.start() for m in _CUT.finditer(s, start + (start > lo), hi)]
        # A cut at the very end has no right context in the left half: it must lie inside.
        found = [x for x in found if lo < x < hi]
        if found:
            return found[-1]
        if start == lo:
            return lo
        step *= 4


def _first_cut(s: str, lo: int, hi: int, step: int = 64) -> int:
    """First stable piece start inside s[lo:hi], hi if there is none."""
    while True:
        end = min(hi, lo + step)
        for m in _CUT.finditer(s, lo + 1, end):
            if lo < m.start() < hi:
                return m.start()
        if end == hi:
            return hi
        step *= 4


def encode_tree(s: str, encode: Callable[[str], list[int]], lengths: list[int], leaf: int = LEAF_CHARS) -> list[int]:
    """Token ids of ``s`` by tree reduction; equal to ``encode(s)``."""

    def trim(ids: list[int], n_bytes: int, from_end: bool) -> int:
        """How many tokens make up ``n_bytes`` at one end."""
        k = 0
        while n_bytes > 0:
            k += 1
            n_bytes -= lengths[ids[-k] if from_end else ids[k - 1]]
        return k

    def node(lo: int, hi: int) -> list[int]:
        if hi - lo <= leaf:
            return encode(s[lo:hi])
        mid = (lo + hi) // 2
        left, right = node(lo, mid), node(mid, hi)
        a, b = _last_cut(s, lo, mid), _first_cut(s, mid, hi)
        if a == lo and b == hi:
            return encode(s[lo:hi])
        drop = trim(left, len(s[a:mid].encode()), True)
        skip = trim(right, len(s[mid:b].encode()), False)
        left[len(left) - drop :] = encode(s[a:b])
        left.extend(right[skip:])
        return left

    return node(0, len(s)) if s else []


_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None, leaf: int = LEAF_CHARS) -> DataFrame:
    """``doc_id, ids``: the token ids of each row's text, without special tokens.

    Null and empty texts give an empty list; strings that look like special tokens are plain
    text. Each row is encoded by itself, so rows, repeated or not, come out one to one and no row
    is moved. ``vocabulary`` is a rank file readable on every worker.
    """
    path = vocabulary or vocabulary_path()
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = load_encoder(path)
        for batch in batches:
            ids, ends = [], [0]
            total = 0
            flat: list[np.ndarray] = []
            for text in batch.column(1).to_pylist():
                got = encode_tree(text, encode, lengths, leaf) if text else ids
                if got:
                    flat.append(np.array(got, dtype=np.int32))
                    total += len(got)
                ends.append(total)
            values = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lists], names=["doc_id", "ids"])

    return df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, _SCHEMA)


def decode_ids(ids: list[int], vocabulary: str | None = None) -> str:
    """The text of a list of ids: concatenation of the tokens' bytes."""
    with open(vocabulary or vocabulary_path(), "rb") as f:
        by_id = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return b"".join(by_id[i] for i in ids).decode("utf-8", errors="replace")
