"""Operator 2, benchmark decontamination by a prefix-filtered set join.

A benchmark item's windows are sets of its word pairs (a pair and its place). A window is inside a document only if all its pairs are, so one pair, the rarest, is its
necessary prefix. Rarity is the pair's count over all documents, summed in a first pass. In the second pass documents look up their pairs among the
prefixes; a candidate has to fit into the document by its place and length (positional and length bound) and is then compared word by word over the
window. Documents never leave their partition and nothing is shuffled but the counts.

The benchmark is the small side by nature, and its size is checked nonetheless: it is broadcast in blocks of at most ``block_words`` words, and a larger benchmark means more
passes over the documents, with their hits so far written between.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, give_back_memory, only, portions, spread, written

#: Digits, a-z and all bytes of non-ASCII characters belong to words, A-Z becomes lower case, the rest are blanks.
_WORDS = bytes(c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in LOWER)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


@dataclass(frozen=True)
class Block:
    """Windows of some items. ``words``: word to number from 1. ``windows``: numbers, 0 after a short window's end."""

    words: dict[bytes, int]
    windows: np.ndarray
    sizes: np.ndarray
    items: list[list[str]]  # of each window
    pairs: np.ndarray  # sorted keys of all pairs in windows
    prefix: np.ndarray | None = None  # sorted keys; a single word's window has the word's own key
    first: np.ndarray | None = None  # for each prefix, its run in entries
    entry_window: np.ndarray | None = None
    entry_offset: np.ndarray | None = None

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.get, words, repeat(0)), np.int64, len(words))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Key of the pair that starts at each word but the last, 0 where either word is in no item."""
        k = x[:-1] * (len(self.words) + 1) + x[1:]
        k[(x[:-1] == 0) | (x[1:] == 0)] = 0
        return k


def block_of(items: list[tuple[str, list[bytes]]], size: int) -> Block:
    """Windows of ``size`` consecutive words of each item; an item of fewer words, but not none, is one window."""
    words: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for item, text in items:
        x = [words.setdefault(w, len(words) + 1) for w in text]
        for at in range(max(1, len(x) - size + 1) if x else 0):
            found[tuple(x[at : at + size])].add(item)
    windows = np.zeros((len(found), size), np.int64)
    for row, w in zip(windows, found, strict=True):
        row[: len(w)] = w
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    block = Block(words, windows, sizes, [sorted(v) for v in found.values()], np.empty(0, np.int64))
    keys = [block.keys(w[:n]) for w, n in zip(windows, sizes, strict=True)]
    return Block(words, windows, sizes, block.items, np.unique(np.concatenate([*keys, np.empty(0, np.int64)])))


def with_prefixes(block: Block, counts: dict[int, int]) -> Block:
    """Each window's rarest pair, ties to the smaller key, and where in the window it stands."""
    entries = []
    for i, (w, n) in enumerate(zip(block.windows, block.sizes, strict=True)):
        if n == 1:
            entries.append((-int(w[0]), i, 0))  # negative: a word, not a pair
        else:
            key, at = min(((counts.get(k, 0), k), p) for p, k in enumerate(block.keys(w[:n]).tolist()))
            entries.append((key[1], i, at))
    entries.sort()
    keys = np.array([e[0] for e in entries], np.int64)
    prefix, first = np.unique(keys, return_index=True)
    column = lambda k: np.array([e[k] for e in entries], np.int64)
    return Block(block.words, block.windows, block.sizes, block.items, block.pairs, prefix, np.append(first, len(keys)), column(1), column(2))


def _among(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``keys`` of members of the sorted ``table``, and their rows there."""
    some = np.flatnonzero(keys)
    if not len(table) or not len(some):
        return some[:0], some[:0]
    row = np.minimum(np.searchsorted(table, keys[some]), len(table) - 1)
    hit = table[row] == keys[some]
    return some[hit], row[hit]


def occurrences(block: Block, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Starts in a document of windows that occur there, and which windows."""
    x = block.numbers(words)
    at, row = _among(block.keys(x), block.prefix)
    if len(block.prefix) and block.prefix[0] < 0:
        one, own = _among(-x, block.prefix)
        at, row = np.concatenate([at, one]), np.concatenate([row, own])
    if not len(at):
        return at, row
    many = block.first[row + 1] - block.first[row]
    entry = np.repeat(block.first[row] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    start, window = np.repeat(at, many) - block.entry_offset[entry], block.entry_window[entry]
    fits = (start >= 0) & (start + block.sizes[window] <= len(x))
    start, window = start[fits], window[fits]
    good = np.ones(len(start), bool)
    for k in range(block.windows.shape[1]):
        inside = np.flatnonzero(good & (block.sizes[window] > k))
        good[inside] = x[start[inside] + k] == block.windows[window[inside], k]
    return start[good], window[good]


def _counts(docs: DataFrame, block: Block) -> dict[int, int]:
    """How often each pair of the block occurs in all documents; as many rows as the block has pairs come to the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        total = np.zeros(len(b.pairs), np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                np.add.at(total, _among(b.keys(b.numbers(words_of(text.as_py()))), b.pairs)[1], 1)
        give_back_memory()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(b.pairs[used]), pa.array(total[used])], names=["pair", "n"])

    rows = docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    shared.unpersist()
    return {r["pair"]: r["n"] for r in rows}


def _blocks(benchmark: DataFrame, size: int, block_words: int) -> Iterator[Block]:
    held: list[tuple[str, list[bytes]]] = []
    total = 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").where("item_id is not null and text is not null").toLocalIterator():
        words = words_of(text.encode("utf-8", "surrogatepass"))
        if held and total + len(words) > block_words:
            yield block_of(held, size)
            held, total = [], 0
        held.append((item, words))
        total += len(words)
    yield block_of(held, size)


def overlap(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, numerator: int = 20, block_words: int = 200_000) -> DataFrame:
    """Each row of ``docs`` as struct ``row``, with n_words, n_hit, items (sorted ids of items with a window in it) and contaminated (n_hit > 0 and ``numerator`` * n_hit >= n_words).

    Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters of whole texts; a word inside any occurrence of a window is hit once. Null and empty texts have no
    words and are never contaminated; items without id, text or words have no window; rows of one item id are one item. Repeated rows get equal results; columns of any
    name stay inside ``row``; empty tables on either side give no rows, or no hits.
    """
    bench = only(benchmark, item_id=item_col, text=item_text_col)
    d = spread(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))).withColumns({"spans": F.lit(b""), "items": F.array().cast("array<string>"), "n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long")})

    place = docs.columns.index(text_col)

    def scan(shared):
        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = shared.value
            for batch in portions(batches):
                spans, items, n_words, n_hit = [], [], [], []
                for text, old, had in zip(batch.column(0).field(place).cast(pa.binary()), batch.column(1), batch.column(2), strict=True):
                    words = words_of(text.as_py())
                    start, which = occurrences(b, words)
                    seen = np.frombuffer(old.as_py(), "<i8").reshape(-1, 2)
                    if len(start):
                        seen = np.unique(np.concatenate([seen, np.stack([start, start + b.sizes[which]], 1)]), axis=0)
                        items.append(sorted({i for w in np.unique(which).tolist() for i in b.items[w]} | set(had.as_py())))
                    else:
                        items.append(had.as_py())
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, seen[:, 0], 1)
                    np.add.at(step, seen[:, 1], -1)
                    spans.append(seen.astype("<i8").tobytes())
                    n_words.append(len(words))
                    n_hit.append(int((np.cumsum(step[:-1]) > 0).sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64())], names=["row", "spans", "items", "n_words", "n_hit"])
            give_back_memory()

        return hits

    waiting = None
    for block in _blocks(bench, window, block_words):
        if waiting is not None:
            d = written(waiting, "hits")
        block = with_prefixes(block, _counts(d.select(F.col("row").getField(text_col).alias("text")), block))
        waiting = d.mapInArrow(scan(docs.sparkSession.sparkContext.broadcast(block)), d.schema)
    return waiting.select("row", "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (numerator * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
