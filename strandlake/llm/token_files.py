"""Operator 7, token files compressed by Re-Pair grammars.

Documents go into ascending order by a range shuffle, each task cuts its run into shards of bounded size, and within a shard the most
frequent id pairs are replaced by nonterminals again and again, never across a document's end. A shard's row in the Parquet files holds

    part, shard, n_docs, n_tokens   its place and size
    doc_ids                         little-endian signed 64-bit, ascending; doc_nulls: one byte each
    doc_tokens, doc_at              little-endian unsigned 32-bit: expanded length of each document, and its first symbol (with one more at the end)
    rules                           little-endian unsigned 32-bit pairs; nonterminal ``base + i`` expands to pair ``i``, made of ids and earlier nonterminals
    rule_tokens                     little-endian unsigned 32-bit expansion length of each rule
    base, symbols                   first nonterminal; little-endian unsigned symbols of ``width`` bytes

``expand`` decodes any span of ids of any document from that: expansion lengths tell which symbols to skip.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only
from .tokens import encoder

SHARD = "part int, shard int, n_docs int, n_tokens long, doc_ids binary, doc_nulls binary, doc_tokens binary, doc_at binary, rules binary, rule_tokens binary, base long, width int, symbols binary"


def _pairs_of(x: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Key of each adjacent pair; 0 where a document ends between the two."""
    keys = (x[:-1].astype(np.uint64) << np.uint64(32)) | x[1:]
    keys[last[:-1]] = 0
    return keys


def re_pair(x: np.ndarray, starts: np.ndarray, rounds: int = 6, at_once: int = 8192, least: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Rules, their expansion lengths, symbols, where each document starts in them, and the first nonterminal.

    ``starts``: first position of each document, none of them empty. Each round counts all pairs and replaces the ``at_once`` most frequent that occur ``least`` times.
    Where replaced pairs overlap, the leftmost goes first, and a pair of the same ids in a row is taken left to right.
    """
    base = int(x.max()) + 1 if len(x) else 1
    rules, sizes = [np.zeros((0, 2), np.uint32)], [np.zeros(0, np.uint32)]
    last = np.zeros(len(x), bool)
    last[starts[1:] - 1] = True
    last[-1:] = True
    fresh, x = base, x.astype(np.uint32)
    for _ in range(rounds):
        if len(x) < 2:
            break
        keys = _pairs_of(x, last)
        # only pairs that can be frequent, by counts of their hashes, are sorted and replaced
        slot = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        near = np.flatnonzero((np.bincount(slot, minlength=1 << 20) >= least)[slot])
        if not len(near):
            break
        keys, slot = keys[near], slot[near] >> 2
        ordered = np.sort(keys)
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        found, counts = ordered[edge[:-1]], np.diff(edge)
        often = np.flatnonzero((counts >= least) & (found != 0))
        if not len(often):
            break
        often = often[np.lexsort((found[often], -counts[often]))][:at_once]
        # a table by hash; of keys that meet in it the more frequent stays, the other waits for the next round
        often = found[often]
        table = np.full(1 << 18, -1, np.int32)
        table[((often * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)[::-1]] = np.arange(len(often))[::-1]
        here = table[slot]
        hit = np.flatnonzero(here >= 0)
        hit = hit[often[here[hit]] == keys[hit]]
        place, here = near[hit], here[hit]
        # in a run of overlapping hits take the first, third, ...
        new_run = np.concatenate([[True], np.diff(place) > 1])
        nth = np.arange(len(place)) - np.maximum.accumulate(np.where(new_run, np.arange(len(place)), 0))
        first = np.flatnonzero(nth % 2 == 0)
        place, here = place[first], here[first]
        taken = np.zeros(len(often), bool)
        taken[here] = True
        used, number = np.flatnonzero(taken), (np.cumsum(taken) - 1)[here]
        pair = often[used]
        rules.append(np.stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        all_sizes = np.concatenate(sizes)
        size_of = lambda s, k=all_sizes: np.where(s < base, 1, k[np.maximum(s.astype(np.int64) - base, 0)] if len(k) else 1)
        sizes.append((size_of(rules[-1][:, 0]) + size_of(rules[-1][:, 1])).astype(np.uint32))
        x[place] = (fresh + number).astype(np.uint32)
        last[place] = last[place + 1]
        keep = np.ones(len(x), bool)
        keep[place + 1] = False
        starts = np.cumsum(keep)[starts] - 1
        x, last = x[keep], last[keep]
        fresh += len(used)
    return np.concatenate(rules), np.concatenate(sizes), x, starts, base


def _expanded(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """All ids of a run of symbols, by doubling: each pass replaces every nonterminal by its pair."""
    while (big := symbols >= base).any():
        sizes = 1 + big.astype(np.int64)
        at = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.uint32)
        out[at[~big]] = symbols[~big]
        pair = rules[symbols[big].astype(np.int64) - base]
        out[at[big]], out[at[big] + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    return symbols


def _all_ids(symbols: np.ndarray, rules: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray:
    """All ids of many symbols: each rule is expanded once, then copied wherever it stands."""
    flat = np.concatenate([_expanded(np.arange(base, base + len(rules), dtype=np.uint32), rules, base), symbols])
    ends = np.cumsum(sizes.astype(np.int64))
    big = np.flatnonzero(symbols >= base)
    rule = symbols[big].astype(np.int64) - base
    n, start = np.ones(len(symbols), np.int64), np.arange(len(flat) - len(symbols), len(flat))
    n[big], start[big] = sizes[rule], ends[rule] - sizes[rule]
    return flat[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def expand(shard: dict, doc: int, start: int = 0, length: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``start + length`` of the ``doc``-th document of a shard's row; only the symbols that cover them are expanded."""
    u4 = lambda name: np.frombuffer(shard[name], "<u4")
    base, at, total = shard["base"], u4("doc_at"), int(u4("doc_tokens")[doc])
    stop = total if length is None else min(total, start + length)
    symbols = np.frombuffer(shard["symbols"], f"<u{shard['width']}")[at[doc] : at[doc + 1]].astype(np.uint32)
    sizes = u4("rule_tokens")
    ends = np.cumsum(np.where(symbols < base, 1, sizes[np.maximum(symbols.astype(np.int64) - base, 0)] if len(sizes) else 1))
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, max(stop, start), "left") + 1
    before = int(ends[a - 1]) if a else 0
    return _expanded(symbols[a:b], u4("rules").reshape(-1, 2), base)[start - before : max(stop, start) - before]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, shard_tokens: int = 1_000_000, partitions: int | None = None) -> None:
    """Writes all documents in ascending order of id as shards under ``path``.

    Null ids come first, documents of one id in order of their texts. A null text is empty and holds the end id alone. A text of any length stays in one shard, whose
    size it may exceed. An empty table gives files without rows. Rows of one id are dealt by their texts' hashes too, so no id is too frequent for a task.
    """
    import os

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        names = [f.split()[0] for f in SHARD.split(", ")]
        kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in SHARD.split(", ")]
        keys: list = []
        held: list[np.ndarray] = []
        total = shard = 0

        def shut() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            rules, rule_sizes, symbols, at, base = re_pair(np.concatenate(held), np.cumsum(sizes) - sizes)
            width = 2 if base + len(rules) <= 1 << 16 else 4
            row = [part, shard, len(keys), total, np.array([k or 0 for k in keys], "<i8").tobytes(), bytes(k is None for k in keys), sizes.astype("<u4").tobytes(), np.append(at, len(symbols)).astype("<u4").tobytes(), rules.astype("<u4").tobytes(), rule_sizes.astype("<u4").tobytes(), base, width, symbols.astype(f"<u{width}").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), codes.encode(batch.column(1)), strict=True):
                keys.append(key)
                held.append(np.append(ids, np.uint32(end_id)))
                total += len(held[-1])
                if total >= shard_tokens:
                    yield shut()
                    keys, held, total, shard = [], [], 0, shard + 1
        if keys:
            yield shut()

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    d = only(docs, doc_id=id_col, text=text_col)
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = d.repartitionByRange(partitions, *keys) if partitions else d.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys, "text").mapInArrow(shards, SHARD).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, decoded from the files.

    Sums of tokens go up in two steps, over the shards of a part and over parts, so no task sees more rows than a part has shards or the job had tasks.
    """
    rows = spark.read.schema(SHARD).parquet(path)
    sizes = rows.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    above = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    starts = sizes.select("part", "shard", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inside")).join(above, "part").select("part", "shard", (F.col("inside") + F.col("above")).alias("first"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, nulls = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_nulls"], bool)
                sizes, at = np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64), np.frombuffer(row["doc_at"], "<u4")
                symbols = np.frombuffer(row["symbols"], f"<u{row['width']}").astype(np.uint32)
                ids = _all_ids(symbols[at[0] : at[-1]], np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["rule_tokens"], "<u4"), row["base"]).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                sums = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys.copy(), pa.int64(), mask=nulls.copy()), pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["shard"], np.int32)), pa.array(ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())], names=["doc_id", "part", "shard", "own", "n_tokens", "ids_crc32"])

    read = rows.mapInArrow(documents, "doc_id long, part int, shard int, own long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")
