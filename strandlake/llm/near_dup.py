"""Operator 6, near-duplicates by MinHash with tensored banding.

A document's set holds its distinct shingles of words as 64-bit hashes. ``collections`` small keys, each over ``depth`` minima, are computed for a set; each pair of small keys
makes one table key, so ``collections * (collections - 1) / 2`` keys over 2 * ``depth`` minima come from ``collections * depth`` minima: about the square
root. Two sets of similarity s miss each other only if fewer than two small keys agree; at s = 0.8 and the defaults (16 of 3) that is 2 in 10,000.

Documents with equal sets are one class and go on as their smallest id, so copies never meet in a table. A small key that one class alone holds is in no shared pair: small keys
are counted first, and pairs are formed of those that two classes hold at least, which leaves next to nothing of unique documents. In a bucket no pairs are listed. Each member is
compared with a pivot, the smallest id among the members of about its size, and these pivots with each other: first each with the pivot it shares most buckets with, then with the
others where both still lie in different components. What is left are buckets whose members still lie in different components: only pairs across
those are listed, at most once, and only if sizes allow the similarity. Every candidate is verified on full sets, made again from whole texts; only texts with a candidate are moved.

Pairs across components come from blocks: a bucket's members are packed, about ``BLOCK`` at a time, with a bitmap of their hashed shingles each; blocks meet blocks of their bucket, but not
two of the bucket's largest component, and only pairs whose bitmaps allow the similarity leave them. Common bits plus the smaller number of shingles that share a bit bound the
intersection from above, so none is lost. Tables are written to the shared folder between stages and deleted when their last reader has written.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, collect_garbage, give_back_memory, mix64, only, sent_if_small, spread

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Members in a block, and 64-bit words of a bitmap.
BLOCK, WORDS = 512, 32


class _Hashes(dict):
    """Words to 64-bit hashes; forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Hashes()


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``k`` words (ASCII white space between, A-Z lower-cased); of fewer words the whole sequence is one, of none there is none."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(k, len(w))
    h = mix64(w[: len(w) - k + 1] + np.uint64(k))
    for j in range(1, k):
        h = mix64(h * _ODD + w[j : len(w) - k + 1 + j])
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def small_keys(s: np.ndarray, collections: int, depth: int) -> np.ndarray:
    """One hash over ``depth`` minima for each collection."""
    rng = np.random.default_rng(20)
    n = collections * depth
    a = rng.integers(1 << 62, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(1 << 63, size=n, dtype=np.uint64)
    low = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(s), 4096):  # bounded memory for long texts
        part = s[at : at + 4096]
        x = part[None, :] * a[:, None] + b[:, None]
        x ^= x >> np.uint64(29)
        x *= _ODD
        np.minimum(low, x.min(1), out=low)
    out = np.zeros(collections, np.uint64)
    for d in range(depth):
        out = mix64(out * _ODD + low[d::depth])
    return out


def bitmap(s: np.ndarray) -> np.ndarray:
    """A set's hashes as bits."""
    bits = np.zeros(WORDS * 64, bool)
    bits[(mix64(s) % np.uint64(WORDS * 64)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    z = np.concatenate([x, y])
    z.sort()
    both = int((z[1:] == z[:-1]).sum())
    return 100 * both >= percent * (len(z) - both)


def _marks(docs: DataFrame, k: int, collections: int, depth: int) -> DataFrame:
    """doc_id, n_shingles, a and b (a fingerprint of the set) and the small keys k0, k1, ...; all but the first two are null if the set is empty."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            made = np.zeros((2 + collections, batch.num_rows), np.uint64)
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                s = shingle_set(text.as_py(), k)
                n[i] = len(s)
                if len(s):
                    # sums of two scrambles don't depend on order
                    made[0, i], made[1, i] = mix64(s).sum(), mix64(s * _ODD + np.uint64(7)).sum()
                    made[2:, i] = small_keys(s, collections, depth)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *[pa.array(x.view(np.int64), mask=n == 0) for x in made]], names=["doc_id", "n_shingles", "a", "b", *_names(collections)])
        _words.clear()  # the worker goes on to other stages
        give_back_memory()

    return spread(docs).mapInArrow(mark, "doc_id long, n_shingles long, a long, b long, " + ", ".join(f"{c} long" for c in _names(collections)))


def _names(collections: int) -> list[str]:
    return [f"k{i}" for i in range(collections)]


def _turned(key: Column) -> Column:
    """The bits of a 64-bit key, turned by one: a pair of small keys is the exclusive or of the first and the second so turned."""
    return F.shiftleft(key, 1).bitwiseOR(F.shiftrightunsigned(key, 63))


def _shared(classes: DataFrame, collections: int, work: Scratch) -> DataFrame:
    """id, n, tag (tells classes of one id apart) and the small keys that another class holds too, null for the others, of classes with two at least."""
    names = _names(collections)
    rows = classes.select("id", "n", F.xxhash64("a", "b").bitwiseAND(0x7FFFFFFF).cast("int").alias("tag"), F.posexplode(F.array(*names)).alias("c", "h"))
    often = work.written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("h"), "small-keys")
    held = rows.join(often, "h").groupBy("id", "n", "tag").agg(*[F.max(F.when(F.col("c") == i, F.col("h"))).alias(c) for i, c in enumerate(names)])
    return held.where(sum(F.col(c).isNotNull().cast("int") for c in names) > 1)


def _table(members: DataFrame, collections: int, percent: int) -> DataFrame:
    """key, band, id and n for each pair of small keys. Sizes that allow a link lie in one band or in two next to each other."""
    turned = members.withColumns({f"t{i}": _turned(F.col(f"k{i}")) for i in range(collections)})
    keys = F.array_compact(F.array(*[F.col(f"k{i}").bitwiseXOR(F.col(f"t{j}")) for i, j in combinations(range(collections), 2)]))
    band = F.floor(F.log(F.col("n").cast("double")) / (log(100 / percent) * (1 + 1e-9))).cast("int") if percent < 100 else F.col("n").cast("int")
    return turned.select(F.explode(keys).alias("key"), band.alias("band"), "id", "n")


def _stars(table: DataFrame, work: Scratch) -> DataFrame:
    """(a, b, shared), a < b: each bucket's members of one band with the smallest id among them, and these pivots with that of the band below; shared: in how many buckets."""
    pivots = work.written(table.groupBy("key", "band").agg(F.min("id").alias("p"), F.max("id").alias("q")), "pivots")
    inside = table.join(pivots.where("p <> q").select("key", "band", "p"), ["key", "band"]).select(F.col("p").alias("a"), F.col("id").alias("b"))
    below = pivots.select("key", (F.col("band") + 1).alias("band"), F.col("p").alias("lower"))
    between = pivots.select("key", "band", "p").join(below, ["key", "band"]).select(F.least("p", "lower").alias("a"), F.greatest("p", "lower").alias("b"))
    return inside.unionByName(between).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def _bits(texts: DataFrame, k: int) -> DataFrame:
    """id, size (of its set) and bitmap."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), k) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary())], names=["id", "n", "bits"])

    return texts.select("doc_id", "text").mapInArrow(make, "id long, n long, bits binary")


def _across(open_: DataFrame, members: DataFrame, bits: DataFrame, percent: int, collections: int, work: Scratch) -> DataFrame:
    """(a, b), a < b: pairs of a bucket's members in different components whose sizes and bitmaps allow the similarity.

    ``open_``: key, id, n, comp. A bucket's largest component makes blocks of its own, which don't meet each other. A row of the join is a pair of blocks; a pair of members leaves the
    bucket of its first two equal small keys, and no other.
    """
    most = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows")).groupBy("key").agg(F.max(F.struct("rows", "comp")).alias("m"), F.sum("rows").alias("rows"))
    most = most.select("key", F.col("m.comp").alias("main"), F.col("m.rows").alias("large"), (F.col("rows") - F.col("m.rows")).alias("small"))
    large = F.col("comp") == F.col("main")
    number = lambda rows: F.pmod(F.xxhash64("id"), F.ceil(F.col(rows) / BLOCK)).cast("int")
    dealt = open_.join(work.written(most, "main"), "key").select("key", "id", "n", "comp", large.alias("large"), F.when(large, number("large")).otherwise(number("small")).alias("block"))
    described = members.join(bits, ["id", "n"]).select("id", "n", "bits", F.array(*[F.coalesce(c, F.lit(0)) for c in _names(collections)]).alias("keys"))
    row = F.struct("id", "n", "comp", "bits", "keys")
    blocks = work.written(dealt.join(described, ["id", "n"]).groupBy("key", "large", "block").agg(F.collect_list(row).alias("rows")), "blocks")

    def unpacked(lists: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Where each row's members start, and all members' ids, sizes, components, bitmaps, keys and numbers of shingles that share a bit."""
        rows, start = lists.flatten(), np.asarray(lists.offsets)
        ids, n, comp = (rows.field(c).to_numpy() for c in ("id", "n", "comp"))
        x = np.frombuffer(b"".join(rows.field("bits").to_pylist()), np.uint64).reshape(-1, WORDS)
        keys = rows.field("keys").flatten().to_numpy().view(np.uint64).reshape(-1, collections)
        return start - start[0], [ids, n, comp, x, keys, n - np.bitwise_count(x).sum(1)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some_rows = batch.slice(at, 256)
                (sa, left), (sb, right) = unpacked(some_rows.column(1)), unpacked(some_rows.column(2))
                found = [np.zeros((0, 2), np.int64)]
                for j, key in enumerate(some_rows.column(0).to_numpy().view(np.uint64)):
                    ib, nb, cb, xb, kb, eb = (c[sb[j] : sb[j + 1]] for c in right)
                    for ia, na, ca, xa, ka, ea in zip(*(c[sa[j] : sa[j + 1]] for c in left), strict=True):
                        some = np.flatnonzero((ca != cb) & (ia != ib) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)))
                        if len(some):
                            bound = np.bitwise_count(xa & xb[some]).sum(1, dtype=np.int64) + np.minimum(ea, eb[some])
                            some = some[100 * bound >= percent * (na + nb[some] - bound)]
                        if len(some):
                            same = (kb[some] == ka) & (ka != 0)
                            one = same.argmax(1)
                            same[np.arange(len(some)), one] = False
                            second = kb[some, same.argmax(1)]
                            some = some[(kb[some, one] ^ (second << np.uint64(1) | second >> np.uint64(63))) == key]
                            found.append(np.stack([np.minimum(ia, ib[some]), np.maximum(ia, ib[some])], 1))
                pairs = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    side = lambda x: blocks.select("key", F.col("large").alias(f"large_{x}"), F.col("block").alias(f"block_{x}"), F.col("rows").alias(f"rows_{x}"))
    met = side("a").join(side("b"), "key").where("not (large_a and large_b) and (large_a and not large_b or large_a = large_b and block_a <= block_b)")
    return met.select("key", "rows_a", "rows_b").mapInArrow(compare, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with ``linked``. The text of b goes to that of a; where a is a pivot, its set is made once for all that follow each other."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            linked = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True):
                if a != last or kept[0] != len(ta.as_buffer()):
                    last, kept = a, (len(ta.as_buffer()), ta.as_py(), shingle_set(ta.as_py(), k))
                mine = kept[2] if kept[1] == ta.as_py() else shingle_set(ta.as_py(), k)
                linked.append(similar(mine, shingle_set(tb.as_py(), k), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])
        _words.clear()
        give_back_memory()

    with_b = texts.join(sent_if_small(pairs.select("a", "b")), F.col("doc_id") == F.col("b")).select("a", "b", F.col("text").alias("tb"))
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long, linked boolean")


def components(links: DataFrame, work: Scratch | None = None) -> DataFrame:
    """(id, comp) of every id in ``links`` (a, b), with comp the smallest id that it reaches.

    Every id takes the smallest of itself and its neighbours, chains of these are shortened by half at a time until each ends at an id that took itself, and the links that still
    lead from one such id to another make the next, smaller graph. The number of rounds grows with the logarithm of the longest path. A hub's neighbours are never gathered: minima are
    pre-aggregated. Tables go to ``work``, which the caller clears.
    """
    work = work or Scratch(links.sparkSession)
    edges = work.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = work.written(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), "labels")
        while True:
            to = work.written(to.join(to.select(F.col("u").alias("p"), F.col("p").alias("further")), "p").select("u", F.col("further").alias("p"), (F.col("further") != F.col("p")).alias("moved")), "labels")
            if to.where("moved").isEmpty():
                break
            to = to.select("u", "p")
        next_ = to.select(F.col("u").alias("p"), F.col("p").alias("root"))
        labels = to.select("u", "p") if labels is None else work.written(labels.join(next_, "p", "left").select("u", F.coalesce("root", "p").alias("p")), "labels")
        ends = edges.join(to.select("u", F.col("p").alias("pu")), "u").join(to.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        edges = work.written(ends.where("pu <> pv").select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct(), "edges")
        if edges.isEmpty():
            return labels.select(F.col("u").alias("id"), F.col("p").alias("comp"))


def _component(df: DataFrame, comp: DataFrame | None, of: str, name: str) -> DataFrame:
    """``df`` with the component of the id in column ``of``: the id itself where no link has been found."""
    if comp is None:
        return df.withColumn(name, F.col(of))
    known = sent_if_small(comp.select(F.col("id").alias("_id"), F.col("comp").alias("_comp")))
    return df.join(known, F.col(of) == F.col("_id"), "left").withColumn(name, F.coalesce("_comp", of)).drop("_id", "_comp")


def _merged(comp: DataFrame | None, links: DataFrame, work: Scratch) -> DataFrame:
    """(id, comp) after further links. Links become edges between components first, so only components that really meet go through the rounds."""
    met = _component(_component(links, comp, "a", "u"), comp, "b", "v").where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b"))
    moved = components(met, work)
    if comp is None:
        return moved
    old = comp.join(moved.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    new = moved.join(comp.select("id"), "id", "left_anti")  # ids that had no component yet are their own
    return work.written(old.unionByName(new), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, collections: int = 16, depth: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that links lead to) and kept (doc_id = component_id) of each row.

    Rows are linked if 100 * intersection >= ``percent`` * union of their sets. Null and empty texts, and texts of white space alone, have an empty set and are linked with
    nothing. A row without id takes no part: its component is null and it is kept. Repeated rows of one id are one document: where their texts differ, a link of either counts, and
    all have one component. An empty table gives no rows; further columns, of any name, are left out. ``collections`` and ``depth``: small keys and the minima of each.
    """
    d, spark = only(docs, doc_id=id_col, text=text_col), docs.sparkSession
    stay, work = Scratch(spark), Scratch(spark)
    names = _names(collections)
    marks = stay.written(_marks(d, k, collections, depth), "marks")
    named = marks.where("doc_id is not null and a is not null")
    classes = work.written(named.groupBy("a", "b").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n"), *[F.max(c).alias(c) for c in names]), "classes")
    members = work.written(_shared(classes, collections, work), "members")
    table = work.written(_table(members, collections, percent), "table")
    stars = work.written(_stars(table, work), "stars")
    ids = stars.select(F.col("a").alias("of")).unionByName(stars.select(F.col("b").alias("of"))).distinct()
    texts = work.written(d.join(sent_if_small(work.written(ids, "ids")), F.col("doc_id") == F.col("of"), "left_semi"), "texts")

    # rows of one id with different sets make their classes one
    twice = named.groupBy("doc_id").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("doc_id")
    both = named.join(twice, "doc_id").select("doc_id", "a", "b").join(classes.select("a", "b", "id"), ["a", "b"]).select("doc_id", "id")
    links = both.join(both.groupBy("doc_id").agg(F.min("id").alias("least")), "doc_id").select(F.col("least").alias("a"), F.col("id").alias("b"))

    best = work.written(stars.groupBy("b").agg(F.max(F.struct("shared", -F.col("a"))).alias("m")).select((-F.col("m.col2")).alias("a"), "b"), "best")
    known = work.written(_verified(best, texts, k, percent), "verified")
    comp = _merged(None, links.unionByName(known.where("linked").select("a", "b")), work)

    def further(pairs: DataFrame) -> None:
        """Verifies pairs that lie in different components and weren't verified before, and merges components."""
        nonlocal known, comp
        fresh = work.written(pairs.join(known.select("a", "b"), ["a", "b"], "left_anti"), "candidates")
        found = work.written(_verified(fresh, texts, k, percent), "verified")
        known = known.unionByName(found)
        new = found.where("linked").select("a", "b")
        if not new.isEmpty():
            comp = _merged(comp, new, work)

    def apart(pairs: DataFrame) -> DataFrame:
        return _component(_component(pairs, comp, "a", "_u"), comp, "b", "_v").where("_u <> _v").select("a", "b")

    further(apart(stars))
    collect_garbage(spark)
    # a bucket with members in different components holds one that isn't in its pivot's
    left = work.written(apart(stars).select(F.col("b").alias("of")).distinct(), "apart")
    if not left.isEmpty():
        keys = table.join(sent_if_small(left), F.col("id") == F.col("of"), "left_semi").select("key").distinct()
        held = work.written(table.join(work.written(keys, "keys"), "key", "left_semi").select("key", "id", "n"), "held")

        now = _component(held, comp, "id", "comp")
        # of two members both have been compared
        open_ = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo <> hi and rows > 2").select("key")
        now = work.written(now.join(open_, "key", "left_semi"), "open")
        own = now.select(F.col("id").alias("of")).distinct()
        bits = work.written(_bits(texts.join(own, F.col("doc_id") == F.col("of"), "left_semi"), k), "bits")
        further(_across(now, members, bits, percent, collections, work))
    moved = comp.where("comp <> id")
    answer = classes.join(moved, "id", "left").where("copies > 1 or comp is not null").select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.coalesce("comp", "id").alias("component"))
    answer = stay.written(answer, "answer")
    work.clear()
    out = marks.join(answer, (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
