"""Operator 4, line dedup, with DataFrame functions only.

Lines are normalised, those long enough explode as pairs of 64-bit hashes (each once for a row), and rows for a hash are summed before and after one shuffle. Only hashes with
enough rows meet their holders again; there distinct documents are counted, by (hash, document) first, so a line that very many documents hold is dealt over all tasks. Hashes over the
threshold come back to their documents as drop lists, which filter their own array of lines by position. Line texts never leave their document. Documents that a bitmap of fixed
size shows to have no list stay where they are; only the others' texts are shuffled to their lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, only, sent_if_small

#: Bits of one row of Spark's bitmap aggregate, fixed there; hashes that are broadcast at most.
_BITS, _SENT = 32_768, 250_000
#: White space of a line's ends: space, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case; every other character stays apart from every other.

    ``lower`` alone would also fold É or Σ. Read as Latin-1 the UTF-8 bytes of a text are letters of one byte, and lower-casing those moves, besides A-Z, only
    lead bytes C3-DE to E3-FE; the number of continuation bytes after a lead byte still tells which it was, so keys are equal only for equal lines.
    """
    return F.lower(F.decode(F.encode(F.btrim(line, F.lit(BLANKS)), "UTF-8"), "ISO-8859-1"))


def _hashes(line: Column) -> Column:
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(0x9E37), key).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _long(line: Column, least: int) -> Column:
    """Cheap first: a line with fewer bytes than that has fewer code points too."""
    return (F.octet_length(line) >= least) & (F.length(F.btrim(line, F.lit(BLANKS))) >= least)


def _bit(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` with the place of (doc_id, of) in a bitmap: _bucket and _bit."""
    place = F.pmod(F.xxhash64("doc_id", "of"), F.lit(buckets * _BITS))
    return docs.withColumns({"_bucket": F.floor(place / _BITS).cast("int"), "_bit": F.pmod(place, F.lit(_BITS)).cast("int")})


def _kept(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, buckets: int) -> DataFrame:
    """row (all columns as a struct), doc_id, n_lines and kept (an array of lines)."""
    # a list belongs to an id and a text, so it is bounded by that text's own lines however many rows share the id or have none
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("of", F.xxhash64("text"))
    work, stay = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: _long(x, min_chars)), _hashes))
    held = d.select("doc_id", "of", F.explode(keys).alias("h")).select("doc_id", "of", "h.a", "h.b")
    frequent = work.written(held.groupBy("a", "b").agg(F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("keeper")).where(F.col("rows") >= min_docs).drop("rows"), "lines")
    met = work.written(held.join(sent_if_small(frequent, _SENT), ["a", "b"]).groupBy("a", "b", "keeper", "doc_id", "of").agg(F.count(F.lit(1)).alias("rows")), "holders")
    documents = met.groupBy("a", "b", "doc_id").agg(F.sum("rows").alias("rows")).groupBy("a", "b").agg(F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(1)).alias("n"))
    often = work.written(documents.where(F.col("n") >= min_docs).select("a", "b"), "often")
    lost = met.join(sent_if_small(often, _SENT), ["a", "b"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lists = stay.written(lost.groupBy("doc_id", "of").agg(F.collect_set(F.struct("a", "b")).alias("drops")), "drops")
    maps = stay.written(_bit(lists, buckets).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map")), "bitmap")
    work.clear()
    byte = F.conv(F.hex(F.substring("_map", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), F.col("_bit") % 8).cast("int")) != 0, F.lit(False))
    dealt = _bit(d, buckets).join(F.broadcast(maps), "_bucket", "left").select("row", "doc_id", "text", "of", may.alias("_may"))
    named = lists.select(F.col("doc_id").alias("_doc"), F.col("of").alias("_of"), "drops")
    some = dealt.where("_may").join(named.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("of").eqNullSafe(F.col("_of"))), "left")
    lines = _lines(F.col("text"))
    kept = F.when(F.col("drops").isNull(), lines).otherwise(F.filter(lines, lambda x: ~(_long(x, min_chars) & F.array_contains(F.col("drops"), _hashes(x)))))
    out = lambda rows, left: rows.select("row", "doc_id", F.size(lines).cast("long").alias("n_lines"), left.alias("kept"))
    return out(some, kept).unionByName(out(dealt.where("not _may"), lines))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, buckets: int = 1024) -> DataFrame:
    """doc_id, n_lines, n_dropped and text (the lines that stay, joined by line ends) of each row.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents goes from all of them but the largest id that holds it, where every occurrence
    stays. A null or empty text is one empty line. Rows of one id are one document, which counts once and, if it is the largest, keeps the key in each of its rows. A row without id
    is a document of its own, smaller than any other; a key that only such rows hold stays. Further columns are left out. An empty table gives no rows. ``buckets``: of a bitmap with
    4 kB each that tells which documents surely lose nothing; results don't depend on it. Drop lists stay in the shared folder, as the result reads them.
    """
    d = _kept(only(docs, doc_id=id_col, text=text_col), "doc_id", "text", min_chars, min_docs, buckets)
    return d.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def rewrite_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, buckets: int = 1024) -> DataFrame:
    """All columns of ``docs``, with the lines that stay as text; otherwise as ``drop_repeated_lines``. A null text comes out empty."""
    d = _kept(docs, id_col, text_col, min_chars, min_docs, buckets)
    return d.select(*[F.array_join("kept", "\n").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
