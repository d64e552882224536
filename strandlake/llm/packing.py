"""Operator 1, packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are powers of two, longest first: as many of the context length as fit, then the binary
digits of the rest. Pieces of one length form a bucket and each piece is a sequence of its own, so no sequence crosses documents and none is padded.
No row meets another one, so the plan is one scan without a shuffle and a lost executor costs its open tasks only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back_memory, lengths, only, slices_of, spread
from .tokens import encoder, forget


def cuts(n: int, context: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids, longest first; ``context`` is a power of two."""
    out = [context] * (n // context)
    rest = n % context
    return out + [1 << k for k in range(context.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", context: int = 1024, end_id: int = 0, with_tokens: bool = True, remembered: int = 500_000, keep_words: bool = True, at_once: int = 4_000_000) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, bucket (log2 of length), tokens (unless left out), sequence_id, offset (always 0).

    A null or empty text holds the end id alone: one piece of length 1. A null id stays null; repeated rows are documents of their own. An empty table gives
    no rows. A sequence id is unique and is the same again when a task is repeated, since it counts within a partition of the input; with another split of the
    input, as on a cluster of another size, the ids are others, while all else is the same.
    ``context`` must be a power of two. ``remembered`` bounds the words that a worker keeps encoded, and with it its memory; with ``keep_words``
    they stay for its next tasks, without it they go when a task ends. ``at_once`` bytes are cut into words at a time (a longer text is one time of its own).
    Results depend on none of them.
    """
    if context < 1 or context & (context - 1):
        raise ValueError("context must be a power of two")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("bucket", pa.int32())]
    if with_tokens:
        fields.append(("tokens", pa.list_(pa.int32())))
    out = pa.schema(fields)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(tokenizer_path, remembered)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices_of(lengths(texts), at_once, 4096):
                columns: list[list] = [[] for _ in fields]
                for key, ids in zip(keys[a:b], codes.encode(texts.slice(a, b - a), at_once), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    at = 0
                    raw = ids.tobytes()
                    for n in cuts(len(ids), context):
                        row = [key, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), len(ids), n.bit_length() - 1]
                        if with_tokens:
                            row.append(ids[at : at + n].astype(np.int32))
                        for column, v in zip(columns, row, strict=True):
                            column.append(v)
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)
        if not keep_words:
            forget(tokenizer_path)
            give_back_memory()

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", tokens array<int>" * with_tokens
    rows = spread(only(docs, doc_id=id_col, text=text_col)).mapInArrow(pieces, kinds)
    return rows.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet, one folder for each length, ready for batches of equal length."""
    packed.write.partitionBy("bucket").parquet(path)
