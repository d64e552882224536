"""Operator 5, approximate nearest neighbours with score-aware anisotropic quantisation.

The nearest in Euclidean distance has the largest inner product of (q, 1) with (x, -|x|^2 / 2). A vector so extended goes to its coarse cell, and its residual is quantised in
subspaces of two dimensions with 16 codes each; a code is chosen to make small the quantisation error with the part parallel to the vector weighted ``eta`` times,
since that part moves high inner products. Tables of 16 numbers for each query and subspace are added up over the four-bit codes. The best of a chunk by these sums get exact distances
first; then so does every other row that, by the stored length of its quantisation error, can be as near as the last of them: within the cells probed nothing is lost.

Centres are fitted on the ``sample_rows`` vectors with the smallest id hashes, codes on the first 4,096 of them; every row is indexed. Rows are packed by cell into chunks of bounded
size where they are read, queries into packs for the cells they probe, and chunks meet packs by cell and share: a cell of many rows is dealt into shares of about 16,384 rows, so no
task gets a whole large cell, and no row meets a query outside a block of both. Where all cells are probed the answer is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, only, spread


@dataclass(frozen=True)
class Index:
    cells: np.ndarray  # n x dim
    books: np.ndarray  # subspaces x 16 x 2
    eta: float
    probes: int = 1  # cells that a query has to look into

    @property
    def dim(self) -> int:
        return self.cells.shape[1]


def extended(x: np.ndarray) -> np.ndarray:
    """Vectors with -|x|^2 / 2 and, if that makes an odd number of dimensions, a zero."""
    half = -0.5 * (x * x).sum(1, keepdims=True)
    return np.concatenate([x, half, *([np.zeros_like(half)] if x.shape[1] % 2 == 0 else [])], 1)


def nearest_cells(x: np.ndarray, cells: np.ndarray, many: int = 1) -> np.ndarray:
    d = (cells * cells).sum(1)[None, :] - 2 * x @ cells.T
    return np.argsort(d, 1, kind="stable")[:, :many]


def _direction(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def assign_codes(residual: np.ndarray, direction: np.ndarray, books: np.ndarray, eta: float, passes: int = 2) -> np.ndarray:
    """Codes (rows x subspaces) by coordinate descent on |e|^2 + (eta - 1) * (e . direction)^2."""
    n, m = len(residual), len(books)
    r, u = residual.reshape(n, m, 2), direction.reshape(n, m, 2)
    codes = np.stack([((r[:, s, None, :] - books[None, s]) ** 2).sum(2).argmin(1) for s in range(m)], 1)
    parallel = ((r - books[np.arange(m)[None, :], codes]) * u).sum((1, 2))
    for _ in range(passes):
        for s in range(m):
            e = r[:, s, None, :] - books[None, s]
            along = (e * u[:, s, None, :]).sum(2)
            rest = parallel - along[np.arange(n), codes[:, s]]
            best = ((e * e).sum(2) + (eta - 1) * (rest[:, None] + along) ** 2).argmin(1)
            parallel = rest + along[np.arange(n), best]
            codes[:, s] = best
    return codes


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        to = nearest_cells(x, centres)[:, 0]
        count = np.bincount(to, minlength=k)
        total = np.stack([np.bincount(to, x[:, d], k) for d in range(x.shape[1])], 1)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def fit_index(sample: np.ndarray, n_cells: int, eta: float = 4.0, rounds: int = 4) -> Index:
    rng = np.random.default_rng(5)
    every = sample.astype(np.float64)
    cells = _k_means(every, n_cells, rng)
    x = every[:4096]  # a code is a point in the plane: few rows tell it
    long = extended(x)
    residual = long - extended(cells)[nearest_cells(x, cells)[:, 0]]
    u = _direction(long)
    m = long.shape[1] // 2
    books = np.stack([_k_means(residual[:, 2 * s : 2 * s + 2], 16, rng) for s in range(m)])
    for _ in range(rounds):
        codes = assign_codes(residual, u, books, eta, 1)
        for s in range(m):
            # least squares of the anisotropic loss for each code, the other subspaces held
            other = residual.reshape(len(x), m, 2) - books[np.arange(m)[None, :], codes]
            us = u[:, 2 * s : 2 * s + 2]
            rest = (other * u.reshape(len(x), m, 2)).sum((1, 2)) - (other[:, s] * us).sum(1)
            weight = np.eye(2)[None] + (eta - 1) * us[:, :, None] * us[:, None, :]
            goal = (weight @ residual[:, 2 * s : 2 * s + 2, None])[:, :, 0] + (eta - 1) * rest[:, None] * us
            for c in range(16):
                if (mine := codes[:, s] == c).any():
                    books[s, c] = np.linalg.solve(weight[mine].sum(0), goal[mine].sum(0))
    return Index(cells, books, eta, enough_probes(every, cells))


def enough_probes(x: np.ndarray, cells: np.ndarray, share: float = 0.98, asked: int = 256, k: int = 10) -> int:
    """How many of a query's nearest cells hold ``share`` of its ``k`` nearest sampled vectors: few if the data form clusters, most of all cells if they are spread evenly."""
    if len(cells) == 1 or len(x) < 2:
        return len(cells)
    own = nearest_cells(x, cells)[:, 0]
    some = np.linspace(0, len(x) - 1, min(asked, len(x))).astype(np.int64)
    d = (x * x).sum(1)[None, :] - 2 * x[some] @ x.T
    d[np.arange(len(some)), some] = np.inf
    near = np.argpartition(d, min(k, len(x) - 1) - 1, 1)[:, :k]
    place = np.argsort(nearest_cells(x[some], cells, len(cells)), 1)  # of each cell in a query's order
    at = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(share * len(at))))]) + 1


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells, codes two to a byte, and what the codes leave out of a product with (q, 1): with the error e of the vector and f of its half square, and the cell's centre c, the
    number c . e + f, which is the same for all queries, and |e|, as the rest (q - c) . e is at most |q - c| |e|."""
    long = extended(x.astype(np.float64))
    centres, books = index.cells.astype(np.float64), index.books.astype(np.float64)
    cell = nearest_cells(x.astype(np.float64), centres)[:, 0]
    residual = long - extended(centres)[cell]
    codes = assign_codes(residual, _direction(long), books, index.eta).astype(np.uint8)
    error = residual - books[np.arange(len(books))[None, :], codes].reshape(residual.shape)
    e = error[:, : index.dim]
    left_out = np.stack([(e * centres[cell]).sum(1) + error[:, index.dim], np.linalg.norm(e, axis=1)], 1)
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
    return cell, codes[:, ::2] | codes[:, 1::2] << 4, left_out


def table_scan(index: Index, cell: int, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate inner products (queries x rows) of one cell's rows."""
    q = np.concatenate([queries, np.ones((len(queries), 1)), *([np.zeros((len(queries), 1))] if index.dim % 2 == 0 else [])], 1)
    tables = np.einsum("qmd,mkd->mqk", q.reshape(len(q), -1, 2), index.books.astype(np.float64))
    out = np.repeat(q @ extended(index.cells[cell : cell + 1].astype(np.float64)).T, len(packed), 1)
    for s, table in enumerate(tables):
        out += table[:, packed[:, s // 2] >> (4 * (s % 2)) & 15]
    return out


def nearest_ids(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best scores of distinct ids, ties to the smaller id."""
    order = np.lexsort((ids, score))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def nearest_of_chunk(index: Index, cell: int, qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, packed: np.ndarray, left_out: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, distances) of each query's ``k`` nearest rows of one chunk, exactly."""
    guess = table_scan(index, cell, q, packed) + left_out[None, :, 0]
    off = np.linalg.norm(q - index.cells[cell].astype(np.float64), axis=1)
    square = (q * q).sum(1)
    slack = 1e-9 * (square + (x * x).sum(1).max())  # far more than sums in double precision are off
    least = (square - slack)[:, None] - 2 * (guess + off[:, None] * left_out[None, :, 1])  # no squared distance is below
    other = qids[:, None] != ids[None, :]
    guess[~other] = -np.inf
    first = np.argpartition(-guess, rerank - 1, 1)[:, :rerank] if len(ids) > rerank else np.repeat(np.arange(len(ids))[None, :], len(q), 0)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, a in enumerate(q):
        at = first[i][other[i, first[i]]]
        score = np.sqrt(((a - x[at]) ** 2).sum(1))
        best = nearest_ids(ids[at], score, k)
        open_ = other[i] if len(best) < k else other[i] & (least[i] <= score[best[-1]] ** 2)
        open_[at] = False
        if open_.any():
            more = np.flatnonzero(open_)
            at, score = np.concatenate([at[best], more]), np.concatenate([score[best], np.sqrt(((a - x[more]) ** 2).sum(1))])
            best = nearest_ids(ids[at], score, k)
        out.append((np.full(len(best), qids[i]), ids[at[best]], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _usable(v: Column) -> Column:
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e70)
    return v.isNotNull() & F.coalesce(F.forall(v, sound), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _shares(count: int, rows: int = 16_384) -> int:
    return max(1, -(-count // rows))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 20_000, rows_per_cell: int = 5_000, rerank: int = 128, chunk: int = 2048, probe: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance in double precision) of each query's ``k`` nearest found, ties to the smaller id.

    A query meets every row but those of its own id; with fewer than ``k`` it has that many rows. Vectors that are null, zero, of another number of dimensions than most, or that hold
    null or non-finite components, or ones of 1e70 or more (fourth powers must be finite; any float is), take no part, nor do rows without id. Repeated rows of one id count as its nearest, and only distinct ids are counted where copies of one vector are
    cut to the smallest ids. Vectors of float keep that type, all others are measured as double. Empty tables, on either side, give no rows.

    ``rows_per_cell``: there is a cell for each so many rows, as far as ``sample_rows`` allows 32 sampled vectors for each; with a larger table raise both the sample and the driver's memory,
    or a query's work grows with the table. ``probe``: cells a query looks into, unless given as many as the sample shows to hold 98 of 100 neighbours; a query goes on to further cells
    until those it looks into hold ``k`` other ids. A number not below that of cells makes the search exact. ``rerank``: rows of a chunk that get exact distances first; every other one
    that can still be as near gets its own after them, so the answer doesn't depend on it. ``chunk``: rows in a block, which bounds a task's memory.
    """
    spark = vectors.sparkSession
    names = {"vec_id": id_col, "v": vector_col}
    rows, asked = (only(t, **names).where(F.col("vec_id").isNotNull() & _usable(F.col("v"))) for t in (vectors, queries))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    kinds = "query_id long, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = sizes["dim"], sizes["n"]
    kind = "array<float>" if dict(rows.dtypes)["v"] == "array<float>" else "array<double>"
    raw = "<f4" if kind == "array<float>" else "<f8"
    rows, asked = (t.where(F.size("v") == dim).select("vec_id", F.col("v").cast(kind).alias("v")) for t in (rows, asked))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow()["v"].combine_chunks()
    n_cells = max(1, min(total // rows_per_cell, sample_rows // 32))
    fitted = fit_index(_matrix(sample, dim), n_cells)
    shared = spark.sparkContext.broadcast(fitted)  # centres and codes, whatever the data
    probes = min(n_cells, probe or fitted.probes)
    held_ids = np.zeros(n_cells, np.int64)  # ids by cell, each counted in one cell alone

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value.cells.astype(np.float64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(nearest_cells(_matrix(some.column(1), dim).astype(np.float64), centres)[:, 0], pa.int32())], names=["vec_id", "cell"])

    if n_cells == 1:
        held_ids[0] = total
    else:
        for r in spread(rows).mapInArrow(cells_of, "vec_id long, cell int").groupBy("vec_id").agg(F.min("cell").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
            held_ids[r["cell"]] = r["n"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, x, cell, codes, left_out = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((ids, cell))
            # of one vector's copies the smallest ids alone can be among the nearest: one more than k, as one may be the query
            _, same = np.unique(x[order], axis=0, return_inverse=True)
            by = np.argsort(same, kind="stable")
            by = by[np.concatenate([[True], (np.diff(same[by]) != 0) | (np.diff(ids[order][by]) != 0)])]  # repeated rows are one
            nth = np.arange(len(by)) - np.maximum.accumulate(np.where(np.diff(same[by], prepend=-1) != 0, np.arange(len(by)), 0))
            order = order[np.sort(by[nth <= k])]
            for c in np.unique(cell[order]):
                own = order[cell[order] == c]
                for at in range(0, len(own), chunk):
                    some = own[at : at + chunk]
                    share = int(mix64(ids[some[:1]].view(np.uint64))[0] % np.uint64(_shares(held_ids[c])))
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([share], pa.int32()), pa.array([ids[some].astype("<i8").tobytes()]), pa.array([x[some].astype(raw).tobytes()]), pa.array([codes[some].tobytes()]), pa.array([left_out[some].astype("<f8").tobytes()])], names=["cell", "share", "ids", "x", "codes", "left_out"])

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                x = _matrix(some.column(1), dim)
                held.append((some.column(0).to_numpy(), x, *encode(index, x)))
                waiting += len(x)
                if waiting >= 65_536:
                    yield from flush()
                    held, waiting = [], 0
        if held:
            yield from flush()

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            near = nearest_cells(x.astype(np.float64), index.cells.astype(np.float64), n_cells)
            before = np.cumsum(held_ids[near], 1) - held_ids[near]
            into = (np.arange(n_cells) < probes) | (before <= k)  # k others and perhaps the query itself
            for c in np.unique(near[into]):
                own = np.flatnonzero(((near == c) & into).any(1))
                for at in range(0, len(own), 256):
                    some = own[at : at + 256]
                    for share in range(_shares(held_ids[c])):
                        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([share], pa.int32()), pa.array([ids[some].astype("<i8").tobytes()]), pa.array([x[some].astype(raw).tobytes()])], names=["cell", "share", "qids", "q"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for cell, ids, x, codes, left_out, qids, q in zip(*(batch.column(j).to_pylist() for j in range(7)), strict=True):
                ids, qids = np.frombuffer(ids, "<i8"), np.frombuffer(qids, "<i8")
                x, q = np.frombuffer(x, raw).reshape(-1, dim).astype(np.float64), np.frombuffer(q, raw).reshape(-1, dim).astype(np.float64)
                found = nearest_of_chunk(index, cell, qids, q, ids, x, np.frombuffer(codes, np.uint8).reshape(len(ids), -1), np.frombuffer(left_out, "<f8").reshape(-1, 2), k, rerank)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    left = spread(rows).mapInArrow(chunks, "cell int, share int, ids binary, x binary, codes binary, left_out binary")
    right = asked.mapInArrow(packs, "cell int, share int, qids binary, q binary")
    met = left.join(right, ["cell", "share"]).select("cell", "ids", "x", "codes", "left_out", "qids", "q").mapInArrow(scan, kinds)
    once = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
