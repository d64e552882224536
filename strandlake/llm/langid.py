"""Operator 9, language identification: averaged hashed subword embeddings with a linear softmax.

A text's letters (white space and ASCII non-letters become one kind of blank, A-Z lower case) give all byte n-grams of 1 to 4 within words, hashed into ``buckets``. The
text's vector is the mean of their embeddings, a linear layer and a softmax give languages. Embeddings and layer are trained together by stochastic gradient descent in
numpy on the driver, over a bounded sample of labelled rows: the ``sample_rows`` with the smallest hashes of text and language. A part of the sample is kept from training to
calibrate: a temperature by likelihood, a threshold for the largest probability, and a limit of strangeness. A text is strange by as much as its subwords are rarer, on average, in the
language that it is given than those of that language's texts; so texts in none of the languages are rejected whatever their largest probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, give_back_memory, only, portions, spread

#: ASCII non-letters become blanks, A-Z lower case.
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in LOWER)


def subword_counts(text: bytes, buckets: int, block: int = 1 << 18) -> np.ndarray:
    """Counts of a text's hashed byte n-grams, of any length. ``block`` n-grams are hashed at a time, so a very long text takes little more memory than its bytes."""
    x = np.frombuffer(b" " + text.translate(_LETTERS) + b" ", np.uint8)
    word = x != 32
    x = x[word | np.concatenate([[True], word[:-1]])]  # runs of blanks become one
    counts = np.zeros(buckets, np.int64)
    for at in range(0, len(x), block):
        _count(x[at : at + block + 3].astype(np.uint32), min(block, len(x) - at), counts)
    return counts


def _count(x: np.ndarray, starts: int, counts: np.ndarray) -> None:
    """Adds the n-grams that begin at the first ``starts`` places of ``x``; three further bytes, where the text has them, complete the last of them."""
    buckets = len(counts)
    blank = x == 32
    h = x.copy()
    ok = ~blank
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for n in range(1, 5):
        if n > 1:
            # a blank may begin or end an n-gram, as a word's edge, but not stand within it
            h = h[:-1] * np.uint32(0x01000193) + x[n - 1 :]
            inner = np.zeros(len(h), bool)
            for k in range(1, n - 1):
                inner |= blank[k : k + len(h)]
            ok = ~inner
        counts += np.bincount((((h[:starts] ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> shift)[ok[:starts]], minlength=buckets)


def has_letters(text: str) -> bool:
    """Any Unicode letter. ASCII ones are looked for first."""
    return bool(text) and (text.isalpha() or any(c.isalpha() for c in text))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    embed: np.ndarray  # buckets x dim
    layer: np.ndarray  # dim x languages
    bias: np.ndarray
    temperature: float
    threshold: float
    rarity: np.ndarray  # buckets x languages: minus the logarithm of a subword's share
    usual: np.ndarray  # of each language: rarity of a text's subwords on average
    limit: float  # of strangeness

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of the languages for rows of counts."""
        return _softmax((_means(counts) @ self.embed @ self.layer + self.bias) / self.temperature)

    def judged(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The likeliest language of rows of counts, its probability, and whether it is refused."""
        p = self.scores(counts)
        best, top = p.argmax(1), p.max(1)
        return best, top, (top < self.threshold) | (_strange(_means(counts), counts.sum(1), self.rarity, self.usual, best) > self.limit)


#: So many subwords, about four words, make a text's mean rarity as uncertain as it differs between long texts of a language.
_FEW = 64


def _means(counts: np.ndarray) -> np.ndarray:
    return (counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def _strange(means: np.ndarray, total: np.ndarray, rarity: np.ndarray, usual: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """How much rarer than usual in a language the subwords of rows are; less of it counts in short texts."""
    over = (means @ rarity)[np.arange(len(means)), lang] - usual[lang]
    return over / np.sqrt(1 + _FEW / np.maximum(total, 1))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(counts: np.ndarray, labels: list[str], dim: int = 16, epochs: int = 30, rate: float = 8.0, batch: int = 32, alpha: float = 0.0025, margin: float = 1.25, seed: int = 7) -> LanguageModel:
    """Trains on rows of counts, which it overwrites if they are of float32. Without rows the model knows no language and rejects all; with one language it always answers that.

    Rejection follows from correctly answered held-out rows alone, so misjudged or mislabelled ones don't loosen it. The threshold is passed by all but a share ``alpha`` of them, or the
    smallest share that so many rows show; it lies above the probability that every text reaches. The limit is ``margin`` times the strangeness that such a share exceeds, and at most
    half that of random subwords; that half alone where fewer than 100 rows would have to show it.
    """
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    buckets = counts.shape[1] if len(counts) else 1
    embed = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    layer = np.zeros((dim, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    if not len(counts) or not languages:
        return LanguageModel(languages, embed, layer, bias, 1.0, 1.0, np.zeros((buckets, len(languages)), np.float32), np.zeros(len(languages)), 0.0)
    total = counts.sum(1)
    x = counts if counts.dtype == np.float32 else counts.astype(np.float32)
    x /= np.maximum(total, 1)[:, None]
    y = np.searchsorted(languages, labels)
    order = rng.permutation(len(x))
    hold = order[: max(1, len(x) // 5)] if len(x) >= 20 else order
    train = order[len(hold) :] if len(x) >= 20 else order
    layer = rng.normal(0, 0.1, layer.shape).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.01
        for at in range(0, len(train), batch):
            some = train[at : at + batch]
            v = x[some] @ embed
            g = _softmax(v @ layer + bias)
            g[np.arange(len(some)), y[some]] -= 1
            g /= len(some)
            back = g @ layer.T
            layer -= step * 0.2 * (v.T @ g)
            bias -= step * 0.02 * g.sum(0)
            embed -= step * 2 * (x[some].T @ back)
    z = x[hold] @ embed @ layer + bias
    at = np.arange(len(hold))
    heat = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(_softmax(z / t)[at, y[hold]] + 1e-12).mean())
    p = _softmax(z / heat)
    # each text counts alike, and one more text holds all subwords alike
    share = np.full((buckets, len(languages)), 1 / buckets)
    for at_ in range(0, len(train), 256):
        some = train[at_ : at_ + 256]
        share += x[some].T @ np.eye(len(languages), dtype=np.float32)[y[some]]
    share /= np.bincount(y[train], minlength=len(languages)) + 1
    rarity = -np.log(share).astype(np.float32)
    own = (x @ rarity)[np.arange(len(x)), y]
    right = p.argmax(1) == y[hold]
    if not right.any():
        right[:] = True
    known = hold[right]
    usual = np.array([np.median(own[some if len(some := known[y[known] == k]) else y == k]) for k in range(len(languages))])
    alpha = max(alpha, 1 / len(known))
    limit = 0.5 * float((rarity.mean(0) - usual).min())
    if len(known) >= 100:
        limit = min(limit, margin * max(0.0, float(np.quantile(_strange(x[known], total[known], rarity, usual, y[known]), 1 - alpha))))
    # rejected if less likely than all but very few answers, and not if likelier than not, but in any case near the probability that all texts reach
    least = 0.0 if len(languages) == 1 else 1.2 / len(languages)
    threshold = max(min(float(np.quantile(p.max(1)[right], alpha)), 0.5), least)
    return LanguageModel(languages, embed, layer, bias, float(heat), threshold, rarity, usual, limit)


def fit_language_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = 4000, buckets: int = 1 << 12) -> LanguageModel:
    """Learns from rows with text and language. ``sample_rows`` bounds what the driver receives: so many rows of ``buckets`` counts at most.

    Of a frequent language there are as many rows in the sample as its share makes; null texts or languages take no part. Repeated rows have one hash and are one row.
    """
    d = only(docs, text=text_col, lang=lang_col).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    # the smallest hashes first, as many as the bound; then texts of those alone
    key = F.xxhash64("text", "lang")
    least = d.select(key.alias("key")).distinct().orderBy("key").limit(sample_rows).agg(F.max("key")).first()[0]
    if least is None:
        return fit(np.zeros((0, buckets)), [])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 256):
            rows = [subword_counts(t.as_py(), buckets) for t in batch.column(0).cast(pa.binary())]
            used = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([u.astype("<i4").tobytes() for u in used], pa.binary()), pa.array([r[u].astype("<i4").tobytes() for r, u in zip(rows, used, strict=True)], pa.binary())], names=["lang", "at", "n"])
        give_back_memory()

    found = d.where(key <= least).dropDuplicates(["text", "lang"]).mapInArrow(count, "lang string, at binary, n binary").toArrow()
    found = found.sort_by([("lang", "ascending"), ("at", "ascending"), ("n", "ascending")])
    counts = np.zeros((found.num_rows, buckets), np.float32)
    for i, (at, n) in enumerate(zip(found["at"], found["n"], strict=True)):
        counts[i, np.frombuffer(at.as_buffer(), "<i4")] = np.frombuffer(n.as_buffer(), "<i4")
    labels = found["lang"].to_pylist()
    del found, at, n  # the driver holds one copy
    pa.default_memory_pool().release_unused()
    return fit(counts, labels)


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and rejected of each row, from its text alone.

    A text that is null or without letters is ``und`` with score 0 and rejected; so is every text if the model knows no language. A text of any length is counted whole.
    A null id stays null, repeated rows get equal answers, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x dim numbers, whatever the data

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(1)
            langs, scores, refused = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
            for at in range(0, len(texts), 64):
                some = [i for i in range(at, min(at + 64, len(texts))) if texts[i].is_valid and has_letters(texts[i].as_py())]
                if some and m.languages:
                    found = m.judged(np.stack([subword_counts(texts[i].as_py().encode("utf-8", "surrogatepass"), m.embed.shape[0]) for i in some]))
                    for i, best, s, no in zip(some, *(c.tolist() for c in found), strict=True):
                        langs[i], scores[i], refused[i] = m.languages[best], min(1.0, max(0.0, s)), no
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores, pa.float64()), pa.array(refused)], names=["doc_id", "lang_pred", "score", "rejected"])

    return spread(only(docs, doc_id=id_col, text=text_col)).mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows whose language the model doesn't refuse, with all their columns: the verdict is made where the row is, so nothing is joined. A text is sent once, inside its row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d, place = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in portions(batches):
            good = np.zeros(batch.num_rows, bool)
            texts = batch.column(0).field(place)
            for at in range(0, len(texts), 64):
                some = [i for i in range(at, min(at + 64, len(texts))) if texts[i].is_valid and has_letters(texts[i].as_py())]
                if some and m.languages:
                    good[some] = ~m.judged(np.stack([subword_counts(texts[i].as_py().encode("utf-8", "surrogatepass"), m.embed.shape[0]) for i in some]))[2]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good))], names=["row"])
        give_back_memory()

    return d.mapInArrow(keep, d.schema).select("row.*")
