import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandlake.llm import packing, token_files
from strandlake.llm.tokens import Encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def plain(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


_made = {name: (Encoder(public_tokenizers.path(name), most=200), plain(name)) for name in FILES}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab AB.,'s\n\t\r\x00\x1c\xa0　éß日́!%1<|>")), max_size=30), max_size=5))
def test_pieces_give_the_ids_of_whole_texts(texts):
    for ours, theirs in _made.values():
        assert [x.tolist() for x in ours.encode(texts)] == [theirs(t) for t in texts]


def test_forgetting_changes_nothing(texts):
    for ours, theirs in _made.values():
        for _ in range(2):
            assert [x.tolist() for x in ours.encode([t for _, t in texts])] == [theirs(t) for _, t in texts]


@pytest.mark.parametrize(("n", "want"), [(1, [1]), (1024, [1024]), (2051, [1024, 1024, 2, 1]), (1023, [512, 256, 128, 64, 32, 16, 8, 4, 2, 1])])
def test_cuts(n, want):
    assert packing.cuts(n, 1024) == want


def test_packing(docs, texts):
    theirs = plain(FILES[0])
    want = sorted((k is None, k or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, t in texts for ids in [[*theirs(t), 0]])
    rows = packing.pack(docs, public_tokenizers.path(FILES[0])).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length == 1 << r.bucket == len(r.tokens) for r in rows)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.tokens, "<u4").tobytes()) for r in rows)
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id >> 33, r.sequence_id)):
        by.setdefault((r.sequence_id >> 33), []).append(r)
    got = []
    for part in by.values():
        ids = []
        for r in part:
            assert r.start == len(ids)
            ids += r.tokens
            if len(ids) == r.doc_tokens:
                got.append((r.doc_id is None, r.doc_id or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
                ids = []
        assert not ids
    assert sorted(got) == want


def test_packing_buckets(spark, docs, tmp_path):
    """A folder for each length, with sequences of that length alone."""
    packed = packing.pack(docs, public_tokenizers.path(FILES[0]), context=256, keep_words=False)
    packing.write_buckets(packed, f"file://{tmp_path}/out")
    read = spark.read.parquet(f"file://{tmp_path}/out")
    assert read.count() == packed.count() and read.where("size(tokens) <> shiftleft(1, bucket) or length <> size(tokens)").count() == 0


def test_packing_of_nothing(empty):
    assert packing.pack(empty, public_tokenizers.path(FILES[0])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, "", context=1000)


@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=40), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_re_pair_round_trip(docs_ids):
    sizes = np.array([len(d) for d in docs_ids])
    rules, rule_sizes, symbols, at, base = token_files.re_pair(np.concatenate([np.array(d, np.uint32) for d in docs_ids]), np.cumsum(sizes) - sizes, least=2)
    shard = {"base": base, "width": 4, "symbols": symbols.astype("<u4").tobytes(), "rules": rules.astype("<u4").tobytes(), "rule_tokens": rule_sizes.astype("<u4").tobytes(), "doc_at": np.append(at, len(symbols)).astype("<u4").tobytes(), "doc_tokens": sizes.astype("<u4").tobytes()}
    for i, d in enumerate(docs_ids):
        assert token_files.expand(shard, i).tolist() == d
        for a in range(len(d)):
            assert token_files.expand(shard, i, a, 3).tolist() == d[a : a + 3]
    assert all(rule_sizes >= 2)


def test_re_pair_compresses():
    x = np.tile(np.array([5, 6, 7, 8], np.uint32), 1000)
    rules, _, symbols, _, _ = token_files.re_pair(x, np.array([0]))
    assert len(rules) * 2 + len(symbols) < 200


def test_token_files(spark, docs, texts, tmp_path):
    theirs = plain(FILES[1])
    token_files.write_token_files(docs, f"file://{tmp_path}/t", public_tokenizers.path(FILES[1]), shard_tokens=500)
    got = sorted(token_files.read_token_files(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(k for k, _ in texts if k is not None)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    want = sorted((k is not None, k or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, t in texts for ids in [[*theirs(t), 1]])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want


def test_token_files_of_nothing(spark, empty, tmp_path):
    token_files.write_token_files(empty, f"file://{tmp_path}/t", public_tokenizers.path(FILES[1]))
    assert token_files.read_token_files(spark, f"file://{tmp_path}/t").count() == 0


class Counted:
    """A tokenizer that counts the ids it gives."""

    def __init__(self, tokenizer):
        self.tokenizer, self.normalizer, self.pre_tokenizer, self.ids = tokenizer, tokenizer.normalizer, tokenizer.pre_tokenizer, 0

    def encode_batch_fast(self, texts, **kwargs):
        found = self.tokenizer.encode_batch_fast(texts, **kwargs)
        self.ids += sum(len(e.ids) for e in found)
        return found


@pytest.mark.parametrize("name", FILES)
def test_a_word_is_encoded_once_whatever_marks_or_line_ends_are_beside_it(name):
    """Of 26 ** 2 words with each of ten marks the words and marks are learned, not their pairs, and the library gives no ids besides theirs."""
    words = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    texts = [" ".join(["x", *(w + m for w in words)]) for m in ".,;:!?%$&*"] + [None, "", " ".join(words) + "\n" + " ".join(words)]
    coder, theirs = Encoder(public_tokenizers.path(name)), plain(name)
    coder.tokenizer = Counted(coder.tokenizer)
    for form in (texts, pa.array(texts, pa.string()), pa.array([None, *texts], pa.large_string())[1:]):
        assert [x.tolist() for x in coder.encode(form)] == [theirs(t) for t in texts]
        assert coder.places.rows < len(words) + 30
        assert coder.tokenizer.ids <= sum(len(theirs(" " + w)) for w in words) + 60


def test_a_vocabulary_without_capitals_learns_a_word_once():
    coder, theirs = Encoder(public_tokenizers.path(FILES[1])), plain(FILES[1])
    texts = ["word Word WORD\nword, Word. wOrd! \u212aord H\u0331 h\u0331 \u1e96 I\u0307"]
    assert [x.tolist() for x in coder.encode(texts)] == [theirs(t) for t in texts]
    assert {"word"} == {p for p in coder.places if p.lower() == "word"}


def test_re_pair_of_rare_pairs_makes_no_rules():
    for x in (np.arange(5000, dtype=np.uint32), np.repeat(np.arange(700, dtype=np.uint32), 8)[::-1][:7], np.zeros(1, np.uint32)):
        rules, sizes, symbols, at, _ = token_files.re_pair(x.copy(), np.array([0]))
        assert not len(rules) and not len(sizes) and symbols.tolist() == x.tolist() and at.tolist() == [0]


def test_words_of_letters_that_the_vocabulary_cuts_are_encoded_apart():
    """Letters to Python, not all of them to the vocabulary; and marks that join a letter across the normaliser."""
    odd = ["ẞ", "ẖ", "H̱", "İ", "ǅ", "ﬁne", "가", "각", "ᵃ", "ª", "\U0001e4d0", "ࡰ", "\U00011f04", "\U00031350", "ﷺ", "ͅa", "ſ", "K", "क़"]
    texts = [" ".join(odd), "\n".join(odd), " ".join(w + "." for w in odd), "ab " + "ab ".join(odd), "　".join(odd), "\n　a \n a\n\n b \x1c\n"]
    for name in FILES:
        theirs = plain(name)
        for many in (texts, *[[t] for t in texts]):
            assert [x.tolist() for x in Encoder(public_tokenizers.path(name)).encode(many)] == [theirs(t) for t in many]
