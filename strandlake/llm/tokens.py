"""Token ids by the tokenizers library, through a bounded memory of words.

Both public vocabularies split a text into pre-tokens before any merge. No pre-token goes on from a non-space character
to white space, or from a letter to a punctuation mark, so a text may be cut there: the library encodes each
distinct piece once, and the ids of a text are gathered from its pieces. Texts in which such a cut could change a run of white
space go to the library whole. Tests compare with whole texts throughout.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import lengths, slices_of

#: A space or line end inside or at the end of a run of white space: there the byte-level vocabulary may not be cut.
_RUN = re.compile(r"\s[ \n](?:\s|\Z)")
_MARKS = ".,;:!?%$&*#"


def _string(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _of_distinct(texts: pa.Array, test: Callable[[str], bool]) -> np.ndarray:
    """A test's results for strings of which few are distinct."""
    found = texts.dictionary_encode()
    return np.array([test(t) for t in found.dictionary.to_pylist()], bool)[found.indices.to_numpy()]


def _taken(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of an array, end to end."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class _Places(dict):
    """Piece to row of the table of ids; a new piece gets the next row and waits to be encoded."""

    def __init__(self) -> None:
        self.new: list[str] = []
        self.rows = 1  # row 0 has no ids

    def __missing__(self, piece: str) -> int:
        self[piece] = row = self.rows
        self.rows += 1
        self.new.append(piece)
        return row


class Encoder:
    """Ids of whole texts. At most about ``most`` pieces are remembered at a time, then all are forgotten.

    A piece is a word that a space precedes, or starts with its line end, or with NUL if neither stands before it.
    """

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.space_matters = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        self.most = most
        # what stands between words that are encoded together: a pre-token and an id of its own
        self.between = "\n" if self.space_matters else " \x01 "
        mark = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        # capitals of ASCII words may go before they are looked up; beside an accent they may not, since both may be one letter in one case only
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str(ascii_uppercase) == ascii_lowercase
        self.closing: dict[str, bool] = {}
        self.edge = self._edges(pre_tokenizers.ByteLevel.alphabet())
        self._forget()

    def _forget(self) -> None:
        self.places = _Places()
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.starts, self.sizes = np.zeros((2, 1 << 16), np.int64)

    def _edges(self, alphabet: list[str]) -> np.ndarray | None:
        """Whether an id stands at a word's edge: it begins with a space, or ends a word of the other vocabulary. None if some byte has no id there, so that a word may have no edge."""
        vocabulary = self.tokenizer.get_vocab()
        if not all(c in vocabulary and (self.space_matters or c + "</w>" in vocabulary) for c in alphabet):
            return None
        edge = np.zeros(max(vocabulary.values()) + 1, bool)
        edge[[i for w, i in vocabulary.items() if (w.startswith("Ġ") if self.space_matters else w.endswith("</w>"))]] = True
        return edge

    def _pieces(self, texts: pa.Array) -> pa.Array:
        """A list of pieces for each text; of a null text, null."""
        if not self.space_matters:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        return pc.split_pattern(pc.binary_join_element_wise(_string("\0"), pc.replace_substring(texts, "\n", " \n"), _string("")), " ")

    def _parts(self, pieces: pa.Array) -> np.ndarray:
        """Rows of three smaller pieces with the same ids, for each of the distinct pieces: its line end, its letters, the marks after them. Row 0 is nothing."""
        parts = np.zeros((len(pieces), 3), np.int64)
        bare = "\0" if self.space_matters else ""
        if self.space_matters:
            lines = np.flatnonzero(pc.starts_with(pieces, "\n").to_numpy(zero_copy_only=False))
            rests = [p[1:] for p in _strings(pieces.take(pa.array(lines)))]
            lines = lines[np.array([bool(r) and not r[0].isspace() for r in rests], bool)]
            parts[lines, 0] = self.places["\0\n"]
            mask = np.zeros(len(pieces), bool)
            mask[lines] = True
            pieces = pc.replace_with_mask(pieces, mask, pa.array([bare + r for r in rests if r and not r[0].isspace()], pa.large_string()))
        if self.lowers:
            pieces = pc.if_else(pc.string_is_ascii(pieces), pc.ascii_lower(pieces), pieces)
        core = pc.ascii_rtrim(pieces, characters=_MARKS)
        gone = pc.subtract(pc.binary_length(pieces), pc.binary_length(core)).to_numpy()
        marked = np.flatnonzero(gone)
        last = pc.utf8_slice_codeunits(core.take(pa.array(marked)), -1)
        marked = marked[_of_distinct(last, self._closes)]
        cut = np.zeros(len(pieces), bool)
        cut[marked] = True
        words = pc.if_else(cut, core, pieces).dictionary_encode()
        parts[:, 1] = self._rows(_strings(words.dictionary))[words.indices.to_numpy()]
        parts[marked, 2] = self._rows([bare + p[-n:] for p, n in zip(_strings(pieces.take(pa.array(marked))), gone[marked].tolist(), strict=True)])
        return parts

    def _closes(self, letter: str) -> bool:
        """Whether the vocabulary cuts between a letter and a mark; not if normalising puts an accent at the letter's end."""
        if letter not in self.closing:
            text = f"a{letter}."
            if self.tokenizer.normalizer:
                text = self.tokenizer.normalizer.normalize_str(text)
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            self.closing[letter] = letter.isalpha() and cut[-1][0] == "."
        return self.closing[letter]

    def _rows(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.places.__getitem__, pieces), np.int64, len(pieces))

    def _text(self, piece: str) -> str:
        if not self.space_matters or piece[:1] == "\n":
            return piece
        return piece[1:] if piece[:1] == "\0" else " " + piece

    def _put(self, rows: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        """Ids of rows, laid end to end."""
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(self.used, len(flat)) + 1024, np.uint32)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.sizes[rows] = sizes
        self.starts[rows] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)

    def _one_word(self, piece: str) -> bool:
        core = piece[1:] if self.space_matters and piece[:1] == "\0" else piece
        return core.split() == [core] and "\x01" not in core and "\0" not in core

    def _lettered(self, words: list[str], many: int = 100) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of words of letters has, and the ids end to end; a hundred words are in a text, and the ids tell where each begins or ends."""
        groups = [words[i : i + many] for i in range(0, len(words), many)]
        lead = " " * self.space_matters
        sizes, flat = [], []
        for g, e in zip(groups, self.tokenizer.encode_batch_fast([lead + " ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            at = np.flatnonzero(self.edge[ids])
            if len(at) == len(g):  # else the vocabulary cuts a word further
                sizes.append(np.diff(at, append=len(ids)) if self.space_matters else np.diff(at, prepend=-1))
            else:
                own, ids = self._apart(g)
                sizes.append(own)
            flat.append(ids)
        return np.concatenate(sizes), np.concatenate(flat)

    def _together(self, words: list[str], many: int = 100) -> tuple[np.ndarray, np.ndarray]:
        """The same of single words of any kind, with a mark between them."""
        groups = [words[i : i + many] for i in range(0, len(words), many)]
        sizes, flat = [], []
        for g, e in zip(groups, self.tokenizer.encode_batch_fast([self.between.join(map(self._text, g)) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            marks = ids == self.mark
            cut = np.flatnonzero(marks)
            if len(cut) != len(g) - 1:
                raise ValueError("a word holds the mark between words")
            sizes.append(np.diff(cut, prepend=-1, append=len(ids)) - 1)
            flat.append(ids[~marks])
        return np.concatenate(sizes), np.concatenate(flat)

    def _apart(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces that are encoded one by one."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([self._text(p) for p in pieces], add_special_tokens=False)]
        return np.fromiter(map(len, found), np.int64, len(found)), np.array([i for ids in found for i in ids], np.uint32)

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids rows have, and the ids end to end."""
        sizes = self.sizes[rows]
        return sizes, _taken(self.flat, self.starts[rows], sizes)

    def _learn(self) -> None:
        new, self.places.new = self.places.new, []
        first = self.places.rows - len(new)
        while self.places.rows > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        for a in range(0, len(new), 10_000):
            lettered, words, others = [], [], []
            for i, p in enumerate(new[a : a + 10_000], a):
                (lettered if self.edge is not None and p.isalpha() else words if self.mark is not None and self._one_word(p) else others).append(i)
            for group, ids in ((lettered, self._lettered), (words, self._together), (others, self._apart)):
                if group:
                    self._put(np.array(group) + first, *ids([new[i] for i in group]))

    def encode(self, texts: list[str | None] | pa.Array, at_once: int = 4_000_000) -> Iterator[np.ndarray]:
        """Ids of each text in turn, unsigned 32-bit; a null text has none. About ``at_once`` bytes are worked on at a time."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string())
        for a, b in slices_of(lengths(texts), at_once, 4096):
            if self.places.rows > self.most:
                self._forget()
            yield from self._encode(texts.slice(a, b - a))

    def _encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        pieces = self._pieces(texts)
        bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(pieces), 0).to_numpy())])
        pieces = pieces.flatten().dictionary_encode()
        at = pieces.indices.to_numpy()
        parts = self._parts(pieces.dictionary)
        if self.places.new:
            self._learn()
        sizes, flat = self._gather(parts.ravel())
        sizes = sizes.reshape(-1, 3).sum(1)
        starts = np.cumsum(sizes) - sizes
        own = sizes[at]
        ids = _taken(flat, starts[at], own)
        last = np.concatenate([[0], np.cumsum(own)])[bounds]
        whole = np.zeros(len(texts), bool)
        if self.space_matters:
            doubtful = _of_distinct(pc.utf8_slice_codeunits(pieces.dictionary, -1), lambda c: not c or c.isspace())
            doubts = np.diff(np.concatenate([[0], np.cumsum(doubtful[at])])[bounds])
            whole = pc.fill_null(pc.match_substring(texts, "\0"), False).to_numpy(zero_copy_only=False).copy()
            for i in np.flatnonzero(doubts).tolist():
                whole[i] |= _RUN.search(texts[i].as_py()) is not None
        for i, alone in enumerate(whole.tolist()):
            if alone:
                yield np.asarray(self.tokenizer.encode_batch_fast([texts[i].as_py()], add_special_tokens=False)[0].ids, np.uint32)
            else:
                yield ids[last[i] : last[i + 1]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str, most: int = 1_000_000) -> Encoder:
    """This process's encoder of a vocabulary file; it works on the task's own core only and stays for the worker's next tasks, with ``most`` pieces at most."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path, most)
    _encoders[path].most = most
    return _encoders[path]


def forget(path: str) -> None:
    """Drops this process's encoder of a vocabulary file with its words: the worker goes on to stages that need the memory."""
    _encoders.pop(path, None)
