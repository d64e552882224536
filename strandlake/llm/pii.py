"""Operator 10, personal data by anchor expansion.

One Aho-Corasick pass over a text with ASCII letters in lower case finds anchors: at-signs, schemes, plus signs before digits, dots and separators between digits, runs of twelve digits,
words that announce an identifier, and digits behind two capital letters, where an IBAN can begin. From each anchor a local parser expands to both sides and validates what it has found. Every parser looks no further than its
own run of characters, and a kind goes on after its last match, so the spans are those of a leftmost, non-overlapping search.

Kinds: email, ip, card (Luhn), phone, and beyond these account (an IBAN with right check digits, or the number after an identifier cue) and login (the user part of an
address with a scheme, ``scheme://user:password@host``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, spread

#: Fixed order of the kinds: base kinds first.
KINDS = ["email", "ip", "card", "phone", "account", "login"]
BASE = KINDS[:4]
#: Fixed identifier cues, lower case; an account number may follow.
CUES = ["account", "acct", "iban", "passport", "ssn", "social security", "tax id", "konto", "compte", "cuenta"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
_AFTER_CUE = re.compile(r"(?: (?:number|no|nr|id))?\.?[ \t]{0,2}[:#=]?[ \t]{0,2}([A-Za-z]{0,3}[0-9](?:[ -]?[0-9]){5,33})(?![A-Za-z0-9])", re.IGNORECASE)
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+(?=@[A-Za-z0-9.-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in [("@", "email"), ("://", "login"), ("+", "phone"), *[(c, "account") for c in CUES]]:
        found.add_word(word, (kind, len(word)))
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    found.make_automaton()
    return found


def _iban_end(text: str, start: int, within: bool = False) -> int:
    """The end of the longest IBAN with right check digits that begins at ``start`` and doesn't end within a word, unless it may; 0 if there is none."""
    if not (m := _IBAN.match(text, start)):
        return 0
    code = m[0]
    while len(code) >= 15:
        after = text[start + len(code) : start + len(code) + 1]
        if code[-1] != " " and (within or not (after.isascii() and after.isalnum())) and iban_valid(code):
            return start + len(code)
        code = code[:-1]
    return 0


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal data in a text, by start and kind; code points, end exclusive."""
    out: list[tuple[int, int, str]] = []
    done = dict.fromkeys(KINDS, 0)  # a kind's search has come so far
    for at, (kind, width) in _automaton().iter(text.translate(_LOWER)):
        if kind == "digit":
            if at and text[at - 1] in _DIGITS:
                continue  # inside a run of digits: what fails from its first fails from here
            if at - 2 >= done["account"] and text[at - 1 : at] in _CAPITALS and text[at - 2 : at - 1] in _CAPITALS and not (at > 2 and text[at - 3].isalnum()) and (end := _iban_end(text, at - 2)):
                done["account"] = end
                out.append((at - 2, end, "account"))
            if at >= done["ip"] and (m := _IP.match(text, at)):
                done["ip"] = m.end()
                if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m.groups()):
                    out.append((at, m.end(), "ip"))
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, m.end(), "card"))
        elif kind == "email":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _HOST.match(text, at + 1)):
                done["email"] = m.end()
                out.append((start, m.end(), "email"))
        elif kind == "phone":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    out.append((at, m.end(), "phone"))
        elif kind == "login":
            if at + 1 >= done["login"] and (m := _LOGIN.match(text, at + 1)):
                done["login"] = m.end()
                out.append((m.start(), m.end(), "login"))
        elif at >= done["account"] and not text[at + 1 : at + 2].isalpha() and not text[max(0, at - width) : at - width + 1].isalpha():
            if m := _AFTER_CUE.match(text, at + 1):
                done["account"] = max(m.end(1), _iban_end(text, m.start(1)))
                out.append((m.start(1), done["account"], "account"))
            elif (m := _IBAN.search(text, at + 1, at + 48)) and (end := _iban_end(text, m.start()) or _iban_end(text, m.start(), True)):
                done["account"] = end
                out.append((m.start(), end, "account"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the four base kinds' spans) and spans (all, ``kind:start:end`` joined by commas) of each row.

    A null or empty text has no span: counts 0, an empty string of spans and its hash. A null id stays null, repeated rows give repeated results and an empty table none.
    The time is linear in a text's length: each parser stops at the end of its own run.
    """
    kinds = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for text in batch.column(1):
                found = spans(text.as_py() or "") if text.is_valid else []
                base = [s for s in found if s[2] in BASE]
                say = lambda some: ",".join(f"{k}:{a}:{b}" for a, b, k in some)
                for column, v in zip(columns, [*[sum(s[2] == k for s in base) for k in BASE], hashlib.sha256(say(base).encode()).hexdigest(), say(found)], strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]], names=[f.split()[0] for f in kinds.split(", ")])

    return spread(only(docs, doc_id=id_col, text=text_col)).mapInArrow(find, kinds)
