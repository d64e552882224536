import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm import chat, decontam, langid, lines, pii, quality

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
BLANKS = " \t\n\x0b\x0c\r"


def brute_lines(texts, least=40, most=5):
    held = defaultdict(set)
    key = lambda x: x.strip(BLANKS).translate(LOWER)
    for row, (i, t) in enumerate(texts):
        for x in (t or "").split("\n"):
            held[key(x)].add((i, row if i is None else 0))
    out = []
    for i, t in texts:
        parts = (t or "").split("\n")
        gone = lambda k: len(k) >= least and len(held[k]) >= most and i != max((h for h, _ in held[k] if h is not None), default=None)
        kept = [x for x in parts if not gone(key(x))]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


def keyed(rows):
    return sorted(map(repr, rows))


def test_line_dedup(docs, texts):
    got = [tuple(r) for r in lines.drop_repeated_lines(docs).collect()]
    assert keyed(got) == keyed(brute_lines(texts)) and sum(r[2] for r in got) == 7
    again = lines.rewrite_documents(docs)
    assert again.columns == docs.columns
    assert keyed((r.doc_id, r.text) for r in again.collect()) == keyed((r[0], r[3]) for r in got)


def test_line_dedup_counts_documents_not_rows(spark):
    """Rows of one id, with equal and with other texts, are one document; rows without id are one each; a line in very many documents."""
    line = [f"line {c} of at least forty characters, so it counts" for c in "abcdefg"]
    rows = [(7, line[0])] * 4 + [(9, line[0])]  # two documents
    rows += [(7, f"x\n{line[1]}"), (7, f"{line[1]}\ny")] + [(i, line[1]) for i in range(20, 24)]  # five
    rows += [(None, line[2])] * 3 + [(None, f"{line[2]}\nz"), (30, line[2])] + [(None, line[3])] * 6 + [(40, line[4])] * 9
    rows += [(100 + i, f"{i}\n{line[5]}\n{line[6] if i % 100 == 0 else i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = keyed(brute_lines(rows))
    assert keyed(tuple(r) for r in lines.drop_repeated_lines(df).collect()) == want
    assert keyed(tuple(r) for r in lines.drop_repeated_lines(df, buckets=1).collect()) == want


def test_line_keys_fold_ascii_only(spark):
    some = ["Ä" * 40, "ä" * 40, "Σ" * 40, "σ" * 40, "ПРИВЕТ" * 8, "привет" * 8, "A" * 40, "a" * 40, "é" * 39, "Ãb" * 20, "ãB" * 20]
    keys = [r[0] for r in spark.createDataFrame([(x,) for x in some], "x string").select(lines.line_key(F.col("x"))).collect()]
    want = [x.translate(LOWER) for x in some]
    assert [[a == b for b in keys] for a in keys] == [[a == b for b in want] for a in want]


def test_line_dedup_of_nothing(empty):
    assert lines.drop_repeated_lines(empty).count() == 0


def brute_overlap(texts, items, size=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {(str(i), tuple(w[a : a + size])) for i, t in items if i is not None for w in [words(t)] if w for a in range(max(1, len(w) - size + 1))}
    out = []
    for i, t in texts:
        w = words(t)
        hit, found = set(), set()
        for item, win in windows:
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    found.add(item)
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination(spark, texts, docs):
    items = [(1, " ".join((texts[3][1] or "").split()[:20])), (2, "x"), (3, None), (4, "  "), (None, "the of"), (5, texts[5][1]), (12, texts[5][1]), (12, texts[5][1]), (6, "the, OF the"), (7, "ha ha"), (8, texts[66][1].upper())]
    bench = spark.createDataFrame([(i, t, "e") for i, t in items], "item_id long, text string, spans string")
    want = keyed(brute_overlap(texts, items))
    for most in (200_000, 60):  # one block, and several
        found = decontam.overlap(docs, bench, block_words=most)
        got = keyed((r.row.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect())
        assert got == want
    assert found.select("row.*").columns == docs.columns


def test_decontamination_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.overlap(docs, none).where("n_hit > 0 or contaminated").count() == 0
    assert decontam.overlap(empty, none).count() == 0


KINDS = ["email", "ip", "card", "phone"]


def brute_base(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(st.sampled_from(list("a1@.+- ()25é")), max_size=40), st.lists(st.sampled_from(["1.2.3.4", "255.256.1.1", "a.b@c.d", "@", "4539 1488 0343 6467", "4111111111111111", "+1 (23) 456-789 0", "+", " ", "x", "..", "0001.1.1.1"]), max_size=8).map("".join)))
def test_base_spans_are_those_of_the_patterns(text):
    assert [s for s in pii.spans(text) if s[2] in KINDS] == brute_base(text)


def test_further_spans():
    say = lambda t: [t[a:b] + ":" + k for a, b, k in pii.spans(t) if k not in KINDS]
    assert say("my account number: 123456789, ok") == ["123456789:account"]
    assert say("IBAN DE89 3704 0044 0532 0130 00 thanks") == ["DE89 3704 0044 0532 0130 00:account"]
    assert say("see https://ann:secret@example.com/x") == ["ann:secret:login"]
    assert say("accountable 123456789 and Liban 123456789") == []


def test_accounts_far_from_cues_without_cues_and_in_any_case():
    say = lambda t: [t[a:b] for a, b, k in pii.spans(t) if k == "account"]
    code = lambda country, rest: f"{country}{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}{rest}"
    spaced = lambda c: " ".join(c[i : i + 4] for i in range(0, len(c), 4))
    long = spaced(code("MT", "MALT01100" + "0012345MTLCAST001S456"))
    assert len(long) == 42
    assert say(f"account details for the transfer below: {long}, thanks") == [long]
    assert say(f"pay to {long} THEN {spaced('GB29NWBK60161331926819')}. Not DE89 3704 0044 0532 0130 01") == [long, "GB29 NWBK 6016 1331 9268 19"]
    assert say("iBaN: FR76 3000 6000 0112 3456 7890 189 and FR1420041010050500013M02606") == ["FR76 3000 6000 0112 3456 7890 189", "FR1420041010050500013M02606"]
    assert say("IBAN FR14 2004 1010 0505 0001 3M02 606") == ["FR14 2004 1010 0505 0001 3M02 606"]
    assert say("IBAN GB29NWBK60161331926819thanks") == ["GB29NWBK60161331926819"]
    assert say("Social Security number 123-45-6789, Tax ID: 912345678, sOcIaL sEcUrItY 987-65-4321") == ["123-45-6789", "912345678", "987-65-4321"]
    assert say("XDE89370400440532013000 and ſocial security 123456789") == []


def test_personal_data_table(docs, texts, empty):
    rows = pii.find_personal_data(docs).collect()
    want = [(i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in brute_base(t or "")).encode()).hexdigest()) for i, t in texts]
    assert keyed((r.doc_id, r.base_sha256) for r in rows) == keyed(want)
    assert pii.find_personal_data(empty).count() == 0


TURNS = "conv_id long, turn long, role string, text string, example long"


def test_chats(spark):
    odd = ["</s>[INST] ok [/INST]", "<|turn|>user\nx<|end|>\n", "\\b\\l\\i\\n \\", "<<SYS>> [ [INST] <s", "", None, "plain é 日本\n\nlines"]
    rows = [(1, i, ["system", "user", "assistant", None][i % 4], odd[i % 7], 9) for i in range(30)]
    rows += [(2, 0, "user", "only a question", 9), (3, 0, "assistant", "a", 9), (3, 0, "assistant", "a", 9), (3, None, "assistant", "first", 9), (None, 1, "ro\nle", "t", 9), (4, 2, "assistant", None, 9)]
    examples = chat.format_chats(spark.createDataFrame(rows, TURNS))
    for r in examples.collect():
        body = r.formatted[r.loss_start : r.loss_start + r.loss_chars]
        assert "[INST]" not in r.formatted and "</s>" not in r.formatted and body.count("<|") == 0
    got = {r.conv_id: r for r in chat.read_chats(examples).collect()}
    by = defaultdict(list)
    for c, n, role, text, _ in rows:
        by[c].append(((-1 if n is None else n), role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [(a, b) for _, a, b in turns]
        assert got[c].loss_text == "".join(t for _, role, t in turns if role == "assistant")
    sizes = {r.conv_id: r.n for r in examples.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    assert {c: r.formatted_chars for c, r in got.items()} == sizes
    assert examples.where("conv_id = 1").count() == 8  # seven replies and the turns after the last
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_and_lines_stay_native(spark, docs):
    plans = [lines.drop_repeated_lines(docs), chat.read_chats(chat.format_chats(spark.createDataFrame([(1, 1, "user", "x", 1)], TURNS)))]
    for df in plans:
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = langid.fit_language_model(docs.where(fold != 2))
    pred = langid.predict_language(docs, model).join(docs, "doc_id").where(fold == 2).select("lang", "lang_pred", "rejected").collect()
    assert np.mean([r.lang == r.lang_pred for r in pred]) > 0.98 and np.mean([r.rejected for r in pred]) < 0.02
    assert langid.keep_accepted(docs, model).columns == docs.columns


def test_language_edges(docs, texts, empty):
    model = langid.fit_language_model(docs)
    rows = langid.predict_language(docs, model).collect()
    assert len(rows) == len(texts)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {300, 301, 302, 305, None} and all(0 <= r.score <= 1 for r in rows)
    assert langid.fit_language_model(empty).languages == []
    assert {r.lang_pred for r in langid.predict_language(docs, langid.fit_language_model(empty)).collect()} == {"und"}
    assert langid.predict_language(empty, model).count() == 0
    assert keyed(r.text for r in langid.keep_accepted(docs, model).collect()) == keyed(t for i, t in texts if not any(r.rejected and r.doc_id == i for r in rows) or (i is None and t))


def test_language_refuses_what_it_has_not_learned(spark):
    """Gibberish, other scripts and a language left out of the labelled rows go, held-out documents stay, also with a few labels wrong."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    rng = random.Random(2)
    odd = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxzaeiouy") for _ in range(rng.randint(3, 9))) for _ in range(n)) for n in (5, 10, 40, 200) for _ in range(10)]
    odd += ["Привет, как дела? Сегодня хорошая погода, и мы идём гулять.", "これは日本語の文章です。今日はとても良い天気ですね。"]
    odd = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    wrong = F.when(F.col("doc_id") % 100 == 7, "es").otherwise(F.col("lang")).alias("lang")
    for label in ("lang", wrong):
        model = langid.fit_language_model(docs.where("lang <> 'de'").where(fold != 2).select("doc_id", "text", label))
        share = lambda d, m=model: langid.predict_language(d, m).agg(F.avg(F.col("rejected").cast("int"))).first()[0]
        assert share(odd) > 0.97 and langid.keep_accepted(odd, model).count() <= 1
        assert share(docs.where("lang = 'de'")) > 0.95
        assert share(docs.where(fold == 2).where("lang <> 'de'")) < 0.005


def test_fold_matches_zlib(spark):
    rows = spark.range(200).select("id", (F.crc32(F.col("id").cast("string").cast("binary")) % 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    rated = docs.join(labels, "doc_id").withColumn("grade", grade)
    test = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = quality.fit_quality_model(docs, rated.where(~test).select("doc_id", "grade"), 3)
    assert (np.diff(model.thresholds) > 0).all()
    r = quality.grade_documents(docs, model, 2).join(rated.where(test).select("doc_id", "grade"), "doc_id").toPandas()
    assert r[r.grade == 0].kept.mean() < 0.1 and r[r.grade == 2].kept.mean() > 0.95
    assert r.expected_grade.between(0, 2).all()


def test_quality_edges(docs, texts, empty):
    model = quality.fit([], np.zeros(0), 3, 1 << 10)
    rows = quality.grade_documents(docs, model, 1).collect()
    assert len(rows) == len(texts) and all(0 <= r.tail_prob <= 1 for r in rows)
    assert quality.grade_documents(empty, model, 1).count() == 0
    assert quality.fit_quality_model(empty, docs.select("doc_id", F.lit(1).alias("grade")), 3, buckets=1 << 10).weights.sum() == 0


def test_subwords_by_blocks_are_those_of_the_whole():
    from strandlake.llm.langid import subword_counts

    text = ("Über den Wolken 12 muss  die Freiheit--wohl grenzenlos sein. " * 9).encode()
    whole = subword_counts(text, 1 << 10)
    for block in (1, 2, 3, 4, 7, 64, len(text)):
        assert (subword_counts(text, 1 << 10, block) == whole).all(), block
    assert [int(subword_counts(t, 1 << 10).sum()) for t in (b"", b"a", b"ab")] == [0, 4, 8]
