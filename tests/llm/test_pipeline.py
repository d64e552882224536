import ast
import re
from pathlib import Path

import corpus_pipeline

ROOT = Path(__file__).parents[2]


def test_stages_keep_columns_and_clean_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns, name
    assert 0.7 * before < docs.count() <= before
    assert corpus_pipeline.run(spark, d).where("length > 1024 or offset <> 0").count() == 0


def test_stages_on_odd_rows(spark, docs, texts):
    d = "/root/testdata/sf0.001"
    rows = docs.selectExpr("*", "1 as gone", "2 as to", "3 as lo", "4 as _may", "5 as comp", "6 as id", "7 as spans", "8 as items", "9 as of", "10 as rejected")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, d)
        assert out.count() > 0
        if name != "pack":
            assert out.columns == rows.columns, name
            assert out.where("gone = 1 and `odd.name` = 'z' and rejected = 10").count() == out.count(), name
        assert stage(spark, rows.limit(0), d).count() == 0, name


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "strandlake").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
    for p in [ROOT / "corpus_pipeline.py", *(ROOT / "strandlake/llm").glob("*.py")]:
        assert not any(isinstance(n, ast.ExceptHandler) for n in ast.walk(ast.parse(p.read_text()))), p


def test_run_equals_brute_force(spark, docs, texts, tmp_path):
    """Stage by stage in plain Python; only the language model's verdict is taken as it is."""
    import zlib

    import numpy as np
    from test_neighbours import brute_components
    from test_text_operators import brute_lines, brute_overlap, keyed
    from test_tokens import FILES, plain

    from strandlake.llm import packing

    d = f"file://{tmp_path}"
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    items = [(1, " ".join((texts[3][1] or "").split()[:30])), (2, texts[7][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.language(spark, spark.read.parquet(f"{d}/documents.parquet"), d).collect()]
    assert 0 < len(kept) < len(texts)
    lined = [(i, t) for i, _, _, t in brute_lines(kept)]
    comp = {i: c for null, i, _, c in brute_components(lined, 5) if not null}
    single = [(i, t) for i, t in lined if i is None or comp[i] == i]
    bad = {i for i, _, _, _, contaminated in brute_overlap(single, items) if contaminated}
    clean = [(i, t) for i, t in single if i not in bad]
    assert len(lined) > len(single) > len(clean)
    ids_of, want = plain(FILES[0]), []
    for i, t in clean:
        ids, at = [*ids_of(t), 0], 0
        for n in packing.cuts(len(ids), 1024):
            want.append((i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)))
            at += n
    got = corpus_pipeline.run(spark, d).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    assert keyed(tuple(r) for r in got) == keyed(want)
