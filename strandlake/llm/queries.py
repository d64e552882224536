"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, langid, lines, near_dup, packing, pii, quality, token_files
from .common import table, work_path, written


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), with_tokens=False)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlap(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: Grades made of the two labels: 0 toxic, 1 poor, 2 good.
GRADES = 3


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))
    model = quality.fit_quality_model(docs, labels, GRADES)
    return quality.grade_documents(docs, model, select_from=2)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, _vocabulary("word_bpe_49k.json"))
    return token_files.read_token_files(spark, path)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    own = spark.sql(f"select -1L as conv_id, turn, role, '{text}' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = chat.read_chats(written(chat.format_chats(turns), "chats"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = langid.fit_language_model(docs.where(fold != 2))
    return langid.predict_language(docs, model).select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_decontamination, op3_quality, op4_line_dedup, op5_nearest, op6_near_duplicates, op7_token_files, op8_chat, op9_language, op10_personal_data)}


_OP2_SQL = r"""
with words as (
  select doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' ') as w from documents
), d as (select doc_id, case when len(w) = 1 and w[1] = '' then []::varchar[] else w end as w from words
), bench as (
  select item_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' ') as w from benchmark
), b as (select item_id, w, least(len(w), 13) as size from bench where not (len(w) = 1 and w[1] = '')
), windows as (select item_id, size, array_to_string(w[i : i + size - 1], ' ') as win from (select item_id, w, size, unnest(range(1, len(w) - size + 2)) as i from b)
), sizes as (select distinct size from windows
), places as (select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') as win from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, sizes where len(w) >= size)
), hits as (select p.doc_id, p.i, p.size, x.item_id from places p join windows x on p.size = x.size and p.win = x.win
), covered as (select doc_id, count(distinct word_at) as n_hit from (select doc_id, unnest(range(i, i + size)) as word_at from (select distinct doc_id, i, size from hits)) group by doc_id
), items as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""

#: DuckDB has no set of characters for trim but a string of them, and its own escapes: chr() gives the same ones.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINE_DEDUP_SQL = f"""
with split as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from DOCS
), keyed as (select *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from split
), often as (select k, max(doc_id) as keeper from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5
), marked as (select keyed.*, keeper is not null and keeper <> doc_id as gone from keyed left join often using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text from marked group by doc_id
"""
_OP4_SQL = f"select doc_id, n_lines, n_dropped, sha256(text) as kept_sha256 from ({LINE_DEDUP_SQL.replace('DOCS', 'documents')})"

_OP6_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), sets as (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) = 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w
), shingles as (select doc_id, unnest(s) as x, len(s) as n from sets
), common as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as shared from shingles a join shingles b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by a.doc_id, b.doc_id
), links as (select a, b from common where 100 * shared >= 80 * (na + nb - shared)
), sym as (select a, b from links union all select b, a from links
), reach as (select doc_id as a, doc_id as b from documents union select r.a, s.b from reach r join sym s on r.b = s.a
), comp as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from sets join comp using (doc_id)
"""

def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": _OP2_SQL, "op4_line_dedup": _OP4_SQL, "op6_near_duplicates": _OP6_SQL}
