"""The registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampwise.llm import ann, bpe, decontam, fim, hardneg, langid, licenses, linededup, lm, minhash, quality, simhash, warc
from rampwise.llm.common import held_out, table


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    got = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return got.select("doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), usable=~held_out("doc_id", 5))
    got = docs.select("doc_id", held_out("doc_id", 5).alias("held_out"), quality.quality(model, docs).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~held_out("doc_id", 5)))
    got = langid.predict(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held_out("doc_id", 5).alias("held_out"), "language.lang_pred", "language.score", "language.accepted")


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = decontam.find(docs, table(spark, sf_dir, "benchmark"), matches=False)
    return got.select("doc_id", "found.n_words", "found.n_hit", F.size("found.item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("found.item_ids", ","), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), folds=10)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = licenses.scan(docs, licenses.fit(docs))
    families = F.array_join(F.array_sort(F.array_distinct("licenses.found.family")), ",")
    return got.select("doc_id", "licenses.n_paragraphs", F.size("licenses.found").cast("long").alias("n_found"), "licenses.n_unconfirmed", families.alias("families"), F.array_join(F.transform("licenses.found.line", lambda x: x.cast("string")), ",").alias("lines"))


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "text", "line_dedup.n_lines", "line_dedup.n_removed", "line_dedup.emptied")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(fim.restored("output", "form").cast("binary"), 256).alias("restored_sha256"))


def op12_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict:
    return {"op1_warc": op1_warc, "op2_quality": op2_quality, "op3_minhash": op3_minhash, "op4_langid": op4_langid, "op5_decontam": op5_decontam, "op6_ann": op6_ann, "op7_lm": op7_lm, "op8_licenses": op8_licenses, "op9_bpe": op9_bpe, "op10_linededup": op10_linededup, "op11_fim": op11_fim, "op12_hardneg": op12_hardneg, "op13_simhash": op13_simhash}


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as n, sha1(html) as h from p),
g as (select h, n, max(page_id) as first from d where n >= 1000 group by h, n)
select d.page_id, cast(d.n as bigint) as payload_bytes, d.h as payload_digest,
  case when g.first <> d.page_id then 'revisit' else 'response' end as record_type,
  case when g.first <> d.page_id then g.first end as refers_to
from d left join g on d.h = g.h and d.n = g.n
"""


OP11_SQL = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as x from documents),
h as (select doc_id, t, length(t) as n, cast('0x' || x[1:8] as bigint) as h1, cast('0x' || x[9:16] as bigint) as h2, cast('0x' || x[17:24] as bigint) as h3, cast('0x' || x[25:32] as bigint) as h4 from d),
c as (select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
s as (select *, substring(t, 1, a) as p, substring(t, a + 1, b - a) as m, substring(t, b + 1, n - b) as s from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(a as bigint) end as prefix_chars, case when form <> 'plain' then cast(b - a as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from s
"""

OP12_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * cast(x as double)) for x in embedding] as e
  from embeddings where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
a as (select * from v where vec_id % 100 = 0),
s as (select a.vec_id as anchor_id, v.vec_id as id, a.label = v.label as same, cast(list_inner_product(a.e, v.e) as bigint) as score from a, v where a.vec_id <> v.vec_id),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, id) as nth from s where same) where nth <= 5),
n as (select p.anchor_id, p.id as positive_id, p.score as positive_score, s.id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op11_fim": OP11_SQL, "op12_hardneg": OP12_SQL}
