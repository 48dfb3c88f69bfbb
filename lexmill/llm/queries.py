"""The registered queries of this subpackage: thin digests of the operators over whole tables."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, fim, html, langid, licenses, mix, neardup, periodic, quality, shard, tokenfile, topk, warc
from lexmill.plans.duck import crc
from lexmill.storage import importable, new_path


def vocabulary(name: str) -> str:
    """A public vocabulary file; LEXMILL_VOCABULARIES names another folder than the installed one."""
    folder = os.environ.get("LEXMILL_VOCABULARIES") or os.path.dirname(importlib.util.find_spec("public_tokenizers").origin)
    return os.path.join(folder, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = shard.shard_by_bytes(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = vocabulary("piece_bpe_32k.model")
    model = langid.train(docs.where(~langid.held_out()), pieces)
    said = langid.predict(docs, model, pieces)
    return said.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.try_element_at("slots", F.lit(1)).alias("first_slot"))


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), threshold=85)


def op11_fim_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    both = made.withColumn("back", fim.restored(F.col("output"), F.col("form")))
    return both.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), digest(F.col("output")).alias("output_sha256"), digest(F.col("back")).alias("restored_sha256")
    )


def planted(docs: DataFrame) -> DataFrame:
    """Documents, of which one in ten by its id repeats words of its own from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    # The words are bound once to w, where repeating begins to s.a and how many words repeat to s.p.
    place = "named_struct('a', cast(g % size(w) as int), 'p', cast(1 + (size(w) - g % size(w)) div (3 + g % 8) as int))"
    words = f"transform(array({place}), s -> transform(sequence(0, size(w) - 1), i -> w[if(i < s.a, i, s.a + (i - s.a) % s.p)]))[0]"
    again = F.expr(rf"transform(array(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)), w -> case when size(w) > 0 then array_join({words}, ' ') end)[0]")
    return docs.withColumn("g", F.expr("crc32(cast(doc_id as string)) div 10")).withColumn("text", F.when(h % 10 == 0, again).otherwise(F.col("text")))


def op12_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(planted(table(spark, sf_dir, "documents")))
    greater = lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    rows = found.withColumn("best", F.aggregate("runs", F.try_element_at("runs", F.lit(1)), greater))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def op13_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = new_path(spark, "token-blocks")
    tokenfile.write(docs, path, vocabulary("word_bpe_49k.json"))
    return tokenfile.read(spark, path, docs.schema["doc_id"].dataType.simpleString()).withColumnRenamed("id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_warc_chain,
        op3_html_layout,
        op4_license_templates,
        op5_byte_shards,
        op6_pivot_topk,
        op7_language_id,
        op8_byte_bpe,
        op9_source_mix,
        op10_hyperminhash,
        op11_fim_automaton,
        op12_lyndon_runs,
        op13_token_blocks,
    )
}

#: SQL twins. The others rest on trained models, hashes or automata and are tested against brute force.
ORACLES: dict[str, str] = {
    "op2_warc_chain": """with p as (select page_id, coalesce(html, '') as html from pages), d as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha1(encode(html)) as payload_digest from p),
        m as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as top, payload_bytes >= 1000 and row_number() over (partition by payload_digest, payload_bytes order by page_id desc nulls last) > 1 as again from d)
        select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then top end as refers_to from m""",
    "op5_byte_shards": f"""with s as (select doc_id, (octet_length(encode(coalesce(text, ''))) + 8)::bigint as size, {crc("coalesce(text, '')")} as text_crc32 from documents),
        l as (select *, sum(size) over (order by doc_id nulls first, text_crc32, size rows unbounded preceding) - size as before, sum(size) over () as total from s), c as (select *, least(23, ((2 * before + size) * 24) // (2 * total))::int as shard from l)
        select doc_id, size, text_crc32, 'bytes' as law, shard, (row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1)::bigint as slot, null::int as grown_shard from c""",
    "op6_pivot_topk": """with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        q as (select vec_id, max(v) as v from v where vec_id % 20 = 0 group by vec_id),
        s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from q join v c on c.vec_id <> q.vec_id),
        r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s)
        select query_id, rank, vec_id, score from r where rank <= 20""",
    "op10_hyperminhash": r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
        g as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as s from w),
        u as (select doc_id, len(s) as n, unnest(s) as x from g), c as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as k from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
        e as (select a, b from c where 100 * k >= 85 * (n + m - k)), l as (select a, b from e union all select b, a from e),
        r(id, there) as (select doc_id, doc_id from documents union select r.id, l.b from r join l on r.there = l.a), t as (select id, min(there) as component_id from r group by id)
        select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from g join t on id = doc_id""",
    "op11_fim_automaton": """with t as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
        n as (select *, length(t)::bigint as n, [('0x' || h[8 * i + 1:8 * i + 8])::bigint for i in range(0, 4)] as k from t),
        c as (select *, least(k[1] % (n + 1), k[2] % (n + 1)) as a, greatest(k[1] % (n + 1), k[2] % (n + 1)) as b,
          case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or k[3] % 100 >= 90 then 'plain' when k[4] % 100 < 20 then 'spm' else 'psm' end as form from n),
        p as (select *, substring(t, 1, a) as prefix, substring(t, a + 1, b - a) as middle, substring(t, b + 1) as suffix from c)
        select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
        sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(t) as restored_sha256 from p""",
}
