"""The registered queries of the training-data operators and the SQL that restates them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, mixing, near_dedup, ngram_join, order_minhash, piece_lattice, quality_rules, repeats, sharding, surrogates, token_alignment, url_filters, warc_fixity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        sharding.text_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sharding.assign_shards(docs, ["doc_id", "text_crc32", "size"], F.col("size"), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_edits(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, against a replica in which some records rotted and some are lost."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rotten = F.when(F.col("page_id") % 97 == 5, F.concat(html, F.lit("\0"))).otherwise(html)
    digest = lambda body: F.sha2(warc_fixity.warc_record(F.col("url"), body), 256)
    pages = _table(spark, sf_dir, "pages").select(
        "page_id",
        F.octet_length(warc_fixity.warc_record(F.col("url"), html)).cast("long").alias("length"),
        digest(html).alias("digest"),
        digest(rotten).alias("held"),
    )
    placed = warc_fixity.place_records(pages, ["page_id", "digest"], "length")
    replica = placed.filter("page_id % 193 <> 7 or page_id is null").select("archive", "offset", "length", F.col("held").alias("digest"))
    return warc_fixity.audit(placed.select("page_id", "archive", "offset", "length", "digest"), replica)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=400).drop("spans")


#: Where the public vocabularies are; see their README.
TOKENIZERS = "/opt/tokenizers"


def op6_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_lattice.nbest_digests(docs, f"{TOKENIZERS}/piece_bpe_32k.model", n=4)


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = surrogates.replace_entities(_table(spark, sf_dir, "documents").select("doc_id", "text"), key="op7")
    return replaced.select("doc_id", "n_entities", "text")


#: host, path, verdict
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filters.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = quality_rules.text_measures(docs).drop("text")
    judged = quality_rules.judge_measured(measured)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.alignment_digests(docs, f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_order_minhash": op2_order_minhash,
    "op3_warc_fixity": op3_warc_fixity,
    "op4_mixing": op4_mixing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_piece_lattice": op6_piece_lattice,
    "op7_surrogates": op7_surrogates,
    "op8_url_filters": op8_url_filters,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_alignment": op11_token_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_ngram_join": op13_ngram_join,
}

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

ORACLE: dict[str, str] = {
    "op3_warc_fixity": r"""
with r as (select page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
      || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
      || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) rec
    from pages),
d as (select page_id, strlen(rec)::bigint as length, sha256(rec) digest, (row_number() over (order by page_id, sha256(rec)) - 1) // 1000 archive from r)
select page_id, archive, (sum(length) over (partition by archive order by page_id, digest rows unbounded preceding) - length)::bigint as "offset", length, digest,
  case when page_id % 193 = 7 then 'missing' when page_id % 97 = 5 then 'changed' else 'ok' end status
from d""",
    "op4_mixing": f"""
with d as (select doc_id, source, coalesce(text, '') t, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint size,
        length(coalesce(text, '')) chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) symbols,
        string_split_regex(coalesce(text, ''), '\n+') lines
      from documents),
k as (select doc_id, source, size,
        -ln((('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null') || ':' || md5(t)), 1, 12))::bigint::double + 0.5) / 281474976710656.0)
        / case when chars > 0 then greatest((1.0::double - symbols::double / chars) * (len(list_distinct(lines))::double / len(lines)), 0.05::double) else 1.0 end as key
      from d),
s as (select source, sum(size)::bigint source_size from d group by source),
r as (select *, [5.0, 2.0, 1.0][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double w, 2.0::double * source_size cap from s),
l as (select *, (1.5::double * (select sum(source_size) from s)::double
        - coalesce(sum(cap) over (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding), 0))
        / ((select sum(w) from r) - coalesce(sum(w) over (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding), 0)) lev
      from r),
t as (select source, source_size, least(cap, w * (select max(lev) from l)) target from l),
e as (select k.doc_id, k.size, t.source_size, t.target,
        case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end epochs,
        sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows unbounded preceding)::bigint run
      from k join t on k.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (size * (epochs + case when size > 0 and 2 * run - size <= 2 * (target - epochs * source_size) then 1 else 0 end))::bigint taken
from e""",
    "op8_url_filters": r"""
with u as (select page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path
  from pages),
r as (select * from (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(h, p, verdict)),
f as (select u.page_id, u.host, u.path, r.h || r.p rule, r.verdict,
    row_number() over (partition by u.page_id, u.host, u.path order by length(r.h || r.p) desc, length(r.h) desc) n
  from u join r on (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p))
select u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') verdict
from u left join f on u.page_id = f.page_id and u.host = f.host and u.path = f.path and f.n = 1""",
    "op10_quality_rules": f"""
with w as (select doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{_WORD}') ws from documents),
b as (select doc_id, source, t, ws, len(ws)::bigint n_words,
    list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) wins,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) lines
  from w),
x as (select doc_id, hash(t) h, length(t) z, unnest(wins) win, unnest(range(1, len(wins) + 1)) i from b where n_words >= 5),
y as (select doc_id, h, z, i from (select *, count(*) over (partition by doc_id, h, z, win) c from x) where c > 1),
c as (select doc_id, h, z, sum(least(5, coalesce(nxt - i, 5)))::bigint n_repeat_words
      from (select *, lead(i) over (partition by doc_id, h, z order by i) nxt from y) group by all),
m as (select b.doc_id, b.source, b.n_words,
    length(regexp_replace(b.t, '{_SPACE}', '', 'g'))::bigint word_chars,
    (length(b.t) - length(regexp_replace(b.t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines,
    coalesce(c.n_repeat_words, 0)::bigint n_repeat_words
  from b left join c on b.doc_id is not distinct from c.doc_id and hash(b.t) = c.h and length(b.t) = c.z),
j as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from m),
h as (select source, count(*) n, sum(base_failed::int)::bigint f from j group by source),
p as (select sum(f)::double / sum(n) m, greatest(sum(n * (f::double / n) * (f::double / n)) / sum(n) - (sum(f)::double / sum(n)) * (sum(f)::double / sum(n)), 1e-4) v from h),
q as (select m, least(greatest(m * (1 - m) / v - 1, 1.0), 1000.0) k from p),
o as (select source, (f + m * k) / (n + k) <= 0.5 host_ok from h, q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed) and host_ok kept
from j join o on j.source is not distinct from o.source""",
    "op12_hard_negatives": """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256.0::double * x::double)) v
      from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id anchor_id, b.vec_id id, a.label = b.label same, list_inner_product(a.v, b.v)::bigint score
      from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, id) n from s where same) where n <= 5),
n as (select p.anchor_id, p.id positive_id, s.id negative_id, p.score positive_score, s.score negative_score,
        row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) r
      from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, r::int as rank, negative_id, positive_score, negative_score from n where r <= 10""",
}
