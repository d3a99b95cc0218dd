"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


OP4_SQL = """
with p as (
  select page_id, coalesce(html, '') as body from pages
), d as (
  select page_id, octet_length(encode(body))::bigint as payload_bytes, sha256(body) as payload_digest from p
), f as (
  select payload_digest, min(page_id) as least_id from d where payload_bytes >= 100 group by 1
)
select d.page_id, d.payload_bytes, d.payload_digest,
       case when f.least_id <> d.page_id then 'revisit' else 'response' end as record_type,
       case when f.least_id <> d.page_id then f.least_id end as refers_to
from d left join f using (payload_digest)
"""


@register("op4_warc", OP4_SQL)
def op4(spark, sf_dir):
    from .warc import archive, read_archive

    read = read_archive(archive(table(spark, sf_dir, "pages")))
    whole = F.col("record_type") == "response"
    return read.select(
        "page_id",
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type", "refers_to",
    )


#: Fixed by the query's contract.
OP7_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

OP7_SQL = r"""
with u as (
  select page_id, lower(coalesce(url, '')) as low,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
), r(rule, h, p, action) as (
  values ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
         ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), b as (
  select page_id, low, host, path,
         (select max_by(struct_pack(rule := rule, action := action), length(rule)) from r
          where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)) as best
  from u
)
select page_id, host, path, best.rule as rule,
       coalesce(best.action, case when regexp_matches(low,
         '(^|[^a-z0-9])(casino[^a-z0-9]+win|free[^a-z0-9]+bets|cheap[^a-z0-9]+pills|adult|xxx|porn|gambling|payday[^a-z0-9]+loans|wp[^a-z0-9]+login|cgi[^a-z0-9]+bin)([^a-z0-9]|$)')
         then 'block' else 'allow' end) as verdict
from b
"""


@register("op7_urls", OP7_SQL)
def op7(spark, sf_dir):
    from .urls import DEFAULT_RULES, address_rule, judge

    rules = [address_rule(text, action) for text, action in OP7_RULES] + list(DEFAULT_RULES)
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


@register("op8_packing")
def op8(spark, sf_dir):
    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register("op10_mixing")
def op10(spark, sf_dir):
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register("op6_fingerprints")
def op6(spark, sf_dir):
    from .fingerprints import SketchRule, as_text, fingerprints, resemblance

    k = SketchRule().k
    made = fingerprints(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("own_sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("own_sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("own_sketch"), F.col("next_sketch"), k).alias("near_next"),
    )


@register("op1_language")
def op1(spark, sf_dir):
    from .language import identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = id_fold("doc_id", 3) == 1
    model = train(docs.where(~held))
    found = identify(docs.select("doc_id", "text", held.alias("held_out")), model)
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


@register("op9_toxicity")
def op9(spark, sf_dir):
    from .toxicity import assess, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = id_fold("doc_id", 4) == 2
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs.where(~held), labels.where(~held))
    found = assess(docs.select("doc_id", "text", held.alias("held_out")), model)
    return found.select("row.doc_id", "row.held_out", "score", "predicted")


@register("op2_class_lm")
def op2(spark, sf_dir):
    from .lm import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (id_fold("doc_id", 5) == 1).alias("held_out"))
    model, vocabulary = train(docs.where("not held_out"))
    return score(docs, model, vocabulary).drop("perplexity")


@register("op5_embeddings")
def op5(spark, sf_dir):
    from .embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@register("op3_jaccard")
def op3(spark, sf_dir):
    from .jaccard import JaccardRule, join_documents

    rule = JaccardRule(words=4, num=85, den=100)
    return join_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), rule).select("doc_id", "n_shingles", "component_id")


OP11_SQL = r"""
with d as (
  select doc_id, row_number() over () as r,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), i as (
  select distinct item_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
), s as (
  select count(*)::bigint as docs, sum(len(terms))::bigint as terms from d where len(terms) > 0
), t as (
  select r, doc_id, n, term, count(*)::bigint as tf
  from (select r, doc_id, len(terms)::bigint as n, unnest(terms) as term from d)
  where term in (select term from i) group by all
), w as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from t, s group by term
), p as (
  select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // s.terms))))::bigint as score
  from i join t using (term) join w using (term), s group by item_id, r, doc_id
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from p where score > 0 qualify rank <= 50
"""


@register("op11_lexical", OP11_SQL)
def op11(spark, sf_dir):
    from .lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op12_bpe")
def op12(spark, sf_dir):
    from .bpe import decode, encode

    ranks = "byte_bpe_multi_50k.tiktoken"
    back = decode(encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP13_SQL = """
with v as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.r as anchor, a.vec_id as anchor_id, b.r, b.vec_id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.r <> b.r and len(a.q) = len(b.q) where a.vec_id % 100 = 0
), p as (
  select * from s where same qualify row_number() over (partition by anchor order by score desc, vec_id) <= 5
)
select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.anchor, p.r order by s.score desc, s.vec_id)::int as rank,
       s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
from p join s on s.anchor = p.anchor and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score
qualify rank <= 5
"""


@register("op13_negatives", OP13_SQL)
def op13(spark, sf_dir):
    from .negatives import mine

    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")))
