"""The registered corpus queries: each operator over its whole table, as contracts want its rows."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagtrail.llm import divergence, lm, mixing, negatives, packing, quality, repeats, secrets, simhash, token_files, token_table, topk, urls
from dagtrail.llm.common import table
from dagtrail.sources.paths import shared_folder

# as the operator: rates of the root of the sizes, a number by hash, the inverse of the distribution
_MIX_SQL = """
with sizes as (
    select source, coalesce(sum(length(text)), 0) as size from documents group by source),
totals as (
    select sum(sqrt(size)) as weights, sum(size) as sizes from sizes where size > 0),
rates as (
    select source, case when size > 0 then (sqrt(size) / weights) / (size / sizes) else 1.0 end as rate
      from sizes cross join totals),
terms as (
    select source, k, case when k = 0 then exp(-rate) else exp(-rate + k * ln(rate) - lgamma(k + 1)) end as p
      from rates cross join range(0, 60) as t(k)),
upto as (
    select source, list(c order by k) as upto
      from (select source, k, sum(p) over (partition by source order by k) as c from terms)
     group by source),
hashed as (
    select d.*, md5(coalesce(md5(doc_id::varchar), '-') || coalesce(md5(text), '-') || coalesce(md5(lang), '-')
                    || coalesce(md5(source), '-') || coalesce(md5(n_chars::varchar), '-')) as hash
      from documents d),
keyed as (
    select * exclude (hash), hash || ':' || row_number() over (partition by hash) as key from hashed),
drawn as (
    select k.*, len(list_filter(upto, lambda c: c < (cast('0x' || substr(md5('42:' || key || ':1'), 1, 13) as bigint) + 0.5)
                                                     / 4503599627370496.0)) as n
      from keyed k join upto u on k.source is not distinct from u.source),
repeated as (
    select * exclude (n), cast(unnest(range(1, n + 1)) as integer) as copy from drawn)
select * exclude (key), cast('0x' || substr(md5('42:' || key || ':' || copy), 1, 15) as bigint) as place
  from repeated
"""

# candidates are numbered, so that rows of one id are told apart
_TOP_K_SQL = """
with usable as (
    select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * x::double) as bigint)) as v
      from embeddings
     where vec_id is not null and embedding is not null
       and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (
    select q.r, q.vec_id as query_id, c.vec_id,
           cast(list_inner_product(q.v::double[], c.v::double[]) as bigint) as score
      from usable q join usable c on q.r <> c.r
     where q.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by r order by score desc, vec_id) as integer) as rank, vec_id, score
  from scored
qualify rank <= 20
"""

# shares are in 128 bits; every kept term is met with every group of its language
_DIVERGENCE_SQL = """
with docs as (
    select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as found
      from documents),
tokens as (
    select r, lang, source, unnest(found) as term from docs),
kept as (
    select lang, term, count(*)::hugeint as n from tokens group by all having count(distinct r) >= 3),
langs as (
    select lang, coalesce(sum(n), 0)::hugeint as total, count(n)::hugeint as terms
      from (select distinct lang from docs) left join kept using (lang) group by all),
counts as (
    select lang, source, term, count(*)::hugeint as n from tokens semi join kept using (lang, term) group by all),
sizes as (
    select lang, source, coalesce(sum(n), 0)::hugeint as total
      from (select distinct lang, source from docs) left join counts using (lang, source) group by all),
shares as (
    select s.lang, s.source, k.term, coalesce(c.n, 0) as n,
           1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (s.total + l.terms) as p,
           1 + (1000000000::hugeint * (k.n + 1)) // (l.total + l.terms) as of_lang
      from sizes s join langs l using (lang) join kept k using (lang)
      left join counts c on c.lang = s.lang and c.source = s.source and c.term = k.term),
sums as (
    select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
      from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
      from sizes a join sizes b on a.lang = b.lang and a.source <> b.source
      left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
above as (
    select lang, source, 'term' as part, term as item, (((p - of_lang) * (p - of_lang)) // of_lang)::bigint as value
      from shares where n > 0 and p > of_lang),
ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank
      from (select * from pairs union all select * from above))
select * from ranked where part = 'pair' or rank <= 200
"""

# rows are numbered, so that those of one id are told apart
_NEGATIVES_SQL = """
with usable as (
    select row_number() over () as r, vec_id,
           (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
           list_transform(embedding, lambda x: floor(256 * x::double)) as v
      from embeddings
     where vec_id is not null and label is not null and embedding is not null
       and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (
    select a.r, a.vec_id as anchor_id, c.r as other, c.vec_id, a.label = c.label as same,
           cast(list_inner_product(a.v, c.v) as bigint) as score
      from usable a join usable c on a.r <> c.r
     where a.vec_id % 50 = 0),
positives as (
    select r, anchor_id, vec_id as positive_id, score as positive_score,
           row_number() over (partition by r order by score desc, vec_id) as nth
      from scored where same
    qualify nth <= 5)
select p.anchor_id, positive_id,
       cast(row_number() over (partition by p.r, nth order by score desc, vec_id) as integer) as rank,
       vec_id as negative_id, positive_score, score as negative_score
  from positives p join scored s on p.r = s.r
 where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""

Query = Callable[[SparkSession, str], DataFrame]

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _token_table(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "tokens")
    token_table.write_token_table(table(spark, folder, "documents"), path, WORD_BPE, end_id=1)
    return token_table.token_digests(token_table.read_token_table(spark, path))


def _token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), path, WORD_BPE)
    counts = token_files.token_counts(spark, path)
    # what follows in a name is drawn for each run
    return counts.withColumn("file", F.regexp_extract("file", "part-[0-9]+", 0))


def _pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), WORD_BPE, end_id=0, capacity=2048)


def _mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def _score(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return lm.score_documents(table(spark, folder, "documents"), F.coalesce(held_out, F.lit(False)))


def _urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), urls.train(urls.labelled_urls(spark)))


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"), PIECE_BPE)


def _secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "documents"))


def _simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


def _top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, folder, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


def _divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(table(spark, folder, "documents"))


def _repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents"))


def _negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.integer_rows(table(spark, folder, "embeddings"), label)
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": _token_counts,
        "op2_best_fit_packing": _pack,
        "op3_mixing": _mix,
        "op4_lm_scoring": _score,
        "op5_quality": _quality,
        "op6_urls": _urls,
        "op7_simhash": _simhash,
        "op8_token_table": _token_table,
        "op9_secrets": _secrets,
        "op10_top_k": _top_k,
        "op11_divergence": _divergence,
        "op12_repeats": _repeats,
        "op13_hard_negatives": _negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": _MIX_SQL, "op10_top_k": _TOP_K_SQL, "op11_divergence": _DIVERGENCE_SQL, "op13_hard_negatives": _NEGATIVES_SQL}
