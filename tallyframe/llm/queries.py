"""The registered queries of this package and, where plain SQL can say it, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import (
    bpe,
    collocations,
    edit_fingerprint,
    exact_dedup,
    hard_negatives,
    jaccard,
    language_id,
    mixing,
    quality_kn,
    secret_scan,
    sharding,
    toxicity,
    url_filter,
)
from tallyframe.session import cut_lineage

SHARDS = 24
VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))

# Fixed values: the rules of the URL query.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# Fixed values: host labels whose pages make up the list of single URLs.
LISTED_LABELS = ("spam-farm", "adult-x", "casino-win", "free-bets")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def op3_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, d))


OP3_SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as s from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by s) as group_size,
       row_number() over w = 1 as kept, s as text_sha256
from d window w as (partition by s order by n desc, doc_id)
"""


def op4_url_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    rules = url_filter.rule_table(spark, URL_RULES)
    bad = F.exists(F.split(url_filter.host_of(F.col("url")), r"\."), lambda label: label.isin(*LISTED_LABELS))
    return url_filter.judge_urls(pages, rules.unionByName(url_filter.listed_urls(pages.where(bad))))


OP4_SQL = r"""
with p as (
    select page_id,
           coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
    from pages),
r(verdict, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                            ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
b as (select page_id, host, path, h || r.p as rule, verdict, row_number() over (partition by page_id order by length(h || r.p) desc nulls last) as k
      from p left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, r.p)),
l as (select *, regexp_matches(host, '(^|\.)(spam-farm|adult-x|casino-win|free-bets)(\.|$)') as listed from b where k = 1)
select page_id, host, path, rule, coalesce(verdict, case when listed then 'block' else 'allow' end) as verdict, listed from l
"""


def op5_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.balanced_shards(_documents(spark, d), SHARDS)


# CRC-32 is folded byte by byte over its table, which is made from the polynomial.
OP5_SQL = r"""
with k as (select list_transform(range(256), lambda i: list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, j: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as k),
b as (select doc_id, strlen(coalesce(text, '')) + 8 as size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint) as b from documents),
d as (select doc_id, size::bigint as size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, k[(xor(c, x) & 255) + 1])), 4294967295)::bigint as text_crc32 from b, k),
s as (select *, sum(size) over w as upto, row_number() over w as place from d window w as (order by doc_id nulls first, text_crc32, size rows unbounded preceding)),
p as (select *, least(23, (2 * upto - size) * 24 // (2 * (select sum(size) from d)))::int as shard from s)
select doc_id, size, text_crc32, 'bytes' as law, shard, (place - min(place) over (partition by shard))::bigint as slot, null::int as grown_shard from p
"""


def op7_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_counts(_documents(spark, d)).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP7_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents),
s as (select source, sum(size) as source_size, row_number() over (order by source nulls last) as k from d group by source),
w as (select source, source_size, (k - 1) % 3 + 1 as w, source_size * 3 / ((k - 1) % 3 + 1)::double as fill from s),
v as (select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over (order by fill, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
               / sum(w) over (order by fill, source nulls last rows between current row and unbounded following) as level from w),
t as (select source, source_size, least(3.0::double * source_size,
             coalesce((select max(level) from v where level <= fill), (select max(fill) from v)) * w) as target from v),
m as (select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0 end as e,
             row_number() over (partition by d.source order by size, doc_id) as place,
             ('0x' || substr(md5('7:' || coalesce('s' || d.source, '-')), 1, 8))::bigint / 4294967296::double as u
      from d join t on d.source is not distinct from t.source),
c as (select *, least(floor(e * place + u) - floor(e * (place - 1) + u), ceil(e))::bigint as copies from m)
select doc_id, size::bigint as size, source_size::bigint as source_size, target, copies * size::bigint as taken, copies from c
"""

def _labels(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet")


def op1_quality_kn(spark: SparkSession, d: str) -> DataFrame:
    return quality_kn.judge(_documents(spark, d), _labels(spark, d))


def op2_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    found = secret_scan.scan(_documents(spark, d).select("doc_id", "text"))
    kinds = F.array(*[F.lit(k) for k in secret_scan.KINDS])

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    ordered = F.array_sort(F.concat("base", "random"), lambda x, y: F.when(x["start"] != y["start"], F.signum(x["start"] - y["start"]).cast("int"))
                           .otherwise(x["kind"] - y["kind"]))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(ordered).alias("spans"),
    )


OP6_SQL = r"""
with recursive d as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
    from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
             else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from d),
e as (select doc_id, len(s) as n, unnest(s) as x from s),
p as (select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id < b.doc_id
      group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l as (select a, b from p union all select b, a from p),
r as (select doc_id as a, doc_id as b from d union select r.a, l.b from r join l on r.b = l.a)
select s.doc_id, len(s)::bigint as n_shingles, min(r.b) as component_id from s join r on s.doc_id = r.a group by s.doc_id, s
"""


def op6_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.near_components(_documents(spark, d))


def op8_edit_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    probe = cut_lineage(edit_fingerprint.edit_probe(_documents(spark, d)))
    return probe.join(edit_fingerprint.near_components(probe), "fingerprint", "left").select(*probe.columns, "near_id")


def op9_bpe(spark: SparkSession, d: str) -> DataFrame:
    coded = bpe.encode(_documents(spark, d).select("doc_id", "text"), VOCABULARY, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_toxicity(spark: SparkSession, d: str) -> DataFrame:
    scored = toxicity.score(_documents(spark, d), _labels(spark, d))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "clauses")


def op11_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


OP11_SQL = r"""
with e as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as s
      from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select a, b, s from s where same qualify row_number() over (partition by a order by s desc, b) <= 5),
n as (select p.a, p.b as positive_id, s.b as negative_id, p.s as positive_score, s.s as negative_score,
             row_number() over (partition by p.a, p.b order by s.s desc, s.b) as rank
      from p join s on p.a = s.a and not same and 50 * p.s <= 100 * s.s and 100 * s.s <= 95 * p.s)
select a as anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""


def op12_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocations.collocations(_documents(spark, d))


OP12_SQL = r"""
with p as (
    select coalesce(lang, 'und') as lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) as p
    from documents),
w as (select lang, list_filter(string_split_regex(p, '[ 	]+'), lambda x: x <> '') as w from p),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
      from w, (values (1), (2), (3), (4)) v(k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as f from g group by all),
t as (select lang, sum(f) as n from f where k = 1 group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k >= 2 and f >= 30),
x as (select lang, phrase, a, unnest(range(1, k)) as cut, k, w from c),
s as (select x.lang, x.phrase, x.a, cut, l.f as l, r.f as r, (2000000::hugeint * x.a) // (l.f + r.f) as score
      from x join f l on l.lang = x.lang and l.phrase = array_to_string(w[1:cut], ' ')
             join f r on r.lang = x.lang and r.phrase = array_to_string(w[cut + 1:], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
i as (select lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda j: array_to_string(w[j:j + m - 1], ' '))))) as phrase
      from c where k >= 3),
m as (select lang, phrase, max(a) as most from i group by all),
r as (select b.lang, row_number() over (partition by b.lang order by score desc, b.a desc, b.phrase) as rank, b.phrase, b.a, l, r, score
      from b left join m on b.lang = m.lang and b.phrase = m.phrase where most is null or 100 * most < 80 * b.a)
select r.lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from r join t using (lang) where rank <= 2000
"""


def op13_language_id(spark: SparkSession, d: str) -> DataFrame:
    return language_id.identify(_documents(spark, d))


QUERIES = {
    "op1_quality_kn": op1_quality_kn,
    "op2_secret_scan": op2_secret_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_sharding": op5_sharding,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_mixing": op7_mixing,
    "op8_edit_fingerprint": op8_edit_fingerprint,
    "op9_bpe": op9_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_collocations": op12_collocations,
    "op13_language_id": op13_language_id,
}
ORACLES = {"op3_exact_dedup": OP3_SQL, "op4_url_filter": OP4_SQL, "op5_sharding": OP5_SQL, "op6_jaccard_join": OP6_SQL, "op7_mixing": OP7_SQL,
           "op11_hard_negatives": OP11_SQL, "op12_collocations": OP12_SQL}
