"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmill.llm import decontaminate, interaction, jaccard, packing, quality, rollup, sharding, spelling, substrings, topk, urlfilter, warc, windows
from linkmill.llm.common import scratch, written
from linkmill.llm.tokens import vocabulary

SHARD_BYTES = 1 << 20
QUALITY_THRESHOLD = 0.7
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.assign_shards(docs, "doc_id", F.octet_length("text"), SHARD_BYTES)


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = topk.sign_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.nearest(codes, codes.where("id % 20 = 0"), 10)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, the second sent twice: all documents under a BPE vocabulary; all of them again
    with the end token counted (revisions) and by white space (inserts); those labelled toxic go."""
    docs = table(spark, sf_dir, "documents")
    bpe = written(rollup.token_counts(docs, vocabulary("byte_bpe_50k.tiktoken"), "byte_bpe_50k"), "token-counts")
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), 1)).cast("long")
    spaces = docs.select("doc_id", "source", "lang", F.lit("white_space").alias("tokenizer_version"), words.alias("n_tokens"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(
        "doc_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"),
        F.explode(F.array(F.lit("byte_bpe_50k"), F.lit("white_space"))).alias("tokenizer_version"),
        F.lit(None).cast("long").alias("n_tokens")
    )
    totals = rollup.Rollup(spark, scratch(spark, "rollup"))
    second = bpe.withColumn("n_tokens", F.col("n_tokens") + 1).unionByName(spaces)
    for batch, changes in ((1, bpe), (2, second), (2, second), (3, toxic)):
        totals.commit(batch, changes.withColumn("seq", F.lit(0)))
    return totals.totals()


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, RULES))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.parsed(warc.records(warc.read_archive(spark, path)))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted")
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_forms(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pack_online(table(spark, sf_dir, "documents"))


OP1_SQL = f"""
with d as (select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as n_bytes,
                  ('0x' || substr(md5(coalesce(cast(doc_id as varchar), chr(0) || 'null')), 1, 15))::bigint as h from documents),
levels as (select *, unnest(range(0, 41))::int as depth from d),
sums as (select depth, h >> (60 - depth) as prefix, sum(n_bytes) as b, count(*) as c from levels group by 1, 2),
fits as (select l.doc_id, min(l.depth) as depth from levels l join sums s on s.depth = l.depth and s.prefix = l.h >> (60 - l.depth)
         where s.b <= {SHARD_BYTES} or s.c = 1 group by 1)
select d.doc_id, d.n_bytes, f.depth, d.h >> (60 - f.depth) as shard, 0::bigint as page from d join fits f using (doc_id)
"""

OP2_SQL = """
with d as (select q.vec_id as query_id, n.vec_id as neighbor_id,
                  list_sum(list_transform(range(1, len(n.embedding) + 1), lambda i: ((q.embedding[i] > 0) <> (n.embedding[i] > 0))::int))::int as distance
           from embeddings q, embeddings n where q.vec_id % 20 = 0 and q.vec_id <> n.vec_id)
select query_id, rank::int as rank, neighbor_id, distance
from (select *, row_number() over (partition by query_id order by distance, neighbor_id) as rank from d) where rank <= 10
"""

OP5_SQL = """
with r as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
rules(rhost, rpath, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m as (select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(v, length(rhost || rpath)) as v
      from p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by 1)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from p left join m using (page_id)
"""

OP7_SQL = """
with p as (select page_id, sha256(coalesce(html, '')) as payload_digest, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to from f
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_topk_search": op2_topk_search,
    "op3_token_counts": op3_token_counts,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_url_filters": op5_url_filters,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_warc": op7_warc,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_filter_audit": op12_filter_audit,
    "op13_packing": op13_packing,
}

OP10_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
s as (select doc_id, i, array_to_string(words[i : i + 34], ' ') as seq from (select *, unnest(range(1, len(words) - 33)) as i from w)),
r as (select doc_id, i from (select *, count(*) over (partition by md5(seq)) as n from s) where n > 1),
g as (select doc_id, list_distinct(flatten(list(range(i, i + 35)))) as gone from r group by 1),
k as (select w.doc_id, words, coalesce(gone, []) as gone from w left join g using (doc_id)),
t as (select doc_id, len(words) as n_words, len(gone) as n_removed, list_filter(words, lambda x, i: not list_contains(gone, i)) as kept from k)
select doc_id, n_words::bigint as n_words, n_removed::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from t
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, array_to_string(words[i : i + least(5, len(words)) - 1], ' ') as s from (select *, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 75 * (x.n + y.n - o)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a),
c as (select a, min(b) as component_id from r group by 1), k as (select a, count(*) as n_links from e group by 1)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, coalesce(n_links, 0)::bigint as n_links
from documents left join n using (doc_id) join c on c.a = doc_id left join k on k.a = doc_id
"""

OP9_SQL = rf"""
with d as (select doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
p as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as s from (select *, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
x as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from p) where len(w) >= n)),
h as (select distinct doc_id, n, i, item_id from x join p using (n, s)),
g as (select doc_id, list_distinct(flatten(list(range(i, i + n)))) as hit, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items, count(distinct item_id) as n_items from h group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(len(hit), 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(len(hit), 0) > 0 and 20 * coalesce(len(hit), 0) >= len(w) as contaminated from d left join g using (doc_id)
"""

OP11_SQL = r"""
with recursive table256 as (select list(c order by i) as t from (select i, list_reduce(list_concat([i], range(0, 8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(0, 256) as r(i))),
r as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents),
d as (select doc_id, run, count(*) as n from r where length(run) >= 5 group by 1, 2),
b as (select run, n, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as x from d),
h as (select run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::bigint)),
                 lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]))) as h from b, table256),
w as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from h),
v as (select word, sum(n)::bigint as n from w where length(word) >= 5 group by 1 having sum(n) >= 3),
k as (select word, n, i, substr(word, 1, i - 1) || chr(1) || substr(word, i + 1) as hole, substr(word, 1, i - 1) || substr(word, i + 1) as less from (select *, unnest(range(1, length(word) + 1)) as i from v)),
p as (select a.word as a, b.word as b, b.n as n from k a join k b on a.hole = b.hole and a.word <> b.word
      union select k.word, v.word, v.n from k join v on k.less = v.word union select v.word, k.word, k.n from k join v on k.less = v.word),
g as (select a as word, count(*) as n_near, max(n) as best from p group by 1),
m as (select a as word, min(b) as near from p join g on p.a = g.word and p.n = g.best group by 1),
f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when best >= 2 * v.n then near end as form, case when best >= 2 * v.n then best end as form_n from v left join g using (word) left join m using (word)),
s as (select word, word as at, form as next from f union all select s.word, f.word, f.form from s join f on s.next = f.word)
select f.word, f.form, s.at as root, f.n, f.n_near::bigint as n_near, f.form_n::bigint as form_n from f join s on s.word = f.word and s.next is null
"""

OP12_SQL = r"""
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from t),
f as (select doc_id, part, len(w) < 50 as a, 100 * len(list_distinct(w)) < 65 * len(w) as b,
             100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d,
             coalesce(doc_id > min(doc_id) over (partition by t), false) as e from w),
g as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
m as (select part, (case when a then 'A' else '' end) || (case when b then 'B' else '' end) || (case when c then 'C' else '' end)
                 || (case when d then 'D' else '' end) || (case when e then 'E' else '' end) as failed,
             count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from f left join g using (doc_id) group by 1, 2),
x(l) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
o as (select p.l || q.l || r.l || s.l || t.l as o from x p, x q, x r, x s, x t
      where len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
k as (select part, o, i, substr(o, i, 1) as l, failed, n, good, toxic, failed = '' or not regexp_matches(failed, '[' || substr(o, 1, i) || ']') as stays,
             i > 1 and regexp_matches(failed, '[' || substr(o, 1, greatest(i - 1, 1)) || ']') as went from m, o, range(1, 6) as s(i)),
y as (select part, o, i, l, sum(n) filter (stays) as kept, sum(n) filter (contains(failed, l) and not went) as removed,
             sum(n) filter (contains(failed, l) and went) as redundant, sum(n) filter (failed = l) as unique_fails,
             sum(good) filter (contains(failed, l) and not went) as good_lost, sum(toxic) filter (contains(failed, l) and not went) as toxic_lost from k group by all)
select part, o as filter_order, i::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
       coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       coalesce(sum(removed) over (partition by part, l), 0)::bigint as shapley from y
"""

SQL: dict[str, str] = {
    "op1_sharding": OP1_SQL,
    "op2_topk_search": OP2_SQL,
    "op4_jaccard_join": OP4_SQL,
    "op5_url_filters": OP5_SQL,
    "op7_warc": OP7_SQL,
    "op9_decontamination": OP9_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
