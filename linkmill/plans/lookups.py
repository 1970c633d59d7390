"""Registered queries over stored tables: text indexes, ledgers, snapshots, and the similarity of a member's texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkmill.operators import ledger, merge, ranks, similar_texts, snapshots, text_index
from linkmill.plans.catalog import QUERIES, SQL, query, shared, t  # noqa: F401

c = F.col

SEARCHES = ["LICENSE", "the tion", "!!", "é", "http", "no text has this"]


@query(
    "with q as (select unnest([" + ", ".join(f"'{x}'" for x in SEARCHES) + "]) as query) "
    "select query, doc_id from q join documents on contains(lower(text), lower(query))"
)
def indexed_search(spark, sf_dir):
    """Documents that hold each of some texts, by the trigram index; the shortest are found by a scan."""
    path = shared(spark)
    text_index.write_index(t(spark, sf_dir, "documents"), "doc_id", "text", path)
    found = [text_index.search(spark, path, q).select(F.lit(q).alias("query"), c("key").alias("doc_id")) for q in SEARCHES]
    return reduce(DataFrame.unionByName, found)


@query("""
select l_orderkey, l_linenumber, l_partkey from lineitem join part on l_partkey = p_partkey
where contains(lower(p_name), 'red w') or contains(lower(p_type), 'red w')
""")
def works_of_search(spark, sf_dir):
    """Line items of the parts that a search finds."""
    path, p = shared(spark), t(spark, sf_dir, "part")
    text_index.write_index(p.withColumn("both", F.concat_ws("\n", "p_name", "p_type")), "p_partkey", "both", path)
    hits = text_index.search(spark, path, "Red W").select(c("key").alias("l_partkey"))
    return t(spark, sf_dir, "lineitem").join(hits, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query(r"""
with b as (select item_id, text, ('0x' || substr(md5(item_id::varchar), 1, 4))::int as k from benchmark),
p as (select item_id, 'src' || (k + j) % 20 as source, text from b, range(0, 3) as r(j)),
s as (select * from (select source, text, row_number() over (partition by source order by n_chars desc, doc_id) as i from documents
      where trim(coalesce(text, '')) <> '') where i <= 5),
x as (select item_id || '/' || source as pair, 0 as i, text from p union all select p.item_id || '/' || source, i, s.text from p join s using (source)),
n as (select pair, count(*) as n_texts from x where trim(coalesce(text, '')) <> '' group by 1 having count(*) > 1 and min(i) = 0),
w as (select pair, i, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') as w from x),
e as (select pair, i, unnest(list_concat(w, list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1]))) as term from w),
f as (select pair, i, term, count(*) as tf from e group by all),
d as (select pair, term, sum(tf) as total, count(*) as df from f group by all),
d8 as (select * from (select *, row_number() over (partition by pair order by total desc, term) as nth from d) where nth <= 8000),
v as (select pair, i, term, (1 + ln(tf)) * (1 + ln((1 + n_texts) / (1 + df))) as x from f join d8 using (pair, term) join n using (pair)),
l as (select pair, i, sqrt(sum(x * x)) as l from v group by all),
z as (select a.pair, a.i, sum(a.x * o.x) as dot from v a join v o on a.pair = o.pair and a.term = o.term and o.i = 0 where a.i > 0 group by all),
m as (select z.pair, max(dot / (la.l * lo.l)) as similarity from z join l la on la.pair = z.pair and la.i = z.i join l lo on lo.pair = z.pair and lo.i = 0 group by 1)
select pair, n_texts, coalesce(similarity, 0) as similarity, case when similarity >= 0.35 then 15 when similarity >= 0.20 then 8 else 0 end as points
from n left join m using (pair)
""", ("similarity",))
def member_similarity(spark, sf_dir):
    """Benchmark items as members' texts, each with three sources as candidates, whose five longest documents are the snippets."""
    start = F.conv(F.substring(F.md5(c("item_id").cast("string")), 1, 4), 16, 10).cast("int")
    three = F.explode(F.array(*(F.concat(F.lit("src"), (start + j) % 20) for j in range(3))))
    own = t(spark, sf_dir, "benchmark").select("item_id", "text", three.alias("source"))
    own = own.withColumn("pair", F.concat_ws("/", "item_id", "source"))
    docs = t(spark, sf_dir, "documents").where("trim(text) != ''").select("source", "doc_id", "text", "n_chars")
    longest = ranks.top_per_group(docs.drop("text"), ["source"], [F.desc("n_chars"), "doc_id"], 5)
    nth = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    snippets = longest.withColumn("i", nth).select("doc_id", "source", "i").join(docs.select("doc_id", "text"), "doc_id")
    others = own.select("pair", "source").join(snippets, "source").select("pair", "i", "text")
    texts = own.select("pair", F.lit(0).alias("i"), "text").unionByName(others)
    return similar_texts.group_similarity(texts, "pair", "i", "text")


DECISION = """
d as (select o_orderkey::varchar as decision, 'M' || o_custkey as name, case o_orderkey % 3 when 0 then 'accept_override' when 1 then 'reject' else 'defer' end as action,
      case when o_orderkey % 10 <> 0 then 'A' || o_orderkey % 7 end as id, o_orderdate::timestamp as made, o_orderkey as k, case when o_orderkey % 4 = 2 then 2 else 1 end as batch
      from orders where o_orderkey % 4 <> 3)
"""


@query(f"""
with {DECISION}
select 'decisions' as t, decision as key, name, id from d union all
select 'last', decision, name, id from (select *, row_number() over (partition by name order by made desc, decision desc) as r from d) where r = 1 union all
select 'overrides', null, name, id from (select *, row_number() over (partition by name order by batch, made, decision) as r from d
       where action = 'accept_override' and id is not null) where r = 1 union all
select distinct 'rejected', null, name, id from d where action = 'reject' and id is not null union all
select 'evidence', decision, strftime(made, '%Y-%m-%d') || ' ' || name || ' ' || action || coalesce(' ' || id, ''), null from d
""")
def decision_ledger(spark, sf_dir):
    """Three batches of decisions, of which the second repeats some and is sent twice, and the third breaks off before its mark."""
    k = c("o_orderkey")
    log = t(spark, sf_dir, "orders").select(
        k.cast("string").alias("decision"), F.concat(F.lit("M"), c("o_custkey")).alias("name"),
        F.when(k % 3 == 0, "accept_override").when(k % 3 == 1, "reject").otherwise("defer").alias("action"),
        F.when(k % 10 != 0, F.concat(F.lit("A"), k % 7)).alias("id"), F.lit("").alias("notes"), c("o_orderdate").cast("timestamp").alias("at"), (k % 4).alias("part")
    )
    book = ledger.Ledger(spark, shared(spark), ledger.DECISIONS, buckets=8)

    def breaks():
        raise InterruptedError

    ledger.record_decisions(book, "1", log.where("part in (0, 1)"))
    for _ in range(2):
        ledger.record_decisions(book, "2", log.where("part in (1, 2)"))
    try:
        ledger.record_decisions(book, "3", log.where("part = 3"), before_mark=breaks)
    except InterruptedError:
        pass
    none, kept = F.lit(None).cast("string"), {n: book.read(n) for n in ledger.DECISIONS}
    last = merge.last_by(kept["decisions"], ["name"], [F.desc("at"), F.desc("decision")])
    rows = {
        "decisions": ("decision", "name", "id"), "last": ("decision", "name", "id"), "overrides": (none, "name", "id"),
        "rejected": (none, "name", "id"), "evidence": ("decision", c("line").alias("name"), none)
    }
    parts = [(kept | {"last": last})[n].select(F.lit(n), *cols).toDF("t", "key", "name", "id") for n, cols in rows.items()]
    return reduce(DataFrame.unionByName, parts)


@query("""
select c_custkey, c_name, case when c_custkey % 3 = 0 then c_acctbal else c_acctbal + 1 end as c_acctbal, c_mktsegment, c_nationkey from customer
""", ("c_acctbal",), 4)
def snapshot_restored(spark, sf_dir):
    """A table that is changed twice, with a snapshot before each change and one more that breaks off, and then restored."""
    cols = ["c_name", "c_acctbal", "c_mktsegment", "c_nationkey"]
    now = t(spark, sf_dir, "customer").select("c_custkey", *cols)
    kept = snapshots.Snapshots(spark, shared(spark), ["c_custkey"])
    cleared = lambda df, rest: merge.clear(df, df.where(f"c_custkey % 3 = {rest}"), ["c_custkey"], cols)

    def breaks():
        raise InterruptedError

    kept.save(now, "before the first change")
    now = cleared(now, 0).withColumn("c_acctbal", c("c_acctbal") + 1)
    kept.save(now, "before the second change")
    now = cleared(now, 1)
    try:
        kept.save(cleared(now, 2), "breaks off", before_mark=breaks)
    except InterruptedError:
        pass
    return kept.restore(now, cols, least=2)


@query("""
with u as (select s_suppkey % 40 + 1 as k, s_name, s_acctbal, s_suppkey as made from supplier where s_suppkey % 3 > 0),
l as (select * from (select *, row_number() over (partition by k order by made desc) as r from u) where r = 1),
g as (select k, max(s_acctbal) as most from u group by 1),
f as (select k, min_by(s_name, made) as s_name from u group by 1)
select c_custkey, case when l.k is null then c_name else l.s_name end as c_name, greatest(c_acctbal, most) as c_acctbal,
       case when c_custkey % 2 = 0 then coalesce(f.s_name, null) else c_mktsegment end as c_mktsegment
from customer left join l on l.k = c_custkey left join g on g.k = c_custkey left join f on f.k = c_custkey
""")
def repeated_updates(spark, sf_dir):
    """Several updates of a key: the last replaces, the first fills a gap, the greatest is kept; rows stay one a key."""
    base = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.when(c("c_custkey") % 2 == 1, c("c_mktsegment")).alias("c_mktsegment"))
    upd = t(spark, sf_dir, "supplier").where("s_suppkey % 3 > 0").select(
        (c("s_suppkey") % 40 + 1).alias("c_custkey"), c("s_name").alias("c_name"), c("s_acctbal").alias("c_acctbal"),
        c("s_name").alias("c_mktsegment"), c("s_suppkey").alias("at")
    )
    out = merge.upsert(base, upd, ["c_custkey"], ["c_name"], insert=False, order=["at"])
    out = merge.fill_missing(out, upd, ["c_custkey"], ["c_mktsegment"], False, order=["at"])
    return merge.keep_greatest(out, upd, ["c_custkey"], ["c_acctbal"])
