"""Registered queries: later link steps, catalogs as tables, stored pages, kept-up figures, files of several encodings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmill.operators import catalogs, cohort, graph, linkage, members, pages, sketches
from linkmill.operators.joins import dealt_join, grid_join, settled
from linkmill.plans.catalog import LINES, QUERIES, SQL, _ratio_sql, lines, query, shared, t  # noqa: F401
from linkmill.plans.records import PEOPLE, people
from linkmill.sources import tables

c = F.col


# Link steps


@query("""
with s as (select s_suppkey as m, 60 + s_suppkey % 50 as score, s_suppkey % 4 as works, s_suppkey % 3 = 0 as on_domain, s_nationkey from supplier),
a as (select distinct l_suppkey as m, l_orderkey from lineitem where l_suppkey in (select m from s where s_nationkey >= 5)),
b as (select distinct l_suppkey as seed, l_orderkey from lineitem where l_suppkey in (select m from s where s_nationkey < 5)),
r as (select m, count(distinct l_orderkey) as n from a join b using (l_orderkey) group by 1),
x as (select s.*, coalesce(n, 0) as n, coalesce(n, 0) > 0 and works > 0 and not on_domain as vetoed, coalesce(n, 0) > 0 and (works = 0 or on_domain) as better from s left join r using (m) where s_nationkey >= 5)
select m, score + case when better then 30 else 0 end as total_score, case when better then 30 else 0 end as score_verdict,
       case when better and score + 30 >= 110 then 'HIGH' else 'REVIEW' end as tier, better and score + 30 >= 110 as accepted,
       case when better and score + 30 >= 110 then 'shared_works' else 'pass2' end as method,
       case when vetoed then 'shared works but no topic of the domain in ' || works || ' works'
            when better then n || ' shared works: ' || score || ' + 30 = ' || (score + 30) end as note from x
""")
def seed_promotion(spark, sf_dir):
    """Suppliers under review, those of five nations as seeds: shared works, the topic veto, points, and HIGH from 110 on."""
    k = c("s_suppkey")
    s = t(spark, sf_dir, "supplier").withColumn("l_suppkey", k)
    ring = graph.seed_ring(s.where("s_nationkey >= 5"), t(spark, sf_dir, "lineitem"), s.where("s_nationkey < 5"), "l_suppkey", "l_orderkey")
    review = s.where("s_nationkey >= 5").select(
        k.alias("m"), (60 + k % 50).alias("total_score"), F.lit(0).alias("score_verdict"), F.lit("REVIEW").alias("tier"), F.lit(False).alias("accepted"),
        F.lit("pass2").alias("method"), (k % 4).alias("works"), F.array(F.when(k % 3 == 0, "skin of the hand").otherwise("heart")).alias("labels")
    )
    return graph.promoted(review, ring, "m", "m", ["skin"]).drop("works", "labels")


@query(f"""
with m as (select s_suppkey as key, 'ann ' || ['leighton', 'lee', 'leigh'][s_suppkey % 3 + 1] as a, s_suppkey % 100 as slot, case when s_suppkey % 2 = 0 then 'Royal Hospital' end as place from supplier),
r as (select c_custkey as id, 'ann ' || ['leightan', 'lee', 'leighton', 'kim'][c_custkey % 4 + 1] as b, c_custkey % 100 as slot,
      case c_custkey % 3 when 0 then 'ROYAL HOSPITAL of X' when 1 then 'zzz' end as inst, c_custkey % 5 as n_on, c_custkey % 7 as z from customer),
p as (select key, id, a, b, n_on, z, coalesce(place is not null and inst like 'ROYAL%', false) as hit, case when a = b then 100.0 else {_ratio_sql('a', 'b')} end as sim from m join r using (slot)),
q as (select key, id, (case when a = b then 40 when sim >= 92 then 35 when sim >= 85 then 25 else 15 end + case when z < 2 then 25 when z < 4 then 15 else 0 end
      + case when n_on >= 3 then 20 when n_on >= 1 then 10 else 0 end + case when hit then 15 else 0 end)::int as total_score from p where sim >= 75),
f as (select *, row_number() over (partition by key order by total_score desc, id) as nth from q)
select key, id, total_score, case when total_score >= 85 then 'HIGH' when total_score >= 70 then 'MEDIUM' else 'REJECTED' end as tier from f where nth = 1
""")
def graded_links(spark, sf_dir):
    """The graded model with its institution part, and its bands: suppliers as members, customers of the same slot as records."""
    s, k = c("s_suppkey"), c("c_custkey")
    pick = lambda i, *x: F.element_at(F.array(*map(F.lit, x)), (i % len(x) + 1).cast("int"))
    m = t(spark, sf_dir, "supplier").select(
        s.alias("key"), F.concat(F.lit("ann "), pick(s, "leighton", "lee", "leigh")).alias("m_norm"), (s % 100).alias("slot"), F.when(s % 2 == 0, "Royal Hospital").alias("place")
    )
    r = t(spark, sf_dir, "customer").select(
        k.alias("id"), F.concat(F.lit("ann "), pick(k, "leightan", "lee", "leighton", "kim")).alias("a_norm"), (k % 100).alias("slot"),
        F.when(k % 3 == 0, "ROYAL HOSPITAL of X").when(k % 3 == 1, "zzz").alias("inst"), (k % 7 < 2).alias("now_local"), (k % 7 < 4).alias("ever_local"),
        F.transform(F.expr("if(c_custkey % 5 > 0, sequence(1, cast(c_custkey % 5 as int)), array())"), lambda x: F.lit("skin")).alias("labels")
    )
    m = m.distinct()
    m_kinds, r = linkage.kinds(m, "key"), linkage.kinds(r, "id")  # the model can't tell rows of a kind apart, so pairs are of kinds
    none, no = F.array().cast("array<string>"), F.lit(False)
    pairs = grid_join(m_kinds, r, "slot", "key", "id").withColumns({
        "in_state": no, "in_hospital": no, "known": no, "concepts": none, "works": F.lit(10), "h": F.lit(1), "rank": F.lit(0)
    })
    of = lambda x, y: m_kinds.select("slot", x).distinct().join(r.select("slot", y).distinct(), "slot")
    best = linkage.graded(pairs, "place", "inst", ["skin"], "key", "rank", "id", of("m_norm", "a_norm"), of("place", "inst"))
    best = linkage.for_all(best.select("key", "id", "total_score", "tier"), m, m_kinds, "key")
    return best.select("key", "id", "total_score", "tier")


@query(f"""
with p as (select distinct string_split(lower(p_name), ' ')[1] as first, string_split(lower(p_name), ' ')[-1] as last from part),
n as (select p_partkey as k, p_size as works, p_type = 'ECONOMY' as on_domain, p_size % 2 = 0 as here, p_size % 3 > 0 as ever, string_split(lower(p_name), ' ')[1] as f1,
      string_split(lower(p_name), ' ')[-1] as l1 from part),
g as (select x.first as fa, x.last as la, y.first as fb, y.last as lb, {_ratio_sql('x.last', 'y.last')} as rl, {_ratio_sql('x.first', 'y.first')} as rf
      from p x join p y on left(x.last, 1) = left(y.last, 1) where x.first <= y.first),
s as (select k, fb, lb, works, on_domain, here, ever, case when rl >= 95 then 50 when rl >= 85 then 35 when rl >= 70 then 15 end
      + case when rf >= 90 then 20 when left(fa, 1) = left(fb, 1) then 12 else -10 end + here::int * 15 + on_domain::int * 10
      + case when works between 1 and 600 then 5 else 0 end as score from n join g on n.f1 = fa and n.l1 = la)
select k, fb, lb, coalesce(score, 0)::int as score, coalesce(score, 0) >= 35 as accepted,
       case when not ever or not on_domain then 'MEDIUM' else 'HIGH' end as topical,
       case when works > 20 and on_domain::int * 2 < greatest(1, floor(works / 20)) then 'REJECTED' when coalesce(score, 0) >= 70 then 'MEDIUM' else 'LOW' end as first_last from s
""")
def variant_tiers(spark, sf_dir):
    """Parts against distinct names: scores by the ratios of first and last names, and the tiers of two variants."""
    word = lambda i: F.element_at(F.split(F.lower("p_name"), " "), i)
    rows = t(spark, sf_dir, "part").select(
        c("p_partkey").alias("k"), c("p_size").alias("works"), (c("p_type") == "ECONOMY").alias("on_domain"), (c("p_size") % 2 == 0).alias("here"),
        (c("p_size") % 3 > 0).alias("ever"), word(1).alias("fa"), word(-1).alias("la")
    )
    names = settled(rows.select("fa", "la", F.left("la", F.lit(1)).alias("i")).distinct())
    near = grid_join(names, names.select("i", c("fa").alias("fb"), c("la").alias("lb")), "i", "la", "lb").where("fa <= fb")
    near = near.withColumn("points", members.ratio_points(c("la"), c("fa"), c("lb"), c("fb")))  # once for two names, not once a part
    name = F.concat_ws("\n", "fa", "la").alias("name")
    near = settled(near.select(name, c("la").alias("last"), "fb", "lb", "points"))
    pairs = dealt_join(rows.select(name, "k", "works", "on_domain", "here", "ever").where("fa is not null and la is not null"), near, "name", "k")
    score = members.score_with(c("points"), c("last"), c("lb"), c("here"), c("on_domain"), c("works"))
    n_on = c("on_domain").cast("int") * 2
    return pairs.withColumn("score", score.cast("int")).select(
        "k", "fb", "lb", "score", (c("score") >= members.VARIANT_ACCEPT["ratio"]).alias("accepted"),
        members.topical_tier(c("ever"), n_on).alias("topical"), members.first_last_tier(c("score"), c("works"), n_on).alias("first_last")
    )


@query(f"""
with {PEOPLE} select key, lower(first || ' ' || last) as first_norm, case when key % 3 = 0 then lower(last) || ' x' else 'z ' || lower(last) end as second_norm,
       key % 3 <> 0 as cross_verified, case when key % 3 <> 0 then key * 2 end as second_works, case when key % 3 <> 0 then key % 50 end as second_h from p
""")
def two_sources_metrics(spark, sf_dir):
    """Two sources' records of a member; where they agree, the second one's metrics."""
    p = people(spark, sf_dir)
    name = F.when(c("key") % 3 == 0, F.concat(c("last"), F.lit(" x"))).otherwise(F.concat(F.lit("z "), c("last")))
    other = p.select("key", name.alias("name"), (c("key") * 2).alias("works"), (c("key") % 50).alias("h"))
    return linkage.agreed(p, other, "key", "name", ["works", "h"])


@query(f"""
with w as ({LINES}), e as (select l_suppkey, count(*) as works, sum(cites)::bigint as citations from (select * from w where contains(lower(p_type), 'econ')
     union all select * from w where contains(lower(p_name), 'econ')) group by 1 order by 2 desc, 3 desc, 1 limit 25)
select l_suppkey, e.works, e.citations, s_name, s_acctbal as balance, (select count(*) from lineitem l where l.l_suppkey = e.l_suppkey) as all_works
from e join supplier on l_suppkey = s_suppkey
""", ("balance",), 4)
def expert_members(spark, sf_dir):
    """The best 25 of a search with their roster columns and figures; the roster repeats names, and its smallest balance counts."""
    found = cohort.experts(lines(spark, sf_dir), "l_suppkey", "p_type", "p_name", "cites", "Econ")
    s = t(spark, sf_dir, "supplier").select(c("s_suppkey").alias("l_suppkey"), "s_name", c("s_acctbal").alias("balance"))
    twice = s.unionByName(s.withColumn("balance", c("balance") + 1).withColumn("s_name", F.lit("later")))
    stats = t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("all_works"))
    return cohort.with_members(found, twice, stats.withColumn("balance", F.lit(0.0)), "l_suppkey", ["balance"])


_ROSTER = "select c_custkey, ['HIGH', 'REVIEW', 'NOT_FOUND'][c_custkey % 3 + 1] as tier, c_mktsegment as priority, c_nationkey % 4 as s from customer"


@query(f"""
with r as (select *, ['NSW', 'VIC', 'QLD', 'WA'][s + 1] as state from ({_ROSTER}))
select 'accepted' as v, c_custkey, tier, state, priority from r where tier = 'HIGH' union all
select 'queue', c_custkey, tier, state, priority from r where tier in ('HIGH', 'REVIEW') and state = 'VIC' and priority = 'BUILDING' union all
select 'state', c_custkey, tier, state, priority from r where tier = 'HIGH' and state = 'WA'
""")
def roster_views(spark, sf_dir):
    k, s = c("c_custkey"), c("c_nationkey")
    pick = lambda i, *x: F.element_at(F.array(*map(F.lit, x)), (i % len(x) + 1).cast("int"))
    r = t(spark, sf_dir, "customer").select(
        k, pick(k, "HIGH", "REVIEW", "NOT_FOUND").alias("tier"), pick(s, "NSW", "VIC", "QLD", "WA").alias("state"), c("c_mktsegment").alias("priority")
    )
    views = {
        "accepted": cohort.roster_view(r), "queue": cohort.roster_view(r, ("high", "Review"), "VIC", "BUILDING"),
        "state": cohort.roster_view(r, state="WA", priority="All")
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("v"), "*") for n, df in views.items()])


# Catalogs


_NAMES = r"select distinct unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) as name from benchmark"


@query(f"""
with n as ({_NAMES}), h as (select doc_id, name from documents join n on contains(lower(text), name)),
b as (select doc_id, count(*) as n_names, min(length(name) * 1000 + ascii(name)) as least from h group by 1)
select doc_id, coalesce(n_names, 0) as n_names, case when least is null then 'none' else 'n' || least end as label from documents left join b using (doc_id)
""")
def catalog_labels(spark, sf_dir):
    """Documents by a catalog of names, the longer words of the benchmark: how many they hold, and the label of the first by rank."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))
    names = t(spark, sf_dir, "benchmark").select(words.alias("name")).distinct()
    rank = F.length("name") * 1000 + F.ascii("name")
    names = names.select("name", rank.alias("rank"), F.concat(F.lit("n"), rank).alias("label"))
    return catalogs.first_labels(t(spark, sf_dir, "documents"), "doc_id", "text", names, "name", "label", "rank", "none")


@query(f"with n as ({_NAMES}) select p_partkey, name from part join (select distinct lower(p_name)[:3] as name from part) n on contains(lower(p_name || ' ' || p_type), name)")
def catalog_pairs(spark, sf_dir):
    """All pairs of a part and a beginning of a part's name inside it, by the index that catalogs too large for a task use."""
    p = t(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("both"), F.left("p_name", F.lit(3)).alias("name"))
    return catalogs.found_names(p, "p_partkey", "both", p, "name", most_chars=0)


# Stored pages and figures


@query("""
select 'page 40' as p, l_orderkey, l_linenumber, l_extendedprice from (from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 100 offset 3900)
union all
select 'after', l_orderkey, l_linenumber, l_extendedprice from (from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 50 offset 4000)
""")
def stored_pages(spark, sf_dir):
    """A page far back by its number, and the rows after its last one, from a table stored in order."""
    order = [("l_extendedprice", True), ("l_orderkey", False), ("l_linenumber", False)]
    path = shared(spark)
    pages.write_pages(t(spark, sf_dir, "lineitem").select(*(x for x, _ in order)), order, path, 5_000)
    one = pages.page_at(spark, path, order, 40, 100)
    rows = one.collect()  # a page
    after = pages.page_after(spark, path, order, rows[-1].asDict(), 50) if rows else one
    return one.select(F.lit("page 40").alias("p"), "*").unionByName(after.select(F.lit("after").alias("p"), "*")).select("p", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("""
select o_orderpriority, count(*) as n, sum(o_totalprice) as total, count(distinct o_custkey) as n_distinct, true as distinct_near,
       true as median_near, true as quartile_near from orders group by 1
""", ("total",), 2)
def kept_figures(spark, sf_dir):
    """Ten batches of orders as stored sketches, merged: counts and sums are exact; distinct members and quantiles are near.

    Whether they are is judged against exact figures: distinct within five standard errors, ranks within three per cent."""
    path, o = shared(spark), t(spark, sf_dir, "orders")
    for b in range(10):
        batch = o.where(F.pmod("o_orderkey", F.lit(10)) == b)
        sketches.batch_figures(batch, ["o_orderpriority"], "o_custkey", "o_totalprice").write.mode("append").parquet(path)
    got = sketches.merged_figures(spark.read.parquet(path), ["o_orderpriority"], (0.25, 0.5)).withColumnRenamed("n_distinct", "about")
    exact = o.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n_distinct"))
    q = got.select("o_orderpriority", c("q")[0].alias("q1"), c("q")[1].alias("q2"))
    share = lambda x: F.avg((c("o_totalprice") <= c(x)).cast("double"))
    ranks_ = o.join(q, "o_orderpriority").groupBy("o_orderpriority").agg(share("q1").alias("r1"), share("q2").alias("r2"))
    out = got.join(exact, "o_orderpriority").join(ranks_, "o_orderpriority")
    return out.select(
        "o_orderpriority", "n", "total", "n_distinct", (F.abs(c("about") - c("n_distinct")) <= 5 * 1.04 / 64 * c("n_distinct") + 1).alias("distinct_near"),
        (F.abs(c("r2") - 0.5) <= 0.03 + 1 / c("n")).alias("median_near"), (F.abs(c("r1") - 0.25) <= 0.03 + 1 / c("n")).alias("quartile_near")
    )


# Files


@query("select c_custkey as k, replace(c_mktsegment, 'U', 'Ü') as s from customer")
def mixed_encodings(spark, sf_dir):
    """A folder of CSV files in UTF-8 and in Latin-1."""
    k, place = c("c_custkey"), shared(spark)
    rows = t(spark, sf_dir, "customer").select(k.alias("k"), F.replace(c("c_mktsegment"), F.lit("U"), F.lit("Ü")).alias("s"))
    rows.where("k % 3 = 0").write.option("header", True).option("encoding", "ISO-8859-1").csv(place)
    rows.where("k % 3 > 0").write.mode("append").option("header", True).csv(place)
    return tables.csv(spark, place, "k long, s string")
