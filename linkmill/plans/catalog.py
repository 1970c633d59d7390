"""The registered queries of the library, and their SQL.

The library works on rosters, authors and works. The given tables stand in for them: suppliers and
customers for members and authors, orders and line items for works and links, part types and brands
for topics, order prices for citations.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmill.functions import names as N
from linkmill.functions import similarity as S
from linkmill.functions import vocab as V
from linkmill.operators import cohort, corpus_weights, flatten, gates, graph, linkage, members, merge, metrics, ranks, similar_texts
from linkmill.sources import tables

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, rounded: tuple[str, ...] = (), digits: int = 6):
    """Registers a function under its name, with the SQL that gives the same rows.

    Columns in `rounded` are compared to `digits` decimals, since two engines add up in different orders."""

    def add(f):
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(spark, sf_dir).withColumns({x: F.round(x, digits) for x in rounded})) if rounded else f
        if sql:
            SQL[f.__name__] = f"select * replace ({', '.join(f'round({x}, {digits}) as {x}' for x in rounded)}) from ({sql})" if rounded else sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share; a temporary one in a local session without it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{found or tempfile.mkdtemp(prefix='spark-linkmill-')}/linkmill/{uuid.uuid4().hex}"


def cited(spark, sf_dir) -> DataFrame:
    """Orders as works: author, work, citations, year."""
    return t(spark, sf_dir, "orders").select(
        c("o_custkey").alias("author"), c("o_orderkey").alias("work"),
        F.floor(c("o_totalprice") / 50000).alias("citations"), F.year("o_orderdate").alias("year")
    )


CITED = "select o_custkey as author, o_orderkey as work, floor(o_totalprice / 50000)::bigint as citations, year(o_orderdate)::int as year from orders"


# Metrics


@query(
    f"""
    select author, max(case when citations >= rn then rn else 0 end)::bigint as h_index from (select *,
        row_number() over (partition by author order by citations desc) as rn from ({CITED})) group by 1
    """
)
def h_index(spark, sf_dir):
    return metrics.h_index(cited(spark, sf_dir), ["author"], "citations")


@query(f"select author, count_if(citations >= 5) as i5, count_if(citations >= 10) as i10 from ({CITED}) group by 1")
def i_index(spark, sf_dir):
    return cited(spark, sf_dir).groupBy("author").agg(metrics.i_index("citations", 5).alias("i5"), metrics.i_index("citations").alias("i10"))


@query("""
with w as (select o_orderkey as work, floor(o_totalprice / 50000)::bigint as citations, year(o_orderdate)::int as year,
       o_totalprice / 100000 as fwci,
                  case o_orderstatus when 'F' then true when 'O' then false end as is_oa from orders),
l as (select o_custkey as author, o_orderkey as work, case o_orderpriority when '1-URGENT' then 'first'
     when '5-LOW' then 'last' else 'middle' end as position from orders),
j as (select * from l join w using (work)),
h as (select author, max(case when citations >= rn then rn else 0 end)::bigint as h_index from (select *,
     row_number() over (partition by author order by citations desc) as rn from j) group by 1),
s as (select author, count(*) as pub_count, sum(citations)::bigint as citations, count_if(citations >= 10) as i10_index,
     avg(fwci) as fwci_mean, median(fwci) as fwci_median, coalesce(avg(is_oa::int), 0) as oa_rate,
             avg((position = 'first')::int) as first_rate, avg((position = 'last')::int) as last_rate, min(year) as first_year,
                  max(year) as last_year from j group by 1)
select c_custkey as author, coalesce(pub_count, 0) as pub_count, coalesce(s.citations, 0)::bigint as citations, coalesce(i10_index,
       0) as i10_index, fwci_mean, fwci_median, coalesce(oa_rate, 0) as oa_rate,
       coalesce(first_rate, 0) as first_rate, coalesce(last_rate, 0) as last_rate, coalesce(first_year, 0) as first_year,
            coalesce(last_year, 0) as last_year, coalesce(h_index, 0) as h_index
from customer left join s on c_custkey = s.author left join h on c_custkey = h.author
""", ("fwci_mean", "fwci_median", "oa_rate", "first_rate", "last_rate"), 9)
def author_stats(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    works = o.select(
        c("o_orderkey").alias("work"), F.floor(c("o_totalprice") / 50000).alias("citations"),
        F.year("o_orderdate").alias("year"), (c("o_totalprice") / 100000).alias("fwci"),
        F.when(c("o_orderstatus") == "F", True).when(c("o_orderstatus") == "O", False).alias("is_oa")
    )
    links = o.select(
        c("o_custkey").alias("author"), c("o_orderkey").alias("work"),
        F.when(
            c("o_orderpriority") == "1-URGENT", "first"
        ).when(c("o_orderpriority") == "5-LOW", "last").otherwise("middle").alias("position")
    )
    roster = t(spark, sf_dir, "customer").select(c("c_custkey").alias("author"))
    return metrics.author_stats(links, works, "author", "work", "citations", "year", "fwci", "is_oa", "position", roster)


@query("""
select l_suppkey, coalesce(avg(case when l_returnflag = 'A' then 1 when l_returnflag = 'N' then 0 end), 0) as known_rate,
       avg((l_linestatus = 'F')::int) as position_rate,
       coalesce(avg(case when n_name not in ('NATION_1', 'NATION_2') then 1 else 0 end), 0) as abroad_rate
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
     group by 1
""", ("known_rate", "position_rate", "abroad_rate",))
def shares(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), c("l_orderkey") == c("o_orderkey")).join(t(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey")).join(
        t(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey")
    )
    return li.groupBy("l_suppkey").agg(
        metrics.share_true(
            F.when(c("l_returnflag") == "A", True).when(c("l_returnflag") == "N", False)
        ).alias("known_rate"),
        metrics.share_position("l_linestatus", "F").alias("position_rate"),
        metrics.share_abroad(metrics.country_codes(c("n_name")), ["NATION_1", "NATION_2"]).alias("abroad_rate")
    )


@query("select l_suppkey, count(distinct (l_partkey, l_returnflag)) as n_grants from lineitem group by 1")
def distinct_grants(spark, sf_dir):
    return metrics.distinct_on(t(spark, sf_dir, "lineitem"), "l_suppkey", ["l_partkey", "l_returnflag"], "n_grants")


@query("""
select o_custkey, n, n_relevant, case when x - floor(x) = 0.5 and floor(x) % 2 = 0 then floor(x) / 10 else round(x) / 10 end as pct
from (select *, 1000.0 * n_relevant / n as x from (select o_custkey, count(*) as n, count_if(o_orderpriority = '1-URGENT') as n_relevant
     from orders group by 1))
""")
def relevance_share(spark, sf_dir):
    return metrics.relevance(t(spark, sf_dir, "orders").withColumn("flag", c("o_orderpriority") == "1-URGENT"), "o_custkey", "flag")


@query("""
with k as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, floor(l_extendedprice / 10000)::bigint as cites,
       l_partkey % 50 as key from lineitem),
o as (select * from (select *, row_number() over (partition by l_suppkey, key order by l_orderkey, l_linenumber, l_partkey,
     l_extendedprice) as r from k) where r = 1),
h as (select l_suppkey, max(case when cites >= rn then rn else 0 end)::bigint as h_index from (select *,
     row_number() over (partition by l_suppkey order by cites desc) as rn from o) group by 1)
select l_suppkey, count(*) as works, sum(cites)::bigint as citations, any_value(h_index) as h_index from o join h using (l_suppkey)
       group by 1
""")
def profiles_merged(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        F.floor(c("l_extendedprice") / 10000).alias("cites"), (c("l_partkey") % 50).cast("string").alias("doi"),
        F.lit("").alias("title")
    )
    own = t(spark, sf_dir, "supplier").select(c("s_suppkey").alias("l_suppkey"), c("s_suppkey").alias("member"))
    return metrics.profiles_merged(
        li, own, "member", "l_suppkey", "doi", "title", "cites",
        [c("l_orderkey"), c("l_linenumber"), c("l_partkey"), c("l_extendedprice")]
    ).withColumnRenamed("member", "l_suppkey")


@query(
    """
    select o_orderpriority, median(o_totalprice) as median, list_sort(list(o_totalprice))[(count(*) // 2 + 1)::bigint] as upper_median
        from orders group by 1
    """,
    ("median", "upper_median",)
)
def two_medians(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.median("o_totalprice").alias("median"), metrics.upper_median("o_totalprice").alias("upper_median")
    )


# Ranks and percentiles

COUNTED = "select c_custkey, c_mktsegment = 'BUILDING' as tier, (select count(*) from orders where o_custkey = c_custkey) as works from customer"


def counted(spark, sf_dir) -> DataFrame:
    n = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("works"))
    return t(spark, sf_dir, "customer").join(n, c("c_custkey") == c("o_custkey"), "left").select(
        "c_custkey", (c("c_mktsegment") == "BUILDING").alias("tier"), F.coalesce("works", F.lit(0)).alias("works")
    )


@query(
    f"""
    with x as ({COUNTED}) select c_custkey, tier, works, (rank() over (order by works) + (count(*) over (partition by works) - 1) / 2.0) /
        count(*) over () * 100 as pct from x
    """,
    ("pct",)
)
def percentile_rank(spark, sf_dir):
    return ranks.percentile_rank(counted(spark, sf_dir), "works")


@query(f"""
with x as ({COUNTED}), b as (select works, count(*) as n from x where tier group by 1), total as (select sum(n) as total from b)
select c_custkey, tier, works, (coalesce((select sum(n) from b where b.works < x.works), 0) + case when tier then ((select n from b
       where b.works = x.works) + 1) / 2.0 else 0 end) / total * 100 as pct from x, total
""", ("pct",))
def tier_percentile(spark, sf_dir):
    return ranks.tier_percentile(counted(spark, sf_dir), "works", "tier")


@query("""
with p as (select s_acctbal as v from supplier), q as (select c_custkey, c_acctbal as value from customer)
select c_custkey, 's_acctbal' as metric, value, 100.0 * (select count(*) from p where v < value) / (select count(*) from p) as pct,
       (select count(*) from p where v > value) + 1 as rank, (select count(*) from p) as n, 100.0 * ((select count(*) from p
            where v > value) + 1) / (select count(*) from p) as top_share from q
""", ("pct", "top_share",))
def rank_of_value(spark, sf_dir):
    ask = t(spark, sf_dir, "customer").select("c_custkey", c("c_acctbal").alias("s_acctbal"))
    return ranks.outside_ranks(ask, t(spark, sf_dir, "supplier").select("s_acctbal"), ["s_acctbal"])


@query("select s_suppkey, s_name, s_nationkey, s_acctbal from supplier order by abs(s_acctbal - 5000), s_suppkey limit 10")
def nearest_k(spark, sf_dir):
    return ranks.nearest_k(t(spark, sf_dir, "supplier"), "s_acctbal", 5000.0, "s_suppkey")


@query(
    f"""
    select author, work, citations, year from (select *, row_number() over (partition by author order by citations desc, work) as r
        from ({CITED})) where r <= 5
    """
)
def top_works(spark, sf_dir):
    return ranks.top_per_group(cited(spark, sf_dir), ["author"], [F.desc("citations"), "work"], 5)


@query(
    f"""
    with x as ({COUNTED}), p as (select *, (rank() over (order by works) + (count(*) over (partition by works) - 1) / 2.0) / count(*) over
        () * 100 as pct from x) select case when pct >= 90 then 'Top 10%' when pct >= 75 then 'Top 25%' when pct >= 50 then 'Above median'
        when pct >= 25 then 'Below median' else 'Bottom 25%' end as label, count(*) as n from p group by 1
    """
)
def tier_labels(spark, sf_dir):
    return ranks.percentile_rank(counted(spark, sf_dir), "works").groupBy(ranks.tier_label("pct").alias("label")).agg(F.count("*").alias("n"))


@query("select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 50")
def third_page(spark, sf_dir):
    return ranks.page(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 3, 25)


@query("""
with s as (select l_suppkey, count(*)::double as works, sum(l_quantity)::double as quantity, avg(l_discount) as discount from lineitem
       where l_suppkey in (1, 2) group by 1)
select metric, max(case when l_suppkey = 1 then value end) as a, max(case when l_suppkey = 2 then value end) as b from (unpivot s on works,
       quantity, discount into name metric value value) group by 1
""", ("a", "b",))
def side_by_side(spark, sf_dir):
    s = t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").cast("double").alias("works"), F.sum("l_quantity").alias("quantity"),
        F.avg("l_discount").alias("discount")
    )
    return ranks.side_by_side(s, "l_suppkey", 1, 2, ["works", "quantity", "discount"])


# Graph

PAIRS = """
select a.m as a, b.m as b, count(*) as weight from (select distinct l_orderkey as w, l_suppkey as m from lineitem) a
    join (select distinct l_orderkey as w, l_suppkey as m from lineitem) b on a.w = b.w and a.m < b.m group by 1, 2
"""


@query(f"select * from ({PAIRS}) where weight >= 2")
def coauthor_edges(spark, sf_dir):
    return graph.coauthor_edges(t(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey", 2)


@query(f"""
with e as (select * from ({PAIRS}) where weight >= 2), d as (select m as member, count(*) as neighbours, sum(weight)::bigint as degree
       from (select a as m, weight from e union all select b, weight from e) group by 1)
select *, case when degree >= 15 then 'hub' when degree >= 6 then 'strong' else 'other' end as role from d
""")
def weighted_degree(spark, sf_dir):
    return graph.degrees(coauthor_edges(spark, sf_dir))


@query(f"""
with e as ({PAIRS}), s as (select * from e where weight >= 2), n as (select count(distinct m) as n from (select a as m from s union all
       select b from s))
select n as n_nodes, (select count(*) from s) as n_edges, (select max(weight) from e) as max_weight, 200.0 * (select count(*)
       from s) / (n * (n - 1)) as density_pct from n
""", ("density_pct",))
def graph_stats(spark, sf_dir):
    return graph.graph_stats(t(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey")


@query("""
with seeds as (select s_suppkey from supplier where s_nationkey < 5), cand as (select s_suppkey from supplier where s_nationkey >= 5),
a as (select distinct l_suppkey as candidate, l_orderkey from lineitem where l_suppkey in (from cand)),
     b as (select distinct l_suppkey as seed, l_orderkey from lineitem where l_suppkey in (from seeds))
select candidate, count(distinct l_orderkey) as shared_works, count(distinct seed) as shared_seeds, 30 as bonus from a
       join b using (l_orderkey) group by 1
""")
def seed_ring(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    return graph.seed_ring(s.where("s_nationkey >= 5"), t(spark, sf_dir, "lineitem"), s.where("s_nationkey < 5"), "l_suppkey", "l_orderkey")


# Cohort aggregates

LINES = """
select l_suppkey, l_orderkey, l_linenumber, floor(l_extendedprice / 10000)::bigint as cites, p_type, p_brand, p_name,
    year(l_shipdate)::int as year, n_name as state from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
    join nation on s_nationkey = n_nationkey
"""


def lines(spark, sf_dir) -> DataFrame:
    li = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part"), c("l_partkey") == c("p_partkey")).join(t(spark, sf_dir, "supplier"), c("l_suppkey") == c("s_suppkey")).join(
        t(spark, sf_dir, "nation"), c("s_nationkey") == c("n_nationkey")
    )
    return li.select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        F.floor(c("l_extendedprice") / 10000).alias("cites"), "p_type", "p_brand", "p_name",
        F.year("l_shipdate").alias("year"), c("n_name").alias("state")
    )


@query(f"select l_suppkey, p_type, count(*) as works, sum(cites)::bigint as citations from ({LINES}) group by 1, 2")
def expertise_index(spark, sf_dir):
    return cohort.expertise(lines(spark, sf_dir), "l_suppkey", "p_type", "cites")


@query(
    f"""
    with w as ({LINES}) select l_suppkey, count(*) as works, sum(cites)::bigint as citations from (select * from w
        where contains(lower(p_type), 'brass') union all select * from w where contains(lower(p_name), 'brass')) group by 1
        order by 2 desc, 3 desc, 1 limit 25
    """
)
def expert_search(spark, sf_dir):
    return cohort.experts(lines(spark, sf_dir), "l_suppkey", "p_type", "p_name", "cites", "BRASS")


def _matrix_sql(col: str, k_cols: str) -> str:
    return f"""
with w as ({LINES}), r as (select p_brand, count(*) as n from w group by 1 order by 2 desc, 1 limit 15), k as (select {col}, count(*) as n
       from w {k_cols})
select p_brand, {col}, (select count(*) from w where w.p_brand = r.p_brand and w.{col} = k.{col}) as n from r, k
"""


@query(_matrix_sql("year", "where p_brand in (select p_brand from r) group by 1"))
def topic_year_matrix(spark, sf_dir):
    return cohort.matrix(lines(spark, sf_dir), "p_brand", "year", 15)


@query(_matrix_sql("state", "group by 1 order by 2 desc, 1 limit 8"))
def topic_state_matrix(spark, sf_dir):
    return cohort.matrix(lines(spark, sf_dir), "p_brand", "state", 15, 8)


@query("""
select (select count(*) from customer) as n_members, (select count(distinct o_custkey) from orders) as n_linked, (select count(*)
       from orders) as n_works, (select count_if(o_orderpriority = '1-URGENT') from orders) as n_relevant,
       (select sum(floor(o_totalprice / 50000))::bigint from orders) as citations, (select count(distinct event_type)
            from events) as n_trials, (select count(*) from lineitem) as n_awards, (select count(distinct l_suppkey)
            from lineitem) as n_funded_members,
       100.0 * (select count(distinct o_custkey) from orders) / (select count(*) from customer) as linked_pct,
            100.0 * (select count_if(o_orderpriority = '1-URGENT') from orders) / (select count(*) from orders) as relevant_pct
""", ("linked_pct", "relevant_pct",))
def key_figures(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(
        c("o_custkey").alias("member"), (c("o_orderpriority") == "1-URGENT").alias("relevant"),
        F.floor(c("o_totalprice") / 50000).alias("citations")
    )
    return cohort.key_figures(
        t(spark, sf_dir, "customer"), o, o, t(spark, sf_dir, "events").select(c("event_type").alias("trial_id")),
        t(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("member"))
    )


@query(
    """
    select year(o_orderdate)::int as year, count_if(o_orderpriority = '1-URGENT') as relevant,
        count_if(o_orderpriority <> '1-URGENT') as other from orders where year(o_orderdate) >= 1996 group by 1
    """
)
def trend_by_year(spark, sf_dir):
    return cohort.trend(
        t(spark, sf_dir, "orders").select(
            F.year("o_orderdate").alias("year"), (c("o_orderpriority") == "1-URGENT").alias("flag")
        ),
        "year", "flag", 1996
    )


@query("select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1 order by 2 desc, 1 limit 12")
def top_institutions(spark, sf_dir):
    return cohort.top_groups(t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey")), "n_name", 12)


@query(
    """
    select c_mktsegment, count(*) as n, case c_mktsegment when 'MACHINERY' then 1 when 'BUILDING' then 2 else 3 end as place from customer
        group by 1
    """
)
def members_in_order(spark, sf_dir):
    return cohort.in_order(t(spark, sf_dir, "customer"), "c_mktsegment", ["MACHINERY", "BUILDING"])


@query("""
select metric, count(value) as n, quantile_cont(value, 0.25) as p25, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.75) as p75,
       quantile_cont(value, 0.95) as p95
from (select l_quantity as value, 'l_quantity' as metric from lineitem union all select l_extendedprice, 'l_extendedprice' from lineitem
     union all select l_tax, 'l_tax' from lineitem) group by 1
""", ("p25", "p50", "p75", "p95",))
def quantile_bands(spark, sf_dir):
    return cohort.quantile_bands(t(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


@query("""
with e as (select min(o_totalprice) as lo, (max(o_totalprice) - min(o_totalprice)) / 30 as w from orders),
       b as (select least(floor((o_totalprice - lo) / w), 29)::int as bin, count(*) as n from orders, e group by 1)
select i::int as bin, lo + i * w as edge, coalesce(n, 0) as n from range(30) r(i), e left join b on b.bin = i
""", ("edge",))
def histogram(spark, sf_dir):
    return cohort.histogram(t(spark, sf_dir, "orders"), "o_totalprice", 30)


@query("""
with e as (select min(o_totalprice) as lo, (max(o_totalprice) - min(o_totalprice)) / 40 as w from orders),
       b as (select least(floor((o_totalprice - lo) / w), 39)::int as bin, count(*) as n from orders, e group by 1),
h as (select i::int as bin, lo + i * w as edge, coalesce(n, 0) as n from range(40) r(i), e left join b on b.bin = i)
select h.bin, h.edge, h.n, sum(g.n * exp(-0.5 * ((g.bin - h.bin) / 1.2) ** 2)) / sum(exp(-0.5 * ((g.bin - h.bin) / 1.2) ** 2)) as smooth
       from h join h g on abs(g.bin - h.bin) <= 5 group by 1, 2, 3
""", ("edge", "smooth",))
def smoothed_histogram(spark, sf_dir):
    return cohort.smoothed(cohort.histogram(t(spark, sf_dir, "orders"), "o_totalprice", 40))


@query(
    """
    select o_orderpriority, count(*) as n, min(o_totalprice) as lo, quantile_cont(o_totalprice, 0.25) as q1,
        median(o_totalprice) as median, quantile_cont(o_totalprice, 0.75) as q3, max(o_totalprice) as hi, avg(o_totalprice) as mean,
        stddev(o_totalprice) as sd from orders group by 1
    """,
    ("q1", "median", "q3", "mean", "sd",)
)
def box_summary(spark, sf_dir):
    return cohort.box(t(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


@query(
    """
    select o_custkey, o_orderpriority, n from (select o_custkey, o_orderpriority, count(*) as n, row_number() over (partition by o_custkey
        order by count(*) desc, o_orderpriority) as r from orders group by 1, 2) where r = 1
    """
)
def modal_value(spark, sf_dir):
    return cohort.modal(t(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query(
    f"""
    select l_suppkey, term, n from (select l_suppkey, term, count(*) as n, row_number() over (partition by l_suppkey
        order by count(*) desc, term) as r from (select l_suppkey, unnest(string_split(lower(p_name), ' ')) as term from ({LINES}))
        where length(term) >= 3 group by 1, 2) where r <= 3
    """
)
def top_terms(spark, sf_dir):
    return cohort.top_terms(lines(spark, sf_dir), "l_suppkey", "p_name", 3, " ")


@query("select distinct c_mktsegment from customer where c_mktsegment <> ''")
def option_list(spark, sf_dir):
    return cohort.options(t(spark, sf_dir, "customer"), "c_mktsegment")


@query(
    """
    select c.* from customer c join nation on c_nationkey = n_nationkey where n_regionkey in (1, 2) and (contains(c_mktsegment,
        'BUILD') or contains(c_mktsegment, 'MACH'))
    """
)
def filtered_members(spark, sf_dir):
    base = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey"))
    cols = t(spark, sf_dir, "customer").columns
    f = cohort.Filters(states=(1, 2), specialties=("BUILD", "MACH"))
    return cohort.members(base.withColumn("state", c("n_regionkey")).withColumn("specialty", c("c_mktsegment")), f).select(*cols)


@query(
    """
    select o_orderkey, year(o_orderdate)::int as year, o_orderstatus as type, o_orderpriority as title, o_totalprice > 100000 as relevant
        from orders where year(o_orderdate) between 1996 and 1998 and o_orderstatus in ('F',
        'O') and o_totalprice > 100000 and contains(lower(o_orderpriority), 'urgent')
    """
)
def filtered_works(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("year"), c("o_orderstatus").alias("type"),
        c("o_orderpriority").alias("title"), (c("o_totalprice") > 100000).alias("relevant")
    )
    return cohort.works(o, cohort.Filters(years=(1996, 1998), types=("F", "O"), relevant=True, text="Urgent"))


@query("select o.* from orders o where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def works_of_accepted(spark, sf_dir):
    names = cohort.accepted(
        t(spark, sf_dir, "customer").select(
            "c_custkey", F.lit(None).cast("boolean").alias("flag"),
            F.when(c("c_mktsegment") == "BUILDING", "HIGH").otherwise("LOW").alias("tier")
        ),
        "flag", "tier", "c_custkey"
    )
    return cohort.only(t(spark, sf_dir, "orders"), names, "o_custkey")


# Text


@query(
    "select doc_id, lower(trim(coalesce(source, '') || ' ' || coalesce(lang, '') || ' ' || coalesce(text, ''), ' ')) as search_text from documents"
)
def search_index(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", cohort.search_text("source", "lang", "text").alias("search_text"))


@query("select p_partkey, p_name, p_type from part where contains(lower(p_name), 'steel') or contains(lower(p_type), 'steel')")
def text_search(spark, sf_dir):
    return cohort.text_search(t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), ["p_name", "p_type"], "STEEL")


TOKENS = ["license", "the tion", "email", "http", "!!"]
RULES = [("licence", ["license", "licensed"]), ("contact", ["@", "http"]), ("shouting", ["!!"]), ("table", [" | "])]


@query("select doc_id, " + " or ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in TOKENS) + " as relevant from documents")
def relevance_tag(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", V.relevant({"text": TOKENS}).alias("relevant"))


@query(
    "select doc_id, case " + " ".join(
        f"when {' or '.join(f'''contains(lower(coalesce(text, '')), '{w}')''' for w in ws)} then '{label}'" for label,
        ws in RULES
    ) + " else 'other' end as topic from documents"
)
def topic_rules(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", V.first_rule(c("text"), RULES, "other").alias("topic"))


@query(
    """
    select key, count(*) as n, sum(value)::bigint as total from (select unnest(json_keys(props)) as key, json_extract(props,
        '$.k')::bigint as value from events) group by 1
    """
)
def json_explode(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select(F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(
    r"select page_id, href, count(*) as n from (select page_id, unnest(regexp_extract_all(coalesce(html, ''), '<a [^>]*href=\"([^\"]*)\"', 1)) as href from pages) group by 1, 2"
)
def page_links(spark, sf_dir):
    return flatten.page_links(t(spark, sf_dir, "pages"), "page_id", "html")


@query(r"""
with r as (select page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?is)(<p\b.*?</p>)', 1)) as row from pages),
x as (select page_id, row, regexp_extract(row, '(\d{3,})', 1) as id from r)
select page_id, id, trim(regexp_replace(regexp_replace(regexp_extract(row, '(?is)<a\b[^>]*>(.*?)</a>', 1), '<[^>]*>', ' ', 'g'), '\s+',
       ' ', 'g')) as title,
       regexp_extract(row, '(?is)<a\b[^>]*href=["'']([^"'']*)', 1) as href from x where id <> ''
""")
def page_ids(spark, sf_dir):
    """Paragraphs that hold a number stand for the rows of a registry's result pages."""
    return flatten.page_rows(t(spark, sf_dir, "pages"), "page_id", "html", r"\d{3,}", "p")


# Names and linkage


@query(r"""
select c_custkey, lower(trim(regexp_replace(regexp_replace(regexp_replace('Dr. ' || replace(c_name, '#', ' ') || ', PhD', '^([^,]*),(.*)$',
       '\2 \1'), '(?i)\bPhD\b\.?', '', 'g'), '[.()\s]+', ' ', 'g'))) as norm from customer
""")
def name_normalise(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(
        "c_custkey",
        N.normalise_name(
            F.concat(F.lit("Dr. "), F.replace(c("c_name"), F.lit("#"), F.lit(" ")), F.lit(", PhD"))
        ).alias("norm")
    )


def distinct_pairs(spark, sf_dir) -> DataFrame:
    """Blocked pairs of distinct part names: the pairs grow with the names, not with the rows."""
    d = linkage.prepared(t(spark, sf_dir, "part").select("p_name").distinct(), "p_name").select("norm", "last").distinct()
    return d.select(c("norm").alias("a"), "last").join(d.select(c("norm").alias("b"), "last"), "last").where("a < b").drop("last")


def _lcs_sql(a: str, b: str) -> str:
    row = f"list_reduce(range(1, length({b}) + 1), lambda acc, j: list_append(acc, case when substr({b}, j::int, 1) = ch then row[j] + 1 else greatest(row[j + 1], acc[-1]) end), [0::bigint])"
    return f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: substr({a}, i::int, 1)), lambda row, ch: {row}, list_transform(range(0, length({b}) + 1), lambda z: 0::bigint))[-1]"


def _ratio_sql(a: str, b: str) -> str:
    return f"200.0 * {_lcs_sql(a, b)} / (length({a}) + length({b}))"


NAME_PAIRS = """
with d as (select distinct lower(p_name) as norm, string_split(lower(p_name), ' ')[-1] as last,
       array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') as s from part)
select x.norm as a, y.norm as b, x.s as sa, y.s as sb from d x join d y on x.last = y.last and x.norm < y.norm
"""


@query(f"select a, b, {_ratio_sql('a', 'b')} as ratio, {_ratio_sql('sa', 'sb')} as sorted from ({NAME_PAIRS})", ("ratio", "sorted"))
def name_ratios(spark, sf_dir):
    p = distinct_pairs(spark, sf_dir)
    return p.select("a", "b", S.ratio(c("a"), c("b")).alias("ratio"), S.token_sort_ratio(c("a"), c("b")).alias("sorted"))


def _sets_sql(pairs: str, keep: str) -> str:
    """Token-set ratios of the columns a and b of pairs, which have single spaces between words; `keep` are other columns."""
    words = "string_split({}, ' ')"
    only = lambda x, y: f"array_to_string(list_sort(list_distinct(list_filter({words.format(x)}, lambda w: not list_contains({words.format(y)}, w)))), ' ')"
    return f"""
    (select {keep}, case when sh <> '' and (l = '' or r = '') then 100.0 when sh <> '' then greatest({_ratio_sql('ia', 'ib')},
         {_ratio_sql('sh', 'ia')}, {_ratio_sql('sh', 'ib')}) else {_ratio_sql('ia', 'ib')} end as sets
     from (select *, trim(sh || ' ' || l) as ia, trim(sh || ' ' || r) as ib from
           (select *, array_to_string(list_sort(list_intersect({words.format('a')}, {words.format('b')})), ' ') as sh, {only('a', 'b')} as l, {only('b', 'a')} as r from ({pairs}))))"""


SHORT, LONG = "case when length(a) <= length(b) then a else b end", "case when length(a) <= length(b) then b else a end"
PARTIAL = f"""(select a, b, list_max(list_transform(range(1, length(y) - length(x) + 2), lambda p: {_ratio_sql('x', 'substr(y, p::int, length(x))')})) as partial from (select a, b, {SHORT} as x, {LONG} as y from ({NAME_PAIRS})))"""
FUZZY = f"""
with l as (select distinct lower(p_name) as a from part where p_size <= 25), r as (select distinct lower(p_name) as b from part
       where p_size > 25),
p as (select a, b from l join r on string_split(a, ' ')[-1] = string_split(b, ' ')[-1] where a not in (select b from r))
select a as left_norm, a as right_norm, 100.0 as score from l where a in (select b from r) union all select a, b, sets
       from {_sets_sql('select * from p', 'a, b')} where sets >= 80
"""


@query(FUZZY, ("score",))
def fuzzy_matches(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    left = p.where("p_size <= 25").select("p_name")
    return linkage.fuzzy_matches(left, p.where("p_size > 25").select("p_name"), "p_name", "p_name", 80)


@query(
    f"""
    select a, b, {_ratio_sql('a', 'b')} as ratio, {_ratio_sql('sa', 'sb')} as sorted, sets, partial
        from {_sets_sql(NAME_PAIRS, 'a, b, sa, sb')} join {PARTIAL} using (a, b)
    """,
    ("ratio", "sorted", "sets", "partial")
)
def fuzzy_pairs(spark, sf_dir):
    p = distinct_pairs(spark, sf_dir)
    return p.select(
        "a", "b", S.ratio(c("a"), c("b")).alias("ratio"), S.token_sort_ratio(c("a"), c("b")).alias("sorted"),
        S.token_set_ratio(c("a"), c("b")).alias("sets"), S.partial_ratio(c("a"), c("b")).alias("partial")
    )


def pairs_to_link(spark, sf_dir) -> DataFrame:
    """Part names (members) and the distinct names (author records, with metrics), blocked by last word."""
    p = t(spark, sf_dir, "part")
    rec = p.groupBy("p_name").agg(
        F.min("p_partkey").alias("id"), F.count("*").alias("works"), F.max("p_size").alias("h"),
        F.min("p_type").alias("topic"), (F.min("p_size") <= 3).alias("is_local")
    )
    rec = rec.withColumn("source_rank", F.lit(0))
    m = p.groupBy("p_name").agg(F.min("p_brand").alias("state")).select(F.concat(F.lit("Dr "), c("p_name")).alias("name"), "state")
    pairs = linkage.candidates(m, rec, "name", "p_name", None)
    none = F.array().cast("array<string>")
    return pairs.select(
        c("m_name").alias("member"), "m_norm", "a_norm", c("a_id").alias("id"), c("a_source_rank").alias("rank"),
        c("a_is_local").alias("now_local"), c("a_is_local").alias("ever_local"), F.lit(False).alias("in_catalog"),
        F.lit(False).alias("in_state"), F.lit(False).alias("in_hospital"), F.array(F.lower("a_topic")).alias("labels"),
        none.alias("concepts"), c("a_works").alias("works"), c("a_h").alias("h"), F.lit(False).alias("known")
    )


LINK_PAIRS = """
m as (select p_name as name, lower(p_name) as a from part group by 1),
r as (select min(p_partkey) as id, count(*) as works, max(p_size) as h, contains(lower(min(p_type)), 'brass') as topic,
     min(p_size) <= 3 as here, lower(p_name) as b from part group by p_name),
pr as (select 'Dr ' || name as member, id, works, h, topic, here, a, b, a = b as exact, array_to_string(list_sort(string_split(a, ' ')),
     ' ') as sa, array_to_string(list_sort(string_split(b, ' ')), ' ') as sb
       from m join r on string_split(a, ' ')[-1] = string_split(b, ' ')[-1] and left(a, 1) = left(b, 1)),
sm as (select *, case when exact then 100.0 else {ratio} end as sim from pr)
"""
_LINK_PAIRS = LINK_PAIRS.replace("{ratio}", _ratio_sql("sa", "sb"))
_SETS = f"sets as (select member, id, case when a = b then 100.0 else sets end as sets from {_sets_sql('select * from pr', 'member, id, a, b')})"
_FEW = """
case when works > 300 and not exact then -20 when works between 1 and 50 then 8 when works between 51 and 150 then 5
    when works between 151 and 300 then 2 else 0 end
"""
_PLAIN = "case when works between 1 and 50 then 8 when works between 51 and 150 then 5 when works between 151 and 300 then 2 else 0 end"
_MANY_H = "case when h > 50 and not exact then -10 else 0 end"
_NAME = "case when exact then 40 when sim >= 92 then 30 when sim >= 80 then 15 else 0 end"
MODEL_SQL = {
    "main": f"{_NAME} + here::int * 25 + topic::int * 15 + {_FEW} + {_MANY_H}",
    "main_wide": f"{_NAME} + here::int * 25 + topic::int * 15 + {_FEW} + {_MANY_H} + (not here)::int * -30",
    "library": "case when exact then 40 when sets >= 85 then 25 else 0 end + here::int * 30 + case when works > 0 then 10 + least(20, floor(log2(works + 1))) else 0 end",
    "strict": f"{_NAME} + here::int * 25 + topic::int * 15 + {_PLAIN}",
    "loose": f"case when exact then 40 when sim >= 92 then 30 when sim >= 80 then 15 when sim >= 60 then 5 else 0 end + here::int * 25 + topic::int * 15 + {_PLAIN}",
    "graded": "case when exact then 40 when sim >= 92 then 35 when sim >= 85 then 25 when sim >= 75 then 15 else 0 end + here::int * 25 + topic::int * 10",
    "topical": "case when exact then 30 when sim >= 85 then 15 else 0 end + here::int * 50 + topic::int * 40 + least(10, works)",
}
MODEL_LEAST = {"strict": 60, "loose": 60, "graded": 75}
_SCORES = " union all ".join(
    f"select '{k}' as model, member, id, ({v})::int as total_score from sm join sets using (member, id) where sim >= {MODEL_LEAST.get(k, 0)}" for k,
    v in MODEL_SQL.items()
)
_BEST = f"""
with {_LINK_PAIRS}, {_SETS}, scores as ({_SCORES}), f as (select *, row_number() over (partition by model, member
       order by total_score desc, id) as r from scores),
x as (select member, id, total_score, 'HIGH' as tier, 1 as pass_no from f where model = 'main' and r = 1 and total_score >= 110)
select * from x union all select member, id, total_score, case when total_score >= 100 then 'HIGH'
       when total_score >= 60 then 'REVIEW' else 'NOT_FOUND' end, 2 from f
       where model = 'main_wide' and r = 1 and member not in (select member from x)
"""


@query(_BEST)
def link_best(spark, sf_dir):
    pairs = pairs_to_link(spark, sf_dir)
    out = linkage.resolved(
        linkage.scored(pairs, linkage.MODELS["main"], ["brass"]),
        linkage.scored(pairs, linkage.MODELS["main_wide"], ["brass"]), "member", "rank", "id"
    )
    return out.select("member", "id", "total_score", "tier", "pass_no")


@query(f"with {_LINK_PAIRS}, {_SETS} {_SCORES}")
def score_models(spark, sf_dir):
    pairs = pairs_to_link(spark, sf_dir)
    out = None
    for name, rules in linkage.MODELS.items():
        one = linkage.scored(pairs, rules, ["brass"]).select(F.lit(name).alias("model"), "member", "id", "total_score")
        out = one if out is None else out.unionByName(one)
    return out


VETO_TYPES = "case when p_size % 4 = 0 then null else [lower(p_type)] end"


@query("""
with x as (select p_partkey, p_size > 25 as proven, p_brand in ('Brand#11', 'Brand#12') as ever_local, p_size * 2 as works,
       lower(p_type) as label from part)
select p_partkey, case when proven and not ever_local then 'no_local_affiliation' when works > 20 and not contains(label,
       'brass') then 'no_topic_in_prolific_profile'
       when (contains(label, 'steel') or contains(label, 'tin')) and not contains(label, 'brass') then 'wrong_specialty' end as reason
            from x
""")
def veto_cascade(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        linkage.veto(
            c("p_size") > 25, c("p_brand").isin("Brand#11", "Brand#12"), c("p_size") * 2, F.array(F.lower("p_type")),
            ["brass"], ["steel", "tin"]
        ).alias("reason")
    )


@query("""
with x as (select p_partkey, p_size * 3 as works, (contains(lower(p_type), 'brass'))::int as have from part)
select p_partkey, case when have < least(case when works <= 50 then 1 when works <= 100 then 2 else 3 end,
       1) and have = 0 then 'too_few_topics' end as reason,
       works <= 5 or have >= greatest(1, floor(works / 20)) as ratio_ok, case when works <= 20 or have >= 3 then 'verified'
            when have >= 1 then 'borderline' else 'clear' end as class from x
""")
def proportional_veto(spark, sf_dir):
    p = t(spark, sf_dir, "part").withColumn("labels", F.array(F.lower("p_type"))).withColumn("works", c("p_size") * 3)
    return p.select(
        "p_partkey", linkage.proportional_veto(c("works"), c("labels"), ["brass"], ["steel"]).alias("reason"),
        linkage.ratio_check(c("works"), V.count_on(c("labels"), ["brass"])).alias("ratio_ok"),
        linkage.topic_class(c("works"), c("labels"), ["brass"]).alias("class")
    )


@query("""
with x as (select o_orderkey as k, o_custkey as id, o_totalprice / 500 as works, o_orderpriority = '1-URGENT' as exact,
       o_orderstatus <> 'P' as ever_local, case when o_orderstatus = 'F' then 'HIGH' else 'REVIEW' end as tier,
       count(*) over (partition by o_custkey) > 1 as dup from orders)
select k, array_to_string(list_filter([case when dup then 'shared_id' end, case
       when works > 300 and not exact then 'volume_without_exact_name' end, case when not ever_local then 'no_local_history' end],
       lambda z: z is not null), ';') as audit_reason,
       case when tier = 'HIGH' and (dup or (works > 300 and not exact) or not ever_local) then 'REVIEW' else tier end as tier from x
""")
def linkage_audit(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("k"), c("o_custkey").alias("id"), (c("o_totalprice") / 500).alias("works"),
        (c("o_orderpriority") == "1-URGENT").alias("exact"), (c("o_orderstatus") != "P").alias("ever_local"),
        F.when(c("o_orderstatus") == "F", "HIGH").otherwise("REVIEW").alias("tier")
    )
    return linkage.audited(o, "k", "id").select("k", "audit_reason", "tier")


@query("""
with x as (select o_custkey as name, o_orderkey as id, o_orderstatus <> 'P' and o_totalprice > 100000 as match,
       o_totalprice / 400000 as conf from orders),
j as (select c_custkey as name, case when c_acctbal > 0 then c_custkey end as author, (select max_by(x.match, x.id) from x
     where x.name = c_custkey) as match, (select max_by(conf, x.id) from x where x.name = c_custkey) as conf, exists (select 1 from x
     where x.name = c_custkey) as given from customer)
select name, case when author is null then 'NOT_FOUND' when not given then 'REVIEW' when not coalesce(match, false) then 'NOT_FOUND'
       when conf >= 0.85 then 'HIGH' else 'REVIEW' end as tier,
       case when given and coalesce(match, false) and conf >= 0.85 then 30 when given and coalesce(match,
            false) and conf >= 0.65 then 15 else 0 end as score_verdict from j
""")
def verdict_rules(spark, sf_dir):
    o = t(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("name")).agg(
        F.max(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")).alias("x")
    )
    v = o.select(
        "name", (F.when(c("x.o_orderstatus") != "P", c("x.o_totalprice") > 100000)).alias("match"),
        (c("x.o_totalprice") / 400000).alias("confidence"), F.lit(True).alias("consistent"),
        F.array().cast("array<string>").alias("flags")
    )
    v = v.withColumn("match", F.coalesce("match", F.lit(False)))
    links = t(spark, sf_dir, "customer").select(
        c("c_custkey").alias("name"), F.when(c("c_acctbal") > 0, c("c_custkey")).alias("author"),
        F.lit("REVIEW").alias("tier"), F.array().cast("array<string>").alias("flags")
    )
    return linkage.judged(links, v, "name", "author").select("name", "tier", "score_verdict")


@query("""
with x as (select p_partkey, lower(p_name) as norm, string_split(lower(p_name), ' ') as w, p_size > 10 as ok from part),
       n as (select w[-1] as last, count(*) as n from x group by 1)
select p_partkey, (case when n >= 3 then 3 when n = 2 then 1 else 0 end + case when length(array_to_string(w[:-2],
       ' ')) <= 3 then 2 else 0 end)::int as risk from x join n on w[-1] = last
where ok and case when n >= 3 then 3 when n = 2 then 1 else 0 end + case when length(array_to_string(w[:-2],
     ' ')) <= 3 then 2 else 0 end >= 3
""")
def common_names(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", "p_name", (c("p_size") > 10).alias("ok"))
    return linkage.common_names(p, "p_name", "ok", []).select("p_partkey", "risk")


# Members


@query(
    """
    select c_custkey, c_name, coalesce(n_name, 'Unknown') as n_name from customer left join (select * from nation
        where n_regionkey <> 0) on c_nationkey = n_nationkey
    """
)
def state_of_member(spark, sf_dir):
    n = t(spark, sf_dir, "nation").where("n_regionkey <> 0").select(c("n_nationkey").alias("c_nationkey"), "n_name")
    return members.mapped(t(spark, sf_dir, "customer"), "c_nationkey", n, "n_name").select("c_custkey", "c_name", "n_name")


@query(
    """
    select c_custkey, case when c_custkey % 3 = 0 then 'Prof ' || c_name
        when c_custkey % 5 = 0 then 'Dr ' || c_name else c_name end as new_name from customer
    """
)
def retitled_members(spark, sf_dir):
    cust = t(spark, sf_dir, "customer")
    found = cust.where("c_custkey % 3 = 0 or c_custkey % 5 = 0").select("c_name", F.lit("Dr").alias("title"))
    manual = cust.where("c_custkey % 3 = 0").select("c_name", F.lit("Prof").alias("title"))
    return members.retitled(cust, found, "c_name", manual).select("c_custkey", "new_name")


@query(
    """
    select o_orderkey, o_custkey, case when o_orderstatus = 'F' and exists (select 1 from supplier
        where s_suppkey = o_custkey) then 'REVIEW' when o_orderstatus = 'F' then 'HIGH' else 'LOW' end as tier from orders
    """
)
def demoted_links(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", c("o_custkey"), F.when(c("o_orderstatus") == "F", "HIGH").otherwise("LOW").alias("tier"))
    listed = o.join(t(spark, sf_dir, "supplier"), c("o_custkey") == c("s_suppkey")).select(c("o_orderkey").alias("name"), c("o_custkey").alias("id"))
    return members.demoted(o, listed, listed.limit(0), "o_orderkey", "o_custkey")[0]


@query("""
select p_partkey, 40 + case when p_size > 25 then 20 else 0 end + case when p_size % 2 = 0 then 25 else 0 end + case when contains(p_type,
       'BRASS') then 15 else 0 end + case when p_size between 5 and 500 then 10 else 0 end + case
       when p_size >= 10 then 5 else 0 end as contained,
       case when p_size % 3 = 0 then 0 when p_size % 2 <> 0 and not contains(p_type, 'BRASS') then 0 else 40 + case
            when p_size > 25 then 30 else 0 end + case when p_size % 2 = 0 then 25 else 15 end + case when p_size >= 20 then 5
            when p_size >= 5 then 2 else 0 end end as first_last
from part
""")
def score_variants(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(
        "p_partkey", "p_size", c("p_type").contains("BRASS").alias("on"), (c("p_size") % 2 == 0).alias("now"),
        (c("p_size") % 3 != 0).alias("ever")
    )
    p = p.withColumn(
        "member", F.when(c("p_size") > 25, "Dr Ann Lee").otherwise("Dr Zoe Lee")
    ).withColumn("first", F.when(c("p_size") > 25, "Ann").otherwise("Zoe"))
    return p.select(
        "p_partkey",
        members.score_contained(
            c("member"), F.lit("A. Lee"), c("now"), c("on"), c("p_size"), c("p_size")
        ).alias("contained"),
        members.score_first_last(
            c("first"), F.lit("Lee"), F.lit("A. Lee"), c("ever"), c("now"), c("on").cast("int"), c("p_size")
        ).alias("first_last")
    )


@query(
    """
    select o_custkey as member, o_orderkey as text, o_totalprice from (select *, row_number() over (partition by o_custkey
        order by o_totalprice desc, o_orderkey) as r from orders) where r = 1 and o_totalprice >= 45
    """
)
def accepted_variants(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(c("o_custkey").alias("member"), c("o_orderkey").alias("text"), "o_totalprice", F.lit(0).alias("rank"))
    return members.accepted_variant(o, "topical", "member", "o_totalprice", "rank", "text").drop("rank")


# Merges

@query(
    """
    select * from (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderkey) as r
        from orders) where r = 1 and o_custkey not in (select s_suppkey from supplier)
    """
)
def keyed_append(spark, sf_dir):
    new = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    have = t(spark, sf_dir, "supplier").select(c("s_suppkey").alias("o_custkey"))
    return merge.new_rows(new, have, ["o_custkey"], ["o_orderkey"]).withColumn("r", F.lit(1))


@query(
    """
    select coalesce(c_custkey, s_suppkey + 1000) as c_custkey, case when s_suppkey is null then c_name else s_name end as c_name, case
        when s_suppkey is null then c_acctbal else s_acctbal end as c_acctbal from customer full
        join supplier on c_custkey = s_suppkey + 1000
    """
)
def keyed_upsert(spark, sf_dir):
    base = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    upd = t(spark, sf_dir, "supplier").select(
        (c("s_suppkey") + 1000).alias("c_custkey"), c("s_name").alias("c_name"), c("s_acctbal").alias("c_acctbal")
    )
    return merge.upsert(base, upd, ["c_custkey"], ["c_name", "c_acctbal"])


@query(
    """
    select 'orders' as table, (select count(*) from orders) as before, (select count(*) from orders where o_custkey in (select c_custkey
        from customer where c_mktsegment = 'BUILDING')) as after union all select 'customer', (select count(*) from customer),
        (select count(*) from customer where c_mktsegment = 'BUILDING')
    """
)
def purge_report(spark, sf_dir):
    cust = t(spark, sf_dir, "customer")
    keep = cust.where("c_mktsegment = 'BUILDING'")
    return merge.purge({"orders": (t(spark, sf_dir, "orders"), "o_custkey"), "customer": (cust, "c_custkey")}, keep, "c_custkey")[1]


@query(
    """
    select c_custkey, case when c_nationkey < 5 then null else c_name end as c_name, case
        when c_nationkey < 5 then 'rejected' else c_mktsegment end as c_mktsegment from customer
    """
)
def clear_matches(spark, sf_dir):
    cust = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    gone = t(spark, sf_dir, "customer").where("c_nationkey < 5")
    return merge.clear(cust, gone, ["c_custkey"], ["c_name"], {"c_mktsegment": F.lit("rejected")})


@query(
    """
    select c_custkey, case when c_acctbal < 1000 then coalesce(s_acctbal, nullif(c_acctbal, c_acctbal)) else c_acctbal end as c_acctbal,
        greatest(c_nationkey, s_nationkey) as c_nationkey from customer left join supplier on c_custkey = s_suppkey
    """
)
def fill_and_keep(spark, sf_dir):
    base = t(spark, sf_dir, "customer").select("c_custkey", F.when(c("c_acctbal") >= 1000, c("c_acctbal")).alias("c_acctbal"), "c_nationkey")
    upd = t(spark, sf_dir, "supplier").select(
        c("s_suppkey").alias("c_custkey"), c("s_acctbal").alias("c_acctbal"), c("s_nationkey").alias("c_nationkey")
    )
    return merge.keep_greatest(merge.fill_missing(base, upd, ["c_custkey"], ["c_acctbal"], False), upd, ["c_custkey"], ["c_nationkey"])


@query(
    """
    select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r
        from events) where r = 1
    """
)
def last_decision(spark, sf_dir):
    return merge.last_by(t(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("select o_orderkey, o_custkey, o_totalprice from orders")
def append_twice(spark, sf_dir):
    """Orders sent to a table in two batches that overlap, the second one twice."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    path = shared(spark)
    for part in (o.where("o_orderstatus <> 'O'"), o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus <> 'F'")):
        tables.append_new(part, path, ["o_orderkey"])
    return spark.read.parquet(path)


@query("""
select 'orders' as gate, (select count(*) from orders)::double as observed, '>= 300' as rule, (select count(*) from orders) >= 300 as pass
union all select 'known customers', (select count(*) from orders where o_custkey not in (select c_custkey from customer))::double, '<= 0',
     (select count(*) from orders where o_custkey not in (select c_custkey from customer)) <= 0
union all select 'no early orders', (select count_if(year(o_orderdate) < 1996) from orders)::double, '<= 0',
     (select count_if(year(o_orderdate) < 1996) from orders) <= 0
union all select 'buyers', (select count(distinct o_custkey) from orders)::double, '>= 50', (select count(distinct o_custkey)
     from orders) >= 50
""")
def quality_gates(spark, sf_dir):
    o, cust = t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer")
    return gates.report(
        gates.at_least(o, "orders", 300),
        gates.only_known(o, cust.withColumnRenamed("c_custkey", "o_custkey"), "known customers", "o_custkey"),
        gates.none_where(o, "no early orders", F.year("o_orderdate") < 1996),
        gates.distinct_at_least(o, "buyers", "o_custkey", 50)
    )


@query(
    """
    select 'members' as section, row_number() over (order by n desc, name) as place, name || ': ' || format('{:,}', n) as line
        from (select c_mktsegment as name, count(*) as n from customer group by 1) union all select 'topics',
        row_number() over (order by n desc, name), name || ': ' || format('{:,}', n) from (select p_type as name, count(*) as n from part
        group by 1) union all select 'states', row_number() over (order by n desc, name), name || ': ' || format('{:,}', n)
        from (select o_orderstatus as name, count(*) as n from orders group by 1) union all select 'figures',
        row_number() over (order by n desc, name), name || ': ' || format('{:,}', n) from (select 'customers' as name, count(*) as n
        from customer union all select 'orders', count(*) from orders)
    """
)
def snapshot_report(spark, sf_dir):
    count = lambda name, col: t(spark, sf_dir, name).groupBy(c(col).alias("name")).agg(F.count("*").alias("n"))
    figures = t(spark, sf_dir, "customer").agg(F.count("*").alias("customers")).join(t(spark, sf_dir, "orders").agg(F.count("*").alias("orders")))
    return cohort.snapshot(figures, count("customer", "c_mktsegment"), count("part", "p_type"), count("orders", "o_orderstatus"))


TFIDF = r"""
with x as (select 'd' || doc_id as k, text from documents union all select 'b' || item_id, text from benchmark),
w as (select k, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda z: length(z) >= 2) as w from x),
t as (select k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from w),
tf as (select k, term, count(*) as tf from t group by 1, 2),
d as (select term, 1 + ln((1 + (select count(*) from x)) / (1 + count(*))) as idf from tf group by 1),
r as (select k, term, (1 + ln(tf)) * idf as x from tf join d using (term)),
v as (select r.k, term, x / norm as weight from r join (select k, sqrt(sum(x * x)) as norm from r group by 1) n on n.k = r.k),
c as (select i.k as item, o.k as doc, sum(i.weight * o.weight) as cosine from v i join v o using (term)
     where i.k like 'b%' and o.k like 'd%' group by 1, 2)
select item, doc, cosine, case when cosine >= 0.35 then 15 else 8 end as points from c where cosine >= 0.20
"""


@query(TFIDF, ("cosine",))
def tfidf_similarity(spark, sf_dir):
    """All pairs of a benchmark item and a document with a cosine of 0.20 or more, the least that gives points."""
    docs = t(spark, sf_dir, "documents").select(F.concat(F.lit("d"), c("doc_id")).alias("k"), "text")
    items = t(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), c("item_id")).alias("k"), "text")
    pairs = corpus_weights.alike(corpus_weights.shared_vectors(items, docs, "k", "text", shared(spark)), "item", "doc", 0.20)
    return pairs.withColumn("points", similar_texts.points(c("cosine")))
