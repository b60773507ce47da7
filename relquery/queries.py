"""One query for each operator over the standard tables, with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquery.functions import expressions as ex
from relquery.functions import names as nm
from relquery.operators.writes import Raw
from relquery.query import Query
from relquery.session import Session
from relquery.sources.tables import csv_text, xml_text

Run = Callable[[SparkSession, str], DataFrame]
_RUNS: dict[str, Run] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a session as a query under its own name."""

    def add(f: Callable[[Session], DataFrame | Query]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made = f(Session(spark, folder=sf_dir))
            return made.to_df() if isinstance(made, Query) else made

        name = f.__name__.removesuffix("_")
        _RUNS[name] = run
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Run]:
    return dict(_RUNS)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _one_row(s: Session, **values: object) -> DataFrame:
    return s.spark.createDataFrame([tuple(values.values())], list(values))


def flagship(s: Session) -> Query:
    """Customers of a segment with five orders or more, with their number of orders; the ten with most."""
    return (
        s.query_on("customer")
        .select("c_custkey, c_name")
        .with_count("orders", "o_custkey", "c_custkey")
        .where("c_mktsegment", "BUILDING")
        .where_has("orders", "o_custkey", "c_custkey", op=">=", n=5)
        .order_by("orders_count DESC, c_custkey")
        .limit(10)
    )


@query("select c_custkey, c_name, n orders_count from customer join (select o_custkey, count(*) n from orders group by o_custkey) on o_custkey = c_custkey where c_mktsegment = 'BUILDING' and n >= 5 order by n desc, c_custkey limit 10")
def busiest_customers(s):
    return flagship(s)


# ---------------------------------------------------------------- projection and sources


@query("select o_orderkey, o_totalprice from orders")
def select_cols(s):
    return s.query_on("orders").select("o_orderkey").add_select(["o_totalprice"])


@query("select round(sum(o_totalprice),2) s, round(avg(o_totalprice),4) a, min(o_totalprice) mn, max(o_totalprice) mx from orders")
def select_aggs(s):
    got = s.query_on("orders").select_sum("o_totalprice", "s").select_avg("o_totalprice", "a").select_min("o_totalprice", "mn").select_max("o_totalprice", "mx").to_df()
    return got.withColumns({"s": F.round("s", 2), "a": F.round("a", 4)})


@query("select distinct l_returnflag, l_linestatus from lineitem")
def distinct(s):
    return s.query_on("lineitem").select("l_returnflag, l_linestatus").distinct()


@query("select r_name, n_name from region, nation where n_regionkey = r_regionkey")
def from_multi(s):
    return s.query_on("region, nation").select("r_name, n_name").where("n_regionkey = r_regionkey")


@query("select t.k, t.n from (select o_custkey k, count(*) n from orders group by o_custkey) t where t.n > 12")
def from_derived(s):
    inner = s.query_on("orders").select("o_custkey AS k, COUNT(*) AS n").group_by("o_custkey")
    return s.query_on({inner: "t"}).select("t.k, t.n").where("t.n >", 12)


# ---------------------------------------------------------------- predicates


@query("select o_orderkey from orders where o_totalprice > 200000 and o_orderstatus = 'F'")
def where_ops(s):
    return s.query_on("orders").select("o_orderkey").where("o_totalprice >", 200000).where({"o_orderstatus": "F"})


@query("select o_orderkey from orders where o_orderstatus = 'P' or o_orderpriority = '1-URGENT' and o_totalprice > 250000")
def or_where_prec(s):
    return s.query_on("orders").select("o_orderkey").where("o_orderstatus", "P").or_where("o_orderpriority", "1-URGENT").where("o_totalprice >", 250000)


@query("select n_name from nation where n_regionkey in (1,2) or n_nationkey in (0,1)")
def where_in(s):
    return s.query_on("nation").select("n_name").where_in("n_regionkey", [1, 2]).or_where_in("n_nationkey", [0, 1])


@query("select n_name from nation where n_regionkey not in (1,2) or n_nationkey not in (3,4)")
def where_not_in(s):
    return s.query_on("nation").select("n_name").where_not_in("n_regionkey", [1, 2]).or_where_not_in("n_nationkey", [3, 4])


@query("select o_orderkey from orders where o_custkey % 2 = 0 and o_custkey < 40000")
def where_in_long(s):
    return s.query_on("orders").select("o_orderkey").where_in("o_custkey", list(range(0, 40_000, 2)))


@query("select c_custkey from customer where c_mktsegment != 'BUILDING' or c_nationkey != 3")
def where_not(s):
    return s.query_on("customer").select("c_custkey").where_not("c_mktsegment", "BUILDING").or_where_not("c_nationkey", 3)


@query("select o_orderkey from orders left join lineitem on l_orderkey = o_orderkey where l_orderkey is null")
def where_null(s):
    return s.query_on("orders").select("o_orderkey").join("lineitem", "l_orderkey = o_orderkey", "left").where_null("l_orderkey")


@query("select o_orderkey, l_linenumber from orders left join lineitem on l_orderkey = o_orderkey where l_orderkey is not null and o_custkey is not null or o_orderstatus is null or o_custkey is not null")
def where_not_null(s):
    return s.query_on("orders").select("o_orderkey, l_linenumber").join("lineitem", "l_orderkey = o_orderkey", "left").where_not_null("l_orderkey").where("o_custkey !=", None).or_where_null("o_orderstatus").or_where_not_null("o_custkey")


@query("select o_orderkey from orders where o_totalprice between 1000 and 50000 or o_custkey between 1 and 3")
def where_between(s):
    return s.query_on("orders").select("o_orderkey").where_between("o_totalprice", [1000, 50000]).or_where_between("o_custkey", [1, 3])


@query("select o_orderkey from orders where o_totalprice not between 1000 and 250000 or o_custkey not between 0 and 1000")
def where_not_between(s):
    return s.query_on("orders").select("o_orderkey").where_not_between("o_totalprice", [1000, 250000]).or_where_not_between("o_custkey", [0, 1000])


@query("select p_partkey from part where p_name ilike 'red%' or p_name ilike '%bolt' and p_type not ilike '%x%' or p_name not ilike '%e%'")
def like_sides(s):
    return s.query_on("part").select("p_partkey").like("p_name", "red", "after").or_like("p_name", "bolt", "before").not_like("p_type", "x").or_not_like("p_name", "e")


@query("select p_partkey from part where (p_name ilike '%red%' or p_type ilike '%red%')")
def search(s):
    return s.query_on("part").select("p_partkey").search("red", ["p_name", "", "p_type"])


@query("select p_partkey from part where (p_name ilike '%e%' and p_type ilike '%e%')")
def search_and(s):
    return s.query_on("part").select("p_partkey").search("e", ["p_name", "p_type"], False)


@query("select o_orderkey from orders where o_orderstatus = 'O' and (o_orderpriority = '1-URGENT' or o_orderpriority = '2-HIGH' and not (o_totalprice < 100000))")
def group_nested(s):
    return s.query_on("orders").select("o_orderkey").where("o_orderstatus", "O").group(lambda q: q.where("o_orderpriority", "1-URGENT").or_where("o_orderpriority", "2-HIGH").not_group_start().where("o_totalprice <", 100000).group_end())


@query("select o_orderkey from orders where o_orderstatus = 'P' or (o_custkey < 10 and o_totalprice > 1000) or not (o_custkey > 5)")
def or_groups(s):
    return s.query_on("orders").select("o_orderkey").group(lambda q: None).where("o_orderstatus", "P").or_group(lambda q: q.where("o_custkey <", 10).where("o_totalprice >", 1000)).or_not_group_start().where("o_custkey >", 5).group_end()


@query("select c_custkey from customer where c_mktsegment = 'BUILDING' and c_acctbal > 0")
def when_unless(s):
    return s.query_on("customer").select("c_custkey").when(True, lambda q: q.where("c_mktsegment", "BUILDING")).unless(False, lambda q: q.where("c_acctbal >", 0)).when(0, lambda q: q.where("c_custkey", 0))


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 7 offset 3")
def get_where(s):
    return s.query_on().select("o_orderkey, o_orderstatus, o_totalprice").order_by("o_totalprice DESC, o_orderkey").get_where("orders", {"o_orderstatus": "F"}, 7, 3).df


# ---------------------------------------------------------------- joins


@query("select c_custkey, n_name from customer join nation on n_nationkey = c_nationkey")
def join_inner(s):
    return s.query_on("customer").select("c_custkey, n_name").join("nation", "n_nationkey = c_nationkey")


@query("select o_orderkey, l_linenumber from orders left join lineitem on l_orderkey = o_orderkey")
def join_left(s):
    return s.query_on("orders o").select("o.o_orderkey, l.l_linenumber").join("lineitem AS l", "l.l_orderkey = o.o_orderkey", "left")


@query("select o_orderkey, l_linenumber from lineitem right join orders on l_orderkey = o_orderkey")
def join_right(s):
    return s.query_on("lineitem").select("o_orderkey, l_linenumber").join("orders", "l_orderkey = o_orderkey", "right outer")


@query("select c_custkey, s_suppkey from customer full outer join supplier on s_nationkey = c_custkey")
def join_full(s):
    return s.query_on("customer").select("c_custkey, s_suppkey").join("supplier", "s_nationkey = c_custkey", "full outer")


@query("select n_nationkey, count(*) n from nation join part on p_size < n_nationkey group by n_nationkey")
def join_theta(s):
    return s.query_on("nation").select("n_nationkey, COUNT(*) AS n").join("part", "p_size < n_nationkey").group_by("n_nationkey")


@query("select k, a, b from (select o_custkey k, count(*) a from orders group by o_custkey) x join (select c_custkey k, c_acctbal b from customer) y using (k)")
def join_using(s):
    x = s.query_on("orders").select("o_custkey AS k, COUNT(*) AS a").group_by("o_custkey")
    y = s.query_on("customer").select("c_custkey AS k, c_acctbal AS b")
    return s.query_on({x: "x"}).select("k, a, b").join({y: "y"}, "k")


# ---------------------------------------------------------------- aggregation


@query("select o_custkey, count(*) n from orders group by o_custkey having count(*) > 12 or round(sum(o_totalprice),2) > 2000000")
def group_by_having(s):
    return s.query_on("orders").select("o_custkey, COUNT(*) AS n").group_by("o_custkey").having("n >", 12).or_having("round(sum(o_totalprice), 2) >", 2000000)


@query("select o_orderkey, (select count(*) from lineitem where l_orderkey = o_orderkey) lineitem_count from orders")
def with_count(s):
    return s.query_on("orders").select("o_orderkey").with_count("lineitem", "l_orderkey", "o_orderkey")


@query("select o_orderkey, (select sum(l_quantity) from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') ret_qty from orders")
def with_sum_cb(s):
    return s.query_on("orders").select("o_orderkey").with_sum({"lineitem": "ret_qty"}, "l_orderkey", "o_orderkey", "l_quantity", False, lambda q: q.where("l_returnflag", "R"))


@query("select o_orderkey, round((select sum(l_extendedprice * l_discount) from lineitem where l_orderkey = o_orderkey),4) d from orders")
def with_sum_expr(s):
    return s.query_on("orders").select("o_orderkey").with_sum({"lineitem": "d"}, "l_orderkey", "o_orderkey", "l_extendedprice * l_discount", True).to_df().withColumn("d", F.round("d", 4))


@query("select o_orderkey, round((select avg(l_quantity) from lineitem where l_orderkey = o_orderkey),4) a, (select min(l_quantity) from lineitem where l_orderkey = o_orderkey) mn, (select max(l_quantity) from lineitem where l_orderkey = o_orderkey) mx from orders")
def with_avg_min_max(s):
    q = s.query_on("orders").select("o_orderkey")
    q.with_avg({"lineitem": "a"}, "l_orderkey", "o_orderkey", "l_quantity").with_min({"lineitem": "mn"}, "l_orderkey", "o_orderkey", "l_quantity").with_max({"lineitem": "mx"}, "l_orderkey", "o_orderkey", "l_quantity")
    return q.to_df().withColumn("a", F.round("a", 4))


@query("select o_orderkey, round((select sum(l_discount) / nullif(sum(l_quantity),0) * 100 from lineitem where l_orderkey = o_orderkey),6) pct, (select count(*) + 1 from lineitem where l_orderkey = o_orderkey) n1 from orders")
def with_calculation(s):
    q = s.query_on("orders").select("o_orderkey").with_calculation({"lineitem": "pct"}, "l_orderkey", "o_orderkey", "SUM(l_discount) / SUM(l_quantity) * 100")
    return q.with_calculation({"lineitem": "n1"}, "l_orderkey", "o_orderkey", "COUNT(*) + 1").to_df().withColumn("pct", F.round("pct", 6))


@query("select c_custkey, (select cast(length(n_name) + 1 as int) from nation where n_nationkey = c_nationkey) plus from customer")
def with_calculation_row(s):
    return s.query_on("customer").select("c_custkey").with_calculation({"nation": "plus"}, "n_nationkey", "c_nationkey", "LENGTH(n_name) + 1")


@query("select o_orderkey from orders where coalesce((select sum(l_quantity) from lineitem where l_orderkey = o_orderkey),0) < 20")
def where_aggregate(s):
    return s.query_on("orders").select("o_orderkey").with_sum({"lineitem": "qty"}, "l_orderkey", "o_orderkey", "l_quantity").where_aggregate("qty <", 20).to_df().drop("qty")


@query("select o_orderkey from orders where o_orderstatus = 'P' or coalesce((select sum(l_quantity) from lineitem where l_orderkey = o_orderkey),0) between 1 and 30 and o_totalprice > 1000")
def or_where_aggregate_between(s):
    return s.query_on("orders").select("o_orderkey").with_sum({"lineitem": "qty"}, "l_orderkey", "o_orderkey", "l_quantity").where("o_orderstatus", "P").or_where_aggregate("qty BETWEEN", [1, 30]).where("o_totalprice >", 1000).to_df().drop("qty")


@query("select o_orderkey, j.n lineitem_count from orders left join (select l_orderkey, count(*) n from lineitem group by l_orderkey) j on j.l_orderkey = o_orderkey")
def join_count(s):
    return s.query_on("orders").select("o_orderkey").join_count("lineitem", "l_orderkey", "o_orderkey")


@query("select c_custkey, round(s,2) s, round(a,4) a, mn, mx from customer left join (select o_custkey, sum(o_totalprice) s, avg(o_totalprice) a, min(o_totalprice) mn, max(o_totalprice) mx from orders where o_orderstatus = 'P' group by o_custkey) j on o_custkey = c_custkey")
def join_sum_etc(s):
    partial = lambda q: q.where("o_orderstatus", "P")
    q = s.query_on("customer").select("c_custkey")
    for call, name in ((q.join_sum, "s"), (q.join_avg, "a"), (q.join_min, "mn"), (q.join_max, "mx")):
        call({"orders": name}, "o_custkey", "c_custkey", "o_totalprice", partial)
    return q.to_df().withColumns({"s": F.round("s", 2), "a": F.round("a", 4)})


@query("select c_custkey, round(r,6) r from customer left join (select o_custkey, sum(o_totalprice) / nullif(count(*),0) r from orders where o_orderstatus = 'F' group by o_custkey) j on o_custkey = c_custkey")
def join_calculation(s):
    return s.query_on("customer").select("c_custkey").join_calculation({"orders": "r"}, "o_custkey", "c_custkey", "SUM(o_totalprice) / COUNT(*)", lambda q: q.where("o_orderstatus", "F")).to_df().withColumn("r", F.round("r", 6))


@query("select c_custkey, j.n big_count from customer left join (select k, count(*) n from (select o_custkey k from orders where o_totalprice > 100000) group by k) j on j.k = c_custkey")
def join_count_derived(s):
    derived = s.query_on("orders").select("o_custkey AS k").where("o_totalprice >", 100000)
    return s.query_on("customer").select("c_custkey").join_count({derived: "big_count"}, "k", "c_custkey")


@query("select count(*) numrows from (select o_custkey from orders group by o_custkey having count(*) > 10) t")
def count_all_results(s):
    return _one_row(s, numrows=s.query_on("orders").select("o_custkey").group_by("o_custkey").having("COUNT(*) >", 10).count_all_results())


# ---------------------------------------------------------------- existence and number of related rows


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def where_exists(s):
    return s.query_on("orders").select("o_orderkey").where_exists(lambda q: q.from_("lineitem").where("lineitem.l_orderkey = orders.o_orderkey").where("l_returnflag", "R"))


@query("select o_orderkey from orders where o_orderstatus = 'P' or exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 49)")
def or_where_exists(s):
    return s.query_on("orders").select("o_orderkey").where("o_orderstatus", "P").or_where_exists_relation("lineitem", "l_orderkey", "o_orderkey", lambda q: q.where("l_quantity >", 49))


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def where_not_exists(s):
    return s.query_on("orders").select("o_orderkey").where_doesnt_have("lineitem", "l_orderkey", "o_orderkey")


@query("select o_orderkey from orders where o_orderstatus = 'P' or not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def or_where_not_exists(s):
    return s.query_on("orders").select("o_orderkey").where("o_orderstatus", "P").or_where_not_exists_relation("lineitem", "l_orderkey", "o_orderkey")


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = o_orderstatus)")
def exists_composite(s):
    return s.query_on("orders").select("o_orderkey").where_exists_relation("lineitem", ["l_orderkey", "l_linestatus"], ["o_orderkey", "o_orderstatus"])


@query("select c_custkey from customer where (select count(*) from orders where o_custkey = c_custkey) >= 12")
def where_has_count(s):
    return s.query_on("customer").select("c_custkey").where_has("orders", "o_custkey", "c_custkey", None, ">=", 12)


@query("select o_orderkey from orders where (select count(*) from lineitem where l_orderkey = o_orderkey) < 2")
def where_has_lt(s):
    return s.query_on("orders").select("o_orderkey").where_has("lineitem", "l_orderkey", "o_orderkey", "<", 2)


@query("select c_custkey from customer where c_custkey = 1 or (select count(*) from orders where o_custkey = c_custkey) >= 12 and c_mktsegment = 'BUILDING'")
def or_where_has(s):
    return s.query_on("customer").select("c_custkey").where("c_custkey", 1).or_where_has("orders", "o_custkey", "c_custkey", op=">=", n=12).where("c_mktsegment", "BUILDING")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P' and exists (select 1 from events where events.user_id = customer.c_custkey and event_type = 'error'))")
def nested_exists_two_levels(s):
    return s.query_on("customer").select("c_custkey").where_exists_relation("orders", "o_custkey", "c_custkey", lambda q: q.where("o_orderstatus", "P").where_exists_relation("events", "user_id", "customer.c_custkey", lambda e: e.where("event_type", "error")))


@query("select c_custkey from customer where (select count(*) from orders where o_custkey = c_custkey and coalesce((select sum(l_quantity) from lineitem where l_orderkey = o_orderkey),0) > 150) >= 3")
def nested_agg_in_has(s):
    return s.query_on("customer").select("c_custkey").where_has("orders", "o_custkey", "c_custkey", lambda q: q.with_sum({"lineitem": "qty"}, "l_orderkey", "o_orderkey", "l_quantity").where_aggregate("qty >", 150), ">=", 3)


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey) and (c_mktsegment = 'BUILDING' or c_mktsegment = 'MACHINERY' and ((c_acctbal > 0) and (select count(*) from orders where o_custkey = c_custkey) >= 10 or not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P'))) and c_nationkey < 20")
def kitchen_sink(s):
    key = ("orders", "o_custkey", "c_custkey")
    inner = lambda q: q.group(lambda g: g.where("c_acctbal >", 0)).where_has(*key, None, ">=", 10).or_where_doesnt_have(*key, lambda o: o.where("o_orderstatus", "P"))
    return s.query_on("customer").select("c_custkey").where_has(*key).group(lambda q: q.where("c_mktsegment", "BUILDING").or_where("c_mktsegment", "MACHINERY").group(inner)).where("c_nationkey <", 20)


# ---------------------------------------------------------------- order and pages


@query("select o_orderkey from orders order by case when o_orderpriority = '2-HIGH' then 0 when o_orderpriority = '1-URGENT' then 1 else 2 end, o_orderkey limit 50")
def order_by_sequence(s):
    return s.query_on("orders").select("o_orderkey").order_by_sequence("o_orderpriority", ["2-HIGH", "1-URGENT"]).order_by("o_orderkey").limit(50)


@query("select c_custkey from customer order by (select n_name from nation where n_nationkey = c_nationkey) desc, c_custkey limit 30")
def order_by_relation(s):
    return s.query_on("customer").select("c_custkey").order_by_relation("nation", "n_nationkey", "c_nationkey", "n_name", "DESC").order_by("c_custkey").limit(30)


@query("select o_orderkey from orders order by o_orderdate desc, o_orderkey limit 20 offset 40")
def latest_limit_offset(s):
    return s.query_on("orders").select("o_orderkey").latest("o_orderdate").order_by("o_orderkey").limit(20, 40)


@query("select o_orderkey from orders order by o_orderdate, o_orderkey limit 15")
def oldest(s):
    return s.query_on("orders").select("o_orderkey").oldest("o_orderdate").order_by("o_orderkey").limit(15)


@query("select n_nationkey from nation")
def order_by_random(s):
    """The rows in a random order: none is lost, none made (rows are compared as a set)."""
    return s.query_on("nation").select("n_nationkey").order_by("7", "RANDOM")


@query("select 20 per_page, 3 current_page, count(*) total, cast(ceil(count(*) / 20.0) as bigint) last_page from orders where o_orderstatus = 'F'")
def paginate_meta(s):
    r = s.query_on("orders").where("o_orderstatus", "F").order_by("o_orderkey").paginate(20, 3).get()
    return _one_row(s, per_page=r.per_page(), current_page=r.current_page(), total=r.found_rows(), last_page=r.last_page()).selectExpr("int(per_page)", "int(current_page)", "total", "last_page")


@query("select o_orderkey from orders where o_orderstatus = 'F' order by o_orderkey limit 20 offset 40")
def paginate_rows(s):
    return s.query_on("orders").select("o_orderkey").where("o_orderstatus", "F").order_by("o_orderkey").paginate(20, 3)


# ---------------------------------------------------------------- nested rows


@query("select o_orderkey, l_linenumber top_line from orders left join (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey) rn from lineitem) t on l_orderkey = o_orderkey and rn = 1")
def with_one(s):
    got = s.query_on("orders").select("o_orderkey").with_one({"lineitem": "top"}, "l_orderkey", "o_orderkey", lambda q: q.select("l_linenumber").order_by("l_extendedprice DESC, l_linenumber, l_partkey"))
    return got.to_df().select("o_orderkey", F.col("top.l_linenumber").alias("top_line"))


@query("select o_orderkey, count(l_orderkey) n_items, coalesce(sum(l_quantity),0) qty, string_agg(cast(l_linenumber as varchar), ',' order by l_extendedprice desc, l_linenumber) line_order from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def with_many(s):
    got = s.query_on("orders").select("o_orderkey").with_many("lineitem", "l_orderkey", "o_orderkey", lambda q: q.order_by("l_extendedprice DESC, l_linenumber")).to_df()
    lines = F.array_join(F.transform("lineitem", lambda x: x["l_linenumber"].cast("string")), ",")
    return got.select("o_orderkey", F.size("lineitem").cast("long").alias("n_items"), F.aggregate("lineitem", F.lit(0.0), lambda a, x: a + x["l_quantity"]).alias("qty"), F.when(F.size("lineitem") > 0, lines).alias("line_order"))


@query("select o_orderkey, count(l_orderkey) n from orders left join lineitem on l_orderkey = o_orderkey and l_linestatus = o_orderstatus group by o_orderkey")
def with_many_composite(s):
    got = s.query_on("orders").select("o_orderkey").with_many({"lineitem": "items"}, ["l_orderkey", "l_linestatus"], ["o_orderkey", "o_orderstatus"]).to_df()
    return got.select("o_orderkey", F.size("items").cast("long").alias("n"))


@query("select c_custkey, count(distinct o_orderkey) n_orders, count(l_orderkey) n_lines from customer left join orders on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey group by c_custkey")
def with_nested(s):
    got = s.query_on("customer").select("c_custkey").with_many("orders", "o_custkey", "c_custkey", lambda q: q.select("o_orderkey").with_many("lineitem", "l_orderkey", "o_orderkey", lambda l: l.select("l_linenumber"))).to_df()
    return got.select("c_custkey", F.size("orders").cast("long").alias("n_orders"), F.aggregate("orders", F.lit(0).cast("long"), lambda a, o: a + F.size(o["lineitem"])).alias("n_lines"))


@query("select c_custkey, o_orderkey, (select count(*) from lineitem where l_orderkey = o_orderkey) n from customer join orders on o_custkey = c_custkey")
def with_nested_agg(s):
    got = s.query_on("customer").select("c_custkey").with_many("orders", "o_custkey", "c_custkey", lambda q: q.select("o_orderkey").with_count({"lineitem": "n"}, "l_orderkey", "o_orderkey")).to_df()
    return got.select("c_custkey", F.explode("orders").alias("o")).select("c_custkey", "o.o_orderkey", "o.n")


@query("select c_custkey, o_orderkey from customer join (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rn from orders) on o_custkey = c_custkey and rn <= 2")
def with_many_limit_per_parent(s):
    got = s.query_on("customer").select("c_custkey").with_many("orders", "o_custkey", "c_custkey", lambda q: q.select("o_orderkey").order_by("o_totalprice DESC, o_orderkey").limit_per_parent(2)).to_df()
    return got.select("c_custkey", F.explode("orders.o_orderkey").alias("o_orderkey"))


@query("select n_nationkey, count(c_custkey) n from nation left join customer on c_nationkey = n_nationkey where n_regionkey = 1 group by n_nationkey")
def raw_query_with(s):
    pending = Query(s).with_many("customer", "c_nationkey", "n_nationkey")
    got = s.query("select n_nationkey from nation where n_regionkey = ?", [1], pending).df
    return got.select("n_nationkey", F.size("customer").cast("long").alias("n"))


# ---------------------------------------------------------------- results


@query("select c_nationkey, max(c_custkey) c_custkey from customer group by c_nationkey")
def key_by(s):
    keyed = s.query_on("customer").select("c_nationkey, c_custkey").order_by("c_custkey").get().key_by("c_nationkey", True)
    return s.spark.createDataFrame([(k, r["c_custkey"]) for k, r in keyed.items()], "c_nationkey int, c_custkey long")


@query("select c_custkey from customer where c_nationkey < 5")
def chunk_by_id(s):
    seen: list[int] = []
    s.query_on("customer").select("c_custkey").where("c_nationkey <", 5).chunk_by_id(200, lambda rows: seen.extend(r.c_custkey for r in rows), "c_custkey")
    return s.spark.createDataFrame([(k,) for k in seen], "c_custkey long")


@query("select cast(count(*) as bigint) done, cast(ceil(count(*) / 7.0) as bigint) calls from nation")
def chunk(s):
    calls: list[int] = []
    done = s.query_on("nation").order_by("n_nationkey").chunk(7, lambda rows: calls.append(len(rows)))
    return _one_row(s, done=done, calls=len(calls))


@query("select n_name from nation where n_regionkey = 2")
def pluck(s):
    return s.spark.createDataFrame([(v,) for v in s.query_on("nation").where("n_regionkey", 2).pluck("n_name")], "n_name string")


@query("select min(c_custkey) first_key, true any_row, true no_row, min(c_custkey) one from customer where c_mktsegment = 'BUILDING'")
def first_value_exists(s):
    q = s.query_on("customer").where("c_mktsegment", "BUILDING").order_by("c_custkey")
    return _one_row(s, first_key=q.first().c_custkey, any_row=q.exists(), no_row=s.query_on("customer").where("c_custkey <", -5).doesnt_exist(), one=q.value("c_custkey"))


@query("select cast(count(*) as bigint) total, 15 per_page, 1 f, least(15, cast(count(*) as bigint)) t, count(*) > 15 more from customer")
def pagination_array(s):
    p = s.query_on("customer").order_by("c_custkey").paginate().get().to_pagination_array()
    return _one_row(s, total=p["total"], per_page=p["per_page"], f=p["from"], t=p["to"], more=p["has_more"]).selectExpr("total", "int(per_page)", "int(f)", "t", "more")


@query("select cast(count(*) as bigint) found, 3 fetched from orders")
def calc_rows(s):
    r = s.query_on("orders").order_by("o_orderkey").calc_rows().get(limit=3)
    return _one_row(s, found=r.found_rows(), fetched=r.num_rows()).selectExpr("found", "int(fetched)")


@query("""select '"r_regionkey","r_name"' || chr(10) || string_agg('"' || r_regionkey || '","' || r_name || '"' || chr(10), '' order by r_regionkey) csv,
  '<root>' || chr(10) || string_agg(chr(9) || '<element>' || chr(10) || chr(9) || chr(9) || '<r_regionkey>' || r_regionkey || '</r_regionkey>' || chr(10)
    || chr(9) || chr(9) || '<r_name>' || r_name || '</r_name>' || chr(10) || chr(9) || '</element>' || chr(10), '' order by r_regionkey) || '</root>' || chr(10) xml from region""")
def result_text(s):
    df = s.query_on("region").order_by("r_regionkey").to_df()
    return _one_row(s, csv=csv_text(df), xml=xml_text(df))


# ---------------------------------------------------------------- writes, catalog, session


@query("select r_regionkey, r_name from region union all select 99, 'NEW' union all select 98, 'N2' union all select 97, 'N3'")
def dml_insert(s):
    s.insert("region", {"r_regionkey": 99, "r_name": "NEW"})
    s.insert_batch("region", [{"r_regionkey": 98, "r_name": "N2"}, {"r_regionkey": 97, "r_name": "N3"}])
    return s.table("region")


@query("select n_nationkey, case when n_regionkey = 1 then 'X' else n_name end n_name from nation")
def dml_update(s):
    s.update("nation", {"n_name": "X"}, {"n_regionkey": 1})
    return s.table("nation").select("n_nationkey", "n_name")


@query("select n_nationkey, case n_nationkey when 1 then 'A' when 2 then 'B' else n_name end n_name from nation")
def dml_update_batch(s):
    s.update_batch("nation", [{"n_nationkey": 1, "n_name": "A"}, {"n_nationkey": 2, "n_name": "B"}], "n_nationkey")
    return s.table("nation").select("n_nationkey", "n_name")


@query("select n_nationkey from nation where not coalesce(n_regionkey = 1, false)")
def dml_delete(s):
    s.delete("nation", {"n_regionkey": 1})
    return s.table("nation").select("n_nationkey")


@query("select n_nationkey from nation where n_nationkey not in (select n_nationkey from nation where n_regionkey = 1 order by n_nationkey limit 2)")
def dml_delete_limit(s):
    s.delete("nation", {"n_regionkey": 1}, 2)
    return s.table("nation").select("n_nationkey")


@query("select r_regionkey, r_name from region where r_regionkey <> 1 union all select 1, 'R1'")
def dml_replace(s):
    s.replace("region", {"r_regionkey": 1, "r_name": "R1"}, "r_regionkey")
    return s.table("region")


@query("select r_regionkey, upper(r_name) || '!' r_name from region")
def dml_raw(s):
    s.update("region", {"r_name": Raw("concat(upper(r_name), '!')")})
    return s.table("region")


@query("select count(*) n from region where false")
def dml_truncate(s):
    s.truncate("region")
    return _one_row(s, n=s.count_all("region"))


@query("select cast(count(*) + 1 as bigint) kept, cast(count(*) + 1 as bigint) after, 'done' value, false failed from region")
def transaction(s):
    value = s.transaction(lambda db: db.insert("region", {"r_regionkey": 50, "r_name": "T"}) and "done")
    kept = s.count_all("region")

    def fails(db):
        db.insert("region", {"r_regionkey": 51, "r_name": "U"})
        raise RuntimeError("no")

    failed = s.transaction(fails)
    return _one_row(s, kept=kept, after=s.count_all("region"), value=value, failed=failed)


@query("select 'id' name, 1 primary_key union all select 'label', 0 union all select 'extra', 0")
def forge(s):
    s.add_field("id")
    s.add_field({"label": {"type": "VARCHAR", "constraint": 40}, "old": {"type": "INT"}})
    s.create_table("made")
    s.add_column("made", {"extra": {"type": "INT", "default": 5}})
    s.drop_column("made", "old")
    s.rename_table("made", "made2")
    return s.spark.createDataFrame([(f["name"], f["primary_key"]) for f in s.field_data("made2")], "name string, primary_key int")


@query("select 5 tables, true here, 'r_regionkey' first_field, count(*) n from region")
def catalog(s):
    known = [t for t in s.list_tables() if t in ("region", "nation", "customer", "orders", "lineitem")]
    return _one_row(s, tables=len(known), here=s.table_exists("region"), first_field=s.primary("region"), n=s.count_all("region")).selectExpr("int(tables)", "here", "first_field", "n")


@query("select count(*) n, 2 queries from nation")
def query_cache(s):
    s.cache_on()
    q = s.query_on("nation")
    first, again = q.get(), q.get()
    n = again.num_rows() if first.df is again.df else -1
    s.cache_off()
    return _one_row(s, n=n, queries=s.total_queries()).selectExpr("n", "int(queries)")


# ---------------------------------------------------------------- expressions


@query("select o_orderkey, round(o_totalprice,1) r, floor(o_totalprice) f, upper(o_orderpriority) u, length(o_orderpriority) ln, replace(o_orderpriority,'-','_') rp, substring(o_orderpriority,1,1) sb, year(o_orderdate) y, coalesce(nullif(o_orderstatus,'F'),'Z') z from orders")
def expr_functions(s):
    got = s.query_on("orders").select("o_orderkey, ROUND(o_totalprice, 1) AS r, FLOOR(o_totalprice) AS f, UPPER(o_orderpriority) AS u, LENGTH(o_orderpriority) AS ln, REPLACE(o_orderpriority, '-', '_') AS rp, SUBSTRING(o_orderpriority, 1, 1) AS sb, YEAR(o_orderdate) AS y, COALESCE(NULLIF(o_orderstatus, 'F'), 'Z') AS z").to_df()
    return got.withColumns({"ln": F.col("ln").cast("long"), "y": F.col("y").cast("long"), "f": F.col("f").cast("double")})


@query("select c_custkey, (select count(distinct o_orderstatus) from orders where o_custkey = c_custkey) n, round((select sum(case when o_orderstatus = 'F' and o_totalprice > 1000 then o_totalprice else 0 end) from orders where o_custkey = c_custkey), 2) f, (select max(day(o_orderdate)) % nullif(min(day(o_orderdate)) - min(day(o_orderdate)), 0) from orders where o_custkey = c_custkey) z from customer")
def expr_calculations(s):
    q = s.query_on("customer").select("c_custkey").with_calculation({"orders": "n"}, "o_custkey", "c_custkey", "COUNT(DISTINCT o_orderstatus)")
    q.with_calculation({"orders": "f"}, "o_custkey", "c_custkey", "SUM(CASE WHEN o_orderstatus = 'F' AND o_totalprice > 1000 THEN o_totalprice ELSE 0 END)")
    q.with_calculation({"orders": "z"}, "o_custkey", "c_custkey", "MAX(DAY(o_orderdate)) % (MIN(DAY(o_orderdate)) - MIN(DAY(o_orderdate)))")
    return q.to_df().withColumns({"f": F.round("f", 2), "z": F.col("z").cast("long")})

@query("""select c_custkey, power(c_nationkey, 2) pw, round(sqrt(c_nationkey), 6) sq, c_mktsegment || '-x' cc, lower(c_mktsegment) lo, trim('  a ') tr, coalesce(nullif(c_nationkey, 3), -1) i1,
  case when c_acctbal > 0 then 'p' else 'n' end i2, ceil(c_acctbal) ce, abs(c_acctbal) ab, c_nationkey % 7 md, cast(c_nationkey as varchar) ca, cast(c_nationkey as double) cv, cast('12' as bigint) + 1 cs from customer""")
def expr_more_functions(s):
    texts = {
        "c_custkey": "c_custkey", "pw": "POW(c_nationkey, 2)", "sq": "ROUND(SQRT(c_nationkey), 6)", "cc": "CONCAT(c_mktsegment, '-', \"x\")", "lo": "LOWER(c_mktsegment)", "tr": "TRIM('  a ')", "i1": "IFNULL(NULLIF(c_nationkey, 3), -1)",
        "i2": "IF(c_acctbal > 0, 'p', 'n')", "ce": "CEIL(c_acctbal)", "ab": "ABS(c_acctbal)", "md": "MOD(c_nationkey, 7)", "ca": "CAST(c_nationkey AS CHAR)", "cv": "CONVERT(c_nationkey, DOUBLE)", "cs": "CAST('12' AS SIGNED) + 1",
    }
    q = s.query_on("customer")
    for name, text in texts.items():
        q.select(f"{ex.to_spark(text)} AS {name}", False)
    return q.to_df().withColumn("ce", F.col("ce").cast("double"))


@query("""select o_orderkey, month(o_orderdate) mo, cast(o_orderdate as date) da, hour(o_orderdate) ho, minute(o_orderdate) mi, second(o_orderdate) se, date_diff('day', date '1990-01-01', cast(o_orderdate as date)) dd,
  date_sub('month', timestamp '1990-01-01', o_orderdate) dm, true now_is_later, true today, 8 clock from orders""")
def expr_dates(s):
    texts = {
        "o_orderkey": "o_orderkey", "mo": "MONTH(o_orderdate)", "da": "DATE(o_orderdate)", "ho": "HOUR(o_orderdate)", "mi": "MINUTE(o_orderdate)", "se": "SECOND(o_orderdate)", "dd": "DATEDIFF(o_orderdate, '1990-01-01')",
        "dm": "TIMESTAMPDIFF(MONTH, CAST('1990-01-01' AS DATETIME), CAST(o_orderdate AS DATETIME))", "now_is_later": "NOW() > CAST('2020-01-01' AS DATETIME)", "today": "CURDATE() = DATE(NOW())", "clock": "LENGTH(CURTIME())",
    }
    q = s.query_on("orders")
    for name, text in texts.items():
        q.select(f"{ex.to_spark(text)} AS {name}", False)
    return q.to_df().withColumns({c: F.col(c).cast("long") for c in ("mo", "ho", "mi", "se", "dd")})


@query("select n_nationkey, case when n_regionkey in (1, 2) then 'in' else 'out' end w, n_name = 'x' same from nation")
def expr_in_and_strings(s):
    return s.query_on("nation").select("n_nationkey").select("CASE WHEN n_regionkey IN (1, 2) THEN 'in' ELSE 'out' END AS w", False).select("n_name = 'x' AS same", False)


@query("select c_custkey from customer where c_mktsegment = 'BUILDING' or (c_nationkey = 3 and c_acctbal > 0)")
def or_group_start(s):
    return s.query_on("customer").select("c_custkey").where("c_mktsegment", "BUILDING").or_group_start().where("c_nationkey", 3).where("c_acctbal >", 0).group_end()


@query("select * from region order by r_regionkey")
def select_star_and_order(s):
    return s.query_on("region").select("*").order_by("r_regionkey")


@query("select o_custkey, count(*) orders_count from orders group by o_custkey having count(*) > 10")
def process_pending(s):
    """The steps that flush pending parts may be called at any time."""
    q = s.query_on("orders").select("o_custkey, count(*) AS orders_count").group_by("o_custkey").having("count(*) >", 10)
    return q.process_aggregates().process_where_aggregates().process_join_aggregates().process_where_has().process_where_exists()


@query("select o_orderkey from orders where o_custkey % 3 = 0 or o_orderkey = 1")
def where_in_long_mixed(s):
    """A list of over ten thousand values of several types behaves as a short one."""
    most = s.table("orders").agg(F.max("o_custkey")).first()[0]
    values = [*range(0, max(most, 30_003) + 1, 3), 1.5, "x"]
    return s.query_on("orders").select("o_orderkey").where_in("o_custkey", values).or_where("o_orderkey", 1)


@query("select r_regionkey, case when r_regionkey = 1 then 'zz' else r_name end r_name from region union all select 77, 'new'")
def dml_raw_replace(s):
    s.query("REPLACE INTO region (r_regionkey, r_name) VALUES (1, 'zz'), (77, 'old'), (77, 'new')")
    return s.table("region")


@query("select n_nationkey, case when n_regionkey = 2 then upper(n_name) || '!' else n_name end n_name from nation union all select 90, 'A' union all select 91, 'B' union all select 92, 'C'")
def dml_set_queue(s):
    q = s.query_on("nation")
    q.set("n_name", "concat(upper(n_name), '!')", False).where("n_regionkey", 2).update()
    q.set({"n_nationkey": 90}).set("n_name", "A").insert("nation")
    q.set_insert_batch([{"n_nationkey": 91, "n_name": "B"}]).set_insert_batch({"n_nationkey": 92, "n_name": "x"}).insert_batch("nation")
    q.set_update_batch([{"n_nationkey": 92, "n_name": "C"}], "n_nationkey").update_batch("nation")
    return s.table("nation").select("n_nationkey", "n_name")


@query("select count(*) filter (n_regionkey = 1) updated, count(*) filter (n_nationkey in (1, 2)) batched, count(*) filter (n_regionkey = 2) deleted, 1::bigint inserted from nation")
def affected_rows(s):
    s.update("nation", {"n_name": "x"}, {"n_regionkey": 1})
    updated = s.affected_rows
    batched = s.update_batch("nation", [{"n_nationkey": k, "n_name": "y"} for k in (1, 2, -5)], "n_nationkey")
    s.delete("nation", {"n_regionkey": 2})
    deleted = s.affected_rows
    s.insert("nation", {"n_nationkey": 99})
    return _one_row(s, updated=updated, batched=batched, deleted=deleted, inserted=s.affected_rows)


@query("select r_regionkey, r_name from region where r_regionkey < 3")
def clause_cache(s):
    q = s.query_on("region").start_cache().where("r_regionkey <", 3).stop_cache().order_by("r_name")
    return q.reset_query().from_("region")


@query("select 0::bigint emptied, false there, 1::bigint named, 'bigint' kind")
def forge_more(s):
    s.empty_table("region")
    s.add_field({"id": {"type": "INT"}, "label": {"type": "VARCHAR"}})
    s.add_key("id", True)
    s.create_table("made")
    s.modify_column("made", {"id": {"type": "BIGINT", "name": "key"}})
    kind = {f["name"]: f["type"] for f in s.field_data("made")}["key"]
    named = int(s.field_exists("key", "made"))
    s.drop_table("made")
    return _one_row(s, emptied=s.count_all("region"), there=s.table_exists("made"), named=named, kind=kind)


@query("""select 'INSERT INTO t (a, b) VALUES (1, ''x'')' ins, 'UPDATE t SET a = 1 WHERE b = ''x''' upd, 'DELETE FROM t WHERE b = ''x''' del, 'SELECT a FROM t WHERE a > 3 ORDER BY a DESC LIMIT 2' sel,
  'select * from t where a = 5 and b = ''?'' and c = ''x''' binds, 'a!%b!_c!!' lik, '(1,''x'',NULL)' esc, '`t`.`a` AS `x`' pro, 'pre_t' pre, true w1, false w2""")
def compiled_text(s):
    s.tables["t"] = s.spark.createDataFrame([(1, "x")], "a int, b string")
    where = {"b": "x"}
    row = {
        "ins": s.get_compiled_insert("t", {"a": 1, "b": "x"}), "upd": s.get_compiled_update("t", {"a": 1}, where), "del": s.get_compiled_delete("t", where), "sel": s.query_on("t").select("a").where("a >", 3).order_by("a", "DESC").limit(2).get_compiled_select(),
        "binds": s.compile_binds("select * from t where a = ? and b = '?' and c = ?", [5, "x"]), "lik": s.escape_like_str("a%b_c!"), "esc": s.escape([1, "x", None]), "pro": s.protect_identifiers("t.a AS x"), "w1": s.is_write_type(" update t set a = 1"), "w2": s.is_write_type("select 1"),
    }
    s.set_dbprefix("pre_")
    return _one_row(s, **row, pre=s.dbprefix("t"))


@query("""select min(r_name) "first", max(r_name) "last", (select r_name from region order by r_name limit 1 offset 1) "next", min(r_name) previous, (select r_name from region order by r_name limit 1 offset 2) sought, 'set' changed, 2::bigint fields,
  'r_regionkey,r_name' names, min(r_name) streamed, min(r_name) made, min(r_name) nth, count(*) n from region""")
def result_cursor(s):
    class Made:
        pass

    r = s.query_on("region").order_by("r_name").get()
    got = {"first": r.first_row().r_name, "last": r.last_row("array")["r_name"], "next": r.next_row().r_name, "previous": r.previous_row().r_name, "sought": (r.data_seek(2), r.row(2))[1].r_name}
    got |= {"made": r.custom_result_object(Made)[0].r_name, "streamed": r.unbuffered_row().r_name, "nth": r.row_array(0)["r_name"], "fields": r.num_fields(), "names": ",".join(r.list_fields()), "n": len(r.result())}
    r.data_seek(0)
    r.set_row("r_name", "set")
    return _one_row(s, **got, changed=r.row_array(0)["r_name"])


@query("select count(*) + 1 committed, count(*) + 1 rolled, count(*) + 1 failed, false status, true again, false off, true active from region")
def transaction_calls(s):
    add = lambda k: s.insert("region", {"r_regionkey": k, "r_name": "t"})
    s.trans_begin()
    active = s.trans_active()
    add(50)
    s.trans_commit()
    committed = s.count_all("region")
    s.trans_begin()
    add(51)
    s.trans_rollback()
    rolled = s.count_all("region")
    s.trans_strict(False)
    s.trans_start()
    add(52)
    s.trans_fail()
    status = s.trans_status()
    s.trans_complete()
    s.trans_start()
    again = s.trans_complete()
    s.trans_off()
    return _one_row(s, committed=committed, rolled=rolled, failed=s.count_all("region"), status=status, again=again, off=s.trans_begin(), active=active)


@query("select 'a_1' ok, 3::bigint refused, 2::bigint keys, true custom, false custom_bad, true calculation, false calculation_bad, 'o' alias, true timed, 2::bigint logged, true database")
def validation_and_log(s):
    refused = sum(not nm.is_column(x) for x in ("a b", "drop", "a" * 70, "a_1", "t.a"))
    s.query_on("region").get()
    s.query("select 1 as x")
    return _one_row(
        s, ok=nm.column("a_1"), refused=refused, keys=len(nm.key_pairs(["a", "b"], ["c", "d"])[0]), custom=ex.is_custom("a * b"), custom_bad=ex.is_custom("SUM(a) OR 1=1"), calculation=ex.is_calculation("SUM(a) / COUNT(b)"), calculation_bad=ex.is_calculation("sleep(1)"),
        alias=nm.table_and_alias("orders AS o")[1], timed=s.elapsed_time() >= 0, logged=len(s.all_last_query()) if s.last_query() == "select 1 as x" else -1, database=s.database_exists("default") and "default" in s.list_databases(),
    )
