"""Listing queries over orders, customers, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.operators import listing as L
from weftline.operators.ordering import ranked
from weftline.plans.base import Tables, query

#: The moment that counts as now, so that results don't change.
NOW = "2024-01-15 08:00:00"


def orders(t: Tables) -> DataFrame:
    """Orders as listed projects: updated when ordered, with a deadline unless they are finished."""
    rows = t.orders.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.withColumn("deadline", F.when(F.col("o_orderstatus") != "F", F.date_add("o_orderdate", 30)))


@query("select o_orderkey, o_orderstatus, o_orderpriority, c_mktsegment from orders join customer on c_custkey = o_custkey where o_orderstatus in ('O', 'P') and o_orderpriority = '1-URGENT' and c_mktsegment in ('BUILDING', 'MACHINERY')")
def faceted_listing(t: Tables) -> DataFrame:
    chosen = {"o_orderstatus": ["O", "P"], "o_orderpriority": ["1-URGENT"], "c_mktsegment": ["BUILDING", "MACHINERY"], "o_custkey": ["all"]}
    return L.faceted(orders(t), chosen).select("o_orderkey", "o_orderstatus", "o_orderpriority", "c_mktsegment")


@query("select c_custkey, c_mktsegment from customer where c_mktsegment in ('AUTOMOBILE', 'MACHINERY', 'FURNITURE')")
def code_groups(t: Tables) -> DataFrame:
    groups = {"industry": ["AUTOMOBILE", "MACHINERY"]}
    return L.faceted(t.customer, {"c_mktsegment": ["industry", "FURNITURE"]}, groups).select("c_custkey", "c_mktsegment")


@query("select o_orderkey, o_custkey from orders left join (select * from customer where c_acctbal > 0) on c_custkey = o_custkey where c_mktsegment is null or c_mktsegment = 'BUILDING'")
def unknown_facet(t: Tables) -> DataFrame:
    """Orders of customers in one segment, or whose segment isn't known because the customer is in debt."""
    rows = t.orders.join(t.customer.where("c_acctbal > 0").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return L.faceted(rows, {"c_mktsegment": ["unknown", "BUILDING"]}).select("o_orderkey", "o_custkey")


@query("select p_partkey, p_name, p_type from part where contains(p_name, 'ring') or contains(p_type, 'ring')")
def substring_search(t: Tables) -> DataFrame:
    return L.search(t.part, ["p_name", "p_type"], "ring").select("p_partkey", "p_name", "p_type")


@query("select o_orderkey, o_orderdate from orders where o_orderdate >= timestamp '2000-03-01 00:00:00'")
def updated_since(t: Tables) -> DataFrame:
    moment = F.lit("2000-03-01T08:00:00+08:00").cast("timestamp").cast("timestamp_ntz")
    return L.updated_since(t.orders, "o_orderdate", moment).select("o_orderkey", "o_orderdate")


def campus(t: Tables) -> DataFrame:
    """Events as intervals of ``value`` minutes; those of type signup have no known time."""
    start = F.when(F.col("event_type") != "signup", F.col("ts").cast("timestamp"))
    micros = F.round(F.col("value") * 60_000_000).cast("long")
    return t.events.select("event_id", "event_type", "user_id", start.alias("start_at"), F.timestamp_micros(F.unix_micros(start) + micros).alias("end_at"))


_CAMPUS = "select event_id, event_type, user_id, case when event_type <> 'signup' then ts end as start_at, case when event_type <> 'signup' then ts + to_microseconds(round(value * 60000000)::bigint) end as end_at from events"


@query(f"select event_id from ({_CAMPUS}) where start_at < timestamp '2024-01-11 16:00:00' and end_at >= timestamp '2024-01-10 16:00:00'")
def events_on_day(t: Tables) -> DataFrame:
    return L.time_filter(campus(t), F.col("start_at"), F.col("end_at"), F.lit(NOW).cast("timestamp"), date="2024-01-11").select("event_id")


@query(f"select event_id from ({_CAMPUS}) where start_at < timestamp '2024-01-21 16:00:00' and end_at >= timestamp '2024-01-14 16:00:00'")
def events_next7(t: Tables) -> DataFrame:
    return L.time_filter(campus(t), F.col("start_at"), F.col("end_at"), F.lit(NOW).cast("timestamp"), time_range="next7").select("event_id")


@query("select o_orderkey, o_custkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 45 and l_returnflag = 'R')")
def same_child_match(t: Tables) -> DataFrame:
    return L.same_child(t.orders, t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), F.col("l_quantity") > 45, F.col("l_returnflag") == "R").select("o_orderkey", "o_custkey")


@query("select 'o_orderstatus' as dimension, o_orderstatus as value, count(*) as n from orders group by 2 union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by 2 union all select 'c_mktsegment', c_mktsegment, count(*) from orders join customer on c_custkey = o_custkey group by 2")
def facet_dictionary(t: Tables) -> DataFrame:
    return L.facets(orders(t), ["o_orderstatus", "o_orderpriority", "c_mktsegment"])


@query("select o_orderkey, row_number() over (order by case when o_orderstatus <> 'F' then o_orderdate + interval 30 day end nulls last, o_orderkey) as rank from orders")
def sort_deadline(t: Tables) -> DataFrame:
    return ranked(orders(t).select("o_orderkey", "deadline"), [F.col("deadline").isNull(), F.col("deadline"), F.col("o_orderkey")], "rank").select("o_orderkey", "rank")


@query(f"select event_id, row_number() over (order by case when start_at is null then 2 when start_at > timestamp '{NOW}' then 0 when end_at >= timestamp '{NOW}' then 1 else 3 end, start_at nulls first, event_id) as rank from ({_CAMPUS})")
def event_ranking(t: Tables) -> DataFrame:
    """To come, going on, unknown, over; then by start; then by id."""
    group = L.event_rank(F.col("start_at"), F.col("end_at"), F.lit(NOW).cast("timestamp"))
    return ranked(campus(t), [group, F.col("start_at"), F.col("event_id")], "rank").select("event_id", "rank")


@query("select o_orderkey, o_orderdate from orders where o_orderstatus = 'P' order by o_orderdate desc, o_orderkey limit 20 offset 40")
def page_listing(t: Tables) -> DataFrame:
    """The third page of pending orders, newest first."""
    rows = L.faceted(orders(t), {"o_orderstatus": ["P"]})
    return L.page(rows, L.listing_order("updated", "o_orderdate", "deadline", "o_orderkey"), number=3).select("o_orderkey", "o_orderdate")


@query("select count(*) as total, 3 as page, 20 as page_size, count(*) > 60 as has_more from orders where o_orderstatus = 'P'")
def page_totals(t: Tables) -> DataFrame:
    return L.page_totals(L.faceted(orders(t), {"o_orderstatus": ["P"]}), number=3)
