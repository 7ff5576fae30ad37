"""Queries that check records and the links between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.functions import text as T
from weftline.operators import checks as C, intervals as I, levels
from weftline.plans.base import Tables, query


@query("select event_id, event_type from events where event_type not in ('click', 'view', 'purchase')")
def domain_violations(t: Tables) -> DataFrame:
    return C.outside_domain(t.events, "event_type", ["click", "view", "purchase"]).select("event_id", "event_type")


@query("select l_orderkey, l_linenumber, l_partkey, l_discount from lineitem where l_discount is null or l_discount < 0.02 or l_discount > 0.08")
def range_violations(t: Tables) -> DataFrame:
    return C.outside_range(t.lineitem, "l_discount", 0.02, 0.08).select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")


@query("select o_orderkey, o_orderpriority from orders where o_orderstatus = 'F' and o_orderpriority in ('4-NOT SPECIFIED', '5-LOW')")
def required_when(t: Tables) -> DataFrame:
    """Finished orders need a priority; the two lowest count as none."""
    rows = t.orders.withColumn("stated", F.when(~F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW"), F.col("o_orderpriority")))
    return C.missing_when(rows, F.col("o_orderstatus") == "F", "stated").select("o_orderkey", "o_orderpriority")


@query("select event_id, case when value < 50 then 'warning' else 'error' end as severity from events where event_type = 'error'")
def severity_demotion(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'error'").select("event_id", C.demoted(F.col("value") < 50).alias("severity"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_partkey not in (select p_partkey from part where p_size <= 25)")
def fk_violations(t: Tables) -> DataFrame:
    return C.broken_references(t.lineitem, "l_partkey", t.part.where("p_size <= 25"), "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("select l_orderkey, l_suppkey, count(*) as n from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0) group by 1, 2")
def fk_filtered_parent(t: Tables) -> DataFrame:
    """Each line's references as an array, against suppliers with money alone. No order is gathered."""
    lines = t.lineitem.select("l_orderkey", F.array("l_suppkey").alias("suppliers"))
    bad = C.broken_array_references(lines, "suppliers", t.supplier.where("s_acctbal > 0"), "s_suppkey")
    return bad.groupBy("l_orderkey", F.col("ref").alias("l_suppkey")).agg(F.count(F.lit(1)).alias("n"))


@query("select coalesce(l.doc_id, d.doc_id) as doc_id, case when d.doc_id is null then 'missing' else 'unexpected' end as status from (select distinct doc_id from labels) l full join (select distinct doc_id from documents where lang = 'en') d on l.doc_id = d.doc_id where l.doc_id is null or d.doc_id is null")
def key_set_diff(t: Tables) -> DataFrame:
    return C.key_differences(t.labels, t.documents.where("lang = 'en'"), ["doc_id"])


@query("select o_orderkey, o_totalprice, lines_price from (select o_orderkey, any_value(o_totalprice) as o_totalprice, round(sum(l_extendedprice), 2) as lines_price from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey) where abs(o_totalprice - lines_price) > 1000")
def attribute_diff(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("lines_price"))
    return C.unequal(t.orders, lines, ["o_orderkey"], "o_totalprice", "lines_price", 1000).select("o_orderkey", "o_totalprice", "lines_price")


@query("select u.user_id, e.event_type, coalesce(c.n, 0) as n from (select distinct user_id from events) u cross join (select distinct event_type from events) e left join (select user_id, event_type, count(*) as n from events where extract(day from ts) <= 5 group by 1, 2) c on c.user_id = u.user_id and c.event_type = e.event_type where coalesce(c.n, 0) <> 1")
def grid_completeness(t: Tables) -> DataFrame:
    """Every user should have one event of every type in the first five days; the grid comes from the types as an array."""
    types = t.events.agg(F.collect_set("event_type")).scalar()
    grid = t.events.select("user_id").distinct().select("user_id", F.explode(types).alias("event_type"))
    return C.incomplete_grid(grid, t.events.where("day(ts) <= 5"), ["user_id", "event_type"])


#: Seconds since midnight.
SECONDS = "cast(hour(ts) * 3600 + minute(ts) * 60 + extract(second from ts) as double)"
SECONDS_SQL = "(extract(hour from ts) * 3600 + extract(minute from ts) * 60 + extract(microsecond from ts) / 1000000.0)"


def spans(t: Tables) -> DataFrame:
    """Events as intervals inside the user's day: start and end in seconds, the end ``value`` minutes later."""
    return t.events.select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type", "ts", "value", F.expr(SECONDS).alias("a"), (F.expr(SECONDS) + F.col("value") * 60).alias("b"))


SPANS = f"select event_id, user_id, cast(ts as date) as day, event_type, ts, value, {SECONDS_SQL} as a, {SECONDS_SQL} + value * 60 as b from events"


@query(f"with s as ({SPANS}), m as (select user_id, day, max(a) as limit_s from s where event_type = 'view' group by 1, 2) select event_id, s.user_id, s.day from s join m on m.user_id = s.user_id and m.day = s.day where not (a >= 0 and a < limit_s)")
def point_in_interval(t: Tables) -> DataFrame:
    """Events after the user's last view of the day, the view itself included."""
    rows = spans(t)
    limit = rows.where("event_type = 'view'").groupBy("user_id", "day").agg(F.max("a").alias("limit_s"))
    return C.outside_interval(rows, limit, ["user_id", "day"], "a", "limit_s").select("event_id", "user_id", "day")


@query(f"with s as ({SPANS}), m as (select distinct user_id, day from s) select event_id, s.user_id, s.day from s where not (a + value * 60 <= 86400 + 0.05)")
def interval_within(t: Tables) -> DataFrame:
    rows = spans(t).withColumn("length", F.col("value") * 60)
    days = rows.select("user_id", "day").distinct().withColumn("whole", F.lit(86400.0))
    return C.not_within(rows, days, ["user_id", "day"], "a", "length", "whole", 0.05).select("event_id", "user_id", "day")


@query("select role, next_role, count(*) as n from (select role, lead(role) over (partition by conv_id order by turn) as next_role from conversations) where next_role is not null group by 1, 2")
def adjacent_pairs(t: Tables) -> DataFrame:
    return I.adjacent_pairs(t.conversations, ["conv_id"], "turn", "role").groupBy("role", F.col("next_value").alias("next_role")).agg(F.count(F.lit(1)).alias("n"))


@query("select r_name, n_name, count(distinct c_custkey) as customers, count(distinct o_orderkey) as orders, count(distinct l_suppkey) as suppliers, count(*) as lines from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey group by 1, 2")
def lineage_paths(t: Tables) -> DataFrame:
    """Region to supplier over orders: how many of each stand on the paths."""
    paths = (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    count = lambda c, name: F.count_distinct(c).alias(name)
    return paths.groupBy("r_name", "n_name").agg(count("c_custkey", "customers"), count("o_orderkey", "orders"), count("l_suppkey", "suppliers"), F.count(F.lit(1)).alias("lines"))


@query("select s_suppkey, s_name from supplier where s_suppkey not in (select l_suppkey from lineitem where l_quantity >= 50 and l_returnflag = 'R' and l_discount >= 0.09)")
def unused_sources(t: Tables) -> DataFrame:
    """Suppliers that no large, returned, well-discounted line names."""
    lines = t.lineitem.where("l_quantity >= 50 and l_returnflag = 'R' and l_discount >= 0.09")
    return C.without_children(t.supplier, lines, "s_suppkey", "l_suppkey").select("s_suppkey", "s_name")


@query("select o_orderkey, c_custkey from orders join customer on o_custkey = c_custkey where (o_orderpriority = '1-URGENT') is distinct from (c_mktsegment = 'BUILDING')")
def cross_record_diff(t: Tables) -> DataFrame:
    """Orders whose urgency and customers whose segment should agree and don't."""
    bad = C.inconsistent(t.orders, t.customer, F.col("o_custkey") == F.col("c_custkey"), F.col("o_orderpriority") == "1-URGENT", F.col("c_mktsegment") == "BUILDING")
    return bad.select("o_orderkey", "c_custkey")


@query("select text, count(*) as n from documents group by text having count(*) > 1")
def uniqueness(t: Tables) -> DataFrame:
    """Texts that repeat. Hashes are counted; of the texts, only those that repeat are read again and shuffled."""
    docs = t.documents.select("text", F.coalesce(T.content_hash(F.col("text")), F.lit("")).alias("digest"))
    return docs.join(C.not_unique(docs, ["digest"]), "digest").dropDuplicates(["digest"]).select("text", "n")


@query("select l_orderkey, count(*) filter (where l_returnflag = 'R') as n from lineitem group by 1 having count(*) filter (where l_returnflag = 'R') <> 1")
def exactly_one(t: Tables) -> DataFrame:
    return C.not_exactly_one(t.lineitem, ["l_orderkey"], F.col("l_returnflag") == "R")


@query(f"select user_id, day, count(distinct event_type) as n_distinct from ({SPANS}) group by 1, 2 having max(b) >= 45 * 60 and count(distinct event_type) < 3")
def min_distinct(t: Tables) -> DataFrame:
    return C.too_few_distinct(spans(t), ["user_id", "day"], "event_type", 3, F.max("b") >= 45 * 60)


@query("select user_id, day, array_to_string(list_sort(list_filter(['click', 'purchase', 'signup', 'view'], lambda x: not list_contains(types, x))), ',') as missing from (select user_id, cast(ts as date) as day, list(distinct event_type) as types from events group by 1, 2) where not (list_contains(types, 'click') and list_contains(types, 'purchase') and list_contains(types, 'signup') and list_contains(types, 'view'))")
def required_members(t: Tables) -> DataFrame:
    return C.missing_members(spans(t), ["user_id", "day"], "event_type", ["view", "click", "purchase", "signup"]).withColumn("missing", F.array_join("missing", ","))


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P' and o_orderpriority = '1-URGENT')")
def missing_children(t: Tables) -> DataFrame:
    return C.without_children(t.customer, t.orders.where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("select l_orderkey, count(distinct l_returnflag) as n_l_returnflag, count(distinct l_linestatus) as n_l_linestatus from lineitem group by 1 having count(*) > 1 and (count(distinct l_returnflag) > 1 or count(distinct l_linestatus) > 1)")
def group_uniformity(t: Tables) -> DataFrame:
    return C.not_uniform(t.lineitem, ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query("select doc_id, lang, source from documents where doc_id in (select doc_id from labels)")
def selected_semi(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left_semi").select("doc_id", "lang", "source")


@query("select doc_id from labels where doc_id not in (select doc_id from documents where lang = 'en')")
def unknown_anti(t: Tables) -> DataFrame:
    return C.broken_references(t.labels, "doc_id", t.documents.where("lang = 'en'"), "doc_id").select("doc_id")


@query("select doc_id from labels where toxic = 1 union select doc_id from documents where lang = 'fr'")
def id_union(t: Tables) -> DataFrame:
    return t.labels.where("toxic = 1").select("doc_id").union(t.documents.where("lang = 'fr'").select("doc_id")).distinct()


@query("select doc_id from labels intersect select doc_id from documents where lang = 'de'")
def id_overlap(t: Tables) -> DataFrame:
    return t.labels.select("doc_id").intersect(t.documents.where("lang = 'de'").select("doc_id"))


@query("select doc_id from documents except select doc_id from labels")
def id_except(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@query("select source, count(*) as total, count(*) filter (where quality = 1) as good, count(*) filter (where toxic = 1) as toxic, count(*) filter (where quality = 1) < 10 as few_good from documents left join labels using (doc_id) group by source")
def source_mix(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic")).withColumn("few_good", F.col("good") < 10)


@query("""
with p as (select user_id, event_type as value, row_number() over (partition by user_id order by ts, event_id) as n, row_number() over (partition by user_id, event_type order by ts, event_id) as m from events),
r as (select user_id, value, count(*) as len, min(n) as first from p group by user_id, value, n - m)
select user_id, value as run_value, len as run_length from (select *, row_number() over (partition by user_id order by len desc, first) as k from r) where k = 1""")
def longest_run(t: Tables) -> DataFrame:
    return I.longest_run(t.events, ["user_id"], ["ts", "event_id"], "event_type")


_GAP = """
with s as ({spans}), c as (select user_id, day, {on} as counts, least(greatest(a, 0), 86400) as lo, greatest(least(b, 86400), least(greatest(a, 0), 86400)) as hi from s),
g as (select *, greatest(lo - coalesce(max(hi) over (partition by user_id, day order by lo, hi rows between unbounded preceding and 1 preceding), 0), 0) as gap from c where counts),
m as (select user_id, day, greatest(max(gap), 86400 - max(hi)) as max_gap from g group by 1, 2)
select d.user_id, d.day, round(coalesce(max_gap, 86400), 3) as max_gap from (select distinct user_id, day from s) d left join m on m.user_id = d.user_id and m.day = d.day"""


@query(_GAP.format(spans=SPANS, on="true"))
def max_gap(t: Tables) -> DataFrame:
    out = I.max_gap(spans(t), ["user_id", "day"], F.col("a"), F.col("b"), F.lit(86400.0))
    return out.withColumn("max_gap", F.round("max_gap", 3))


@query(_GAP.format(spans=SPANS, on="event_type <> 'error'"))
def max_gap_subject(t: Tables) -> DataFrame:
    out = I.max_gap(spans(t), ["user_id", "day"], F.col("a"), F.col("b"), F.lit(86400.0), F.col("event_type") != "error")
    return out.withColumn("max_gap", F.round("max_gap", 3))


@query(f"select event_id, user_id, case when step < 0 then 'overlap' else 'gap' end as status, round(abs(step), 3) as seconds from (select *, a - lag(b) over (partition by user_id, day order by ts, event_id) as step from ({SPANS})) where abs(step) > 0.05")
def timeline_overlap(t: Tables) -> DataFrame:
    rows = I.neighbours(spans(t), ["user_id", "day"], ["ts", "event_id"], F.col("a"), F.col("b"))
    return rows.select("event_id", "user_id", "status", F.round("seconds", 3).alias("seconds"))


@query("select conv_id, turn, n_chars, previous_max from (select conv_id, turn, length(text) as n_chars, max(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as previous_max from conversations) where n_chars <= previous_max")
def strictly_increasing(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"))
    return I.not_strictly_increasing(rows, ["conv_id"], ["turn"], "n_chars")


@query("select o_orderkey, o_custkey, o_orderdate, previous from (select o_orderkey, o_custkey, o_orderdate, lag(o_orderdate) over (partition by o_custkey order by o_orderkey) as previous from orders) where o_orderdate < previous")
def non_decreasing(t: Tables) -> DataFrame:
    return I.decreasing(t.orders, ["o_custkey"], ["o_orderkey"], "o_orderdate").select("o_orderkey", "o_custkey", "o_orderdate", "previous")


@query("select conv_id, coalesce(list(role order by turn) = ['system', 'user', 'assistant'], false) as matches from conversations group by conv_id")
def exact_sequence(t: Tables) -> DataFrame:
    return I.exact_sequence(t.conversations, ["conv_id"], "turn", "role", ["system", "user", "assistant"])


@query("select conv_id, turn, place from (select *, row_number() over (partition by conv_id order by turn) as place from conversations) where (place = 1) <> coalesce(role in ('system', 'user'), false)")
def first_row_rule(t: Tables) -> DataFrame:
    return I.first_row_rule(t.conversations, ["conv_id"], "turn", "role", ["system", "user"]).select("conv_id", "turn", F.col("place").cast("long").alias("place"))


_LEVELS = "select vec_id, label, round(20 * log10(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / len(embedding))), 3) as rms_dbfs, round(20 * log10(list_max(list_transform(embedding, lambda x: abs(x::double)))), 3) as peak_dbfs, len(list_filter(embedding, lambda x: abs(x::double) >= 0.3))::double / len(embedding) as clipped_ratio, len(embedding) as n_samples from embeddings"


@query(f"select vec_id, n_samples, rms_dbfs, peak_dbfs, round(clipped_ratio, 6) as clipped_ratio, clipped_ratio > 0.0001 as clipping, round_even(n_samples / 44100.0, 6) as seconds from ({_LEVELS})")
def audio_levels(t: Tables) -> DataFrame:
    """Vectors as samples of full scale 1, clipped from 0.3 on."""
    rows = levels.audio_levels(t.embeddings, F.col("embedding"), full=1.0, clip=0.3)
    return rows.select("vec_id", "n_samples", "rms_dbfs", "peak_dbfs", F.round("clipped_ratio", 6).alias("clipped_ratio"), (F.col("clipped_ratio") > 1e-4).alias("clipping"), F.bround(F.col("n_samples") / 44100, 6).alias("seconds"))


@query(f"select label, round(max(rms_dbfs) - min(rms_dbfs), 3) as drift, round(max(rms_dbfs) - min(rms_dbfs), 3) <= 2.0 as ok from ({_LEVELS}) group by label")
def level_drift(t: Tables) -> DataFrame:
    return levels.level_drift(levels.audio_levels(t.embeddings, F.col("embedding"), full=1.0, clip=0.3), ["label"], limit=2.0)


@query("select label, count(*) as n_blocks, sum(len(embedding))::bigint as n_samples, round(20 * log10(sqrt(sum(list_sum(list_transform(embedding, lambda x: x::double * x::double))) / sum(len(embedding)))), 3) as rms_dbfs, round(20 * log10(max(list_max(list_transform(embedding, lambda x: abs(x::double))))), 3) as peak_dbfs, round(sum(len(list_filter(embedding, lambda x: abs(x::double) >= 0.3)))::double / sum(len(embedding)), 6) as clipped_ratio from embeddings group by label")
def recording_levels(t: Tables) -> DataFrame:
    """Vectors of a label as the blocks of one long recording."""
    whole = levels.block_levels(t.embeddings, ["label"], F.col("embedding"), full=1.0, clip=0.3).withColumn("clipped_ratio", F.round("clipped_ratio", 6))
    return whole.join(t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n_blocks")), "label")


@query(f"with s as ({SPANS}) select p.event_id, v.event_id as view_id from s p join s v on p.user_id = v.user_id and p.day = v.day and p.a >= v.a and p.a < v.b where p.event_type = 'click' and v.event_type = 'view'")
def clicks_in_views(t: Tables) -> DataFrame:
    """Clicks inside a view of their user's day, by bins of ten minutes."""
    rows = spans(t)
    clicks = rows.where("event_type = 'click'").select("event_id", "user_id", "day", "a")
    views = rows.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "day", F.col("a").alias("since"), F.col("b").alias("until"))
    return I.points_in_spans(clicks, views, ["user_id", "day"], "a", "since", "until", 600.0).select("event_id", "view_id")


@query(f"with s as ({SPANS}) select p.event_id, v.event_id as error_id from s p join s v on p.user_id = v.user_id and p.day = v.day and greatest(p.a, v.a) < least(p.b, v.b) where p.event_type = 'purchase' and v.event_type = 'error'")
def purchases_beside_errors(t: Tables) -> DataFrame:
    """Purchases whose time overlaps that of an error of the same user and day."""
    rows = spans(t)
    bought = rows.where("event_type = 'purchase'").select("event_id", "user_id", "day", "a", "b")
    wrong = rows.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", "day", F.col("a").alias("since"), F.col("b").alias("until"))
    return I.overlapping_spans(bought, wrong, ["user_id", "day"], "a", "b", "since", "until", 600.0).select("event_id", "error_id")
