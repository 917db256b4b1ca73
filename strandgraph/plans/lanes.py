"""Review, grouping and activation over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.functions import scalar as S
from strandgraph.operators import candidates as X
from strandgraph.operators import effects as E
from strandgraph.operators import joins as J
from strandgraph.operators import review as V
from strandgraph.operators import windows as W
from strandgraph.plans.registry import Tables, query

# --- effects and calls ---------------------------------------------------------------


@query("SELECT p_brand AS program, p_name AS paragraph, p_type AS construct FROM part WHERE p_partkey % 3 > 0")
def e06_unsupported_effects(t: Tables) -> DataFrame:
    """Messages that name a construct and its paragraph; others are none."""
    text = F.when(F.col("p_partkey") % 3 > 0, F.concat("p_type", F.lit(" en paragraph "), "p_name")).otherwise(F.col("p_name"))
    return E.unsupported_effects(t.part.select(F.col("p_brand").alias("program"), text.alias("message"))).select("program", "paragraph", "construct")


@query("""
SELECT event_id, event_type, user_id || '/' || event_type || '/' || row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS fact_id, event_type = 'error' AS barrier FROM events
""")
def e09_numbered_facts(t: Tables) -> DataFrame:
    """Facts and barriers whose ids rest on content and order, so that reruns agree."""
    key = F.concat_ws("/", F.col("user_id").cast("string"), "event_type")
    e = W.collision_ordinal(t.events, key, ["ts", "event_id"])
    return e.select("event_id", "event_type", F.concat_ws("/", key, F.col("collision").cast("string")).alias("fact_id"), (F.col("event_type") == "error").alias("barrier"))


@query("""
WITH i AS (SELECT upper(p_name) AS k, count(*) AS n, min(p_partkey) AS p, min(p_size) % 3 AS formals FROM part GROUP BY 1),
c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'missing' ELSE lower(p_name) END AS called, o_orderkey % 3 AS actuals FROM orders JOIN part ON p_partkey = o_orderkey % 200)
SELECT o_orderkey, CASE WHEN called IS NULL THEN 'DYNAMIC' WHEN n IS NULL THEN 'UNRESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' WHEN actuals = formals THEN 'BOUND' ELSE 'COUNT_DIFFERS' END AS status, CASE WHEN n = 1 THEN p END AS target FROM c LEFT JOIN i ON k = upper(called)
""")
def e11_call_sites(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    called = F.when(k % 4 == 1, "missing").when(k % 4 > 1, F.lower("p_name"))
    sites = t.orders.select("o_orderkey").join(t.part.select("p_partkey", "p_name"), F.col("p_partkey") == k % 200).select("o_orderkey", called.alias("called"), (k % 3).alias("actuals"))
    programs = t.part.select("p_name", "p_partkey", (F.col("p_size") % 3).alias("formals"))
    return E.call_sites(sites, programs, "called", "p_name", "p_partkey", "actuals", "formals").select("o_orderkey", "status", "target")


# --- detectors and reviews --------------------------------------------------------------


@query("""
WITH d AS (SELECT 'returned' AS detector, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48 UNION ALL SELECT 'cheap', l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.09 AND l_quantity < 3)
SELECT detector, l_orderkey, l_linenumber::BIGINT AS line, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') AS in_baseline FROM d
""")
def x06_run_detectors(t: Tables) -> DataFrame:
    line = t.lineitem.withColumn("line", F.col("l_linenumber").cast("long"))
    d = {"returned": line.where("l_returnflag = 'R' and l_quantity > 48"), "cheap": line.where("l_discount > 0.09 and l_quantity < 3")}
    base = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return V.run_detectors(d, ["l_orderkey", "line"], base, ["l_orderkey"]).select("detector", "l_orderkey", "line", "in_baseline")


_SUPPORT = "CASE event_type WHEN 'purchase' THEN 'DETERMINISTIC' WHEN 'error' THEN 'BLOCKED' ELSE 'PARTIAL' END"


@query(f"SELECT event_id, user_id % 4 AS tag, CASE WHEN {_SUPPORT} = 'DETERMINISTIC' THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM events WHERE user_id % 4 IN (1, 2) AND {_SUPPORT} <> 'BLOCKED'")
def x09_productised(t: Tables) -> DataFrame:
    tags = F.element_at(F.array(*[F.lit(x) for x in ("none", "status", "status_flag", "return_code")]), (F.col("user_id") % 4 + 1).cast("int"))
    e = t.events.withColumn("tag_", tags).withColumn("support", F.expr(_SUPPORT))
    return V.productised(e, "tag_", ["status", "status_flag"], "support").select("event_id", (F.col("user_id") % 4).alias("tag"), "confidence")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'PROMOTE' WHEN 'MACHINERY' THEN 'REJECT' ELSE 'MANUAL_REVIEW' END AS action FROM customer")
def x18_review_items(t: Tables) -> DataFrame:
    return V.review_items(t.customer, "c_mktsegment", {"BUILDING": "PROMOTE", "MACHINERY": "REJECT"}).select("c_custkey", "action")


@query("""
SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'NOT_FOUND' WHEN c_custkey % 10 = 4 THEN 'AMBIGUOUS' WHEN coalesce(c_mktsegment, '') = o_seg THEN 'RESOLVED' ELSE 'IDENTITY_MISMATCH' END AS resolution
FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'BUILDING' ELSE 'FURNITURE' END AS o_seg FROM orders) LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON c_custkey = o_custkey
""")
def x21_references(t: Tables) -> DataFrame:
    """References into customers: some are gone, some are there twice."""
    refs = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 3 == 0, "BUILDING").otherwise("FURNITURE").alias("c_mktsegment"))
    c = t.customer.where("c_custkey % 7 <> 0").select("c_custkey", "c_mktsegment")
    return V.resolve_references(refs, c.union(c.where("c_custkey % 10 = 4")), ["c_custkey"], ["c_mktsegment"]).select("o_orderkey", "resolution")


@query("""
SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') THEN 'CONFLICTS' WHEN bool_or(o_totalprice > 400000) THEN 'EXACT' WHEN bool_or(o_totalprice > 300000) THEN 'RELATED' ELSE 'NOT_IN_BASELINE' END AS comparison FROM orders GROUP BY 1
""")
def x22_group_to_baseline(t: Tables) -> DataFrame:
    p = F.col("o_totalprice")
    return V.group_to_baseline(t.orders, "o_custkey", (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"), p > 400000, p > 300000)


@query("""
WITH m AS (SELECT DISTINCT c_nationkey AS g, c_custkey, c_mktsegment FROM customer), s AS (SELECT g, count(*)::BIGINT AS members, count(DISTINCT c_mktsegment) = 1 AS one FROM m GROUP BY 1)
SELECT g AS c_nationkey, members, CASE WHEN g % 5 = 0 THEN 'EXCLUDED' WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = g AND s_acctbal < 0) THEN 'CONFLICTS' WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = g) THEN 'RELATED' ELSE 'NOT_IN_BASELINE' END AS comparison FROM s
""")
def x20_grouped_candidates(t: Tables) -> DataFrame:
    """Members grouped, compared with the baseline, and excluded groups marked."""
    s = t.supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.bool_or(F.col("s_acctbal") < 0).alias("bad"))
    m = t.customer.select("c_nationkey", "c_custkey").distinct().join(s, "c_nationkey", "left")
    compared = V.group_to_baseline(m, "c_nationkey", F.col("bad"), F.lit(False), F.col("bad").isNotNull())
    sizes = m.groupBy("c_nationkey").agg(F.count("*").alias("members"))
    return sizes.join(compared, "c_nationkey").select("c_nationkey", "members", F.when(F.col("c_nationkey") % 5 == 0, "EXCLUDED").otherwise(F.col("comparison")).alias("comparison"))


@query("""
SELECT 'negative' AS gate, CASE WHEN count(*) > 0 THEN 'FAILED' ELSE 'PASSED' END AS status, count(*)::BIGINT AS findings FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'returned', CASE WHEN count(*) > 0 THEN 'WARNING' ELSE 'PASSED' END, count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'orphans', 'PASSED', 0
""")
def x23_gates(t: Tables) -> DataFrame:
    orphans = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.col("o_orderkey").alias("k"))
    f = {"negative": t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("k")), "returned": t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")), "orphans": orphans}
    return V.gate_status(f, "k", ["negative", "orphans"])


@query("""
WITH e AS (SELECT n_nationkey, n_name AS hash, n_regionkey AS version FROM nation), s AS (SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 1 THEN 'x' ELSE n_name END AS hash, CASE WHEN n_nationkey % 4 = 1 THEN 9 ELSE n_regionkey END AS version FROM nation WHERE n_nationkey % 5 <> 0)
SELECT e.n_nationkey, 'MISSING' AS defect FROM e WHERE n_nationkey % 5 = 0 UNION ALL SELECT e.n_nationkey, 'HASH_MISMATCH' FROM e JOIN s USING (n_nationkey) WHERE e.hash <> s.hash UNION ALL SELECT e.n_nationkey, 'VERSION_MISMATCH' FROM e JOIN s USING (n_nationkey) WHERE e.version <> s.version
""")
def x24_bindings(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    expected = t.nation.select("n_nationkey", F.col("n_name").alias("hash"), F.col("n_regionkey").alias("version"))
    found = expected.where(k % 5 != 0).withColumn("hash", F.when(k % 6 == 1, "x").otherwise(F.col("hash"))).withColumn("version", F.when(k % 4 == 1, 9).otherwise(F.col("version")))
    return V.binding_defects(found, expected, "n_nationkey", ["hash", "version"])


@query("""
SELECT c_nationkey, CASE WHEN c_nationkey % 8 = 0 THEN 'EMPTY_GROUP' WHEN c_nationkey % 8 = 1 THEN 'UNKNOWN_GROUP' WHEN c_nationkey % 8 = 2 THEN 'SIZE' ELSE 'MEMBERS' END AS defect FROM (SELECT DISTINCT c_nationkey FROM customer) WHERE c_nationkey % 8 < 4
""")
def x25_recomputed_groups(t: Tables) -> DataFrame:
    """Stored groups against their members, with a defect of each kind put in."""
    k = F.col("c_nationkey") % 8
    ids = F.array_join(F.array_sort(F.collect_set(F.col("c_custkey").cast("string"))), ",")
    stored = t.customer.groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("n"), F.sha2(ids, 256).alias("digest")).where(k != 1)
    stored = stored.withColumn("n", F.when(k == 2, F.col("n") + 1).otherwise(F.col("n"))).withColumn("digest", F.when(k == 3, "x").otherwise(F.col("digest")))
    return V.recomputed_groups(stored, t.customer.where(k != 0), "c_nationkey", "n", "digest", "c_custkey")


@query("SELECT o_custkey, bool_and(o_totalprice > 20000) AS evidence, bool_and(o_orderstatus <> 'P') AS provenance, bool_and(o_orderpriority <> '5-LOW') AS decision FROM orders GROUP BY 1")
def x26_traceability(t: Tables) -> DataFrame:
    return V.traceability(t.orders, "o_custkey", F.col("o_totalprice") > 20000, F.col("o_orderstatus") != "P", F.col("o_orderpriority") != "5-LOW")


_SIDES = """l AS (SELECT min(o_orderkey) AS id, o_custkey, o_orderpriority, arg_min(o_orderstatus, o_orderkey) AS v FROM orders WHERE month(o_orderdate) <= 6 GROUP BY 2, 3),
r AS (SELECT min(o_orderkey) AS id, o_custkey, o_orderpriority, nullif(arg_min(o_orderstatus, o_orderkey), 'P') AS v FROM orders WHERE month(o_orderdate) > 6 GROUP BY 2, 3),
a AS (SELECT l.id AS left_id, r.id AS right_id, l.v AS lv, r.v AS rv FROM l JOIN r USING (o_custkey, o_orderpriority)), lr AS (SELECT * FROM l WHERE id NOT IN (SELECT left_id FROM a)), rr AS (SELECT * FROM r WHERE id NOT IN (SELECT right_id FROM a)),
f AS (SELECT min(lr.id) AS left_id, min(rr.id) AS right_id, o_custkey FROM lr JOIN rr USING (o_custkey) GROUP BY o_custkey)"""


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    side = lambda half: t.orders.where(half).groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("id"), F.min_by("o_orderstatus", "o_orderkey").alias("v"))
    early = F.month("o_orderdate") <= 6
    return side(early), side(~early).withColumn("v", F.nullif(F.col("v"), F.lit("P")))


@query(f"""
WITH {_SIDES} SELECT left_id, right_id, CASE WHEN right_id % 5 = 0 THEN 'NOT_EVALUATED' WHEN lv IS NULL OR rv IS NULL THEN 'NOT_COMPARABLE' WHEN lv = rv THEN 'EXACT' ELSE 'CONFLICTING' END AS outcome FROM a
UNION ALL SELECT left_id, right_id, CASE WHEN right_id % 5 = 0 THEN 'NOT_EVALUATED' ELSE 'RELATED' END FROM f
UNION ALL SELECT id, NULL, 'LEFT_ONLY' FROM lr WHERE o_custkey NOT IN (SELECT o_custkey FROM f) UNION ALL SELECT NULL, id, 'ADDITIVE' FROM rr WHERE o_custkey NOT IN (SELECT o_custkey FROM f)
""")
def x31_activation_outcome(t: Tables) -> DataFrame:
    l, r = _sides(t)
    return V.activation_outcome(l, r, ["o_custkey", "o_orderpriority"], ["o_custkey"], "v", F.col("right_id") % 5 != 0)


@query(f"""
WITH {_SIDES} SELECT outcome, count(*)::BIGINT AS n FROM (SELECT CASE WHEN lv IS NULL OR rv IS NULL THEN 'NOT_COMPARABLE' WHEN lv = rv THEN 'EXACT' ELSE 'CONFLICTING' END AS outcome FROM a UNION ALL SELECT 'RELATED' FROM f
UNION ALL SELECT 'LEFT_ONLY' FROM lr WHERE o_custkey NOT IN (SELECT o_custkey FROM f) UNION ALL SELECT 'ADDITIVE' FROM rr WHERE o_custkey NOT IN (SELECT o_custkey FROM f)) GROUP BY 1
""")
def x28_groups_by_comparison(t: Tables) -> DataFrame:
    l, r = _sides(t)
    return V.activation_outcome(l, r, ["o_custkey", "o_orderpriority"], ["o_custkey"], "v", F.lit(True)).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, o.t, CASE WHEN c_custkey % 2 = 0 THEN c_name END) AS text, CASE WHEN c_acctbal > 5000 THEN 'segment' WHEN o.t IS NOT NULL THEN 'order' WHEN c_custkey % 2 = 0 THEN 'name' ELSE 'NONE' END AS surface
FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS t FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o_custkey = c_custkey
""")
def x32_best_surface(t: Tables) -> DataFrame:
    orders = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("text"))
    segment = t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("text"))
    name = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("text"))
    return V.best_surface(t.customer, [("segment", segment), ("order", orders), ("name", name)], "c_custkey", "text")


_LANE = """CASE WHEN o_orderstatus <> 'P' AND o_totalprice > 50000 AND (m = 'ON' OR m = 'CANARY' AND b < 30) THEN 'UNIFIED' WHEN o_orderkey % 11 <> 0 THEN 'V1' ELSE 'NONE' END"""
_MODES = """(SELECT *, CASE o_custkey % 4 WHEN 0 THEN 'OFF' WHEN 1 THEN 'SHADOW' WHEN 2 THEN 'CANARY' ELSE 'ON' END AS m, ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 100 AS b FROM orders)"""


def _lanes(t: Tables) -> DataFrame:
    m = F.element_at(F.array(*[F.lit(x) for x in ("OFF", "SHADOW", "CANARY", "ON")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    picked = S.stable_bucket(F.col("o_orderkey").cast("string")) < 30
    lane = V.lane(m, picked, F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus") != "P", F.col("o_totalprice") > 50000)
    return t.orders.select("o_orderkey", m.alias("mode"), lane.alias("lane"))


@query(f"SELECT o_orderkey, m AS mode, {_LANE} AS lane FROM {_MODES}")
def x34_lanes(t: Tables) -> DataFrame:
    return _lanes(t)


@query(f"SELECT m AS mode, {_LANE} AS lane, count(*)::BIGINT AS n FROM {_MODES} GROUP BY 1, 2")
def x35_activation_summary(t: Tables) -> DataFrame:
    return _lanes(t).groupBy("mode", "lane").agg(F.count("*").alias("n"))


@query(f"""
WITH {_SIDES} SELECT left_id, right_id, CASE WHEN lv = rv THEN 'EXACT' ELSE 'CONFLICTING' END AS outcome FROM a WHERE lv IS NOT NULL AND rv IS NOT NULL
""")
def x31_anchored_values(t: Tables) -> DataFrame:
    l, r = _sides(t)
    pairs = J.anchored(l, r, ["o_custkey", "o_orderpriority"], ["o_custkey"]).where("level = 'ANCHOR'").select("left_id", "right_id")
    values = X.differential(l, r, ["o_custkey", "o_orderpriority"], ["o_custkey"], "v").select("left_id", "right_id", "outcome")
    return pairs.join(values, ["left_id", "right_id"]).where(F.col("outcome").isin("EXACT", "CONFLICTING")).join(r.where("v is not null").select(F.col("id").alias("right_id")), "right_id", "left_semi").select("left_id", "right_id", "outcome")
