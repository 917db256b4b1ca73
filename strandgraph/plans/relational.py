"""Joins, aggregates, windows, checks and scalar rules over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.functions import scalar as S
from strandgraph.operators import aggregates as A
from strandgraph.operators import checks as C
from strandgraph.operators import joins as J
from strandgraph.operators import propagation as N
from strandgraph.operators import resolve as R
from strandgraph.operators import windows as W
from strandgraph.operators.rules import by_rules
from strandgraph.plans.registry import Tables, query


@query("""
WITH tok AS (
  SELECT o_orderkey AS token_id, CASE WHEN o_orderkey % 3 = 0 THEN p_brand || '.' || p_name ELSE ' ' || lower(p_name) END AS token
  FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part) + 1
), idx AS (SELECT p_partkey, upper(trim(p_brand || '.' || p_name)) AS q, upper(trim(p_name)) AS s FROM part),
q AS (SELECT q, count(*) AS n, min(p_partkey) AS t FROM idx GROUP BY q), s AS (SELECT s, count(*) AS n, min(p_partkey) AS t FROM idx GROUP BY s)
SELECT token_id, CASE WHEN q.n = 1 THEN q.t WHEN q.n IS NULL AND s.n = 1 THEN s.t END AS target,
  CASE WHEN q.n = 1 THEN 'QUALIFIED' WHEN q.n > 1 THEN 'AMBIGUOUS' WHEN s.n = 1 THEN 'SIMPLE' WHEN s.n > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS resolution
FROM tok LEFT JOIN q ON q.q = upper(trim(token)) LEFT JOIN s ON s.s = upper(trim(token))
""")
def j02_resolve_names(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.lit(t.part.count()).alias("n"))
    tok = o.join(t.part, F.col("p_partkey") == F.col("o_orderkey") % F.col("n") + 1)
    tok = tok.select(F.col("o_orderkey").alias("token_id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat("p_brand", F.lit("."), "p_name")).otherwise(F.concat(F.lit(" "), F.lower("p_name"))).alias("token"))
    idx = t.part.select("p_partkey", F.concat("p_brand", F.lit("."), "p_name").alias("q"), F.col("p_name").alias("s"))
    return R.resolve_names(tok, idx, "token", [], "q", "s", "p_partkey").select("token_id", "target", "resolution")


@query("""
WITH f AS (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
o AS (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2)
SELECT coalesce(f.o_custkey, o.o_custkey) AS o_custkey, coalesce(f.o_orderpriority, o.o_orderpriority) AS o_orderpriority, f.v AS left_value, o.v AS right_value,
  CASE WHEN o.o_custkey IS NULL THEN 'LEFT_ONLY' WHEN f.o_custkey IS NULL THEN 'RIGHT_ONLY' WHEN f.v = o.v THEN 'SAME' ELSE 'DIFFERENT' END AS status
FROM f FULL JOIN o ON f.o_custkey = o.o_custkey AND f.o_orderpriority = o.o_orderpriority
""")
def j05_three_way_status(t: Tables) -> DataFrame:
    best = lambda s: t.orders.where(F.col("o_orderstatus") == s).groupBy("o_custkey", "o_orderpriority").agg(F.max("o_totalprice").alias("v"))
    return J.three_way(best("F"), best("O"), ["o_custkey", "o_orderpriority"], "v")


@query("""
SELECT coalesce(a.pair, f.pair) AS pair, coalesce(a.turn, f.turn) AS turn,
  CASE WHEN coalesce(a.pair, f.pair) % 4 = 3 THEN 'FORMAL_UNRESOLVED' WHEN a.turn IS NULL THEN 'MISSING_ACTUAL' WHEN f.turn IS NULL THEN 'EXTRA_ACTUAL' ELSE 'BOUND' END AS binding
FROM (SELECT conv_id // 2 AS pair, turn FROM conversations WHERE conv_id % 2 = 0) a
FULL JOIN (SELECT conv_id // 2 AS pair, turn FROM conversations WHERE conv_id % 2 = 1 AND (conv_id // 2) % 4 <> 3) f ON a.pair = f.pair AND a.turn = f.turn
""")
def j10_ordinal_zip(t: Tables) -> DataFrame:
    c = t.conversations.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair"), (F.col("conv_id") % 2).alias("side"), "turn")
    known = c.select("pair").where("pair % 4 <> 3").distinct()
    return J.ordinal_zip(c.where("side = 0"), c.where("side = 1"), ["pair"], "turn", known)


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM events
""")
def j11_latest_before(t: Tables) -> DataFrame:
    """The value of each user's last purchase before every event."""
    return J.latest_before(t.events, F.col("event_type") == "purchase", F.col("value"), ["user_id"], ["ts", "event_id"]).select("event_id", "latest")


@query("""
WITH s AS (
  SELECT event_id, event_type, last_value(CASE WHEN event_type IN ('purchase', 'signup') THEN event_type END IGNORE NULLS) OVER w AS kind, last_value(CASE WHEN event_type IN ('purchase', 'signup') THEN value END IGNORE NULLS) OVER w AS v
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT event_id, CASE WHEN kind = 'purchase' THEN v END AS nearest, CASE WHEN kind IS NULL THEN 'NOT_AVAILABLE' WHEN kind = 'signup' THEN 'AMBIGUOUS' ELSE 'PROVEN' END AS proof FROM s WHERE event_type = 'error'
""")
def j12_latest_unless_barred(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    out = J.latest_unless_barred(t.events, kind == "purchase", kind == "signup", F.col("value"), ["user_id"], ["ts", "event_id"])
    return out.where(kind == "error").select("event_id", "nearest", "proof")


@query("""
WITH have AS (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders))
SELECT o_custkey, bool_and(o_orderpriority IN (SELECT p FROM have)) AS contained FROM orders GROUP BY o_custkey
""")
def j14_contained(t: Tables) -> DataFrame:
    """Whether the priorities of each customer's orders are among those of the first customer."""
    need = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("need"))
    first = t.orders.agg(F.min("o_custkey").alias("k"))
    have = t.orders.join(F.broadcast(first), F.col("o_custkey") == F.col("k")).agg(F.collect_set("o_orderpriority").alias("have"))  # a row
    return need.join(F.broadcast(have)).select("o_custkey", J.contained(F.col("need"), F.col("have")).alias("contained"))


@query("""
SELECT a.s_nationkey, a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 200
""")
def j16_pairs_in_group(t: Tables) -> DataFrame:
    """Pairs within one nation and a narrow band: only rows of a band and the two beside it meet."""
    band = F.floor(F.col("s_acctbal") / 200)
    a = t.supplier.withColumn("band", band).alias("a")
    b = t.supplier.withColumn("band", F.explode(F.array(band - 1, band, band + 1))).alias("b")
    on = (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))
    return a.join(b, on).where(F.abs(F.col("a.s_acctbal") - F.col("b.s_acctbal")) < 200).select("a.s_nationkey", F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


@query("""
WITH i AS (
  SELECT (p_size % 5)::VARCHAR AS program, p_brand || '.' || p_type AS qualified, p_type AS name FROM part
), s AS (
  SELECT program, name, count(*) AS n, min(qualified) AS one FROM (SELECT DISTINCT * FROM i) GROUP BY program, name
), tokens AS (
  SELECT DISTINCT (p_size % 5)::VARCHAR AS program, unnest([p_type, p_brand || '.' || p_type, upper(p_type) || ' ']) AS token FROM part
)
SELECT t.program, token, CASE WHEN q.qualified IS NOT NULL THEN token WHEN s.n = 1 THEN s.one ELSE token END AS identity, q.qualified IS NULL AND coalesce(s.n, 0) > 1 AS ambiguous
FROM tokens t LEFT JOIN (SELECT DISTINCT program, qualified FROM i) q ON q.program = t.program AND q.qualified = token LEFT JOIN s ON s.program = t.program AND s.name = token
""")
def j02_symbols(t: Tables) -> DataFrame:
    """Names as they are written, without normalising: qualified ones are themselves (the last of equal ones, which are one), simple ones the only item of that name."""
    items = t.part.select((F.col("p_size") % 5).cast("string").alias("program"), F.concat_ws(".", "p_brand", "p_type").alias("qualified"), F.col("p_type").alias("simple"))
    tokens = t.part.select((F.col("p_size") % 5).cast("string").alias("program"), F.explode(F.array("p_type", F.concat_ws(".", "p_brand", "p_type"), F.concat(F.upper("p_type"), F.lit(" ")))).alias("token")).distinct()
    table = N.symbol_table(items.distinct()).withColumnRenamed("name", "token")
    out = tokens.join(table, ["program", "token"], "left")
    return out.select("program", "token", F.coalesce("key", "token").alias("identity"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


_RULES = [("R1", "metal", "STEEL|BRASS|COPPER|TIN|NICKEL", 0.9), ("R2", "plate", "PLATED", 0.7), ("R3", "metal", "STEEL$", 0.95), ("R4", "size", "SMALL|LARGE", 0.5)]
_RULES_SQL = "rules(rule_id, tag, pattern, confidence) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in _RULES) + ")"


@query(f"""
WITH {_RULES_SQL}, m AS (SELECT p_partkey, list_sort(list(DISTINCT tag)) AS tags, max(confidence) AS c, list_sort(list(DISTINCT rule_id)) AS rules FROM part JOIN rules ON regexp_matches(upper(p_type), pattern) GROUP BY p_partkey)
SELECT p_partkey, CASE WHEN len(tags) = 1 THEN tags[1] END AS tag, CASE WHEN len(tags) = 1 THEN c END AS confidence, array_to_string(rules, ',') AS rules, len(tags) > 1 AS conflict FROM m
""")
def j17_rule_tags(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame(_RULES, "rule_id string, tag string, pattern string, confidence double")
    m = by_rules(t.part.select("p_partkey", "p_type"), rules, F.upper("p_type"))
    return A.one_tag_each(m, ["p_partkey"], "tag", "confidence", "rule_id").withColumn("rules", F.array_join("rules", ","))


@query("""
SELECT c_custkey, s_suppkey AS rule_id, s_name AS tag
FROM customer JOIN supplier ON regexp_matches(c_name, '^(Customer|Supplier)#' || lpad((s_suppkey * 3)::VARCHAR, 9, '0') || '$')
UNION ALL SELECT c_custkey, -1, 'sevens' FROM customer WHERE regexp_matches(c_name, '7.?7')
""")
def j17_rule_per_supplier(t: Tables) -> DataFrame:
    """A rule for each supplier, met through its literal, and one without a literal that is tried on all names."""
    pattern = F.concat(F.lit("^(Customer|Supplier)#"), F.lpad((F.col("s_suppkey") * 3).cast("string"), 9, "0"), F.lit("$"))
    rules = t.supplier.select(F.col("s_suppkey").cast("long").alias("rule_id"), F.col("s_name").alias("tag"), pattern.alias("pattern"))
    rules = rules.union(t.spark.createDataFrame([(-1, "sevens", "7.?7")], "rule_id long, tag string, pattern string"))
    return by_rules(t.customer.select("c_custkey", "c_name"), rules, F.col("c_name")).select("c_custkey", "rule_id", "tag")


@query("""
WITH l AS (SELECT o_orderkey AS id, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT o_orderkey AS id, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'),
lf AS (SELECT o_custkey, o_orderpriority, min(id) AS i FROM l GROUP BY ALL), rf AS (SELECT o_custkey, o_orderpriority, min(id) AS i FROM r GROUP BY ALL),
la AS (SELECT * FROM l WHERE (o_custkey, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderpriority) FROM rf)), ra AS (SELECT * FROM r WHERE (o_custkey, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderpriority) FROM lf))
SELECT lf.i AS left_id, rf.i AS right_id, 'ANCHOR' AS level FROM lf JOIN rf USING (o_custkey, o_orderpriority)
UNION ALL SELECT a.i, b.i, 'FALLBACK' FROM (SELECT o_custkey, min(id) AS i FROM la GROUP BY 1) a JOIN (SELECT o_custkey, min(id) AS i FROM ra GROUP BY 1) b USING (o_custkey)
UNION ALL SELECT id, NULL, 'LEFT_ONLY' FROM la WHERE o_custkey NOT IN (SELECT o_custkey FROM ra)
UNION ALL SELECT NULL, id, 'RIGHT_ONLY' FROM ra WHERE o_custkey NOT IN (SELECT o_custkey FROM la)
""")
def j18_anchored(t: Tables) -> DataFrame:
    side = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderpriority")
    return J.anchored(side("F"), side("O"), ["o_custkey", "o_orderpriority"], ["o_custkey"])


@query("""
SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS value, false AS is_total FROM events GROUP BY event_type UNION ALL SELECT NULL, count(*), round(sum(value), 2), true FROM events
""")
def a01_totals_and_kinds(t: Tables) -> DataFrame:
    return A.totals_and_kinds(t.events, "event_type", ["value"]).withColumn("value", F.round("value", 2))


@query("""
SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n, array_to_string(list_sort(list(o_orderkey))[1:3], ',') AS refs FROM orders GROUP BY ALL
""")
def a02_sampled_groups(t: Tables) -> DataFrame:
    out = A.sampled_groups(t.orders, ["o_orderstatus", "o_orderpriority"], ["o_orderkey"], "o_orderkey", 3)
    return out.select("o_orderstatus", "o_orderpriority", "n", F.array_join(F.transform("references", lambda x: x.cast("string")), ",").alias("refs"))


@query("""
SELECT 0 AS set_no, o_orderstatus, NULL AS o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 1, NULL, o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority UNION ALL SELECT 2, o_orderstatus, o_orderpriority, count(*) FROM orders GROUP BY 2, 3
""")
def a08_grouping_sets(t: Tables) -> DataFrame:
    return A.counts_by(t.orders, ["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"])


@query("""
WITH s AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'DETERMINISTIC' WHEN 'P' THEN 'BLOCKED' ELSE 'PARTIAL' END AS s FROM orders)
SELECT o_custkey, CASE WHEN bool_and(s = 'DETERMINISTIC') THEN 'DETERMINISTIC' WHEN bool_or(s = 'BLOCKED') THEN 'BLOCKED' WHEN bool_or(s = 'PARTIAL') THEN 'PARTIAL' ELSE 'UNKNOWN' END AS support, count(*)::BIGINT AS n FROM s GROUP BY o_custkey
""")
def a10_support_lattice(t: Tables) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "F", "DETERMINISTIC").when(F.col("o_orderstatus") == "P", "BLOCKED").otherwise("PARTIAL")
    return A.support_lattice(t.orders.select("o_custkey", s.alias("s")), ["o_custkey"], "s")


@query("""
SELECT n_nationkey, count(s_suppkey)::BIGINT AS n_issues, coalesce(array_to_string(list_sort(list(DISTINCT s_name) FILTER (WHERE s_name IS NOT NULL)), ','), '') AS codes, count(s_suppkey) = 0 AS passed
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 0 GROUP BY n_nationkey
""")
def a11_gates(t: Tables) -> DataFrame:
    bad = t.supplier.where("s_acctbal < 0").withColumnRenamed("s_nationkey", "n_nationkey")
    out = A.gate_results(t.nation, bad, "n_nationkey", "s_name")
    return out.select("n_nationkey", F.col("n_issues").cast("long").alias("n_issues"), F.array_join("codes", ",").alias("codes"), "passed")


@query("""
WITH x AS (SELECT d.source, l.quality = 1 AS t, d.n_chars > 1500 AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
m AS (SELECT source, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn FROM x GROUP BY source),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM m)
SELECT source, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM pr
""")
def a12_precision_recall(t: Tables) -> DataFrame:
    x = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id")
    out = A.classification_metrics(x, F.col("quality") == 1, F.col("n_chars") > 1500, ["source"])
    return out.select("source", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""
SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, count(DISTINCT o_orderstatus) = 1 AS agrees FROM orders GROUP BY o_custkey
""")
def a13_merged_reports(t: Tables) -> DataFrame:
    return A.merged_reports(t.orders, "o_custkey", "o_orderkey", "o_orderstatus")


@query("""
WITH s AS (SELECT o_custkey, list(DISTINCT CASE o_orderstatus WHEN 'F' THEN 'EXACT' ELSE 'UNRESOLVED' END) AS s FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN s = ['EXACT'] THEN 'EXACT' WHEN s = ['UNRESOLVED'] THEN 'UNRESOLVED' ELSE 'PARTIAL' END AS status FROM s
""")
def a14_applicability(t: Tables) -> DataFrame:
    s = t.orders.groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderstatus") == "F", "EXACT").otherwise("UNRESOLVED")).alias("s"))
    return s.select("o_custkey", A.applicability(F.col("s")).alias("status"))


@query("""
SELECT CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'UNKNOWN' END AS event_type, count(value)::BIGINT AS n, round(sum(value), 2) AS total,
  count(*) FILTER (WHERE value <= 10)::BIGINT AS le_10, count(*) FILTER (WHERE value <= 50)::BIGINT AS le_50, count(*) FILTER (WHERE value <= 100)::BIGINT AS le_100 FROM events GROUP BY 1
""")
def a16_histogram(t: Tables) -> DataFrame:
    return A.histogram(t.events, "event_type", "value", [10, 50, 100], ["view", "click", "purchase"]).withColumn("total", F.round("total", 2))


@query("""
WITH f AS (SELECT * FROM lineitem WHERE l_quantity >= 48),
a AS (SELECT 0 AS anchor_no, l_orderkey::VARCHAR AS key, list_sort(list(DISTINCT l_returnflag)) AS v, count(DISTINCT l_linenumber) AS n FROM f GROUP BY l_orderkey),
b AS (SELECT 1, l_orderkey || '-' || l_suppkey, list_sort(list(DISTINCT l_returnflag)), count(DISTINCT l_linenumber) FROM f GROUP BY l_orderkey, l_suppkey)
SELECT anchor_no, key, array_to_string(v, ',') AS vals, n::BIGINT AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE len(v) > 1
""")
def a17_value_conflicts(t: Tables) -> DataFrame:
    out = A.value_conflicts(t.lineitem.where("l_quantity >= 48"), [["l_orderkey"], ["l_orderkey", "l_suppkey"]], "l_returnflag", "l_linenumber")
    key = F.regexp_replace(F.regexp_replace("key", r'"[a-z_]+":', ""), r"[{}]", "")
    return out.select("anchor_no", F.replace(key, F.lit(","), F.lit("-")).alias("key"), F.array_join("values", ",").alias("vals"), F.size("ids").cast("long").alias("n"))


@query("""
SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS families FROM orders WHERE o_orderpriority <> 'UNKNOWN' GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1
""")
def a18_family_conflicts(t: Tables) -> DataFrame:
    return A.family_conflicts(t.orders, ["o_custkey"], "o_orderpriority").select("o_custkey", F.array_join("families", ",").alias("families"))


@query("""
SELECT c_custkey, CASE WHEN count(l_orderkey) FILTER (WHERE l_quantity > 45) > 0 THEN NULL WHEN count(DISTINCT o_orderkey) = 0 THEN 'NO_DECISIONS' WHEN count(l_orderkey) FILTER (WHERE l_quantity > 20) = 0 THEN 'NO_RESOLVED_EFFECTS' ELSE 'NO_TAGGED_TARGET' END AS reason
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey
""")
def a19_zero_reason(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 45).alias("hi"), F.count_if(F.col("l_quantity") > 20).alias("mid"))
    o = t.orders.join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("hi").alias("hi"), F.sum("mid").alias("mid"))
    out = t.customer.select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return out.select("c_custkey", A.zero_reason(n("hi"), n("n"), n("mid")).alias("reason"))


@query("""
WITH s AS (SELECT DISTINCT user_id, event_type FROM events), r AS (SELECT *, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 WHEN 'error' THEN 5 END AS k FROM s)
SELECT user_id, arg_max(event_type, k) AS event_type, count(*)::BIGINT AS n FROM r GROUP BY user_id
""")
def a20_worst_severity(t: Tables) -> DataFrame:
    return A.worst(t.events.select("user_id", "event_type"), ["user_id"], "event_type", ["view", "click", "signup", "purchase", "error"])


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::BIGINT AS ordinal FROM orders")
def w01_ordinals(t: Tables) -> DataFrame:
    return W.ordinal(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", F.col("ordinal").cast("long").alias("ordinal"))


@query("""
SELECT l_suppkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1
""")
def w03_primary_row(t: Tables) -> DataFrame:
    line = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return W.primary(line, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_suppkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query("""
WITH e AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 OR value > 90 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM e
""")
def w05_runs(t: Tables) -> DataFrame:
    return W.runs(t.events, ["user_id"], ["ts", "event_id"], "event_type", F.col("value") > 90).select("event_id", "run")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id)::BIGINT AS n, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS is_last FROM events")
def w06_last_in_partition(t: Tables) -> DataFrame:
    return W.last_in_partition(t.events, ["user_id"], ["ts", "event_id"]).select("event_id", "n", "is_last")


@query("""
WITH c AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE (conv_id + turn) % 9 <> 4)
SELECT conv_id, count(*)::BIGINT AS n, bool_and(turn = coalesce(p + 1, 0)) AS contiguous FROM c GROUP BY conv_id
""")
def w07_contiguity(t: Tables) -> DataFrame:
    return W.contiguity(t.conversations.where("(conv_id + turn) % 9 <> 4"), ["conv_id"], "turn", 0)


@query("SELECT p_partkey, substr(sha256(p_name || chr(31) || p_brand), 1, 16) AS digest, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey)::BIGINT - 1 AS collision FROM part")
def w08_collisions(t: Tables) -> DataFrame:
    out = W.collision_ordinal(t.part, S.digest(["p_name", "p_brand"], 16), ["p_partkey"])
    return out.select("p_partkey", "digest", F.col("collision").cast("long").alias("collision"))


@query("""
SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderkey DESC) AS r FROM orders) WHERE r = 1
""")
def w09_priority_pick(t: Tables) -> DataFrame:
    return W.by_priority(t.orders, ["o_custkey"], "o_orderstatus", ["P", "O", "F"], "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""
SELECT s_nationkey, l_suppkey, l_shipmode, alias FROM (SELECT s_nationkey, l_suppkey, l_shipmode, 'E' || lpad((row_number() OVER (PARTITION BY s_nationkey ORDER BY l_suppkey, l_shipmode))::VARCHAR, 3, '0') AS alias
FROM (SELECT DISTINCT s_nationkey, l_suppkey, l_returnflag AS l_shipmode FROM lineitem JOIN supplier ON l_suppkey = s_suppkey))
""")
def w10_aliases(t: Tables) -> DataFrame:
    x = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "l_suppkey", F.col("l_returnflag").alias("l_shipmode"))
    return W.aliases(x, ["s_nationkey"], ["l_suppkey", "l_shipmode"])


@query("SELECT o_orderkey, o_totalprice, count(*) OVER ()::BIGINT AS total FROM orders ORDER BY o_orderkey DESC LIMIT 20 OFFSET 40")
def l02_page(t: Tables) -> DataFrame:
    return W.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_orderkey")], 40, 20)


@query("SELECT l_suppkey, count(*)::BIGINT AS n, array_to_string(list_sort(list(l_orderkey * 10 + l_linenumber))[1:5], ',') AS ids FROM lineitem GROUP BY l_suppkey")
def l04_preview(t: Tables) -> DataFrame:
    x = t.lineitem.select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return W.preview(x, ["l_suppkey"], "id").select("l_suppkey", "n", F.array_join(F.transform("ids", lambda v: v.cast("string")), ",").alias("ids"))


@query("""
SELECT 'I01' AS code, 'ERROR' AS severity, event_id::VARCHAR AS entity, NULL::VARCHAR AS detail FROM events WHERE event_id % 500 = 0
UNION SELECT 'I02', 'ERROR', l_orderkey::VARCHAR, NULL FROM lineitem WHERE l_orderkey % 400 = 0 UNION SELECT 'I04', 'WARNING', o_orderkey::VARCHAR, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')
UNION SELECT 'I09', 'ERROR', s_nationkey::VARCHAR, count(*)::VARCHAR FROM supplier GROUP BY s_nationkey HAVING count(*) > 1
""")
def i11_integrity_issues(t: Tables) -> DataFrame:
    """Checks over tables into which defects are put: blanked text, missing parents, values outside a list, repeated keys."""
    events = t.events.withColumn("props", F.when(F.col("event_id") % 500 == 0, F.lit("  ")).otherwise(F.col("props")))
    some = t.orders.where("o_orderkey % 400 <> 0")
    return C.all_issues(
        C.issue(C.blank(events, "props"), "I01", F.col("event_id")),
        C.issue(C.orphans(t.lineitem, some, "l_orderkey", "o_orderkey"), "I02", F.col("l_orderkey")),
        C.issue(C.outside_catalogue(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]), "I04", F.col("o_orderkey"), F.col("o_orderpriority"), "WARNING"),
        C.issue(C.duplicates(t.supplier, ["s_nationkey"]), "I09", F.col("s_nationkey"), F.col("n")),
    )


@query("""
SELECT l_orderkey, l_suppkey, 'dst' AS side FROM lineitem WHERE l_suppkey % 10 = 3 AND l_quantity = 50 UNION ALL SELECT l_orderkey, l_suppkey, 'src' FROM lineitem WHERE l_orderkey % 20 = 0 AND l_quantity = 50
""")
def i10_dangling_edges(t: Tables) -> DataFrame:
    e = t.lineitem.where("l_quantity = 50").select("l_orderkey", F.col("l_suppkey"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    nodes = t.orders.where("o_orderkey % 20 <> 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id")).union(t.supplier.where("s_suppkey % 10 <> 3").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))))
    return C.dangling(e, nodes, "src", "dst", "id").select("l_orderkey", "l_suppkey", "side")


@query("SELECT o_custkey, count(DISTINCT (o_orderstatus, o_orderpriority))::BIGINT AS versions FROM orders GROUP BY o_custkey HAVING count(DISTINCT (o_orderstatus, o_orderpriority)) > 1")
def f07_differing_content(t: Tables) -> DataFrame:
    return C.differing(t.orders, ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query("""
WITH c AS (
  SELECT c_custkey, ('0x' || substr(sha256(c_custkey::VARCHAR), 1, 8))::BIGINT % 100 AS b, c_acctbal < 0 AS deny, c_mktsegment = 'BUILDING' AS allow,
    c_nationkey % 4 IN (0, 2) AS by_list, c_nationkey % 4 IN (1, 2) AS by_bucket FROM customer
), r AS (
  SELECT *, CASE WHEN deny THEN 'denylisted' WHEN by_list AND allow THEN 'allowlisted' WHEN by_bucket AND b < 25 THEN 'bucket_selected' WHEN by_bucket THEN 'bucket_not_selected'
    WHEN by_list THEN 'not_allowlisted' ELSE 'strategy_never_selects_without_match' END AS reason FROM c
)
SELECT c_custkey, reason IN ('allowlisted', 'bucket_selected') AS selected, CASE WHEN by_bucket AND NOT deny THEN b END AS bucket, reason,
  CASE WHEN deny THEN allow ELSE by_list AND allow END AS matched_allowlist, deny AS matched_denylist FROM r
""")
def x33_canary(t: Tables) -> DataFrame:
    """Four strategies by nation; who owes is denied, one segment is allowed."""
    n = F.col("c_nationkey") % 4
    strategy = F.when(n == 0, S.BY_LIST).when(n == 1, S.BY_BUCKET).when(n == 2, S.BY_EITHER)
    picked = S.canary(F.col("c_acctbal") < 0, F.col("c_mktsegment") == "BUILDING", F.col("c_custkey").cast("string"), 25, strategy)
    return t.customer.select("c_custkey", picked.alias("x")).select("c_custkey", "x.*")


@query("""
WITH p AS (SELECT p_partkey, p_size, p_partkey % 12 AS m FROM part)
SELECT p_partkey, CASE WHEN m IN (1, 7, 11) THEN 'UNRESOLVED' WHEN m IN (2, 9) THEN 'PARTIAL' ELSE 'EXACT' END AS status,
  CASE WHEN m IN (0, 2, 6, 8, 9) THEN 2 ELSE 1 END AS conjuncts,
  CASE WHEN m IN (1, 2, 7, 9, 11) THEN NULL WHEN m IN (3, 6, 10) THEN p_size = 10 WHEN m = 8 THEN false ELSE true END AS applies FROM p
""")
def f10_predicates(t: Tables) -> DataFrame:
    """Predicates made from the parts, read back and tried on the part's own values: doubled
    quotes, quoted columns, nested parentheses, ANDs in quotes and in parentheses."""
    brand, size = F.col("p_brand"), F.col("p_size").cast("string")
    texts = [
        F.concat(F.lit("BRAND = '"), brand, F.lit("' AND SIZE = "), size), F.lit("BRAND = :V"), F.lit("BRAND = 'x AND y' AND SIZE IN (1)"), F.lit("SIZE = 10.0"), F.lit("NAME = 'O''BRIEN'"),
        F.concat(F.lit('("size" = '), size, F.lit(")")), F.concat(F.lit("((SIZE = 10) and (BRAND = '"), brand, F.lit("'))")), F.lit("A.B = 1"), F.lit("NAME = 'a'' AND ''b' and SIZE = -1"), F.lit("SIZE = 10 AND (A = 1 AND B = 2)"),
        F.lit("( ( (SIZE=10) ) )"), F.lit("(A = 1) OR (B = 2)"),
    ]
    text = F.get(F.array(*texts), (F.col("p_partkey") % 12).cast("int"))
    row = F.create_map(F.lit("BRAND"), brand, F.lit(" size "), size, F.lit("NAME"), F.lit("O'BRIEN "))
    p = t.part.select("p_partkey", text.alias("predicate"), row.alias("row"))
    p = p.withColumn("parts", S.conjuncts(F.col("predicate"))).withColumn("cmp", S.comparisons(F.col("parts")))
    p = p.withColumn("status", S.predicate_status(F.col("parts"), F.col("cmp")))
    return p.select("p_partkey", "status", F.size("parts").alias("conjuncts"), F.when(F.col("status") == "EXACT", S.row_matches(F.col("row"), F.col("cmp"))).alias("applies"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, true AS found, false AS found_missing FROM events")
def f14_json_path(t: Tables) -> DataFrame:
    found, value = S.json_path("props", "$.k")
    missing, _ = S.json_path("props", "$.nothing[0]")
    return t.events.select("event_id", value.cast("long").alias("k"), found.alias("found"), missing.alias("found_missing"))


@query(r"""
SELECT page_id, len(regexp_extract_all(html, '\b\d{4}-\d{2}-\d{2}\b'))::BIGINT AS dates, len(regexp_extract_all(html, '\d+(?:\.\d+)?'))::BIGINT AS numbers, len(regexp_extract_all(html, '"([^"]*)"'))::BIGINT AS quoted FROM pages
""")
def f22_tokens(t: Tables) -> DataFrame:
    n = lambda c: F.size(c).cast("long")
    return t.pages.select("page_id", n(S.iso_dates(F.col("html"))).alias("dates"), n(S.numbers(F.col("html"))).alias("numbers"), n(S.double_quoted(F.col("html"))).alias("quoted"))


@query("""
WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND n IS NULL THEN 'DROPPED' WHEN n >= 5 THEN 'REFINED' ELSE 'KEPT' END AS outcome FROM orders LEFT JOIN a ON k = o_orderkey AND n > 2
""")
def x13_superseded(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n")).where("n > 2")
    out = t.orders.join(n, F.col("k") == F.col("o_orderkey"), "left")
    return out.select("o_orderkey", A.ladder(((F.col("o_orderstatus") == "F") & F.col("n").isNull(), "DROPPED"), (F.col("n") >= 5, "REFINED"), otherwise="KEPT").alias("outcome"))
