"""Program-shaped queries: detectors, call linkage, control edges, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.operators import aggregates as A
from strandgraph.operators import candidates as X
from strandgraph.operators import checks as C
from strandgraph.operators import derive as D
from strandgraph.operators import effects as E
from strandgraph.operators import graph as G
from strandgraph.operators import joins as J
from strandgraph.operators import windows as W
from strandgraph.plans.registry import Tables, query
from strandgraph.sources import packages as P
from strandgraph.sources import sinks as K

# --- detectors --------------------------------------------------------------


def _facts(t: Tables) -> DataFrame:
    """Events as facts on an item per event type."""
    k = F.col("event_type")
    return t.events.select(
        F.col("event_id").alias("statement_id"), k.alias("target"), F.when(k.isin("purchase", "click"), F.col("value").cast("int").cast("string")).alias("literal"),
        F.when(k == "error", "BARRIER").otherwise("PARTIAL").alias("status"),
    )


def _inside(t: Tables) -> DataFrame:
    return t.events.where("user_id is not null").select(F.col("event_id").alias("statement_id"), F.col("user_id").alias("decision"))


def _tags(t: Tables) -> DataFrame:
    rows = [("purchase", "return_code"), ("error", "return_code"), ("view", "return_code"), ("view", "return_code"), ("click", "status")]
    return t.spark.createDataFrame(rows, "item string, tag string")


@query("""
SELECT event_id AS statement_id, event_type AS target, user_id AS decision, CASE event_type WHEN 'purchase' THEN 'DETERMINISTIC' WHEN 'error' THEN 'BLOCKED' ELSE 'PARTIAL' END AS support,
  CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'error' THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence FROM events WHERE event_type IN ('purchase', 'error', 'view')
""")
def x01_return_codes(t: Tables) -> DataFrame:
    return X.return_code_candidates(_facts(t), _tags(t), _inside(t)).select("statement_id", "target", "decision", "support", "confidence")


@query("SELECT event_id AS statement_id, event_type AS source, 'RC' AS parent, 'LEVEL_88_RETURN_CODE' AS family FROM events WHERE event_type IN ('purchase', 'error')")
def x02_condition_codes(t: Tables) -> DataFrame:
    conditions = t.spark.createDataFrame([("purchase", "RC"), ("error", "RC"), ("view", "OTHER")], "condition string, parent string")
    tags = t.spark.createDataFrame([("RC", "return_code"), ("OTHER", "status")], "item string, tag string")
    facts = t.events.select(F.col("event_id").alias("statement_id"), F.col("event_type").alias("source"))
    return X.condition_candidates(facts, conditions, tags).select("statement_id", "source", "parent", "family")


@query("SELECT event_id AS statement_id, trunc(value)::INT::VARCHAR AS literal, user_id AS decision, 'PARTIAL' AS support FROM events WHERE event_type = 'click'")
def x03_state_changes(t: Tables) -> DataFrame:
    return X.state_candidates(_facts(t), _tags(t), _inside(t)).select("statement_id", "literal", "decision", "support")


@query("SELECT event_id AS statement_id, user_id AS decision FROM events WHERE event_type = 'signup'")
def x04_calculations(t: Tables) -> DataFrame:
    effects = t.events.select(F.col("event_id").alias("statement_id"), F.when(F.col("event_type") == "signup", "COMPUTE").otherwise("CALL").alias("kind"))
    return X.calculation_candidates(effects, _inside(t)).select("statement_id", "decision")


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS evidence, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS states FROM orders GROUP BY o_custkey")
def x05_merged_evidence(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", F.array("o_orderpriority").alias("evidence"), F.array("o_orderstatus").alias("states"))
    return X.merge_evidence(o, "o_custkey", ["evidence", "states"]).select("o_custkey", F.array_join("evidence", ",").alias("evidence"), F.array_join("states", ",").alias("states"))


@query("""
WITH x AS (SELECT o_custkey, o_orderpriority, arg_min(o_orderstatus, o_orderkey) AS entry, arg_max(o_orderstatus, o_orderkey) AS exit FROM orders GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority, entry, exit FROM x WHERE entry <> exit AND o_orderpriority IN ('1-URGENT', '2-HIGH')
""")
def x07_transitions(t: Tables) -> DataFrame:
    """The state that a customer's first and last order of a priority have, where it changes."""
    tags = t.spark.createDataFrame([("1-URGENT", "state"), ("2-HIGH", "status"), ("3-MEDIUM", "return_code")], "item string, tag string")
    o = t.orders.groupBy("o_custkey", "o_orderpriority")
    entries = o.agg(F.min_by("o_orderstatus", "o_orderkey").alias("literal"))
    exits = o.agg(F.max_by("o_orderstatus", "o_orderkey").alias("literal"))
    return X.transitions(entries, exits, ["o_custkey", "o_orderpriority"], tags).select("o_custkey", "o_orderpriority", "entry", "exit")


@query("SELECT o_orderkey AS id, o_orderstatus AS state, NULL AS place, 'orders' AS source FROM orders UNION ALL SELECT c_custkey, NULL, c_mktsegment, 'customer' FROM customer")
def x14_unified(t: Tables) -> DataFrame:
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    b = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("place"))
    return X.unify({"orders": a, "customer": b}, ["id", "state", "place"])


@query("""
WITH d AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS s FROM orders),
n AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, count(s) OVER (PARTITION BY o_custkey) AS m FROM d)
SELECT o_orderkey, CASE WHEN n = 1 OR m = 1 AND n = 2 THEN 'STANDS' ELSE 'REJECTED' END AS outcome FROM n WHERE n <> 2 OR m <> 1 OR s IS NOT NULL
""")
def x19_active_decisions(t: Tables) -> DataFrame:
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    d = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, before).alias("s"))
    stands, rejected = X.active_decisions(d, "o_custkey", "o_orderkey", "s")
    return stands.select("o_orderkey", F.lit("STANDS").alias("outcome")).union(rejected.select("o_orderkey", F.lit("REJECTED")))


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'NOT_EVALUATED' WHEN c_acctbal < 0 THEN 'BLOCKED' WHEN c_acctbal > 1000 AND c_nationkey % 3 <> 0 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'QUALIFIED_WITH_WARNINGS' ELSE 'QUALIFIED' END ELSE 'REVIEW_REQUIRED' END AS disposition FROM customer
""")
def x29_group_dispositions(t: Tables) -> DataFrame:
    bal, nation = F.col("c_acctbal"), F.col("c_nationkey")
    return X.group_disposition(t.customer, F.col("c_mktsegment") == "MACHINERY", bal < 0, bal > 1000, nation % 3 != 0, nation % 2 == 0).select("c_custkey", "disposition")


@query(r"""
SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<script') THEN '(?i)<script' WHEN regexp_matches(html, 'https?://') THEN 'https?://' ELSE '(?i)<p' END AS pattern FROM pages WHERE regexp_matches(html, '(?i)<script|https?://|<p')
""")
def x38_suspicious(t: Tables) -> DataFrame:
    return X.suspicious(t.pages, "html", ["(?i)<script", "https?://", "(?i)<p"]).select("page_id", "pattern")


def _catalogue(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderpriority").alias("alias")).distinct()


@query("""
WITH c AS (SELECT DISTINCT o_custkey, o_orderpriority AS alias FROM orders WHERE o_orderstatus = 'F'), e AS (SELECT o_custkey, o_orderkey, o_orderpriority AS alias FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, o_orderkey, 'E001' FROM orders WHERE o_orderstatus = 'O')
SELECT e.o_orderkey, e.alias, c.alias IS NOT NULL AS known FROM e LEFT JOIN c ON c.o_custkey = e.o_custkey AND c.alias = e.alias
""")
def x39_aliases(t: Tables) -> DataFrame:
    claims = t.orders.where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", F.array("o_orderpriority", F.lit("E001")).alias("aliases"))
    known, unknown = X.resolve_aliases(claims, _catalogue(t), "aliases", "o_orderkey", ["o_custkey"])
    return known.select("o_orderkey", "alias", F.lit(True).alias("known")).union(unknown.select("o_orderkey", "alias", F.lit(False)))


@query("""
WITH c AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS ok FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_orderkey, ok IS NOT NULL AND NOT list_contains(ok, o_orderpriority) AS repaired, CASE WHEN ok IS NOT NULL AND NOT list_contains(ok, o_orderpriority) THEN o_orderpriority || ',' || array_to_string(ok, ',') ELSE o_orderpriority END AS aliases
FROM orders o LEFT JOIN c ON c.o_custkey = o.o_custkey WHERE o_orderstatus = 'O'
""")
def x40_anchored_claims(t: Tables) -> DataFrame:
    claims = t.orders.where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", F.array("o_orderpriority").alias("aliases"))
    return X.anchored_claims(claims, _catalogue(t), ["o_custkey"], "aliases").select("o_orderkey", "repaired", F.array_join("aliases", ",").alias("aliases"))


# --- between programs and within graphs --------------------------------------


@query("""
WITH a AS (SELECT 'n' || c_nationkey AS program, c_mktsegment AS formal, CASE WHEN c_acctbal < 2000 THEN 'LOW' ELSE 'HIGH' END AS v FROM customer),
one AS (SELECT program, formal, CASE WHEN min(v) = max(v) THEN min(v) END AS literal, min(v) <> max(v) AS conflicted FROM a GROUP BY 1, 2),
b AS (SELECT 's' || s_suppkey % 37 AS program, CASE WHEN s_suppkey % 2 = 0 THEN 'LOW' ELSE one.literal END AS v FROM supplier LEFT JOIN one ON one.program = 'n' || s_nationkey AND formal = 'BUILDING')
SELECT * FROM one UNION ALL SELECT program, 'X', CASE WHEN min(v) = max(v) THEN min(v) END, min(v) <> max(v) FROM b WHERE v IS NOT NULL GROUP BY program
""")
def e10_entry_facts(t: Tables) -> DataFrame:
    """Literals from a root to nations, and through them to groups of suppliers."""
    null = F.lit(None).cast("string")
    nation = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    first = t.customer.select(F.lit("root").alias("caller"), nation("c_nationkey").alias("callee"), F.col("c_mktsegment").alias("formal"), F.when(F.col("c_acctbal") < 2000, "LOW").otherwise("HIGH").alias("literal"), null.alias("via"))
    even = F.col("s_suppkey") % 2 == 0
    then = t.supplier.select(nation("s_nationkey").alias("caller"), F.concat(F.lit("s"), (F.col("s_suppkey") % 37).cast("string")).alias("callee"), F.lit("X").alias("formal"), F.when(even, "LOW").alias("literal"), F.when(~even, "BUILDING").alias("via"))
    b = first.union(then)
    levels = b.select(F.col("callee").alias("node")).distinct().withColumn("level", F.when(F.startswith("node", F.lit("n")), 1).otherwise(2))
    return E.entry_facts(b, levels)


@query("""
SELECT o_orderkey, CASE WHEN min(o_orderstatus) OVER w = max(o_orderstatus) OVER w THEN o_orderstatus END AS exit, CASE WHEN min(o_orderstatus) OVER w = max(o_orderstatus) OVER w THEN 'PROPAGATED' ELSE 'INVALIDATED' END AS status
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)
""")
def e10_exit_facts(t: Tables) -> DataFrame:
    return E.exit_facts(t.orders, ["o_custkey"], ["o_orderkey"], "o_orderstatus").select("o_orderkey", "exit", "status")


@query("""
WITH c(construct, kind) AS (VALUES ('C1', 'view'), ('C2', 'view'), ('C3', 'error'), ('C4', 'never')) SELECT construct, c.kind, count(e.event_id)::BIGINT AS occurrences, count(DISTINCT user_id)::BIGINT AS programs FROM c LEFT JOIN events e ON e.event_type = c.kind GROUP BY ALL
""")
def e12_observations(t: Tables) -> DataFrame:
    constructs = t.spark.createDataFrame([("C1", "view"), ("C2", "view"), ("C3", "error"), ("C4", "never")], "construct string, kind string")
    return A.observations(t.events.withColumnRenamed("event_type", "kind"), constructs, "kind", "user_id").select("construct", "kind", "occurrences", "programs")


_CONTROL = """par AS (SELECT n_regionkey AS program, n_name AS name FROM nation UNION ALL SELECT n_regionkey, n_name FROM nation WHERE n_nationkey % 5 = 0),
idx AS (SELECT program, upper(trim(name)) AS k, count(*) AS n FROM par GROUP BY 1, 2),
tok AS (
  SELECT a.n_regionkey AS program, a.n_name AS paragraph, c_custkey AS statement_id, c_mktsegment AS construct, lower(b.n_name) AS target
  FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON b.n_nationkey = c_custkey * 7 % 25
), r AS (
  SELECT tok.*, CASE WHEN n IS NULL THEN 'UNRESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' WHEN upper(target) = upper(paragraph) THEN 'SELF' END AS reason FROM tok LEFT JOIN idx ON idx.program = tok.program AND k = upper(target)
)"""


def _control(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Jumps between nations of one region; some names are there twice, some in another region."""
    names = t.nation.select(F.col("n_regionkey").alias("program"), F.col("n_name").alias("name"), "n_nationkey")
    paragraphs = names.union(names.where("n_nationkey % 5 = 0")).select("program", "name")
    to = t.nation.select(F.col("n_nationkey").alias("to_key"), F.lower("n_name").alias("target"))
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(to, F.col("c_custkey") * 7 % 25 == F.col("to_key"))
    targets = c.select(F.col("n_regionkey").alias("program"), F.col("n_name").alias("paragraph"), F.col("c_custkey").alias("statement_id"), F.col("c_mktsegment").alias("construct"), "target")
    return D.control_edges(targets, paragraphs)


@query(f"""
WITH {_CONTROL} SELECT program, paragraph AS "from", upper(target) AS "to", construct, min(statement_id) AS "primary", array_to_string(list_sort(list(DISTINCT statement_id)), ',') AS evidence FROM r WHERE reason IS NULL GROUP BY ALL
""")
def d01_control_edges(t: Tables) -> DataFrame:
    return _control(t)[0].withColumn("evidence", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ","))


@query(f"WITH {_CONTROL} SELECT program, paragraph, target, reason FROM r WHERE reason IS NOT NULL")
def d01_control_warnings(t: Tables) -> DataFrame:
    return _control(t)[1]


@query("""
WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type IN ('view', 'error')) SELECT user_id AS paragraph, event_id AS pos, n::BIGINT AS ordinal FROM s
""")
def d08_numbered_decisions(t: Tables) -> DataFrame:
    s = t.events.select(F.lit("P").alias("program"), F.col("user_id").alias("paragraph"), F.col("event_id").alias("pos"), F.col("event_type").alias("kind"))
    return D.numbered_decisions(s, ["view", "error"]).select("paragraph", "pos", F.col("ordinal").cast("long").alias("ordinal"))


@query("""
WITH tok AS (SELECT p_partkey AS token_id, CASE p_partkey % 3 WHEN 0 THEN p_brand || '.' || p_name WHEN 1 THEN lower(p_name) ELSE 'none' || p_partkey END AS token FROM part),
q AS (SELECT upper(trim(p_brand || '.' || p_name)) AS k, count(*) AS n, min('t' || p_partkey) AS t FROM part GROUP BY 1), s AS (SELECT upper(trim(p_name)) AS k, count(*) AS n, min('t' || p_partkey) AS t FROM part GROUP BY 1),
r AS (SELECT token_id, token, CASE WHEN q.n = 1 THEN q.t WHEN q.n IS NULL AND s.n = 1 THEN s.t END AS target, coalesce(q.n > 1, false) OR (q.n IS NULL AND coalesce(s.n > 1, false)) AS warning FROM tok LEFT JOIN q ON q.k = upper(trim(token)) LEFT JOIN s ON s.k = upper(trim(token)))
SELECT token_id, coalesce(target, 'table::' || upper(trim(token))) AS table_node, target IS NULL AS operational, warning FROM r
""")
def d10_table_nodes(t: Tables) -> DataFrame:
    m, key = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    full = F.concat("p_brand", F.lit("."), "p_name")
    tokens = t.part.select(F.col("p_partkey").alias("token_id"), F.when(m == 0, full).when(m == 1, F.lower("p_name")).otherwise(F.concat(F.lit("none"), key)).alias("token"))
    tables = t.part.select(full.alias("qualified"), F.col("p_name").alias("terminal"), F.concat(F.lit("t"), key).alias("table_id"))
    return D.resolve_table(tokens, tables, "token", []).select("token_id", "table_node", "operational", "warning")


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' END AS term, o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AS warning FROM orders")
def d18_mapped_terms(t: Tables) -> DataFrame:
    glossary = t.spark.createDataFrame([("1-URGENT", "urgent"), ("2-HIGH", "high"), ("2-HIGH", "high")], "o_orderpriority string, term string")
    return D.mapped_terms(t.orders.select("o_orderkey", "o_orderpriority"), glossary, "o_orderpriority", "term").select("o_orderkey", "term", "warning")


@query("""
SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT (o_orderstatus = 'F' AND (o_orderpriority = '1-URGENT' OR c_mktsegment = 'BUILDING') AND c_mktsegment IN ('BUILDING', 'MACHINERY') OR o_orderstatus = 'O' AND o_orderpriority = '5-LOW' AND c_mktsegment = 'FURNITURE')
""")
def j13_signatures(t: Tables) -> DataFrame:
    s = t.spark.createDataFrame([("F", "any", "BUILDING"), ("F", "1-URGENT", "MACHINERY"), ("O", "5-LOW", "FURNITURE")], "type string, src_label string, dst_label string")
    e = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_orderstatus").alias("type"), F.array(F.lit("any"), F.col("o_orderpriority")).alias("src_labels"), F.array("c_mktsegment").alias("dst_labels"))
    return J.allowed_endpoints(e, s).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size % 5 = 0 AND p_partkey % 3 <> 0")
def i07_lacking_labels(t: Tables) -> DataFrame:
    labels = F.array_compact(F.array(F.when(F.col("p_size") % 5 == 0, "ParameterTable"), F.when(F.col("p_partkey") % 3 == 0, "Table")))
    return C.lacks_label(t.part.select("p_partkey", labels.alias("labels")), "ParameterTable", "Table").select("p_partkey")


@query("""
SELECT min(c_custkey) AS component, array_to_string(list_sort(list(c_custkey)), ',') AS members, count(DISTINCT c_custkey % 2) = 1 AS consistent
FROM customer GROUP BY c_nationkey, c_mktsegment, round(c_acctbal / 500)
""")
def g07_consistent_groups(t: Tables) -> DataFrame:
    """Customers of one place and balance in a chain; edges that lead out of the members do not count."""
    w = Window.partitionBy("c_nationkey", "c_mktsegment", F.round(F.col("c_acctbal") / 500)).orderBy("c_custkey")
    members = t.customer.withColumn("parity", F.col("c_custkey") % 2)
    edges = members.select(F.col("c_custkey").alias("src"), F.lead("c_custkey").over(w).alias("dst")).union(t.customer.select("c_custkey", -F.floor(F.col("c_custkey") / 10) - 1))
    out = G.grouped_consistency(members, edges, "c_custkey", ["parity"])
    return out.select("component", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), "consistent")


@query()
def g05_ordered_calls(t: Tables) -> DataFrame:
    """Topological order with ties by name within each brand; the fixtures hold hand-derived orders."""
    name = lambda c: F.lpad(c.cast("string"), 3, "0")
    calls = t.part.select(F.col("p_brand").alias("g"), name(F.col("p_partkey") % 40).alias("src"), F.when(F.col("p_size") % 7 > 0, name((F.col("p_partkey") * 3 + F.col("p_size")) % 40)).alias("dst"))
    return G.ordered_calls(calls, "g")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS line FROM lineitem WHERE l_quantity = 50 AND l_discount = 0")
def l03_hard_cap(t: Tables) -> DataFrame:
    """Nothing is cut: more rows than the cap are an error."""
    out = t.lineitem.where("l_quantity = 50 and l_discount = 0").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"))
    return W.at_most(out, 1_000_000, "lines")


# --- sources and sinks ---------------------------------------------------------


@query("""
WITH e AS (SELECT CASE WHEN p_partkey % 100 = 0 THEN '../' ELSE 'd/' END || CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE lower(p_name) END AS name, p_partkey * 10 AS size, p_size AS packed FROM part)
SELECT 'UNSAFE_PATH' AS code, name AS entry FROM e WHERE name LIKE '../%' UNION ALL SELECT 'NAME_COLLISION', min(name) FROM e GROUP BY lower(name) HAVING count(*) > 1
UNION ALL SELECT 'COMPRESSION_RATIO', name FROM e WHERE size > 200 * greatest(packed, 1) UNION ALL SELECT 'TOO_MANY_ENTRIES', NULL UNION ALL SELECT 'TOO_LARGE', NULL
""")
def s01_entry_problems(t: Tables) -> DataFrame:
    head = F.when(F.col("p_partkey") % 100 == 0, "../").otherwise("d/")
    name = F.concat(head, F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.lower("p_name")))
    return P.entry_problems(t.part.select(name.alias("name"), (F.col("p_partkey") * 10).alias("size"), F.col("p_size").alias("packed")), max_entries=100, max_bytes=10_000)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def s07_missing_paths(t: Tables) -> DataFrame:
    return P.missing_paths(t.orders, t.lineitem.where("l_quantity > 40"), "o_orderkey", "l_orderkey").select("o_orderkey")


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(p_brand) WHEN 1 THEN 'T' || p_size WHEN 3 THEN 'S.T' || p_size END AS "table", CASE p_partkey % 4 WHEN 0 THEN 'READS' WHEN 1 THEN 'UPDATES' WHEN 3 THEN 'INSERTS' END AS operation,
  CASE p_partkey % 4 WHEN 0 THEN 'P_SIZE = :W' WHEN 1 THEN 'B = ' || p_size END AS predicate, CASE p_partkey % 4 WHEN 0 THEN 'V,W' WHEN 1 THEN 'V' WHEN 2 THEN '' ELSE 'X' END AS hosts FROM part
""")
def s11_sql_access(t: Tables) -> DataFrame:
    """Embedded statements made from the parts, read back."""
    m, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    sql = (
        F.when(m == 0, F.concat(F.lit("EXEC SQL SELECT P_SIZE INTO :V FROM "), F.lower("p_brand"), F.lit("\n WHERE P_SIZE = :W END-EXEC"))).when(m == 1, F.concat(F.lit("UPDATE T"), size, F.lit(" SET A = :V:IND WHERE B = "), size))
        .when(m == 2, F.lit("DELETE FROM X JOIN Y ON 1 = 1")).otherwise(F.concat(F.lit("insert into s.t"), size, F.lit(" (A) values (:X)")))
    )
    a = t.part.select("p_partkey", P.sql_access(sql).alias("a"))
    return a.select("p_partkey", "a.table", "a.operation", "a.predicate", F.array_join("a.host_variables", ",").alias("hosts"))


def _snapshot(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A file of customers per nation: some with longer rows, some with headers that are equal but for case."""
    key = F.col("c_custkey")
    number = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) + 1
    rows = t.customer.select(F.col("c_nationkey").alias("file"), number.alias("line_no"), F.concat(key.cast("string"), F.lit(", "), "c_mktsegment", F.when(key % 100 == 0, ",extra").otherwise("")).alias("line"))
    heads = t.nation.select(F.col("n_nationkey").alias("file"), F.lit(1).alias("line_no"), F.when(F.col("n_nationkey") % 5 == 3, "id, ID").otherwise("ID,segment").alias("line"))
    return P.snapshot_rows(heads.union(rows))


@query("""
SELECT c_nationkey AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::BIGINT AS row_number, sha256('["' || c_custkey || '"," ' || c_mktsegment || '"]') AS row_hash, ' ' || c_mktsegment AS raw, c_mktsegment AS segment FROM customer WHERE c_nationkey % 5 <> 3
""")
def s14_snapshot_rows(t: Tables) -> DataFrame:
    return _snapshot(t)[0].select("file", "row_number", "row_hash", F.col("raw")["segment"].alias("raw"), F.col("normalized")["SEGMENT"].alias("segment"))


@query("""
SELECT n_nationkey AS file, CASE WHEN n_nationkey % 5 = 3 THEN 'UNSUPPORTED' WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 100 = 0) THEN 'PARTIAL' ELSE 'SUPPORTED' END AS status FROM nation
""")
def s14_snapshot_status(t: Tables) -> DataFrame:
    return _snapshot(t)[1]


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS terms FROM part WHERE p_size = 3 GROUP BY p_brand HAVING count(DISTINCT p_type) > 1")
def s16_unclear_terms(t: Tables) -> DataFrame:
    return P.unclear_terms(t.part.where("p_size = 3"), "p_brand", "p_type").select("p_brand", F.array_join("terms", ",").alias("terms"))


@query("""
WITH s AS (SELECT user_id, ts, event_type AS st, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS r FROM events WHERE event_type <> 'error'), e AS (SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT coalesce(s.user_id, e.user_id) AS run, CASE WHEN e.ts IS NOT NULL AND (s.ts IS NULL OR (st <> 'purchase' AND e.ts > s.ts)) THEN 'error' ELSE st END AS status, e.ts IS NOT NULL AND (s.ts IS NULL OR (st <> 'purchase' AND e.ts > s.ts)) AS emergency
FROM (SELECT * FROM s WHERE r = 1) s FULL JOIN e ON s.user_id = e.user_id
""")
def s20_latest_states(t: Tables) -> DataFrame:
    error = F.col("event_type") == "error"
    return P.latest_state(t.events.where(~error), t.events.where(error), "user_id", "ts", "event_type", ["purchase"]).select("run", "status", "emergency")


@query(r"""
SELECT p_partkey, '# ' || regexp_replace(p_name, '([\\`#*_\[\]()!|{}+-])', '\\\1', 'g') || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '- **Brand**: ' || regexp_replace(p_brand, '([\\`#*_\[\]()!|{}+-])', '\\\1', 'g') ELSE '' END AS text FROM part
""")
def k06_markdown(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", K.markdown(F.col("p_name"), {"Brand": F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))}).alias("text"))
