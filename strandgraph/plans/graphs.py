"""Graph queries over keys of the star schema."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.operators import graph as G
from strandgraph.operators import lists as L
from strandgraph.operators.components import connected_components
from strandgraph.operators.templates import Template
from strandgraph.plans.registry import Tables, query


@query("""
SELECT r_name, n_name, s_suppkey, l_orderkey, l_linenumber::BIGINT AS line
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey
WHERE l_returnflag = 'R' AND l_quantity >= 49
""")
def q0_pattern_chain(t: Tables) -> DataFrame:
    """A fixed path region, nation, supplier, line; the sink is filtered before the joins."""
    sink = t.lineitem.where("l_returnflag = 'R' and l_quantity >= 49").select("l_orderkey", "l_linenumber", "l_suppkey")
    out = G.chain(sink, (t.supplier, "l_suppkey", "s_suppkey"), (t.nation, "s_nationkey", "n_nationkey"), (t.region, "n_regionkey", "r_regionkey"))
    return out.select("r_name", "n_name", "s_suppkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("line"))


@query("""
SELECT o_orderkey, c_custkey, c_name, n_name, r_name
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000
""")
def q1_reverse_hierarchy(t: Tables) -> DataFrame:
    """From an order up to its region."""
    start = t.orders.where("o_orderpriority = '1-URGENT' and o_totalprice > 300000").select("o_orderkey", "o_custkey")
    out = G.chain(start, (t.customer, "o_custkey", "c_custkey"), (t.nation, "c_nationkey", "n_nationkey"), (t.region, "n_regionkey", "r_regionkey"))
    return out.select("o_orderkey", "c_custkey", "c_name", "n_name", "r_name")


def _next(t: Tables, kind: int) -> DataFrame:
    """Edges from each order to the next one: 1 of its customer, 2 of its day and priority."""
    by = ["o_custkey"] if kind == 1 else ["o_orderdate", "o_orderpriority"]
    after = F.lead("o_orderkey").over(Window.partitionBy(*by).orderBy("o_orderkey"))
    return t.orders.select(F.col("o_orderkey").cast("long").alias("src"), after.cast("long").alias("dst")).where("dst is not null")


_NEXT = """steps AS (
  SELECT 1 AS m, o_orderkey::BIGINT AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS dst FROM orders
  UNION ALL SELECT 2, o_orderkey::BIGINT, lead(o_orderkey) OVER (PARTITION BY o_orderdate, o_orderpriority ORDER BY o_orderkey)::BIGINT FROM orders
), edge AS (SELECT DISTINCT * FROM steps WHERE dst IS NOT NULL)"""


def _seeds(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").cast("long").alias("seed"))


def _walk(name: str, edges: str, depth: int) -> str:
    return f"""{name} AS (
  SELECT o_orderkey::BIGINT AS seed, o_orderkey::BIGINT AS node, 0 AS depth FROM orders
  UNION SELECT w.seed, e.src, w.depth + 1 FROM {name} w JOIN {edges} e ON e.dst = w.node WHERE w.depth < {depth}
)"""


@query(f"""
WITH RECURSIVE {_NEXT}, one AS (SELECT src, dst FROM edge WHERE m = 1), {_walk("w", "one", 4)}
SELECT seed, node, min(depth)::INT AS depth FROM w WHERE depth > 0 GROUP BY seed, node
""")
def g01_bounded_reach(t: Tables) -> DataFrame:
    return G.reach(_next(t, 1), _seeds(t), 4)


@query(f"""
WITH RECURSIVE {_NEXT}, one AS (SELECT src, dst FROM edge WHERE m = 1), two AS (SELECT src, dst FROM edge WHERE m = 2),
{_walk("a", "one", 2)}, {_walk("b", "two", 2)}, s AS (
  SELECT seed, node, bool_or(lane = 'a') AS a, bool_or(lane = 'b') AS b
  FROM (SELECT 'a' AS lane, seed, node FROM a WHERE depth > 0 UNION ALL SELECT 'b', seed, node FROM b WHERE depth > 0
    UNION ALL SELECT 'own', seed, node FROM a WHERE depth = 0) GROUP BY seed, node
)
SELECT seed, node, CASE WHEN seed = node THEN 'CANDIDATE' WHEN a AND b THEN 'BOTH' WHEN a THEN 'DATA_DEPENDENCY' ELSE 'CONTROL_DEPENDENCY' END AS reason FROM s
""")
def q2_two_lane_slice(t: Tables) -> DataFrame:
    return G.two_lane_slice(_next(t, 1), _next(t, 2), _seeds(t), 2)


@query(f"""
WITH RECURSIVE {_NEXT}, mixed AS (SELECT DISTINCT src, dst FROM edge WHERE m <= 2), {_walk("w", "mixed", 2)}, s AS (SELECT DISTINCT seed, node FROM w)
SELECT s.seed, s.node, list_sort(list(DISTINCT s_suppkey)) AS suppliers
FROM s JOIN lineitem ON l_orderkey = s.node AND l_quantity > 45 JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 5000 GROUP BY s.seed, s.node
""")
def q3_mixed_slice_reads(t: Tables) -> DataFrame:
    """What lies in the mixed slice of each seed, gathered per node."""
    edges = _next(t, 1).union(_next(t, 2))
    line = t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").cast("long").alias("node"), "l_suppkey")
    rich = line.join(t.supplier.where("s_acctbal > 5000").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("node", "s_suppkey").distinct()
    return G.mixed_slice(edges, _seeds(t), 2).join(rich, "node").groupBy("seed", "node").agg(F.array_sort(F.collect_set("s_suppkey")).alias("suppliers"))


@query(f"""
WITH RECURSIVE {_NEXT}, mixed AS (SELECT DISTINCT src, dst FROM edge WHERE m <= 2), {_walk("w", "mixed", 1)}, s AS (SELECT DISTINCT seed, node FROM w),
effects AS (SELECT DISTINCT l_orderkey::BIGINT AS node, l_suppkey AS target FROM lineitem WHERE l_quantity = 50), home AS (SELECT o_orderkey::BIGINT AS node, o_custkey AS program FROM orders)
SELECT seed, s.node, target, CASE WHEN seed = s.node THEN 'DIRECT' ELSE 'DEPENDENCY_SLICE' END AS scope, true AS approved FROM s JOIN effects e ON e.node = s.node
UNION ALL
SELECT h.node, o.node, target, 'PROGRAM_CONTEXT', false FROM home h JOIN home o ON h.program = o.program JOIN effects e ON e.node = o.node
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.seed = h.node AND s.node = o.node)
""")
def q5_scoped_effects(t: Tables) -> DataFrame:
    edges = _next(t, 1).union(_next(t, 2))
    effects = t.lineitem.where("l_quantity = 50").select(F.col("l_orderkey").cast("long").alias("node"), F.col("l_suppkey").alias("target")).distinct()
    home = t.orders.select(F.col("o_orderkey").cast("long").alias("node"), F.col("o_custkey").alias("program"))
    return G.scoped_effects(G.mixed_slice(edges, _seeds(t), 1), effects, home).select("seed", "node", "target", "scope", "approved")


@query("""
SELECT o_orderkey, o_totalprice, s_suppkey, s_acctbal FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
WHERE o_orderkey = 7 AND l_linenumber = 1
""")
def q4_point_lookup(t: Tables) -> DataFrame:
    """One order's first line through both of its keys; the key reaches both scans."""
    o = t.orders.where("o_orderkey = 7").select("o_orderkey", "o_totalprice")
    line = t.lineitem.where("l_orderkey = 7 and l_linenumber = 1").select("l_orderkey", "l_suppkey")
    return G.chain(o, (line, "o_orderkey", "l_orderkey"), (t.supplier, "l_suppkey", "s_suppkey")).select("o_orderkey", "o_totalprice", "s_suppkey", "s_acctbal")


#: The lines Q1, Q4, Q5a and Q6 as texts with parameters, and the values they are asked with.
TEMPLATES = {
    "q1": (
        "SELECT l_orderkey AS id, r_name AS answer FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey "
        "JOIN {region} ON n_regionkey = r_regionkey WHERE l_returnflag = :flag AND l_quantity >= :least",
        [{"flag": "R", "least": 49}, {"flag": "A", "least": 50}, {"flag": "it's", "least": 1}],
    ),
    "q4": ("SELECT o_orderkey AS id, o_orderpriority AS answer FROM {orders} WHERE o_orderkey = :decision OR o_custkey = :decision", [{"decision": 7}, {"decision": 33}, {"decision": -1}]),
    "q5a": (
        "SELECT l_orderkey AS id, l_returnflag AS answer FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE o_orderkey BETWEEN :decision AND :decision + :width",
        [{"decision": 7, "width": 0}, {"decision": 100, "width": 50}, {"decision": 5, "width": -1}],
    ),
    "q6": ("SELECT l_orderkey AS id, l_linestatus AS answer FROM {lineitem} WHERE l_linenumber = :line AND l_quantity = :amount -- not :this", [{"line": 1, "amount": 50}, {"line": 2, "amount": 50.0}, {"line": None, "amount": 50}]),
}


def _templates() -> list[tuple[Template, dict]]:
    count = lambda text: {n: len(re.findall(rf":{n}\b", text)) for n in re.findall(r":(?!this)(\w+)", text)}
    return [(Template(name, text, count(text)), values) for name, (text, asked) in TEMPLATES.items() for values in asked]


def _asked_sql() -> str:
    each = []
    for template, values in _templates():
        effective = template.effective(**values)
        table = re.sub(r"\{(\w+)\}", r"\1", effective).replace("-- not :this", "")
        quoted = lambda x: "'" + x.replace("'", "''") + "'"
        each.append(f"SELECT *, '{template.name}' AS query, sha256({quoted(template.text)}) AS template_sha256, sha256({quoted(effective)}) AS effective_sha256 FROM ({table})")
    return " UNION ALL ".join(each)


@query(_asked_sql())
def q9_bound_queries(t: Tables) -> DataFrame:
    """Four lines as templates, each bound to three sets of values, with the digests of what was meant and of what was run."""
    tables = {n: getattr(t, n) for n in ("lineitem", "supplier", "nation", "region", "orders")}
    used = lambda text: {n: df for n, df in tables.items() if f"{{{n}}}" in text}
    return reduce(DataFrame.unionByName, [template.run(t.spark, used(template.text), **values) for template, values in _templates()])


@query("""
SELECT o_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 'RETURNED' WHEN l_returnflag = 'A' THEN 'ACCEPTED' ELSE 'OPEN' END) AS outcome, count(DISTINCT l_returnflag) AS flags
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def q5a_outcomes(t: Tables) -> DataFrame:
    """The outcome of every decision: of an order, by the flags of its lines."""
    flag = F.col("l_returnflag")
    word = F.when(flag == "R", "RETURNED").when(flag == "A", "ACCEPTED").otherwise("OPEN")
    lines = G.chain(t.orders.select("o_orderkey"), (t.lineitem.select("l_orderkey", "l_returnflag"), "o_orderkey", "l_orderkey"))
    return lines.groupBy("o_orderkey").agg(F.max(word).alias("outcome"), F.count_distinct("l_returnflag").alias("flags"))


@query("""
WITH x AS (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_quantity = 50)
SELECT DISTINCT a.l_orderkey, a.l_partkey, p.l_partkey AS before_part, n.l_partkey AS after_part
FROM x a LEFT JOIN lineitem p ON p.l_orderkey = a.l_orderkey AND p.l_linenumber = a.l_linenumber - 1
LEFT JOIN lineitem n ON n.l_orderkey = a.l_orderkey AND n.l_linenumber = a.l_linenumber + 1
""")
def q6_neighbours(t: Tables) -> DataFrame:
    """Rows with what comes before and after them, both optional."""
    x = t.lineitem.where("l_quantity = 50").select("l_orderkey", "l_partkey", "l_linenumber")
    p = t.lineitem.select(F.col("l_orderkey").alias("po"), (F.col("l_linenumber") + 1).alias("pl"), F.col("l_partkey").alias("before_part"))
    n = t.lineitem.select(F.col("l_orderkey").alias("no"), (F.col("l_linenumber") - 1).alias("nl"), F.col("l_partkey").alias("after_part"))
    out = x.join(p, (x.l_orderkey == p.po) & (x.l_linenumber == p.pl), "left").join(n, (x.l_orderkey == n.no) & (x.l_linenumber == n.nl), "left")
    return out.select("l_orderkey", "l_partkey", "before_part", "after_part").distinct()


@query("""
SELECT DISTINCT c_custkey, n_name, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, m) AS confidence
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT s_nationkey, max(s_acctbal) AS m FROM supplier GROUP BY s_nationkey) ON s_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'
""")
def q7_edge_or_node_value(t: Tables) -> DataFrame:
    """A two-step path whose value is the edge's, else the node's."""
    best = t.supplier.groupBy("s_nationkey").agg(F.max("s_acctbal").alias("m"))
    c = t.customer.where("c_mktsegment = 'BUILDING'")
    out = G.chain(c, (t.nation, "c_nationkey", "n_nationkey"), (best, "n_nationkey", "s_nationkey"))
    return out.select("c_custkey", "n_name", F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), "m").alias("confidence")).distinct()


def _calls(t: Tables) -> DataFrame:
    """Parts that follow each other among an order's returned lines."""
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    lines = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("src"), after.alias("dst"), F.col("l_orderkey").alias("site"))
    return lines.where("dst is not null")


_CALLS = """calls AS (
  SELECT * FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst, l_orderkey AS site FROM lineitem WHERE l_returnflag = 'R') WHERE dst IS NOT NULL
)"""
_CLOSURE = "closure AS (SELECT DISTINCT src, dst FROM calls UNION SELECT c.src, e.dst FROM closure c JOIN calls e ON c.dst = e.src)"
_SCC = f"""{_CALLS}, {_CLOSURE}, nodes AS (SELECT src AS node FROM calls UNION SELECT dst FROM calls), scc AS (
  SELECT node, greatest(node, coalesce(max(a.dst), node)) AS component FROM nodes
  LEFT JOIN closure a ON a.src = node AND EXISTS (SELECT 1 FROM closure b WHERE b.src = a.dst AND b.dst = node) GROUP BY node
)"""


@query(f"WITH RECURSIVE {_SCC} SELECT node, component FROM scc")
def g02_strong_components(t: Tables) -> DataFrame:
    return G.strong_components(_calls(t))


@query(f"""
WITH RECURSIVE {_SCC}, big AS (SELECT component FROM scc GROUP BY component HAVING count(*) > 1), inside AS (SELECT scc.* FROM scc JOIN big USING (component))
SELECT DISTINCT c.src, c.dst, a.node IS NOT NULL AND b.node IS NOT NULL AS part_of_cycle FROM calls c LEFT JOIN inside a ON a.node = c.src LEFT JOIN inside b ON b.node = c.dst
""")
def g03_cycle_edges(t: Tables) -> DataFrame:
    return G.cycles(_calls(t))[1]


@query(f"WITH {_CALLS} SELECT src, dst, list_sort(list(DISTINCT site)) AS sites, src = dst AS recursive FROM calls GROUP BY src, dst")
def g04_collapsed_edges(t: Tables) -> DataFrame:
    return G.collapse(_calls(t), "src", "dst", "site")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT * FROM (SELECT p_partkey::BIGINT AS u, (p_partkey // (2 + p_size % 5))::BIGINT AS v FROM part) WHERE u <> v),
nodes AS (SELECT u AS node FROM e UNION SELECT v FROM e), w AS (
  SELECT node, 0 AS level FROM nodes WHERE node NOT IN (SELECT v FROM e) UNION SELECT e.v, w.level + 1 FROM w JOIN e ON e.u = w.node
)
SELECT node, max(level)::INT AS level FROM w GROUP BY node
""")
def g05_levels(t: Tables) -> DataFrame:
    """Longest-path levels of a graph without cycles."""
    part = F.col("p_partkey").cast("long")
    e = t.part.select(part.alias("src"), F.floor(part / (2 + F.col("p_size") % 5)).cast("long").alias("dst")).distinct()
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst"))
    return G.levels(e, nodes)


_LINKED = "linked AS (SELECT c_custkey AS a, lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment, round(c_acctbal / 500) ORDER BY c_custkey) AS b FROM customer)"


@query(f"""
WITH RECURSIVE {_LINKED}, pairs AS (SELECT a, b FROM linked WHERE b IS NOT NULL UNION SELECT b, a FROM linked WHERE b IS NOT NULL),
w AS (SELECT a AS node, a AS other FROM pairs UNION SELECT w.node, b.b FROM w JOIN pairs b ON b.a = w.other)
SELECT node, min(other) AS component FROM w GROUP BY node
""")
def g07_components(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey", "c_mktsegment", F.round(F.col("c_acctbal") / 500)).orderBy("c_custkey")
    return connected_components(t.customer.select(F.col("c_custkey").alias("src"), F.lead("c_custkey").over(w).alias("dst")))


def _tree(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("node"), F.when(F.col("doc_id") > 0, F.floor((F.col("doc_id") - 1) / 3)).cast("long").alias("parent"), "lang")


_TREE = "tree AS (SELECT doc_id AS node, CASE WHEN doc_id > 0 THEN (doc_id - 1) // 3 END AS parent, lang FROM documents)"
_UP = f"{_TREE}, up AS (SELECT node, node AS ancestor, 0 AS depth FROM tree UNION ALL SELECT u.node, t.parent, u.depth + 1 FROM up u JOIN tree t ON t.node = u.ancestor WHERE t.parent IS NOT NULL)"


@query(f"""
WITH RECURSIVE {_UP}
SELECT u.node, arg_min(u.ancestor, u.depth) AS ancestor, min(u.depth)::INT AS depth FROM up u JOIN tree t ON t.node = u.ancestor WHERE t.lang = 'en' GROUP BY u.node
""")
def g08_nearest_ancestor(t: Tables) -> DataFrame:
    return G.nearest_ancestor(_tree(t), _tree(t).where("lang = 'en'"))


@query(f"""
WITH RECURSIVE {_TREE}, w AS (
  SELECT node AS root, node, 0 AS depth FROM tree WHERE lang = 'de' UNION ALL SELECT w.root, t.node, w.depth + 1 FROM w JOIN tree t ON t.parent = w.node WHERE t.lang <> 'en'
)
SELECT root, node, depth::INT AS depth FROM w WHERE depth > 0
""")
def g09_pruned_descent(t: Tables) -> DataFrame:
    return G.pruned_descent(_tree(t), _tree(t).where("lang = 'de'"), F.col("lang") == "en")


@query(f"WITH RECURSIVE {_UP} SELECT u.ancestor AS node, bool_or(t.lang = 'es') AS found FROM up u JOIN tree t ON t.node = u.node GROUP BY u.ancestor")
def g11_subtree_has(t: Tables) -> DataFrame:
    return G.subtree_has(_tree(t), F.col("lang") == "es")


@query("""
WITH RECURSIVE e AS (
  SELECT conv_id, turn AS event, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN 3 WHEN turn > 0 THEN turn - 1 END AS previous FROM conversations WHERE (conv_id * 13 + turn) % 17 <> 0
), p AS (
  SELECT conv_id, CASE WHEN conv_id % 11 <> 0 THEN max(turn) - conv_id % 2 END AS head FROM conversations GROUP BY conv_id
), w AS (
  SELECT conv_id, head AS here, []::BIGINT[] AS passed FROM p
  UNION ALL SELECT w.conv_id, e.previous, list_append(w.passed, w.here) FROM w JOIN e ON w.conv_id = e.conv_id AND w.here = e.event WHERE NOT list_contains(w.passed, w.here)
), z AS (
  SELECT conv_id, arg_max(here, len(passed)) AS stopped, max(len(passed)) AS length FROM (SELECT conv_id, coalesce(here, -1) AS here, passed FROM w) GROUP BY conv_id
)
SELECT z.conv_id, CASE WHEN head IS NULL THEN 'EMPTY' WHEN stopped = -1 THEN 'VALID' WHEN e.event IS NULL THEN 'BROKEN' ELSE 'CYCLIC' END AS status, length,
  CASE WHEN stopped >= 0 THEN stopped END AS stopped_at
FROM z JOIN p ON z.conv_id = p.conv_id LEFT JOIN e ON z.conv_id = e.conv_id AND z.stopped = e.event
""")
def g12_chain_status(t: Tables) -> DataFrame:
    """Turns as a linked list from a pointer, with some turns taken out, some that lead back, some behind the pointer, and some pointers missing."""
    n = F.col("turn")
    e = t.conversations.where("(conv_id * 13 + turn) % 17 <> 0").select("conv_id", n.alias("event"), F.when((F.col("conv_id") % 5 == 0) & (n == 1), 3).when(n > 0, n - 1).alias("previous"))
    head = F.when(F.col("conv_id") % 11 != 0, F.max("turn") - F.col("conv_id") % 2)
    p = t.conversations.groupBy("conv_id").agg(head.alias("head"))
    return L.chain_status(p, e, "conv_id", "head", "event", "previous").drop("issues")


@query("""
WITH n AS (
  SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events
), e AS (
  SELECT *, i + CASE WHEN user_id % 7 = 0 AND i > 2 THEN 1 ELSE 0 END AS seq FROM n
), p AS (
  SELECT user_id, max(i) AS length, arg_max(event_type, i) AS newest, CASE WHEN user_id % 3 = 0 THEN 'view' ELSE arg_max(event_type, i) END AS active FROM n GROUP BY user_id
)
SELECT user_id, length, CASE WHEN (user_id % 7 = 0 AND length > 2) OR newest <> active THEN 'BROKEN' ELSE 'VALID' END AS status,
  CASE WHEN user_id % 7 = 0 AND length > 2 THEN 'EVENT_SEQUENCE_INVALID' WHEN newest <> active THEN 'EVENT_POINTER_MISMATCH' ELSE '' END AS issues
FROM p
""")
def g13_event_chains(t: Tables) -> DataFrame:
    """Each user's events as a chain from the latest one: links, numbers that fall by one to 1, and the head's type against the pointer's."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.select("user_id", "event_id", "event_type", F.row_number().over(order).alias("i"), F.lag("event_id").over(order).alias("previous"))
    e = e.withColumn("seq", F.col("i") + F.when((F.col("user_id") % 7 == 0) & (F.col("i") > 2), 1).otherwise(0))
    newest = F.max_by("event_type", "i")
    p = e.groupBy("user_id").agg(F.max_by("event_id", "i").alias("head"), F.when(F.col("user_id") % 3 == 0, "view").otherwise(newest).alias("active"))
    out = L.chain_status(p, e, "user_id", "head", "event_id", "previous", "seq", "active", "event_type")
    return out.select("user_id", "length", "status", F.array_join("issues", ",").alias("issues"))


@query("""
SELECT o_orderkey, 'MISSING' AS side FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)
UNION ALL SELECT o_orderkey, 'EXTRA' FROM (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity > 25) WHERE o_orderkey % 50 <> 0
""")
def g10_drift(t: Tables) -> DataFrame:
    expected = t.orders.where("o_orderkey % 50 = 0").select("o_orderkey")
    loaded = t.lineitem.where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return G.drift(expected, loaded, ["o_orderkey"])
