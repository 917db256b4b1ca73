"""Scalar rules, set operations and summaries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.functions import scalar as S
from strandgraph.operators import aggregates as A
from strandgraph.operators import derive as D
from strandgraph.operators import windows as W
from strandgraph.operators.resolve import normal_name
from strandgraph.plans.registry import Tables, query


def _text(c: str):
    return F.col(c).cast("string")


# --- names, text, digests --------------------------------------------------------


@query("SELECT p_partkey, upper(trim(p_name)) AS id FROM part")
def f01_identifiers(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", normal_name(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("id"))


@query("""SELECT p_partkey, p_brand || '.x"y' || '|' || p_name AS parts FROM part""")
def f02_qualified_parts(t: Tables) -> DataFrame:
    name = F.concat(F.lit('"'), "p_brand", F.lit('.x""y".'), "p_name")
    return t.part.select("p_partkey", F.array_join(S.split_qualified(name), "|").alias("parts"))


@query("SELECT s_suppkey, s_name AS program FROM supplier")
def f03_before_mark(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", S.before(F.concat("s_name", F.lit("::paragraph::"), _text("s_nationkey")), "::paragraph::").alias("program"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS head, CASE p_partkey % 3 WHEN 1 THEN p_type WHEN 2 THEN p_type || '::' || p_size END AS middle, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS tail FROM part")
def f04_three_parts(t: Tables) -> DataFrame:
    """Cut at the first and the last mark; with one mark there are no three parts."""
    m, c = F.col("p_partkey") % 3, F.lit("::")
    text = F.when(m == 0, F.concat("p_brand", c, "p_name")).when(m == 1, F.concat("p_brand", c, "p_type", c, "p_name")).otherwise(F.concat("p_brand", c, "p_type", c, _text("p_size"), c, "p_name"))
    p = S.three_parts(text)
    return t.part.select("p_partkey", p[0].alias("head"), p[1].alias("middle"), p[2].alias("tail"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS digest FROM documents")
def f05_collapsed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(S.collapse_space("text"), 256).alias("digest"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[0-9]{3,}'))::INT AS long_numbers, regexp_matches(text, '(?i)license') AS licensed, nullif(regexp_extract(text, '^([A-Z][a-z]+) ', 1), '') AS head FROM documents")
def f06_patterns(t: Tables) -> DataFrame:
    head = F.nullif(F.regexp_extract("text", "^([A-Z][a-z]+) ", 1), F.lit(""))
    return t.documents.select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[0-9]{3,}"), F.lit(0))).alias("long_numbers"), F.col("text").rlike("(?i)license").alias("licensed"), head.alias("head"))


@query("SELECT c_custkey, sha256(k) AS full_digest, substr(sha256(k), 1, 12) AS short_digest FROM (SELECT c_custkey, c_name || chr(31) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END || chr(31) || c_nationkey AS k FROM customer)")
def f08_digests(t: Tables) -> DataFrame:
    c = t.customer.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))
    k = ["c_name", "c_mktsegment", "c_nationkey"]
    return c.select("c_custkey", S.digest(k).alias("full_digest"), S.digest(k, 12).alias("short_digest"))


@query("SELECT c_custkey, ('0x' || substr(sha256(c_name), 1, 8))::BIGINT % 100 AS bucket FROM customer")
def f09_buckets(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.stable_bucket("c_name").alias("bucket"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size = 10 WHEN 1 THEN p_type = 'PROMO' WHEN 2 THEN p_size = 10 AND p_type = 'PROMO' ELSE false END AS matches FROM part
""")
def f12_row_matches(t: Tables) -> DataFrame:
    """Rows as maps of text against comparisons; text that is no number matches none."""
    m = F.col("p_partkey") % 4
    p = F.when(m == 0, "P_SIZE = 10.0").when(m == 1, "P_TYPE = 'PROMO '").when(m == 2, "P_SIZE = 10 AND P_TYPE = 'PROMO'").otherwise("P_TYPE = 3")
    row = F.create_map(F.lit("P_SIZE"), _text("p_size"), F.lit("P_TYPE"), F.col("p_type"))
    return t.part.select("p_partkey", S.row_matches(row, S.comparisons(S.conjuncts(p))).alias("matches"))


@query("""SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_mktsegment":' || CASE WHEN c_custkey % 4 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || ',"c_name":"' || c_name || '"}' AS json FROM customer""")
def f13_canonical_json(t: Tables) -> DataFrame:
    c = t.customer.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")))
    return c.select("c_custkey", S.canonical_json(["c_name", "c_custkey", "c_mktsegment"]).alias("json"))


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem)
SELECT l_orderkey, l_partkey AS id, 'lines[' || i || '].part' AS path FROM l UNION ALL SELECT l_orderkey, l_suppkey, 'lines[' || i || '].by' FROM l
""")
def f15_nested_paths(t: Tables) -> DataFrame:
    """The ids within nested rows with the path to each."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("by"))))
    at = t.lineitem.groupBy("l_orderkey").agg(lines.alias("lines")).select("l_orderkey", F.posexplode("lines").alias("i", "x"))
    head = F.concat(F.lit("lines["), _text("i"), F.lit("]."))
    pairs = F.array(*[F.struct(F.col(f"x.{f}").alias("id"), F.concat(head, F.lit(f)).alias("path")) for f in ("part", "by")])
    return at.select("l_orderkey", F.inline(pairs))


@query("SELECT event_id, event_id % 4 = 0 AS accepted, CASE WHEN event_id % 4 = 0 THEN json_extract(props, '$.k')::INT END AS k FROM events")
def f16_strict_objects(t: Tables) -> DataFrame:
    """Objects only; a repeated key, a list or a value that JSON lacks is none."""
    m = F.col("event_id") % 4
    text = F.when(m == 0, F.col("props")).when(m == 1, '{"k": 1, "k": 2}').when(m == 2, "[1]").otherwise('{"k": NaN}')
    v = S.strict_object(text)
    return t.events.select("event_id", v.isNotNull().alias("accepted"), F.try_variant_get(v, "$.k", "int").alias("k"))


@query("""
SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS states, list_has_all(['F', 'O'], list(DISTINCT o_orderstatus)) AS subset, count(*)::INT * 2 AS flat FROM orders GROUP BY o_custkey
""")
def f17_arrays(t: Tables) -> DataFrame:
    """Distinct, subset and flatten; zipped lists give pairs by position."""
    a = t.orders.groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("s"), F.collect_list("o_orderkey").alias("k"))
    zipped = F.transform(F.arrays_zip("s", "k"), lambda p: F.array(p["s"], p["k"].cast("string")))
    states = F.array_sort(F.array_distinct("s"))
    return a.select("o_custkey", F.array_join(states, ",").alias("states"), (F.size(F.array_except("s", F.array(F.lit("F"), F.lit("O")))) == 0).alias("subset"), F.size(F.flatten(zipped)).alias("flat"))


@query("SELECT p_partkey, p_brand AS brand, p_size::VARCHAR AS size, 2 AS n FROM part")
def f18_maps(t: Tables) -> DataFrame:
    m = F.transform_keys(F.map_from_arrays(F.array(F.lit(" brand"), F.lit("Size ")), F.array("p_brand", _text("p_size"))), lambda k, _: normal_name(k))
    return t.part.select("p_partkey", m["BRAND"].alias("brand"), m["SIZE"].alias("size"), F.size(m).alias("n"))


@query("SELECT o_orderkey, 'snap::' || strftime(o_orderdate, '%Y-%m-%d') AS id, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderkey % 3 = 2 AS ambiguous FROM orders")
def f19_dates(t: Tables) -> DataFrame:
    """Dates to text and back; day and month that could change places are ambiguous."""
    m = F.col("o_orderkey") % 3
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    token = F.when(m == 0, F.lit("2024-13-01")).when(m == 1, iso).otherwise(iso)
    slashed = F.when(m == 2, "03/04/2024").when(m == 1, "2024-05-06").otherwise("31/04/2024")
    return t.orders.select("o_orderkey", F.concat(F.lit("snap::"), iso).alias("id"), F.date_format(F.try_to_date(token, "yyyy-MM-dd"), "yyyy-MM-dd").alias("day"), S.ambiguous_date(slashed).alias("ambiguous"))


@query("""
WITH p AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS at, round((epoch_us(ts) - epoch_us(before)) / 1e6, 3) AS seconds FROM p
""")
def f20_times(t: Tables) -> DataFrame:
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = t.events.withColumn("before", before)
    return e.select("event_id", S.utc_text("ts").alias("at"), F.round(S.seconds_between("before", "ts"), 3).alias("seconds"))


@query("""
SELECT p_partkey, CASE WHEN p_size > 10 THEN round(p_retailprice / (p_size - 10), 4) WHEN p_size < 10 THEN round(p_retailprice / (p_size - 10), 4) END AS ratio, greatest(0.0, least(1.0, p_size / 40.0 - 0.1))::DOUBLE AS clamped, least(30.0, 0.5 * 2.0 ** (p_size % 10))::DOUBLE AS backoff FROM part
""")
def f21_numbers(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t.part.select("p_partkey", F.round(F.try_divide("p_retailprice", size - 10), 4).alias("ratio"), S.clamp(size / 40.0 - 0.1, 0.0, 1.0).alias("clamped"), S.backoff_seconds(size % 10).alias("backoff"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' WHEN c_mktsegment = 'BUILDING' THEN 'BUILD' WHEN c_custkey % 7 = 0 THEN 'SEVENTH' ELSE c_mktsegment END AS label FROM customer")
def f23_ladder(t: Tables) -> DataFrame:
    """The first rule of a ladder that gives a value decides."""
    rules = [F.when(F.col("c_acctbal") < 0, "DEBT"), F.when(F.col("c_mktsegment") == "BUILDING", "BUILD"), F.when(F.col("c_custkey") % 7 == 0, "SEVENTH"), F.col("c_mktsegment")]
    return t.customer.select("c_custkey", F.coalesce(*rules).alias("label"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'UTF-8-SIG' WHEN 1 THEN 'UTF-8' WHEN 2 THEN 'ISO-8859-1' WHEN 3 THEN NULL ELSE 'UTF-8' END AS encoding FROM part")
def f24_encodings(t: Tables) -> DataFrame:
    """Bytes with a mark, plain, declared, neither valid nor declared, and valid with high bytes."""
    m, plain = F.col("p_partkey") % 5, F.encode("p_name", "UTF-8")
    content = F.when(m == 0, F.concat(F.unhex(F.lit("EFBBBF")), plain)).when((m == 2) | (m == 3), F.concat(plain, F.unhex(F.lit("E9")))).when(m == 4, F.concat(plain, F.unhex(F.lit("C3A9")))).otherwise(plain)
    declared = F.when(m == 2, "iso-8859-1").otherwise("AUTO")
    return t.part.select("p_partkey", S.encoding_of(content, declared).alias("encoding"))


@query("SELECT p_partkey, p_partkey % 4 < 2 AS numeric FROM part")
def f25_pictures(t: Tables) -> DataFrame:
    m, n = F.col("p_partkey") % 4, _text("p_size")
    pic = F.when(m == 0, F.concat(F.lit("S9("), n, F.lit(")V99"))).when(m == 1, F.concat(F.lit(" 9("), n, F.lit(") "))).when(m == 2, F.concat(F.lit("X("), n, F.lit(")"))).otherwise("ZZ9")
    return t.part.select("p_partkey", S.is_numeric_picture(pic).alias("numeric"))


# --- sets and joins ---------------------------------------------------------------


@query("SELECT c_custkey, array_to_string(list_sort(list(DISTINCT w)), ',') AS words FROM (SELECT c_custkey, unnest([c_mktsegment, n_name, 'X']) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1")
def u02_united_lists(t: Tables) -> DataFrame:
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", F.array_join(F.array_sort(F.array_union(F.array("c_mktsegment", "n_name"), F.array(F.lit("X"), F.col("n_name")))), ",").alias("words"))


@query("""
WITH a AS (SELECT c_custkey AS key FROM customer WHERE c_custkey % 13 <> 0), b AS (SELECT o_custkey AS key FROM orders WHERE o_orderkey % 9 = 0)
(SELECT key, 'ONLY_CUSTOMERS' AS side FROM a EXCEPT SELECT key, 'ONLY_CUSTOMERS' FROM b) UNION ALL (SELECT key, 'ONLY_ORDERS' FROM b EXCEPT SELECT key, 'ONLY_ORDERS' FROM a)
""")
def u03_differences(t: Tables) -> DataFrame:
    a, b = t.customer.where("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("key")), t.orders.where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("key"))
    return a.subtract(b).withColumn("side", F.lit("ONLY_CUSTOMERS")).union(b.subtract(a).withColumn("side", F.lit("ONLY_ORDERS")))


@query("SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def u04_shared_keys(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")).intersect(t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("""
WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY k) AS kinds FROM f GROUP BY 1
""")
def u05_ordered_unique(t: Tables) -> DataFrame:
    """Each customer's priorities in the order of their first use."""
    firsts = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("k"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("k", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    return firsts.groupBy("o_custkey").agg(F.array_join(kinds, ",").alias("kinds"))


@query("SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem")
def u06_exact_rows(t: Tables) -> DataFrame:
    return t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag").dropDuplicates()


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def j01_equi(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice > 300000").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT p_partkey, s_name FROM part LEFT JOIN supplier ON s_suppkey = p_size AND s_acctbal > 5000")
def j04_optional(t: Tables) -> DataFrame:
    rich = t.supplier.where("s_acctbal > 5000").select("s_suppkey", "s_name")
    return t.part.join(rich, F.col("s_suppkey") == F.col("p_size"), "left").select("p_partkey", "s_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j06_without(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50 AND l_discount > 0.05)")
def j07_with(t: Tables) -> DataFrame:
    return t.supplier.join(t.lineitem.where("l_quantity = 50 and l_discount > 0.05"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS line, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate < o_orderdate")
def j08_before_order(t: Tables) -> DataFrame:
    """An equal key and an inequality: lines that left before they were ordered."""
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") < F.col("o_orderdate"))
    return t.lineitem.join(t.orders, on).select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "o_custkey")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def j15_siblings(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


# --- summaries ----------------------------------------------------------------------


@query("SELECT event_type AS kind, count(*)::BIGINT AS n, count_if(value > 200)::BIGINT AS barriers, false AS is_total FROM events GROUP BY 1 UNION ALL SELECT NULL, count(*), count_if(value > 200), true FROM events")
def a03_fact_kinds(t: Tables) -> DataFrame:
    e = t.events.select(F.col("event_type").alias("kind"), (F.col("value") > 200).cast("long").alias("barriers"))
    return A.totals_and_kinds(e, "kind", ["barriers"])


@query("SELECT o_orderpriority, count(*)::BIGINT AS n, count_if(o_orderstatus = 'F')::BIGINT AS resolved, count_if(o_orderstatus <> 'F')::BIGINT AS unresolved FROM orders GROUP BY 1")
def a04_resolution(t: Tables) -> DataFrame:
    return A.resolved_counts(t.orders, ["o_orderpriority"], F.col("o_orderstatus") == "F")


@query("SELECT event_type, count_if(user_id % 3 = 0)::BIGINT AS s0, count_if(user_id % 3 = 1)::BIGINT AS s1, count_if(user_id % 3 = 2)::BIGINT AS s2 FROM events GROUP BY 1")
def a05_kinds_by_support(t: Tables) -> DataFrame:
    e = t.events.select("event_type", F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("support"))
    return e.groupBy("event_type").pivot("support", ["s0", "s1", "s2"]).count().na.fill(0)


@query("""
SELECT o_orderstatus, NULL AS o_orderpriority, count(*)::BIGINT AS n, 0 AS set FROM orders GROUP BY 1 UNION ALL SELECT NULL, o_orderpriority, count(*), 1 FROM orders GROUP BY 2 UNION ALL SELECT o_orderstatus, o_orderpriority, count(*), 2 FROM orders GROUP BY 1, 2
""")
def a06_detector_counts(t: Tables) -> DataFrame:
    """Counts by one column, by another and by both, in one pass."""
    out = A.counts_by(t.orders, ["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"])
    return out.select("o_orderstatus", "o_orderpriority", "n", F.col("set_no").alias("set"))


@query("SELECT l_returnflag, l_linestatus, count(DISTINCT l_orderkey)::BIGINT AS orders, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def a09_plan_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count_distinct("l_orderkey").alias("orders"), F.count("*").alias("n"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS number FROM events")
def w02_row_numbers(t: Tables) -> DataFrame:
    return W.ordinal(t.events, ["user_id"], ["ts", "event_id"], "number").select("user_id", "event_id", F.col("number").cast("long").alias("number"))


# --- nodes and edges ------------------------------------------------------------------


@query("""
SELECT 'r' || r_regionkey AS id, 'Region' AS label, r_name AS name, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name, 'n' || s_nationkey FROM supplier
""")
def d06_hierarchy(t: Tables) -> DataFrame:
    levels = [("Region", t.region, "r", "r_regionkey", "r_name", None, None), ("Nation", t.nation, "n", "n_nationkey", "n_name", "r", "n_regionkey"), ("Supplier", t.supplier, "s", "s_suppkey", "s_name", "n", "s_nationkey")]
    return D.hierarchy(levels)


@query("SELECT p_partkey, p_name, CASE WHEN p_size > 40 THEN 'large' END AS tag FROM part")
def d07_tagged_items(t: Tables) -> DataFrame:
    tags = t.part.where("p_size > 40").select("p_partkey", F.lit("large").alias("tag"))
    return t.part.select("p_partkey", "p_name").join(tags, "p_partkey", "left")


_EVENTS = """WITH tok AS (SELECT o_orderkey, p_brand, CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE lower(p_name) END AS token, o_orderkey % 2 = 0 AS written FROM orders JOIN part ON p_partkey = o_orderkey % 200),
i AS (SELECT p_brand, upper(p_name) AS k, count(*) AS n, min(p_partkey) AS item FROM part GROUP BY 1, 2), r AS (SELECT tok.*, n, item FROM tok LEFT JOIN i ON i.p_brand = tok.p_brand AND k = upper(token))"""


def _events(t: Tables):
    k = F.col("o_orderkey")
    s = t.orders.select("o_orderkey").join(t.part.select("p_partkey", "p_brand", "p_name"), F.col("p_partkey") == k % 200)
    name = F.when(k % 5 == 0, F.lit("none")).otherwise(F.lower("p_name"))
    s = s.select("o_orderkey", "p_brand", F.when(k % 2 == 0, F.array(name)).alias("writes"), F.when(k % 2 != 0, F.array(name)).alias("reads"))
    return D.variable_events(s, t.part.select("p_brand", "p_name", "p_partkey"), ["p_brand"], "p_name", "p_partkey")


@query(f"{_EVENTS} SELECT o_orderkey, item, written FROM r WHERE n = 1")
def d03_variable_events(t: Tables) -> DataFrame:
    return _events(t)[0].select("o_orderkey", F.col("p_partkey").alias("item"), "written")


@query(f"{_EVENTS} SELECT o_orderkey, token, CASE WHEN n IS NULL THEN 'UNRESOLVED' ELSE 'AMBIGUOUS' END AS reason FROM r WHERE n IS NULL OR n > 1")
def d03_variable_warnings(t: Tables) -> DataFrame:
    return _events(t)[1].select("o_orderkey", "token", "reason")


@query("""
SELECT 't' || o_orderkey AS src, 't' || o_orderkey || ':' || l_linenumber AS dst, 'HAS_ENTRY' AS type, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'
""")
def d12_table_entries(t: Tables) -> DataFrame:
    nested = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("entries"))
    tables = t.orders.where("o_orderstatus = 'P'").join(nested, F.col("l_orderkey") == F.col("o_orderkey"))
    table = F.concat(F.lit("t"), _text("o_orderkey"))
    rows = tables.select(table.alias("src"), F.inline("entries"))
    return rows.select("src", F.concat("src", F.lit(":"), _text("l_linenumber")).alias("dst"), F.lit("HAS_ENTRY").alias("type"), "l_partkey")


@query("SELECT l_orderkey AS src, l_partkey AS dst, count(*)::BIGINT AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1, 2")
def d13_mapped_edges(t: Tables) -> DataFrame:
    """Facts as edges; a key that is no node would be an error."""
    facts = t.lineitem.where("l_quantity > 40").select("l_orderkey", "l_partkey")
    out = D.mapped_edges(facts, t.part.select("p_partkey"), "l_partkey", "p_partkey")
    return out.groupBy(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count("*").alias("n"))
