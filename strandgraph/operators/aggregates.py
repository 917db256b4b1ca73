"""Grouped summaries: counters, samples, lattices, gates, metrics, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals_and_kinds(df: DataFrame, kind: str, counters: list[str]) -> DataFrame:
    """Sums of the counters and row counts per kind, and for all kinds (kind null, is_total)."""
    return df.rollup(kind).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in counters], F.grouping(kind).cast("boolean").alias("is_total"))


def counts_by(df: DataFrame, *sets: list[str]) -> DataFrame:
    """Row counts for each of several grouping sets in one pass, absent columns null, with the set's number."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    spread = F.explode(F.array(*[F.lit(i) for i in range(len(sets))]))
    d = df.select(*names, spread.alias("set_no"))
    keep = [F.when(F.col("set_no").isin([i for i, s in enumerate(sets) if c in s]), F.col(c)).alias(c) for c in names]
    return d.select("set_no", *keep).groupBy("set_no", *names).agg(F.count("*").alias("n"))


def resolved_counts(df: DataFrame, keys: list[str], resolved: Column) -> DataFrame:
    """(keys, n, resolved, unresolved): what is not surely resolved is unresolved."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(resolved).alias("resolved")).withColumn("unresolved", F.col("n") - F.col("resolved"))


def sampled_groups(df: DataFrame, keys: list[str], order: list[str], reference: str, n: int) -> DataFrame:
    """Counts per key with the first ``n`` references in ``order``. Ranks are
    taken before collecting, so a group's list never holds more than ``n``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = df.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= n)
    refs = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r_", reference))), lambda x: x[reference]).alias("references"))
    return df.groupBy(*keys).agg(F.count("*").alias("n")).join(refs, keys)


def support_lattice(df: DataFrame, keys: list[str], support: str) -> DataFrame:
    """DETERMINISTIC if all are, else BLOCKED if any is, else PARTIAL if any is, else UNKNOWN."""
    s = F.col(support)
    out = F.when(F.bool_and(s == "DETERMINISTIC"), "DETERMINISTIC").when(F.bool_or(s == "BLOCKED"), "BLOCKED").when(F.bool_or(s == "PARTIAL"), "PARTIAL").otherwise("UNKNOWN")
    return df.groupBy(*keys).agg(out.alias("support"), F.count("*").alias("n"))


def applicability(statuses: Column) -> Column:
    """Lattice over an array of statuses: all EXACT, none or all UNRESOLVED, else PARTIAL."""
    d = F.array_distinct(statuses)
    return F.when((F.size(d) == 0) | ((F.size(d) == 1) & (F.get(d, F.lit(0)) == "UNRESOLVED")), "UNRESOLVED").when((F.size(d) == 1) & (F.get(d, F.lit(0)) == "EXACT"), "EXACT").otherwise("PARTIAL")


def gate_results(gates: DataFrame, issues: DataFrame, gate: str, code: str) -> DataFrame:
    """(gate, n_issues, codes, passed) for every gate, those without an issue too."""
    found = issues.groupBy(gate).agg(F.count("*").alias("n_issues"), F.array_sort(F.collect_set(code)).alias("codes"))
    out = gates.select(gate).distinct().join(found, gate, "left")
    return out.select(gate, F.coalesce("n_issues", F.lit(0)).alias("n_issues"), F.coalesce("codes", F.expr("cast(array() as array<string>)")).alias("codes"), F.col("n_issues").isNull().alias("passed"))


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1: null where the denominator is 0; f1 is 0 where both are."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    f1 = F.when(p + r == 0, F.lit(0.0)).otherwise(F.try_divide(2 * p * r, p + r))
    return [p.alias("precision"), r.alias("recall"), f1.alias("f1")]


def classification_metrics(df: DataFrame, truth: Column, predicted: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, tp, fp, fn, tn, precision, recall, f1); a null truth or prediction counts as false."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    n = [F.count_if(c).alias(a) for a, c in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p))]
    out = (df.groupBy(*keys) if keys else df.groupBy()).agg(*n)
    return out.select(*(keys or []), "tp", "fp", "fn", "tn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def merged_reports(reports: DataFrame, case: str, run: str, outcome: str) -> DataFrame:
    """(case, run, outcome, agrees): the smallest run per case stands; agrees is
    false where runs differ, which callers take as fatal."""
    return reports.groupBy(case).agg(F.min(run).alias(run), F.min_by(outcome, run).alias(outcome), (F.size(F.collect_set(F.struct(outcome))) == 1).alias("agrees"))


def one_tag_each(matches: DataFrame, keys: list[str], tag: str, confidence: str, rule: str) -> DataFrame:
    """(keys, tag, confidence, rules, conflict): the tag if all matching rules
    say one, else none and a conflict; confidence is the highest, rules sorted."""
    m = matches.groupBy(*keys).agg(F.array_sort(F.collect_set(tag)).alias("t_"), F.max(confidence).alias("c_"), F.array_sort(F.collect_set(rule)).alias("rules"))
    one = F.size("t_") == 1
    return m.select(*keys, F.when(one, F.get("t_", F.lit(0))).alias(tag), F.when(one, F.col("c_")).alias(confidence), "rules", (~one).alias("conflict"))


def histogram(df: DataFrame, label: str, value: str, bounds: list[float], known: list[str]) -> DataFrame:
    """(label, n, total, le_<bound>...): cumulative counts per label; labels that are not known are UNKNOWN."""
    name = F.when(F.col(label).isin(known), F.col(label)).otherwise("UNKNOWN")
    steps = [F.count_if(F.col(value) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return df.groupBy(name.alias(label)).agg(F.count(value).alias("n"), F.sum(value).alias("total"), *steps)


def value_conflicts(df: DataFrame, anchors: list[list[str]], value: str, id_col: str) -> DataFrame:
    """(anchor_no, key, values, ids) where an anchor has two or more different
    values, null and empty ones not counting. A null in an anchor is no anchor."""
    out = None
    for i, keys in enumerate(anchors):
        full = df.where(F.col(value) != "")
        for k in keys:
            full = full.where(F.col(k).isNotNull())
        key = F.to_json(F.struct(*keys))
        found = full.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set(value)).alias("values"), F.array_sort(F.collect_set(id_col)).alias("ids")).where(F.size("values") > 1).select(F.lit(i).alias("anchor_no"), "key", "values", "ids")
        out = found if out is None else out.unionByName(found)
    return out


def family_conflicts(df: DataFrame, keys: list[str], family: str) -> DataFrame:
    """(keys, families) with two or more families other than UNKNOWN."""
    known = df.where(F.col(family) != "UNKNOWN")
    return known.groupBy(*keys).agg(F.array_sort(F.collect_set(family)).alias("families")).where(F.size("families") > 1)


def observations(statements: DataFrame, constructs: DataFrame, kind: str, program: str) -> DataFrame:
    """``constructs`` with the occurrences of their kind and the programs that
    hold it; constructs may share a kind, and one that is never seen has zeros."""
    seen = statements.groupBy(kind).agg(F.count("*").alias("o_"), F.count_distinct(program).alias("p_"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return constructs.join(seen, kind, "left").withColumns({"occurrences": zero(F.col("o_")), "programs": zero(F.col("p_"))}).drop("o_", "p_")


def ladder(*steps: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The name of the first condition that holds."""
    out = F.when(F.coalesce(steps[0][0], F.lit(False)), steps[0][1])
    for condition, name in steps[1:]:
        out = out.when(F.coalesce(condition, F.lit(False)), name)
    return out.otherwise(otherwise) if otherwise is not None else out


def zero_reason(candidates: Column, decisions: Column, resolved: Column) -> Column:
    """Why a program has no candidate; null if it has some."""
    return F.when(candidates > 0, F.lit(None).cast("string")).when(decisions == 0, "NO_DECISIONS").when(resolved == 0, "NO_RESOLVED_EFFECTS").otherwise("NO_TAGGED_TARGET")


def worst(df: DataFrame, keys: list[str], severity: str, ranks: list[str]) -> DataFrame:
    """(keys, severity, n): the worst severity per key, ``ranks`` from mild to bad, and distinct rows."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ranks]), F.col(severity))
    return df.distinct().withColumn("r_", rank).groupBy(*keys).agg(F.max_by(severity, "r_").alias(severity), F.count("*").alias("n"))
