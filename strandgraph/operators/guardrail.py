"""Drafted texts checked against the evidence that their claims cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.functions.scalar import iso_dates
from strandgraph.store import stash

#: Codes of violations, by the parts of a document that must be
#: approved to be cited, and of those that never are.
APPROVABLE = {"unapproved_table_effect": r"^(\$\.effects\.table_effects\[\d+\])", "unapproved_return_code": r"^(\$\.effects\.return_codes\[\d+\])"}
NEVER = {"unapproved_parameter_row": r"^(\$\.data_context\.parameter_tables\[\d+\]\.context_rows\[\d+\])"}
#: What gives quoted literals their authority.
DECISION, RETURN_CODE = r"^\$\.decision($|\.)", APPROVABLE["unapproved_return_code"]
APPROVED = "approved_for_rule_text"


def json_nodes(docs: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, value): every node of each JSON document by its path, value
    as text (strings bare) where it has no nodes below, else null. Documents
    that are no JSON have none.

    Objects and arrays are opened a level at a time, all documents at once; so
    there are as many rounds as the deepest document has levels.
    """
    now = docs.select(F.col(key).alias(key), F.lit("$").alias("path"), F.try_parse_json(F.col(json)).alias("v")).where("v is not null")
    found = []
    while True:
        kind = F.schema_of_variant("v")
        opens = kind.rlike("^(OBJECT|ARRAY)")
        level = now.select(key, "path", F.when(~opens, F.coalesce(F.try_variant_get("v", "$", "string"), F.lit("null"))).alias("value"), F.when(opens, F.to_json("v")).alias("json"))
        level = stash(level, "nodes")
        found.append(level.select(key, "path", "value"))
        inner = level.where("json is not null")
        if inner.isEmpty():
            break
        below = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.parse_json(F.col("json").outer())).toDF("pos_", "key_", "v_"))
        step = F.when(F.col("key_").isNull(), F.concat(F.lit("["), F.col("pos_").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key_")))
        now = below.select(key, F.concat("path", step).alias("path"), F.col("v_").alias("v"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _word_in(text: Column, word: Column) -> Column:
    """Whether ``word`` stands in ``text`` with no letter, digit or underscore beside it."""
    return F.rlike(text, F.concat(F.lit(r"(?<!\w)\Q"), word, F.lit(r"\E(?!\w)")))


def _number_in(text: Column, number: Column) -> Column:
    """Whether ``number`` stands in ``text`` as a number of its own, not as part of a longer one, a name or a date."""
    undated = F.regexp_replace(F.regexp_replace(text, r"\b\d{4}-\d{2}-\d{2}\b", " "), r"\b\d{1,2}[/.]\d{1,2}[/.]\d{2,4}\b", " ")
    return F.rlike(undated, F.concat(F.lit(r"(?<![\w.])\Q"), number, F.lit(r"\E(?!\w|\.\w)")))


def claim_violations(claims: DataFrame, drafts: DataFrame, nodes: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(key, field, code, claim, detail) of what drafts may not say.

    ``claims``: key, claim, field, paths and ids (arrays); ``drafts``: key,
    field, text; ``nodes``: as ``json_nodes`` gives them; ``evidence``: key, id.

    A claim may cite only paths and ids that its package has
    (``unknown_evidence_path``, ``unknown_evidence_id``), approved effects and
    return codes (a node whose flag APPROVED is true) and no context rows.
    Numbers and ISO dates of a draft have to stand in a node that a claim of
    its field cites, numbers whole and outside of dates; a field without
    claims has no evidence. Quoted codes of
    up to eight capitals or digits have to stand as words in the decision or
    an approved return code so cited. Other dates are ambiguous, a warning.
    ``claim`` is the least of the field for findings of a field, null if there
    is none. Null texts, paths and ids are left out.
    """
    cited = stash(claims.select(key, "claim", "field", F.explode("paths").alias("path")).where("path is not null").distinct(), "cited")
    leaves = nodes.where("value is not null").select(key, F.col("path").alias("leaf"), "value")
    inside = (F.col("leaf") == F.col("path")) | F.startswith("leaf", F.concat("path", F.lit("."))) | F.startswith("leaf", F.concat("path", F.lit("[")))
    known = stash(cited.join(leaves, key).where(inside), "known")
    row = lambda df, code, detail, claim="claim": df.select(key, "field", F.lit(code).alias("code"), F.col(claim).alias("claim"), detail.alias("detail"))
    there = nodes.select(key, "path", F.lit(True).alias("is_"))
    lost = cited.join(there, [key, "path"], "left_anti")
    ids = claims.select(key, "claim", "field", F.explode("ids").alias("id")).where("id is not null").distinct()
    out = [row(lost, "unknown_evidence_path", F.col("path")), row(ids.join(evidence.select(key, "id"), [key, "id"], "left_anti"), "unknown_evidence_id", F.col("id"))]

    flags = nodes.where(F.endswith("path", F.lit(f".{APPROVED}"))).select(key, F.regexp_replace("path", rf"\.{APPROVED}$", "").alias("part"), (F.col("value") == "true").alias("ok"))
    flags = stash(flags, "flags")
    for code, pattern in {**APPROVABLE, **NEVER}.items():
        part = cited.withColumn("part", F.regexp_extract("path", pattern, 1)).where("part <> ''")
        if code in NEVER:
            out.append(row(part.select(key, "claim", "field", "part").distinct(), code, F.col("part")))
            continue
        part = part.join(there.withColumnRenamed("path", "part"), [key, "part"], "left_semi").join(flags, [key, "part"], "left").where("not coalesce(ok, false)")
        out.append(row(part.select(key, "claim", "field", "part").distinct(), code, F.col("part")))

    d = drafts.where("text is not null").select(key, "field", "text")
    plain = F.regexp_replace("text", r"\b\d{4}-\d{2}-\d{2}\b", " ")
    vague = F.regexp_extract_all(F.col("text"), F.lit(r"(\b\d{1,2}[/.]\d{1,2}[/.]\d{2,4}\b)"), F.lit(1))
    number = F.regexp_extract_all(F.regexp_replace(plain, r"\b\d{1,2}[/.]\d{1,2}[/.]\d{2,4}\b", " "), F.lit(r"((?<![\w.])\d+(?:\.\d+)?(?![\w.]))"), F.lit(1))
    quoted = F.regexp_extract_all(F.col("text"), F.lit("""(['"])([A-Z0-9]{1,8})\\1"""), F.lit(2))
    kinds = {"unsupported_explicit_date": iso_dates(F.col("text")), "unsupported_explicit_number": number, "unsupported_explicit_literal": quoted, "ambiguous_date_format": vague}
    each = F.array(*[F.struct(F.lit(code).alias("code"), F.array_distinct(found).alias("found")) for code, found in kinds.items()])
    tokens = d.select(key, "field", F.explode(each).alias("kind_")).select(key, "field", "kind_.code", F.explode("kind_.found").alias("token")).distinct()
    tokens = stash(tokens, "tokens")
    part = F.nullif(F.regexp_extract("path", RETURN_CODE, 1), F.lit(""))
    ranked = known.withColumn("part", part).join(flags, [key, "part"], "left").select(key, "field", "value", (F.col("path").rlike(DECISION) | (F.col("part").isNotNull() & F.coalesce("ok", F.lit(False)))).alias("ranks"))
    literal = F.col("code") == "unsupported_explicit_literal"
    stands = F.when(literal, F.col("ranks") & _word_in(F.col("value"), F.col("token"))).when(F.col("code") == "unsupported_explicit_number", _number_in(F.col("value"), F.col("token"))).otherwise((F.col("code") != "ambiguous_date_format") & F.contains("value", F.col("token")))
    held = tokens.join(ranked.where("value is not null"), [key, "field"]).where(stands).select(key, "field", "code", "token").distinct()
    least = claims.groupBy(key, "field").agg(F.min("claim").alias("claim"))
    bare = tokens.join(held, [key, "field", "code", "token"], "left_anti").join(least, [key, "field"], "left")
    out.append(bare.select(key, "field", "code", "claim", F.col("token").alias("detail")))
    found = out[0]
    for o in out[1:]:
        found = found.union(o)
    return found


def case_verdicts(cases: DataFrame, expectations: DataFrame, rows: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(case_id, kind, outcome, expected, matched, unexpected) per case, and (case_id, id) of unexpected rows.

    ``cases``: case_id, kind, program, fixtures (array of digests);
    ``expectations``: case_id, expectation_id, family, paragraph, literal,
    condition (null meets all) and min_count; ``rows``: id, family, program,
    paragraph, literal, condition; ``present``: digest of each file there is.
    Text is compared trimmed, null rows as empty text.

    A case whose fixtures are not all present, or that names none, is
    NOT_EVALUATED. A POSITIVE case is MATCHED if each expectation is met by
    ``min_count`` different rows, else MISSING; rows in the scope (family,
    program, paragraph) of one of its expectations that meet none are
    unexpected. A NEGATIVE case has a closed world: any row of a known family
    in its program is unexpected; without one it is CONFIRMED_ABSENT.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    need = cases.select("case_id", F.size("fixtures").alias("n_"), F.explode_outer(F.array_distinct("fixtures")).alias("f_"))
    have = need.join(present.select(F.col("digest").alias("f_")).distinct().withColumn("here", F.lit(1)), "f_", "left").groupBy("case_id").agg(F.min(F.coalesce("here", F.lit(0))).alias("here"))
    c = stash(cases.join(have, "case_id").withColumn("applies", F.col("here") == 1).select("case_id", "kind", "program", "applies"), "cases")
    r = rows.select("id", F.col("family").alias("rf"), text("program").alias("rp"), text("paragraph").alias("rg"), text("literal").alias("rl"), text("condition").alias("rc"))
    live = c.where("applies").select("case_id", "kind", F.trim("program").alias("rp"))
    e = expectations.join(live.where("kind = 'POSITIVE'"), "case_id").withColumnRenamed("family", "rf")
    meets = lambda mine, theirs: F.col(mine).isNull() | (F.trim(F.col(mine)) == F.col(theirs))
    scope = stash(e.join(r, ["rf", "rp"]).where(meets("paragraph", "rg")).withColumn("hit", meets("literal", "rl") & meets("condition", "rc")).select("case_id", "expectation_id", "id", "hit"), "scope")
    met = scope.where("hit").groupBy("case_id", "expectation_id").agg(F.count_distinct("id").alias("n"))
    each = e.join(met, ["case_id", "expectation_id"], "left").withColumn("ok", F.coalesce("n", F.lit(0)) >= F.col("min_count"))
    each = each.groupBy("case_id").agg(F.count("*").alias("expected"), F.count_if("ok").alias("matched"))
    stray = scope.groupBy("case_id", "id").agg(F.bool_or("hit").alias("hit")).where("not hit").select("case_id", "id")
    closed = live.where("kind = 'NEGATIVE'").join(r.where("rf <> 'UNKNOWN'"), "rp").select("case_id", "id").distinct()
    unexpected = stash(stray.union(closed), "unexpected")
    counts = unexpected.groupBy("case_id").agg(F.count("*").alias("unexpected"))
    out = c.join(each, "case_id", "left").join(counts, "case_id", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
    out = out.select("case_id", "kind", "applies", zero("expected"), zero("matched"), zero("unexpected"))
    outcome = F.when(~F.col("applies"), "NOT_EVALUATED").when(F.col("kind") == "POSITIVE", F.when(F.col("matched") == F.col("expected"), "MATCHED").otherwise("MISSING")).otherwise(F.when(F.col("unexpected") > 0, "UNEXPECTED_CANDIDATES").otherwise("CONFIRMED_ABSENT"))
    return out.select("case_id", "kind", outcome.alias("outcome"), "expected", "matched", "unexpected"), unexpected


def case_metrics(verdicts: DataFrame) -> DataFrame:
    """(tp, fn, fp, tn) of evaluated cases: expectations met and missed, stray
    rows of positive cases and failed negative ones, and negative ones that held."""
    v, positive = verdicts.where("outcome <> 'NOT_EVALUATED'"), F.col("kind") == "POSITIVE"
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return v.agg(
        total(F.when(positive, F.col("matched"))).alias("tp"), total(F.when(positive, F.col("expected") - F.col("matched"))).alias("fn"),
        total(F.when(positive, F.col("unexpected")).when(F.col("outcome") == "UNEXPECTED_CANDIDATES", 1)).alias("fp"), total(F.when(F.col("outcome") == "CONFIRMED_ABSENT", 1)).alias("tn"),
    )


def _parts(nodes: DataFrame, key: str, pattern: str, field: str) -> DataFrame:
    """(key, part, value, ok) of the parts of documents by ``pattern``: a field's text, and whether the part is approved."""
    part = nodes.withColumn("part", F.regexp_extract("path", pattern, 1)).where("part <> '' and value is not null")
    own = lambda name: F.max(F.when(F.col("path") == F.concat("part", F.lit(f".{name}")), F.col("value")))
    return part.groupBy(key, "part").agg(own(field).alias("value"), F.coalesce(own(APPROVED) == "true", F.lit(False)).alias("ok"))


def _evidence_ids(nodes: DataFrame, key: str) -> DataFrame:
    """(key, part, ids): the ids that a part lists as its evidence."""
    found = nodes.withColumn("part", F.regexp_extract("path", r"^(.*)\.evidence_ids\[\d+\]$", 1)).where("part <> '' and value is not null")
    return found.groupBy(key, "part").agg(F.array_sort(F.collect_set("value")).alias("own_ids"))


def anchored_citations(claims: DataFrame, nodes: DataFrame, violations: DataFrame, key: str) -> DataFrame:
    """``claims`` with (anchored) and more paths and ids where evidence was there but not cited.

    A number, date or quoted code that no cited node holds may stand in the
    decision, or else in the code of an approved return code, the first that
    holds it as a token. If that is so for all such findings of a package,
    their claims cite these parts and their evidence as well; if one has no
    anchor, or no claim, the package stays as it is. No text is changed.
    """
    codes = ["unsupported_explicit_number", "unsupported_explicit_date", "unsupported_explicit_literal"]
    found = violations.where(F.col("code").isin(codes)).select(key, "claim", "code", F.col("detail").alias("token")).distinct()
    found = stash(found.withColumn("at_", F.monotonically_increasing_id()), "findings")
    decision = nodes.where(F.col("path").rlike(DECISION) & F.col("value").isNotNull() & ~F.contains("path", F.lit(".evidence_ids"))).select(key, F.lit("$.decision").alias("part"), F.lit(0).alias("rank"), "value")
    number = F.regexp_extract("part", r"\[(\d+)\]$", 1).cast("int") + 1
    anchors = decision.union(_parts(nodes, key, RETURN_CODE, "code").where("ok and value is not null").select(key, "part", number.alias("rank"), "value"))
    holds = F.when(F.col("code") == codes[0], _number_in(F.col("value"), F.col("token"))).otherwise(_word_in(F.col("value"), F.col("token")))
    first = found.join(anchors, key).where(holds).groupBy("at_").agg(F.min(F.struct("rank", "part")).alias("a"))
    each = stash(found.join(first, "at_", "left").select(key, "claim", "a"), "anchors")
    whole = each.groupBy(key).agg(F.bool_and(F.col("a").isNotNull() & F.col("claim").isNotNull()).alias("all_")).where("all_").select(key)
    ids = _evidence_ids(nodes, key)
    more = each.join(whole, key, "left_semi").select(key, "claim", "a.rank", "a.part").distinct().join(ids, [key, "part"], "left")
    listed = F.array_sort(F.collect_list(F.struct("rank", "part", F.coalesce("own_ids", F.array()).alias("ids"))))
    more = more.groupBy(key, "claim").agg(listed.alias("more_"))
    out = claims.join(more, [key, "claim"], "left").withColumn("anchored", F.col("more_").isNotNull())
    plus = lambda c, new: F.when(F.col("more_").isNotNull(), F.array_distinct(F.concat(c, new))).otherwise(F.col(c))
    out = out.withColumns({"paths": plus("paths", F.transform("more_", lambda m: m["part"])), "ids": plus("ids", F.flatten(F.transform("more_", lambda m: m["ids"])))})
    return out.select(*claims.columns, "anchored")


def retargeted_citations(claims: DataFrame, drafts: DataFrame, nodes: DataFrame, violations: DataFrame, key: str) -> DataFrame:
    """``claims`` with (retargeted) and the right table effect cited in place of one without approval.

    The text of the claim's field has to name, as a word, the table of exactly
    one approved effect and not the table that is cited. If that is so for all
    such findings of a package, path and evidence ids change places; if not for
    one, or if it is cited by a longer path, the package stays as it is.
    """
    wrong = violations.where("code = 'unapproved_table_effect'").select(key, "claim", "field", F.col("detail").alias("part")).distinct()
    parts = stash(_parts(nodes, key, APPROVABLE["unapproved_table_effect"], "table"), "tables")
    cited = claims.select(key, "claim", "paths")
    wrong = wrong.join(drafts.select(key, "field", "text"), [key, "field"], "left").join(parts.select(key, "part", F.col("value").alias("table_")), [key, "part"], "left").join(cited, [key, "claim"], "left")
    wrong = stash(wrong.withColumn("at_", F.monotonically_increasing_id()), "findings")
    named = wrong.join(parts.where("ok").select(key, F.col("part").alias("to"), "value"), key).where(_word_in(F.col("text"), F.col("value")))
    named = named.groupBy("at_").agg(F.count("*").alias("n"), F.min("to").alias("to"))
    each = wrong.join(named, "at_", "left")
    right = (F.col("n") == 1) & ~_word_in(F.col("text"), F.col("table_")) & F.array_contains("paths", F.col("part"))
    each = stash(each.withColumn("right", F.coalesce(right, F.lit(False))).select(key, "claim", "part", "to", "right"), "targets")
    whole = each.groupBy(key).agg(F.bool_and("right").alias("all_")).where("all_").select(key)
    ids = _evidence_ids(nodes, key)
    swap = each.join(whole, key, "left_semi").join(ids.withColumnRenamed("own_ids", "old_ids"), [key, "part"], "left")
    swap = swap.join(ids.select(key, F.col("part").alias("to"), F.col("own_ids").alias("new_ids")), [key, "to"], "left")
    none = F.array().cast("array<string>")
    swap = swap.groupBy(key, "claim").agg(
        F.map_from_entries(F.collect_list(F.struct("part", "to"))).alias("swap_"), F.flatten(F.collect_list(F.coalesce("old_ids", none))).alias("old_"), F.flatten(F.collect_list(F.coalesce("new_ids", none))).alias("new_"),
    )
    out = claims.join(swap, [key, "claim"], "left").withColumn("retargeted", F.col("swap_").isNotNull())
    paths = F.transform("paths", lambda p: F.coalesce(F.try_element_at("swap_", p), p))
    out = out.withColumns({"paths": F.when(F.col("retargeted"), paths).otherwise(F.col("paths")), "ids": F.when(F.col("retargeted"), F.array_distinct(F.concat(F.array_except("ids", "old_"), "new_"))).otherwise(F.col("ids"))})
    return out.select(*claims.columns, "retargeted")
