"""Statements to effects, and literals followed through them.

A statement row has program, paragraph, statement_id, pos (execution order),
kind, parent_id, branch_kind, branch_condition, targets, sources (arrays of
names), literals (array), condition_target, condition_value (boolean), and may
have target_paragraphs (array), call_kind (LITERAL or DYNAMIC), arguments
(array of name, mode, literal, omitted) and returning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.operators.resolve import normal_name
from strandgraph.store import stash

EFFECT = "struct<kind string, target string, source string, literal string, support string, note string>"
ARGUMENTS = "array<struct<name:string, mode:string, literal:string, omitted:boolean>>"

#: Statement kinds that compute, that end a program, and that only branch.
COMPUTING = ["COMPUTE", "ADD", "SUBTRACT", "MULTIPLY", "DIVIDE"]
ENDING = ["STOP_RUN", "GOBACK", "EXIT_PROGRAM"]
BRANCHING = ["IF", "EVALUATE"]


def _effect(kind: str, target: Column | None = None, source: Column | None = None, literal: Column | None = None, support: str = "DETERMINISTIC", note: Column | str | None = None) -> Column:
    null = F.lit(None).cast("string")
    pick = lambda c: null if c is None else F.lit(c) if isinstance(c, str) else c.cast("string")
    return F.struct(F.lit(kind).alias("kind"), pick(target).alias("target"), pick(source).alias("source"), pick(literal).alias("literal"), F.lit(support).alias("support"), pick(note).alias("note"))


def statement_effects(statements: DataFrame, conditions: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """A row per effect: (program, paragraph, statement_id, pos, ordinal, kind,
    target, source, literal, support, note, control_targets, arguments, returning).

    A move of one literal assigns it to every target; of several literals it
    is a partial assignment each; of one name a copy, ambiguous to several
    targets or from several names; anything else is kept as it stands. Setting
    a condition true assigns its value if it has a single one without a range;
    setting it false assigns nothing known; a condition that is not declared
    is unknown. Setting anything else writes each target with a value that is
    not followed. Arithmetic computes every target and is never evaluated;
    without a target it is kept as it stands.

    GO TO and PERFORM name their targets; without one they are kept as they
    stand. A call has its arguments and what it returns to; it is sure only
    with a literal program, arguments that are all known by mode and shape,
    and nothing returned, and unknown where its kind is null. Statements that
    end a program and all others are kept as they stand; a branch has no
    effect of its own. Columns to ``keep`` follow.
    """
    s = statements
    for name, kind in (("target_paragraphs", "array<string>"), ("arguments", ARGUMENTS), ("returning", "string")):
        if name not in s.columns:
            s = s.withColumn(name, F.lit(None).cast(kind))
    if "call_kind" not in s.columns:
        s = s.withColumn("call_kind", F.lit("LITERAL"))
    if conditions is not None:
        ranged = F.coalesce("ranged", F.lit(False))
        c = conditions.select(
            F.col("program").alias("cp_"), F.col("condition").alias("cc_"), F.col("parent").alias("condition_parent"), F.when((F.size("values") == 1) & ~ranged, F.get("values", F.lit(0))).alias("condition_literal"),
            F.when(ranged, "CONDITION_VALUE_RANGE").otherwise("MULTIPLE_CONDITION_VALUES").alias("condition_note"),
        )
        s = s.join(c, (F.col("program") == F.col("cp_")) & (F.col("condition_target") == F.col("cc_")), "left")
    else:
        s = s.withColumns({x: F.lit(None).cast("string") for x in ("condition_parent", "condition_literal", "condition_note")})
    none = F.expr(f"cast(array() as array<{EFFECT}>)")
    t, src, lit = F.col("targets"), F.col("sources"), F.col("literals")
    n_lit, n_src, n_t = F.size(lit), F.size(src), F.size(t)
    one_lit, one_src = F.get(lit, F.lit(0)), F.get(src, F.lit(0))
    kept = lambda note, support="PRESERVED": F.array(_effect("PRESERVED", None, None, None, support, note))
    moved = (
        F.when((n_lit == 1) & (n_src == 0), F.transform(t, lambda x: _effect("ASSIGN_LITERAL", x, None, one_lit)))
        .when((n_lit > 1) & (n_src == 0), F.flatten(F.transform(t, lambda x: F.transform(lit, lambda y: _effect("ASSIGN_LITERAL", x, None, y, "PARTIAL")))))
        .when((n_src == 1) & (n_lit == 0) & (n_t == 1), F.transform(t, lambda x: _effect("COPY", x, one_src)))
        .when((n_src == 1) & (n_lit == 0) & (n_t > 1), F.transform(t, lambda x: _effect("COPY", x, one_src, None, "AMBIGUOUS")))
        .when((n_src > 1) & (n_lit == 0) & (n_t > 0), F.transform(t, lambda x: _effect("COPY", x, None, None, "AMBIGUOUS")))
        .otherwise(kept("MOVE_NOT_EXPANDED", "PARTIAL"))
    )
    unknown = lambda note: F.array(_effect("UNKNOWN", None, None, None, "UNKNOWN", note))
    parent = F.col("condition_parent")
    sets = F.when(F.col("condition_target").isNotNull() & parent.isNull(), unknown("CONDITION_NOT_DECLARED")).when(
        F.col("condition_target").isNotNull(),
        F.when(F.col("condition_value"), F.array(F.when(F.col("condition_literal").isNotNull(), _effect("SET_CONDITION", parent, F.col("condition_target"), F.col("condition_literal"))).otherwise(_effect("SET_CONDITION", parent, F.col("condition_target"), None, "PARTIAL", F.col("condition_note")))))
        .otherwise(F.array(_effect("UNSET_CONDITION", parent, F.col("condition_target"), None, "PARTIAL"))),
    ).otherwise(F.transform(t, lambda x: _effect("SET_VALUE", x, None, one_lit, "PARTIAL")))
    kind, args = F.col("kind"), F.col("arguments")
    away = F.coalesce(F.size("target_paragraphs") > 0, F.lit(False))
    whole = F.coalesce(F.forall(args, lambda a: (F.coalesce(a["mode"], F.lit("UNKNOWN")) != "UNKNOWN") & (F.coalesce(a["omitted"], F.lit(False)) | a["name"].isNotNull() | a["literal"].isNotNull())), F.lit(True))
    sure = (F.col("call_kind") == "LITERAL") & whole & F.col("returning").isNull()
    doubts = F.concat_ws(
        ",", F.when(~whole, "CALL_ARGUMENT_PARTIAL"), F.when(F.col("call_kind") == "DYNAMIC", "CALL_DYNAMIC_TARGET_UNRESOLVED"),
        F.when(F.col("returning").isNotNull(), "CALL_RETURNING_PARTIAL"), F.when(~F.col("call_kind").isin("LITERAL", "DYNAMIC"), "CALL_TARGET_NOT_IDENTIFIABLE"),
    )
    doubts = F.when(doubts != "", doubts)
    called = F.when(F.col("call_kind").isNull(), unknown("CALL_WITHOUT_TARGET_KIND")).when(sure, F.array(_effect("CALL", note=doubts))).otherwise(F.array(_effect("CALL", None, None, None, "PARTIAL", doubts)))
    each = (
        F.when(kind.isin(BRANCHING), none)
        .when(kind == "MOVE", moved).when(kind == "SET", sets)
        .when(kind.isin(COMPUTING), F.when(n_t > 0, F.transform(t, lambda x: _effect("COMPUTE", x))).otherwise(kept("CALCULATION_TARGET_UNAVAILABLE")))
        .when(kind.isin("GO_TO", "PERFORM") & ~away, kept("CONTROL_TRANSFER_TARGET_UNAVAILABLE"))
        .when(kind == "GO_TO", F.array(_effect("JUMP"))).when(kind == "PERFORM", F.array(_effect("PERFORM", None, None, None, "PARTIAL", "PERFORM_LOOP_CONTROL_NOT_FULLY_REPRESENTED")))
        .when(kind == "EXEC_SQL", F.when(n_t > 0, F.transform(t, lambda x: _effect("SQL_WRITE", x, None, None, "PARTIAL"))).otherwise(F.array(_effect("SQL", None, None, None, "PARTIAL"))))
        .when(kind == "CALL", called)
        .when(kind.isin(ENDING), kept("PROGRAM_TERMINATION_HAS_NO_DATA_EFFECT"))
        .otherwise(kept("STATEMENT_TEXT_PRESERVED_WITHOUT_SEMANTIC_EFFECT"))
    )
    more = [F.when(kind.isin("GO_TO", "PERFORM") & away, F.col("target_paragraphs")).alias("control_targets"), F.when(kind == "CALL", args).alias("arguments"), F.when(kind == "CALL", F.col("returning")).alias("returning")]
    out = s.select("program", "paragraph", "statement_id", "pos", *more, *(keep or []), F.posexplode(each).alias("ordinal", "e"))
    return out.select("program", "paragraph", "statement_id", "pos", "ordinal", "e.*", "control_targets", "arguments", "returning", *(keep or []))


def unsupported_effects(messages: DataFrame, message: str = "message", mark: str = " en paragraph ") -> DataFrame:
    """(program, paragraph, construct) of messages ``<construct><mark><paragraph>``."""
    m = F.col(message)
    return messages.where(F.contains(m, F.lit(mark))).select("program", F.trim(F.split_part(m, F.lit(mark), F.lit(2))).alias("paragraph"), F.trim(F.split_part(m, F.lit(mark), F.lit(1))).alias("construct"))


# --- straight-line and branching constants ---------------------------------


def straight_constants(rows: DataFrame, assigns: Column, clears: Column, value: Column, partition: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``known``: the value last assigned before a row with no
    clearing row since. Windows alone, for code without branches."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(assigns | clears, F.struct(clears.alias("c"), value.alias("v"))), ignorenulls=True).over(w)
    return rows.withColumn("l_", last).withColumn("known", F.when(~F.col("l_.c"), F.col("l_.v"))).drop("l_")


# --- between programs -------------------------------------------------------


def entry_facts(bindings: DataFrame, levels: DataFrame, rounds: int | None = None) -> DataFrame:
    """(program, formal, literal, conflicted): what is known of a formal on entry.

    ``bindings``: caller, callee, formal, literal (null if the actual is no
    literal) and via (the caller's own formal that is passed on, or null).
    ``levels``: node, level. Level by level, a formal is known if all observed
    literals agree and conflicted if two differ; callers whose value is not
    known say nothing. Callees without a level take no part.
    """
    b = bindings.join(levels.where("level is not null").select(F.col("node").alias("callee"), F.col("level").alias("l_")), "callee")
    last = rounds if rounds is not None else (b.agg(F.max("l_")).first()[0] or 0)
    facts = None
    for level in range(1, last + 1):
        here = b.where(F.col("l_") == level)
        if facts is not None:
            f = facts.where("not conflicted").select(F.col("program").alias("caller"), F.col("formal").alias("via"), F.col("literal").alias("passed"))
            here = here.join(f, ["caller", "via"], "left").withColumn("seen", F.coalesce("literal", "passed"))
        else:
            here = here.withColumn("seen", F.col("literal"))
        found = here.where("seen is not null").groupBy(F.col("callee").alias("program"), "formal").agg(F.when(F.min("seen") == F.max("seen"), F.min("seen")).alias("literal"), (F.min("seen") != F.max("seen")).alias("conflicted"))
        found = stash(found, "facts")
        facts = found if facts is None else facts.unionByName(found)
    return facts if facts is not None else b.select(F.col("callee").alias("program"), "formal", "literal", F.lit(False).alias("conflicted")).limit(0)


def exit_facts(observed: DataFrame, partition: list[str], order: list[str], literal: str) -> DataFrame:
    """``observed`` with ``exit``: the literal if all seen so far in ``order``
    agree, PROPAGATED; else null, INVALIDATED. Later conflicts change nothing before them."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.min(literal).over(w) == F.max(literal).over(w)
    ok = F.coalesce(same & F.col(literal).isNotNull(), F.lit(False))
    return observed.withColumn("exit", F.when(ok, F.col(literal))).withColumn("status", F.when(ok, "PROPAGATED").otherwise("INVALIDATED"))


def call_sites(sites: DataFrame, programs: DataFrame, called: str, name: str, id_col: str, actuals: str, formals: str) -> DataFrame:
    """``sites`` with (target, status): DYNAMIC without a name, UNRESOLVED or
    AMBIGUOUS by it, else BOUND where actuals and formals are as many, or COUNT_DIFFERS."""
    one = programs.groupBy(normal_name(F.col(name)).alias("k_")).agg(F.count("*").alias("n_"), F.min(id_col).alias("target"), F.min(formals).alias("formals_"))
    j = sites.join(one, normal_name(F.col(called)) == F.col("k_"), "left")
    status = F.when(F.col(called).isNull(), "DYNAMIC").when(F.col("n_").isNull(), "UNRESOLVED").when(F.col("n_") > 1, "AMBIGUOUS").when(F.col(actuals) == F.col("formals_"), "BOUND").otherwise("COUNT_DIFFERS")
    return j.select(*[sites[c] for c in sites.columns], F.when(F.col("n_") == 1, F.col("target")).alias("target"), status.alias("status"))
