"""Files of a package as tables: inventory, programs, snapshots, declarations, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandgraph.functions.scalar import encoding_of

#: Kinds of package files by extension.
KINDS = {"cbl": "COBOL", "cob": "COBOL", "cpy": "COPYBOOK", "dcl": "DCLGEN", "sql": "SQL", "ddl": "DDL", "csv": "CSV", "xml": "MANIFEST"}


def inventory(spark: SparkSession, path: str, declared: str | None = None) -> DataFrame:
    """(path, name, kind, size, sha256, encoding) of every file under a folder; kind and encoding null where nothing tells."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path", name.alias("name"), F.try_element_at(kinds, F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))).alias("kind"), F.col("length").alias("size"),
        F.sha2("content", 256).alias("sha256"), encoding_of("content", F.lit(declared) if declared else None).alias("encoding"),
    )


def entry_problems(entries: DataFrame, max_entries: int = 10_000, max_bytes: int = 1 << 30, max_ratio: float = 200.0) -> DataFrame:
    """(code, entry) of archive entries (name, size, packed) that may not be unpacked: paths
    that leave the folder, names that collide without regard to case, sizes, ratio, number."""
    clean = F.regexp_replace("name", r"\\", "/")
    bad = entries.where(clean.rlike(r"(^|/)\.\.(/|$)|^/|^[A-Za-z]:|[\x00-\x1F]")).select(F.lit("UNSAFE_PATH").alias("code"), F.col("name").alias("entry"))
    same = entries.groupBy(F.lower(clean).alias("k")).agg(F.count("*").alias("n"), F.min("name").alias("entry")).where("n > 1").select(F.lit("NAME_COLLISION").alias("code"), "entry")
    ratio = entries.where(F.col("size") > max_ratio * F.greatest("packed", F.lit(1))).select(F.lit("COMPRESSION_RATIO").alias("code"), F.col("name").alias("entry"))
    whole = entries.agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    many = whole.where(F.col("n") > max_entries).select(F.lit("TOO_MANY_ENTRIES").alias("code"), F.lit(None).cast("string").alias("entry"))
    large = whole.where(F.col("b") > max_bytes).select(F.lit("TOO_LARGE").alias("code"), F.lit(None).cast("string").alias("entry"))
    return bad.union(same).union(ratio).union(many).union(large)


def missing_paths(declared: DataFrame, entries: DataFrame, path: str = "path", name: str = "name") -> DataFrame:
    """Declared paths that the package does not hold; a null path is missing."""
    return declared.join(entries.select(F.col(name).alias("n_")).distinct(), F.col(path) == F.col("n_"), "left_anti")


def programs(spark: SparkSession, path: str, schema: str, hashes: DataFrame | None = None) -> DataFrame:
    """Program documents by a fixed schema, a malformed one fails the read; with
    ``hashes`` (source_file, sha256) those that were made of other sources fail too."""
    docs = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", "true").json(path)
    if hashes is None:
        return docs
    h = hashes.select(F.col("source_file").alias("f_"), F.col("sha256").alias("h_"))
    joined = docs.join(h, F.col("source_file") == F.col("f_"), "left")
    return joined.where(F.when(F.col("h_").eqNullSafe(F.col("source_hash")), True).otherwise(F.raise_error(F.concat(F.lit("other source: "), F.col("source_file"))))).select(*[docs[c] for c in docs.columns])


def manifests(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Elements ``row_tag`` of XML files by a fixed schema; malformed ones fail."""
    return spark.read.format("xml").schema(schema).option("rowTag", row_tag).option("mode", "FAILFAST").load(path)


#: What becomes of a manifest file, the first that holds.
OUTCOMES = ["UNSAFE", "NOT_WELL_FORMED", "SCHEMA_INVALID", "VALUE_INVALID", "VALID"]


def manifest_outcomes(files: DataFrame, schema: str, required: dict[str, Column], allowed: dict[str, Column], path: str = "path", content: str = "content") -> DataFrame:
    """(path, outcome, problems, manifest) per XML file, none of which fails the job.

    UNSAFE has a document type or an entity of its own and is not read;
    NOT_WELL_FORMED is no XML; SCHEMA_INVALID lacks something ``required``,
    conditions over columns of ``schema`` by name, all of whose fields are read
    as text; VALUE_INVALID breaks something ``allowed``. ``problems`` names the
    conditions that do not hold, sorted; a null condition does not hold.
    ``manifest`` is null but for VALID ones.
    """
    text = F.col(content).cast("string")
    unsafe = F.coalesce(text.rlike(r"(?i)<!(DOCTYPE|ENTITY)\b"), F.lit(False))
    read = F.from_xml(F.when(~unsafe, text), f"{schema}, broken_ string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken_"})
    held = files.select(F.col(path).alias("path"), unsafe.alias("unsafe_"), F.coalesce(F.trim(text) == "", F.lit(True)).alias("blank_"), read.alias("m_")).select("*", "m_.*")
    wrong = lambda rules: F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])))
    held = held.withColumns({"lacks_": wrong(required), "bad_": wrong(allowed)})
    broken = F.col("blank_") | F.col("m_").isNull() | F.col("broken_").isNotNull()
    outcome = F.when(F.col("unsafe_"), OUTCOMES[0]).when(broken, OUTCOMES[1]).when(F.size("lacks_") > 0, OUTCOMES[2]).when(F.size("bad_") > 0, OUTCOMES[3]).otherwise(OUTCOMES[4])
    out = held.withColumn("outcome", outcome)
    problems = F.when(F.col("outcome") == OUTCOMES[2], F.col("lacks_")).when(F.col("outcome") == OUTCOMES[3], F.col("bad_")).otherwise(F.expr("cast(array() as array<string>)"))
    return out.select("path", "outcome", problems.alias("problems"), F.when(F.col("outcome") == OUTCOMES[4], F.col("m_").dropFields("broken_")).alias("manifest"))


def snapshot_rows(lines: DataFrame, file: str = "file", number: str = "line_no", text: str = "line", max_rows: int | None = 100_000) -> tuple[DataFrame, DataFrame]:
    """CSV lines with their file and number, to (file, row_number, row_hash, raw,
    normalized) and (file, status).

    Row 1 is the header. Short rows are filled with empty text and long rows
    cut, either makes the file PARTIAL. Headers that are equal once trimmed
    and upper-cased, or over ``max_rows`` rows (a limit of the file format;
    None sets none), make it UNSUPPORTED, and its rows go. Quoted fields may hold commas and doubled quotes, not line feeds.
    """
    field = F.regexp_extract_all(F.concat(F.lit(","), F.col(text)), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    plain = F.transform(field, lambda x: F.when(F.startswith(x, F.lit('"')), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    cut = lines.where(F.col(text).isNotNull()).select(F.col(file).alias("file"), F.col(number).cast("long").alias("n"), plain.alias("v"))
    heads = cut.where("n = 1").select(F.col("file").alias("f_"), F.col("v").alias("head"), F.transform("v", lambda x: F.upper(F.trim(x))).alias("keys"))
    rows = cut.where("n > 1").join(heads, F.col("file") == F.col("f_"))
    width = F.size("head")
    counted = heads.join(rows.groupBy("file").agg(F.count("*").alias("rows"), F.bool_or(F.size("v") != width).alias("uneven")), F.col("file") == F.col("f_"), "left")
    odd = (F.size(F.array_distinct("keys")) < F.size("keys")) | (F.lit(False) if max_rows is None else F.coalesce("rows", F.lit(0)) > max_rows)
    status = counted.select(F.col("f_").alias("file"), F.when(odd, "UNSUPPORTED").when(F.coalesce("uneven", F.lit(False)), "PARTIAL").otherwise("SUPPORTED").alias("status"))
    good = rows.join(status.where("status <> 'UNSUPPORTED'").select(F.col("file").alias("g_")), F.col("file") == F.col("g_"), "left_semi")
    even = F.transform("head", lambda _, i: F.coalesce(F.get("v", i), F.lit("")))
    out = good.select(
        "file", (F.col("n") - 1).alias("row_number"), F.sha2(F.to_json(even), 256).alias("row_hash"),
        F.map_from_arrays("head", even).alias("raw"), F.map_from_arrays("keys", F.transform(even, lambda x: F.trim(x))).alias("normalized"),
    )
    return out, status


def sql_access(sql: Column) -> Column:
    """(table, operation, predicate, host_variables) of one embedded statement.

    Joins and statements that start otherwise are not interpreted: table and
    operation are null, host variables stay. Indicator variables are left out.
    """
    s = F.trim(F.regexp_replace(F.regexp_replace(sql, r"(?i)\bEXEC\s+SQL\b|\bEND-EXEC\b\.?", " "), r"\s+", " "))
    found = lambda p, g=1: F.nullif(F.regexp_extract(s, p, g), F.lit(""))
    name = r"([A-Za-z0-9_.\"#$@-]+)"
    verb = F.upper(found(r"^(\w+)"))
    joined = s.rlike(r"(?i)\bJOIN\b")
    table = F.when(verb == "SELECT", found(rf"(?i)\bFROM {name}")).when(verb == "INSERT", found(rf"(?i)^INSERT INTO {name}")).when(verb == "UPDATE", found(rf"(?i)^UPDATE {name}")).when(verb == "DELETE", found(rf"(?i)^DELETE FROM {name}"))
    operation = F.when(verb == "SELECT", "READS").when(verb == "INSERT", "INSERTS").when(verb == "UPDATE", "UPDATES").when(verb == "DELETE", "WRITES")
    return F.struct(
        F.when(~joined, F.upper(table)).alias("table"), F.when(~joined & table.isNotNull(), operation).alias("operation"), F.when(~joined, found(r"(?i)\bWHERE (.+?)(?: (?:ORDER|GROUP) BY .*)?$")).alias("predicate"),
        F.array_distinct(F.regexp_extract_all(s, F.lit(r"(?<![:\w]):\s?([A-Za-z][\w-]*)"), F.lit(1))).alias("host_variables"),
    )


def unclear_terms(glossary: DataFrame, tag: str = "tag", term: str = "term") -> DataFrame:
    """Tags that a glossary maps to several terms; must be empty."""
    return glossary.groupBy(tag).agg(F.array_sort(F.collect_set(term)).alias("terms")).where(F.size("terms") > 1)


def latest_state(states: DataFrame, emergencies: DataFrame, run: str, at: str, status: str, final: list[str]) -> DataFrame:
    """The last state of each run; an emergency record that is strictly newer than a state that is not final takes its place."""
    w = Window.partitionBy(run).orderBy(F.desc(at), status)
    last = lambda df: df.select(run, at, status).withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")
    s = last(states).select(F.col(run).alias("run"), F.col(at).alias("s_at"), F.col(status).alias("s"))
    e = last(emergencies).select(F.col(run).alias("run"), F.col(at).alias("e_at"), F.col(status).alias("e"))
    both = s.join(e, "run", "full_outer")
    newer = F.col("s").isNull() | (~F.col("s").isin(final) & (F.col("e_at") > F.col("s_at")))
    take = F.coalesce(newer & F.col("e").isNotNull(), F.lit(False))
    return both.select("run", F.when(take, F.col("e_at")).otherwise(F.col("s_at")).alias("at"), F.when(take, F.col("e")).otherwise(F.col("s")).alias("status"), take.alias("emergency"))
