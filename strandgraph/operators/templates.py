"""Query templates with named parameters, bound by Spark, and known by digests."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A quoted text, a quoted name or a comment, or else a named parameter.
_PIECE = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|(?<![:\w]):([A-Za-z_]\w*)""", re.DOTALL)


def _literal(value) -> str:
    """A value as it stands in an effective text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class Template:
    """A query text and how often each of its ``:name`` parameters stands in it.

    Parameters in quotes and comments do not count. A text that is blank, or
    whose parameters are not exactly the declared ones, is an error.
    """

    name: str
    text: str
    parameters: dict[str, int]

    def __post_init__(self) -> None:
        if not self.text.strip():
            raise ValueError(f"query {self.name} is empty")
        found = dict(Counter(m[1] for m in _PIECE.finditer(self.text) if m[1]))
        if found != dict(self.parameters):
            raise ValueError(f"query {self.name} has the parameters {found}, not {dict(self.parameters)}")

    @property
    def sha256(self) -> str:
        return _digest(self.text)

    def effective(self, **values) -> str:
        """The text with its values in place: what is run, for the record."""
        if set(values) != set(self.parameters):
            raise ValueError(f"query {self.name} takes {sorted(self.parameters)}, not {sorted(values)}")
        return _PIECE.sub(lambda m: _literal(values[m[1]]) if m[1] else m[0], self.text)

    def run(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, **values) -> DataFrame:
        """The query's rows with (query, template_sha256, effective_sha256).

        Values are bound as typed arguments, never put into the text that is
        parsed. ``{table}`` in the text stands for one of ``tables``.
        """
        effective = self.effective(**values)
        rows = spark.sql(self.text, args=values, **(tables or {}))
        return rows.withColumns({"query": F.lit(self.name), "template_sha256": F.lit(self.sha256), "effective_sha256": F.lit(_digest(effective))})


def load_template(spark: SparkSession, path: str, name: str, parameters: dict[str, int]) -> Template:
    """A template from one file of any store that Spark reads."""
    found = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"query {name}: {path} is not one file")
    return Template(name, found[0].value, parameters)
