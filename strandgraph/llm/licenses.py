"""License notices by diagonal voting of word k-grams."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandgraph.llm.rows import ordered
from strandgraph.llm.words import chunks, plain_words, window_hashes, word_hashes
from strandgraph.store import stash

#: Phrases whose places are the base labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Opening sentences of well-known public licence notices.
NOTICES = {
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "cc-by-nc": [
        "This work is licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    ],
    "gpl-3": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
}


def _gnu(name: str, short: str, versions: dict[str, list[str]]) -> dict[str, list[str]]:
    """Names of a GNU licence with its version, in words, by label."""
    return {
        f"{short}-{label}": [x for v in written for x in (f"gnu {name}public license version {v}", f"gnu {name}public license v{v}", f"gnu {short} version {v}", f"gnu {short} v{v}", f"the {short} version {v}", f"the {short} v{v}", f"under {short} version {v}", f"under {short} v{v}")]
        for label, written in versions.items()
    }


#: SPDX identifiers, in words, by label; they stand after ``spdx license identifier``.
SPDX = {
    "mit": ["mit"], "apache-2": ["apache 2 0"], "bsd": ["bsd 2 clause", "bsd 3 clause"], "0bsd": ["0bsd"], "isc": ["isc"], "mpl-2": ["mpl 2 0"], "epl-2": ["epl 2 0"], "epl-1": ["epl 1 0"],
    "gpl-2": ["gpl 2 0"], "gpl-3": ["gpl 3 0"], "lgpl-2.1": ["lgpl 2 1"], "lgpl-3": ["lgpl 3 0"], "agpl-3": ["agpl 3 0"],
    "cc-by": ["cc by 2 0", "cc by 2 5", "cc by 3 0", "cc by 4 0"], "cc-by-sa": ["cc by sa"], "cc-by-nd": ["cc by nd"], "cc0": ["cc0 1 0"], "unlicense": ["unlicense"],
}

#: Words before a short name that make it a grant.
GRANTING = ["licensed under", "licensed under the", "released under", "released under the", "under the terms of the"]


def _granted(*names: str) -> list[str]:
    return [f"{before} {name}" for before in GRANTING for name in names]


#: Names of licences as short grants give them. Names of two
#: versions share most k-grams, so all words must stand there, in a row. The
#: short names of attribution licences need their version or a granting word,
#: as plain words follow one another in the same way.
GRANTS = {
    **_gnu("general ", "gpl", {"2": ["2"], "3": ["3"]}), **_gnu("lesser general ", "lgpl", {"2.1": ["2 1"], "3": ["3"]}), **_gnu("affero general ", "agpl", {"3": ["3"]}),
    "bsd": ["bsd 2 clause", "bsd 3 clause", "2 clause bsd", "3 clause bsd", "two clause bsd", "three clause bsd", "under the bsd license", "new bsd license", "modified bsd license", "simplified bsd license"],
    "mpl-2": ["mozilla public license version 2", "mozilla public license v2", "mozilla public license 2 0", "mpl version 2", "mpl v2 0", "mpl 2 0"],
    "epl-2": ["eclipse public license version 2", "eclipse public license v2", "eclipse public license 2 0", "epl v2 0"], "epl-1": ["eclipse public license version 1", "eclipse public license v1", "eclipse public license 1 0", "epl v1 0"],
    "isc": ["the isc license", *_granted("isc license", "isc")],
    "apache-2": ["apache license v2", "apache license 2 0", "apache 2 0 license"],
    "mit": ["the mit license", "under mit license", "licensed under mit"],
    "cc-by": ["cc by 2 0", "cc by 2 5", "cc by 3 0", "cc by 4 0", *_granted("cc by 2", "cc by 3", "cc by 4"), "creative commons attribution license", *(f"creative commons attribution {v}" for v in (2, 3, 4))],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"],
    "cc-by-nd": ["cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs", "creative commons attribution no derivatives"],
    "cc-by-nc-sa": ["cc by nc sa", "creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike"],
    "cc-by-nc-nd": ["cc by nc nd", "creative commons attribution noncommercial noderivatives", "creative commons attribution noncommercial noderivs", "creative commons attribution non commercial no derivatives"],
    "cc0": ["cc0 1 0", "under cc0 license", "creative commons zero", "creative commons cc0"],
}
for _label, _names in {"gpl-2": ["gplv2", "gpl 2"], "gpl-3": ["gplv3", "gpl 3"], "lgpl-2.1": ["lgplv2 1", "lgpl 2 1"], "lgpl-3": ["lgplv3", "lgpl 3"], "agpl-3": ["agplv3", "agpl 3"]}.items():
    GRANTS[_label] = GRANTS[_label] + _granted(*_names)
for _label, _names in SPDX.items():
    GRANTS[_label] = [*GRANTS.get(_label, []), *(f"spdx license identifier {n}" for n in _names)]


#: Words per hashed gram: of short templates and of whole licence texts, whose
#: shorter grams stand in any prose.
SHORT, WHOLE = 3, 6


@dataclass
class Template:
    """A text to be found. ``exact``: all its words must stand in a row; ``base``: its places are base labels."""

    label: str
    words: list[bytes]
    k: int
    exact: bool = False
    base: bool = False


def whole_texts() -> dict[str, list[str]]:
    """The public licence texts that come with this module, by label."""
    return {p.stem: [p.read_text(encoding="utf-8")] for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))}


def templates(phrases: dict[str, str] | None = None, notices: dict[str, list[str]] | None = None, grants: dict[str, list[str]] | None = None, texts: dict[str, list[str]] | None = None) -> list[Template]:
    """All templates; None stands for the ones of this module."""
    found = [Template(label, plain_words(p), SHORT, True, True) for p, label in (PHRASES if phrases is None else phrases).items()]
    found += [Template(label, plain_words(t), SHORT) for label, ts in (NOTICES if notices is None else notices).items() for t in ts]
    found += [Template(label, plain_words(t), SHORT, True) for label, ts in (GRANTS if grants is None else grants).items() for t in ts]
    found += [Template(label, plain_words(t), WHOLE) for label, ts in (whole_texts() if texts is None else texts).items() for t in ts]
    for t in found:
        if len(t.words) < t.k:
            raise ValueError(f"template of fewer than {t.k} words: {t.label}")
    return found


def template_grams(spark: SparkSession, found: list[Template]) -> DataFrame:
    """(gram, said, template, at, k, exact, total): hashes and words of the templates' k-grams."""
    parts = []
    for number, t in enumerate(found):
        grams = window_hashes(word_hashes(t.words), t.k).view(np.int64)
        said = [b" ".join(t.words[i : i + t.k]).decode() for i in range(len(grams))]
        parts.append(pd.DataFrame({"gram": grams, "said": said, "template": number, "at": np.arange(len(grams)), "k": t.k, "exact": t.exact, "total": len(grams)}))
    schema = "gram long, said string, template int, at int, k int, exact boolean, total int"
    return spark.createDataFrame(pd.concat(parts), schema) if parts else spark.createDataFrame([], schema)


def _grams(found: list[Template]):
    """A row, with its words, per rolling gram whose hash a template has, and
    one without a gram per document that holds its number of words."""
    known = {k: np.unique(np.concatenate([window_hashes(word_hashes(t.words), k).view(np.int64) for t in found if t.k == k])) for k in sorted({t.k for t in found})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            words, counts = [], []
            for t in b["text"].to_pylist():
                w = plain_words(t)
                words += w
                counts.append(len(w))
            n = np.array(counts, np.int64)
            ord_ = b["ord"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ord_), pa.array(n), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.string())], ["ord", "pos", "gram", "words"])
            h = word_hashes(words)
            owner = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            for k, some in known.items():
                grams = window_hashes(h, k).view(np.int64)
                hit = np.flatnonzero((some[np.minimum(np.searchsorted(some, grams), len(some) - 1)] == grams) & (pos[: len(grams)] + k <= n[owner[: len(grams)]]))
                said = [b" ".join(words[i : i + k]).decode("utf-8", "surrogatepass") for i in hit.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ord_[owner[hit]]), pa.array(pos[hit]), pa.array(grams[hit]), pa.array(said, pa.string())], ["ord", "pos", "gram", "words"])

    return run


def _settle(found: list[Template]):
    """Documents' spans to (ord, label, base, start, end, share) of those that stand.

    Of overlapping spans of templates that are not exact, the one with the most
    equal words stands, or of these the one with the greatest share of its
    template: licence texts hold parts of one another.
    """

    def standing(spans: list[dict]) -> Iterator[tuple]:
        loose = []
        for x in spans:
            t = found[x["template"]]
            if t.exact:
                yield t.label, t.base, x["start"], x["end"], 1.0
            else:
                loose.append((-x["equal"], -x["equal"] / len(t.words), t.label, x["start"], x["end"]))
        taken: list[tuple[int, int]] = []
        for _, share, label, start, end in sorted(loose):
            i = bisect(taken, (start, end))
            if not (i and taken[i - 1][1] > start) and not (i < len(taken) and taken[i][0] < end):
                taken.insert(i, (start, end))
                yield label, False, start, end, -share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(o, *r) for o, s in zip(b["ord"].to_pylist(), b["spans"].to_pylist(), strict=True) for r in standing(s)]
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["ord", "label", "base", "start", "end", "share"])

    return run


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, list[str]] | None = None,
    drift: int = 3, least: float = 0.6, grants: dict[str, list[str]] | None = None, texts: dict[str, list[str]] | None = None,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) per row.

    All rolling gram hashes join the template positions (those of given text,
    so they are broadcast). Hits vote for diagonals (position in the text less
    position in the template). Phrases and grants stand at a place where one
    diagonal holds all their grams; a grant gives a label but no base label.
    For notices and whole licence texts, diagonals of one template within
    ``drift`` of the next are merged. A gram votes only where its words are
    the template's, not its hash alone, so a span is verified word by word: a
    merged span holds the template if its different grams are the share
    ``least`` of the template's grams, and the words in them that share of its
    words. Overlapping spans are settled by ``_settle``. Texts are read once
    and not shuffled. score is the largest share of votes of any template,
    phrases included.

    Null text is empty; an empty text has no labels, null first_word and
    score 0. Each input row gets one row, repeated rows and null ids
    included. Other columns are not read.
    """
    spark = docs.sparkSession
    found = templates(phrases, notices, grants, texts)
    d = ordered(docs, id_col, text_col)
    grams = d.select("ord", "text").mapInArrow(_grams(found), "ord long, pos long, gram long, words string")
    hits = grams.join(F.broadcast(template_grams(spark, found)), "gram", "left").where("gram is null or words = said").drop("words", "said")
    hits = hits.withColumn("diagonal", F.col("pos") - F.col("at"))
    by_diagonal = hits.groupBy("ord", "template", "k", "exact", "total", "diagonal").agg(F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    near = Window.partitionBy("ord", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(near) > drift)).cast("int"), F.lit(1))
    merged = by_diagonal.withColumn("apart", apart).withColumn("span", F.sum("apart").over(near))
    merged = merged.groupBy("ord", "template", "k", "exact", "total", "span").agg(
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.max("last").alias("n"), F.min("first").alias("start"), (F.max("last") + F.max("k")).alias("end")
    )
    merged = merged.withColumn("votes", F.size("ats"))
    covered = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("k") - 1))))
    merged = merged.withColumn("equal", F.when(F.col("votes") > 0, F.size(covered)).otherwise(0))
    share = F.when(F.col("template").isNotNull(), F.col("votes") / F.col("total"))
    may = F.when(F.col("exact"), share == 1).otherwise((share >= least) & (F.col("equal") / (F.col("total") + F.col("k") - 1) >= least))
    voted = merged.groupBy("ord").agg(
        F.max(F.when(F.col("template").isNull(), F.col("n"))).alias("n_words"), F.coalesce(F.max(share), F.lit(0.0)).alias("score"),
        F.collect_list(F.when(may, F.struct("template", "start", "end", "equal"))).alias("spans"),
    )
    voted = stash(voted, "votes")
    right = voted.where("size(spans) > 0").select("ord", "spans").mapInArrow(_settle(found), "ord long, label string, base boolean, start long, end long, share double")
    right = right.groupBy("ord").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.array_sort(F.collect_list(F.struct("start", "end", "label", "share"))).alias("spans"),
    )
    out = d.select(F.col("ord").alias("o_"), "doc_id").join(voted.drop("spans"), F.col("o_") == F.col("ord")).drop("o_").join(right, "ord", "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", empty("base_labels"), empty("labels"), "score", "spans")
