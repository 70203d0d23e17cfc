"""Licence scans by a trained paragraph classifier, in DataFrame functions and spark.ml only.

Passages become sparse hashed word uni- and bigrams: lines, overlapping windows of long lines, and, as
texts are often hard-wrapped, windows that run across the line ends of a paragraph (a run of lines with a
word) and the words on either side of each of its line ends. A
multinomial logistic regression, trained here on notices built from licence names and carrier phrases,
on clauses of the licence texts and on a bounded sample of the corpus as the unknown class, names a
family. A passage counts if its licence probability passes a bound calibrated on passages that the
regression was not fitted on, and if its words cover a template of that family. The bound lies over the unknown class (lines of
the corpus, and carrier phrases with names that are no licence's, which are what it may take for one) but for 1 - QUANTILE
of it, as far as the share KEPT of notices set aside stays over it.

Training is bounded (NOTES below and NEGATIVE_ROWS rows). Every line of every whole text is scored.
Passages across line ends are scored where their paragraph as a whole covers a template: in any other
paragraph none of them could be confirmed. The only shuffle carries the passages that were confirmed.

n_passages counts lines with a word. n_licence_passages counts confirmed lines, and 1 for a paragraph that is
confirmed across its line ends only.

Defined results: null, empty and wordless texts have no passage and no licence; each distinct (doc_id,
text) is judged once and repeated rows get equal results; an empty corpus gives no rows; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

# Licence families with the names that notices use for them.
NAMES = {
    "MIT": ["MIT License", "SPDX-License-Identifier: MIT", "Expat License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPLv2", "GPL-2.0-only"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPLv3", "GPL-3.0-only"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0-only"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0-only"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "BSD-3-Clause"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"],
    "ISC": ["ISC License", "SPDX-License-Identifier: ISC"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero 1.0", "CC0-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
}
# Phrases that carry a licence's name.
CARRIERS = ["Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "Distributed under the terms of the {}.", "SPDX-License-Identifier: {}", "You may use this file under the terms of the {}.", "License: {}", "This program is free software under the {}."]
# Opening clauses of licence texts.
CLAUSES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "Apache-2.0": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC0-1.0": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide",
}
# Sentences of the unknown class that use licence words.
NEAR_MISSES = ["The driver renewed her license last week.", "A software license can be expensive.", "Released under pressure from the press.", "The terms of the agreement were not public.", "Copyright is a matter of law.", "Permission was denied to any person.", "The Apache are a people of the Southwest.", "She studied at MIT for four years.", "Version 3 of the plan was distributed.", "The general public was free to enter.", "Public license fees rose.", "This work is new."]

# Names that stand in carrier phrases without being a licence's; every second is kept for the calibration.
OTHER_NAMES = ["Terms of Service", "terms of the sale", "Press Agreement", "Music Rights Act", "Open Mind Foundation", "company rules, version 2", "General Public Health Plan", "state of New York", "Creative Writing Programme", "Apache Tribe Council", "Public Library Rules 2.0", "university regulations"]
# What notices stand behind.
OPENINGS = ["", "Copyright (c) 2019 the authors. All rights reserved. ", "See the file LICENSE for details. ", "This project and its documentation: "]

#: Hash buckets, words of a passage, step between passages of a long line or a paragraph, words taken on either side of a line end.
BUCKETS, PASSAGE, STEP, EDGE = 1 << 13, 48, 24, 12
#: Lines without a word end a paragraph. Possessive, so that the matcher keeps no stack.
BREAK = r"\n(?:[^\p{L}\p{N}\n]*+\n)++"
#: Bound of the corpus sample for the unknown class, quantiles of the unknown class and of notices that the bound lies between, share of a template's bigrams that confirms, share that keeps a line of the corpus out of the unknown class.
NEGATIVE_ROWS, QUANTILE, KEPT, COVER, PIECE = 400, 0.999, 0.02, 0.6, 0.5
UNKNOWN = "unknown"
# Words of templates that any English text holds.
COMMON = frozenset("the of to and in or is a an any this on it be by for with without may not that are can as all has his her from which either work".split())


def words_of(text: Column) -> Column:
    return F.array_remove(F.array_remove(F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}.+]+"), lambda w: F.btrim(w, F.lit("."))), ""), "+")


def _bigrams(w: Column) -> Column:
    return F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def _terms(w: Column) -> Column:
    """Hashes of the uni- and bigrams: no strings are built, and HashingTF, which turns every string into a Java one, takes integers as they are.

    The outer lambda evaluates w once, wherever the optimizer puts it."""
    return F.get(F.transform(F.array(w), lambda v: F.concat(F.transform(v, lambda x: F.hash(x)), F.transform(v, lambda x, i: F.hash(x, F.get(v, i + 1))))), 0)


def _windows(w: Column) -> Column:
    # The outer lambda evaluates w once and not once a window.
    return F.get(F.transform(F.array(w), lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.size(v) - STEP, F.lit(1)), F.lit(STEP)), lambda at: F.slice(v, at, PASSAGE))), 0)


def _paragraphs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text_key, text) -> doc_id, text_key, para, lines, covers: the words of the paragraph's lines that have any, and whether they cover a template together.

    No filter stands on these columns: it would be pushed below them and make them twice."""
    paras = docs.select("doc_id", "text_key", F.posexplode(F.split("text", BREAK)).alias("para", "body"))
    words = paras.select("doc_id", "text_key", "para", F.filter(F.transform(F.split("body", "\n"), words_of), lambda w: F.size(w) > 0).alias("lines"))
    whole = words.withColumn("whole", F.flatten("lines"))
    some = F.arrays_overlap("whole", F.array(*[F.lit(w) for w in _anchors()]))
    known = whole.withColumn("known", F.when(some, _held(F.col("whole"))))
    return known.select("doc_id", "text_key", "para", "lines", _covers(F.col("known"), COVER).alias("covers"))


def _own(lines: Column) -> Column:
    """Windows of each line on its own: structs of line (its number) and words."""
    return F.flatten(F.transform(lines, lambda line, i: F.transform(_windows(line), lambda w: F.struct(i.alias("line"), w.alias("words")))))


def passages(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text_key, text) -> doc_id, text_key, para, line (-1: the passage is of more than one), words."""
    n = F.size("lines")
    ends = F.zip_with(F.slice("lines", 1, n - 1), F.slice("lines", 2, n - 1), lambda a, b: F.concat(F.slice(a, F.greatest(F.size(a) - EDGE + 1, F.lit(1)), EDGE), F.slice(b, 1, EDGE)))
    own = _own(F.col("lines"))
    across = F.transform(F.concat(ends, _windows(F.flatten("lines"))), lambda w: F.struct(F.lit(-1).alias("line"), w.alias("words")))
    found = F.explode(F.when(F.col("covers") & (n > 1), F.concat(own, across)).otherwise(own))
    return _paragraphs(docs).select("doc_id", "text_key", "para", found.alias("p")).select("doc_id", "text_key", "para", "p.line", "p.words")


def featured(rows: DataFrame) -> DataFrame:
    terms = rows.withColumn("terms", _terms(F.col("words")))
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="terms", outputCol="features").transform(terms).drop("terms")


def training_notes(spark: SparkSession, corpus: DataFrame | None) -> DataFrame:
    """family, words, aside (for the calibration)."""
    notes = [(f, OPENINGS[(i + k) % len(OPENINGS)] + c.format(n), (i + 2 * k) % 5 == 4) for f, ns in NAMES.items() for k, n in enumerate(ns) for i, c in enumerate(CARRIERS)] + [(f, c, False) for f, c in CLAUSES.items() for _ in range(4)]
    notes += [(UNKNOWN, x, False) for x in NEAR_MISSES for _ in range(3)]
    notes += [(UNKNOWN, OPENINGS[(i + k) % len(OPENINGS)] + c.format(n), k % 2 == 1) for k, n in enumerate(OTHER_NAMES) for i, c in enumerate(CARRIERS)]
    fixed = spark.createDataFrame(notes, "family string, note string, aside boolean").select("family", words_of(F.col("note")).alias("words"), "aside")
    if corpus is None:
        return fixed
    # The corpus holds notices too: paragraphs that cover a template, and so the lines of a wrapped one, are no example of the unknown class.
    ids = corpus.where(F.col("text").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(21)), "doc_id").limit(NEGATIVE_ROWS)
    # Only ids are ranked in one place; at most NEGATIVE_ROWS of them are broadcast.
    sample = corpus.where(F.col("text").isNotNull()).join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
    paras = _paragraphs(sample.select("doc_id", F.lit(0).cast("long").alias("text_key"), "text"))
    clean = paras.select(F.explode(F.when(~F.col("covers"), _own(F.col("lines")))).alias("w")).select("w.words")
    # Nor is a piece of a notice cut apart, which a whole one holds too.
    clean = clean.where(~_covers(_held(F.col("words")), PIECE))
    clean = clean.withColumn("aside", F.pmod(F.xxhash64("words"), F.lit(4)) == 0)
    return fixed.unionByName(clean.select(F.lit(UNKNOWN).alias("family"), "words", "aside"))


def _parts_of(note: str) -> list[str]:
    w = [x.strip(".") for x in "".join(c if c.isalnum() or c in ".+" else " " for c in note.lower()).split()]
    w = [x for x in w if x]
    pairs = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    return sorted(set(pairs or w))


def _anchors() -> list[str]:
    """Words of the templates but COMMON: more than 1 - COVER of each template's parts hold one, so a text without any covers none."""
    return sorted({w for p in _known_parts() for w in p.split()} - COMMON)


def _known_parts() -> list[str]:
    return sorted({p for n in [n for ns in NAMES.values() for n in ns] + list(CLAUSES.values()) for p in _parts_of(n)})


def _hash_of(part: str) -> Column:
    """The part among _terms; a constant when the plan is made."""
    return F.hash(*[F.lit(w) for w in part.split()])


def _held(w: Column) -> Column:
    """Those of _terms that are the templates'."""
    return F.array_distinct(F.filter(_terms(w), lambda t: t.isin([_hash_of(p) for p in _known_parts()])))


def _covers(held: Column, share: float) -> Column:
    """Whether they are that share of a template. Equal hashes of other words may say so too: passages are confirmed by their words."""
    return F.get(F.transform(F.array(held), lambda v: F.when(F.size(v) > 0, F.exists(_template_parts(hashed=True), lambda t: F.size(F.array_intersect(t, v)) >= share * F.size(t))).otherwise(False)), 0)


def _template_parts(family: str | None = None, hashed: bool = False) -> Column:
    """Literal array of the templates' bigrams, or of their hashes; their number is that of the fixed values above."""
    notes = [n for f, ns in NAMES.items() for n in ns if family in (None, f)] + [c for f, c in CLAUSES.items() if family in (None, f)]
    return F.array(*[F.array(*[_hash_of(p) if hashed else F.lit(p) for p in _parts_of(n)]) for n in notes])


class Scanner:
    """families (index order), the fitted regression and the calibrated bound of the licence probability."""

    def __init__(self, families, model, bound: float):
        self.families, self.model, self.bound = families, model, bound

    def scored(self, rows: DataFrame) -> DataFrame:
        p = vector_to_array("probability", "float64")
        out = self.model.transform(featured(rows)).select(*rows.columns, "prediction", p.alias("p"))
        names = F.array(*[F.lit(f) for f in self.families])
        return out.select(*rows.columns, F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("family"), F.element_at("p", (F.col("prediction") + 1).cast("int")).alias("score"), (1 - F.element_at("p", self.families.index(UNKNOWN) + 1)).alias("licensed"))


def train(spark: SparkSession, corpus: DataFrame | None) -> Scanner:
    notes = written(training_notes(spark, corpus), "licence-notes")
    families = [UNKNOWN, *NAMES]
    index = F.element_at(F.map_from_arrays(F.array(*[F.lit(f) for f in families]), F.array(*[F.lit(float(i)) for i in range(len(families))])), F.col("family"))
    fitted = featured(notes.where(~F.col("aside"))).withColumn("label", index).coalesce(1)
    model = LogisticRegression(family="multinomial", maxIter=25, regParam=2e-4, elasticNetParam=0.0, tol=1e-5, labelCol="label").fit(fitted)
    scanner = Scanner(families, model, 0.5)
    unknown = F.col("truth") == UNKNOWN
    scored = scanner.scored(notes.where("aside").select("words", F.col("family").alias("truth")))
    out, into = scored.agg(F.percentile_approx(F.when(unknown, F.col("licensed")), QUANTILE, 10_000), F.percentile_approx(F.when(~unknown, F.col("licensed")), KEPT, 10_000)).first()
    scanner.bound = min(float(out or 0.0), float(into or 0.0))
    return scanner


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_passages, n_licence_passages, licences, score."""
    spark = docs.sparkSession
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    scanner = scanner or train(spark, d.select("doc_id", "text"))
    near = scanner.scored(passages(d)).where((F.col("family") != UNKNOWN) & (F.col("licensed") >= scanner.bound))
    parts = F.concat("words", _bigrams(F.col("words")))
    own = F.coalesce(*[F.when(F.col("family") == f, _template_parts(f)) for f in NAMES])
    near = near.where(F.exists(own, lambda t: F.size(F.array_intersect(t, parts)) >= COVER * F.size(t)))
    # sets of places, so that repeated rows count once and a line with several windows too
    lines, only = F.collect_set(F.when(F.col("line") >= 0, F.struct("para", "line"))), F.array_except(F.collect_set("para"), F.collect_set(F.when(F.col("line") >= 0, F.col("para"))))
    found = near.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg((F.size(lines) + F.size(only)).alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licences"), F.max("score").alias("score"))
    everything = d.select("doc_id", "text_key", _passage_count().alias("n_passages"))
    out = everything.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    return out.select("doc_id", "n_passages", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_licence_passages"), F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _passage_count() -> Column:
    """Lines that hold a word."""
    return F.greatest(F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))), F.lit(0)), F.lit(0)).cast("bigint")
