"""Licence scans with DataFrame operations only: a trained paragraph classifier, confirmed by templates.

A paragraph without any licence-specific word has no evidence and is unknown; those words are learned: template words
that ordinary paragraphs hardly use. For the others a logistic regression over counts of word 1- and
2-grams gives a family or none (class `unknown`). It is trained on the sentences of TEMPLATES and on ordinary paragraphs:
fixed ones, and all those of the scanned corpus. The probability of being a licence text is calibrated on examples kept
out of the training, and a prediction counts only if the paragraph shares enough word pairs with one of its family's
templates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.tables import release, stage

UNKNOWN = "unknown"
#: What all ordinary paragraphs of a corpus weigh together in the training at most, in examples: they outnumber the
#: templates the more, the larger the corpus is, and each weighs less for it.
CORPUS_WEIGHT = 2000.0
#: Share of a corpus' ordinary paragraphs from which on a word they use is not specific to licences.
USED = 0.0005
#: Smallest share of a paragraph's word pairs that are found in a template of its family.
SIMILARITY = 0.5
#: Calibrated probability from which a paragraph counts.
THRESHOLD = 0.5
#: Smallest share of a template's word pairs that are found in a paragraph which says other things besides.
CONTAINED = 0.8
#: Paragraphs of more words are cut at sentence ends and longer sentences into windows of so many words, half of which
#: the next one shares, so that a notice within a paragraph is not drowned.
LONG = 24

# Characteristic sentences of public licences, by family.
TEMPLATES: dict[str, list[str]] = {
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Except where otherwise noted, content is available under the Creative Commons Attribution License.",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Released under the CC BY-NC 4.0 licence; commercial use is not permitted.",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
        "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
}

# Ordinary sentences that share words with licences.
ORDINARY = [
    "She renewed her driving licence and then went to work at the office.",
    "The software was released last week and the general public can download a copy.",
    "Permission to enter the building is granted by the front desk.",
    "The Apache helicopter flew under the clouds above the public park.",
    "The university at Cambridge is known as MIT and has many students.",
    "Any person who obtains a copy of the report must work with the team.",
    "The following conditions were measured in the study without any change.",
    "This work was done under the direction of the project leader, with version control.",
    "The conditions of the road and the terms of the contract were discussed at length.",
    "Free entry for the public; use the side door and follow the signs.",
    "The foundation published a list of books that you can read for any purpose.",
    "It is the in of and to a that was for with from are at by on this be.",
]


#: What holds one of these, lower-cased, is not learned as ordinary.
BARRED = ("licenc", "licens", "copyright", "permit", "permiss", "redistribut", "warrant", "public domain")


def word_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits (with inner hyphens), in order."""
    return _words(F.lower(F.coalesce(text, F.lit(""))))


def _words(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}\-]+"), F.lit(0))


def pairs(words: Column) -> Column:
    """Runs of two words, joined by a space."""
    rest = F.size(words) - 1
    return F.when(rest > 0, F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, paragraph, body): the lines that are not blank, numbered from 0."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(body, "\n")).alias("paragraph", "body"))
    return lines.where(F.trim("body") != "")


def parts(lines: DataFrame) -> DataFrame:
    """lines with `part` and the part's `body`: lines of at most LONG words whole, of longer ones the sentences and of
    longer sentences windows of LONG words. Parts are numbered by sentence."""
    sentences = F.when(_long(F.col("body")), F.split("body", r"\s(?<=[.!?]\s)\s*")).otherwise(F.array("body"))
    rest = [c for c in lines.columns if c != "body"]
    cut = lines.select(*rest, F.posexplode(sentences).alias("part", "sentence"))
    step = LONG // 2

    def windows(spoken: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil((F.size(spoken) - LONG) / step).cast("int")), lambda i: F.array_join(F.slice(spoken, i * step + 1, LONG), " "))

    bodies = F.when(_long(F.col("sentence")), _let(F.split("sentence", r"\s+"), windows)).otherwise(F.array("sentence"))
    return cut.select(*rest, "part", F.explode(bodies).alias("body"))


def _long(text: Column) -> Column:
    """Whether white space cuts a text into more than LONG words; nothing behind those is read."""
    return (F.length(text) >= 2 * LONG - 1) & text.rlike(rf"^\S*+(?:\s++\S*+){{{LONG}}}")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _examples() -> list[tuple[str, str, int]]:
    """(body, family, fold): each template whole, in halves and with its surroundings. Fold 1, for calibration, holds all
    variants of every third template of a family (the second one where there are two), so no template is in both."""
    out = []
    for family, bodies in TEMPLATES.items():
        for i, body in enumerate(bodies):
            words = body.split()
            variants = [body, f"Copyright 2024 the authors. {body}", f"{body} All rights reserved.", f"Note: {body} Thanks."]
            if len(words) >= 12:
                variants += [" ".join(words[: 2 * len(words) // 3]), " ".join(words[len(words) // 3 :])]
            out += [(v, family, int(i % 3 == min(2, len(bodies) - 1))) for v in variants]
    for k, body in enumerate(ORDINARY):
        words = body.split()
        out += [(v, UNKNOWN, int(k % 3 == 2)) for v in (body, " ".join(reversed(words)), " ".join(words[: len(words) // 2]))]
    return out


class LicenceModel:
    """The fitted classifier: vocabulary of the templates' n-grams, regression, licence-specific words, calibration; and
    how many different ordinary paragraphs of a corpus it has learned from."""

    def __init__(self, vector: CountVectorizerModel, regression: LogisticRegressionModel, families: list[str], telling: list[str], learned: int = 0) -> None:
        self.vector, self.regression, self.families, self.telling, self.learned = vector, regression, families, telling, learned
        self.calibration: LogisticRegressionModel | None = None

    def tells(self, words: Column) -> Column:
        """Whether any of the words is specific to licences."""
        return F.arrays_overlap(words, F.array(*[F.lit(w) for w in self.telling]))

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with `body` -> with words, pairs, family (the best one that is not unknown) and raw (log odds); those
        without a licence-specific word are left out."""
        spoken = rows.withColumn("words", word_list(F.col("body"))).where(self.tells(F.col("words")))
        grams = spoken.withColumn("pairs", pairs(F.col("words"))).withColumn("grams", F.concat("words", "pairs"))
        return self.rate(self.vector.transform(grams), *rows.columns, "words", "pairs")

    def rate(self, counted: DataFrame, *keep: str) -> DataFrame:
        """The columns `keep` of rows with `features`, family and raw."""
        scored = self.regression.transform(counted).withColumn("found", vector_to_array("probability"))
        # Exploded, the probabilities are a generator's output: a later filter is not pushed below it, where it would
        # run the model once for every use of a probability.
        scored = scored.select(*keep, F.explode(F.array("found")).alias("chances"))
        chances, unknown = F.col("chances"), self.families.index(UNKNOWN)
        known = F.array(*[F.struct(chances[i].alias("p"), F.lit(f).alias("family")) for i, f in enumerate(self.families) if i != unknown])
        miss = F.greatest(chances[unknown], F.lit(1e-12))
        best = scored.withColumn("best", F.array_max(known))
        raw = F.log(F.greatest(F.col("best.p"), F.lit(1e-12)) / miss)
        return best.select(*keep, F.col("best.family").alias("family"), raw.alias("raw"))

    def chance(self, raw: Column) -> Column:
        """Calibrated probability that a paragraph is a licence text."""
        a, b = float(self.calibration.coefficients[0]), float(self.calibration.intercept)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(raw * a + b)))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with the column `name`, computed once a row: as a generator's output it is not inlined where it is used."""
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def _counted(rows: DataFrame, vector: CountVectorizerModel) -> DataFrame:
    """rows with `body` -> with words, pairs and features, the counts of the vocabulary's n-grams."""
    spoken = _once(_once(rows, "words", word_list(F.col("body"))), "pairs", pairs(F.col("words")))
    return _once(vector.transform(spoken.withColumn("grams", F.concat("words", "pairs"))).drop("grams"), "features", F.col("features"))


def ordinary(corpus: DataFrame, vector: CountVectorizerModel, known: list[list[str]]) -> DataFrame:
    """(fold, features, n): counts of the n-grams in all ordinary paragraphs of the corpus, and how many different
    paragraphs have them; known: the different word pairs of each template.

    Not ordinary, so that no notice is taught as unknown, are paragraphs with a word of `licen[cs]e`, `copyright`,
    `permission` and the like (BARRED), and those that `scan` would find similar enough to some template. A paragraph that
    many documents share is one example; documents (the least of it), not paragraphs, are dealt to the folds.

    A paragraph's counts follow from its gist: its words in the vocabulary, with a gap wherever others stand between. They
    are taken once for all paragraphs of one gist.
    """
    single, double = [g for g in vector.vocabulary if " " not in g], [g for g in vector.vocabulary if " " in g]
    templates = F.array(*[F.array(*[F.lit(p) for p in k]) for k in known])
    # Templates of which too many pairs are barred are contained in none of these paragraphs.
    least = min(len(k) for k in known if sum(not any(b in p for b in BARRED if " " not in b) for p in k) >= CONTAINED * len(k))

    def near(shared: Column) -> Column:
        n = F.size(shared)
        # No fewer pairs are different than words, less one: only few paragraphs need theirs formed.
        alike = (n > 0) & (n >= SIMILARITY * (F.size(F.array_distinct("words")) - 1))
        own = F.when(alike, F.size(F.array_distinct(pairs(F.col("words"))))).otherwise(F.lit(2**31 - 1))
        # Only what shares so many pairs with all templates together can do so with one.
        return _let(own, lambda o: ((n >= SIMILARITY * o) | (n >= CONTAINED * least)) & F.exists(templates, lambda k: like(F.size(F.array_intersect(shared, k)), o, F.size(k))))

    def like(both: Column, own: Column, size: Column) -> Column:
        return (both >= SIMILARITY * own) | (both >= CONTAINED * size)

    low = F.col("low")
    plain = _once(parts(paragraphs(corpus)).select("doc_id", "body"), "low", F.lower("body")).where(~reduce(Column.__or__, [low.contains(b) for b in BARRED]))
    spoken = _once(plain.select("doc_id", F.xxhash64("body").alias("h"), "low"), "words", _words(low)).drop("low")
    marked = F.array_join(F.transform("words", lambda w: F.when(w.isin(single), w).otherwise(F.lit(""))), " ")
    met = _once(spoken, "gist", F.trim(F.regexp_replace(marked, " {3,}", "  ")))
    shared = F.array_distinct(F.filter(pairs(F.split("gist", " ")), lambda p: p.isin(double)))
    others = met.where(~F.when(F.col("gist").rlike(r"\S \S"), _let(shared, near)).otherwise(F.lit(False)))
    distinct = others.groupBy("h", "gist").agg(F.min("doc_id").alias("doc_id"))
    fold = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 2).cast("int")
    told = distinct.groupBy(fold.alias("fold"), "gist").agg(F.count(F.lit(1)).alias("n"))
    grams = _once(told, "told", F.split("gist", " ")).select("fold", "n", F.concat("told", pairs(F.col("told"))).alias("grams"))
    counted = _once(vector.transform(grams), "features", F.col("features"))
    return counted.groupBy("fold", "features").agg(F.sum("n").alias("n"))


def fit(spark: SparkSession, corpus: DataFrame | None = None) -> LicenceModel:
    """Train on the templates, ORDINARY and, if a corpus is given, all its ordinary paragraphs, which weigh CORPUS_WEIGHT
    examples together at most. Words are specific to licences if ORDINARY has none of them and less than a share of USED of the
    corpus' ordinary paragraphs."""
    templates = spark.createDataFrame([(i, t) for i, t in enumerate(t for bodies in TEMPLATES.values() for t in bodies)], "template int, body string")
    spoken = templates.withColumn("words", word_list(F.col("body"))).withColumn("pairs", F.array_distinct(pairs(F.col("words")))).orderBy("template").collect()  # as many as TEMPLATES
    words = sorted({w for r in spoken for w in r["words"]})
    vocabulary = words + sorted({p for r in spoken for p in r["pairs"]})
    vector = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    families = sorted([*TEMPLATES, UNKNOWN])
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("label_name")) - 1
    fixed = _counted(spark.createDataFrame(_examples(), "body string, label_name string, fold int").coalesce(1), vector)
    ready = fixed.select("fold", "features", label.cast("double").alias("label"), F.lit(1.0).alias("weight"))
    used = {r["word"] for r in fixed.where(F.col("label_name") == UNKNOWN).select(F.explode("words").alias("word")).distinct().collect()}  # of ORDINARY
    learned, counts = 0, None
    if corpus is not None:
        counts = stage(ordinary(corpus, vector, [r["pairs"] for r in spoken]), "licences-ordinary")
        learned = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        met = counts.select(F.explode(F.unwrap_udt("features")["indices"]).alias("at"), "n").where(F.col("at") < len(words)).groupBy("at").agg(F.sum("n").alias("n"))
        used |= {words[r["at"]] for r in met.where(F.col("n") >= USED * learned).collect()}  # no more than the vocabulary
        share = min(1.0, CORPUS_WEIGHT / max(learned, 1))
        ready = ready.unionByName(counts.select("fold", "features", F.lit(float(families.index(UNKNOWN))).alias("label"), (F.col("n") * share).alias("weight")))
    try:
        learner = LogisticRegression(family="multinomial", regParam=0.002, maxIter=40, weightCol="weight")
        telling = [w for w in words if not w.isdigit() and w not in used]
        model = LicenceModel(vector, learner.fit(ready.where("fold = 0")), families, telling, learned)
        held = model.rate(ready.where("fold = 1"), "label", "weight")
        truth = (F.col("label") != families.index(UNKNOWN)).cast("double")
        one = VectorAssembler(inputCols=["raw"], outputCol="features").transform(held.select(truth.alias("label"), "raw", "weight"))
        model.calibration = LogisticRegression(regParam=0.01, maxIter=40, weightCol="weight").fit(one)
        model.regression = learner.fit(ready)  # the calibrated odds hold for the model of all examples as well
    finally:
        if counts is not None:
            release(counts)
    return model


def scan(docs: DataFrame, model: LicenceModel, threshold: float = THRESHOLD, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, paragraph, part, family, score, similarity, body) of every sentence that is a licence text or holds one.

    similarity is the share of the part's word pairs found in the closest template of its family, or, if it is larger and
    at least CONTAINED, the share of a template's pairs found in the part: so a notice counts in the middle of a
    paragraph. Blank and null texts have no paragraphs; rows of one doc_id with the same paragraph are one.
    """
    lines = paragraphs(docs)
    scored = model.score(parts(lines.where(model.tells(word_list(F.col("body"))))))
    scored = scored.withColumn("score", model.chance(F.col("raw"))).where((F.col("score") >= threshold) & (F.size("pairs") > 0))
    spark = docs.sparkSession
    flat = spark.createDataFrame([(f, b) for f, bodies in TEMPLATES.items() for b in bodies], "of string, template string")
    known = flat.withColumn("known", F.array_distinct(pairs(word_list(F.col("template"))))).groupBy("of").agg(F.collect_list("known").alias("known"))
    own = F.array_distinct("pairs")

    def like(k: Column) -> Column:
        both = F.size(F.array_intersect(own, k))
        held = both / F.size(k)
        return F.greatest(both / F.size(own), F.when(held >= CONTAINED, held).otherwise(F.lit(0.0)))

    near = scored.join(F.broadcast(known), F.col("family") == F.col("of")).withColumn("similarity", F.array_max(F.transform("known", like)))  # one row a family
    found = near.where(F.col("similarity") >= similarity)
    best = found.groupBy("doc_id", "paragraph", "part", "family").agg(F.max(F.struct("score", "similarity", "body")).alias("best"))  # of a sentence's windows
    return best.select("doc_id", "paragraph", "part", "family", "best.score", "best.similarity", "best.body")
