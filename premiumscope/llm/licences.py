"""Licence scans with DataFrame functions and Spark ML only.

Lines with a licence word are the paragraphs to judge; what has none holds none of the model's evidence. A
sparse logistic regression over hashed word uni- and bigrams names the family of each, one class standing for
text that is none. The probability needed is calibrated on held-back examples, and a prediction counts only if
the paragraph also resembles a template of that family.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from premiumscope.llm.common import documents_of

# How the licence families name themselves.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has dedicated all copyright to this work to the public domain.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
    ],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."],
}
UNKNOWN = "unknown"
OTHER = [
    "The driver must carry a valid license at all times.", "Her licence to trade was renewed by the council in spring.",
    "The office issues permission to fish in the lower river.", "Copyright law was debated in the parliament.",
    "All rights to the field were granted to the village.", "The warranty of the machine covers two years.",
    "They gave permission for the concert in the public garden.", "Public opinion on the new version was mixed.",
    "The Apache helicopter landed at noon.", "He studied at MIT before the war.", "The general spoke to the public.",
    "A licensed electrician repaired the wiring.", "Software was released in version two of the series.",
]
#: A line with one of these is judged.
WORDS = ("licen", "copyright", "warrant", "redistribut", "permission", "public domain", "creative commons", "apache", "gnu ", "mozilla", "cc by", "cc0")
FEATURES, PRECISION, LIKENESS = 4096, 0.99, 0.5
# Ordinary lines of the corpus the unknown class learns from, at most.
CORPUS_LINES = 500


def _tokens(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, line) of the lines to judge; whole texts are cut at line ends."""
    low = F.lower("text")
    held = docs.filter(_any_word(low))
    lines = held.select("doc_id", F.explode(F.split("text", r"[\r\n]+")).alias("line"))
    return lines.filter(_any_word(F.lower("line")))


def _any_word(low: Column) -> Column:
    found = F.contains(low, F.lit(WORDS[0]))
    for word in WORDS[1:]:
        found = found | F.contains(low, F.lit(word))
    return found


def _local(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(pa.table({"family": [a for a, _ in rows], "line": [b for _, b in rows]}))


def _examples(spark: SparkSession, corpus: DataFrame) -> DataFrame:
    """(family, words, held): templates, whole, with any one word left out and with words around them."""
    known = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    rows = _local(spark, known + [(UNKNOWN, text) for text in OTHER]).withColumn("words", _tokens(F.col("line")))
    plain = corpus.select(F.lit(UNKNOWN).alias("family"), "line", _tokens(F.col("line")).alias("words")).filter(F.size("words") > 0)
    rows = rows.union(plain)
    place = F.explode(F.sequence(F.lit(-1), F.least(F.size("words") - 1, F.lit(30)))).alias("place")
    drop = F.filter("words", lambda w, i: i != F.col("place"))
    varied = rows.select("family", "line", "words", place).withColumn("words", F.when(F.col("place") < 0, F.col("words")).otherwise(drop))
    wrapped = varied.withColumn("words", F.when(F.col("place") % 3 == 2, F.concat(F.array(F.lit("see"), F.lit("notice")), "words")).otherwise(F.col("words")))
    return wrapped.select("family", "words", (F.pmod(F.xxhash64("line", "place"), F.lit(4)) == 0).alias("held"))


@dataclass
class LicenceModel:
    stages: PipelineModel
    families: list[str]
    least: float

    def judged(self, lines: DataFrame) -> DataFrame:
        """``lines(line)`` with family and probability; unknown where neither model nor template agree."""
        found = self.stages.transform(lines.withColumn("words", _tokens(F.col("line"))))
        names = F.array(*[F.lit(n) for n in self.families])
        chosen = F.element_at(names, F.col("prediction").cast("int") + 1)
        sure = F.array_max(vector_to_array("probability"))
        like = F.lit(False)
        for family, texts in TEMPLATES.items():
            for text in texts:
                words = _tokens(F.lit(text))
                shared = F.size(F.array_intersect("words", words)) / F.size(F.array_distinct(words))
                like = like | ((chosen == family) & (shared >= LIKENESS))
        family = F.when((sure >= self.least) & like & (chosen != UNKNOWN), chosen).otherwise(UNKNOWN)
        kept = [c for c in lines.columns if c not in ("family", "probability")]
        return found.select(*kept, family.alias("family"), F.round(sure, 6).alias("probability"))


def fit_licences(docs: DataFrame) -> LicenceModel:
    """Fit on the templates and at most ``CORPUS_LINES`` ordinary lines: beginnings of the documents with the
    smallest hash of their id."""
    spark = docs.sparkSession
    first = (docs.filter("text IS NOT NULL").filter(~_any_word(F.lower("text")))
             .select(F.xxhash64("doc_id").alias("mark"), F.substring("text", 1, 200).alias("line"))
             .orderBy("mark", "line").limit(CORPUS_LINES).select("line"))
    examples = _examples(spark, first)
    families = [UNKNOWN, *sorted(TEMPLATES)]
    code = F.array_position(F.array(*[F.lit(n) for n in families]), F.col("family")) - 1
    examples = examples.withColumn("label", code.cast("double")).coalesce(2).cache()
    stages = Pipeline(stages=[
        NGram(n=2, inputCol="words", outputCol="pairs"),
        HashingTF(numFeatures=FEATURES, binary=True, inputCol="words", outputCol="one"),
        HashingTF(numFeatures=FEATURES, binary=True, inputCol="pairs", outputCol="two"),
        VectorAssembler(inputCols=["one", "two"], outputCol="features"),
        LogisticRegression(maxIter=25, regParam=0.001, elasticNetParam=0.5, family="multinomial"),
    ]).fit(examples.filter(~F.col("held")))
    checked = (stages.transform(examples.filter("held")).select("family", F.col("prediction").cast("int").alias("p"),
               F.array_max(vector_to_array("probability")).alias("sure")).collect())
    examples.unpersist()
    right, least = 0, 1.0
    # The bound parts licences from other text; between families with nearly the same words the template decides.
    named = sorted(((r["sure"], r["family"] != UNKNOWN) for r in checked if r["p"]), reverse=True)
    for n, (sure, ok) in enumerate(named, 1):
        right += ok
        if ok and right / n >= PRECISION:
            least = sure
    return LicenceModel(stages, families, least)


def licence_scan(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """One row per document and family found: doc_id, family, n_paragraphs, probability (the highest).

    Documents without a confirmed licence paragraph, null and empty texts have no row. Documents are told apart by
    doc_id: rows that repeat an id count together, null ids as one. Other columns are not looked at; an empty table
    gives an empty result.
    """
    texts = documents_of(docs, "doc_id", "text")
    model = model or fit_licences(texts)
    judged = model.judged(paragraphs(texts)).filter(F.col("family") != UNKNOWN)
    return judged.groupBy("doc_id", "family").agg(F.count("*").alias("n_paragraphs"), F.max("probability").alias("probability"))
