"""Licence notices in documents: a trained paragraph classifier, confirmed by templates.

A paragraph (a line) is counted words, pairs and triples of words.  A multinomial
logistic regression with an L1 penalty, which leaves most of its weights zero, tells the
families of `TEMPLATES` and an unknown class apart.  It is trained here: on variations
of the templates, and, for the unknown class, on lines from a sample of the corpus.  A
held-out part of both calibrates it: a temperature makes its probabilities fit.  The
threshold comes from the whole corpus: of all its different lines that no template
confirms, at most a share of `FALSE_ALARMS` reaches it.

A prediction counts only if a template of the family confirms it, by the share of the
template's word pairs that the paragraph holds (or, for a fragment of a long notice,
the other way round).  A line that shares no pair with any template can't be confirmed,
so only the others are put to the classifier.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilode.llm.common import add_column, arrow_map
from epilode.llm.decontamination import words
from epilode.session import cut_lineage

#: Documents whose lines teach the unknown class, in expectation, and variations of each family.
SAMPLE = 300
VARIATIONS = 150
FALSE_ALARMS = 0.001
CONFIRM = 0.6
UNKNOWN = "unknown"
_OTHER = "#other"
_MOST_OTHER = 20
_GROUP = 1 << 21
# Steps of log odds in which the corpus counts its unconfirmed lines, and the largest odds a double tells from certainty.
_STEPS, _SURE = 100, 36.0

# Public wordings by which licences are declared, by family.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
_BEFORE = ["", "", "", "Copyright 2020 the authors.", "Copyright (c) Example Inc.", "Note:", "The code in this file is", "See also:", "(c) 2019"]
_AFTER = ["", "", "", "See the LICENSE file for details.", "All other terms apply.", "For more see the website.", "Contributions are welcome."]
_DECOYS = [
    "a driving license is required for the job", "the right to copy is reserved for members", "the public library is open in general",
    "free software and free beer for all", "version 3 of the plan was released under pressure", "all seats reserved for guests",
    "the mit campus is large", "apache helicopters were seen", "the terms of the contract", "this work is good", "permission is granted by the owner",
]


def grams(own: list[bytes]) -> list[bytes]:
    """Words, pairs and triples."""
    return [b" ".join(own[k : k + n]) for n in (1, 2, 3) for k in range(len(own) - n + 1)]


def pairs_of(own: list[bytes]) -> set[bytes]:
    """Word pairs; a single word is a pair of its own."""
    return {b" ".join(own[k : k + 2]) for k in range(max(1, len(own) - 1))} if own else set()


_PAIRS = {family: [pairs_of(words(t.encode())) for t in texts] for family, texts in TEMPLATES.items()}
_VOCABULARY = sorted({g for texts in TEMPLATES.values() for t in texts for g in grams(words(t.encode()))})


def similarity(own: set[bytes], family: str) -> float:
    """How far one of the family's templates and a paragraph's pairs cover each other."""
    best = 0.0
    for template in _PAIRS[family]:
        both = len(own & template)
        best = max(best, both / len(template), both / len(own) if len(own) >= 8 else 0.0)
    return best


def features(own: list[bytes], known: dict[bytes, int]) -> Counter:
    """Which of the templates' grams a paragraph holds, and how many words beside them."""
    found = Counter(dict.fromkeys((g for g in grams(own) if g in known), 1))
    other = min(_MOST_OTHER, sum(w not in known for w in own))
    if other:
        found[_OTHER.encode()] = other
    return found


def variations(per_family: int = VARIATIONS, seed: int = 7) -> list[tuple[str, str]]:
    """(family, text): templates with words around them, some lost, some cut short; and unknown decoys."""
    rng, out = random.Random(seed), []
    for family, texts in TEMPLATES.items():
        for n in range(per_family):
            own = texts[n % len(texts)].split(" ")
            if len(own) > 6:
                own = own[: max(5, round(len(own) * rng.choice((1, 1, 0.9, 0.8))))]
                own = [w for w in own if rng.random() > 0.03]
            out.append((family, " ".join([rng.choice(_BEFORE), *own, rng.choice(_AFTER)]).strip()))
    for n in range(per_family):
        out.append((UNKNOWN, " ".join(x for x in (rng.choice(_BEFORE), _DECOYS[n % len(_DECOYS)], rng.choice(_AFTER)) if x)))
    return out


class LicenceModel:
    """Weights by gram, biases, temperature and threshold."""

    def __init__(self, families: list[str], weights: dict[bytes, np.ndarray], bias: np.ndarray, temperature: float, threshold: float):
        self.families, self.weights, self.bias = families, weights, bias
        self.temperature, self.threshold = temperature, threshold
        self.known = {g: n for n, g in enumerate(_VOCABULARY)}
        # Words of the templates, and their pairs as numbers, for the quick test of many lines.
        single = sorted({w for g in _VOCABULARY for w in g.split(b" ")})
        self.numbers = {w: n for n, w in enumerate(single)} | {b"\x01": -2}
        self.base = len(single)
        self.codes = np.unique([
            self.numbers[p.split(b" ")[0]] * self.base + self.numbers[p.split(b" ")[-1]]
            for sets in _PAIRS.values() for s in sets for p in s if b" " in p
        ])

    def probabilities(self, own: list[bytes]) -> np.ndarray:
        logits = self.bias.copy()
        for gram, n in features(own, self.known).items():
            if gram in self.weights:
                logits += n * self.weights[gram]
        logits = logits / self.temperature
        exp = np.exp(logits - logits.max())
        return exp / exp.sum()

    def classify(self, line: bytes) -> tuple[str, float, float] | None:
        """(family, probability, similarity) of a confirmed notice."""
        own = words(line)
        if not own:
            return None
        p = self.probabilities(own)
        family = self.families[int(p.argmax())]
        if family == UNKNOWN or p.max() < self.threshold:
            return None
        close = similarity(pairs_of(own), family)
        return (family, round(float(p.max()), 6), round(close, 6)) if close >= CONFIRM else None

    def hopeful(self, lines: list[bytes]) -> np.ndarray:
        """Numbers of the lines that hold a pair of words of some template."""
        joined = b" \x01 ".join(line.translate(_TABLE) for line in lines) + b" \x01"
        parts = joined.split()
        ids = np.fromiter(map(self.numbers.get, parts, repeat(-1)), np.int64, len(parts))
        edges = np.flatnonzero(ids == -2)
        both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        code = ids[both] * self.base + ids[both + 1]
        where = np.searchsorted(self.codes, code)
        where[where == len(self.codes)] = 0
        return np.unique(np.searchsorted(edges, both[self.codes[where] == code]))

    def alarms(self, texts: list[bytes | None]) -> set[tuple[int, int]]:
        """(hash, step of the log odds) of lines that some family gets at least half of, but no template confirms."""
        out = set()
        lines = list({line for text in texts if text for line in text.split(b"\n")})
        for at in self.hopeful(lines).tolist() if lines else ():
            own = words(lines[at])
            odds = self.probabilities(own)[[f != UNKNOWN for f in self.families]].max()
            if odds < 0.5:
                continue
            pairs = pairs_of(own)
            if all(similarity(pairs, f) < CONFIRM for f in TEMPLATES):
                out.add((xxhash.xxh64_intdigest(lines[at]) - (1 << 63), step_of(odds)))
        return out

    def scan(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, str, float, float]]]]:
        """(number of paragraphs, [(paragraph, family, probability, similarity)]) of each text."""
        out, lines, owner, size = [], [], [], 0
        for n, text in enumerate(texts):
            own = (text or b"").split(b"\n")
            out.append((sum(1 for x in own if x.strip()), []))
            lines += own
            owner += [(n, k) for k in range(len(own))]
            size += len(text or b"")
            if size >= _GROUP or n + 1 == len(texts):
                for at in self.hopeful(lines).tolist():
                    found = self.classify(lines[at])
                    if found:
                        out[owner[at][0]][1].append((owner[at][1], *found))
                lines, owner, size = [], [], 0
        return out


_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> LicenceModel:
    """Fit and calibrate the classifier.

    About `sample` documents, chosen by a hash of id and text, give lines of the unknown
    class; lines that a template confirms are left out.  The threshold is set over all
    documents.  Null texts teach nothing, and an empty table gives a classifier of the
    templates' variations alone, with a threshold of one half.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    share = min(1.0, sample / max(1, texts.count()))
    chosen = texts.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < share * (1 << 30))
    lines = chosen.select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    positives = spark.createDataFrame(variations(), "family string, line string")
    rows = positives.unionByName(lines.select(F.lit(UNKNOWN).alias("family"), "line"))
    schema = pa.schema([("family", pa.string()), ("grams", pa.list_(pa.string())), ("part", pa.int64())])
    known = {g: n for n, g in enumerate(_VOCABULARY)}

    def count(batch: pa.RecordBatch) -> list[tuple]:
        out = []
        for family, line, part in zip(*(batch.column(k).to_pylist() for k in range(3))):
            own = words(line.encode())
            noisy = family == UNKNOWN and any(similarity(pairs_of(own), f) >= CONFIRM for f in TEMPLATES) if own else True
            if not noisy:
                out.append((family, [g.decode() for g in features(own, known).elements()], part))
        return out

    rows = rows.select("family", "line", F.pmod(F.xxhash64("line"), F.lit(5)))
    counted = cut_lineage(arrow_map(rows, schema, count), "grams")
    families = [*TEMPLATES, UNKNOWN]
    vocabulary = [g.decode() for g in _VOCABULARY] + [_OTHER]
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", minTF=0.0)
    data = vectors.transform(counted.withColumn("label", label.cast("double")))
    fitter = LogisticRegression(maxIter=80, regParam=0.001, elasticNetParam=1.0, family="multinomial", standardization=False)
    model = fitter.fit(data.where("part != 0"))
    # As many rows as the sample has lines at most; two numbers each.
    index = F.col("label").cast("int")
    held = model.transform(data.where("part = 0")).select(index.alias("label"), "rawPrediction").collect()
    raw = np.array([r.rawPrediction.toArray() for r in held]) if held else np.zeros((0, len(families)))
    temperature = calibrate(raw, np.array([r.label for r in held], np.int64))
    matrix = model.coefficientMatrix.toArray()
    weights = {g.encode(): matrix[:, n] for n, g in enumerate(vocabulary) if matrix[:, n].any()}
    fitted = LicenceModel(families, weights, model.interceptVector.toArray(), temperature, 0.5)
    fitted.threshold = threshold(texts.select("text"), fitted)
    return fitted


def step_of(probability: float) -> int:
    """Step of the log odds."""
    rest = 1.0 - probability
    return math.floor(_STEPS * (min(_SURE, math.log(probability / rest)) if rest > 0 else _SURE))


def threshold(texts: DataFrame, model: LicenceModel) -> float:
    """Least probability, at least one half, that at most `FALSE_ALARMS` of the unconfirmed lines reach.

    `texts` has one column of texts.  Equal lines count once; a line that shares no word
    pair with a template is never put to the classifier and reaches nothing.  All lines are counted by a
    sketch (2 % off); those that reach one half are counted exactly, by steps of their log
    odds, which are the rows that come to the driver: a few thousand at any size.
    """
    lines = texts.select(F.explode(F.split(F.col(texts.columns[0]), "\n")).alias("line"))
    total = lines.agg(F.approx_count_distinct(F.xxhash64("line"), 0.02).alias("n")).first()["n"]
    shared = texts.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("line", pa.int64()), ("step", pa.int64())])
    found = arrow_map(
        texts.select(F.col(texts.columns[0]).cast("binary")), schema, lambda batch: list(shared.value.alarms(batch.column(0).to_pylist()))
    )
    steps = found.groupBy("line").agg(F.max("step").alias("step")).groupBy("step").count().collect()
    return threshold_of({r["step"]: r["count"] for r in steps}, int(FALSE_ALARMS * total))


def threshold_of(counts: dict[int, int], allowed: int) -> float:
    """Probability at the end of the first step beyond which at most `allowed` lines lie."""
    above = 0
    for step in sorted(counts, reverse=True):
        above += counts[step]
        if above > allowed:
            return 1.0 / (1.0 + math.exp(-(step + 1) / _STEPS))
    return 0.5


def calibrate(raw: np.ndarray, labels: np.ndarray) -> float:
    """Temperature of least loss."""
    if not len(raw):
        return 1.0

    def soft(t: float) -> np.ndarray:
        exp = np.exp((raw - raw.max(axis=1, keepdims=True)) / t)
        return exp / exp.sum(axis=1, keepdims=True)

    steps = np.geomspace(0.25, 8, 41)
    loss = [-np.log(np.maximum(soft(t)[np.arange(len(raw)), labels], 1e-12)).mean() for t in steps]
    return float(steps[int(np.argmin(loss))])


def scan(docs: DataFrame, model: LicenceModel, into: str = "licences", text_col: str = "text") -> DataFrame:
    """`docs` and a struct column `into`: `n_paragraphs, notices` (paragraph, family, probability, similarity).

    Paragraphs are lines, numbered from 0; blank ones are not counted.  Null and empty
    texts have none.  Every row is judged alone, over its whole text, and keeps its
    columns; `into` must be a new name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ("paragraph", "family", "probability", "similarity")
    notice = pa.struct(list(zip(names, (pa.int64(), pa.string(), pa.float64(), pa.float64()))))
    kind = pa.struct([("n_paragraphs", pa.int64()), ("notices", pa.list_(notice))])

    def values(texts: list) -> list[dict]:
        return [
            {"n_paragraphs": n, "notices": [dict(zip(names, f)) for f in found]} for n, found in shared.value.scan(texts)
        ]

    return add_column(docs, docs.columns, into, kind, [F.col(text_col).cast("binary")], values)
