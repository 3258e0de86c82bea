import numpy as np
import pytest

import __spark_entry__ as entry
from epilode.llm import licenses as L

FOLDER = "/root/testdata/sf0.01"
KNOWN = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl", "Released under the MIT License.": "mit",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache", "All rights reserved.": "proprietary",
}


@pytest.fixture(scope="module")
def model(spark):
    return L.train(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_unseen_wordings(model):
    for line, family in {
        "Copyright 1999 A. Person. Licensed under the Apache License, Version 2.0": "apache", "released under the MIT license": "mit",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the FSF, either version 3": "gpl",
        "This library is licensed under the GNU Lesser General Public License, version 2.1": "lgpl",
    }.items():
        assert model.classify(line.encode())[0] == family, line
    for line in ("She has a driving license.", "rights and duties", "", "The MIT is a school.", "all is reserved", "the terms of the public", "2.0", "é"):
        assert model.classify(line.encode()) is None, line


def test_weights_are_sparse_and_calibrated(model):
    total = len(L._VOCABULARY) * len(model.families)
    assert sum(np.count_nonzero(w) for w in model.weights.values()) < 0.2 * total
    assert 0.5 <= model.threshold < 1 and 0.25 <= model.temperature <= 8


def test_quick_test_loses_no_line(spark, model):
    lines = [x.encode() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() for x in r.text.split("\n")]
    lines += [t.encode() for _, t in L.variations(20, seed=1)] + [b"", b"the the", b"license", b"\x01 MIT"]
    hopeful = set(model.hopeful(lines).tolist())
    wanted = {n for n, line in enumerate(lines) if model.classify(line)}
    assert wanted and wanted <= hopeful and len(hopeful) < len(lines)


def test_accuracy_on_held_out_variations(model):
    rows = L.variations(60, seed=99)
    got = [(model.classify(t.encode()) or (L.UNKNOWN,))[0] for _, t in rows]
    assert np.mean([g == f for g, (f, _) in zip(got, rows)]) > 0.93
    assert np.mean([g == L.UNKNOWN for g, (f, _) in zip(got, rows) if f == L.UNKNOWN]) > 0.95


def test_calibration():
    raw = np.array([[4.0, 0.0], [3.0, 0.0], [0.0, 4.0], [2.0, 0.0]])
    assert L.calibrate(raw, np.array([0, 0, 1, 1])) > 1
    assert L.calibrate(np.zeros((0, 2)), np.zeros(0, int)) == 1.0
    assert L.threshold_of({}, 0) == L.threshold_of({50: 3, 10: 2}, 5) == 0.5
    # One line of odds e^0.5 may reach it, three may not.
    assert L.threshold_of({90: 1, 50: 3}, 1) == pytest.approx(1 / (1 + np.exp(-0.51)))
    assert L.step_of(1.0) == 3600 and L.step_of(0.5) == 0


def test_threshold_over_the_corpus(spark, model, monkeypatch):
    # Cut notices: the classifier knows them, no template confirms them; and copies, which count once.
    cut = [" ".join(w for k, w in enumerate(t.split()) if k % 7 < 4) for _, t in L.variations(40, seed=5)]
    lines = cut + [f"line {n} of the text" for n in range(600)] + cut[:50] * 4
    texts = ["\n".join(lines[n::9]) for n in range(9)] + [None, ""]
    monkeypatch.setattr(L, "FALSE_ALARMS", 0.01)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    got = L.threshold(docs, model)
    odds = []
    for line in {x for t in texts if t is not None for x in t.split("\n")}:
        own = L.words(line.encode())
        pairs = L.pairs_of(own)
        if any(pairs & t for sets in L._PAIRS.values() for t in sets) and all(L.similarity(pairs, f) < L.CONFIRM for f in L.TEMPLATES):
            odds.append(max(p for f, p in zip(model.families, model.probabilities(own)) if f != L.UNKNOWN))
    allowed = int(0.01 * len({x for t in texts if t is not None for x in t.split("\n")}))
    assert sum(p >= 0.5 for p in odds) > allowed and got > 0.5
    assert sum(p >= got for p in odds) <= allowed < sum(p >= 1 / (1 + np.exp(0.01) * (1 / got - 1)) for p in odds)


def test_threshold_does_not_hang_on_the_draw(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [L.train(docs, sample=n).threshold for n in (100, 300)]
    assert abs(found[0] - found[1]) <= 0.05


def test_query_over_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = entry.queries()["op6_licences"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    found = 0
    for r in rows:
        lines = texts[r.doc_id].split("\n")
        want = {(n, KNOWN[x]) for n, x in enumerate(lines) if x in KNOWN}
        got = {(x.paragraph, x.family) for x in r.notices}
        assert want <= got
        assert all("icense" in lines[n] or "ights" in lines[n] or "LICENSE" in lines[n] for n, _ in got)
        assert r.n_notices == len(r.notices) and set(r.families.split(",")) - {""} == {f for _, f in got}
        found += len(want)
    assert found


def test_edge_rows(spark, docs_of, model):
    rows = [(None, "Released under the MIT License."), (1, None), (1, ""), (2, "\n\n x \nAll rights reserved."), (2, "\n\n x \nAll rights reserved."),
            (3, "word " * 200_000 + "\nLicensed under CC BY-NC 4.0.")]
    out = L.scan(docs_of(rows), model)
    got = sorted((r.doc_id or 0, r.licences.n_paragraphs, [(n.paragraph, n.family) for n in r.licences.notices]) for r in out.collect())
    assert got == [
        (0, 1, [(0, "mit")]), (1, 0, []), (1, 0, []), (2, 2, [(3, "proprietary")]), (2, 2, [(3, "proprietary")]), (3, 2, [(1, "cc-by-nc")]),
    ]
    assert L.scan(docs_of([]), model).count() == 0
    assert L.train(docs_of([])).classify(b"Released under the MIT License.")[0] == "mit"
    with pytest.raises(ValueError):
        L.scan(docs_of(rows), model, into="n")
