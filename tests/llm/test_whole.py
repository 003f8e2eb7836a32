"""Whole operators and the pipeline against plain brute force, and every operator on awkward tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opplens.llm import chat, decontaminate, licences, media, mixing, near, pii, repeats, tokens, toxicity
from opplens.llm.queries import fold_of, toxicity_model, vocabulary

DATA = "/root/testdata/sf0.01"


def best_segments(weights, lo=0):
    """All maximal scoring segments by their definition: the best one, then those to its left and to its right."""
    sums = np.concatenate([[0], np.cumsum(weights)])
    best, at = 0.0, None
    for i in range(len(weights)):
        for j in range(i + 1, len(weights) + 1):
            if sums[j] - sums[i] > best + 1e-12:
                best, at = sums[j] - sums[i], (i, j)
    if at is None:
        return []
    i, j = at
    return [*best_segments(weights[:i], lo), (lo + i, lo + j, best), *best_segments(weights[j:], lo + j)]


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 30))
        listed = sorted(rng.choice(n, int(rng.integers(0, n + 1)), replace=False).tolist())
        scores = [(i, float(rng.normal(0.3, 1))) for i in listed]
        weights = np.full(n, -0.37)
        for i, s in scores:
            weights[i] = s
        got = toxicity.segments(scores, n, -0.37)
        assert [x[:2] for x in got] == [x[:2] for x in best_segments(weights)]
        assert np.allclose([x[2] for x in got], [x[2] for x in best_segments(weights)])
    long = [(2 * i, 1.0) for i in range(50_000)]  # isolated words: the scan stays linear
    assert len(toxicity.segments(long, 100_000, -2.0)) == 50_000


def test_toxicity_words_and_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity_model(docs, labels)
    rows = docs.join(labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").select("text", "toxic", (fold_of() == 1).alias("held")).collect()
    kinds = [Counter(), Counter()]
    for r in rows:
        if not r.held:
            found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
            kinds[int(r.toxic != 0)].update(set(found))
    n = [sum(k.values()) for k in kinds]
    want = {}
    for w in kinds[0] | kinds[1]:
        c, t = kinds[0][w], kinds[1][w]
        a, total = 0.1 * (c + t), 0.1 * sum(n)
        odds = math.log((t + a) / (n[1] + total - t - a)) - math.log((c + a) / (n[0] + total - c - a))
        if odds / math.sqrt(1 / (t + a) + 1 / (c + a)) >= 3:
            want[w] = odds
    assert set(model.words) == set(want)
    assert np.allclose(sorted(model.weights), sorted(want.values()))
    scored = toxicity.score(docs.where(fold_of() == 1), model).join(labels, "doc_id").where("toxic is not null").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in scored)
    assert hit >= 0.7 * sum(r.toxic for r in scored) and hit >= 0.9 * sum(r.predicted for r in scored)


#: Headers as files have them: wrapped, with comment marks, with wordings around the notice.
HEADERS = {
    "mit": "/*\n * Permission is hereby granted, free of charge, to any\n * person obtaining a copy of this software and associated\n * documentation files (the Software), to deal in the Software\n * without restriction.\n */",
    "bsd": "# Redistribution and use in source and binary forms, with or\n# without modification, are permitted provided that the\n# following conditions are met:\n# 1. Redistributions of source code must retain the notice.",
    "apache-2.0": "// Licensed under the Apache License, Version 2.0 (the License);\n// you may not use this file except in compliance with the\n// License. You may obtain a copy of the License online.",
    "gpl-3": "This program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General Public\nLicense as published by the Free Software Foundation, either\nversion 3 of the License, or any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0. If a copy was not distributed, get one.",
    "cc-by-sa": "The text of this work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.",
}
UNLIKE = [
    "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense, version 2.1.",
    "Licensed under the GNU Affero General Public License, version 3.",
    "He lost his driving license in the city and had to walk.\nThe office was closed.",
    "All rights and all lefts of the road are open, without written signs.",
    "Public software in source form is subject to review by the office.",
]


def test_licences_wrapped_and_unlike(spark):
    rows = [(f, f"Some words before.\n\n{t}\n\nand words after it") for f, t in HEADERS.items()] + [("", t) for t in UNLIKE]
    docs = spark.createDataFrame(rows, "want string, text string")
    corpus = spark.read.parquet(f"{DATA}/documents.parquet").select("text")
    got = [(r.want, [x.family for x in r.licences]) for r in licences.scan(docs, licences.train(corpus)).collect()]
    right = sum(found == [want] for want, found in got if want)
    wrong = sum(bool(found) for want, found in got if not want) + sum(bool(set(found) - {want}) for want, found in got if want)
    assert right >= 0.8 * len(HEADERS) and wrong == 0, got


def brute_terms(texts, reach=80, disclosure=0.9):
    """(text, term) that disclose, by counting over distinct texts."""
    spans, words = {}, {}
    for t in set(texts):
        base = []
        for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),):
            base += [(m.start(), m.end(), f"{kind}:{m[0].lower()}") for m in re.finditer(pattern, t)]
        spans[t] = base
        blank = t
        for a, b, _ in base:
            blank = blank[:a] + " " * (b - a) + blank[b:]
        words[t] = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_][^\W_]{2,}", blank)]
    n, n_e, n_te = len(spans), Counter(), Counter()
    n_t = Counter(w for t in spans for w in {m[0].lower() for m in re.finditer(r"[^\W\d_][^\W_]{2,}", t)})
    for t in spans:
        n_e.update({e for _, _, e in spans[t]})
        n_te.update({(e, w) for a, b, e in spans[t] for w, x, y in words[t] if x >= a - reach and y <= b + reach})
    told = {(e, w) for (e, w), c in n_te.items() if (pmi := math.log(n * c / (n_t[w] * n_e[e]))) > 0 and pmi >= disclosure * math.log(n / n_e[e])}
    return {t: sorted((x, y) for w, x, y in words[t] if any((e, w) in told for _, _, e in spans[t])) for t in spans}


def test_terms_against_counts(spark):
    rng = np.random.default_rng(4)
    common = ["".join(rng.choice(list("abcde"), 4)) for _ in range(40)]
    texts = []
    for i in range(120):
        body = list(rng.choice(common, 30))
        if i % 6 == 0:  # an entity of several texts, told by a name of its own
            body[5:5] = [f"Name{i % 4}x", f"Person{i % 4}@corp.example"]
            body += [f"name{i % 4}X"]
        if i % 40 == 7:
            body[3:3] = [f"Lone{i}", f"once{i}@corp.example"]
        texts.append(" ".join(body))
    texts += texts[:10]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = brute_terms(texts)
    found = pii.sanitise(docs).collect()
    for r in found:
        assert sorted((s.start, s.end) for s in r.spans if s.kind == "term") == want[r.text]
    planted = [(m.start(), m.end(), r) for r in found for m in re.finditer(r"(?i)\b(?:name\dx|lone\d+)\b", r.text) if "@" in r.text]
    hit = sum((a, b) in [(s.start, s.end) for s in r.spans] for a, b, r in planted)
    assert hit == len(planted) and sum(len(want[r.text]) for r in found) <= 1.5 * len(planted)


def test_linear_in_one_row(spark):
    """Many matches in one text, many turns in one conversation."""
    n = 20_000
    text = " ".join(f"user{i}@mail.example word{i}" for i in range(n))
    found = pii.sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert found.select(F.size("base")).first()[0] == n
    assert pii.redact(found).first().text == " ".join(f"[EMAIL] word{i}" for i in range(n))
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é<|"), "id").alias("text"))
    r = chat.read_chats(chat.format_chats(rows)).first()
    assert [t.text for t in r.turns] == [f"é<|{i}" for i in range(n)] and list(r.loss_texts) == [f"é<|{i}" for i in range(n) if i % 3]


CLASH = ["row", "key", "t", "spans", "base", "size", "copies", "target", "root", "id", "a.b", "N_Words", "licences", "h"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids, texts and sources, empty and repeated rows, ties, and columns with clashing names."""
    texts = [None, "", "one", "mail a@b.co and text", "mail a@b.co and text", "Released under the MIT License.", "x" * 2000, " ".join(["same words here"] * 300)]
    rows = [(None if i == 3 else i, t, None if i % 3 == 0 else f"s{i % 2}", *([f"v{i}"] * len(CLASH))) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([*rows, rows[1], rows[4]], schema)


def operators(spark):
    bench = spark.createDataFrame([("b", "mail a b co and text"), (None, "x"), ("n", None)], "item_id string, text string")
    labels = lambda docs: docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("toxic"))
    return {
        "decontaminate": lambda d: decontaminate.find_contamination(d, bench), "decontaminate blocks": lambda d: decontaminate.find_contamination(d, bench, n=2, broadcast_limit=100), "mix": lambda d: mixing.mix_sources(d, keep=d.columns),
        "pii": lambda d: pii.redact(pii.sanitise(d)), "tokens": lambda d: tokens.count_tokens(d, vocabulary()), "media": lambda d: media.read_media(media.store_media(d)), "licences": lambda d: licences.scan(d, licences.train(d)),
        "near": near.keep_one, "classes": near.classify, "repeats": repeats.remove_repeats, "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels(d))),
    }


@pytest.mark.parametrize("name", ["decontaminate", "decontaminate blocks", "mix", "pii", "tokens", "media", "licences", "near", "classes", "repeats", "toxicity"])
def test_awkward_tables(spark, awkward, name, tmp_path):
    run = operators(spark)[name]
    out = run(awkward)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    out.write.parquet(str(tmp_path / "out"))  # which refuses names that come twice
    back = spark.read.parquet(str(tmp_path / "out"))
    n = awkward.count()
    assert back.count() == (n if name != "near" else 6)  # null is empty; equal texts are one
    if "a.b" in back.columns and name != "near":
        assert sorted(r[0] for r in back.select("`a.b`").collect()) == sorted(r[0] for r in awkward.select("`a.b`").collect())
    empty = run(awkward.limit(0))
    assert empty.columns == out.columns and empty.count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage on what the last one kept, held against plain rules; and run() gives what the stages give."""
    import corpus_pipeline

    rng = np.random.default_rng(2)
    vocab = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(800)]
    prose = lambda n: [str(w) for w in rng.choice(vocab, n)]
    passage = prose(14)
    rows, toxic = [], []
    for i in range(240):
        body = prose(60)
        if i % 6 == 0:
            body[10:10] = ["vileword", "nastyword"]
        if i % 20 == 3:
            body[30:30] = passage
        if i % 20 == 5:
            body[20:20] = [f"person{i}@mail.example"]
        rows.append((i, " ".join(body), "en", f"s{i % 3}", len(" ".join(body))))
        toxic.append((i, 1, int(i % 6 == 0)))
    for i in range(240, 260):  # near copies: four words of 60 or more differ
        body = rows[(i - 240) * 7 + 1][1].split()
        body[0], body[-1] = "other", "ending"
        rows.append((i, " ".join(body), "en", "s1", 0))
    rows.append((260, rows[1][1], "en", "s1", 0))
    rows.append((261, None, None, None, None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b1", " ".join(passage))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        kept[name] = {r.doc_id: r.asDict() for r in docs.collect()}
    text = {r[0]: r[1] or "" for r in rows}
    words = {i: t.split() for i, t in text.items()}
    want = {i for i in text if "vileword" not in words[i]}
    assert set(kept["toxicity"]) == want
    order = sorted(want)
    seen, firsts = [], set()
    for i in order:  # planted copies are like one earlier document only
        like = [j for j in seen if words[i] and near.similarity_of(*(np.asarray([hash(w) & (2**63 - 1) for w in words[k]], np.uint64) for k in (i, j)), 0.8) is not None or text[i] == text[j]]
        seen.append(i)
        if not like:
            firsts.add(i)
    assert set(kept["near_dedup"]) == firsts
    joined = " ".join(passage)
    clean = {i for i in firsts if joined not in text[i] and not any(" ".join(passage[k : k + 10]) in text[i] for k in range(5))}
    assert set(kept["decontamination"]) == clean
    assert set(kept["pii"]) == clean and not any("@" in (r["text"] or "") for r in kept["pii"].values())
    for i, r in kept["pii"].items():
        if "@" not in text[i]:
            assert (r["text"] or "") == text[i]
    sizes = {i: len((r["text"] or "").split()) for i, r in kept["pii"].items()}
    taken = Counter()
    for i, r in kept["mixing"].items():
        assert 1 <= r["copies"] <= 3
        taken[r["source"]] += sizes[i] * r["copies"]
    for r in mixing.mix_sources(spark.read.parquet(f"{tmp_path}/out/pii"), keep=["source"]).select("source", "target").distinct().collect():
        assert abs(taken[r.source] - r.target) <= 75 or r.target == 0
    again = {r.doc_id: r.copies for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == {i: r["copies"] for i, r in kept["mixing"].items()}
