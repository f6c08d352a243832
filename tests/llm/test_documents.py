"""Operators on documents against plain Python versions, on documents with every odd case."""

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from airtally.llm import bpe, exact_dedup, jaccard, language, licenses, mixing, packing, quality, substrings
from airtally.llm.mixing import apportion, targets
from airtally.llm.tables import saved
from tests.llm import cases

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def rows():
    return cases.odd_documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, cases.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], cases.SCHEMA)


@pytest.fixture(scope="module")
def coder():
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(VOCABULARY), special_tokens={})


# Exact dedup


@pytest.mark.parametrize("candidates", [1, 1000])
def test_exact_dedup_marks(docs, rows, candidates):
    got = exact_dedup.mark_duplicates(docs, candidates=candidates).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter(
        (r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in got:
        ids = by_digest[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        if r.kept:
            kept[r.text_sha256] += 1
            assert r.doc_id == r.keep_id
    assert kept == Counter(by_digest.keys())


@pytest.mark.parametrize("candidates", [1, 1000])
def test_exact_dedup_keeps_columns(docs, rows, candidates):
    out = exact_dedup.without_duplicates(docs, candidates=candidates)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter(r.text or "" for r in got) == Counter({r[1] or "" for r in rows})
    assert all(tuple(r) in {tuple(x) for x in rows} for r in got)


def test_exact_dedup_of_many_copies(spark):
    frame = spark.range(3000).selectExpr(
        "id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('t', id) END AS text")
    winners = exact_dedup.verified_winners(
        frame.selectExpr("doc_id", "sha2(text, 256) AS text_sha256", "doc_id AS row_no"), 10, 1024)
    assert [(r.winner.doc_id, r.group_size) for r in winners.collect()] == [(2997, 1000)]
    assert exact_dedup.without_duplicates(frame).count() == 2001


# Licenses


def test_license_scan(docs, rows):
    rules = licenses.signature_rules()
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(docs).collect()}
    for doc_id, text in {(r[0], r[1]) for r in rows}:
        n, places = cases.phrase_places(text, licenses.BASE_PHRASES)
        r = got[doc_id, n]
        assert sorted((p.start, p.label) for p in r.places) == places
        assert sorted((d.start, d.stop, d.rule, d.label) for d in r.detections) == cases.detections(text, rules)


def test_license_texts(spark):
    rules = licenses.signature_rules()
    texts = [
        "Licensed under the Apache License, Version 2.0 (the License)", "SPDX-License-Identifier: GPL-2.0-only",
        "This work is licensed under the GNU General Public License version 3 or any later version.",
        "released UNDER THE MIT LICENSE under the mit license", "CC BY-NC cc by nc sa 4.0; CC-BY-NC-ND",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 license", "Copyright (c) 2020 x",
        "mozilla public license 2.0 and Boost Software License 1.0", "the mit of it", "CC0 1.0 Universal",
        "BSD 3-Clause License, 2-clause BSD license; placed in the public domain. All rights reserved",
        "éunder the mit license", "under the mit licenseé", "license", "under the mit license " * 300,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.scan(frame).collect()}
    brief = {r.doc_id: r for r in licenses.summarize(licenses.scan(frame)).collect()}
    for i, text in enumerate(texts):
        n, places = cases.phrase_places(text, licenses.BASE_PHRASES)
        assert found[i].n_words == n and sorted((p.start, p.label) for p in found[i].places) == places
        if i < 14:
            spans = cases.detections(text, rules)
            assert sorted((d.start, d.stop, d.rule, d.label) for d in found[i].detections) == spans
            labels = {x[3] for x in spans} | {p[1] for p in places}
            assert brief[i].labels == ",".join(sorted(labels))
        assert brief[i].n_base == len(places) and 0 <= brief[i].score <= 1
        assert (brief[i].first_word, brief[i].last_word) == (
            (places[0][0], places[-1][0]) if places else (None, None))
    assert brief[0].labels == "apache-2" and brief[1].labels == "gpl-2" and brief[2].labels == "gpl-3"
    assert brief[14].n_base == 300 and brief[8].labels == ""


def license_detections(spark, texts, rules):
    """Checks that the scan of the texts finds what the unfiltered rules find."""
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.detections for r in licenses.scan(frame).collect()}
    lost = [text for i, text in enumerate(texts) if sorted(
        (d.start, d.stop, d.rule, d.label) for d in found[i]) != cases.detections(text, rules)]
    assert not lost, (len(lost), lost[:10])


def test_license_keywords_lose_nothing(spark):
    rules = licenses.signature_rules()
    for rule in rules:
        for text in cases.all_matching_texts(rule.pattern):
            assert re.fullmatch(rule.pattern, text) and not set(text.split()).isdisjoint(rule.keywords), (rule, text)
    texts = [" ".join([*rule.required, text]) for rule in rules for text in cases.matching_texts(rule.pattern)]
    texts += ["licensed under the Expat license", "MIT No Attribution License", "FreeBSD License",
              "distributed under this licence", "SPDX-License-Identifier: GPLv2",
              "SPDX-License-Identifier: LGPLv3", "SPDX-License-Identifier: AGPLv3"]
    license_detections(spark, ["according to " + text for text in texts], rules)


def test_license_gate_loses_nothing(spark):
    rules = licenses.signature_rules()
    for rule in rules:
        assert rule.stems
        for text in cases.all_matching_texts(rule.pattern):
            text = " ".join([*rule.required, text])
            assert all(any(stem in text for stem in group) for group in rule.stems), (rule, text)
    texts = [" ".join([*rule.required, cases.matching_texts(rule.pattern)[0]]) for rule in rules]
    texts += ["Released under MIT.", "Distributed under the BSD 3-Clause", "available under Apache 2.0",
              "published\nunder Mozilla Public 2.0", "All rights\nreserved", "ALL RIGHTS  RESERVED."]
    license_detections(spark, texts, rules)


MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
BSD_BODY = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer."""
BSD_3 = BSD_BODY + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission."""
GPL_HEADER = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any
later version."""
WORDS_OF_LICENSES = [
    (MIT_BODY, "mit"), (BSD_BODY, "bsd"), (BSD_3, "bsd,bsd-3-clause"), (GPL_HEADER, "gpl-2"),
    (GPL_HEADER.replace("GNU General", "GNU Lesser General").replace("version 2", "version 2.1"), "lgpl-2.1"),
    (GPL_HEADER.replace("GNU General", "GNU Affero General").replace("version 2", "version 3"), "agpl-3"),
    ("to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\"", "mit-0"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "zlib"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2,mit"),
    ("SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR GPL-2.0-or-later", "bsd-3-clause,gpl-2,mit"),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR ISC", "classpath-exception,gpl-2,isc"),
    ("SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", "apache-2,llvm-exception"),
    ("SPDX tags help. Take version 2 or mit gloves with you.", "mit"),
    ("Take 2 or mit gloves with you, and permission to use them is hereby granted by the author.", ""),
    ("The city redistributed permits without any warranty of fairness.", ""),
]


def test_wordings_and_expressions(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WORDS_OF_LICENSES)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.summarize(licenses.scan(frame)).collect()}
    assert [got[i].labels for i in range(len(got))] == [labels for _, labels in WORDS_OF_LICENSES]
    assert all((got[i].score > 0) == bool(labels) for i, (_, labels) in enumerate(WORDS_OF_LICENSES))


def test_every_wording_has_its_label(spark):
    texts = [(label, text) for label, _, wording in licenses.WORDINGS for text in cases.matching_texts(wording)]
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in licenses.summarize(licenses.scan(frame)).collect()}
    assert not [(texts[i], labels) for i, labels in got.items() if texts[i][0] not in labels]


def test_license_rules_of_a_caller(spark):
    own = [licenses.Rule(0, "x", (), "house rules apply", 0.5), licenses.Rule(1, "y", ("rules",), "rules", 0.5)]
    frame = spark.createDataFrame([(1, "House rules apply; other rules")], "doc_id long, text string")
    found = licenses.scan(frame, rules=own).first().detections
    assert [(d.start, d.stop, d.label) for d in found] == [(0, 3, "x"), (4, 5, "y")]


def test_phrase_that_overlaps_itself(spark):
    frame = spark.createDataFrame([(1, "a b a b a license")], "doc_id long, text string")
    got = licenses.scan(frame, phrases={"a b a": "x"}, rules=[]).first()
    assert [p.start for p in got.places] == [0, 2]
    got = licenses.scan(frame, phrases={"a b a": "x", "license": "y"}, rules=[]).first()
    assert [(p.start, p.label) for p in got.places] == [(0, "x"), (2, "x"), (5, "y")]


# Repeated strings


@pytest.mark.parametrize("length,gram,hot", [(200, 32, 10 ** 6), (40, 8, 10 ** 6), (60, 32, 2)])
def test_repeated_strings(docs, rows, length, gram, hot):
    got = substrings.without_repeats(docs, length=length, gram=gram, hot_anchors=hot, bucket_suffixes=200)
    want = cases.without_repeats([(r[0], r[1]) for r in rows], length)
    assert ordered(got.drop("kept").collect()) == ordered(want)
    assert any(w[2] for w in want)


def test_repeats_within_one_text(spark):
    texts = ["abcdefgh" * 40, "x" * 199, "y" * 200, "z" * 201, "".join(map(str, range(2000)))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substrings.without_repeats(frame).drop("kept").collect()
    assert ordered(got) == ordered(cases.without_repeats(list(enumerate(texts)), 200))


def test_multikey_sort():
    rnd = np.random.default_rng(1)
    words = rnd.integers(0, 3, (500, 4)).astype(np.uint64)
    order = substrings.multikey_sort(words)
    assert words[order].tolist() == sorted(words.tolist())


# Byte-level BPE


def test_bpe_round_trip(docs, rows, coder):
    got = bpe.encode(docs, VOCABULARY, PATTERN, round_trip=True).collect()
    assert len(got) == len(rows)
    want = {}
    for r in rows:
        want.setdefault((r[0], r[1] or ""), coder.encode_ordinary(r[1] or ""))
    texts = {(i, t) for i, t in want}
    for r in got:
        text = r.decoded.decode()
        assert (r.doc_id, text) in texts
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id, text] and r.n_tokens * 4 == len(r.ids)
    again = bpe.decode(bpe.encode(docs, VOCABULARY, PATTERN), VOCABULARY).collect()
    assert Counter((r.doc_id, r.decoded) for r in again) == Counter((r.doc_id, r.decoded) for r in got)


def test_bpe_merges_like_the_library(coder):
    ready = bpe.Merger(bpe.load_ranks(VOCABULARY), PATTERN)
    rnd = np.random.default_rng(4)
    texts = ["".join(rnd.choice(list("abé ×'sll ,.!\n日👍"), rnd.integers(0, 90))) for _ in range(800)]
    texts += ["a" * 3000, " " * 500 + "x", "ab" * 900, "日本" * 200, "it's we'll 'S <|endoftext|>"]
    assert [np.frombuffer(i, "<u4").tolist() for i in ready.encode(texts)] == [
        coder.encode_ordinary(t) for t in texts]
    for text in texts[:200]:
        raw = text.encode() or b"x"
        assert ready.merge_one(raw) == coder._encode_single_piece(raw)


# Jaccard join


@pytest.mark.parametrize("width,threshold,tokens", [
    (4, (85, 100), 10 ** 6), (4, (85, 100), 300), (5, (80, 100), 10 ** 6), (2, (60, 100), 400)])
def test_near_duplicates(docs, rows, width, threshold, tokens):
    got = jaccard.near_duplicates(docs, width=width, threshold=threshold, task_tokens=tokens)
    want = cases.components([(r[0], r[1]) for r in rows], width, *threshold)
    assert ordered(got.collect()) == ordered(want)


def test_near_duplicates_by_blocks(spark):
    rnd = np.random.default_rng(8)
    base = [str(w) for w in rnd.integers(0, 10 ** 6, 80)]
    rows = []
    for i in range(250):
        words = list(base)
        for at in rnd.integers(0, 80, rnd.integers(0, 5)):
            words[at] = f"w{rnd.integers(0, 10 ** 6)}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = cases.components(rows)
    for tokens in (700, 10 ** 6):
        assert ordered(jaccard.near_duplicates(frame, task_tokens=tokens).collect()) == ordered(want)
    assert 1 < len({w[2] for w in want}) < 250


def test_one_of_each_group_stays(docs, rows):
    out = jaccard.representatives(docs)
    assert out.columns == docs.columns
    kept = {(r[0]) for r in cases.components([(r[0], r[1]) for r in rows], 5, 80, 100)
            if r[0] is None or r[0] == r[2]}
    assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in rows if r[0] in kept)


def test_size_classes_cover_all_pairs():
    classes = jaccard.Classes()
    for a in range(1, 400):
        for b in range(a, 2 * a):
            if 100 * a >= 85 * b:
                band = classes.band(a)
                assert classes.band(b) in (band, band + 1)
                differ = 15 * (a + b) // 185
                assert differ <= classes.segments(band)[1]


# Language


def test_language_model_learns(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs.filter(~language.held_out(docs.doc_id)))
    found = language.predict(docs, model).join(
        docs.select("doc_id", "lang", language.held_out(docs.doc_id).alias("test")), "doc_id")
    held = found.filter("test AND lang IS NOT NULL AND lang_pred <> 'und'").toPandas()
    assert len(held) > 150 and (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert found.filter("score < 0 OR score > 1").count() == 0


def test_language_counts_like_plain_python():
    texts = ["Ab c", "", "日x", "a" * 40]
    buckets, bounds = language.grams([t.encode() for t in texts])
    assert len(bounds) == 5 and bounds[-1] == len(buckets)
    for i, t in enumerate(texts):
        alone, ends = language.grams([t.encode()])
        assert buckets[bounds[i]:bounds[i + 1]].tolist() == alone[:ends[1]].tolist()


def test_language_odd_documents(docs, rows, none):
    model = language.learn(docs)
    got = language.predict(docs, model).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"en", "de", "und"}
    letterless = Counter(r[0] for r in rows if not any(c.isalpha() for c in r[1] or ""))
    assert Counter(r.doc_id for r in got if r.lang_pred == "und") == letterless
    empty = language.learn(none)
    assert {r.lang_pred for r in language.predict(docs, empty).collect()} == {"und"}


def test_language_like_plain_python(docs, rows):
    taught = [(t, lang) for _, t, lang, *_ in rows if t is not None and lang is not None]
    model = language.learn(docs)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.lang_pred, r.score) for r in language.predict(docs, model).collect())
    found = cases.naive_bayes(taught, [r[1] for r in rows], language.BUCKETS)
    wanted = sorted((r[0] is None, r[0] or 0, *each) for r, each in zip(rows, found))
    assert [x[:3] for x in got] == [x[:3] for x in wanted]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in wanted], abs=1e-6)


# Packing


def test_packing_is_lossless(docs, rows, coder):
    packed = packing.pack(docs, VOCABULARY, PATTERN, row_tokens=64, shard_bytes=5000).toPandas()
    ids, places = packing.matrices(packed, 64, "<u2")
    pieces = {}
    for line, spot, r in zip(ids, places, packed.itertuples()):
        cuts = list(r.cu_seqlens)
        assert cuts[0] == 0 and cuts[-1] == r.n_tokens <= 64 and (line[r.n_tokens:] == 50256).all()
        assert (spot[r.n_tokens:] == 0).all()
        for doc, start, a, b in zip(r.doc_ids, r.starts, cuts, cuts[1:]):
            assert spot[a:b].tolist() == list(range(b - a)) and (b - a == 64 or start % 64 == 0)
            pieces.setdefault((doc, start), []).append(line[a:b].tolist())
    want = {}
    for r in rows:
        tokens = coder.encode_ordinary(r[1] or "")
        for at in range(0, len(tokens), 64):
            want.setdefault((r[0], at), []).append(tokens[at:at + 64])
    missing = {k: v for k, v in want.items() if k[0] is not None}
    for key, parts in missing.items():
        assert sorted(pieces[key]) == sorted(parts)
    assert sum(packed.n_tokens) == sum(len(p) for parts in want.values() for p in parts)


def test_best_fit_is_best_fit():
    rnd = np.random.default_rng(2)
    for _ in range(150):
        room = int(rnd.integers(1, 60))
        lengths = rnd.integers(1, room + 1, rnd.integers(0, 60)).tolist()
        left = []
        for n in sorted(lengths, reverse=True):
            fits = [x for x in left if x >= n]
            if fits:
                left[left.index(min(fits))] -= n
            else:
                left.append(room - n)
        rows = packing.best_fit(lengths, room)
        assert sorted(sum(rows, [])) == list(range(len(lengths)))
        assert sorted(room - sum(lengths[i] for i in r) for r in rows) == sorted(left)


def test_packing_writes_files(docs, tmp_path):
    packed = packing.pack(docs, VOCABULARY, PATTERN, row_tokens=128)
    packing.write(packed, str(tmp_path / "packed"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "packed")).count() == packed.count()


# Mixing


def test_mix(docs, rows):
    options = {"block_words": 4, "shard_words": 500}
    got = mixing.mix(docs, **options).drop("row").collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    target_of = {s: (sizes[s], float(t)) for s, t in zip(order, want)}
    source_of = {(r[0], len((r[1] or "").split())): r[3] for r in rows}
    taken = Counter()
    for r in got:
        source = source_of[r.doc_id, r.size]
        assert (r.source_size, r.target) == target_of[source] and 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    assert len(got) == len(rows) and sum(t for _, t in target_of.values()) == 1.5 * sum(sizes.values())
    for source, (size, target) in target_of.items():
        assert abs(taken[source] - target) <= 8 and taken[source] <= 2 * size
    again = mixing.mix(docs.repartition(7), **options).drop("row").collect()
    assert ordered(got) == ordered(again)
    repeated = mixing.mixed_rows(docs, **options)
    assert repeated.columns == docs.columns
    assert repeated.count() == sum(int(r.taken / r.size + 0.5) for r in got if r.size)


def test_apportionment_is_by_highest_quotient():
    rnd = np.random.default_rng(6)
    for _ in range(300):
        n = int(rnd.integers(1, 8))
        shares = [float(rnd.choice([0, 1, 2, 3, rnd.random() * 50, rnd.integers(0, 900)])) for _ in range(n)]
        most = rnd.integers(0, 60, n).tolist()
        seats = int(rnd.integers(0, 150))
        given = [0] * n
        for _ in range(min(seats, sum(m for s, m in zip(shares, most) if s > 0))):
            best = max((i for i in range(n) if given[i] < most[i] and shares[i] > 0),
                       key=lambda i: (shares[i] / (2 * given[i] + 1), -i))
            given[best] += 1
        assert apportion(shares, seats, most) == given


def test_targets_stop_at_twice_the_source():
    assert [float(t) for t in targets([100, 10, 1000], [5, 2, 1])] == [200, 20, 1445]
    assert targets([], []) == [] and targets([0, 0], [5, 2]) == [0, 0]


# Quality


def test_quality_against_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model, weights = quality.fit(docs, sample_rows=1500)
    found = quality.assess(docs, model, weights).join(labels, "doc_id").toPandas()
    assert (found.kept == (found.quality == 1)).mean() > 0.98
    assert found[found.quality == 1].kept.mean() > 0.99
    assert (model.accuracy > 0.5).all() and 0.7 < model.share < 0.98


def test_quality_keeps_a_clean_corpus():
    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").merge(
        pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    texts = docs[docs.quality == 1].text.head(2500).tolist()
    # Texts too short for most heuristics, and of a language whose function words are not known.
    texts += [f"Dom {i} stoi przy lesie" for i in range(60)]
    patterns = [quality.votes(t) for t in texts]
    good = quality.LabelModel(Counter(p for p in patterns if p.strip("0"))).posterior(patterns)
    weights = quality.train(np.stack([quality.features(t) for t in texts]), good)
    kept = quality.scores(texts, weights) >= quality.KEEP_FROM
    assert kept[good >= 0.9].all() and kept.mean() > 0.999


def test_quality_sample_is_of_distinct_texts(spark):
    few = [f"text number {i} of the sample" for i in range(600)]
    often = [t for t in few[:20] for _ in range(200)]
    copies = spark.createDataFrame([(t,) for t in few + often + [None, None]], "text string")
    samples = []
    for frame in (copies, copies.repartition(7), copies.distinct()):
        measured = quality.measure(frame.select(F.lit(1).alias("doc_id"), "text"))
        texts = Counter(r.votes for r in measured.filter("length(vector) > 0").dropDuplicates(["hash"]).collect())
        samples.append([tuple(r) for r in quality._sampled(measured, texts, 150).collect()])
        assert sum(r[3] for r in samples[-1]) == pytest.approx(600, rel=0.2)
    assert samples[0] == samples[1] == samples[2] and 100 < len(samples[0]) == len(set(samples[0])) <= 225
    weights = [quality.fit(frame, sample_rows=150)[1] for frame in (copies, copies.repartition(7))]
    assert (weights[0] == weights[1]).all()


def test_quality_odd_documents(docs, rows):
    model, weights = quality.fit(docs)
    got = quality.assess(docs, model, weights).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    blank = [r for r in got if r.votes == "0" * len(quality.HEURISTICS) and r.score == 0]
    assert len(blank) >= 6 and not any(r.kept for r in blank)
    out = quality.accepted(docs, weights)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_quality_like_plain_python(docs, rows):
    """Every number of the model and of the scorer, on a table that the sample takes as a whole."""
    model, weights = quality.fit(docs)
    texts = [r[1] for r in rows]
    share, accuracy = cases.label_model([quality.votes(t) for t in texts if t and t.split()])
    assert model.share == pytest.approx(share, abs=1e-6)
    assert model.accuracy.tolist() == pytest.approx(accuracy, abs=1e-6)
    plain = cases.scorer(sorted({t for t in texts if t and t.split()}), quality.votes, share, accuracy, 12)
    got = quality.assess(docs, model, weights).collect()
    wanted = {t: cases.chance_of_good(quality.votes(t), share, accuracy) for t in texts}
    by_id = {r[0]: r[1] for r in rows}
    assert all(r.posterior == pytest.approx(wanted[by_id[r.doc_id]], abs=1e-6)
               for r in got if r.doc_id is not None)
    measured = quality.measure(docs).filter("length(vector) > 0").dropDuplicates(["hash"]).orderBy("hash").collect()
    inputs = np.zeros((len(measured), quality.BUCKETS), np.float32)
    for i, r in enumerate(measured):
        at, values = quality._parts(r.vector)
        inputs[i, at] = values
    few = quality.train(inputs, model.posterior([r.votes for r in measured]), rounds=12)
    found = quality.scores(list(plain), few)
    assert found.tolist() == pytest.approx(list(plain.values()), abs=2e-3)


def test_quality_rare_patterns_are_in_the_sample(spark):
    """Six programs among thousands of documents: the scorer learns of them what their votes say."""
    code = [(-1 - i, "\n".join(f"x{i}[{k}] += {{a{k}: (b_{k} << {k}) | ~c{k}}};" for k in range(9)))
            for i in range(6)]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    measured = saved(quality.measure(docs.union(spark.createDataFrame(code, docs.schema))), "test-quality")
    kinds = {r.votes: r.n for r in measured.filter("length(vector) > 0").groupBy("votes").agg(
        F.count_distinct("hash").alias("n")).collect()}
    drawn = quality._sampled(measured, kinds, 1500).collect()
    assert 1400 < len(drawn) <= 2250
    rare = quality.votes(code[0][1])
    assert sum(r.votes == rare for r in drawn) == kinds[rare] == 6
    assert sum(r.stands_for for r in drawn) == pytest.approx(sum(kinds.values()), rel=0.15)
    model, weights = quality.fit_measured(measured, 1500)
    assert (model.posterior([rare]) < 0.01).all()
    assert (quality.scores([t for _, t in code], weights) < quality.KEEP_FROM).all()


# Empty tables


def test_empty_tables(none):
    model, weights = quality.fit(none)
    frames = [
        quality.assess(none, model, weights), quality.accepted(none, weights),
        exact_dedup.mark_duplicates(none), exact_dedup.without_duplicates(none),
        licenses.summarize(licenses.scan(none)), substrings.without_repeats(none),
        bpe.encode(none, VOCABULARY, PATTERN), jaccard.near_duplicates(none), jaccard.representatives(none),
        packing.pack(none, VOCABULARY, PATTERN), mixing.mix(none), mixing.mixed_rows(none),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


# Small sources, vague ids


@pytest.mark.parametrize("sizes", [[3] * 200, list(range(1, 41)), [1, 5000, 7, 2, 900, 14]])
def test_mix_meets_the_targets_of_small_sources(spark, sizes):
    rows = [(i, " ".join(["w"] * size), "en", f"s{i:03d}", 1, *cases.EXTRA) for i, size in enumerate(sizes)]
    mixed = mixing.mix(spark.createDataFrame(rows, cases.SCHEMA)).collect()
    wanted = targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    for r in mixed:
        target = float(wanted[r.doc_id])
        assert r.target == pytest.approx(target) and r.taken <= 2 * r.size
        assert abs(r.taken - target) <= max(1, target / 32)
    assert abs(sum(r.taken for r in mixed) - 1.5 * sum(sizes)) <= 1 + sum(sizes) / 64


def test_quotas_of_many_shards_go_through_batches(spark, docs, monkeypatch):
    whole = {r.source: r.taken for r in mixing.mix(docs).withColumn("source", F.col("row.source")).groupBy(
        "source").agg(F.sum("taken").alias("taken")).collect()}
    monkeypatch.setattr(mixing, "SHARDS_AT_ONCE", 2)
    many = mixing.mix(docs, shard_words=60, shard_documents=3).withColumn("source", F.col("row.source"))
    for r in many.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, abs=max(2, r.target / 10)) and whole[r.source] > 0


def test_jaccard_links_through_texts_without_id_and_of_shared_ids(spark):
    words = [f"w{i}" for i in range(60)]

    def text(*changed):
        return " ".join("x" + w if i in changed else w for i, w in enumerate(words))

    rows = [(1, text()), (None, text(20)), (2, text(20, 40)), (7, "one two three four five"), (7, text(20, 40, 58)),
            (None, text(20)), (9, "quite another text of its own")]
    docs = spark.createDataFrame([(*r, None, None, None, *cases.EXTRA) for r in rows], cases.SCHEMA).repartition(2)
    got = jaccard.near_duplicates(docs, width=4, threshold=(85, 100)).collect()
    found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in got)
    assert found == Counter([(1, 57, 1), (None, 57, 1), (None, 57, 1), (2, 57, 1), (7, 57, 1), (7, 2, 7), (9, 3, 9)])
