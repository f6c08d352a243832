"""The pipeline against its stages in plain Python."""

import hashlib
from collections import Counter

import numpy as np
import tiktoken

import corpus_pipeline as pipeline
from airtally.llm import bpe, mixing, quality
from tests.llm import cases

KEPT = ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select(KEPT).collect()]
    _, weights = quality.fit(docs)
    good = [r for r, s in zip(rows, quality.scores([r[1] for r in rows], weights)) if s >= quality.KEEP_FROM]
    assert 0.7 * len(rows) < len(good) < len(rows)
    last = {}
    for r in good:
        last[r[1]] = max(r, last.get(r[1], r), key=lambda x: x[0])
    unique = list(last.values())
    near = [r for r, c in zip(unique, cases.components([(r[0], r[1]) for r in unique], 5, 80, 100)) if r[0] == c[2]]
    assert len(near) < len(unique) < len(good)
    frame = spark.createDataFrame(near, docs.select(KEPT).schema)
    copies = Counter()
    for r in mixing.mix(frame).collect():
        copies[r.doc_id] = int(r.taken / r.size + 0.5) if r.size else 0
    coder = tiktoken.Encoding("t", pat_str=pipeline.public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks=bpe.load_ranks(pipeline.VOCABULARY))
    texts = {r[0]: r[1] for r in near}
    want = Counter()
    for doc_id, n in copies.items():
        ids = np.array(coder.encode_ordinary(texts[doc_id]), "<u4").tobytes()
        if n:
            want[doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                 hashlib.sha256(texts[doc_id].encode()).hexdigest()] = n
    got = pipeline.run(spark, sf)
    found = got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, found)) == want


def test_stages_keep_the_columns_of_documents(spark):
    rows = cases.odd_documents()
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0
    none = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, "").count() == 0


def test_names():
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None
