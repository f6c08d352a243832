"""Language of a text: multinomial naive Bayes over hashed n-grams of its letters.

Texts are UTF-8 bytes with A-Z lowered and every other ASCII character a blank; grams of two and
three bytes fall into `BUCKETS` buckets. A task counts them per language and sends its counts once,
in slices, so that what a reducer gets grows with the number of tasks and not with a language's
share of the rows. The log probabilities, one row per language, are broadcast; a batch is scored as
a sparse matrix, by gathers and one segmented sum per language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
SLICE = 1 << 11
MAX_CELLS = 1 << 26
CHUNK_BYTES = 1_000_000
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_TABLE = np.full(256, 32, dtype=np.uint32)
_TABLE[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_TABLE[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_TABLE[128:] = np.arange(128, 256)


def held_out(doc_id: Column) -> Column:
    """A fixed quarter of the ids, never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def chunks(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, a limited number of bytes at once; a long text is a chunk of its own."""
    start, held, size = 0, [], 0
    for text in texts:
        raw = text.encode("utf-8", "replace")
        if held and size + len(raw) > CHUNK_BYTES:
            yield start, held
            start, held, size = start + len(held), [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield start, held


def grams(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all grams of all texts, and where each text's grams begin (and the last ones end).

    Two blanks stand before and after each text, so that grams of neighbours do not mix.
    """
    joined = b"  ".join([b"", *raws, b""])
    data = _TABLE[np.frombuffer(joined, dtype=np.uint8)]
    pairs = data[:-2] << 8 | data[1:-1]
    triples = pairs << 8 | data[2:]
    buckets = np.empty(2 * len(pairs), dtype=np.uint32)
    for part, values in ((buckets[0::2], pairs), (buckets[1::2], triples | np.uint32(1 << 24))):
        np.multiply(values, np.uint32(2654435761), out=part)
        part >>= 17
    # Two positions (the blanks) in front of each text belong to it, and so do its own bytes.
    starts = np.cumsum([0] + [len(raw) + 2 for raw in raws])
    return buckets, 2 * starts


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Languages, log priors and log probabilities (languages x buckets), add-half smoothed.

    Rows without text or without language teach nothing.
    """
    source = docs.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    ).dropna()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                sums = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                seen[lang] = seen.get(lang, 0) + len(texts)
                for _, raws in chunks(texts.tolist()):
                    sums += np.bincount(grams(raws)[0], minlength=BUCKETS)
        for lang, sums in counts.items():
            yield pd.DataFrame({
                "lang": lang, "slice": range(BUCKETS // SLICE),
                "documents": [seen[lang]] + [0] * (BUCKETS // SLICE - 1),
                "counts": [part.tobytes() for part in sums.reshape(-1, SLICE)],
            })

    def add(key, parts: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros(SLICE, dtype=np.int64)
        for each in parts["counts"]:
            sums += np.frombuffer(each, dtype=np.int64)
        return pd.DataFrame({"lang": [key[0]], "slice": [key[1]],
                             "documents": [parts["documents"].sum()], "counts": [sums.tobytes()]})

    schema = "lang string, slice int, documents long, counts binary"
    most = MAX_CELLS // BUCKETS * (BUCKETS // SLICE)
    rows = source.mapInPandas(count, schema).groupBy("lang", "slice").applyInPandas(
        add, schema).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many languages for one model")
    languages = sorted({r["lang"] for r in rows})
    sums = np.zeros((len(languages), BUCKETS))
    documents = np.zeros(len(languages))
    for r in rows:
        at = languages.index(r["lang"])
        sums[at, r["slice"] * SLICE:(r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], dtype=np.int64)
        documents[at] += r["documents"]
    smooth = sums + 0.5
    return {
        "languages": languages,
        "prior": np.log((documents + 1) / max(1.0, (documents + 1).sum())),
        "log_prob": np.log(smooth / smooth.sum(axis=1, keepdims=True)),
    }


def score_texts(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability."""
    names = model["languages"]
    found = [UNKNOWN] * len(texts)
    scores = np.zeros(len(texts))
    able = [i for i, text in enumerate(texts) if text and names and _LETTER.search(text)]
    for start, raws in chunks([texts[i] for i in able]):
        buckets, bounds = grams(raws)
        logs = np.empty((len(names), len(raws)))
        for k in range(len(names)):
            logs[k] = model["prior"][k] + np.add.reduceat(model["log_prob"][k][buckets], bounds[:-1])
        best = logs.argmax(axis=0)
        posterior = 1.0 / np.exp(logs - logs.max(axis=0)).sum(axis=0)
        for j in range(len(raws)):
            found[able[start + j]] = names[best[j]]
            scores[able[start + j]] = posterior[j]
    return found, scores


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, one row per row of `docs`.

    `und` with score 0 where the text is missing or has no letter, or nothing was learned. Equal
    likelihoods go to the first language by code point. Only the text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            found, scores = score_texts(texts, shared.value)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": found, "score": scores})

    return source.mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")
