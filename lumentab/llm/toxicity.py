"""Toxicity by multiple-instance learning: noisy-or over sentence scores, learned from document labels.

A sentence is a bag of hashed words and word beginnings with a logistic score; a document is
toxic if any of its sentences is, so its probability is ``1 - prod(1 - p)``. Document labels
train the sentence weights, and the sentences that carry a document's score are located.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lumentab.llm import batches as B
from lumentab.session import ship_package

SENTENCE = re.compile(rb"[^.!?\n]+[.!?]*")
#: Bytes of a sentence for its words: A-Z lower-cased, punctuation as white space.
PLAIN = bytes(32 if chr(i) in ".,;:!?|\"'()[]{}<>/*_~`" else i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Hashed features; the weights are one array of so many numbers.
FEATURES = 1 << 18
#: Labelled documents of each class that are learned from, at most.
SAMPLE = 2000
BIAS = -6.0


def _sentences(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, list[list[bytes]]]:
    """Words of every sentence, sentences per text, and the sentences themselves."""
    cut = [SENTENCE.findall(t) or [b""] for t in texts]
    words = [s.translate(PLAIN).split() for sentences in cut for s in sentences]
    return words, np.fromiter(map(len, cut), np.int64, len(cut)), cut


def _coded(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words on one line, words per sentence, three features of each code.

    The features are the word and its first four and five bytes, hashed apart.
    """
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = list(chain.from_iterable(words))
    codes, unique = pd.factorize(flat)
    if not len(unique):
        return codes, counts, np.zeros((0, 3), np.int32)
    begin = [np.array(unique, dtype=f"S{n}").astype("S8").view(np.uint64) + np.uint64(n << 56) for n in (4, 5)]
    hashed = [pd.util.hash_array(unique, categorize=False), *map(B.mixed, begin)]
    return codes, counts, np.stack([(h % np.uint64(FEATURES)).astype(np.int32) for h in hashed], axis=1)


def _log_clean(z: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(z)), stable."""
    return -np.logaddexp(0.0, z)


def learn(ids: np.ndarray, per_sentence: np.ndarray, per_doc: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 120, rate: float = 0.15, lasso: float = 1.5e-4, least_docs: int = 3) -> tuple[np.ndarray, float]:
    """Feature weights and bias by gradient steps on the noisy-or likelihood of the documents.

    ``ids`` are the features of all sentences on one line. Features seen in fewer than
    ``least_docs`` documents keep the weight 0.
    """
    w, bias = np.zeros(FEATURES), BIAS
    if not len(labels) or labels.min() == labels.max():
        return w.astype(np.float32), bias
    doc_of_sentence = np.repeat(np.arange(len(per_doc)), per_doc)
    doc_of_id = np.repeat(doc_of_sentence, per_sentence)
    pair = np.unique(doc_of_id.astype(np.int64) * FEATURES + ids)
    seen = np.bincount(pair % FEATURES, minlength=FEATURES) >= least_docs
    keep = seen[ids]
    per_sentence = B.run_sums(keep, per_sentence).astype(np.int64)
    ids = ids[keep]
    sentence_of_id = np.repeat(np.arange(len(per_sentence)), per_sentence)
    m, v, mb, vb = np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0
    share = weights / weights.sum()
    for t in range(1, rounds + 1):
        z = B.run_sums(w[ids], per_sentence) + bias
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
        clean = B.run_sums(_log_clean(z), per_doc)
        toxic = -np.expm1(clean)
        factor = np.where(labels == 1, -np.exp(clean) / np.maximum(toxic, 1e-9), 1.0) * share
        dz = factor[doc_of_sentence] * p
        g = np.bincount(ids, weights=dz[sentence_of_id], minlength=FEATURES)
        gb = dz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * lasso / (np.sqrt(v / (1 - 0.99**t)) + 1e-6), 0.0)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    return w.astype(np.float32), float(bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights from at most ``sample`` labelled documents of each class, by a seeded order of ids.

    Rows whose ``crc32(doc_id) % 5`` is 0 are never learned from. Classes are weighted back to
    their share among all labelled rows. A document with several labels counts as toxic if one
    of them says so; of several texts under one id the smallest is taken.
    """
    spark = docs.sparkSession
    ship_package(spark)
    marked = (
        labels.filter("doc_id is not null and toxic in (0, 1)").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    totals = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit(5), "doc_id")
    picked = None
    for label in (0, 1):
        part = marked.filter(F.col("toxic") == label).orderBy(order, "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * sample short rows
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def extract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.chunks(parts):
            words, per_doc, _ = _sentences(B.raw_texts(part))
            codes, per_sentence, features = _coded(words)
            ids = features[codes]
            sentence = np.repeat(np.arange(len(words)), per_sentence)
            pair = np.unique((sentence[:, None] * FEATURES + ids).ravel()) if len(ids) else np.zeros(0, np.int64)
            n = np.bincount(pair // FEATURES, minlength=len(words))
            of_doc = B.run_sums(n, per_doc).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("toxic"), B.ragged((pair % FEATURES).astype(np.int32), of_doc, pa.int32()), B.ragged(n.astype(np.int32), per_doc, pa.int32())],
                names=["doc_id", "toxic", "ids", "counts"],
            )

    def train(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(parts), schema=FEATURE_ROWS).sort_by("doc_id").combine_chunks()
        weights, bias = np.zeros(FEATURES, np.float32), BIAS
        if got.num_rows:
            y = got.column("toxic").to_numpy()
            flat = lambda c: got.column(c).combine_chunks().flatten().to_numpy()
            per_doc = pc.list_value_length(got.column("counts")).to_numpy().astype(np.int64)
            back = {k: totals[k] / max(1, (y == k).sum()) for k in totals}
            weights, bias = learn(flat("ids"), flat("counts").astype(np.int64), per_doc, y, np.array([back[k] for k in y]))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([bias])], names=["weights", "bias"])

    # the bounded sample is learned from in one task; the driver only gets the weights
    rows = texts.mapInArrow(extract, "doc_id bigint, toxic int, ids array<int>, counts array<int>").repartition(1)
    model = rows.mapInArrow(train, "weights binary, bias double").first()
    return np.frombuffer(bytes(model["weights"]), np.float32), float(model["bias"])


FEATURE_ROWS = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
RESULT = "doc_id bigint, score double, n_sentences int, offending array<struct<sentence:int,score:double,text:string>>"


def score(docs: DataFrame, model: tuple[np.ndarray, float], at_least: float = 0.5, keep: list[str] = ()) -> DataFrame:
    """``doc_id, score, n_sentences, offending`` of every whole text.

    ``offending`` holds the sentences whose own score is ``at_least`` or more, numbered from 0.
    Columns named in ``keep`` pass through. Null and empty texts count as one empty sentence;
    repeated rows are scored alike; other columns are not read.
    """
    ship_package(docs.sparkSession)
    weights, bias = model
    keep = list(keep)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.chunks(parts):
            words, per_doc, cut = _sentences(B.raw_texts(part))
            codes, per_sentence, features = _coded(words)
            # a feature counts once in a sentence, as it did in training
            ids = features[codes]
            sentence = np.repeat(np.arange(len(words)), per_sentence)
            live = weights[ids]
            hot = np.flatnonzero(live.ravel())
            pair = np.unique(sentence[hot // 3] * FEATURES + ids.ravel()[hot]) if len(hot) else np.zeros(0, np.int64)
            z = np.bincount(pair // FEATURES, weights=weights[pair % FEATURES], minlength=len(words)) + bias
            total = -np.expm1(B.run_sums(_log_clean(z), per_doc))
            first = B.starts_of(per_doc)
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
            spans: list[list[dict]] = [[] for _ in cut]
            for s in np.flatnonzero(p >= at_least):
                d = int(np.searchsorted(first, s, side="right")) - 1
                spans[d].append({"sentence": int(s - first[d]), "score": float(p[s]), "text": cut[d][s - first[d]].decode("utf-8", "replace").strip()})
            spans_type = pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))
            arrays = [part.column("doc_id"), pa.array(np.clip(total, 0.0, 1.0)), pa.array(per_doc.astype(np.int32)), pa.array(spans, spans_type), *[part.column(c) for c in keep]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "n_sentences", "offending", *[f"keep_{c}" for c in keep]])

    types = dict(docs.dtypes)
    schema = RESULT + "".join(f", keep_{c} {types[c]}" for c in keep)
    read = ["doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")]]
    return docs.select(*read).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_sentences, offending`` of every document."""
    scored = score(docs, fit(docs, labels, sample))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending")


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with the columns of documents."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    scored = score(docs.select(*columns), fit(docs, labels, sample), keep=columns)
    return scored.filter("score < 0.5").select(*[F.col(f"keep_{c}").alias(c) for c in columns])
