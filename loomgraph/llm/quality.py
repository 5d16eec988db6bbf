"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text is a bag of terms that say how it is written: shapes of its words (case, length, first and last
characters, symbols and digits), hashed words, and graded shares of the whole text (repeated words and word
runs, capitals, symbols, digits, line length). Weighted term counts of a bounded sample of labelled texts are
reduced by truncated SVD. The labelled vectors, ``MAX_LABELS`` of ``RANK`` numbers at most, are broadcast; each
document's cosines with all of them are exact products in blocks, and its nearest neighbours vote with
their similarity.

Labels come only from rows that the caller's ``fit_on`` condition keeps. Term weights and vectors are part of
what is fitted on the sample. Scoring is one pass without a shuffle.

Defined results: a null or empty text has no terms and gets the share of label 1 in the sample; without
labels every score is 0.5; an id with conflicting labels counts as its largest; repeated texts get equal scores; rows without an id are scored but
never learnt from; an empty table gives no rows. A column named like the score is replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import words

MAX_LABELS = 4000
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 12
BLOCK = 256
SHAPES, WORDS, GRADES = 640, 256, 128
TERMS = SHAPES + WORDS + GRADES

_KIND = np.zeros(256, np.int64)  # 0 symbol, 1 lower, 2 upper, 3 digit, 4 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4


def _grades(shares: np.ndarray, steps: int) -> np.ndarray:
    return np.minimum((np.sqrt(np.clip(shares, 0, 1)) * steps).astype(np.int64), steps - 1)


def term_counts(part: words.Words) -> np.ndarray:
    """Documents by terms: log counts of shapes and words, and grades of shares."""
    n, docs = len(part.starts), part.docs
    out = np.zeros((docs, TERMS), np.float32)
    if not n:
        return out
    doc, counts = part.doc_of_word(), np.diff(part.first)
    kind = _KIND[part.data]
    length = part.ends - part.starts
    per = lambda mask: np.add.reduceat(mask.astype(np.int64), part.starts)
    upper = per(kind == 2)
    digit = per(kind == 3)
    symbol = per((kind == 0) & (part.data > 32))
    last = part.data[part.ends - 1]
    shape = kind[part.starts]
    for values, size in ((np.where(_KIND[last] == 0, 5 + last % 11, _KIND[last]), 16), (np.minimum(np.log2(length).astype(np.int64), 4), 5), (np.minimum(upper, 2), 3), (np.minimum(symbol, 3), 4), (np.minimum(digit, 2), 3)):
        shape = shape * size + values
    shape = (words.mix(shape.astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64)
    word = SHAPES + (part.hashes % np.uint64(WORDS)).astype(np.int64)
    bag = np.bincount(np.concatenate([doc * TERMS + shape, doc * TERMS + word]), minlength=docs * TERMS).reshape(docs, TERMS)
    full = counts > 0
    out[:] = np.log1p(bag) / np.log1p(np.maximum(counts, 1))[:, None]
    total = lambda x: np.bincount(doc, x, docs)
    size = np.maximum(total(length), 1)
    runs, first = words.windows(part, 4)
    fresh = np.array([len(np.unique(part.hashes[a:b])) for a, b in zip(part.first[:-1], part.first[1:], strict=True)])
    fresh_runs = np.array([len(np.unique(runs[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)])
    same = np.zeros(n)
    same[1:] = (part.hashes[1:] == part.hashes[:-1]) & (doc[1:] == doc[:-1])
    breaks = np.concatenate([[0], np.cumsum(part.data == 10)])
    where = np.concatenate([part.starts[part.first[:-1][full]], [len(part.data)]])
    lines = np.zeros(docs)
    lines[full] = np.diff(breaks[where])
    shares = [
        total(upper) / size, total(symbol) / size, total(digit) / size, total(symbol > 1) / np.maximum(counts, 1), total(length == symbol) / np.maximum(counts, 1),
        1 - fresh / np.maximum(counts, 1), 1 - fresh_runs / np.maximum(np.diff(first), 1), total(same) / np.maximum(counts, 1), lines / np.maximum(counts, 1), np.minimum(size / np.maximum(counts, 1) / 20, 1),
        np.minimum(np.log2(np.maximum(counts, 1)) / 16, 1) ** 2,
    ]
    at = SHAPES + WORDS
    for share in shares:
        step = _grades(share, 10)
        for near, value in ((0, 1.0), (-1, 0.5), (1, 0.5)):
            place = np.clip(step + near, 0, 10)
            out[np.flatnonzero(full), at + place[full]] += value
        at += 11
    out[~full] = 0
    return out


@dataclass
class Model:
    """Term weights, the SVD's basis, and the labelled vectors with their labels."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    def project(self, terms: np.ndarray) -> np.ndarray:
        low = (terms * self.weights) @ self.basis
        norm = np.linalg.norm(low, axis=1, keepdims=True)
        return np.divide(low, norm, out=np.zeros_like(low), where=norm > 0)

    def score(self, terms: np.ndarray) -> np.ndarray:
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(terms), prior)
        if not len(self.labels):
            return out
        low = self.project(terms)
        k = min(self.neighbours, len(self.labels))
        for lo in range(0, len(low), BLOCK):
            cosine = low[lo : lo + BLOCK] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
            mass = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1)
            some = mass > 1e-12
            out[lo : lo + BLOCK][some] = vote[some] / mass[some]
        return np.clip(out, 0.0, 1.0)


def fit_terms(terms: np.ndarray, labels: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model:
    """Weights by how rare a term is in the sample, and the leading right singular vectors."""
    if not len(terms):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), neighbours)
    rare = np.log((1 + len(terms)) / (1 + (terms > 0).sum(axis=0))) + 0.1
    rare[SHAPES + WORDS :] *= 1.5
    weighted = terms * rare.astype(np.float32)
    _, vectors = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    basis = vectors[:, ::-1][:, : min(rank, len(terms))].astype(np.float32)
    model = Model(rare.astype(np.float32), basis, np.zeros((0, basis.shape[1]), np.float32), np.zeros(0), neighbours)
    model.vectors, model.labels = model.project(terms), labels.astype(np.float64)
    return model


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.chunks(batch.column("_text")):
            rows = [r.tobytes() for r in term_counts(part)]
            yield pa.RecordBatch.from_arrays([batch.column("_label").slice(part.lo, part.docs), pa.array(rows, pa.binary())], names=["label", "terms"])


def sample(documents: DataFrame, labels: DataFrame, label: str, fit_on: Column, limit: int, id: str, text: str) -> DataFrame:
    """(_text, _label) of at most ``limit`` labelled ids, the first by a hash; of texts that share an id the smallest."""
    order = F.xxhash64(F.col(id), F.lit(17))
    chosen = labels.filter(fit_on & F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(id).agg(F.max(label).alias("_label"))
    chosen = chosen.orderBy(order, id).limit(limit)  # the sample's documented bound, so it may be broadcast
    found = documents.select(id, F.col(text).alias("_text")).join(F.broadcast(chosen), id)
    once = found.groupBy(id).agg(F.min("_text").alias("_text"), F.max("_label").cast("int").alias("_label"))  # rows may repeat an id
    return once.select("_text", "_label")


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", fit_on: Column | None = None, max_labels: int = MAX_LABELS, id: str = "doc_id", text: str = "text", rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model:
    """A model of at most ``max_labels`` labelled texts; only their term vectors reach the driver."""
    chosen = sample(documents, labels, label, F.lit(True) if fit_on is None else fit_on, max_labels, id, text)
    rows = chosen.mapInArrow(_terms, "label int, terms binary").toPandas()
    rows = rows.sort_values(["terms", "label"]).reset_index(drop=True)
    terms = np.frombuffer(b"".join(rows["terms"]), np.float32).reshape(-1, TERMS)
    return fit_terms(terms, rows["label"].to_numpy(), rank, neighbours)


def score(documents: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Every row with its score, the estimated share of label 1 among texts like it."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for texts in batches:
            parts = [known.score(term_counts(part)) for part in words.chunks(pa.array(texts, pa.large_string()))]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return documents.withColumn(into, vote(F.coalesce(F.col(text), F.lit(""))))
