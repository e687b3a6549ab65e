"""Quality classifier on subword embeddings.

A document's features are its words, pairs of neighbouring words, character n-grams of words, and for each pair whether its
words are equal and whether the document held it before; each is hashed to one of a fixed number of vectors. The vectors are averaged and a softmax layer gives the label; both are trained by stochastic
gradient descent in numpy. Training uses a bounded sample of labelled rows and runs in one task; scoring covers every row
of every partition. As the output is linear in the average, scoring needs one number per feature: its vector's share of
the difference between the two outputs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawbook.llm.rows import free_name
from drawbook.llm.shingles import PLACES, RAW_LETTERS, chunks, mix, prefix_hash, span_hashes, word_spans
from drawbook.llm.workers import tidy_task
from drawbook.session import write_table

BUCKETS = 1 << 18
NGRAMS = (3, 4, 5)
LEFT, RIGHT = 0x3C, 0x3E


def bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (mix(hashes + PLACES[kind]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def pair_features(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of neighbouring words of one document, and the document: the pair itself, equality, and recurrence."""
    same = owner[1:] == owner[:-1]
    left, right, holder = words[:-1][same], words[1:][same], owner[1:][same]
    if not len(left):
        return np.zeros(0, np.int64), holder
    pair = left * PLACES[2] + right * PLACES[3]
    fresh = np.zeros(len(pair), bool)
    fresh[np.unique(mix(pair + holder.astype(np.uint64) * PLACES[5]), return_index=True)[1]] = True
    kinds = [bucket(pair, 1), bucket((left == right).astype(np.uint64), 6), bucket(fresh.astype(np.uint64), 7)]
    return np.concatenate(kinds), np.concatenate([holder] * 3)


def ngram_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the character n-grams of the words in angle brackets, and the word each belongs to."""
    lengths = ends - starts + 2
    first = np.concatenate([[0], np.cumsum(lengths)])
    word = np.repeat(np.arange(len(starts)), lengths)
    at = np.arange(first[-1]) - first[word]
    framed = np.full(first[-1], LEFT, np.uint8)
    inside = (at > 0) & (at < lengths[word] - 1)
    framed[inside] = data[(starts[word] + at - 1)[inside]]
    framed[first[1:] - 1] = RIGHT
    prefix = prefix_hash(framed, RAW_LETTERS)
    features, owners = [], []
    for n in NGRAMS:
        begin = np.flatnonzero(at + n <= lengths[word])
        features.append(bucket(span_hashes(prefix, begin, begin + n), 4))
        owners.append(word[begin])
    return np.concatenate(features), np.concatenate(owners)


@dataclass
class SubwordModel:
    """``vectors`` per bucket, ``output`` (dimension x 2), ``bias`` (2)."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def weights(self) -> np.ndarray:
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32)

    def intercept(self) -> float:
        return float(self.bias[1] - self.bias[0])


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of one text and the share of each."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, owner = word_spans(data, np.array([0, len(data)]))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    words = span_hashes(prefix_hash(data, RAW_LETTERS), starts, ends)
    every = np.concatenate([bucket(words, 0), pair_features(words, owner)[0], ngram_features(data, starts, ends)[0]])
    features, counts = np.unique(every, return_counts=True)
    return features, (counts / len(every)).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, prior: float, dim: int = 16, epochs: int = 5, least_steps: int = 20_000, rate: float = 0.5,
          seed: int = 11) -> SubwordModel:
    """Fits vectors and output in ``epochs`` passes, or in more where the rows are few, so as to make ``least_steps`` steps.

    The bias is the log odds of ``prior`` and stays: a text of unknown words gets about that.
    """
    random = np.random.default_rng(seed)
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    bias = np.array([0.0, math.log(prior / (1 - prior))], np.float32)
    model = SubwordModel(random.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32), np.zeros((dim, 2), np.float32), bias)
    rows = [document_features(t) for t in texts]
    epochs = max(epochs, -(-least_steps // max(1, len(rows))))
    steps, step = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in random.permutation(len(rows)):
            features, share = rows[k]
            lr = rate * (1 - step / steps)
            step += 1
            hidden = share @ model.vectors[features]
            z = hidden @ model.output + model.bias
            p = np.exp(z - z.max())
            gradient = p / p.sum()
            gradient[labels[k]] -= 1
            back = model.output @ gradient
            model.output -= lr * np.outer(hidden, gradient)
            model.vectors[features] -= lr * back
    return model


@dataclass
class FoldedModel:
    """One number per bucket, and the log odds of a text without features."""

    folded: np.ndarray
    log_odds: float

    def weights(self) -> np.ndarray:
        return self.folded

    def intercept(self) -> float:
        return self.log_odds


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, rows_per_label: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> FoldedModel:
    """Model, folded for scoring, from at most ``rows_per_label`` labelled documents of each label, none of them held out.

    The sample is the smallest hashes of the ids. Labels other than 0 and 1 and ids with both are left out. Of an id with
    several texts the first in code-point order is learned. Without any usable label the model gives every text 0.5.
    """
    spark = docs.sparkSession
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("key")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2")).where("y = y2").drop("y2")
    )
    named = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    present = known.join(named.select("key").distinct(), "key")
    present, _ = write_table(present, "labelled")
    totals = {r["y"]: r["n"] for r in present.groupBy("y").agg(F.count("*").alias("n")).collect()}
    sample = [present.where(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(rows_per_label) for y in (0, 1)]
    sample, _ = write_table(sample[0].union(sample[1]), "sample")
    texts = named.join(F.broadcast(sample), "key").groupBy("key", F.col("y").cast("int").alias("y")).agg(F.min("text").alias("text"))
    texts = texts.select("key", "text", "y").orderBy("key").coalesce(1)
    prior = totals.get(1, 0) / max(1, sum(totals.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        model = train([t or "" for t, _ in rows], np.array([y for _, y in rows], np.int64), prior)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().tobytes()], pa.binary()), pa.array([model.intercept()])], names=["weights", "intercept"])

    if not totals:
        return FoldedModel(np.zeros(BUCKETS, np.float32), 0.0)
    row = texts.mapInArrow(tidy_task(run), "weights binary, intercept double").first()
    return FoldedModel(np.frombuffer(row["weights"], np.float32), row["intercept"])


def chunk_scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, intercept: float) -> np.ndarray:
    documents = len(offsets) - 1
    total, number = np.zeros(documents), np.zeros(documents)
    starts, ends, owner = word_spans(data, offsets)
    if len(starts):
        words = span_hashes(prefix_hash(data, RAW_LETTERS), starts, ends)
        _, index, inverse = np.unique(words, return_index=True, return_inverse=True)
        grams, holder = ngram_features(data, starts[index], ends[index])
        per_word = np.bincount(holder, weights[grams], len(index)) + weights[bucket(words[index], 0)]
        size = np.bincount(holder, minlength=len(index)) + 1
        pairs, behind = pair_features(words, owner)
        total += np.bincount(owner, per_word[inverse], documents) + np.bincount(behind, weights[pairs], documents)
        number += np.bincount(owner, size[inverse], documents) + np.bincount(behind, minlength=documents)
    return 1 / (1 + np.exp(-(intercept + total / np.maximum(number, 1))))


def score(docs: DataFrame, model: SubwordModel | FoldedModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``: the probability of label 1, from the text alone.

    Null and empty texts have no features and get the model's prior. A column named ``score_col`` is replaced; other
    columns, repeated rows and nulls pass through. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    weights, intercept = spark.sparkContext.broadcast(model.weights()), model.intercept()
    names = [c for c in docs.columns if c.lower() != score_col.lower()]
    kept = docs.select(*names, F.col(text_col).cast("string").alias(free_name(docs, "__scored_text")))
    schema = docs.select(*names, F.lit(0.0).alias(score_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            parts = [chunk_scores(data, offsets, weights.value, intercept) for _, _, data, offsets in chunks(texts)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*names, score_col])

    return kept.mapInArrow(tidy_task(run), schema)
