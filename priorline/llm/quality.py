"""Text quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features are single words and pairs of neighbouring words of the whole text, hashed into a fixed number of cells; a
text's value in a cell is its count over the square root of all its features. The learner reads a bounded sample of
labelled texts once per pass, in a fixed shuffled order; scoring is a sparse dot product per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.llm.words import pairs, signed, word_runs
from priorline.session import stored


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled texts the model is fitted on at most (those with the smallest hash of their id)."""

    cells: int = 1 << 18
    sample: int = 12_000
    passes: int = 4
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.1


def held_out(doc_id: Column) -> Column:
    """Rows that are kept from learning: CRC-32 of the id as text leaves 1 by 3. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def features(column: pa.Array, cells: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first and last row, all cells row by row, and where each row's cells begin (and end)."""
    for first, last, words, rows in word_runs(column, lower=False):
        counts = np.diff(rows)
        both = pairs(words) if len(words) > 1 else words[:0]
        # A pair belongs to the row of its first word, unless that is the row's last word.
        owner = np.repeat(np.arange(len(counts)), counts)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        owners = np.concatenate([owner, owner[inside]])
        order = np.argsort(owners, kind="stable")
        cell = (np.concatenate([words, both[inside]]) % np.uint64(cells)).astype(np.int64)[order]
        yield first, last, cell, np.searchsorted(owners[order], np.arange(len(counts) + 1))


def learn(texts: pa.Array, labels: np.ndarray, s: Settings) -> np.ndarray:
    """Weights of all cells, the intercept last."""
    z, n = np.zeros(s.cells + 1), np.zeros(s.cells + 1)
    rows = []
    for first, _, cell, at in features(texts, s.cells):
        for k in range(len(at) - 1):
            index, count = np.unique(cell[at[k] : at[k + 1]], return_counts=True)
            scale = max(1.0, float(at[k + 1] - at[k])) ** 0.5
            rows.append((np.append(index, s.cells).astype(np.int32), count.astype(np.int32), scale, float(labels[first + k])))
    for _ in range(s.passes):
        for index, count, scale, label in rows:
            value = np.append(count / scale, 1.0)
            zi, ni = z[index], n[index]
            w = np.where(np.abs(zi) > s.l1, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha
            z[index] = zi + g - sigma * w
            n[index] = ni + g * g
    return np.where(np.abs(z) > s.l1, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2), 0.0)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The model as a table of cells with a weight. Without usable labels it is empty, and every score is one half."""
    drawn = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label"))
        .filter("_label is not null and _id is not null").filter(~held_out(F.col("_id")))
        .groupBy("_id").agg(F.max("_label").alias("_label"))
        .withColumn("_draw", F.xxhash64("_id")).orderBy("_draw", "_id").limit(s.sample)
    )
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(drawn), "_id")  # bounded by s.sample
    # One row of each id, so that the sample is bounded in rows as well.
    sample = rows.groupBy("_draw", "_id", "_label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    sample = sample.select("_draw", "_id", F.col("one.text").alias("text"), "_label")

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_draw", "ascending"), ("_id", "ascending")])
        weights = learn(table.column("text").combine_chunks(), table.column("_label").to_numpy(), s)
        cells = np.flatnonzero(weights)
        return pa.table({"cell": pa.array(cells, pa.int64()), "weight": pa.array(weights[cells])})

    # One task reads the sample: its rows are bounded, whatever the size of the tables.
    return sample.withColumn("_all", F.lit(1)).groupBy("_all").applyInArrow(train, "cell long, weight double")


def margins(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Intercept plus the dot product of each text."""
    out = np.full(len(texts), weights[-1])
    for first, last, cell, at in features(texts, len(weights) - 1):
        sums = np.concatenate([[0.0], np.cumsum(weights[cell])])
        out[first:last] += (sums[at[1:]] - sums[at[:-1]]) / np.sqrt(np.maximum(1, np.diff(at)))
    return out


def _shared(model: DataFrame, s: Settings):
    rows = model.limit(s.cells + 1).toArrow()  # bounded by the number of cells
    weights = np.zeros(s.cells + 1)
    weights[rows.column("cell").to_numpy()] = rows.column("weight").to_numpy()
    return model.sparkSession.sparkContext.broadcast(weights)


def scores(docs: DataFrame, model: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per row: doc_id and score, 0 to 1. Null and empty texts get the intercept's score; whole texts are read."""
    shared = _shared(model, s)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = 1 / (1 + np.exp(-np.clip(margins(batch.column(1), shared.value), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")


def quality(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per document: whether it was held out from learning, its score, and the predicted label.

    Duplicate labels of a document count once, by the larger; of repeated documents one is learned from, and all are
    scored. An empty table gives an empty result. Nothing but the text enters a score; other columns play no part.
    """
    model = stored(fit(docs, labels, s), "quality-model")
    found = scores(docs, model, s)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents with a score of at least one half, all columns kept, whatever their names.

    Null and empty texts have the intercept's score; repeated rows stay or go together; an empty table stays empty. Only
    the text is sent to the workers, a batch at a time; rows are filtered where they are.
    """
    shared = _shared(stored(fit(docs, labels, s), "quality-model"), s)

    @F.arrow_udf("double")
    def margin(texts: pa.Array) -> pa.Array:
        return pa.array(margins(texts, shared.value))

    return docs.filter(margin(F.col("text").cast("string")) >= 0)
