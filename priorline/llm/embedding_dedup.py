"""Near-duplicate embeddings by iterative quantisation, multi-index Hamming tables and exact reranking.

Binary codes come from rotations through the origin that bring vectors close to the corners of a cube (learned on a
bounded sample by alternating signs and a Procrustes step). Vectors are not centred: the number of tables follows from
the angle at the origin, and around a common mean angles are wider. Codes are cut into tables of short substrings;
vectors of a label that agree on a whole substring are candidates, and their cosine is taken on the original vectors.
Width and number of the tables follow from the largest label and the threshold. Equal vectors are one class and are
compared once. A crowded substring is cut into cells, and each pair of cells is one bounded piece of work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.llm.components import components
from priorline.llm.vectors import rotation, sample, usable
from priorline.llm.words import mix
from priorline.session import stored

THRESHOLD = 0.98
SAMPLE = 20_000
#: A pair at the threshold is in no common table with about this probability.
MISSED = 1e-3
CELL = 512
_STEPS = 40


def tables_for(rows: int, threshold: float, missed: float) -> tuple[int, int]:
    """Bits per table and number of tables. A bit of two vectors differs with the angle's share of a half turn."""
    width = min(max(math.ceil(math.log2(max(rows, 2))), 8), 32)
    same = (1 - math.acos(threshold) / math.pi) ** width
    return width, math.ceil(math.log(missed) / math.log(1 - same))


def learn(vectors: np.ndarray, seed: int) -> np.ndarray:
    """Matrix whose signs give one code bit per dimension: principal axes through the origin, then iterative quantisation."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(unit.T @ unit)
    projected, turn = unit @ axes, rotation(unit.shape[1], seed)
    for _ in range(_STEPS):
        corners = np.where(projected @ turn >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(corners.T @ projected)
        turn = (u @ v).T
    return axes @ turn


def codes(vectors: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.concatenate([unit @ turn >= 0 for turn in models], axis=1)


def _models(trained: dict, dimension: int, bits: int) -> list[np.ndarray]:
    """Learned rotations; for a dimension that the sample lacks, random ones."""
    count = -(-bits // dimension)
    known = trained.get(dimension, [])
    return known[:count] + [rotation(dimension, 1000 + k) for k in range(len(known), count)]


def _linked(pdf: pd.DataFrame, threshold: float, cell: int) -> pd.DataFrame:
    """Links within one piece of work: per class the number of other vectors linked, and a link to the smallest class
    of its component here. A pair counts in the first table where its keys are equal, so over all pieces once."""
    out = []
    for _, part in pdf.groupby(["key"] if cell < 0 else ["cell_a"], sort=False):
        part = part.sort_values("class_id", kind="stable")
        table = int(part["at"].iloc[0])
        classes, copies = part["class_id"].to_numpy(), part["copies"].to_numpy()
        side = part["side"].to_numpy()
        vectors, keys = np.array(part["vector"].tolist(), float), np.array(part["keys"].tolist(), np.int64)
        label = np.arange(len(part))
        counts = np.zeros(len(part), np.int64)
        norms = np.linalg.norm(vectors, axis=1)
        near = (vectors @ vectors.T) / np.outer(norms, norms) >= threshold
        for k in range(table):
            near &= keys[:, None, k] != keys[None, :, k]
        near &= classes[:, None] != classes[None, :]
        if (side >= 0).any() and part["cell_a"].iloc[0] != part["cell_b"].iloc[0]:
            near &= side[:, None] != side[None, :]
        counts += (near * copies[None, :]).sum(1)
        while True:  # smallest class within reach
            reach = np.where(near, label[None, :], len(part)).min(1)
            new = np.minimum(label, reach)
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        some = counts > 0
        out.append(pd.DataFrame({"class_id": classes[some], "links": counts[some], "to": classes[label[some]]}))
    return pd.concat(out) if out else pd.DataFrame({"class_id": [], "links": [], "to": []})


def near_duplicates(
    embeddings: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE, missed: float = MISSED
) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept. Vectors link within their label only.

    A vector that is null, zero or not finite, or whose label is null, has no links. Vectors of different dimensions
    never link. Repeated rows are vectors of their own and link with each other; equal vectors are compared once.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    fit = F.col("label").isNotNull() & usable(F.col("vector"))
    rows = rows.withColumn("class_id", F.when(fit, F.xxhash64("label", "vector")))
    held = stored(rows, "dedup-vectors")
    good = held.filter("class_id is not null")
    classes = good.groupBy("class_id").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies")
    )
    largest = good.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    width, tables = tables_for(int(largest), threshold, missed)
    trained = {
        d: [learn(m, seed) for seed in range(-(-width * tables // d))]
        for d, m in sample(good, "vec_id", "vector", sample_rows).items()
        if len(m) > d
    }
    shared = spark.sparkContext.broadcast(trained)  # a few rotations of the dimension's size

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys: list = [None] * len(pdf)
            sizes = pdf["vector"].map(len).to_numpy()
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                bits = codes(np.array(pdf["vector"].iloc[at].tolist(), float), _models(shared.value, int(d), width * tables))
                bits = bits[:, : width * tables].reshape(len(at), tables, width).astype(np.uint64)
                values = (bits << np.arange(width, dtype=np.uint64)).sum(2, dtype=np.uint64)
                label = mix(pdf["label"].iloc[at].to_numpy().astype(np.int64).view(np.uint64) + np.uint64(d))
                found = mix(values + mix(label[:, None] + mix(np.arange(tables, dtype=np.uint64))[None, :])).view(np.int64)
                for k, row in zip(at, found):
                    keys[k] = row
            yield pdf.assign(keys=keys)[["class_id", "copies", "vector", "keys"]]

    found = stored(
        classes.mapInPandas(keyed, "class_id long, copies long, vector array<double>, keys array<long>"), "dedup-codes"
    )
    written = found.select("class_id", F.posexplode("keys").alias("at", "key"))
    crowds = written.groupBy("key").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    members = stored(written.join(crowds, "key"), "dedup-members")
    small = members.filter(F.col("crowd") <= CELL)
    groups = 1 + int(small.count()) // (2 * CELL)
    packed = small.select(
        "class_id", "at", "key", F.pmod(F.xxhash64("key"), F.lit(groups)).alias("piece"),
        F.lit(-1).cast("long").alias("cell_a"), F.lit(-1).cast("long").alias("cell_b"), F.lit(-1).cast("long").alias("side"),
    )
    cells = F.ceil(F.col("crowd") / CELL)
    own = F.pmod(F.xxhash64("class_id", "key"), cells)
    large = members.filter(F.col("crowd") > CELL).withColumn("_own", own)
    large = large.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1))).select(
        "class_id", "at", "key", F.col("key").alias("piece"),
        F.least("_own", "_other").alias("cell_a"), F.greatest("_own", "_other").alias("cell_b"), F.col("_own").alias("side"),
    )

    def work(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _linked(pdf, threshold, int(group[1]))

    pieces = packed.union(large).join(found, "class_id")
    links = stored(
        pieces.groupBy("piece", "cell_a", "cell_b").applyInPandas(work, "class_id long, links long, to long"), "dedup-links"
    )
    labels = components(links.select(F.col("class_id").alias("a"), F.col("to").alias("b")))
    counts = links.groupBy("class_id").agg(F.sum("links").alias("links"))
    copies = found.select("class_id", "copies")
    all_rows = (
        held.select("vec_id", "class_id").join(copies, "class_id", "left").join(counts, "class_id", "left")
        .join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
        .withColumn("label", F.coalesce("label", "class_id"))
    )
    all_rows = stored(all_rows, "dedup-rows")
    least = all_rows.filter("label is not null").groupBy("label").agg(F.min("vec_id").alias("_least"))
    component = F.coalesce("_least", "vec_id")
    return all_rows.join(least, "label", "left").select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
