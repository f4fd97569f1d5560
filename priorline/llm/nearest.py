"""Nearest neighbours from randomly rotated one-bit codes with error bounds, reranked on the original vectors.

Vectors are centred, rotated at random (padded with zeros to more dimensions) and kept as sign bits with two scalars:
the length, and the agreement of the unit vector with its code. From the bits a query's inner product with every vector
is estimated, with a bound of the error that holds except with a very small probability; only vectors whose lower bound
of the distance does not exceed the k-th smallest upper bound are measured exactly. Queries and candidates meet in
blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorline.llm.vectors import rotation, sample, usable
from priorline.session import stored

EVERY = 100
NEAREST = 10
SAMPLE = 10_000
QUERY_ROWS = 1024
DATA_ROWS = 8192
#: Bits per dimension of a code, and how many standard errors the bound allows.
BITS_PER_DIMENSION = 4
SURE = 4.0


class Codes:
    """Packed sign bits of rotated, centred vectors with their correction scalars."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        moved = vectors - centre
        self.length = np.linalg.norm(moved, axis=1)
        turned = (moved / np.where(self.length > 0, self.length, 1)[:, None]) @ turn
        self.packed = np.packbits(turned >= 0, axis=1)
        self.bits = turn.shape[1]
        #: Inner product of the unit vector with its own code.
        self.agreement = np.maximum(np.abs(turned).sum(1) / self.bits**0.5, 1e-9)

    def bounds(self, query: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances, one row per vector and one column per query."""
        moved = query - centre
        length = np.linalg.norm(moved, axis=1)
        turned = (moved / np.where(length > 0, length, 1)[:, None]) @ turn
        signs = np.unpackbits(self.packed, axis=1, count=self.bits).astype(np.float32) * 2 - 1
        product = (signs @ turned.T.astype(np.float32)).astype(float) / self.bits**0.5 / self.agreement[:, None]
        error = SURE * np.sqrt(np.maximum(1 - self.agreement**2, 0)) / self.agreement / max(self.bits - 1, 1) ** 0.5 + 1e-4
        low, high = np.clip(product - error[:, None], -1, 1), np.clip(product + error[:, None], -1, 1)
        squares, twice = self.length[:, None] ** 2 + length[None, :] ** 2, 2 * self.length[:, None] * length[None, :]
        return squares - twice * high, squares - twice * low


def _model(trained: dict, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    centre = trained.get(dimension, np.zeros(dimension))
    return centre, rotation(dimension * BITS_PER_DIMENSION, 11)[:dimension]


def search_block(queries: pd.DataFrame, data: pd.DataFrame, trained: dict, k: int) -> pd.DataFrame:
    """The k nearest of a block's vectors for each query."""
    out = []
    for d in sorted(set(queries["d"]) & set(data["d"])):
        q, x = queries[queries["d"] == d], data[data["d"] == d]
        qv, xv = np.array(q["vector"].tolist(), float), np.array(x["vector"].tolist(), float)
        qi, xi = q["vec_id"].to_numpy(), x["vec_id"].to_numpy()
        centre, turn = _model(trained, d)
        low, high = Codes(xv, centre, turn).bounds(qv, centre, turn)
        for c in range(len(q)):
            others = np.flatnonzero(xi != qi[c])
            if not len(others):
                continue
            kth = np.partition(high[others, c], min(k, len(others)) - 1)[min(k, len(others)) - 1]
            chosen = others[low[others, c] <= kth]
            score = np.sqrt(((xv[chosen] - qv[c]) ** 2).sum(1))
            best = np.lexsort((xi[chosen], score))[:k]
            out.append(pd.DataFrame({"query_id": qi[c], "vec_id": xi[chosen][best], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def nearest(embeddings: DataFrame, every: int = EVERY, k: int = NEAREST, sample_rows: int = SAMPLE) -> DataFrame:
    """For each vector whose id is divisible by ``every``: its k nearest others by Euclidean distance.

    Null, zero and not finite vectors take no part, and vectors of another dimension are no candidates. A row without
    an id is no query and no candidate. Rows that share the query's id count as the query's own. A repeated query gives
    one answer; repeated candidates with one id each take a rank. Ties go to the smaller id.
    """
    spark = embeddings.sparkSession
    good = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    good = good.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("d", F.size("vector"))
    good = stored(good, "nearest-vectors")
    trained = {d: m.mean(0) for d, m in sample(good, "vec_id", "vector", sample_rows).items()}
    shared = spark.sparkContext.broadcast(trained)  # one centre per dimension
    queries = good.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    data_blocks = 1 + good.count() // DATA_ROWS
    query_blocks = 1 + queries.count() // QUERY_ROWS
    number = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    asked = queries.withColumn("block_q", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)))
    asked = asked.withColumn("block_d", F.explode(number(data_blocks))).withColumn("asks", F.lit(True))
    # Rows are dealt by id and content; equal rows may share a block.
    there = good.withColumn("block_d", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(data_blocks)))
    there = there.withColumn("block_q", F.explode(number(query_blocks))).withColumn("asks", F.lit(False))
    columns = ["block_q", "block_d", "asks", "vec_id", "vector", "d"]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return search_block(pdf[pdf["asks"]], pdf[~pdf["asks"]], shared.value, k)

    met = asked.select(*columns).union(there.select(*columns)).groupBy("block_q", "block_d")
    found = met.applyInPandas(work, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
