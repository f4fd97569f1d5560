"""Packing tokenised documents into windows of one length.

A document's full windows stand alone; what is left of it (its tail) is packed with other tails. Tails are counted by
length, all combinations of two or three lengths that fill a window exactly are enumerated, and non-negative least
squares finds how often to use each so that the histogram is met. The counts are rounded, and the rest is packed greedily,
cutting a tail where nothing fits. The plan speaks of lengths and ranks only, so its size does not grow with
the documents; each tail finds its window by its rank among the tails of its length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from priorline.session import stored

MODEL = "byte_bpe_50k.json"
END = 0
WINDOW = 1024
_ITERATIONS = 800


class Encoder:
    """Ids as the tokenizers library gives them. Texts without its special strings go through the same merges in a
    faster library, with a pattern free of look-ahead where no two white-space characters meet."""

    def __init__(self, model: str):
        self.library = Tokenizer.from_file(public_tokenizers.path(model))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.double = re.compile(r"\s\s")
        self.exact = self.simple = None
        twin = public_tokenizers.path(model.replace(".json", ".tiktoken")) if model == MODEL else None
        if twin:
            with open(twin, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            plain = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
            self.exact, self.simple = (
                tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
                for name, pattern in (("exact", public_tokenizers.PATTERN), ("simple", plain))
            )

    def __call__(self, text: str) -> np.ndarray:
        if self.exact is None or any(s in text for s in self.special):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = (self.exact if self.double.search(text) else self.simple).encode_ordinary(text)
        return np.array([*ids, END], "<u4")


@cache
def encoder(model: str) -> Encoder:
    return Encoder(model)


def tails(docs: DataFrame, id_column: str, text_column: str, window: int, model: str) -> DataFrame:
    """Per row: tokens, CRCs of its full windows, the tail's ids, and counts of what came before it in its partition."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = (
        f"id {kind}, tokens long, crcs array<long>, length int, tail binary, part int, rank long, windows_before long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(model), TaskContext.get().partitionId()
        seen, windows = np.zeros(window, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                rows = []
                for text in piece.column(1).to_pylist():
                    ids = encode(text or "")
                    full, length = divmod(len(ids), window)
                    crcs = [zlib.crc32(ids[k * window : (k + 1) * window]) for k in range(full)]
                    rows.append((len(ids), crcs, length, ids[full * window :].tobytes(), part, int(seen[length]), windows))
                    seen[length] += 1
                    windows += full
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), *columns],
                    ["id", "tokens", "crcs", "length", "tail", "part", "rank", "windows_before"],
                )

    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All pairs and triples of the given lengths that fill the window; the third place of a pair is 0."""
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    c = window - a - b
    has = np.zeros(window + 1, bool)
    has[lengths] = True
    has[0] = True
    ok = (a <= b) & (c >= 0) & ((c == 0) | (c >= b))
    ok &= has[np.clip(c, 0, window)]
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def repeats(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts whose use of lengths is closest to the histogram (accelerated projected gradient)."""
    scale = max(1.0, float(histogram.max()))
    goal = histogram / scale
    goal[0] = 0
    weights = combos > 0
    flat = combos.ravel()

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, (weights * x[:, None]).ravel(), minlength=len(goal))

    def back(r: np.ndarray) -> np.ndarray:
        return (r[combos] * weights).sum(1)

    x = probe = np.zeros(len(combos))
    direction = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue sets the step
        direction = back(used(direction))
        size = np.linalg.norm(direction)
        direction = direction / max(size, 1e-12)
    step, t = 1 / max(1.05 * size, 1e-12), 1.0
    for _ in range(_ITERATIONS):
        new = np.maximum(0, probe - step * back(used(probe) - goal))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        probe = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


@dataclass
class Plan:
    """Where tails go. A class is a tail length and how much of the tail's front was cut off already.

    ``rows``: class, first and last rank (exclusive), window of the first, tails of it per window, offset of the first
    in the window, length taken, and the class of what is left after a cut (-1: none).
    """

    classes: list[tuple[int, int]]
    rows: np.ndarray
    windows: int
    padding: int


def plan(histogram: np.ndarray, window: int) -> Plan:
    """Plan all tails of a histogram (index: length). Only the last window can have padding."""
    left = {(int(n), 0): int(c) for n, c in enumerate(histogram) if n and c}
    used = dict.fromkeys(left, 0)
    order = {c: k for k, c in enumerate(left)}
    rows: list[tuple[int, ...]] = []
    windows = 0

    def take(cls, first_window, per_window, times, offset, length, rest=-1):
        start, count = used[cls], per_window * times
        rows.append((order[cls], start, start + count, first_window, per_window, offset, length, rest))
        used[cls] = start + count
        left[cls] -= count
        if not left[cls]:
            del left[cls]

    lengths = np.array(sorted(n for n, _ in left), np.int64)
    if len(lengths):
        combos = combinations(lengths, window)
        counts = repeats(combos, np.asarray(histogram, float).copy()) if len(combos) else np.zeros(0)
        # Neighbouring combinations share a length: rounding their running sum keeps its use, where rounding each alone
        # would lose the many small counts.
        whole = np.diff(np.floor(np.cumsum(counts) + 0.5), prepend=0).astype(np.int64)
        for k in np.argsort(-whole, kind="stable")[: np.count_nonzero(whole)]:
            times = int(whole[k])
            parts = [int(n) for n in combos[k] if n]
            need = {n: parts.count(n) for n in parts}
            times = min([times, *(left.get((n, 0), 0) // m for n, m in need.items())])
            offset = 0
            for n, m in need.items() if times else ():
                take((n, 0), windows, m, times, offset, n)
                offset += n * m
            windows += times

    def size(cls):
        return cls[0] - cls[1]

    padding = 0
    while left:
        # Largest first, then whatever is the largest that still fits; the same window as often as the counts allow.
        parts, room = {}, window
        for cls in sorted(left, key=lambda c: (-size(c), c)):
            fit = min(room // size(cls), left[cls])
            if fit:
                parts[cls] = fit
                room -= fit * size(cls)
        spare = {c: n - parts.get(c, 0) for c, n in left.items() if size(c) > room and n > parts.get(c, 0)}
        cut = max(spare, key=lambda c: (spare[c], size(c), c)) if room and spare else None  # of the most frequent
        times = min(left[c] // m for c, m in parts.items())
        if cut:
            times = min(times, left[cut] // (parts.get(cut, 0) + 1))
        elif room:
            times, padding = 1, room
        offset = 0
        for cls, m in parts.items():
            take(cls, windows, m, times, offset, size(cls))
            offset += m * size(cls)
        if cut:
            rest = (cut[0], cut[1] + room)
            if rest not in order:
                order[rest], used[rest] = len(order), 0
            # Ranks of the rest go on where earlier cuts of the same kind ended.
            base = used[rest] + left.get(rest, 0)
            take(cut, windows, 1, times, offset, room, order[rest])
            rows[-1] = (*rows[-1], base)
            left[rest] = left.get(rest, 0) + times
        windows += times
    table = np.array([r if len(r) == 9 else (*r, 0) for r in rows], np.int64).reshape(-1, 9)
    return Plan(list(order), table, windows, padding)


class Places:
    """Looks up the pieces of a tail by its length and rank."""

    def __init__(self, made: Plan):
        self.index = {c: k for k, c in enumerate(made.classes)}
        by_class = np.lexsort((made.rows[:, 1], made.rows[:, 0]))
        self.rows = made.rows[by_class]
        bounds = np.searchsorted(self.rows[:, 0], np.arange(len(made.classes) + 1))
        self.of = [self.rows[a:b] for a, b in zip(bounds, bounds[1:])]

    def pieces(self, length: int, rank: int) -> Iterator[tuple[int, int, int, int]]:
        """Start within the tail, length, window and offset of each piece."""
        cls, start = self.index[length, 0], 0
        while cls >= 0:
            own = self.of[cls]
            row = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            _, first, _, window, per, offset, taken, rest, base = (int(v) for v in row)
            turn, slot = divmod(rank - first, per)
            yield start, taken, window + turn, offset + slot * taken
            start += taken
            cls, rank = rest, base + turn


def pack(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, model: str = MODEL
) -> DataFrame:
    """Pieces of all documents: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is an empty one and still has its end id; repeated rows and null ids are packed like others; an empty
    table gives an empty result. Sequences of tails come first, then the full windows. Together they have at most one
    sequence with padding.
    """
    spark = docs.sparkSession
    tokenised = stored(tails(docs, id_column, text_column, window, model), "pack-tails")
    counts = tokenised.filter("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()  # at most one per length
    histogram = np.zeros(window, np.int64)
    for row in counts:
        histogram[row["length"]] = row["n"]
    made = plan(histogram, window)

    per_part = tokenised.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank_base"))
    per_part = tokenised.groupBy("part").agg(F.sum(F.size("crcs")).cast("long").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("window_base"))
    based = ranks.join(bases, "part")  # one row per partition and length
    placed = tokenised.join(based, ["part", "length"]).select(
        "id", "tokens", "crcs", "length", "tail",
        (F.col("rank") + F.col("rank_base")).alias("rank"),
        (F.col("windows_before") + F.col("window_base") + made.windows).alias("first"),
    )
    kind = tokenised.schema["id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(made)  # lengths and ranks only: bounded by the window, not by the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(shared.value)
        for batch in batches:
            out: list[tuple] = []
            who: list[int] = []
            columns = [batch.column(k).to_pylist() for k in range(1, 7)]
            for k, (tokens, crcs, length, tail, rank, first) in enumerate(zip(*columns)):
                for n, crc in enumerate(crcs):
                    out.append((n * window, window, crc, tokens, first + n, 0))
                for start, taken, sequence, offset in places.pieces(length, rank) if length else ():
                    crc = zlib.crc32(tail[4 * start : 4 * (start + taken)])
                    out.append((len(crcs) * window + start, taken, crc, tokens, sequence, offset))
                who += [k] * (len(out) - len(who))
            ids = batch.column(0).take(pa.array(who, pa.int64()))
            numbers = np.array(out, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(numbers[:, k]) for k in range(6))],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    pieces = placed.mapInArrow(
        run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return pieces.withColumnRenamed("id", id_column)
