"""Periodic runs of words: stretches that repeat one block over and over, found by suffix arrays.

A run is a maximal stretch of consecutive words with smallest period q. Its last two blocks form a branching tandem: the
suffixes that begin at both share exactly q words, so both lie in the LCP interval of depth q, in different children.
For each LCP interval, all suffixes of its children but the largest one look up whether the suffix one depth further
(or back) lies in the interval, too; the squares found are rotated to the left as far as they go and merged by their
ends. Intervals are pairs of array positions; no tree is built. The suffix arrays of many texts are built at once, with
separate words for each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNK_BYTES = 1 << 20
_TESTED_AT_ONCE = 1 << 20
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


@dataclass(frozen=True)
class Settings:
    """A run has at least ``words`` words and ``repeats`` periods (two or more)."""

    words: int = 24
    repeats: int = 3

    def shared(self) -> int:
        """Words two suffixes one period apart share at least, at the start of any such run."""
        return min(max(self.words - q, (self.repeats - 1) * q) for q in range(1, self.words + 1))


def suffixes(ids: np.ndarray, width: int | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Positions in suffix order, each position's rank by its first 1, 2, 4, … words, and the positions not told apart.

    Doubling ends when all suffixes differ, or at a given width (a power of two). A rank is the first place of its
    group, so only groups of two or more are sorted again. The end of the words comes before any word.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = ids[order[1:]] != ids[order[:-1]]
    places, levels, known = np.arange(n), [np.full(n + 1, -1, np.int64)], 1
    while True:
        rank = levels[-1].copy()
        rank[order[places]] = np.maximum.accumulate(np.where(fresh, places, -1))
        levels.append(rank)
        again = ~fresh
        again[:-1] |= ~fresh[1:]
        places = places[again]
        if not len(places) or known == width:
            return order, levels[1:], order[places]
        inside = order[places]
        heads, ahead = rank[inside], rank[np.minimum(inside + known, n)]
        by = np.lexsort((ahead, heads))
        order[places] = inside[by]
        heads, ahead = heads[by], ahead[by]
        fresh = np.ones(len(places), bool)
        fresh[1:] = (heads[1:] != heads[:-1]) | (ahead[1:] != ahead[:-1])
        known *= 2


def common(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words each suffix shares with the one before it in order; the first shares none."""
    n = len(order)
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    left, right, shared = order[at - 1], order[at], np.zeros(len(at), np.int64)
    for k in reversed(range(len(levels))):
        same = levels[k][np.minimum(left + shared, n)] == levels[k][np.minimum(right + shared, n)]
        shared += same * (1 << k)
    out[at] = shared
    return out


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """Children of all LCP intervals but each one's largest: first place, place after the last, depth, and the interval's own two."""
    values = lcp.tolist() + [-1]
    before, after = [0] * len(values), [0] * len(values)
    open_: list[int] = []
    for i, v in enumerate(values):
        while open_ and values[open_[-1]] > v:
            after[open_.pop()] = i
        if open_ and values[open_[-1]] == v:
            before[i] = before[open_[-1]]  # the interval's first place
        else:
            before[i] = open_[-1] if open_ else 0
        open_.append(i)
    cut = np.flatnonzero(lcp > 0)
    low, high, depth = np.array(before)[cut], np.array(after)[cut], lcp[cut]
    # Cuts of one interval follow each other in this order; the pieces between them are its children.
    by = np.lexsort((cut, depth, low))
    cut, low, high, depth = cut[by], low[by], high[by], depth[by]
    head = np.ones(len(cut), bool)
    head[1:] = (low[1:] != low[:-1]) | (depth[1:] != depth[:-1])
    nexts = high.copy()
    nexts[:-1] = np.where(head[1:], high[:-1], cut[1:])
    start = np.concatenate([cut, low[head]])
    stop = np.concatenate([nexts, cut[head]])
    group = np.concatenate([np.cumsum(head) - 1, np.arange(head.sum())])
    by = np.lexsort((start, stop - start, group))
    largest = np.ones(len(by), bool)
    largest[:-1] = group[by][1:] != group[by][:-1]
    small = by[~largest]
    firsts = np.flatnonzero(head)[group[small]]
    return start[small], stop[small], depth[firsts], low[firsts], high[firsts]


def tandems(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of all branching tandems."""
    n = len(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    start, stop, depth, low, high = intervals(lcp)
    ends = np.cumsum(stop - start)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    first = 0
    while first < len(start):
        done = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, done + _TESTED_AT_ONCE, "right")), first + 1)
        sizes = (stop - start)[first:last]
        own = np.repeat(np.arange(first, last), sizes)
        rank = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[own]
        at = order[rank]
        for step in (depth[own], -depth[own]):
            other = at + step
            inside = (other >= 0) & (other < n)
            there = place[np.where(inside, other, 0)]
            inside &= (there >= low[own]) & (there < high[own])
            inside &= (there < start[own]) | (there >= stop[own])
            found.append((np.minimum(at, other)[inside], depth[own][inside]))
        first = last
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _reach(ids: np.ndarray, start: int, period: int) -> int:
    """First position from which the period holds up to a square's start."""
    width = 64
    while start:
        width = min(width, start)
        equal = ids[start - width : start] == ids[start - width + period : start + period]
        if not equal.all():
            return start - int(np.argmin(equal[::-1]))
        start -= width
        width *= 2
    return 0


def runs(ids: np.ndarray, s: Settings = Settings()) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of all runs in a row of word numbers, by start, then period."""
    order, levels, _ = suffixes(ids)
    begin, period = tandems(order, common(order, levels))
    # Without one more equal word to the left the square is the whole run.
    enough = np.maximum(s.words, s.repeats * period) <= 2 * period
    enough |= (begin > 0) & (ids[begin - 1] == ids[begin - 1 + period])
    begin, period = begin[enough], period[enough]
    ends: dict[int, list[tuple[int, int]]] = {}
    out = []
    for k in np.lexsort((begin, period)).tolist():
        b, q = int(begin[k]), int(period[k])
        known = ends.setdefault(b + 2 * q, [])
        if any(q % p == 0 and f <= b for f, p in known):
            continue  # the same run, seen with a multiple of its period
        f = _reach(ids, b, q)
        known.append((f, q))
        if b + 2 * q - f >= max(s.words, s.repeats * q):
            out.append((f, b + 2 * q - f, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[bytes], s: Settings) -> tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]:
    """Words and runs of each text."""
    words = [t.split() for t in texts]  # of bytes: at space and 0x09 to 0x0D
    counts = np.array([len(w) for w in words])
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    if counts.max(initial=0) < s.words:
        return words, out
    coded = pa.array([w for row in words for w in row], pa.large_binary()).dictionary_encode()
    owner = np.repeat(np.arange(len(words)), counts)
    # No word is shared by two texts, so no stretch crosses from one into the next.
    ids = coded.indices.to_numpy().astype(np.int64) + owner * len(coded.dictionary)
    # A text in which no two places share enough words has no run.
    _, _, alike = suffixes(ids, 1 << (s.shared().bit_length() - 1))
    likely = np.unique(owner[alike])
    if not len(likely):
        return words, out
    chosen = np.isin(owner, likely)
    starts = np.cumsum(counts[likely]) - counts[likely]
    for begin, length, period in runs(ids[chosen], s):
        k = int(np.searchsorted(starts, begin, "right")) - 1
        out[likely[k]].append((begin - int(starts[k]), length, period))
    return words, out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> str:
    """The words outside all runs, and the first block of each run, joined by one space."""
    if not found:
        return b" ".join(words).decode()
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()]).decode()


def periodic_runs(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, ``runs`` (start, length, smallest period in words; by start, then period) and ``collapsed``.

    ``collapsed`` leaves out the words that any run holds after its first period. A null or empty text has no words, no runs and an empty collapsed text. Null ids
    stay null; repeated rows give repeated results; an empty table gives an empty one; other columns play no part.
    Whole texts are read, about a megabyte of them at a time (a longer text on its own).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            ends = np.cumsum([len(t) for t in texts])
            first = 0
            while first < len(texts):
                done = ends[first - 1] if first else 0
                last = max(int(np.searchsorted(ends, done + _CHUNK_BYTES, "right")), first + 1)
                words, found = runs_of_texts(texts[first:last], s)
                rows = [[{"start": a, "length": b, "period": c} for a, b, c in f] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                        pa.array([collapsed(w, f) for w, f in zip(words, found)], pa.string()),
                    ],
                    ["doc_id", "runs", "collapsed"],
                )
                first = last

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, runs {_RUNS}, collapsed string")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; where CRC-32 of the id leaves 0 by 10, the words from a place on repeat one block to the end.

    With g the CRC-32 over 10 and n words, the place is g % n and the block floor((n - place) / (3 + g % 8)) + 1 words.
    Rows with a null id or no word stay as they are.
    """
    crc = F.crc32(F.col("doc_id").cast("string"))
    split = docs.select("doc_id", F.col("text").cast("string").alias("text"), crc.alias("_crc")).withColumn(
        "_words", F.when(F.col("_crc") % 10 == 0, _words(F.col("text")))
    )
    sized = split.withColumns({"_n": F.size("_words"), "_g": F.expr("_crc div 10")})
    sized = sized.withColumn("_from", F.when(F.col("_n") > 0, (F.col("_g") % F.col("_n")).cast("int")))
    sized = sized.withColumn("_block", F.expr("1 + (_n - _from) div (3 + _g % 8)").cast("int"))
    rest = F.col("_n") - F.col("_from")
    copies = F.ceil(rest / F.col("_block")).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice("_words", F.col("_from") + 1, F.col("_block")), copies))
    words = F.concat(F.slice("_words", F.lit(1), F.col("_from")), F.slice(repeated, F.lit(1), rest))
    return sized.select("doc_id", F.when(F.col("_n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document with planted runs: the number of runs, the one of greatest exponent, and digests of all runs and the rest."""
    found = periodic_runs(with_planted_runs(docs))
    best = F.aggregate(
        "runs",
        F.col("runs")[0],
        lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    all_runs = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.withColumn("_best", F.when(F.size("runs") > 0, best)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.encode(all_runs, "utf-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"),
    )
