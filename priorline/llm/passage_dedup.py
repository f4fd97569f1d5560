"""Passages that repeat across documents: MinHash banding of content-defined paragraphs.

Repeated passages begin and end anywhere in a line, so a paragraph here is what stands around an anchor: a word pair
whose hash is the least within ``REACH`` words on either side, with ``SPAN`` words about it. A shared passage has the
same anchors in every document, wherever it stands. Paragraphs that collide in a pair of the minimum hashes of their
five-word shingles (so many that similar ones always do) are verified by exact Jaccard similarity against the first and the last paragraph of the key's
group. Those of groups that then still hold several components are joined on the subsets that similar sets have in
common, so no pair is left out. All links are clustered by connected components; in each cluster the document with the smallest id keeps its passage.
Each paragraph is then extended word by word as far as its document and the keeper's agree.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.llm.components import components
from priorline.llm.words import WIDTH, mix, pairs, signed, windows, word_runs
from priorline.session import forget, stored

REACH = 7
SPAN = 20
PERCENT = 75
#: Shingles that a key is made of.
ROWS = 2
_SHINGLES = SPAN - WIDTH + 1
_ROWS_AT_ONCE = 1000
_SEEDS = mix(np.arange(9001, 9301, dtype=np.uint64))


def common(m: int, n: int, percent: int) -> int:
    """Shingles that two sets of so many must share at least."""
    return -(-percent * (m + n) // (100 + percent))


def partners(size: int, loose: bool, percent: int) -> list[int]:
    """Sizes of the sets that a set of this size can be similar to.

    A set is loose if its paragraph repeats a word pair. From 75 per cent on, the others are similar only to sets of at
    most one shingle less: within a paragraph without repeated word pairs each pair has one successor, so the shared
    shingles of the other paragraph follow each other in one run and at most one of its shingles can stand twice.
    """
    least = 1 if loose or percent < 75 else _SHINGLES - 1
    return [m for m in range(least, _SHINGLES + 1) if common(size, m, percent) <= min(size, m)]


def anchors(words: np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First words of the paragraphs of texts that follow each other, and the text of each; word pairs that repeat each
    other are never anchors. ``bounds`` holds the first word of each text and the end; without it there is one text."""
    bounds = np.array([0, len(words)]) if bounds is None else bounds
    if len(words) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = least = pairs(words)
    reached = 1
    while reached < REACH:
        step = min(reached, REACH - reached)
        least = np.minimum(least[:-step], least[step:])
        reached += step
    middle = found[REACH : len(found) - REACH]
    at = np.flatnonzero((middle < least[: len(middle)]) & (middle <= least[REACH + 1 : REACH + 1 + len(middle)])) + REACH
    first = at - SPAN // 2 + 1
    first = first[first >= 0]
    # A paragraph that lies within one text has its anchor's neighbours there, too.
    text = np.searchsorted(bounds, first, "right") - 1
    inside = first + SPAN <= bounds[text + 1]
    return first[inside], text[inside]


def repeating(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether the paragraphs repeat a word pair."""
    double = np.sort(pairs(words)[first[:, None] + np.arange(SPAN - 1)], axis=1)
    return (double[:, 1:] == double[:, :-1]).any(1)


def paragraphs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, the shingles of each paragraph of a text, and whether it repeats a word pair."""
    first, _ = anchors(words)
    if not len(first):
        return first, np.zeros((0, _SHINGLES), np.uint64), np.zeros(0, bool)
    return first, windows(words)[first[:, None] + np.arange(_SHINGLES)], repeating(words, first)


def nodes_of(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each paragraph's shingles, whatever their order, from running sums over the words."""
    if not len(first):
        return np.zeros(0, np.uint64)
    found = windows(words)
    sums, both = np.zeros(len(found) + 1, np.uint64), np.zeros(len(found) + 1, np.uint64)
    np.cumsum(found, out=sums[1:])
    np.bitwise_xor.accumulate(found, out=both[1:])
    return mix(sums[first + _SHINGLES] - sums[first] + mix(both[first + _SHINGLES] ^ both[first]))


def by_size(found: np.ndarray, loose: np.ndarray, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows of one size and kind, their hashed distinct shingles in order, and the kind."""
    hashes = np.sort(mix(found ^ _SEEDS[seed]), axis=1)
    again = np.zeros(hashes.shape, bool)
    again[:, 1:] = hashes[:, 1:] == hashes[:, :-1]
    sizes = hashes.shape[1] - np.count_nonzero(again, axis=1)
    short = np.flatnonzero(sizes < hashes.shape[1])
    hashes[short] = np.take_along_axis(hashes[short], np.argsort(again[short], axis=1, kind="stable"), 1)
    for kind in (False, True):
        for size in np.unique(sizes[loose == kind]):
            at = np.flatnonzero((sizes == size) & (loose == kind))
            yield at, hashes[at, :size], kind


def band_keys(found: np.ndarray, loose: np.ndarray, percent: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Paragraphs and their keys: all runs of ``rows`` among the least hashes of a set.

    Two sets that share c shingles have the first ``rows`` shared ones among their least size - c + rows hashes, so
    similar sets have a key in common, without exception.
    """
    own, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at, hashes, kind in by_size(found, loose, 0):
        size = hashes.shape[1]
        shared = min(common(size, m, percent) for m in partners(size, kind, percent))
        width = min(rows, shared)
        for chosen in combinations(range(min(size, size - shared + width)), width):
            key = np.full(len(at), _SEEDS[200], np.uint64)
            for k in chosen:
                key = mix(key + hashes[:, k])
            own.append(at)
            keys.append(key)
    return np.concatenate(own), np.concatenate(keys)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int64()))


def _binary(words: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of 64-bit values, one after the other, as a binary column."""
    ends = np.concatenate([[0], np.cumsum(counts) * 8]).astype(np.int64)
    values = pa.py_buffer(np.ascontiguousarray(words, np.uint64))
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), values]).cast(pa.binary())


def _words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column, and where each row's begin (one more at the end)."""
    column = column.cast(pa.large_binary())
    _, offsets, values = column.buffers()
    if not len(column) or values is None:
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // 8
    return np.frombuffer(values, np.uint64, values.size // 8), at


def _set_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One row of shingles per set, short sets filled up with their last one, and the sizes."""
    values, at = _words_of(column)
    sizes = np.diff(at)
    return values[at[:-1, None] + np.minimum(np.arange(_SHINGLES), sizes[:, None] - 1)], sizes


def similar(x: pa.Array, y: pa.Array, percent: int) -> np.ndarray:
    """Whether the sets of two columns are similar, row by row."""
    (one, m), (two, n) = _set_rows(x), _set_rows(y)
    shared = np.zeros(len(m), np.int64)
    for k in range(_SHINGLES):
        shared += (one[:, k : k + 1] == two).any(1) & (k < m)
    return shared >= common(m, n, percent)


def _stretches(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of all members of stretches of places that begin at ``first``."""
    rows = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    return rows, first[rows] + within


def _placed(column: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text and first word in the run of all paragraphs in a list column of texts, and its flat list."""
    text = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    flat = column.flatten()
    return text, flat.field("first").to_numpy(zero_copy_only=False) + at[text], flat


def _written(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Per document: id, doc (a key of id and text), and its paragraphs' first words and nodes."""
    kind = docs.schema[id_column].dataType.simpleString()
    text = F.col(f"`{text_column}`").cast("string")
    keyed = docs.select(F.col(f"`{id_column}`").alias("id"), text.alias("text"))
    keyed = keyed.select("id", F.xxhash64("id", "text").alias("doc"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words, at in word_runs(batch.column(2)):
                ids, keys = (batch.column(k).slice(first, last - first) for k in (0, 1))
                place, text = anchors(words, at)
                counts = np.bincount(text, minlength=last - first)
                columns = [ids, keys, _lists(place - at[text], counts), _lists(signed(nodes_of(words, place)), counts)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "doc", "first", "node"])

    return keyed.mapInArrow(run, f"id {kind}, doc long, first array<long>, node array<long>")


def _keyed(docs: DataFrame, text_column: str, percent: int, rows: int) -> DataFrame:
    """Keys and nodes of all paragraphs, once for a node in a run of documents. They are not written but shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, words, at in word_runs(batch.column(0)):
                place, _ = anchors(words, at)
                if not len(place):
                    continue
                nodes, once = np.unique(nodes_of(words, place), return_index=True)
                found = windows(words)[place[once, None] + np.arange(_SHINGLES)]
                own, keys = band_keys(found, repeating(words, place[once]), percent, rows)
                columns = [pa.array(signed(keys)), pa.array(signed(nodes[own]))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "node"])

    return docs.select(F.col(f"`{text_column}`").cast("string")).mapInArrow(run, "key long, node long")


def _sets(chosen: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Shingles of the chosen paragraphs (node, doc, first), from the texts they stand in."""
    by_doc = stored(chosen.groupBy("doc").agg(F.collect_list(F.struct("node", "first")).alias("wanted")), "passage-wanted")
    text = F.col(f"`{text_column}`").cast("string")
    texts = docs.select(F.xxhash64(F.col(f"`{id_column}`"), text).alias("doc"), text.alias("text"))
    texts = texts.join(by_doc, "doc").select("wanted", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words, at in word_runs(batch.column(1)):
                _, place, wanted = _placed(batch.column(0).slice(first, last - first), at)
                if not len(place):
                    continue
                found = np.sort(windows(words)[place[:, None] + np.arange(_SHINGLES)], axis=1)
                new = np.ones(found.shape, bool)
                new[:, 1:] = found[:, 1:] != found[:, :-1]
                sets = _binary(found[new], np.count_nonzero(new, axis=1))
                columns = [wanted.field("node"), sets, pa.array(repeating(words, place))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "found", "loose"])

    return texts.mapInArrow(run, "node long, found binary, loose boolean").dropDuplicates(["node"])


def subset_keys(found: np.ndarray, loose: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Rows, keys, sizes and levels: one key for each subset of a set that a similar set can have in common with it.

    ``found`` holds one row of shingles per set, short sets filled up with their last one. The level is the subset's
    size. Two sets with an equal key share that subset; two similar ones have an equal key at their least common size.
    """
    for at, hashes, kind in by_size(found, loose, 1):
        size = hashes.shape[1]
        whole = np.bitwise_xor.reduce(hashes, axis=1)
        for level in sorted({common(size, m, percent) for m in partners(size, kind, percent)}):
            for left_out in combinations(range(size), size - level):
                key = whole.copy()
                for k in left_out:
                    key ^= hashes[:, k]
                yield at, mix(key + _SEEDS[201 + level]), size, level


def _subset_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b by which all similar ones among the sets are connected, without comparing pairs.

    Sets with an equal subset are linked to the smallest of them: if two of them are similar, each is to that one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), _ROWS_AT_ONCE):
                part = batch.slice(first, _ROWS_AT_ONCE)
                nodes, loose = (part.column(c).to_numpy(zero_copy_only=False) for c in ("node", "loose"))
                found, _ = _set_rows(part.column("found"))
                for at, key, size, level in _gathered(subset_keys(found, loose, percent)):
                    columns = [pa.array(signed(key)), pa.array(nodes[at]), pa.array(size * 32 + level)]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "node", "shape"])

    # Spread once: the groups and their join read all columns, so they share the exchange and the keys are made once.
    keyed = sets.select("node", "found", "loose").mapInArrow(run, "key long, node long, shape int")
    keyed = keyed.filter("key is not null").repartition("key")
    met = keyed.groupBy("key").agg(F.min(F.struct("shape", "node")).alias("least"), F.min("node").alias("low"), F.max("node").alias("high"))
    met = met.filter("low < high").select("key", "least")
    size = lambda shape: F.shiftright(shape, 5)
    near = (100 + percent) * F.col("shape").bitwiseAND(31) >= percent * (size("shape") + size("least.shape"))
    links = keyed.join(met.hint("shuffle_hash"), "key").filter((F.col("node") != F.col("least.node")) & near)
    return links.select(F.col("least.node").alias("a"), F.col("node").alias("b")).distinct()


def _gathered(parts: Iterator[tuple], rows: int = 100_000) -> Iterator[tuple]:
    """The same in fewer, longer pieces."""
    held: list[tuple] = []
    for at, key, size, level in parts:
        held.append((at, key, np.full(len(at), size, np.int32), np.full(len(at), level, np.int32)))
        if sum(len(h[0]) for h in held[-1:]) * len(held) >= rows:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held = []
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _around(found: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Per placed paragraph (doc, id, p): the words from its middle back to the start of the one before, and on to the
    end of the next one, as hashes from the middle outwards.

    Common words end there: the next paragraph would else stand in both documents and be placed itself. Documents with
    equal id and text give equal rows.
    """
    by_doc = stored(found.groupBy("doc").agg(F.first("id").alias("id"), F.collect_list("p").alias("placed")), "passage-placed")
    shape = by_doc.schema["id"].dataType.simpleString()
    text = F.col(f"`{text_column}`").cast("string")
    texts = docs.select(F.xxhash64(F.col(f"`{id_column}`"), text).alias("doc"), text.alias("text"))
    texts = texts.join(by_doc, "doc").select("doc", "id", "placed", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, words, at in word_runs(batch.column("text")):
                text, first, placed = _placed(batch.column("placed").slice(low, high - low), at)
                if not len(first):
                    continue
                starts, owner = anchors(words, at)
                middle, turn = first + SPAN // 2, np.searchsorted(starts, first)
                # The paragraphs before and after it; the ends of the text where there are none.
                near = lambda k: (k >= 0) & (k < len(starts)) & (owner[np.clip(k, 0, len(starts) - 1)] == text)
                back = np.where(near(turn - 1), starts[np.maximum(turn - 1, 0)], at[text])
                ahead = np.where(near(turn + 1), starts[np.minimum(turn + 1, len(starts) - 1)] + SPAN, at[text + 1])
                _, later = _stretches(middle, ahead - middle)
                rows, earlier = _stretches(np.zeros(len(middle), np.int64), middle - back)
                before = _binary(words[middle[rows] - 1 - earlier], middle - back)
                take = pa.array(low + text)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").take(take), batch.column("id").take(take), *[placed.field(c) for c in ("first", "label", "kept")],
                        before, _binary(words[later], ahead - middle),
                    ],
                    ["doc", "id", "first", "label", "kept", "before", "after"],
                )

    shape = f"doc long, id {shape}, first long, label long, kept long, before binary, after binary"
    return texts.mapInArrow(run, shape)


def _alike(x: pa.Array, y: pa.Array) -> np.ndarray:
    """How far two runs of words agree beyond half a paragraph, row by row; below 0 if the half itself ends in differing words."""
    (one, m), (two, n) = _words_of(x), _words_of(y)
    size, half = np.minimum(np.diff(m), np.diff(n)), SPAN // 2
    rows, left = _stretches(m[:-1], size)
    place = left - m[rows]
    same = one[left] == two[n[rows] + place]
    found = size - half
    differing, at = np.unique(rows[(place >= half) & ~same], return_index=True)
    found[differing] = place[(place >= half) & ~same][at] - half
    first = np.cumsum(size) - size
    inside = same[first[:, None] + np.arange(half - 1, -1, -1)]
    return np.where(inside[:, 0], found, np.where(inside.any(1), -inside.argmax(1), -half))


def reach(before: pa.Array, left: pa.Array, after: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words to add on either side (to take off, below 0). Paragraphs around different anchors stay as they are."""
    back, ahead = _alike(before, left), _alike(after, right)
    near = np.minimum(back, 0) + np.minimum(ahead, 0) >= -SPAN // 2
    return np.where(near, back, 0), np.where(near, ahead, 0)


def _extended(found: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Placed paragraphs (doc, id, first, label, kept) with start and end of the words about their middle that the
    keeper's paragraph and the other one share; the keeper's own reach as far as any other's."""
    around = stored(_around(found, docs, id_column, text_column), "passage-around")
    keepers = around.filter("doc = kept").withColumn("turn", F.xxhash64("label", "before", "after"))
    # A paragraph that comes again within its keeper, with the same words around it, is compared once.
    each = keepers.select("label", "turn", F.col("before").alias("left"), F.col("after").alias("right")).dropDuplicates(["turn"])
    met = around.filter("doc != kept").join(each, "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            back, ahead = reach(*(batch.column(n) for n in ("before", "left", "after", "right")))
            kept = batch.select(["doc", "first", "turn"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(back), pa.array(ahead)], ["doc", "first", "turn", "back", "ahead"])

    met = met.select("doc", "first", "turn", "before", "after", "left", "right")
    shared = stored(met.mapInArrow(run, "doc long, first long, turn long, back long, ahead long"), "passage-shared")
    most = [F.max("back").alias("back"), F.max("ahead").alias("ahead")]
    # Rows with equal id and text count once; the words are not shuffled for it.
    once = lambda rows: rows.drop("before", "after").dropDuplicates(["doc", "first"])
    others = once(around.filter("doc != kept")).join(shared.groupBy("doc", "first").agg(*most), ["doc", "first"])
    own = once(keepers).join(shared.groupBy("turn").agg(*most), "turn", "left")
    both = own.drop("turn").unionByName(others).withColumns({"back": F.coalesce("back", F.lit(0)), "ahead": F.coalesce("ahead", F.lit(0))})
    return both.select(
        "doc", "id", "first", "label", "kept", (F.col("first") - F.col("back")).alias("start"), (F.col("first") + SPAN + F.col("ahead")).alias("end")
    )


def spans_of(doc: int, placed: list[dict]) -> list[tuple]:
    """First word, end word, paragraphs, cluster and removed for each run of touching paragraphs with one keeper.

    A paragraph that another document keeps is cut where it meets words that this document keeps itself.
    """
    runs: dict[int, list[list]] = {}
    for one in sorted(placed, key=lambda p: (p["start"], p["first"])):
        first, end = one["start"], one["end"]
        own = runs.setdefault(one["kept"], [])
        if own and first <= own[-1][1]:
            own[-1][1] = max(own[-1][1], end)
            own[-1][2].add(one["first"])
        else:
            own.append([first, end, {one["first"]}, one["cluster"]])
    out = [(first, end, len(at), cluster, False) for first, end, at, cluster in runs.get(doc, [])]
    keeps = [(first, end) for first, end, *_ in out]
    starts, ends = [k[0] for k in keeps], [k[1] for k in keeps]
    for kept in runs.keys() - {doc}:
        for first, end, at, cluster in runs[kept]:
            left = first
            for k in range(bisect_right(ends, first), bisect_left(starts, end)):
                if left < keeps[k][0]:
                    out.append((left, keeps[k][0], sum(left <= x < keeps[k][0] for x in at), cluster, True))
                left = keeps[k][1]
            if left < end:
                out.append((left, end, sum(left <= x < end for x in at), cluster, True))
    return sorted(out, key=lambda s: (s[0], s[1]))


def _spans(by_doc: DataFrame, id_column: str) -> DataFrame:
    kind = by_doc.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            rows, at = [], []
            for k, (doc, placed) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("placed").to_pylist())):
                found = spans_of(doc, placed)
                rows += found
                at += [k] * len(found)
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), ids.type, pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                [id_column, "first_word", "end_word", "paragraphs", "cluster", "removed"],
            )

    shape = f"`{id_column}` {kind}, first_word long, end_word long, paragraphs long, cluster {kind}, removed boolean"
    return by_doc.mapInArrow(run, shape)


def repeated_passages(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT, rows: int = ROWS
) -> DataFrame:
    """Spans of text that repeat in other documents: id, first and last word (exclusive), paragraphs, cluster, removed.

    A cluster is named by the smallest id of its documents; ``removed`` is false in that document only, and a span holds
    one cluster's words: where clusters meet, a new one starts, and no removed span covers words its document keeps.
    Spans of clusters that different other documents keep may overlap. Passages of
    fewer words than a paragraph are not looked at, nor are those repeated within one document alone. Null, empty and
    short texts have no spans. Rows with equal id and text count once; an empty table gives an empty result.
    """
    written = stored(_written(docs, id_column, text_column), "passage-paragraphs")
    occurring = written.select("doc", F.explode(F.arrays_zip("first", "node")).alias("p")).select("doc", "p.first", "p.node")
    # Spread once; the groups and their join with the members read the same exchange.
    each = _keyed(docs, text_column, percent, rows).filter("key is not null").repartition("key")
    groups = each.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead < last")
    # The side with one row a key fits into memory, a partition at a time; the other one, most of which meets nothing, needs no sort.
    members = stored(each.join(groups.hint("shuffle_hash"), "key").select("key", "node", "lead", "last").distinct(), "passage-members")

    ends = F.explode(F.array("lead", "last"))
    pair = members.select(ends.alias("a"), F.col("node").alias("b")).filter("a != b")
    pair = stored(pair.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "passage-pairs")
    involved = members.select("node").distinct()
    # Any place will do, as a node stands for the same shingles everywhere.
    chosen = occurring.join(involved.hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node"])
    sets = stored(_sets(chosen, docs, id_column, text_column), "passage-sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield batch.select(["a", "b"]).filter(pa.array(similar(batch.column("x"), batch.column("y"), percent)))

    one = sets.select(F.col("node").alias("a"), F.col("found").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("found").alias("y"))
    links = pair.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")
    links = stored(links, "passage-links")
    forget(pair)
    labels = stored(components(links), "passage-labels")

    # Groups that hold several components beside their first and last, which have been compared with all others.
    inner = members.filter("node != lead and node != last").select("key", "node").join(labels.hint("shuffle_hash"), "node", "left")
    inner = inner.withColumn("label", F.coalesce("label", "node"))
    mixed = inner.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    rest = stored(inner.join(mixed.select("key").hint("shuffle_hash"), "key", "left_semi").select("node").distinct(), "passage-mixed")
    forget(members)
    more = stored(_subset_links(sets.join(rest, "node", "left_semi"), percent), "passage-links")
    forget(sets, rest, labels)
    labels = stored(components(links.union(more)), "passage-labels")
    forget(links, more)

    ids = written.select("id", "doc").dropDuplicates(["doc"])
    repeated = occurring.groupBy("node").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high")
    involved = repeated.select("node").union(labels.select("node")).distinct()
    placed = occurring.join(involved.hint("shuffle_hash"), "node").join(labels.hint("shuffle_hash"), "node", "left")
    placed = placed.withColumn("label", F.coalesce("label", "node")).join(ids.hint("shuffle_hash"), "doc")
    placed = stored(placed.select("id", "doc", "first", "label"), "passage-placed")
    forget(written, labels)
    owner = F.struct(F.col("id").isNull().alias("none"), "id", "doc")
    clusters = placed.groupBy("label").agg(F.min(owner).alias("owner"), F.max(owner).alias("other")).filter("owner.doc != other.doc")
    clusters = stored(clusters.select("label", "owner"), "passage-clusters")
    found = placed.join(clusters.select("label", F.col("owner.doc").alias("kept")), "label")
    found = _extended(found.select("doc", "id", F.struct("first", "label", "kept").alias("p")), docs, id_column, text_column)
    found = found.join(clusters.select("label", F.col("owner.id").alias("cluster")), "label")
    found = found.select("doc", "id", F.struct("first", "start", "end", "kept", "cluster").alias("p"))
    return _spans(found.groupBy("doc").agg(F.first("id").alias("id"), F.collect_list("p").alias("placed")), id_column)
