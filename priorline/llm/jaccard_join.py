"""Documents whose sets of five-word shingles have a Jaccard similarity of three quarters, by parity sketches.

Shingles are hashed into blocks, and the hashes in a block are combined by exclusive or. A block differs between two
sets only if one of their differing shingles falls into it, so similar sets share most blocks; the number of blocks
goes with the size of a set, by octaves. Sets are joined on equal blocks (pigeonhole), candidates are held against a
parity sketch of bits (each shingle flips one bit, so the Hamming distance of two sketches is at most the number of
differing shingles), and what remains is verified on the whole sets.

Within a group of sets with an equal block every set is compared with the group's first one. Groups whose members are
then still in different components are compared with ``LEADS`` more members, drawn by hash, and at last pair by pair where
a pair is not of the group's largest component, where each set may leave out its most crowded blocks: two
similar sets share at least ``SHARED`` of the blocks that are written, so one of the shared ones is not left out. The
number of blocks is chosen such that two sets at exactly the threshold share fewer with a probability below ``MISSED``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorline.llm.components import components
from priorline.llm.words import mix, shingles, signed, word_runs
from priorline.session import stored

#: Two sets link from this many hundredths of their union on.
PERCENT = 75
MISSED = 1e-7
SHARED = 3
#: 64-bit words of the sketch that is compared while groups are joined.
WORDS = 16
#: Up to so many ids are sent to all tasks to pick texts; more are joined by shuffling.
SENT_IDS = 1_000_000
#: Further members that a group with several components is compared with before its pairs are.
LEADS = 3
_SEEDS = mix(np.arange(1, 4097, dtype=np.uint64))


@cache
def blocks_for(size: int, octave: int) -> tuple[int, int]:
    """Blocks of one hashing in an octave of sizes, and how many blocks a set of this size writes there."""
    blocks = max(2, 1 << max(octave - 1, 0))
    ratio = PERCENT / 100
    differing, common = size * (1 - ratio) / ratio, size * ratio
    p = (1 - 1 / blocks) ** differing * (1 - (1 - 1 / blocks) ** common)
    count = SHARED
    while sum(math.comb(count, k) * p**k * (1 - p) ** (count - k) for k in range(SHARED)) > MISSED:
        count += 1
    return blocks, count


def octaves(size: int) -> list[int]:
    """The set's own octave, and the next one if a set there can be similar."""
    own = size.bit_length() - 1
    return [own, own + 1] if 100 * size >= PERCENT << (own + 1) else [own]


def block_keys(found: np.ndarray) -> np.ndarray:
    """Keys of a set's filled blocks: equal for two sets if all shingles in the block are the same."""
    keys = []
    for octave in octaves(len(found)):
        blocks, count = blocks_for(len(found), octave)
        bits = np.uint64(64 - blocks.bit_length() + 1)
        for seed in range(-(-count // blocks)):
            values = found if not seed else np.sort(mix(found ^ _SEEDS[seed]))
            place = values >> bits  # sorted values come block by block
            values, place = (v[place < count - seed * blocks] for v in (values, place))
            if len(values):
                first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                content = np.bitwise_xor.reduceat(mix(values ^ _SEEDS[4095]), first)
                label = place[first] + np.uint64(octave << 40 | seed << 32)
                keys.append(mix(content ^ mix(label)))
    return np.concatenate(keys)


def bit_sketch(found: np.ndarray) -> bytes:
    """Parity of the shingles per bit; four to eight bits a shingle, a power of two in all."""
    bits = max(64, 4 << (len(found).bit_length() - 1))
    flips = np.bincount((mix(found ^ _SEEDS[4094]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()


def fixed_sketch(found: np.ndarray) -> np.ndarray:
    """A parity sketch of ``WORDS`` 64-bit words, whatever the set's size."""
    bits = 64 * WORDS
    flips = np.bincount((mix(found ^ _SEEDS[4093]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").view(np.int64)


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, the longer one folded: a lower bound of the differing shingles."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def set_hash(found: np.ndarray) -> int:
    """One signed number for a whole set; 0 for the empty one."""
    if not len(found):
        return 0
    both = np.array([found.sum(dtype=np.uint64), np.bitwise_xor.reduce(found)]) + np.uint64(len(found))
    return int(mix(both[:1] + mix(both[1:])).view(np.int64)[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def prepare(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Per row: id, a key of id and text, the set's size and its node (a hash of the set), and for the first row with
    a node in a partition its block keys and bit sketch."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    rows = rows.withColumn("row", F.xxhash64("id", "text")).select("id", "row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for first, last, words, at in word_runs(batch.column(2)):
                sizes, nodes, keys, sketches, fixed = [], [], [], [], []
                for k in range(last - first):
                    found = shingles(words[at[k] : at[k + 1]])
                    node = set_hash(found)
                    new = len(found) > 0 and node not in seen
                    seen.add(node)
                    sizes.append(len(found))
                    nodes.append(node)
                    keys.append(signed(block_keys(found)) if new else None)
                    sketches.append(bit_sketch(found) if new else None)
                    fixed.append(fixed_sketch(found) if new else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first),
                        pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                        pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
                        pa.array(fixed, pa.list_(pa.int64())),
                    ],
                    ["id", "row", "size", "node", "keys", "sketch", "bits"],
                )

    return rows.mapInArrow(run, f"id {kind}, row long, size long, node long, keys array<long>, sketch binary, bits array<long>")


def _near(pairs: DataFrame, prepared: DataFrame) -> DataFrame:
    """Pairs a, b whose sizes and bit sketches allow the similarity."""
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    known = prepared.filter("sketch is not null").select("node", "size", "sketch")
    known = stored(known.join(involved, "node", "left_semi").dropDuplicates(["node"]), "join-sketches")
    first = known.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a"))
    second = known.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b"))
    # Sizes first, so that few sketches travel.
    sized = pairs.join(first.drop("sketch_a"), "a").join(second.drop("sketch_b"), "b")
    least, most = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    sized = sized.filter(100 * least >= PERCENT * most).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in ("size_a", "size_b", "sketch_a", "sketch_b")}
            # J >= r bounds the differing shingles by (1 - r) / (1 + r) of both sizes together.
            keep = [
                (100 + PERCENT) * distance(x, y) <= (100 - PERCENT) * (m + n)
                for m, n, x, y in zip(c["size_a"], c["size_b"], c["sketch_a"], c["sketch_b"])
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sized.join(first, "a").join(second, "b").mapInArrow(run, "a long, b long")


def _sets(nodes: DataFrame, prepared: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The whole shingle sets of nodes (column node), once each, as bytes in column found."""
    chosen = prepared.filter("sketch is not null").join(nodes.select("node").distinct(), "node", "left_semi")
    chosen = stored(chosen.groupBy("node").agg(F.min("row").alias("row")), "join-chosen")
    texts = docs.select(F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text_column}`").cast("string")).alias("row"), F.col(f"`{text_column}`").cast("string").alias("text"))
    few = chosen.count() <= SENT_IDS
    texts = texts.join(F.broadcast(chosen) if few else chosen, "row").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words, at in word_runs(batch.column(1)):
                sets = [shingles(words[at[k] : at[k + 1]]).tobytes() for k in range(last - first)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(sets, pa.binary())], ["node", "found"]
                )

    # Rows with equal id and text share a key; one set of each node is enough.
    return stored(texts.mapInArrow(run, "node long, found binary").dropDuplicates(["node"]), "join-sets")


def _verified(pairs: DataFrame, prepared: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Those of the pairs that are similar, by their whole sets."""
    pairs = stored(_near(pairs, prepared), "join-near")
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    sets = _sets(involved, prepared, docs, id_column, text_column)
    first = sets.select(F.col("node").alias("a"), F.col("found").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("found").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64))
                for x, y in zip(batch.column("x"), batch.column("y"))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(second, "b").join(first, "a").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _merged(labels: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """Labels of all member nodes after further links between them."""
    now = _labelled(members.select("node").distinct(), labels)
    ends = links.join(now.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
    ends = ends.join(now.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    joined = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    joined = joined.select(F.col("node").alias("label"), F.col("label").alias("_merged"))
    return stored(now.join(joined, "label", "left").select("node", F.coalesce("_merged", "label").alias("label")), "join-labels")


def _led(members: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Pairs that join many components at once: members of groups with several labels, each with one of another label.

    A group's one is drawn by a hash of its node, the same in all of the node's groups; of the ones of its groups a member
    meets the first drawn. So there is at most one pair for each member, and few different ones are met.
    """
    now = _labelled(members.select("key", "node"), labels)
    drawn = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), F.col("node").alias("a"), F.col("label").alias("own")))
    leads = now.groupBy("key").agg(drawn.alias("lead"), F.min("label").alias("low"), F.max("label").alias("high"))
    met = now.join(leads.filter("low < high").select("key", "lead.*"), "key").filter("label <> own")
    return stored(met.groupBy(F.col("node").alias("b")).agg(F.min(F.struct("draw", "a"))["a"].alias("a")).select("a", "b"), "join-pairs")


def _unsettled(mixed: DataFrame) -> DataFrame:
    """Pairs a, b of different components that share a key and whose sizes and sketches allow the similarity, once each.

    ``mixed`` holds key, node, label, main (the key's largest component), size, bits, and keys (all of the node's here).
    Everything is compared within the join, so that it makes one row for a pair, however many keys the pair shares: at
    the least of them. Members of a group's largest component are compared with the others only.
    """

    def side(x: str) -> DataFrame:
        return mixed.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "size", "bits", "main", "keys")])

    flips = [F.bit_count(F.get("bits_a", F.lit(k)).bitwiseXOR(F.get("bits_b", F.lit(k)))) for k in range(WORDS)]
    near = (
        (F.col("label_a") != F.col("label_b"))
        & ((F.col("label_b") == F.col("main_b")) | (F.col("node_a") < F.col("node_b")))
        & (100 * F.least("size_a", "size_b") >= PERCENT * F.greatest("size_a", "size_b"))
        & ((100 + PERCENT) * reduce(add, flips) <= (100 - PERCENT) * (F.col("size_a") + F.col("size_b")))
        & (F.col("key") == F.array_min(F.array_intersect("keys_a", "keys_b")))
    )
    others = side("a").filter("label_a != main_a").withColumnRenamed("key", "_key")
    met = others.join(side("b"), (F.col("_key") == F.col("key")) & near)
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, row (a key of id and text), size, and label, equal for all rows of a component.

    Rows with equal sets have one label without being compared. A row without words (null or empty text) has size 0
    and a null label. Null ids and repeated rows are rows like others; an empty table gives an empty result.
    """
    prepared = stored(prepare(docs, id_column, text_column), "join-prepared")
    written = prepared.filter("keys is not null").select("node", F.explode("keys").alias("key"))
    crowded = written.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead < last")
    members = stored(written.join(crowded.select("key", "lead"), "key").distinct(), "join-members")

    pairs = stored(members.filter("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "join-pairs")
    links = stored(_verified(pairs, prepared, docs, id_column, text_column), "join-links")
    labels = stored(components(links), "join-labels")

    # Groups that still hold several components are compared with a few more of their members first.
    for turn in range(LEADS):
        pairs = _led(members, labels, turn)
        if not pairs.limit(1).count():
            break
        labels = _merged(labels, members, stored(_verified(pairs, prepared, docs, id_column, text_column), "join-links"))

    labelled = _labelled(members, labels)
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("key").agg(
        F.sum("n").alias("crowd"), F.count("*").alias("labels"), F.max(F.struct("n", "label"))["label"].alias("main")
    )
    ranked = labelled.join(groups, "key").withColumn(
        "place", F.row_number().over(Window.partitionBy("node").orderBy(F.col("crowd").desc(), "key"))
    )
    # The first member of a group has been compared with all others.
    mixed = ranked.filter(f"place >= {SHARED} and labels > 1 and node != lead").select("key", "node", "label", "main")
    known = prepared.filter("sketch is not null").select("node", "size", "bits")
    known = known.join(mixed.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    mixed = mixed.withColumn("keys", F.collect_list("key").over(Window.partitionBy("node")))  # a set's own blocks
    mixed = stored(mixed.join(known, "node"), "join-mixed")
    rest = stored(_unsettled(mixed), "join-pairs")
    more = stored(_verified(rest, prepared, docs, id_column, text_column), "join-links")
    labels = _merged(labels, members, more)
    rows = prepared.select("id", "row", "size", F.when(F.col("size") > 0, F.col("node")).alias("node"))
    rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return rows.select("id", "row", "size", "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: the size of its shingle set and the smallest doc_id of its component (its own without words)."""
    found = stored(classes(docs), "join-classes")
    least = found.filter("label is not null").groupBy("label").agg(F.min("id").alias("_least"))
    return found.join(least, "label", "left").select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("_least", "id").alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each component: the one with the smallest doc_id stays (null ids last).

    Documents without words all stay. Columns are kept as they are, whatever their names; of rows with equal id and text
    one stays; an empty table stays empty.
    """
    found = classes(docs).filter("label is not null")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("kept"))
    kept = first.select(F.col("kept.row").alias("key"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"),
        F.xxhash64("doc_id", F.col("text").cast("string")).alias("key"),
        (~F.rlike(text, F.lit(r"[^\x20\x09-\x0D]"))).alias("wordless"),
    )
    once = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    unique = whole.filter("not wordless").withColumn("turn", once).filter("turn = 1").join(kept, "key", "left_semi")
    return unique.select("whole").union(whole.filter("wordless").select("whole")).select("whole.*")
