"""Token counts, packing, personal data, quality and mixing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from priorline.llm import mixing, packing, pii, quality, token_counts

DOCS = "doc_id long, text string"
EDGE = [(None, None), (1, ""), (2, " \t\n"), (3, "one"), (3, "one"), (None, "two words"), (4, "x" * 30_000), (5, "a <|endoftext|> b  c\n\n d's 're")]
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


PIECES = st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "'", "'s", "'re", "é", "1", "!", "***", "the", "ing", "\u00a0", "日本", "<|endoftext|>", "<|end"]))


@settings(max_examples=300, deadline=None)
@given(PIECES.map("".join) | st.text(max_size=12))
def test_steps_count_the_tokens_of_every_prefix(text):
    steps = token_counts.counter(token_counts.MODEL).steps(text)
    assert len(steps) == len(text)
    for i in range(len(text) + 1):
        assert token_counts.tokens_at(steps, i) == count(text[:i])


def test_latin_pattern_splits_as_the_general_one():
    c = token_counts.counter(token_counts.MODEL)
    for x in range(0x250):
        text = f"a{chr(x)}a 1{chr(x)}1 .{chr(x)}."
        assert c.units.findall(text) == c.latin_units.findall(text)


def test_token_counts_and_prefix_questions(spark):
    df = spark.createDataFrame(EDGE, DOCS).withColumn("steps", F.lit(1)).withColumn("id", F.lit("x"))
    got = token_counts.token_counts(df).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted((len((t or "").encode()), count(t or "")) for _, t in EDGE)
    assert [r.over_limit for r in got if r.doc_id == 4] == [count("x" * 30_000) > 512]
    table = token_counts.prefix_counts(df.filter("doc_id = 5"))
    asked = table.select(token_counts.tokens_of_prefix("steps", F.lit(4)), token_counts.prefix_within("steps", F.lit(2))).first()
    text = EDGE[-1][1]
    assert asked[0] == count(text[:4])
    assert asked[1] == max(i for i in range(len(text) + 1) if count(text[:i]) <= 2)
    assert token_counts.token_counts(df.limit(0)).count() == 0


def test_packing_is_whole_gapless_and_nearly_without_padding(spark):
    random.seed(4)
    data = EDGE + [(100 + i, " ".join(random.choice(["the", "of", "blue", "zq"]) for _ in range(random.randint(0, 2500)))) for i in range(200)]
    data += [(1000 + i, "x " * 700) for i in range(150)]  # one length holds a third of all
    got = packing.pack(spark.createDataFrame(data, DOCS)).toPandas()
    by_sequence = got.sort_values(["sequence_id", "offset"])
    assert (by_sequence.groupby("sequence_id").length.cumsum() - by_sequence.length == by_sequence.offset).all()
    sizes = got.groupby("sequence_id").length.sum()
    assert (sizes <= 1024).all() and (sizes < 1024).sum() <= 1
    assert got.length.sum() == sum(count(t or "") + 1 for _, t in data)
    for i, text in data:
        if i is not None and i != 3:
            ids = np.array([*LIBRARY.encode(text, add_special_tokens=False).ids, 0], "<u4")
            pieces = got[got.doc_id == i].sort_values("start")
            assert pieces.length.sum() == len(ids) == pieces.doc_tokens.iloc[0]
            for p in pieces.itertuples():
                assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_plan_fills_windows_for_hot_and_few_lengths():
    for lengths in ({700: 10**6}, {1: 3}, {512: 7, 1023: 5, 1: 2}, {}, {n: 40 for n in range(1, 1024, 7)}):
        histogram = np.zeros(1024, np.int64)
        for n, c in lengths.items():
            histogram[n] = c
        made = packing.plan(histogram, 1024)
        total = int((np.arange(1024) * histogram).sum())
        assert made.windows == -(-total // 1024) and made.padding == -total % 1024


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(n - 9 * (n > 9) for n in doubled) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
}
PARTS = ["a", "1", "@", ".", "b.c", "1.2.3.4", "+1", "-", " ", "(", "_", "4111111111111111", "4111 1111 1111 1111", "999", "é",
         "+1 (988) 555-2485", "GB82 WEST 1234 5698 7654 32", "ssn ", "123-45-6789", "x@y.z", "01.002.3.0004"]


def test_base_spans_are_those_of_a_plain_search(spark):
    random.seed(3)
    data = [(i, "".join(random.choice(PARTS) for _ in range(random.randint(0, 12)))) for i in range(600)]
    data += [(None, None), (-1, "1" * 20_000), (-2, "a." * 10_000 + "@b.c"), (-3, "x@y.z " * 500)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(data, DOCS).withColumn("row", F.lit(1))).collect()}
    for i, text in data:
        spans = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m.group())] for k, (p, ok) in BASE.items()}
        flat = ",".join(f"{k}:{a}:{b}" for k, found in spans.items() for a, b in found)
        assert [got[i][f"n_{k}"] for k in BASE] == [len(v) for v in spans.values()], text
        assert got[i].base_sha256 == hashlib.sha256(flat.encode()).hexdigest()
        assert got[i].spans.startswith(flat)


def test_further_kinds_and_marks(spark):
    texts = ["pay GB82 WEST 1234 5698 7654 32 now", "GB83 WEST 1234 5698 7654 32", "my ssn 123-45-6789", "part 123-45-6789",
             "call +1 (319) 555-5132 4524132264652876", "mail x@y.z", None]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("lang", F.lit("en"))
    spans = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    assert [spans[k].split(":")[0] for k in (0, 2, 5)] == ["iban", "ssn", "email"] and spans[1] == spans[3] == spans[6] == ""
    marked = pii.redact(df)
    assert marked.columns == df.columns
    text = {r.doc_id: r.text for r in marked.collect()}
    assert text[0] == "pay <IBAN> now" and text[1] == texts[1] and text[5] == "mail <EMAIL>" and text[6] is None
    assert "4524132264652876" not in text[4]


def test_secrets_need_their_shape_and_a_word(spark):
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'set token = "{secret}" now', f"commit {secret} merged", "the token abcdefghijklmnopqrstuvwxyz is none", f"API_KEY={secret[:22]}",
             "key " + "a1" * 400, "token 1234567890123456789012"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    found = {r.doc_id: (r.spans, r.n_spans) for r in pii.personal_data(df).collect()}
    assert found[0] == (f"secret:13:{13 + len(secret)}", 1) and [found[k][1] for k in (1, 2, 4)] == [0, 0, 0]
    assert "secret" not in found[5][0]
    text = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert text[0] == 'set token = "<SECRET>" now' and text[1] == texts[1] and text[2] == texts[2]
    assert pii.personal_data(df.limit(0)).collect() == []


def test_quality_learns_from_labels_that_are_not_held_out(spark):
    random.seed(1)
    good = lambda: " ".join(random.choice(["river", "stone", "light", "green", "over"]) for _ in range(40))
    bad = lambda: " ".join(random.choice(["CLICK!!", "FREE!!", "NOW!!"]) for _ in range(40))
    data = [(i, good() if i % 4 else bad()) for i in range(300)]
    docs = spark.createDataFrame(data + [(None, None), (900, "")], DOCS).withColumn("score", F.lit(0))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in data] + [(None, 1), (5, None)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert all(rows[i].predicted == int(i % 4 > 0) for i, _ in data)
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in data)
    assert 0 <= rows[900].score <= 1 and rows[None].score == rows[900].score
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id % 4 = 0 and doc_id < 300").count() == 0
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    # Other columns, repeats of a learned document and empty tables change nothing.
    extra = {c: F.lit(7) for c in ("_id", "_label", "_draw", "_all", "one", "cell", "margin", "h")}
    more = docs.union(docs.filter("doc_id = 8")).withColumns(extra)
    again = {(r.doc_id, round(r.score, 9)) for r in quality.quality(more, labels.withColumns(extra)).collect()}
    assert again == {(r.doc_id, round(r.score, 9)) for r in rows.values()}
    both = quality.accepted(more, labels.withColumns(extra))
    assert both.columns == more.columns and both.select(*docs.columns).exceptAll(kept).count() == 0
    assert quality.accepted(docs.limit(0), labels).count() == 0 and quality.quality(docs.limit(0), labels).count() == 0


def plain_ftrl(rows, s):
    """Weights by cell, one update after the other, in plain numbers; rows are (label, {cell: value})."""
    z, n = {}, {}

    def weight(c):
        v = z.get(c, 0.0)
        return 0.0 if abs(v) <= s.l1 else -(v - math.copysign(s.l1, v)) / ((s.beta + n[c] ** 0.5) / s.alpha + s.l2)

    for _ in range(s.passes):
        for label, cells in rows:
            w = {c: weight(c) for c in cells}
            p = 1 / (1 + math.exp(-sum(w[c] * v for c, v in cells.items())))
            for c, v in cells.items():
                g = (p - label) * v
                sigma = ((n.get(c, 0.0) + g * g) ** 0.5 - n.get(c, 0.0) ** 0.5) / s.alpha
                z[c], n[c] = z.get(c, 0.0) + g - sigma * w[c], n.get(c, 0.0) + g * g
    return weight


def test_learning_equals_plain_updates():
    random.seed(2)
    s = quality.Settings(cells=1 << 10)
    texts = [" ".join(random.choices(["a", "bb", "c", "dd", "e"], k=random.randrange(12))) for _ in range(60)]
    labels = [int("bb" in t.split()) for t in texts]
    rows = []
    for text, label in zip(texts, labels):
        (_, _, cell, at), = quality.features(pa.array([text]), s.cells)
        counts = Counter(cell[at[0] : at[1]].tolist())
        rows.append((label, {c: v / max(1, at[1]) ** 0.5 for c, v in counts.items()} | {s.cells: 1.0}))
    weights, plain = quality.learn(pa.array(texts), np.array(labels), s), plain_ftrl(rows, s)
    assert all(abs(weights[c] - plain(c)) < 1e-9 for _, cells in rows for c in cells)
    assert np.count_nonzero(weights) <= len({c for _, cells in rows for c in cells})


def water_filled(sizes, weights, repeats=3):
    capped = set()
    while True:
        free = [s for s in sizes if s not in capped]
        left = sum(sizes.values()) - sum(repeats * sizes[s] for s in capped)
        level = left / sum(weights[s] for s in free) if free else 0
        over = [s for s in free if level * weights[s] > repeats * sizes[s]]
        if not over:
            return {s: repeats * sizes[s] if s in capped else level * weights[s] for s in sizes}
        capped |= set(over)


def test_mixing_meets_capped_targets(spark):
    random.seed(6)
    data = [(i, " ".join(["w"] * random.randint(0, 60)), random.choice(["a", "a", "a", "a", "b", "c"])) for i in range(500)]
    data += [(1000, "w w w", "tiny"), (1001, "w w", None), (1002, None, "void"), (None, "w", "b"), (7, data[7][1], data[7][2])]
    docs = spark.createDataFrame(data, DOCS + ", source string").withColumn("size", F.lit("x")).withColumn("block", F.lit(1))
    got = mixing.mixed_documents(docs)
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mixed_documents(docs.repartition(7)).collect()))
    sizes, named = {}, docs.select("doc_id", "source").distinct()
    for _, text, source in data:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = water_filled({s: n for s, n in sizes.items() if n}, {s: 1 + k % 3 for k, s in enumerate(order)})
    rows = got.toPandas()
    assert len(rows) == len(data) and (rows.taken <= 3 * rows["size"]).all()
    taken = rows.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert sorted(round(t, 6) for t in want.values()) == sorted(round(t, 6) for t in taken.target if t)
    assert ((taken.target - taken.taken).abs() <= 0.5).all()
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.filter("text is null").count() == 0
    extra = {c: F.lit(7) for c in ("copies", "_id_", "_source_", "_size_", "_turn_", "whole", "__position", "rank")}
    wide = mixing.mixed_rows(docs.withColumns(extra))
    assert wide.select(*docs.columns).exceptAll(mixed).count() == 0 == wide.filter("copies <> 7 or _turn_ <> 7").count()
    assert wide.count() == mixed.count()
    assert named.count() and mixing.mixed_documents(docs.limit(0)).count() == 0 and mixing.mixed_rows(docs.limit(0)).count() == 0


@pytest.mark.parametrize("slots", [5, 100, 3000])
def test_golden_ratio_slots_reach_every_quota(spark, slots):
    sources = spark.createDataFrame([(None, 1, slots * 10, float(slots * 10)), ("b", 2, 3, 3.0)], "source string, rank int, source_size long, target double")
    got = mixing.schedule(sources, 10).groupBy("rank").agg(F.sum("taken").alias("n")).collect()
    assert {r["rank"]: r.n for r in got} == {1: slots * 10, 2: 3}
