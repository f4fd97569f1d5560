"""Periodic runs against a scan of every period."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from priorline.llm.periodic_runs import Settings, periodic_runs, run_digests, runs, runs_of_texts


def every_period(words, least, repeats):
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items() if n >= max(least, repeats * q)), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least, repeats", [(24, 3), (2, 2), (6, 2), (5, 4)])
def test_runs_equal_a_scan_of_every_period(least, repeats):
    draw = random.Random(least)
    for _ in range(800):
        words = [draw.randrange(draw.choice([1, 2, 3, 8])) for _ in range(draw.randrange(60))]
        if words and draw.random() < 0.6:
            a, p = draw.randrange(len(words)), draw.randrange(1, 9)
            words = [w if i < a else words[a + (i - a) % p] if a + (i - a) % p < len(words) else w for i, w in enumerate(words)]
        s, expected = Settings(least, repeats), every_period(words, least, repeats)
        text = " ".join(map(str, words)).encode()
        assert runs_of_texts([text, b"", b" 0 1 0 1 0 1", text], s)[1][::3] == [expected, expected]
        assert runs(np.array(words, int), s) == expected


def test_long_repetition():
    assert runs(np.zeros(30_000, int)) == [(0, 30_000, 1)]
    assert runs(np.array(list(range(7)) * 3000)) == [(0, 21_000, 7)]


def expected_row(doc_id, text):
    words = (text or "").encode().split()
    n, crc = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if crc % 10 == 0 and n:
        a, p = crc // 10 % n, 1 + (n - crc // 10 % n) // (3 + crc // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = every_period(words, 24, 3)
    gone = {k for s, n_, q in found for k in range(s + q, s + n_)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n_},{q}\n" for s, n_, q in found)
    rest = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(found), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())


def test_query_equals_a_plain_version(spark):
    draw = random.Random(5)
    texts = {}
    for i in range(400):
        words = [draw.choice(["a", "b", "é x", "Zz", "c\x1fd", str(draw.random())]) for _ in range(draw.randrange(150))]
        texts[i] = draw.choice([" ", "\n", "\t\x0b "]).join(words)
    given = [*texts.items(), (1000, None), (1001, ""), (None, "a " * 40), (1002, " \n"), (7, texts[7]), (1003, "x y " * 5000)]
    docs = spark.createDataFrame([(i, t, t, 1) for i, t in given], "doc_id long, text string, runs string, _n int").repartition(3)
    got = sorted((tuple(r) for r in run_digests(docs).collect()), key=str)
    assert got == sorted((expected_row(i, t) for i, t in given), key=str)
    assert sum(r[1] > 0 for r in got) > 20
    assert run_digests(docs.limit(0)).collect() == []


def test_real_outputs(spark):
    docs = spark.createDataFrame([("k", "go " + "la di " * 20 + "end")], "doc_id string, text string")
    row = periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 40, 2)] and row.collapsed == "go la di end"
