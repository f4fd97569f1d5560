"""Similar texts and vectors, nearest vectors and address rules against plain versions."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorline.llm import embedding_dedup, jaccard_join, nearest, passage_dedup, url_rules
from priorline.llm.components import components

DOCS = "doc_id long, text string"


class Groups:
    def __init__(self, n):
        self.parent = list(range(n))

    def of(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        self.parent[self.of(a)] = self.of(b)


def test_components(spark):
    random.seed(2)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)]
    links += [(5000, 5000 + k) for k in range(1, 200)]
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    groups, place = Groups(len(nodes)), {x: k for k, x in enumerate(nodes)}
    for a, b in links:
        if a != b:
            groups.join(place[a], place[b])
    least = {}
    for x in nodes:
        least.setdefault(groups.of(place[x]), x)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: least[groups.of(place[x])] for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def word_sets(texts):
    out = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        runs = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        out.append(runs if len(words) >= 5 else {tuple(words)} if words else set())
    return out


def plain_classes(rows):
    sets, groups = word_sets([t for _, t in rows]), Groups(len(rows))
    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            groups.join(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if sets[k] and i is not None:
            least[groups.of(k)] = min(least.get(groups.of(k), i), i)
    return [(i, len(sets[k]), least.get(groups.of(k), i) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def near_copies():
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    hot, texts = " ".join(random.choices(words, k=40)), []
    for _ in range(40):
        base = random.choices(words, k=random.choice([3, 5, 6, 7, 8, 9, 12, 20, 40, 60, 100, 300]))
        for _ in range(random.randint(1, 8)):
            t = list(base)
            for _ in range(int(len(t) * random.random() * 0.08)):
                t[random.randrange(len(t))] = random.choice(words)
            t = t[: max(1, len(t) - random.randint(0, len(t) // 4))] if random.random() < 0.3 else t
            texts.append(" ".join(t) + ("\n" + hot if random.random() < 0.3 else ""))
    texts += ["", None, "  \t", "one", "One", "one two three four", "one two three four"]
    rows = [(i * 3 % len(texts) if i != 17 else None, t) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3]]


def test_jaccard_join_finds_every_link(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit(1), "node": F.lit("x")})
    want = plain_classes(rows)
    assert sorted(map(str, (tuple(r) for r in jaccard_join.near_duplicates(df).collect()))) == sorted(map(str, want))
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    assert kept.count() == len({w[2] for w in want if w[1]}) + sum(w[1] == 0 for w in want)
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_a_pair_of_many_shared_blocks_is_one_row(spark):
    """Twelve sets of components of their own that share eight blocks: 66 pairs, not 8 * 66."""
    rows = [(key, node, node, -1, 40, [0] * 16, list(range(8))) for node in range(12) for key in range(8)]
    rows += [(key, 50 + node, -1, -1, 40, [0] * 16, list(range(8))) for node in range(2) for key in range(8)]
    shape = "key long, node long, label long, main long, size long, bits array<long>, keys array<long>"
    found = [tuple(r) for r in jaccard_join._unsettled(spark.createDataFrame(rows, shape)).collect()]
    nodes = [*range(12), 50, 51]
    assert sorted(found) == [(a, b) for a, b in itertools.combinations(nodes, 2) if (a, b) != (50, 51)]


def test_other_columns_of_the_kept_documents_stay(spark):
    rows = near_copies()[:60]
    extra = {c: F.lit(7) for c in ("__row", "__turn", "key", "turn", "whole", "wordless", "label", "keys")}
    df = spark.createDataFrame(rows, DOCS)
    wide = jaccard_join.one_of_each(df.withColumns(extra))
    assert sorted(map(str, wide.select("doc_id", "text").collect())) == sorted(map(str, jaccard_join.one_of_each(df).collect()))
    assert wide.filter("__row <> 7 or key <> 7 or turn <> 7").count() == 0


@pytest.mark.parametrize("leads, sent", [(3, 1_000_000), (0, 0)])
def test_a_crowded_group_of_near_copies_is_joined_whole(spark, monkeypatch, leads, sent):
    """Copies of one text with a fifth of it replaced: few are similar to the first, most to some other one."""
    monkeypatch.setattr(jaccard_join, "LEADS", leads)
    monkeypatch.setattr(jaccard_join, "SENT_IDS", sent)
    g = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(700):
        t = list(base)
        for k in g.sample(range(4), g.randrange(4)):
            at = 15 * k + g.randrange(3)
            t[at : at + 2] = [f"x{g.randrange(3)}", f"y{g.randrange(2)}"]
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(g.choices(base, k=50))) for i in range(200)]
    got = [tuple(r) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5)).collect()]
    assert sorted(got) == sorted(plain_classes(rows))


def test_bit_sketches_bound_the_difference_from_below():
    g = np.random.default_rng(1)
    for n, m in ((5, 6), (40, 50), (300, 310), (500, 600)):
        both = np.unique(g.integers(1, 2**63, n + m).astype(np.uint64))
        a, b = both[: n], both[n // 4 : n // 4 + m]
        differing = len(np.setxor1d(a, b))
        assert jaccard_join.distance(jaccard_join.bit_sketch(a), jaccard_join.bit_sketch(b)) <= differing


def test_passages_are_found_wherever_they_stand(spark):
    random.seed(2)
    some = lambda n: random.choices([f"v{i}" for i in range(3000)], k=n)
    passages, planted, rows = [some(random.randint(51, 90)) for _ in range(30)], [], []
    for i in range(250):
        text = some(random.choice([3, 30, 80, 200, 500]))
        if i % 3 == 0:
            k, at = random.randrange(30), random.randrange(len(text) + 1)
            planted.append((i, k))
            text = text[:at] + passages[k] + text[at:]
        rows.append((i, random.choice([" ", "\n"]).join(text)))
    times = [k for _, k in planted]
    want = {i for i, k in planted if times.count(k) > 1}
    df = spark.createDataFrame([*rows, (None, None), (700, ""), rows[1]], DOCS).withColumn("first", F.lit(0))
    got = passage_dedup.repeated_passages(df).toPandas()
    assert set(got.doc_id) == want
    kept = {min(i for i, k in planted if k == one) for one in set(times)}
    assert set(got[~got.removed].doc_id) <= kept | {i for i in want if times.count(dict(planted)[i]) > 1 and i in kept}
    assert passage_dedup.repeated_passages(df.limit(0)).count() == 0


def test_a_longer_passage_is_kept_where_a_shared_part_of_it_is_removed(spark):
    random.seed(6)
    some = lambda n: [f"x{random.randrange(10**9)}" for _ in range(n)]
    a, b = some(120), some(120)
    texts = {1: some(60) + a + some(60), 2: some(50) + a + b + some(50), 3: some(70) + a + b + some(30)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], DOCS)
    left = {i: list(t) for i, t in texts.items()}
    for r in passage_dedup.repeated_passages(df).collect():
        if r.removed:
            left[r.doc_id][r.first_word : r.end_word] = [None] * (r.end_word - r.first_word)
    assert set(a) <= set(left[1]) and set(b) <= set(left[2])
    assert sum(w in set(a) for w in left[2]) < 60 and sum(w in set(a + b) for w in left[3]) < 60


def edited_paragraphs():
    """Sets of 20 words each and copies with one or two edits, some of words that come again and again."""
    random.seed(8)
    out = []
    for k in range(4000):
        period = random.choice([20, 20, 20, 3, 8, 11, 12, 13, 14, 15])
        base = [f"y{random.randrange(10**9)}" for _ in range(period)]
        words = (base * 20)[:60]
        for _ in range(2):
            at, t = random.randint(0, 6), list(words)
            for _ in range(random.choice([0, 1, 1, 2])):
                t[at + random.choice([0, 1, 2, 3, 9, 16, 17, 18, 19])] = f"z{random.randrange(10**9)}"
            out.append((k, t[at : at + 20]))
    return out


def test_similar_paragraphs_always_share_a_key():
    place = {}
    number = lambda w: place.setdefault(w, len(place))
    words = np.array([[number(w) for w in t] for _, t in edited_paragraphs()], np.uint64)
    words = passage_dedup.mix(words + np.uint64(7))
    found = np.array([passage_dedup.windows(w) for w in words])
    double = [passage_dedup.pairs(w) for w in words]
    loose = np.array([len(np.unique(d)) < len(d) for d in double])
    own, keys = passage_dedup.band_keys(found, loose, 75, 2)
    by = {k: set() for k in range(len(found))}
    for k, key in zip(own.tolist(), keys.tolist()):
        by[k].add(key)
    links = uneven = 0
    for k in range(0, len(found), 2):
        a, b = set(found[k].tolist()), set(found[k + 1].tolist())
        if 100 * len(a & b) >= 75 * len(a | b):
            links += 1
            uneven += len(a) != len(b)
            assert by[k] & by[k + 1]
    assert links > 500 and uneven > 20


def test_texts_of_a_run_are_handled_together(monkeypatch):
    random.seed(17)
    texts = ["", None, "one two", *[" ".join(random.choice(("a", f"w{random.randrange(300)}")) for _ in range(n % 97)) for n in range(400)]]
    column = passage_dedup.pa.array(texts)
    calls = []
    of_pairs = passage_dedup.pairs
    monkeypatch.setattr(passage_dedup, "pairs", lambda words: calls.append(1) or of_pairs(words))
    (_, _, words, at), = passage_dedup.word_runs(column)
    first, text = passage_dedup.anchors(words, at)
    nodes = passage_dedup.nodes_of(words, first)
    assert len(calls) == 1
    for k in range(len(texts)):
        alone, found, _ = passage_dedup.paragraphs(words[at[k] : at[k + 1]])
        own = text == k
        assert (first[own] - at[k]).tolist() == alone.tolist()
        mixed = passage_dedup.mix(found.sum(1, dtype=np.uint64) + passage_dedup.mix(np.bitwise_xor.reduce(found, axis=1)))
        assert nodes[own].tolist() == mixed.tolist()
    assert len(set(text.tolist())) > 100


def test_sets_and_surroundings_are_compared_as_by_hand():
    rng = np.random.default_rng(5)
    binary = lambda rows: passage_dedup.pa.array([np.array(r, np.uint64).tobytes() for r in rows], "binary")
    sets = [sorted(rng.choice(18, rng.integers(1, 17), replace=False).tolist()) for _ in range(2000)]
    x, y = sets[::2], sets[1::2]
    want = [100 * len({*a} & {*b}) >= 75 * len({*a} | {*b}) for a, b in zip(x, y)]
    assert passage_dedup.similar(binary(x).slice(3), binary(y).slice(3), 75).tolist() == want[3:]
    assert 10 < sum(want) < 990
    words = lambda: rng.integers(0, 2, rng.integers(10, 14)).tolist()
    rows = [[words() for _ in range(4)] for _ in range(1000)]
    rows = [[a, list(a) if k % 3 else b, c, list(c) if k % 5 else d] for k, (a, b, c, d) in enumerate(rows)]

    def alike(m, n):
        size = min(len(m), len(n))
        same = [m[k] == n[k] for k in range(size)]
        if not same[9]:
            return max((k + 1 for k in range(10) if same[k]), default=0) - 10
        return next((k - 10 for k in range(10, size) if not same[k]), size - 10)

    got = passage_dedup.reach(*(binary(c) for c in zip(*rows)))
    for (a, b, c, d), *found in zip(rows, *(g.tolist() for g in got)):
        both = [alike(a, b), alike(c, d)]
        assert found == (both if min(both[0], 0) + min(both[1], 0) >= -10 else [0, 0])


def test_near_copies_in_one_crowded_group_are_all_linked(spark):
    random.seed(9)
    word = lambda: f"q{random.randrange(10**9)}"
    template, at = [word() for _ in range(60)], 0
    rows = []
    for k in range(300):
        text = list(template)
        for at in (21, 27, 33, 39):
            text[at] = word()
        rows += [(2 * k, text), (2 * k + 1, [*text[:44], word(), *text[45:]])]
    rows = [(i, [word() for _ in range(30)] + t + [word() for _ in range(30)]) for i, t in rows]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], DOCS)
    where = {}
    for i, t in rows:
        words = next(passage_dedup.word_runs(passage_dedup.pa.array([" ".join(t)])))[2]
        for first, found in zip(*passage_dedup.paragraphs(words)[:2]):
            where.setdefault(frozenset(found.tolist()), set()).add((i, int(first)))
    sets = list(where)
    groups = Groups(len(sets))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            groups.join(a, b)
    docs = {}
    for k, one in enumerate(sets):
        docs.setdefault(groups.of(k), set()).update(where[one])
    want = {p: min(c)[0] for c in docs.values() if len({i for i, _ in c}) > 1 for p in c}
    got = passage_dedup.repeated_passages(df).collect()
    assert len(set(want.values())) > 100
    for (i, first), least in want.items():
        spans = [r for r in got if r.doc_id == i and r.first_word < first + 20 and first < r.end_word]
        assert any(r.cluster == least and r.removed == (i != least) for r in spans) or any(not r.removed for r in spans)
    assert {i for i, _ in want} == {r.doc_id for r in got}


def test_spans_reach_the_ends_of_the_passage(spark):
    random.seed(10)
    some = lambda n: [f"u{random.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for k in range(60):
        passage = some(random.randint(51, 120))
        for i in (2 * k, 2 * k + 1):
            first = random.randint(30, 90)
            rows.append((i, " ".join(some(first) + passage + some(random.randint(30, 90)))))
            want[i] = (first, first + len(passage))
    got = passage_dedup.repeated_passages(spark.createDataFrame([*rows, rows[5]], DOCS)).collect()
    assert len(got) >= 116 and len({r.doc_id for r in got}) == len(got)
    assert all((r.first_word, r.end_word) == want[r.doc_id] for r in got)


def plain_vectors(rows, threshold=0.98):
    fit = [v is not None and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    groups, links = Groups(len(rows)), [0] * len(rows)
    for a, b in itertools.combinations([k for k, ok in enumerate(fit) if ok], 2):
        x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
        if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
            groups.join(a, b)
            links[a] += 1
            links[b] += 1
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[groups.of(k)] = min(least.get(groups.of(k), r[0]), r[0])
    return [(r[0], links[k], least.get(groups.of(k)), r[0] is not None and r[0] == least.get(groups.of(k))) for k, r in enumerate(rows)]


def vectors():
    g = np.random.default_rng(3)
    hot = g.standard_normal(16)
    rows = [(i, list(map(float, g.standard_normal(16) if i % 3 else hot + 0.05 * g.standard_normal(16))), int(i % 2)) for i in range(300)]
    nan, inf = float("nan"), float("inf")
    odd = [[0.0] * 16, None, [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 0.0, 0.0], [1e30] * 16]
    rows += [(400 + k, v, 1) for k, v in enumerate(odd)]
    return rows + [(500, rows[0][1], None), (None, rows[0][1], 0), rows[0], (600, rows[3][1], 1)]


VECTORS = "vec_id long, embedding array<double>, label int"


def test_embedding_links_and_recall(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).withColumn("node", F.lit(1))
    got = {tuple(r) for r in embedding_dedup.near_duplicates(df).collect()}
    want = plain_vectors(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in set(want))
    assert there and there * 0.99 <= found <= there
    assert {r[0] for r in got if r[1] == 0} >= {401, 402, 403, 404}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_around_a_common_mean():
    g = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    mean = unit(g.standard_normal(64))
    a = unit(0.9 * mean + 0.19**0.5 * unit(g.standard_normal((3000, 64))))
    aside = g.standard_normal(a.shape)
    aside = unit(aside - (aside * a).sum(1, keepdims=True) * a)
    b = 0.98 * a + (1 - 0.98**2) ** 0.5 * aside
    width, tables = embedding_dedup.tables_for(300_000, 0.98, embedding_dedup.MISSED)
    models = [embedding_dedup.learn(a, seed) for seed in range(-(-width * tables // 64))]
    x, y = (embedding_dedup.codes(v, models)[:, : width * tables].reshape(-1, tables, width) for v in (a, b))
    assert (x == y).all(2).any(1).mean() >= 0.99


def test_nearest_recall_and_scores(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).withColumn("rank", F.lit(1))
    got = nearest.nearest(df, every=20).toPandas()
    good = [(i, np.array(v)) for i, v, _ in rows if i is not None and v is not None and len(v) == 16 and any(v)]
    hits = total = 0
    for q, part in got.groupby("query_id"):
        if q not in dict(good):
            continue
        own = dict(good)[q]
        order = sorted((float(np.sqrt(((v - own) ** 2).sum())), i) for i, v in good if i != q)[:10]
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, len(order) + 1))
        hits += len({i for _, i in order} & set(part.vec_id))
        total += len(set(i for _, i in order))
        assert np.allclose(part.score.iloc[0], order[0][0], rtol=1e-12)
    assert total and hits / total >= 0.99
    assert nearest.nearest(df.limit(0)).count() == 0


def test_address_rules(spark):
    urls = ["https://a.b.example.org/es/x?q#f", "http://EXAMPLE.org/en/17", "http://example.org/en/2", "http://x.com/fr/1", "http://x.com/de/1",
            "http://notexample.org/es/1", "ftp://example.org", "no scheme", None, "://", "http://É.Org/", "x://a://b/es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit(2))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, url_rules.given_rules(spark)).collect()}
    assert got[0] == ("a.b.example.org", "/es/x", "example.org/es/", "block")
    assert [got[k][2] for k in (1, 2, 3, 4, 5)] == ["example.org/en/1", "org/", "com/fr/", "com/de/", "org/"]
    assert got[6] == ("example.org", "", None, "allow") and got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10] == ("É.org", "/", "org/", "allow") and got[11] == ("a:", "//b/es/", None, "allow")
    assert url_rules.judge(df.limit(0), url_rules.given_rules(spark)).count() == 0


def test_scratch_tables_of_passages_go_after_their_use(spark):
    from pathlib import Path

    from priorline.session import scratch_root

    random.seed(9)
    words = [f"w{i}" for i in range(500)]
    same = random.choices(words, k=80)
    texts = [" ".join(random.choices(words, k=60) + same + random.choices(words, k=40)) for _ in range(6)]
    df = spark.createDataFrame([*enumerate(texts), (2, texts[2])], DOCS)
    folder = Path(scratch_root(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    found = passage_dedup.repeated_passages(df).collect()
    assert sorted(r.doc_id for r in found) == list(range(6)) and [r.doc_id for r in found if not r.removed] == [0]
    left = {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before}
    assert not left & {"passage-members", "passage-pairs", "passage-sets", "passage-links", "passage-paragraphs", "passage-labels"}
