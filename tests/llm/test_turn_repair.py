"""Repair of conversations against all edit scripts, and its query against a plain version."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import pytest

from priorline.llm import turn_repair
from priorline.llm.turn_repair import repair, repair_digests, structure


def all_scripts(kinds, insertions=2):
    best = None

    def go(i, cost, audit, out, left):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(kinds) and re.fullmatch("(s?(ua)+)?", out):
            best = min(best or (cost, audit), (cost, audit))
        for letter in "ua" * (left > 0):
            go(i, cost + 5, audit + "I", out + letter, left - 1)
        if i < len(kinds):
            go(i + 1, cost + 2, audit + "D", out, left)
            if kinds[i] != "-":
                extra = 5 * kinds[i].isupper()
                go(i + 1, cost + extra, audit + "K", out + kinds[i].lower(), left)
                for letter in "ua":
                    go(i + 1, cost + extra + 1, audit + "R", out + letter, left)

    go(0, 0, "", "", insertions)
    return best


@pytest.mark.parametrize("block", [1, 2, 8])
def test_repair_equals_all_scripts(block, monkeypatch):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    draw = random.Random(block)
    for _ in range(400):
        kinds = "".join(draw.choice("uaUAs-xSX") for _ in range(draw.randrange(7)))
        assert repair(kinds) == all_scripts(kinds)


def test_long_conversations():
    assert repair("ua" * 3000) == (0, "K" * 6000)
    assert repair("s" + "ua" * 1000 + "-" + "ua" * 1000) == (2, "K" * 2001 + "D" + "K" * 2000)


def plain(rows, deal=repair):
    """Summary and digest of each conversation, by the stated rules, one conversation at a time."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        own = groups[conv]
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
        turns = [t for t, _, _ in own if t is not None]
        counts, kinds, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, "", set()
        for _, role, text in own:
            signs = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not signs else "duplicate" if (role, text) in seen else "" if signs[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            kinds += "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = deal(kinds)
        made, left = [], list(own)
        for edit in audit:
            role, text = ("", "") if edit == "I" else left.pop(0)[1:]
            if edit in "IR":
                role = "assistant" if made and made[-1][:1] == "u" else "user"
            if edit != "D":
                made.append(f"{role}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(made).encode()).hexdigest()
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, digest)
    return out


def got(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_a_plain_version(spark):
    draw = random.Random(3)
    texts = ["Hello.", "Well", "  ", "", None, "So?  ", "Yes!\n", "No. é", "a.b"]
    rows = []
    for conv in [None, *range(120)]:
        for turn in range(draw.randrange(1, 9)):
            number = None if draw.random() < 0.05 else turn * draw.choice([1, 1, 2]) - 1
            rows.append((conv, number, draw.choice(["user", "assistant", "system", "tool", "", None, "user"]), draw.choice(texts)))
    rows += rows[::17]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "conv_id long, turn long, role string, text string, kind string, copies int")
    found = got(repair_digests(df.repartition(5)))
    assert found == plain(rows)
    assert found == plain(rows, all_scripts_bounded)
    assert repair_digests(df.limit(0)).collect() == []


def all_scripts_bounded(kinds):
    return all_scripts(kinds, 1) if len(kinds) < 7 else repair(kinds)


def test_hot_conversation(spark):
    """A third of all rows in one conversation, many of them equal, in several batches of a task."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}." if t % 5 else "Again.") for t in range(12_000)]
    rows += [(k, t, "user" if t % 2 == 0 else "assistant", f"{k} {t}.") for k in range(2, 4000) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(repair_digests(df)) == plain(rows)


def test_repaired_turns(spark):
    rows = [("c", 0, "system", "Be kind."), ("c", 1, "user", "Hi."), ("c", 2, "user", "Hi!"), ("c", 2, "user", "Hi!"), ("d", 1, "bot", " ")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id string, turn int, role string, text string, copies int")
    found, turns = structure(df)
    assert {r.conv_id: (r.duplicate, r.blank, r.cost, r.audit) for r in found.collect()} == {"c": (1, 0, 3, "KKRD"), "d": (0, 1, 2, "D")}
    made = [tuple(r) for r in turns.collect()]
    assert made == [("c", 0, "system", "Be kind."), ("c", 1, "user", "Hi."), ("c", 2, "assistant", "Hi!")]


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="the given data is not here")
def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert got(repair_digests(df)) == plain(rows)
