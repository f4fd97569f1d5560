"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

A text falls into units (white space with what follows it, a contraction, or a run of letters, digits or other signs)
whose tokens do not depend on their neighbours. Within a piece of byte-pair encoding the tokens of a prefix end in the
one token that may follow the last token of the shorter prefix, so one pass over the bytes gives the count at every
prefix; shared prefixes of words are computed once. The counts of a text are the joined counts of its units.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from tokenizers import Tokenizer

MODEL = "byte_bpe_50k.json"
LIMIT = 512
_KEPT = 600_000
_LONG = 48
_WIDE = re.compile("[^\0-\u024f]")
_SPACE = regex.compile(r"^\s+")
_UNIT = r"\s+(?<! )'(?:[sdmt]|ll|ve|re)|\s+\p{L}+|\s+\p{N}+|\s+[^\s\p{L}\p{N}]+|'(?:[sdmt]|ll|ve|re)|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PrefixCounter:
    """Token counts of one byte-level vocabulary. Memory is bounded: full tables are emptied and filled anew."""

    def __init__(self, model: str = MODEL):
        self.library = Tokenizer.from_file(public_tokenizers.path(model))
        alphabet = _byte_alphabet()
        self.letters = {b: c for c, b in alphabet.items()}
        added = self.library.get_added_tokens_decoder().values()
        self.special = sorted((t.content for t in added), key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        words = {w: k for w, k in self.library.get_vocab(with_added_tokens=False).items() if w not in self.special}
        self.bytes_of = {k: bytes(alphabet[c] for c in w) for w, k in words.items()}
        self.tokens = {b: k for k, b in self.bytes_of.items()}
        self.longest = max(map(len, self.tokens))
        self.merges = tiktoken.Encoding("merges", pat_str=".", mergeable_ranks=self.tokens, special_tokens={})
        self.units = regex.compile(_UNIT)
        letter, digit, space = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
        classes = {r"[^\s\p{L}\p{N}]": f"[^{space}{letter}{digit}]", r"\p{L}": f"[{letter}]", r"\p{N}": f"[{digit}]", r"\s": f"[{space}]"}
        narrow = _UNIT
        for general, latin in classes.items():
            narrow = narrow.replace(general, latin)
        self.latin_units = re.compile(narrow)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.ends: dict[bytes, tuple[int, int]] = {}
        counter = self

        class Units(dict):
            def __missing__(self, unit: str) -> bytes:
                if len(self) >= _KEPT:
                    self.clear()
                found = counter.unit_steps(unit)
                if len(unit) <= _LONG:
                    self[unit] = found
                return found

        self.steps_of = Units()

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the two tokens are what the merges make of their joined bytes."""
        if len(self.pairs) >= _KEPT // 2:
            self.pairs.clear()
        joined = self.bytes_of[a] + self.bytes_of[b]
        known = self.pairs[a, b] = self.merges._encode_single_piece(joined) == [a, b]
        return known

    def piece_counts(self, piece: bytes) -> list[int]:
        """Tokens of ``piece[:i]`` for every i from 1."""
        tokens, ends, pairs, longest = self.tokens, self.ends, self.pairs, self.longest
        short = known = len(piece) <= _LONG
        if len(ends) >= _KEPT // 2:
            ends.clear()
        lasts, counts = [-1], [0]
        for i in range(1, len(piece) + 1):
            if known:  # else no longer prefix is known either
                known = ends.get(piece[:i])
            if not known:
                for j in range(i - 1, max(i - longest, 0) - 1, -1):
                    token = tokens.get(piece[j:i])
                    if token is not None:
                        if j:
                            fits = pairs.get((lasts[j], token))
                            if not (self.may_follow(lasts[j], token) if fits is None else fits):
                                continue
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                lasts.append(token)
                counts.append(counts[j] + 1)
                if short:
                    ends[piece[:i]] = token, counts[i]
                continue
            lasts.append(known[0])
            counts.append(known[1])
        return counts[1:]

    def _at_chars(self, piece: bytes) -> list[int]:
        """Tokens of the piece's prefixes that end with a code point."""
        counts = self.piece_counts(piece)
        return [c for c, after in zip(counts, piece[1:] + b" ") if after & 0xC0 != 0x80]

    def unit_steps(self, unit: str) -> bytes:
        """How much each code point of a unit adds to the count, as signed bytes."""
        if unit[0] not in "'\t\n\v\f\r" and not unit[1:2].isspace():  # one piece
            if unit[0] == " " or not unit[0].isspace():
                return self._steps(self._at_chars(unit.encode()))
        word = _SPACE.sub("", unit)
        space = unit[: len(unit) - len(word)]
        counts = self._at_chars(space.encode()) if space else []
        if word:
            # Before a word the last white space is a piece of its own or, if a space, part of the word's piece.
            before = counts[-2] if len(counts) > 1 else 0
            if space[-1:] == " ":
                counts += [before + c for c in self._at_chars(f" {word}".encode())[1:]]
            else:
                own = self._at_chars(word.encode())
                if word[0] == "'" and len(word) > 2 and word[1].isalpha():  # a contraction of two letters
                    own[1] = own[0] + self._at_chars(word[1].encode())[0]
                before += self._at_chars(space[-1].encode())[0] if space else 0
                counts += [before + c for c in own]
        return self._steps(counts)

    @staticmethod
    def _steps(counts: list[int]) -> bytes:
        return bytes([(c - b) & 255 for b, c in zip([0, *counts], counts)])

    def _broken_steps(self, unit: str, special: str) -> bytes:
        """Steps of a unit and the special string after it: a prefix that ends within the string is ordinary text."""
        text = unit + special
        counts = [tokens_at(self.plain_steps(text[:i]), i) for i in range(1, len(text))]
        whole = tokens_at(self.plain_steps(unit), len(unit)) + 1
        return self._steps([*counts, whole])

    def plain_steps(self, text: str) -> bytes:
        units = self.latin_units if not _WIDE.search(text) else self.units
        return b"".join(map(self.steps_of.__getitem__, units.findall(text)))

    def steps(self, text: str) -> bytes:
        """One signed byte per code point; their running sum is the token count of each prefix."""
        if not self.special or not any(s in text for s in self.special):
            return self.plain_steps(text)
        parts, out = self.split.split(text), []
        for k in range(0, len(parts) - 1, 2):
            units = self.units.findall(parts[k])
            last = units.pop() if units else ""
            out += [*map(self.steps_of.__getitem__, units), self._broken_steps(last, parts[k + 1])]
        return b"".join([*out, self.plain_steps(parts[-1])])


@cache
def counter(model: str) -> PrefixCounter:
    return PrefixCounter(model)


def tokens_at(steps: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` code points."""
    return int(np.frombuffer(steps, np.int8)[:chars].sum(dtype=np.int64))


def longest_within(steps: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    within = np.flatnonzero(np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def prefix_counts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str = MODEL, limit: int = LIMIT
) -> DataFrame:
    """Per row: id, UTF-8 bytes, tokens, the longest prefix (code points) within the limit, and the steps of all prefixes.

    A null text counts as empty: no bytes, no tokens, no steps. A null id stays null; repeated rows give repeated
    results; an empty table gives an empty one. Texts are never cut, and special strings inside a text count as the
    tokenizer's library counts them by default. Columns other than the two named play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                steps = [count.steps(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array([tokens_at(s, len(s)) for s in steps], pa.int64()),
                        pa.array([longest_within(s, limit) for s in steps], pa.int64()),
                        pa.array(steps, pa.binary()),
                    ],
                    ["id", "n_bytes", "n_tokens", "limit_chars", "steps"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, limit_chars long, steps binary").withColumnRenamed(
        "id", id_column
    )


@F.pandas_udf(LongType())
def tokens_of_prefix(steps: pd.Series, chars: pd.Series) -> pd.Series:
    """Column form of ``tokens_at`` for stored steps."""
    return pd.Series([None if s is None or pd.isna(c) else tokens_at(s, int(c)) for s, c in zip(steps, chars)], dtype="Int64")


@F.pandas_udf(LongType())
def prefix_within(steps: pd.Series, budget: pd.Series) -> pd.Series:
    """Column form of ``longest_within`` for stored steps."""
    return pd.Series([None if s is None or pd.isna(b) else longest_within(s, int(b)) for s, b in zip(steps, budget)], dtype="Int64")


def token_counts(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per document: bytes, tokens, and whether the limit is passed, read off the prefix counts."""
    counts = prefix_counts(docs, limit=limit)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "limit_chars")
