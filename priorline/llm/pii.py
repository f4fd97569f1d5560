"""Personal data in texts: patterns propose spans, checks confirm them, words nearby adjust their score.

The base kinds (email, ip, card, phone) are taken whenever their check holds; their score only informs. Further kinds
are taken from a score on, and only where no base span is: card and phone numbers that stand next to other digits, bank
account numbers (mod 97), and, only with a telling word nearby, social security numbers and secrets such as keys and
tokens (a long run of signs with letters and digits mixed). Everything is built from SQL functions; positions come from the lengths of what stands between the matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEARBY = 40
ACCEPTED = 0.7
_PROPOSED, _CONFIRMED, _TOLD = 0.5, 0.3, 0.2
_LOCAL = "A-Za-z0-9._%+-"
_SIGN = "A-Za-z0-9_-"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SHAPE = "array<struct<gap:string,found:string,after:string>>"
_DIGIT_VALUES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _card(found: Column) -> Column:
    digits = _digits(found)
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _phone(found: Column) -> Column:
    return F.length(_digits(found)).between(9, 15)


def _mod97(found: Column) -> Column:
    """Whether the rearranged number, letters as 10 to 35, leaves 1."""
    plain = F.replace(found, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))

    def step(rest: Column, letter: Column) -> Column:
        value = F.instr(F.lit(_DIGIT_VALUES), letter) - 1
        return ((rest * F.when(value > 9, 100).otherwise(10) + value) % 97).cast("int")

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """``hint`` is a cheap test that holds for every text with a match; ``check`` is None where nothing confirms.

    ``confirmed`` is what a check that holds adds to the score; a small one leaves the verdict to the words nearby.
    """

    name: str
    pattern: str
    hint: Callable[[Column], Column]
    check: Callable[[Column], Column] | None
    words: str
    base: bool = True
    confirmed: float = _CONFIRMED


def _has(part: str) -> Callable[[Column], Column]:
    return lambda text: F.contains(text, F.lit(part))


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda text: F.rlike(text, F.lit(pattern))


# Leftmost matches start where a run of their first class starts, or where the match before ended; saying so, with
# possessive repeats, keeps the search linear in long runs.
KINDS = [
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _has("@"), None, "mail|contact|write"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _like(r"[0-9]\.[0-9]"),
         lambda m: F.rlike(m, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")), "ip|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _like("[0-9][\\x20-]?[0-9]"), _card, "card|visa|credit|payment|pan"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _has("+"), _phone, "phone|tel|call|mobile|fax"),
    Kind("card_run", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])", _like("[0-9]{4}"), _card,
         "card|visa|credit|payment|pan", False),
    Kind("phone_run", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])", _has("+"), _phone,
         "phone|tel|call|mobile|fax", False),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", _like("[A-Z]{2}[0-9]{2}"), _mod97,
         "iban|account|bank", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _like("[0-9]{3}-[0-9]{2}-[0-9]{4}"), None,
         "ssn|social|security|insurance", False),
    Kind("secret", rf"(?<![{_SIGN}])[{_SIGN}]{{20,}}+", _like(f"[{_SIGN}]{{20}}"),
         lambda m: (F.length(m) <= 512) & F.rlike(m, F.lit("^(?=(?:[^0-9]*+[0-9]){4})(?=(?:[^A-Za-z]*+[A-Za-z]){4})")),
         "token|secret|passw|pwd|api|key|credential|bearer|auth", False, 0.1),
]
BASE = [k for k in KINDS if k.base]


def _confirmed(kind: Kind, found: Column) -> Column:
    return F.lit(True) if kind.check is None else F.coalesce(kind.check(found), F.lit(False))


def _score(kind: Kind, found: Column, around: Column) -> Column:
    told = F.rlike(around, F.lit(rf"(?i)(?:^|[^a-z])(?:{kind.words})"))
    sure = F.lit(0.0) if kind.check is None else F.when(_confirmed(kind, found), kind.confirmed).otherwise(-_PROPOSED)
    return F.lit(_PROPOSED) + sure + F.when(told, _TOLD).otherwise(0.0)


def _pieces(kind: Kind, text: Column) -> Column:
    """What stands before each match, the match, and what follows it up to the next one; null without a match."""
    gaps = F.split(text, kind.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), 0)
    return F.when(kind.hint(text), F.arrays_zip(gaps.alias("gap"), found.alias("found"), F.slice(gaps, 2, F.size(gaps)).alias("after")))


def find(rows: DataFrame, text_column: str = "text") -> DataFrame:
    """Every row, as ``row`` (all columns but the text), with ``spans``: kind, start, end (code points), score, base.

    Spans are in the order of kinds and starts. A null text counts as empty; rows without spans have an empty array.
    Repeated rows give repeated results. No text is cut.
    """
    kept = [c for c in rows.columns if c != text_column]
    marked = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(True).alias("__present")).alias("row"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("number"),
    )
    per_kind = [F.struct(F.lit(-1).alias("kind"), F.lit(None).cast(_SHAPE).alias("pieces"))]
    per_kind += [F.struct(F.lit(k).alias("kind"), _pieces(kind, F.col("text")).cast(_SHAPE).alias("pieces")) for k, kind in enumerate(KINDS)]
    kinds = marked.select("row", "number", F.explode(F.array(*per_kind)).alias("k")).filter("k.kind < 0 or k.pieces is not null")
    found = kinds.select(
        F.when(F.col("k.kind") < 0, F.col("row")).alias("row"), "number", F.col("k.kind").alias("kind"), F.posexplode_outer("k.pieces").alias("at", "p")
    ).filter("kind < 0 or p.found is not null")
    around = F.concat(F.right("p.gap", F.lit(NEARBY)), F.lit(" "), F.left(F.coalesce("p.after", F.lit("")), F.lit(NEARBY)))
    score = F.coalesce(*[F.when(F.col("kind") == k, _score(kind, F.col("p.found"), around)) for k, kind in enumerate(KINDS)])
    sure = F.coalesce(*[F.when(F.col("kind") == k, _confirmed(kind, F.col("p.found"))) for k, kind in enumerate(KINDS)])
    slim = found.select(
        "row", "number", "kind", "at", F.length("p.gap").alias("gap"), F.length("p.found").alias("length"),
        score.alias("score"), sure.alias("sure"),
    ).repartition("number")
    so_far = Window.partitionBy("number", "kind").orderBy("at")
    placed = slim.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(so_far)).withColumn("start", F.col("end") - F.col("length"))
    is_base = F.col("kind").between(0, len(BASE) - 1)
    placed = placed.filter((F.col("kind") < 0) | (is_base & F.col("sure")) | (~is_base & (F.col("score") >= ACCEPTED)))
    by_start = Window.partitionBy("number").orderBy("start", "kind")
    reached = F.max(F.when(is_base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    next_base = F.min(F.when(is_base, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    placed = placed.withColumn("_met", (F.coalesce(reached, F.lit(0)) > F.col("start")) | (F.coalesce(next_base < F.col("end"), F.lit(False))))
    placed = placed.filter((F.col("kind") < 0) | is_base | ~F.col("_met"))
    names = F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("kind") + 1)
    span = F.when(
        F.col("kind") >= 0,
        F.struct("kind", "start", "end", names.alias("name"), F.round("score", 2).alias("score"), is_base.alias("base")),
    )
    return placed.groupBy("number").agg(
        F.first("row", ignorenulls=True).alias("row"), F.array_sort(F.collect_list(span)).alias("spans")
    ).select("row", "spans")


def _text(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: spans of each base kind, a digest of all base spans, all spans as text and how many there are.

    A null or empty text has no spans; null ids stay null; repeated rows give repeated results; an empty table gives an
    empty one; other columns play no part.
    """
    found = find(docs.select("doc_id", "text"))

    def of_kind(name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["name"] == name)).cast("long").alias(f"n_{name}")

    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[of_kind(k.name) for k in BASE],
        F.sha2(_text(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        _text(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def _redacted(kind: Kind) -> Callable[[Column], Column]:
    """What comes before a match, and the match or its mark."""
    mark = F.lit(f"<{kind.name.split('_')[0].upper()}>")

    def piece(p: Column) -> Column:
        around = F.concat(F.right(p["gap"], F.lit(NEARBY)), F.lit(" "), F.left(F.coalesce(p["after"], F.lit("")), F.lit(NEARBY)))
        taken = _confirmed(kind, p["found"]) if kind.base else _score(kind, p["found"], around) >= ACCEPTED
        return F.concat(p["gap"], F.when(p["found"].isNull(), "").when(taken, mark).otherwise(p["found"]))

    return piece


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The same rows and columns, with each confirmed span replaced by its kind in angle brackets; null texts stay null.

    Base kinds come first, so the further kinds only find what those left.
    """
    text = F.col(f"`{text_column}`")
    for kind in KINDS:
        changed = F.array_join(F.transform(_pieces(kind, text).cast(_SHAPE), _redacted(kind)), "")
        docs = docs.withColumn(text_column, F.when(text.isNotNull() & kind.hint(text), changed).otherwise(text))
    return docs
