"""Allow and block rules for web addresses, found by hash look-up of every host suffix with every path prefix.

A rule holds for a host with all its subdomains and for all paths that start with the rule's path. Each address is
expanded into the expressions a rule could have; expressions meet rules on a short prefix of their digest, full digests
confirm, and the longest rule wins. Only joins on equal keys are used, so the rules may be many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_DIGITS = 8
#: Different lengths of rule paths that are tried on each address.
MAX_LENGTHS = 4096
DEFAULT = "allow"
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")


def host(url: Column) -> Column:
    """From the first :// to the next slash, question mark, hash or the end; only A-Z are lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to a question mark, a hash or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _expression(host_part: Column, path_part: Column) -> Column:
    return F.concat(host_part, F.lit("\n"), path_part)


def _with_digest(df: DataFrame, host_part: Column, path_part: Column) -> DataFrame:
    digest = F.sha2(_expression(host_part, path_part), 256)
    return df.withColumn("_digest", digest).withColumn("_short", F.substring("_digest", 1, PREFIX_DIGITS))


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Per page: id, host, path, the rule that holds (host and path joined) and the verdict.

    ``rules`` has the columns host, path and verdict. The longest fitting rule wins, at equal length the one with the
    longer host; of rules that are given twice, block wins. A page without a fitting rule has a null rule and the
    default verdict. A null address, or one without ``://``, has an empty host and path. Repeated rows are judged once
    for each distinct host and path and all returned; an empty table gives an empty result; other columns play no part.
    """
    rows = pages.select(F.col(id_column).alias("_id"), F.col(url_column).cast("string").alias("_url"))
    rows = rows.select("_id", host(F.col("_url")).alias("_host"), path(F.col("_url")).alias("_path"))

    known = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" follows "allow"
    known = _with_digest(known, F.col("host"), F.col("path"))
    found_lengths = known.select(F.length("path").alias("n")).distinct().limit(MAX_LENGTHS + 1).collect()
    if len(found_lengths) > MAX_LENGTHS:
        raise ValueError(f"the rules have paths of more than {MAX_LENGTHS} different lengths")
    lengths = F.array(*[F.lit(n) for n in sorted(r["n"] for r in found_lengths)] or [F.lit(0)])

    places = rows.select("_host", "_path").distinct().filter(F.col("_host") != "")
    labels = F.split("_host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."),
    )
    prefixes = F.transform(
        F.filter(lengths, lambda n: n <= F.length("_path")), lambda n: F.substr(F.col("_path"), F.lit(1), n)
    )
    tried = places.select("_host", "_path", F.explode(suffixes).alias("_suffix"), prefixes.alias("_prefixes"))
    tried = tried.select("_host", "_path", "_suffix", F.explode("_prefixes").alias("_prefix"))
    tried = _with_digest(tried, F.col("_suffix"), F.col("_prefix"))
    found = (
        tried.alias("t")
        .join(known.alias("k"), F.col("t._short") == F.col("k._short"))
        .filter(F.col("t._digest") == F.col("k._digest"))
        .groupBy("t._host", "t._path")
        .agg(
            F.max(
                F.struct(
                    (F.length("k.host") + F.length("k.path")).alias("n"),
                    F.length("k.host").alias("h"),
                    F.concat("k.host", "k.path").alias("rule"),
                    F.col("k.verdict").alias("verdict"),
                )
            ).alias("_best")
        )
        .select("_host", "_path", F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("_verdict"))
    )
    return (
        rows.join(found, ["_host", "_path"], "left")
        .select(
            F.col("_id").alias(id_column),
            F.col("_host").alias("host"),
            F.col("_path").alias("path"),
            "rule",
            F.coalesce("_verdict", F.lit(DEFAULT)).alias("verdict"),
        )
    )


def given_rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT host, path, max(struct_pack(n := length(h) + length(p), rule := h || p, verdict := v)) AS b
  FROM (SELECT DISTINCT host, path FROM cut) c JOIN rules r
    ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p)
  GROUP BY host, path
)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM cut LEFT JOIN best USING (host, path)
"""
