"""Rule bitmask ledger: measure once, keep failure bits, apply policies and ablations to the bits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import WHITE, once, words_of

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``failed`` is an SQL condition over the measurements; ``bit`` is its place in the ledger."""

    bit: int
    name: str
    failed: str


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]


RULES = (
    Rule(0, "too_short", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "short_words", "word_chars < 2 * n_words"),
    Rule(3, "long_words", "word_chars > 15 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > n_words"),
    Rule(5, "duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(6, "capitals", "10 * n_capitals > 4 * word_chars"),
)
BASE = Policy("base", ("too_short", "repeated_windows"))
STANDARD = Policy("v1", tuple(r.name for r in RULES))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def _count(text: Column, characters: str) -> Column:
    """Code points of the class; runs outside it go in one match each, which is cheaper than ``translate``."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the measurements of every text; a null text has no words, lines or characters.

    Window repeats are found inside the row: a long holds the window's hash above its position, so one
    sort brings equal windows together; hash matches are then compared as strings. The work is
    n log n in the words of a text and nothing is shuffled.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select(
        "*", words_of(F.col("text")).alias("w"),
        F.filter(F.split("text", "\n"), lambda s: F.rlike(s, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
    )
    base = base.select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", WHITE, "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _count(F.col("text"), "A-Z").alias("n_capitals"),
        F.ceil(F.log2(F.size("w") + F.lit(2))).cast("int").alias("b"),
    )
    # Fewer than three words: no window. xxhash64 of the words, with the position in the low bits.
    places = F.expr("IF(size(w) < 3, CAST(array() AS array<int>), sequence(0, size(w) - 3))")
    keys = base.withColumn("p", places).withColumn(
        "k",
        F.expr("transform(p, i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), b) | CAST(i AS BIGINT))"),
    )
    keys = keys.withColumn("k", F.expr("sort_array(k)")).withColumn(
        "c",
        F.expr(
            "filter(k, (x, j) -> (j > 0 AND shiftright(get(k, j - 1), b) = shiftright(x, b))"
            " OR (j < size(k) - 1 AND shiftright(get(k, j + 1), b) = shiftright(x, b)))"
        ),
    )
    keys = keys.withColumn(
        "g",
        F.expr(
            "sort_array(transform(transform(c, x -> CAST(x & (shiftleft(1L, b) - 1L) AS INT)),"
            " i -> struct(concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS s, i AS i)))"
        ),
    )
    keys = keys.withColumn(
        "g",
        F.expr(
            "filter(g, (x, j) -> (j > 0 AND get(g, j - 1).s = x.s) OR (j < size(g) - 1 AND get(g, j + 1).s = x.s))"
        ),
    )
    covered = F.expr("size(array_distinct(flatten(transform(g, x -> array(x.i, x.i + 1, x.i + 2)))))")
    measured = F.struct("doc_id", *MEASURES[:4], covered.cast("long").alias("n_repeat_words"), *MEASURES[5:])
    return keys.select(once(measured).alias("m")).select("m.*")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its measurements and ``failed_bits``, bit ``r.bit`` set where rule r fails.

    Null ids, repeated rows and extra columns are allowed: rows are measured one by one and only id and
    text are read. An empty table gives an empty ledger.
    """
    if len({r.bit for r in rules}) != len(rules) or not all(0 <= r.bit < 63 for r in rules):
        raise ValueError("rules need different bits from 0 to 62")
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.failed), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, id_col, text_col).withColumn("failed_bits", bits)


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    known = {r.name: r.bit for r in rules}
    return sum(1 << known[name] for name in set(policy.rules))


def apply_policy(entries: DataFrame, policy: Policy = STANDARD, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed. Only the bits are read, no text."""
    return entries.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0)


def ablation(entries: DataFrame, policies: tuple[Policy, ...] = (STANDARD,), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy version and rule: documents that fail it, and those that only it removes.

    The ledger shrinks first to one row per bit pattern (map-side combined), whatever its length.
    """
    patterns = entries.groupBy("failed_bits").agg(F.count("*").alias("n"))
    plan = [
        (p.version, r.name, mask(p, rules), 1 << r.bit) for p in policies for r in rules if r.name in p.rules
    ]
    spark = entries.sparkSession
    each = spark.createDataFrame(plan, "version string, rule string, policy_mask long, rule_mask long")
    rows = patterns.select(
        "n", "failed_bits",
        F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(p, each.columns)]) for p in plan])).alias("x"),
    ).select("n", "failed_bits", "x.*")
    failed = F.col("failed_bits").bitwiseAND(F.col("policy_mask"))
    sums = rows.groupBy("version", "rule").agg(
        F.sum("n").alias("n_documents"),
        F.sum(F.when(F.col("failed_bits").bitwiseAND(F.col("rule_mask")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(failed == F.col("rule_mask"), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(failed == 0, F.col("n")).otherwise(0)).alias("n_kept"),
    )
    return each.select("version", "rule").join(sums, ["version", "rule"], "left").na.fill(0)


def query(docs: DataFrame) -> DataFrame:
    rows = apply_policy(ledger(docs))
    failed = F.col("failed_bits").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0
    return rows.select("doc_id", *MEASURES[:5], failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"), "failed_bits")


SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM t
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), c AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY r
), m AS (
  SELECT doc_id, len(w) AS n_words,
         CAST(length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
         length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals
  FROM w LEFT JOIN c USING (r)
), b AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (word_chars < 2 * n_words)::INT
    + 8 * (word_chars > 15 * n_words)::INT + 16 * (10 * n_symbols > n_words)::INT
    + 32 * (10 * n_dup_lines > 3 * n_lines)::INT + 64 * (10 * n_capitals > 4 * word_chars)::INT AS BIGINT) AS failed_bits FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b
"""
