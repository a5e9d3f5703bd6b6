"""Mixing sources to target weights: fixed-length blocks, multinomial shard draws, permuted block indices.

1. The words of a source, its documents in a hashed order, form one stream that is cut into blocks.
2. Weights, capped by the sizes of the sources, give every source a quota of block uses.
3. Every slot of an output shard draws a source in proportion to the quotas, so the counts of a shard are
   multinomial. Uses that a source drew beyond its quota pass to sources that drew too few: totals are exact.
4. Use r of a source with n blocks is block ``perm(r mod n)`` of round ``r div n``, ``perm`` a pseudorandom
   permutation that is computed, not stored. Blocks are then joined by (source, index).

Only built-in functions are used. No step needs a whole source in one task: streams are cut into about
sqrt(documents) hash buckets, slots into about sqrt(slots) shards, and their sums are carried forward.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.common import WORD, materialise, once

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # all targets together: 3/2 of all sizes
CAP = 2
BLOCK_WORDS = 64
ROUNDS = 12
SALTS = 64
PRIME = 2**31 - 1
# Round constants: powers of two primitive roots of PRIME.
ADD = [pow(48271, r + 1, PRIME) for r in range(ROUNDS)]
MULTIPLY = [pow(16807, r + 1, PRIME) for r in range(ROUNDS)]


@dataclass(frozen=True)
class Mix:
    """``documents``: a row per document (equal ones share a row and its ``copies``) with its place in the stream
    of its source; ``sources``: a row per source; ``slots``: a row per block use of the mix."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    block_words: int


def count_words(text: Column) -> Column:
    marks = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), " \t\n\v\f\r", "")
    return F.length(marks).cast("long")


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def with_draws(slots: DataFrame, name: str, below: int) -> DataFrame:
    """Add a pseudorandom number under ``below`` for every ``id``: squares modulo a prime, each step a generated column."""
    a, b = F.col("_a"), F.col("_b")
    out = slots.withColumn("_a", once((F.col("id") % PRIME * ADD[0] + MULTIPLY[0] + F.floor(F.col("id") / PRIME)) % PRIME))
    out = out.withColumn("_b", once((a * a + ADD[1]) % PRIME)).withColumn("_a", once((b * b + a) % PRIME))
    out = out.withColumn("_b", once((a * a + ADD[2]) % PRIME)).withColumn("_b", once((b * b + a) % PRIME))
    return out.withColumn(name, (F.col("_a") * PRIME + F.col("_b")) % max(1, below)).drop("_a", "_b")


def with_permuted(rows: DataFrame, name: str) -> DataFrame:
    """Add the image of ``x`` under a pseudorandom permutation of 0..blocks-1 that ``seed`` picks: in every round x and its
    mirror ``(key - x) mod blocks`` are swapped or not, as a hash of the larger of them says. Every round is
    a generated column: its steps stay in compiled code, and no filter is pushed into them."""
    x, mirror, seed, n = F.col("_x"), F.col("_mirror"), F.col("seed"), F.col("blocks")
    out = rows.withColumn("_x", F.col("x"))
    for add, multiply in zip(ADD, MULTIPLY):
        key = ((seed * add) % PRIME * PRIME + (seed * multiply) % PRIME) % n
        out = out.withColumn("_mirror", (key + n - x) % n)
        h = ((F.greatest(x, mirror) % PRIME + 1) * multiply + seed) % PRIME
        out = out.withColumn("_x", once(F.when(h % 2048 >= 1024, mirror).otherwise(x)))
    return out.withColumnRenamed("_x", name).drop("_mirror")


def _carry(ranged: DataFrame, name: str, value: Column) -> DataFrame:
    """Add the sum of ``value`` over the sources before each one. ``_part`` numbers range partitions; their sums,
    a row for each partition, are carried forward."""
    order = [F.col("source").isNull(), F.col("source")]
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    valued = ranged.withColumn("_value", value)
    parts = valued.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    parts = parts.select("_part", F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    out = valued.withColumn("_inside", F.sum("_value").over(before)).join(parts, "_part")
    zero = F.lit(0).cast("long")
    return out.withColumn(name, F.coalesce("_inside", zero) + F.coalesce("_carry", zero)).drop("_value", "_inside", "_carry")


def _level(sources: DataFrame, share: tuple[int, int], cap: int) -> float:
    """Words per unit of weight, once sources above their cap have handed on their excess."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    if not total:
        return 0.0
    level = -1.0
    while True:
        over = F.col("weight") * F.lit(level) > F.lit(float(cap)) * F.col("source_size")
        capped, rest = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))
        ).first()
        following = (share[0] * total - share[1] * cap * capped) / (float(share[1]) * rest) if rest else level
        if following <= level:
            return level
        level = following


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP, block_words: int = BLOCK_WORDS,
    shard_blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> Mix:
    """Plan of a mix in which the sources, by code point and null last, weigh ``weights`` in turn.

    A null or blank text has size 0, is in no block and is never taken. Null ids and repeated rows are allowed: rows
    equal in id, text and source are interchangeable, and each has its own place. Ids, texts and sources alone
    decide, so reruns agree however the table is split. No columns but the three named are read. An empty
    table gives empty tables. ``share`` over 1 may not exceed ``cap``.
    """
    if share[0] > share[1] * cap:
        raise ValueError("the targets together exceed the cap of all sources")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text))
    measured = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("size"),
        key.alias("key"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"),
    )
    measured = materialise(measured.groupBy("doc_id", "source", "size", "key", "salt").agg(F.count("*").alias("copies")), "measured")
    sources = measured.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n"))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = sources.repartitionByRange(n_parts, F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    numbered = _carry(materialise(ranged, "ranged"), "source_no", F.lit(1).cast("long"))
    turn = F.array(*[F.lit(w).cast("long") for w in weights])
    numbered = materialise(numbered.withColumn("weight", F.element_at(turn, (F.col("source_no") % len(weights) + 1).cast("int"))), "numbered")
    level = _level(numbered, share, cap)
    quotas = numbered.withColumn("target", F.least(F.col("weight") * F.lit(level), float(cap) * F.col("source_size")))
    quotas = quotas.withColumn("blocks", F.ceil(F.col("source_size") / block_words)).withColumn(
        "quota", F.when(F.col("blocks") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).otherwise(0).cast("long")
    )
    quotas = quotas.withColumn("seed", _hex(F.coalesce("source", F.lit("<null>")), 7))
    quotas = materialise(_carry(quotas, "low", F.col("quota")), "quotas")
    rows, uses, n_sources = quotas.agg(F.sum("n"), F.sum("quota"), F.count("*")).first()
    documents = _places(measured, quotas, rows or 0)
    return Mix(documents, quotas, _slots(quotas, uses or 0, n_sources, shard_blocks), block_words)


def _places(measured: DataFrame, quotas: DataFrame, rows: int) -> DataFrame:
    """Documents with their first word's place in the stream of their source, which is ordered by key."""
    buckets = max(1, math.ceil(math.sqrt(rows)))
    known = quotas.select(F.col("source").alias("_source"), "source_no", "source_size", "target")
    own = measured.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    own = own.withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets, 32))
    own = own.withColumn("words", F.col("size") * F.col("copies"))
    sums = own.groupBy("source_no", "bucket").agg(F.sum("words").alias("words"))
    over = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("key", "doc_id", "salt").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("inside", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(sums, ["source_no", "bucket"])
    return own.select("doc_id", "source", "source_no", "source_size", "target", "size", "copies", (F.col("base") + F.col("inside")).alias("start"))


def _slots(quotas: DataFrame, uses: int, n_sources: int, shard_blocks: int | None) -> DataFrame:
    """Block uses (shard, source_no, use, round, block)."""
    spark = quotas.sparkSession
    width = max(1, -(-uses // (4 * max(1, n_sources))))
    size = shard_blocks or max(1, math.ceil(math.sqrt(uses)))
    # A source takes part in every stretch of draws that its range touches: stretches and sources together bound the rows.
    ranges = quotas.where("quota > 0").select(
        "source_no", "low", (F.col("low") + F.col("quota")).alias("high"),
        F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("low") + F.col("quota") - 1) / width))).alias("stretch"),
    )
    draws = with_draws(spark.range(uses), "draw", uses).select(F.floor(F.col("id") / size).alias("shard"), "draw")
    draws = draws.withColumn("stretch", F.floor(F.col("draw") / width)).join(ranges, "stretch").where("draw >= low AND draw < high")
    earlier = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialise(draws.groupBy("shard", "source_no").agg(F.count("*").alias("drawn")), "counts")
    counts = counts.withColumn("first", F.coalesce(F.sum("drawn").over(earlier), F.lit(0)))
    each = counts.select("shard", "source_no", F.explode(F.expr("sequence(first, first + drawn - 1)")).alias("use"))
    sums = counts.groupBy("source_no").agg(F.sum("drawn").alias("drawn"))
    state = quotas.join(sums, "source_no", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    state = _carry(state, "over_before", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)))
    state = _carry(state, "under_before", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)))
    state = materialise(state.select("source_no", "seed", "blocks", "quota", "drawn", "over_before", "under_before"), "state")
    each = each.join(state.select("source_no", "quota", "over_before"), "source_no")
    spare = each.where("use >= quota").select("shard", (F.col("over_before") + F.col("use") - F.col("quota")).alias("z"))
    short = state.where("drawn < quota").select(
        "source_no", "drawn", "under_before", F.explode(F.expr("sequence(drawn, quota - 1)")).alias("use")
    ).select("source_no", "use", (F.col("under_before") + F.col("use") - F.col("drawn")).alias("z"))
    taken = each.where("use < quota").select("shard", "source_no", "use").union(spare.join(short, "z").select("shard", "source_no", "use"))
    taken = taken.join(state.select("source_no", "seed", "blocks"), "source_no").withColumn("round", F.floor(F.col("use") / F.col("blocks")))
    taken = taken.withColumn("seed", (F.col("seed") + F.col("round") * 7919) % PRIME).withColumn("x", F.col("use") % F.col("blocks"))
    return with_permuted(taken, "block").select("shard", "source_no", "use", "round", "block")


def spans(documents: DataFrame, block_words: int) -> DataFrame:
    """Rows (source_no, block, copy, from_word, n_words): what a block holds of each document; ``copy`` is the
    document's place in the stream. Equal documents are told apart inside the blocks, so a group of copies is
    spread like any other words."""
    end = F.col("start") + F.col("size") * F.col("copies")
    each = documents.where("size > 0").select(
        "source_no", "start", "size", end.alias("end"),
        F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))).alias("block"),
    )
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(F.col("end"), (F.col("block") + 1) * block_words)
    each = each.select("*", low.alias("low"), high.alias("high")).select(
        "*", F.explode(F.expr("sequence((low - start) div size, (high - 1 - start) div size)")).alias("k")
    )
    copy = F.col("start") + F.col("k") * F.col("size")
    first = F.greatest(F.col("low"), copy)
    return each.select(
        "source_no", "block", copy.alias("copy"), (first - copy).alias("from_word"),
        (F.least(F.col("high"), copy + F.col("size")) - first).alias("n_words"),
    )


def pieces(plan: Mix) -> DataFrame:
    """The mixed blocks: per use, the stretches of documents that it holds (joined by source and block index)."""
    return plan.slots.join(spans(plan.documents, plan.block_words), ["source_no", "block"])


def taken_words(plan: Mix) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes, repeats counted."""
    used = pieces(plan).groupBy("source_no", "copy").agg(F.sum("n_words").alias("taken"))
    each = plan.documents.withColumn("k", F.explode(F.expr("sequence(0L, copies - 1)")))
    each = each.withColumn("copy", F.when(F.col("size") > 0, F.col("start") + F.col("k") * F.col("size")))
    return each.join(used, ["source_no", "copy"], "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def query(docs: DataFrame) -> DataFrame:
    return taken_words(mix(docs)).select("doc_id", "size", "source_size", "target", "taken")


_KEY = f"(((seed * add_r[r + 1]) % {PRIME} * {PRIME} + (seed * mul_r[r + 1]) % {PRIME}) % blocks)"
_MIRROR = f"(({_KEY} + blocks - a) % blocks)"
_HASH = f"((greatest(a, {_MIRROR}) % {PRIME} + 1) * mul_r[r + 1] + seed) % {PRIME}"
SQL = rf"""
WITH m AS (
  SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM m GROUP BY source
), n AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM s
), w AS (
  SELECT *, ([{', '.join(map(str, WEIGHTS))}])[source_no % {len(WEIGHTS)} + 1] AS weight, sum(source_size) OVER () AS total FROM n
), l AS (
  SELECT *, (3 * total - 4 * coalesce(sum(source_size) OVER before, 0)) / (2.0::DOUBLE * sum(weight) OVER rest) AS level FROM w
  WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY 2.0::DOUBLE * source_size / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), f AS (
  SELECT level FROM l WHERE source_size > 0 AND weight * level <= 2.0::DOUBLE * source_size ORDER BY 2.0::DOUBLE * source_size / weight, source_no LIMIT 1
), q AS (
  SELECT source, source_no, source_size, least(weight * coalesce((SELECT level FROM f), 0.0), 2.0::DOUBLE * source_size) AS target,
         CAST(ceil(source_size / {BLOCK_WORDS}.0) AS BIGINT) AS blocks,
         ('0x' || substr(md5(coalesce(source, '<null>')), 1, 7))::BIGINT AS seed0 FROM w
), k AS (
  SELECT *, CASE WHEN blocks > 0 THEN CAST(floor(target * blocks / source_size + 0.5) AS BIGINT) ELSE 0 END AS quota FROM q
), o AS (
  SELECT *, coalesce(sum(quota) OVER (ORDER BY source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, sum(quota) OVER () AS uses FROM k
), u AS (SELECT CAST(max(uses) AS BIGINT) AS uses FROM o
), e AS (
  SELECT id, (id % {PRIME} * {ADD[0]} + {MULTIPLY[0]} + id // {PRIME}) % {PRIME} AS a, (a * a + {ADD[1]}) % {PRIME} AS b, (b * b + a) % {PRIME} AS c,
         (c * c + {ADD[2]}) % {PRIME} AS f, (f * f + c) % {PRIME} AS g, (c * {PRIME} + g) % uses AS draw FROM (SELECT unnest(range(uses)) AS id, uses FROM u)
), d AS (
  SELECT o.source_no, row_number() OVER (PARTITION BY o.source_no ORDER BY e.id) - 1 AS use FROM e JOIN o ON draw >= low AND draw < low + quota
), c AS (SELECT source_no, use FROM d JOIN o USING (source_no) WHERE use < quota
  UNION ALL SELECT source_no, unnest(range(drawn, quota)) AS use FROM (SELECT o.source_no, quota, count(use) AS drawn FROM o LEFT JOIN d USING (source_no) GROUP BY ALL) WHERE drawn < quota
), b AS (
  SELECT source_no, use % blocks AS x, blocks, (seed0 + use // blocks * 7919) % {PRIME} AS seed, {ADD} AS add_r, {MULTIPLY} AS mul_r FROM c JOIN o USING (source_no)
), p AS (
  SELECT source_no, list_reduce(list_prepend(x, range(0, {ROUNDS})), lambda a, r:
    CASE WHEN ({_HASH}) % 2048 >= 1024 THEN {_MIRROR} ELSE a END) AS block FROM b
), y AS (SELECT source_no, block, count(*) AS uses FROM p GROUP BY ALL
), g AS (
  SELECT m.*, source_no, source_size, target, coalesce(sum(size) OVER (PARTITION BY source_no ORDER BY key, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM m JOIN o ON m.source IS NOT DISTINCT FROM o.source
), h AS (
  SELECT r, source_no, start, size, unnest(range(start // {BLOCK_WORDS}, (start + size - 1) // {BLOCK_WORDS} + 1)) AS block FROM g WHERE size > 0
), t AS (
  SELECT r, sum(uses * (least(start + size, (block + 1) * {BLOCK_WORDS}) - greatest(start, block * {BLOCK_WORDS}))) AS taken FROM h JOIN y USING (source_no, block) GROUP BY r
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM g LEFT JOIN t USING (r)
"""
