"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import ascii_lower

RULE_SCHEMA = "verdict string, host string, path string"
# The rules of the registered query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_path(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", prefix_hex: int = 8) -> DataFrame:
    """Per URL: host, path, the rule that decides (host + path) and its verdict; ``default`` without one.

    A URL yields one expression per host suffix that has rules and per path length of those rules. The
    expressions of all distinct (host, path) pairs meet the rules in an equi-join on the first
    ``prefix_hex`` digits of their SHA-256; the full digest then confirms. The longest rule wins, block
    before allow at equal rules. Null and odd URLs have no expression and get the default; repeated rows
    each keep their row, since verdicts are looked up by (host, path). No rules: all default.
    """
    host, path = host_path(F.col(url_col))
    base = urls.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    r = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")
    )
    r = r.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("full", F.sha2("rule", 256))
    r = r.withColumn("short", F.substring("full", 1, prefix_hex))
    # The path lengths of a host's rules, at most as many as a path has characters, come with the host suffix.
    lengths = r.groupBy(F.col("rule_host").alias("s")).agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = base.select("host", "path").distinct().where("host <> ''").select("host", "path", F.explode(suffixes).alias("s")).join(
        lengths, "s"
    ).select("host", "path", "s", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    each = each.withColumn("e", F.concat("s", F.expr("left(path, n)"))).withColumn("digest", F.sha2("e", 256))
    hits = each.join(r, F.substring(each["digest"], 1, prefix_hex) == r["short"]).where(
        (F.col("digest") == F.col("full")) & (F.col("s") == F.col("rule_host"))
    )
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), F.col("rule_verdict").alias("v"), "rule")).alias("m")
    )
    return base.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.v", F.lit(default)).alias("verdict")
    )


def query(pages: DataFrame) -> DataFrame:
    return judge(pages, pages.sparkSession.createDataFrame(list(RULES), RULE_SCHEMA))


SQL = """
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), rules(verdict, rh, rp) AS (VALUES """ + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES) + """
), b AS (
  SELECT r, rh || rp AS rule, verdict FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rh || rp) DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN b USING (r)
"""
