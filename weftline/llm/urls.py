"""URL filters: host-suffix and path-prefix expressions, joined with rules by short hash prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import checkpointed, lower_ascii, other_columns, own_columns, read_table, row_count, whole_row

#: Hex digits of the digest that the join uses.
SHORT = 8
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_and_path(url) -> tuple:
    """The host, A-Z lowered, and the path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", broadcast_rules: int = 100_000) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    A rule (host, path, verdict) fits its host and all subdomains where the url's path starts
    with its own. Of the rules that fit, the one with the longest host and path together holds; of
    equally long ones that with the longer host, and of equal rules one that blocks. Where none
    fits, ``rule`` is null and ``verdict`` is ``default``.

    Each distinct host and path is expanded to the expressions that a rule could have: suffixes of
    as many labels and prefixes of as many characters as occur in the rules. These meet the rules
    on the first digits of their SHA-256; the full digests confirm. Up to ``broadcast_rules`` rules
    are broadcast; more are shuffled.

    Every row of ``pages`` gives one row, repeated ones too, whatever its other columns hold; own
    columns named like the four new ones are replaced. Null urls and urls without ``://`` have an
    empty host and path, and no rule fits an empty host. Without rules all is ``default``.
    """
    rules = rules.select(F.coalesce("host", F.lit("")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")).where("rule_host != ''")
    shapes = rules.select(F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("chars")).distinct().collect()
    host, path = host_and_path(F.col(url_col))
    kept = own_columns(other_columns(pages, ("host", "path", "rule", "verdict")))
    pages = pages.select(whole_row(pages), host.alias("host"), path.alias("path"))
    if not shapes:
        return pages.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels, chars = (F.array(*(F.lit(n) for n in sorted({s[c] for s in shapes}))) for c in ("labels", "chars"))
    rules = rules.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    if row_count(rules) <= broadcast_rules:
        rules = F.broadcast(rules)

    own = F.split("host", r"\.")
    expanded = (
        pages.select("host", "path")
        .where("host != ''")
        .distinct()
        .withColumn("suffixes", F.transform(F.filter(labels, lambda n: n <= F.size(own)), lambda n: F.array_join(F.slice(own, -n, n), ".")))
        .withColumn("prefixes", F.transform(F.filter(chars, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)))
        .withColumn("suffix", F.explode("suffixes"))
        .withColumn("prefix", F.explode("prefixes"))
        .select("host", "path", F.sha2(F.concat("suffix", "prefix"), 256).alias("full"))
        .withColumn("short", F.substring("full", 1, SHORT))
    )
    best = F.max(F.struct(F.length("rule").alias("length"), F.length("rule_host").alias("host_length"), (F.col("rule_verdict") == "block").alias("blocks"), "rule", "rule_verdict")).alias("best")
    # kept, since AQE splits no join with an aggregate in it, and a front page may be most of a host
    judged = checkpointed(expanded.join(rules, "short").where("full = digest").groupBy("host", "path").agg(best))
    # rows without a host meet no rule: they stay where they are
    found = pages.where("host != ''").join(judged, ["host", "path"], "left").unionByName(pages.where("host = ''").withColumn("best", F.lit(None).cast(judged.schema["best"].dataType)))
    return found.select(*kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` judged by ``RULES``; odd rows as in ``judge_urls``."""
    return judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op10_url_filters": op10_url_filters}
SQL = {
    "op10_url_filters": """
WITH r(rule_host, rule_path, rule_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
 a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
       row_number() OVER () AS k FROM pages),
 b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
 u AS (SELECT page_id, k, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict
FROM u LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(rule_host || rule_path) DESC NULLS LAST) = 1"""
}
