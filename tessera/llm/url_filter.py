"""URL filters: a sort-merge range join of urls against host and path rules, in DataFrame operations only.

A rule's host becomes a canonical key, its labels reversed and each followed by a dot (``example.net`` ->
``net.example.``), so that the host and all its subdomains are the keys in the interval ``[key, key + FF)``. Intervals
of different hosts are disjoint or nested. Urls and interval ends are sorted together; a running ``last`` over that
order carries the stack of active nested rules: a start puts its stack there, an end puts back its parent's. Each url
takes, from the stack at its place, the longest rule whose path its own path starts with.

Scale: urls are dealt into sweeps by a hash of their place, not of their host, so no host is hot; every sweep gets all
rules, and has at least ``4 x rules`` urls, so that the copies of the rules stay a fraction of the urls. Nothing is
broadcast or collected but two counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import lower_ascii

#: At least so many urls in a sweep, and so many for each rule.
LEAST_URLS, URLS_PER_RULE = 256, 4

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each followed by a dot, as bytes; the empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))
    ).cast("binary")


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules given as (verdict, "host/path") as a DataFrame of verdict, host, path, rule."""
    given = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules]) if rules else F.array().cast("array<struct<verdict:string,rule:string>>")
    return spark.range(1).select(F.inline(given)).select(
        "verdict", lower_ascii(F.substring_index("rule", "/", 1)).alias("host"),
        F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("path"), "rule",
    )


def _intervals(rules: DataFrame) -> DataFrame:
    """For each distinct rule host: its key, and the rules active inside it and just outside it."""
    rules = rules.where(F.col("host").isNotNull() & F.col("verdict").isNotNull())
    # The same host and path twice: block wins.
    rules = rules.groupBy("host", F.coalesce("path", F.lit("")).alias("path")).agg(
        F.max("verdict").alias("verdict"), F.min("rule").alias("rule"))
    own = rules.groupBy(host_key(F.col("host")).alias("key")).agg(
        F.collect_list(F.struct(F.length("host").alias("host_len"), "path", "rule", "verdict")).alias("own"))
    # A host's ancestors are its keys cut after each label, the empty one included.
    text = F.col("key").cast("string")
    cut = F.transform(F.sequence(F.lit(0), F.size(F.split(text, r"\.", -1)) - 1), lambda i: F.concat(
        F.array_join(F.slice(F.split(text, r"\.", -1), F.lit(1), i), "."), F.when(i > 0, F.lit(".")).otherwise(F.lit(""))))
    chain = own.select("key", F.explode(F.array_distinct(cut)).alias("at"))
    above = own.select(F.col("key").cast("string").alias("at"), "own")
    stacks = chain.join(above, "at").groupBy("key").agg(
        F.flatten(F.collect_list("own")).alias("inside"),
        F.flatten(F.collect_list(F.when(F.col("at") != F.col("key").cast("string"), F.col("own")))).alias("outside"))
    return stacks


def filter_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """Judge every url by its longest fitting rule.

    ``rules`` has verdict ("allow" or "block"), host (lower case), path and rule (what to report). A rule fits its host
    and all subdomains if the url's path starts with the rule's; the longest host and path together wins, at a tie the
    longer host. Returns one row per input row: id, host, path, rule (null where none fits), verdict (``default``
    where none fits). Other columns are left out, so they can't clash.

    Defined cases: a null url or one without ``://`` has an empty host and path and only a rule with an empty host fits
    it; a null id is kept; repeated rows give repeated results; the same rule as allow and block is block; empty rules
    give ``default``; empty urls give no rows; an url of any length is one sort key.
    """
    spark = urls.sparkSession
    n_rules, n_urls = rules.count(), urls.count()
    sweeps = max(1, -(-n_urls // max(LEAST_URLS, URLS_PER_RULE * n_rules)))
    points = urls.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    points = points.select(
        F.pmod(F.xxhash64("_id", "host", "path"), F.lit(sweeps)).alias("sweep"), host_key(F.col("host")).alias("key"),
        F.lit(1).alias("kind"), "_id", "host", "path")
    end = F.lit(bytearray(b"\xff"))
    ends = _intervals(rules).select(F.explode(F.array(
        F.struct(F.col("key").alias("key"), F.col("inside").alias("stack")),
        F.struct(F.concat(F.col("key"), end).alias("key"), F.col("outside").alias("stack")))).alias("e"))
    ends = ends.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sweeps - 1).cast("long"))).alias("sweep"), "e.key",
        F.lit(0).alias("kind"), "e.stack")
    both = points.unionByName(ends, allowMissingColumns=True)
    order = Window.partitionBy("sweep").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("active", F.last("stack", ignorenulls=True).over(order)).where("kind = 1")
    fits = F.filter(F.coalesce("active", F.array().cast(both.schema["stack"].dataType)), lambda r: F.expr("path").startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(
        (r["host_len"] + F.length(r["path"])).alias("n"), r["host_len"].alias("h"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return swept.withColumn("best", best).select(
        F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: The contract's rules.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark, RULES))


SQL = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(verdict, rhost, rpath, rule) AS (VALUES
  ('block', 'net', '/', 'net/'), ('allow', 'example.net', '/en/', 'example.net/en/'),
  ('block', 'example.com', '/de/', 'example.com/de/'), ('allow', 'org', '/fr/', 'org/fr/'))
SELECT page_id, host, path,
       (SELECT arg_max(rule, length(rule)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
       coalesce((SELECT arg_max(verdict, length(rule)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM parts
"""
