"""URL filters [native]: a sort-merge range join of reversed-host keys with nested rules.

A rule (host, path prefix, verdict) fits its host and every subdomain of it. Written with the labels
reversed ("org.example."), a host and all its subdomains are one interval of keys, and the intervals of any
two rules nest or are apart. Two sweeps in key order do the join:

1. over the ends of the rules' intervals, holding a stack of the rules open at each point; every end begins a
   segment of keys that all have the same stack (`rule_segments`);
2. over pages and segment starts sorted together, where each page takes the stack of the last segment that
   began at or before its key (`judge_urls`).

Of the stack, the longest rule whose path prefix the url's path starts with decides. The second sweep runs in
`parts` salted shares of the pages (by row id, so a host with any share of the rows is spread evenly; about
`ROWS_A_PART` rows each, and no fewer shares than the session's shuffle partitions); each has its own copy of the segments, of which there are at most two a rule. Rules are a Python list (bounded: they
stand in the query plan). Everything is DataFrame expressions.

Null urls and urls without "://" have empty host and path, and no rule fits them. Repeated rows are judged each
by itself; columns other than the url and id are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of pages a share of the sweep takes on average.
ROWS_A_PART = 200_000


def url_host(url: Column) -> Column:
    """Between the first "://" and "/", "?", "#" or the end; A-Z lower-cased; "" if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the host's end up to "?", "#" or the end; "" if there is no "://"."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each followed by a dot: a.b.org -> org.b.a. ; subdomains share the prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def rule_segments(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(key, stack): from `key` on, up to the next row's, exactly the rules in `stack` are open.

    One sweep over the sorted ends of the rules' intervals, as a fold that pushes and pops.
    """
    kind = "struct<key:string,opens:boolean,id:int,rule:string,path:string,verdict:string>"
    ends = []
    for i, (host, path, verdict) in enumerate(rules):
        lo = _key(host)
        hi = lo[:-1] + "/"  # the least string above every string that starts with lo
        for key, opens in ((lo, True), (hi, False)):
            ends.append(F.struct(F.lit(key).alias("key"), F.lit(opens).alias("opens"), F.lit(i).alias("id"), F.lit(host + path).alias("rule"), F.lit(path).alias("path"), F.lit(verdict).alias("verdict")))
    sweep = F.array_sort(F.array(*ends)) if ends else F.array().cast(f"array<{kind}>")
    stack = f"array<{kind}>"
    state = f"struct<stack:{stack},out:array<struct<key:string,stack:{stack}>>>"
    start = F.struct(F.array().cast(stack).alias("stack"), F.array().cast(f"array<struct<key:string,stack:{stack}>>").alias("out")).cast(state)

    def step(s: Column, e: Column) -> Column:
        now = F.when(e["opens"], F.concat(s["stack"], F.array(e))).otherwise(F.filter(s["stack"], lambda r: r["id"] != e["id"]))
        return F.struct(now.alias("stack"), F.concat(s["out"], F.array(F.struct(e["key"].alias("key"), now.alias("stack")))).alias("out")).cast(state)

    segments = spark.range(1).select(F.inline(F.aggregate(sweep, start, step)["out"]))
    # Several ends may share a key: the last of the fold holds.
    numbered = segments.withColumn("n", F.monotonically_increasing_id())
    return numbered.groupBy("key").agg(F.max_by("stack", "n").alias("stack"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", url: str = "url", row_id: str = "page_id", parts: int | None = None) -> DataFrame:
    """row_id, host, path, rule (null if none fits), verdict (the rule's, else `default`) for each row."""
    spark = pages.sparkSession
    if parts is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // ROWS_A_PART), 1)
    link = F.col(url).cast("string")
    left = pages.select(F.col(row_id).alias("__row"), url_host(link).alias("host"), url_path(link).alias("path"))
    none = rule_segments(spark, rules)
    left = left.select("*", F.when(F.col("host") != "", host_key(F.col("host"))).otherwise(F.lit("")).alias("key"), F.lit(None).cast(none.schema["stack"].dataType).alias("stack"), F.lit(1).alias("kind"), F.pmod(F.xxhash64("__row", "path"), F.lit(parts)).alias("part"))
    right = none.select(F.lit(None).cast(pages.schema[row_id].dataType).alias("__row"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "key", "stack", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    open_rules = F.last("stack", ignorenulls=True).over(sweep)
    swept = left.unionByName(right).select("__row", "host", "path", "kind", open_rules.alias("open")).where("kind = 1")
    fits = F.filter("open", lambda r: F.col("path").startswith(r["path"]))
    # The longest rule wins; equal lengths: the deeper host, then the earlier rule.
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("l"), (-F.length(r["path"])).alias("p"), (-r["id"]).alias("i"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return swept.select(F.col("__row").alias(row_id), "host", "path", best.alias("b")).select(row_id, "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
