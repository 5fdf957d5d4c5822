"""URL filter lists by hashed host-suffix and path-prefix expressions.

Each url is expanded to the suffixes of its host, as far as rules have that
many labels, with the prefixes of its path that end in a slash or are as long
as a rule's path that does not.  Expressions meet rules in an equi-join on a
short prefix of their SHA-256; the whole digest confirms, and the longest rule
decides.  Spark expressions only, and nothing is gathered in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest on which the join is made.
PREFIX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url):
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    ``rules`` has host, path and action (allow or block).  A rule fits its
    host and all subdomains, if the url's path starts with the rule's path;
    the longest wins, then the one with the longer host, then block.  Without
    a rule the verdict is ``default``.  A null url or one without ``://`` has
    empty host and path and fits no rule; rows of the rules with a null are
    ignored.  Repeated rows stay; other columns are ignored.
    """
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "action").where("rule_host <> '' and rule_path is not null and action is not null")
    rules = rules.select("*", F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256).alias("digest"), F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("chars"))
    # One row: label counts, and the lengths of paths that do not end in a slash.
    shapes = rules.agg(F.collect_set("labels").alias("counts"), F.collect_set(F.when(~F.col("rule_path").endswith("/"), F.col("chars"))).alias("lengths"))
    url = F.col(url_col).cast("string")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.filter("counts", lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    slashes = F.size(F.split("path", "/")) - 1
    prefixes = F.concat(
        F.transform(F.filter(F.sequence(F.lit(0), slashes), lambda k: k > 0), lambda k: F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), k), F.lit("/"))),
        F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n)),
    )
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(F.array_distinct(F.col("prefixes")), lambda p: F.sha2(F.concat_ws("\n", h, p), 256))))
    rows = rows.join(F.broadcast(shapes)).withColumn("prefixes", prefixes)
    asked = rows.select("row", "page_id", "host", "path", F.explode_outer(keys).alias("asked")).withColumn("short", F.substring("asked", 1, PREFIX))
    listed = rules.withColumn("short", F.substring("digest", 1, PREFIX)).drop("labels", "chars")
    found = asked.join(listed, "short", "left")
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), (F.col("action") == "block").cast("int").alias("b"), F.concat("rule_host", "rule_path").alias("rule"), F.col("action").alias("action")
    )
    best = found.groupBy("row", "page_id", "host", "path").agg(F.max(F.when(F.col("asked") == F.col("digest"), rank)).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
