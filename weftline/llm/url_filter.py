"""URL rules by expanded expressions: short hash prefixes join, full digests confirm."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_facts, settle

#: Hex digits of the digest that the join uses: 32 bits.
SHORT = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first :// up to / ? or #, A-Z lower-cased; then up to ? or #.

    Null, or no :// in it: both empty.
    """
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, "(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    authority = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(authority, string.ascii_uppercase, string.ascii_lowercase), path


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Give each page's URL the verdict of its longest rule, or `default`.

    rules: (action, rule), rule being host and path as in ``example.com/en/``;
    what precedes its first / is the host. A rule fits its host and the
    subdomains if the URL's path starts with the rule's path. Returns
    (page_id, host, path, rule, verdict), rule null where none fits.

    Each distinct (host, path) is expanded into the host suffixes of as many
    labels, and the path prefixes of as many characters, as some rule has.
    These expressions meet the rules by equality of a 32-bit digest prefix;
    the full SHA-256 then confirms. Of several rules the longest wins; of two
    equal ones, block. The number of distinct label counts and path lengths is
    bounded by the longest rule, not by the number of rules or pages.

    Null or malformed URLs have an empty host and path, which no rule fits, and
    an empty rule fits nothing; neither takes part in a join. A URL that very
    many pages have is joined by broadcast (`join_facts`). A URL of any length
    is read whole; repeated pages are judged each; no rules, or an empty table,
    are fine; other columns are ignored.
    """
    slash = F.instr("rule", "/")
    known = rules.where(F.col("rule").isNotNull() & (F.col("rule") != "")).select(
        F.col("action").alias("rule_action"),
        F.col("rule").alias("rule_text"),
        F.substring_index("rule", "/", 1).alias("rule_host"),
        F.when(slash > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit("")).alias("rule_path"),
    )
    known = known.withColumn("rule_text", F.concat("rule_host", "rule_path")).withColumn("rule_digest", F.sha2("rule_text", 256))
    known = known.groupBy("rule_text", "rule_host", "rule_path", "rule_digest").agg(F.max(F.when(F.col("rule_action") == "block", "block").otherwise("allow")).alias("rule_action"))
    shapes = known.select(F.size(F.split("rule_host", "\\.")).alias("labels"), F.length("rule_path").alias("chars")).distinct().collect()
    host, path = split_url(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    named = (F.col("host") != "") | (F.col("path") != "")
    labels = F.split("host", "\\.")
    # the shapes are data of the plan, not expressions of it, however many there are
    listed = F.array(*(F.struct(F.lit(r["labels"]).alias("labels"), F.lit(r["chars"]).alias("chars")) for r in shapes)) if shapes else F.array().cast("array<struct<labels:int,chars:int>>")
    fits = F.filter(listed, lambda r: (F.size(labels) >= r["labels"]) & (F.length("path") >= r["chars"]))
    expressions = F.transform(fits, lambda r: F.concat(F.array_join(F.slice(labels, -r["labels"], r["labels"]), "."), F.substr(F.col("path"), F.lit(1), r["chars"])))
    counted = settle(parsed.where(named).groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages")))
    expanded = counted.select("host", "path", F.explode(expressions).alias("expression")).withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    best = F.max(F.struct(F.length("rule_text").alias("chars"), F.col("rule_text").alias("rule"), F.col("rule_action").alias("action"))).alias("best")
    judged = expanded.join(known.withColumn("short", F.substring("rule_digest", 1, SHORT)), "short").where(F.col("digest") == F.col("rule_digest")).groupBy("host", "path").agg(best)
    facts = counted.join(judged, ["host", "path"])
    met = join_facts(parsed.where(named), facts, ["host", "path"], "pages", "left").select("page_id", "host", "path", "best")
    unnamed = parsed.where(~named).select("page_id", "host", "path", F.lit(None).cast(met.schema["best"].dataType).alias("best"))
    return met.union(unnamed).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
