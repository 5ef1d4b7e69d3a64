"""Robots rules: parsing of robots.txt bodies, path permission and back-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds between fetches of a domain without a rule, and the longest back-off.
DELAY, LONGEST = 2, 300


def rules(bodies: DataFrame, agent: str) -> DataFrame:
    """(domain, disallowed, allowed, crawl_delay_s, rules_fetched) from (domain, body), one body for each domain.

    Rules count in sections whose last user-agent line names `*` or contains the agent's name, in any case. All such
    sections add up; empty paths are none; the last whole-number delay counts. A null body allows everything.
    """
    line = bodies.select("domain", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\r\n|\r|\n", -1)).alias("at", "line"))
    bare = line.select("domain", "at", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line"))
    named = bare.select("domain", "at", F.lower(F.regexp_extract("line", "^([A-Za-z-]+):", 1)).alias("field"), F.trim(F.regexp_replace("line", "^[A-Za-z-]+:", "")).alias("value"))
    who = F.lower("value")
    ours = F.when(F.col("field") == "user-agent", (who == "*") | F.contains(who, F.lit(agent.lower())))
    so_far = Window.partitionBy("domain").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    meant = named.withColumn("ours", F.last(ours, ignorenulls=True).over(so_far)).where("ours")
    paths = lambda field: F.transform(F.sort_array(F.collect_list(F.when((F.col("field") == field) & (F.col("value") != ""), F.struct("at", "value")))), lambda x: x["value"])
    delay = F.when((F.col("field") == "crawl-delay") & F.col("value").rlike("^\\+?[0-9]+$"), F.col("value").try_cast("long"))
    kept = meant.groupBy("domain").agg(paths("disallow").alias("disallowed"), paths("allow").alias("allowed"), F.max_by(delay, F.when(delay.isNotNull(), F.col("at"))).alias("delay"))
    none = F.array().cast("array<string>")
    return bodies.select("domain").distinct().join(kept, "domain", "left").select(
        "domain", F.coalesce("disallowed", none).alias("disallowed"), F.coalesce("allowed", none).alias("allowed"),
        F.coalesce("delay", F.lit(DELAY).cast("long")).alias("crawl_delay_s"), F.lit(True).alias("rules_fetched"),
    )


def can_crawl(path: Column, disallowed: Column, allowed: Column) -> Column:
    """An allowed beginning permits a path whatever its length, else a disallowed one forbids it."""
    starts = lambda rules_: F.exists(rules_, lambda p: F.startswith(path, p))
    return F.coalesce(starts(allowed), F.lit(False)) | ~F.coalesce(starts(disallowed), F.lit(False))


def backoff(delay_s: Column, errors: Column) -> Column:
    """Seconds to wait after a number of rate limits in a row: the delay, doubled for each, at most LONGEST."""
    # Ten doublings of one second pass the bound, so larger powers aren't computed.
    return F.least(F.lit(LONGEST), F.greatest(F.lit(1), delay_s) * F.pow(F.lit(2), F.least(errors, F.lit(9)))).cast("long")
