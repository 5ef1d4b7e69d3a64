"""The crawl frontier: new addresses, states, and when each may be fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodespan.functions import urls
from lodespan.operators import robots

PENDING, DONE = "pending", "done"


def new_urls(found: DataFrame, frontier: DataFrame) -> DataFrame:
    """(url, status) of the distinct addresses in found that the frontier doesn't know: exact, no filter guesses."""
    fresh = found.select("url").where(F.col("url").isNotNull()).distinct()
    return fresh.join(frontier.select("url"), "url", "left_anti").select("url", F.lit(PENDING).alias("status"))


def add(found: DataFrame, frontier: DataFrame) -> DataFrame:
    return frontier.select("url", "status").unionByName(new_urls(found, frontier))


def mark_done(frontier: DataFrame, fetched: DataFrame) -> DataFrame:
    """The frontier with the addresses in fetched set to done; failed fetches stay pending."""
    done = fetched.select("url").distinct().select("url", F.lit(True).alias("fetched"))
    return frontier.join(done, "url", "left").select("url", F.when(F.col("fetched"), F.lit(DONE)).otherwise(F.col("status")).alias("status"))


def pending(frontier: DataFrame) -> DataFrame:
    """Pending addresses with their domain and path; those without a host stay pending and are left out."""
    parts = frontier.where(F.col("status") == PENDING).select("url", urls.host(F.col("url")).alias("domain"), urls.path(F.col("url")).alias("path"))
    return parts.where(F.col("domain").isNotNull())


def judged(frontier: DataFrame, rules: DataFrame) -> DataFrame:
    """Pending addresses with their domain's rules (none known: everything allowed) and the column allowed_to_crawl."""
    none = F.array().cast("array<string>")
    joined = pending(frontier).join(rules.select("domain", "disallowed", "allowed", "crawl_delay_s"), "domain", "left")
    delay = F.coalesce("crawl_delay_s", F.lit(robots.DELAY).cast("long"))
    return joined.select("url", "domain", "path", delay.alias("crawl_delay_s"), robots.can_crawl(F.col("path"), F.coalesce("disallowed", none), F.coalesce("allowed", none)).alias("allowed_to_crawl"))


def schedule(arrivals: DataFrame, delay_s: str = "crawl_delay_s") -> DataFrame:
    """arrivals (domain, arrival_s, seq, crawl_delay_s, ...) with number and start_s, the earliest polite fetch.

    Fetches of a domain are in order of arrival and at least its delay apart: the n-th starts at delay * n plus the most
    that any arrival so far is late for its place.
    """
    order = Window.partitionBy("domain").orderBy("arrival_s", "seq")
    counted = arrivals.withColumn("number", F.row_number().over(order))
    late = F.max(F.col("arrival_s") - F.col(delay_s) * F.col("number")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("start_s", F.col(delay_s) * F.col("number") + late)


def consecutive_errors(outcomes: DataFrame) -> DataFrame:
    """outcomes (domain, at, seq, limited) with errors, the rate limits in a row up to each row, and backoff_s."""
    order = Window.partitionBy("domain").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    runs = outcomes.withColumn("run", F.count_if(~F.col("limited")).over(order))
    in_run = Window.partitionBy("domain", "run").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("errors", F.count_if("limited").over(in_run)).drop("run").withColumn("backoff_s", F.when(F.col("limited"), robots.backoff(F.lit(robots.DELAY), F.col("errors") - 1)))


def round_of(frontier: DataFrame, rules: DataFrame, blocked: DataFrame | None = None, now_s: int = 0) -> tuple[DataFrame, DataFrame]:
    """One batch of crawling: addresses to fetch with their start_s, and the frontier in which forbidden ones are done.

    blocked (domain, blocked_until), as crawl states give it, holds a domain back: none of its addresses starts before
    blocked_until. start_s counts from now_s.
    """
    known = judged(frontier, rules)
    wait = F.lit(0).cast("long")
    if blocked is not None:
        known = known.join(blocked.select("domain", "blocked_until"), "domain", "left")
        wait = F.greatest(F.coalesce(F.col("blocked_until") - now_s, wait), wait)
    arrivals = known.where("allowed_to_crawl").withColumn("arrival_s", wait).withColumn("seq", F.col("url"))
    return schedule(arrivals).select("url", "domain", "number", "start_s"), mark_done(frontier, known.where("not allowed_to_crawl"))
