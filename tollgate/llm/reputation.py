"""Empirical-Bayes host reputation for URL filtering, in DataFrame expressions only.

Labelled page outcomes are counted per host. Their bad rate is shrunk in three steps: suffixes towards the overall rate,
registered domains towards their suffix, hosts towards their domain. The strength of each beta-binomial prior is estimated
from the spread of the groups of that level (method of moments). A host is blocked if the lower end of its posterior bad
rate is above a threshold, so a host with few labels is judged mostly by what it belongs to.

Null or malformed urls have an empty host and path; they form one host of their own. Null labels are ignored, repeated labels
of one page count once (bad if any says so), repeated pages are separate rows. Empty tables give empty results.
Without labels every host has a bad rate of 0.1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import pinned
from tollgate.operators.skew import join_keys

Rule = tuple[str, str, str]

# Host, path, verdict.
RULES: tuple[Rule, ...] = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PRIOR = (0.5, 4.5)  # bad and good outcomes added to all labelled ones
LEAST_SPREAD, MOST_SPREAD = 1e-4, 0.5  # of the intra-group correlation


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; among equally long ones a blocking rule, then the first by name."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0] + r[1]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for at, start, says in reversed(ranked):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(at + start)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def spread(groups: DataFrame, parent: Column) -> DataFrame:
    """Prior strength of one level: 1 / rho - 1, where rho is the correlation of outcomes inside a group."""
    m, n = parent, F.col("n").cast("double")
    rate, noise = F.col("bad") / n, m * (1 - m)
    rho = F.try_divide(F.sum(n * (rate - m) * (rate - m) - noise), F.sum((n - 1) * noise))  # null if no group has two labels
    bounded = F.coalesce(F.least(F.lit(MOST_SPREAD), F.greatest(F.lit(LEAST_SPREAD), rho)), F.lit(LEAST_SPREAD))
    return groups.where("n > 0").agg((1 / bounded - 1).alias("strength"))


def shrunk(groups: DataFrame, level: str) -> DataFrame:
    """Posterior mean of every group around the column `parent`."""
    prior = F.col("strength") * F.col("parent")
    return (groups.withColumn("strength", spread(groups, F.col("parent")).scalar())
            .withColumn(level + "_a", prior + F.col("bad"))
            .withColumn(level + "_b", F.col("strength") - prior + F.col("n") - F.col("bad"))
            .drop("strength", "parent"))


def reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """One row per host of `pages(page_id, url)`: labelled pages, bad ones, posterior mean and lower bound of the bad rate.

    `outcomes(page_id, bad)` holds the labels. The bound is a normal one on the scale on which a beta posterior has nearly
    constant variance (arc sine of the root).
    """
    host, _ = host_and_path(F.col("url"))
    labels = (outcomes.where("page_id is not null and bad is not null")
              .groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad")))
    # Every level reads the one below more than once, so each is computed once and kept.
    hosts = pinned(pages.select("page_id", host.alias("host")).join(labels, "page_id", "left")
                   .groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("n"))
                   .withColumn("domain", F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0))
                   .withColumn("suffix", F.regexp_extract("host", r"[^.]*$", 0)))
    domains = pinned(hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    bad, good = PRIOR
    overall = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + bad) / (F.coalesce(F.sum("n"), F.lit(0)) + bad + good)).alias("parent"))

    def mean(level: str) -> Column:
        return F.col(level + "_a") / (F.col(level + "_a") + F.col(level + "_b"))

    top = pinned(shrunk(suffixes.withColumn("parent", overall.scalar()), "s").select("suffix", mean("s").alias("parent")))
    middle = pinned(shrunk(domains.join(top, "suffix"), "d").select("domain", mean("d").alias("parent")))
    total = F.col("h_a") + F.col("h_b")
    angle = F.asin(F.sqrt(F.col("h_a") / total)) - z / (2 * F.sqrt(total + 1))
    return (shrunk(hosts.join(middle, "domain"), "h")
            .select("host", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), mean("h").alias("bad_rate"),
                    F.pow(F.sin(F.greatest(F.lit(0.0), angle)), 2).alias("bad_bound")))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = RULES, most: float = 0.25,
                z: float = 1.645) -> DataFrame:
    """Judge every page: its rule's verdict, else `block` if the host's bad rate is above `most` with confidence."""
    host, path = host_and_path(F.col("url"))
    name, says = matched_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = pinned(reputation(pages, outcomes, z))
    judged = join_keys(judged, known, "host")  # a host may hold a third of all pages
    method = F.when(F.col("bad_bound") > most, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", name.alias("rule"), F.coalesce(says, method).alias("verdict"),
                         "n_labelled", "n_bad", "bad_rate", "bad_bound")
