"""robots.txt: rules as rows, and whether an address may be fetched.

Parsing is a window over the lines of each file.  Groups follow RFC 9309:
consecutive user-agent lines share the rules after them, of all groups the ones
with the most specific matching agent apply, `*` only if none does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import get_domain, resolve_url, robots_path

LEAST_DELAY = 0.5  # fixed value: floor of a crawl delay in seconds


def directives(files: DataFrame) -> DataFrame:
    """(domain, base_url, pos, name, value) of each directive line of `files`
    (domain, base_url, content).  Comments, blank lines and lines without colon
    go; a null content has none."""
    lines = files.select("domain", "base_url", F.posexplode(F.split("content", r"\r?\n", -1)).alias("pos", "raw"))
    line = F.trim(F.split_part(F.col("raw"), F.lit("#"), F.lit(1)))
    return lines.select("domain", "base_url", "pos", line.alias("line")).where(F.col("line").contains(":")).select(
        "domain", "base_url", "pos", F.lower(F.trim(F.regexp_extract("line", "^([^:]*):", 1))).alias("name"), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value")
    )


def rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """(domain, pos, kind, pattern, delay): the allow, disallow and crawl-delay
    lines that apply to `agent`."""
    by_file = Window.partitionBy("domain").orderBy("pos")
    known = directives(files).where(F.col("name").isin("user-agent", "allow", "disallow", "crawl-delay"))
    begins = (F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(by_file), F.lit("")) != "user-agent")
    grouped = known.withColumn("begins", begins.cast("int")).withColumn("group", F.sum("begins").over(by_file))
    token = F.lower(F.col("value"))
    match = F.when(token == "*", 0).when((token != "") & F.lit(agent.lower()).contains(token), F.length(token))
    by_group = Window.partitionBy("domain", "group")
    scored = grouped.withColumn("match", F.max(F.when(F.col("name") == "user-agent", match)).over(by_group))
    best = scored.withColumn("best", F.max("match").over(Window.partitionBy("domain"))).where("match = best and name != 'user-agent'")
    return best.select(
        "domain", "pos", F.col("name").alias("kind"), F.when(F.col("name") != "crawl-delay", F.col("value")).alias("pattern"),
        F.when(F.col("name") == "crawl-delay", F.expr("try_cast(value as double)")).alias("delay"),
    ).where("(kind = 'crawl-delay' and delay is not null) or pattern != ''")


def sitemaps(files: DataFrame) -> DataFrame:
    """(domain, pos, sitemap): sitemap lines, for any agent, made absolute."""
    found = directives(files).where("name = 'sitemap' and value != ''")
    return found.select("domain", "pos", resolve_url("base_url", "value").alias("sitemap"))


def pattern_regex(pattern: Column) -> Column:
    """Anchored regular expression of a path pattern: `*` is anything, `$` at the
    end anchors, all else is literal."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    literal = F.regexp_replace(body, r"([.\\+?^${}()|\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(literal, r"\*", ".*"), F.when(anchored, "$").otherwise(""))


def rule_sets(files: DataFrame, agent: str = "*") -> DataFrame:
    """(domain, rules, delay): one row a domain, its rules as an array of
    (allow, regex, length), the last valid delay."""
    applying = rules(files, agent)
    each = F.struct((F.col("kind") == "allow").alias("allow"), pattern_regex(F.col("pattern")).alias("regex"), F.length("pattern").alias("length"))
    return applying.groupBy("domain").agg(F.collect_list(F.when(F.col("pattern").isNotNull(), each)).alias("rules"), F.max_by("delay", F.when(F.col("delay").isNotNull(), F.col("pos"))).alias("delay"))


def is_allowed(rule_set: Column, path: Column) -> Column:
    """Whether a path may be fetched: the longest matching pattern wins, allow
    wins ties, no rule or no match allows.  `rule_set` is the array of `rule_sets`."""

    def longest(allow: bool) -> Column:
        matching = F.filter(rule_set, lambda r: (r["allow"] == allow) & F.regexp_like(path, r["regex"]))
        return F.coalesce(F.array_max(F.transform(matching, lambda r: r["length"])), F.lit(-1))

    return longest(True) >= longest(False)


def can_fetch(urls: DataFrame, files: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """`urls` with `allowed` added; hosts without a robots file allow all."""
    sets = rule_sets(files, agent).select(F.col("domain").alias("_domain"), F.col("rules").alias("_rules"))
    joined = urls.withColumn("_host", get_domain(url)).join(sets, F.col("_host") == F.col("_domain"), "left")
    return joined.withColumn("allowed", F.coalesce(is_allowed(F.col("_rules"), robots_path(url)), F.lit(True))).drop("_host", "_domain", "_rules")


def effective_delay(delay: Column) -> Column:
    """Delay of a host in seconds, not below the floor."""
    return F.greatest(F.coalesce(delay, F.lit(LEAST_DELAY)), F.lit(LEAST_DELAY))
