"""robots.txt rules and the admission of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.urls import url_host, url_path
from ..operators.joins import fits_broadcast, lookup_join
from ..session import write_through

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def robots_directives(robots: DataFrame) -> DataFrame:
    """``host, line_no, field, value, stanza`` of every directive.

    ``robots`` has one row ``host, body`` per host. A User-agent line opens a new stanza when none
    is open yet or another directive came since the last User-agent line; directives before the
    first one have stanza 0.
    """
    line = F.btrim(F.regexp_replace("raw", "#.*", ""), F.lit(" \t\r\f\u000b"))
    lines = (
        robots.select(F.lower("host").alias("host"), F.posexplode(F.split("body", "\n")).alias("line_no", "raw"))
        .select("host", "line_no", line.alias("line"))
        .filter(F.col("line").contains(":"))
        .select(
            "host",
            "line_no",
            F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"),
            F.btrim(F.regexp_replace("line", "^[^:]*:", ""), F.lit(" \t")).alias("value"),
        )
    )
    in_file = W.partitionBy("host").orderBy("line_no")
    is_agent = F.col("field") == "user-agent"
    opens = is_agent & ~F.coalesce(F.lag(is_agent).over(in_file), F.lit(False))
    return lines.withColumn("opens", opens).select(
        "host", "line_no", "field", "value", F.sum(F.col("opens").cast("int")).over(in_file).alias("stanza")
    )


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """``host, disallow, crawl_delay_s`` that apply to ``agent``.

    All stanzas naming the agent count together and replace those for ``*``. Hosts without an
    applying stanza are left out: everything is allowed there. The first stanza with a readable
    crawl delay decides it, inside a stanza the last one.
    """
    stanzas = _stanzas(robots, agent)
    delay = F.when(F.col("value").rlike(_NUMBER), F.col("value").try_cast("double"))
    delay_line = F.when((F.col("field") == "crawl-delay") & delay.isNotNull(), F.col("line_no"))
    prefix = F.when((F.col("field") == "disallow") & (F.col("value") != ""), F.col("value"))
    rules = stanzas.groupBy("host", "stanza").agg(F.max_by(delay, delay_line).alias("delay"), F.collect_set(prefix).alias("prefixes"))
    return rules.groupBy("host").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("prefixes")))).alias("disallow"),
        F.min_by("delay", F.when(F.col("delay").isNotNull(), F.col("stanza"))).alias("crawl_delay_s"),
    )


def robots_prefixes(robots: DataFrame, agent: str) -> DataFrame:
    """``host, prefix``: the disallowed prefixes that apply to ``agent``, a row each, so a file may hold any number."""
    rules = _stanzas(robots, agent).filter("field = 'disallow' and value <> ''")
    return rules.select("host", F.col("value").alias("prefix")).distinct()


def _stanzas(robots: DataFrame, agent: str) -> DataFrame:
    """Directives of the stanzas that name the agent, or of those for ``*`` where none does."""
    directives = robots_directives(robots).filter("stanza > 0")
    value = F.lower(F.col("value"))
    agents = directives.filter("field = 'user-agent'").groupBy("host", "stanza")
    agents = agents.agg(F.max(value == agent.lower()).alias("named"), F.max(F.col("value") == "*").alias("wildcard"))
    agents = agents.withColumn("has_named", F.max("named").over(W.partitionBy("host")))
    chosen = agents.filter(F.when(F.col("has_named"), F.col("named")).otherwise(F.col("wildcard")))
    return directives.join(chosen.select("host", "stanza"), ["host", "stanza"], "left_semi")


def mark_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (any table with a ``url``) plus ``allowed``.

    ``rules`` has ``host`` and ``prefix``, or ``host`` and an array ``disallow``. No disallowed prefix
    may start the path; a host without rules allows everything. Each distinct path gives its
    beginnings, of the lengths that prefixes of its host have, and these meet the prefixes in an equi
    join: the work does not grow with the rules of a host, and no list of them is gathered. A host
    with a third of all addresses is split. Prefixes few enough to be broadcast meet the addresses where
    they lie, and only refused paths move.
    """
    prefixes = rules if "prefix" in rules.columns else rules.select("host", F.explode("disallow").alias("prefix"))
    prefixes = prefixes.select("host", "prefix").distinct()
    # No more lengths than the longest prefix has characters.
    lengths = prefixes.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    parts = urls.withColumns({"host": url_host("url"), "_path": url_path("url")})
    paths = parts.select("host", "_path")
    paths = lookup_join(paths if fits_broadcast(prefixes) else paths.distinct(), lengths, ["host"], "inner", spread_by=["_path"])
    fitting = F.filter("lengths", lambda n: n <= F.length("_path"))
    starts = paths.select("host", "_path", F.explode(fitting).alias("n"))
    starts = starts.select("host", "_path", F.left("_path", F.col("n")).alias("prefix"))
    refused = lookup_join(starts, prefixes, ["host", "prefix"], "left_semi", spread_by=["_path"])
    refused = write_through(refused.select("host", "_path").distinct().withColumn("_refused", F.lit(True)), "refused")
    marked = lookup_join(parts, refused, ["host", "_path"], "left", spread_by=["url"])
    return marked.withColumn("allowed", F.col("_refused").isNull()).drop("host", "_path", "_refused")


def allowed_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    return mark_allowed(urls, rules).filter("allowed").drop("allowed")
