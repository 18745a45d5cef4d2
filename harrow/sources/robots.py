"""Robots rules from captured ``robots(target_idx, status, body)`` rows.

Semantics are those of the standard-library robots parser as used on a seed
host: a read with status >= 400 (or no capture) allows everything; groups are
separated by a blank line or by a user-agent line after rules; the first
specific group whose agent name is a substring of our agent token decides,
else the first ``*`` group; inside the group the first rule whose path is a
prefix of the URL decides; no match means allowed.

The line state machine is expressed with window functions over the exploded
lines of each file (running sums mark group boundaries), so the rules table is
built without collecting any file.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MiningConfig
from ..functions.urls import path as url_path
from ..functions.urls import query as url_query

LINE_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def _unquote(c):
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def robots_rules(robots: DataFrame, cfg: MiningConfig) -> DataFrame:
    """``(target_idx, rule_pos, rule_path, allow)`` of the group that applies."""
    ok = robots.filter(F.coalesce(F.col("status") < 400, F.lit(False)) & F.col("body").isNotNull())
    lines = ok.select("target_idx", F.posexplode(F.split("body", LINE_BREAKS, -1)).alias("pos", "raw"))
    stripped = F.trim(F.regexp_replace(F.regexp_replace(F.col("raw"), "#.*$", ""), r"^\s+|\s+$", ""))
    key = F.lower(F.trim(F.substring_index(stripped, ":", 1)))
    value = F.trim(F.regexp_extract(stripped, "^[^:]*:(.*)$", 1))
    has_colon = stripped.contains(":")
    kind = (F.when(F.col("raw") == "", F.lit("blank"))
            .when(has_colon & (key == "user-agent"), F.lit("agent"))
            .when(has_colon & key.isin("allow", "disallow"), F.lit("rule"))
            .when(has_colon & key.isin("crawl-delay", "request-rate"), F.lit("meta"))
            .otherwise(F.lit("skip")))
    typed = lines.select("target_idx", "pos", kind.alias("kind"), key.alias("key"), _unquote(value).alias("value")) \
        .filter(F.col("kind") != "skip")
    w = Window.partitionBy("target_idx").orderBy("pos")
    prev_kind = F.lag("kind").over(w)
    boundary = (F.col("kind") == "blank") | ((F.col("kind") == "agent")
                                             & F.coalesce(prev_kind.isin("rule", "meta"), F.lit(False)))
    seg = typed.withColumn("seg", F.sum(boundary.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ws = Window.partitionBy("target_idx", "seg").orderBy("pos")
    seg = seg.withColumn("agents_before", F.sum((F.col("kind") == "agent").cast("int"))
                         .over(ws.rowsBetween(Window.unboundedPreceding, 0)))
    token = cfg.user_agent.split("/")[0].lower()
    groups = seg.groupBy("target_idx", "seg").agg(
        F.max(F.when((F.col("kind") == "agent") & (F.col("value") == "*"), 1).otherwise(0)).alias("is_default"),
        F.max(F.when((F.col("kind") == "agent") & (F.col("value") != "*")
                     & F.lit(token).contains(F.lower(F.col("value"))), 1).otherwise(0)).alias("applies"),
        F.max(F.when(F.col("kind").isin("rule", "meta") & (F.col("agents_before") > 0), 1).otherwise(0)).alias("added"),
    ).filter(F.col("added") == 1)
    # A group naming '*' is the default group (the first one only); others are
    # specific groups tried in file order.
    choice = groups.withColumn(
        "prio", F.when(F.col("is_default") == 1, F.lit(1)).when(F.col("applies") == 1, F.lit(0)).otherwise(F.lit(None))
    ).filter(F.col("prio").isNotNull())
    first_default = groups.filter(F.col("is_default") == 1).groupBy("target_idx").agg(F.min("seg").alias("dseg"))
    choice = choice.join(first_default, "target_idx", "left") \
        .filter((F.col("prio") == 0) | (F.col("seg") == F.col("dseg")))
    chosen = choice.groupBy("target_idx").agg(F.min_by("seg", F.struct("prio", "seg")).alias("seg"))
    rules = seg.join(chosen, ["target_idx", "seg"]) \
        .filter((F.col("kind") == "rule") & (F.col("agents_before") > 0))
    allow = (F.col("key") == "allow") | (F.col("value") == "")
    return rules.select("target_idx", F.col("pos").alias("rule_pos"),
                        F.regexp_replace(F.col("value"), r"\?$", "").alias("rule_path"), allow.alias("allow"))


def _request_path(url):
    p = url_path(url)
    q = url_query(url)
    full = F.concat(p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    full = _unquote(full)
    return F.when(full == "", F.lit("/")).otherwise(full)


def robots_flag(visits: DataFrame, rules: DataFrame, cfg: MiningConfig) -> DataFrame:
    """Adds ``allowed``: the first matching rule of the target decides.

    An equi-join on (target, beginning of the request): each visit is cut to the
    lengths that occur among its target's rules, so it gives one row per length,
    not per rule, and meets at most one rule for each.
    """
    first = rules.select("target_idx", F.col("rule_path").alias("_path"), "rule_pos", "allow").groupBy("target_idx", "_path") \
        .agg(F.min("rule_pos").alias("_pos"), F.min_by("allow", "rule_pos").alias("_rule"))
    lengths = first.groupBy("target_idx").agg(F.collect_set(F.length("_path")).alias("_lengths"))
    keyed = visits.withColumn("_req", _request_path(F.col("url")))
    cut = keyed.select("target_idx", "url", "_req").join(lengths, "target_idx") \
        .select("target_idx", "url", "_req", F.explode(F.filter("_lengths", lambda n: n <= F.length("_req"))).alias("_n")) \
        .select("target_idx", "url", F.substring(F.col("_req"), F.lit(1), F.col("_n")).alias("_path"))
    hit = cut.join(first, ["target_idx", "_path"]).groupBy("target_idx", "url").agg(F.min_by("_rule", "_pos").alias("_allow"))
    return keyed.join(hit, ["target_idx", "url"], "left") \
        .withColumn("allowed", F.coalesce(F.col("_allow"), F.lit(True))).drop("_req", "_allow")


def robots_allowed(visits: DataFrame, rules: DataFrame, cfg: MiningConfig) -> DataFrame:
    return robots_flag(visits, rules, cfg).filter(F.col("allowed")).drop("allowed")
