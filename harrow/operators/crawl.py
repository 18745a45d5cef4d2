"""Breadth-first link expansion over captured pages, one join per level.

The FIFO queue of a serial crawler visits, at depth d+1, the links of the
depth-d pages in (parent visit order, link order), skipping URLs already
visited, until the limit of pages per target, if there is one.  Per level that is:

    links of fetched depth-d pages  (filtered *before* explode)
      -> anti join with everything visited so far   (target_idx, url)
      -> min(parent rank) per (target_idx, url)     (first enqueue wins)
      -> rank inside target by (parent rank, url) + visited so far
      -> keep rank <= max_pages, where a job sets that limit

Evaluation is semi-naive: a level reads the level before it, and appends only
its own rows, as one partition ``depth=d`` of the visits on the shared
checkpoint folder; nothing is written twice, and lineage stays flat.  What a
level needs of earlier ones is which pages its *live* targets (those with a page
on the last level) have visited.  While there are few live targets they are
named in a filter that reaches the Parquet scan, whose files are sorted by
target; a target that found nothing new costs later levels nothing.  Ranks go on
from the last level's own maximum.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAX_PATH_SLASHES, MiningConfig
from ..functions.ordinal import rank_in_pieces
from ..functions.staging import scratch, staged
from ..functions.urls import is_allowed, normalise_domain, normalise_url, should_enqueue, should_skip

VISIT_COLS = ["target_idx", "domain", "url", "depth", "visit_rank"]
PARENTS_PER_PIECE = 1 << 10
PAGES_PER_PIECE = 1 << 16
#: Up to so many live targets are named in the filter of the visits.
NAMED_TARGETS = 1000


def seeds(targets: DataFrame, cfg: MiningConfig) -> DataFrame:
    """Depth-0 visits: the normalised seed, if it passes the visit test."""
    t = targets.select(
        "target_idx",
        normalise_domain(F.col("allowed_domain")).alias("domain"),
        normalise_url(F.col("seed_url")).alias("url"))
    return t.filter(~should_skip(F.col("url"), cfg) & is_allowed(F.col("url"), F.col("domain"), True)) \
        .select("target_idx", "domain", "url", F.lit(0).alias("depth"), F.lit(1).alias("visit_rank"))


class Visits:
    """Visits by level; with ``folder`` each is written once, as a partition of one table."""

    def __init__(self, folder: str | None):
        self.folder, self.levels = folder, []
        self.schema = None

    def add(self, level: DataFrame) -> DataFrame:
        depth = len(self.levels)
        if self.folder is not None:
            path = f"{self.folder}/depth={depth}"
            self.schema = self.schema or level.schema
            level.drop("depth").sortWithinPartitions("target_idx").write.parquet(path)
            level = level.sparkSession.read.schema(level.drop("depth").schema).parquet(path).withColumn("depth", F.lit(depth)).select(*VISIT_COLS)
        self.levels.append(level)
        return level

    def table(self) -> DataFrame:
        if self.folder is not None:
            spark = self.levels[0].sparkSession
            return spark.read.schema(self.schema).option("basePath", self.folder).parquet(self.folder).select(*VISIT_COLS)
        out = self.levels[0]
        for level in self.levels[1:]:
            out = out.unionByName(level)
        return out

    def seen_by(self, live: DataFrame) -> DataFrame:
        """``(target_idx, url)`` of what the targets of ``live`` have visited."""
        seen = self.table()
        if self.folder is not None:
            named = [r["target_idx"] for r in live.select("target_idx").distinct().limit(NAMED_TARGETS + 1).collect()]
            if len(named) <= NAMED_TARGETS:
                seen = seen.filter(F.col("target_idx").isin(named))
        return seen.select("target_idx", "url")


def crawl_visits(targets: DataFrame, content: DataFrame, cfg: MiningConfig,
                 edges: DataFrame | None = None, robots: DataFrame | None = None,
                 checkpoint: bool = True) -> DataFrame:
    """``visits(target_idx, domain, url, depth, visit_rank, fetched)``.

    ``content(url, is_html, links, ...)`` is the parsed page table (one row per
    normalised URL); ``edges(src, dst)`` optionally adds links; ``robots`` is
    the output of :func:`harrow.sources.robots.robots_rules`.
    """
    from ..sources.robots import robots_allowed

    readable = content.filter(F.col("is_html")).select("url", "links")
    if edges is not None:
        extra = edges.select(normalise_url(F.col("src")).alias("src"), normalise_url(F.col("dst")).alias("dst"))
        extra = staged(extra, "links") if checkpoint else extra
    visits = Visits(scratch(targets.sparkSession, "visits") if checkpoint else None)
    level = visits.add(seeds(targets, cfg))
    # Built once, reused at every level (expression construction is not free).
    from ..functions.text import cached_expr
    keep_link = cached_expr(("keep_link", repr(cfg)), lambda: F.filter(
        "links", lambda l: should_enqueue(l, F.col("domain"), cfg, MAX_PATH_SLASHES, True)))
    keep_edge = cached_expr(("keep_edge", repr(cfg)), lambda: should_enqueue(
        F.col("dst"), F.col("domain"), cfg, MAX_PATH_SLASHES, True))
    depth = 0
    while cfg.max_depth is None or depth < cfg.max_depth:
        depth += 1
        parents = level
        if robots is not None:
            parents = robots_allowed(parents, robots, cfg)
        parents = parents.join(readable, "url")
        frontier = parents.select(
            "target_idx", "domain", F.col("visit_rank").alias("parent_rank"),
            F.explode(keep_link).alias("url"))
        if edges is not None:
            frontier = frontier.unionByName(
                parents.join(extra, parents.url == extra.src)
                .filter(keep_edge)
                .select("target_idx", "domain", F.col("visit_rank").alias("parent_rank"), F.col("dst").alias("url")))
        fresh = frontier.join(visits.seen_by(level), ["target_idx", "url"], "left_anti") \
            .groupBy("target_idx", "domain", "url").agg(F.min("parent_rank").alias("parent_rank"))
        base = level.groupBy("target_idx").agg(F.max("visit_rank").alias("_base"))
        fresh = _ranked(fresh, cfg.max_pages).join(base, "target_idx") \
            .withColumn("visit_rank", (F.col("_base") + F.col("_rank")).cast("int"))
        if cfg.max_pages is not None:
            fresh = fresh.filter(F.col("visit_rank") <= cfg.max_pages)
        level = visits.add(fresh.select("target_idx", "domain", "url", F.lit(depth).alias("depth"), "visit_rank"))
        if level.isEmpty():
            break
    return visits.table()


def _ranked(fresh: DataFrame, limit: int | None) -> DataFrame:
    """``_rank`` of the new pages of each target by (parent's rank, URL).

    With a limit the window keeps that many rows of a target (a partial limit
    runs before the shuffle).  Without one, pages are ranked in pieces of a
    few parents each, so that a large frontier is spread over tasks.
    """
    order = ["parent_rank", "url"]
    if limit is not None:
        w = Window.partitionBy("target_idx").orderBy(*order)
        return fresh.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= limit)
    return rank_in_pieces(fresh, ["target_idx"], [F.floor(F.col("parent_rank") / PARENTS_PER_PIECE)], order, "_rank")


def visit_outcomes(visits: DataFrame, content: DataFrame, robots: DataFrame | None, cfg: MiningConfig) -> DataFrame:
    """Visits joined with their page: ``fetched``, ``failure`` and content columns.

    A URL with no capture is a failed read (warning); a robots-blocked or
    non-HTML page is visited without content and without warning.
    """
    from ..sources.robots import robots_flag

    v = visits if robots is None else robots_flag(visits, robots, cfg)
    if "allowed" not in v.columns:
        v = v.withColumn("allowed", F.lit(True))
    joined = v.join(content, "url", "left")
    captured = F.col("page_id").isNotNull()
    return joined.withColumn(
        "failure",
        F.when(~F.col("allowed"), F.lit(None).cast("string"))
        .when(~captured, F.concat(F.col("url"), F.lit(": page not captured")))
        .when(F.col("failure").isNotNull(), F.concat(F.col("url"), F.lit(": "), F.col("failure")))
    ).withColumn("fetched", F.col("allowed") & captured & F.coalesce(F.col("is_html"), F.lit(False)))


def candidates(outcomes: DataFrame, targets: DataFrame, cfg: MiningConfig) -> DataFrame:
    """Pages scoring at least the threshold, ranked by score desc then visit order."""
    t = targets.select("target_idx", F.col("name").alias("university_name"), "country")
    kept = outcomes.filter(F.col("fetched") & (F.col("candidate_score") >= cfg.min_score)).join(t, "target_idx")
    piece = [-F.col("candidate_score"), F.floor(F.col("visit_rank") / PAGES_PER_PIECE)]
    return rank_in_pieces(kept, ["target_idx"], piece, ["visit_rank"], "candidate_rank") \
        .withColumn("candidate_rank", F.col("candidate_rank").cast("int")).withColumn("needs_review", F.lit("Yes"))
