"""Pages, their links, and the walk over a link graph."""

from __future__ import annotations

import html
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.text import INSIDE_TAG, html_text
from shelfspark.operators.scan import explode_rows
from shelfspark.storage import cut_lineage, spread

_ANCHOR = rf"(?is)<a(?=[\s>/]){INSIDE_TAG}>"
_HREF = r"(?is)\shref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*)"


def page_texts(pages: DataFrame) -> DataFrame:
    """(url, text) of each page; the address serves as file name."""
    return spread(pages, "url").select(
        "url", F.col("url").alias("file_name"), html_text(F.col("html")).alias("text")
    )


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def resolve(base: Column, href: Column) -> Column:
    """``href`` against ``base``. Plain root-relative links stay in the JVM."""

    @F.pandas_udf(T.StringType())
    def joined(bases: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if link is None else urljoin(at, html.unescape(link))
                for at, link in zip(bases, links, strict=True)
            ]
        )

    simple = href.rlike(r"\A/(?!/)[^&?#;.]*\z") & (origin(base) != "")
    return F.when(simple, F.concat(origin(base), href)).otherwise(
        joined(base, F.when(~simple, href))
    )


def links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst): links below the page's own address, fragments dropped."""
    tags = F.array_distinct(F.regexp_extract_all("html", F.lit(_ANCHOR), 0))
    anchors = explode_rows(
        spread(pages, "url").select(F.col("url").alias("src"), tags.alias("_tags")), "_tags", "tag"
    )
    quoted = F.regexp_extract("tag", _HREF, 1)
    href = F.trim(F.regexp_replace(quoted, r"\A[\"']|[\"']\z", ""))
    targets = anchors.select("src", href.alias("href")).distinct()
    return (
        targets.withColumn("dst", resolve(F.col("src"), F.col("href")))
        .where(F.col("dst").startswith(F.col("src")))
        .select("src", F.substring_index("dst", "#", 1).alias("dst"))
        .distinct()
    )


#: Pages of a level that are sent to where the visited ones lie; larger levels are joined by shuffle.
BROADCAST_PAGES = 200_000


class Visited:
    """Pages (root, url) that have been reached, in runs that are merged as they double.

    A level is compared with the runs where they lie: it is sent to them if it is small, so
    they are not shuffled. Each page is rewritten once for each doubling, a logarithmic number
    of times, however many levels a walk has.
    """

    def __init__(self):
        self.runs: list[tuple[int, DataFrame]] = []
        self.rewritten = 0

    def add(self, pages: DataFrame, n: int) -> None:
        self.runs.append((n, pages))
        while len(self.runs) > 1 and self.runs[-2][0] <= 2 * self.runs[-1][0]:
            (m, other), (n, pages) = self.runs[-2:]
            parts = max(1, -(-(m + n) // BROADCAST_PAGES))
            self.runs[-2:] = [(m + n, cut_lineage(other.unionByName(pages).repartition(parts, "root", "url")))]
            self.rewritten += m + n

    def unseen(self, pages: DataFrame, n: int) -> DataFrame:
        """Those of ``pages`` (distinct, counted) that no run has."""
        small = n <= BROADCAST_PAGES
        for _, run in self.runs:
            if small:
                met = run.join(F.broadcast(pages), ["root", "url"], "left_semi")  # at most the pages asked for
                pages = pages.join(F.broadcast(met), ["root", "url"], "left_anti")
            else:
                pages = pages.join(run, ["root", "url"], "left_anti")
        return pages


def crawl(
    edges: DataFrame, roots: DataFrame, exclude: tuple[str, ...] = (), max_depth: int = -1
) -> DataFrame:
    """Pages reached from each root (root, url, depth, n_emitted), depth being the distance.

    Every unseen child of an expanded page is emitted once; children ending in a slash are
    expanded in turn and so emitted a second time. Excluded prefixes are not expanded.
    ``edges`` are the (src, dst) of ``links``, read once from their pages and kept for all
    levels. One job per level; each level is checkpointed, so a lost executor does not
    replay the walk.
    """
    edges = cut_lineage(edges.select("src", "dst"))

    def expandable(frontier: DataFrame, depth: int) -> DataFrame:
        if 0 < max_depth <= depth:
            return frontier.where(F.lit(False))
        for prefix in exclude:
            frontier = frontier.where(~F.col("url").startswith(prefix))
        return frontier

    frontier = cut_lineage(roots.select("root", F.col("root").alias("url")).distinct())
    visited = Visited()
    visited.add(expandable(frontier, 0), frontier.count())
    emitted = []
    depth = 0
    while True:
        opened = expandable(frontier, depth)
        emitted.append(opened.select("root", "url", F.lit(depth).alias("depth")))
        children = cut_lineage(
            opened.join(edges.select(F.col("src").alias("url"), "dst"), "url")
            .select("root", F.col("dst").alias("url"))
            .distinct()
        )
        fresh = cut_lineage(visited.unseen(children, children.count()))
        n = fresh.count()
        if not n:
            break
        depth += 1
        emitted.append(fresh.select("root", "url", F.lit(depth).alias("depth")))
        visited.add(fresh, n)
        frontier = fresh.where(F.col("url").endswith("/"))
    every = emitted[0]
    for part in emitted[1:]:
        every = every.unionByName(part)
    return every.groupBy("root", "url").agg(
        F.min("depth").alias("depth"), F.count(F.lit(1)).cast("int").alias("n_emitted")
    )
