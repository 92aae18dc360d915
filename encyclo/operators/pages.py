"""Pages -> keyed tables (titles, redirects, text, categories, links, domains,
authors, quality, importance, category parents).

Every branch is a filter on the page kind plus native column expressions,
and a join against the title resolver.  Store the parsed dump once with
``sources.dump.write_pages`` (Parquet partitioned by namespace): each branch
then reads only its namespace partition and its columns, and the cut-off
becomes a pushed-down timestamp range.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup as M
from . import resolve as R

ARTICLE_NS, TALK_NS, CATEGORY_NS = 0, 1, 14


def is_article(ns: str = "ns") -> Column:
    return F.col(ns) == ARTICLE_NS


def is_talk(ns: str = "ns") -> Column:
    return F.col(ns) == TALK_NS


def is_category(ns: str = "ns") -> Column:
    return F.col(ns) == CATEGORY_NS


def is_redirect(col: str = "redirect") -> Column:
    return F.coalesce(F.length(F.col(col)) > 0, F.lit(False))


def is_disambiguation(col: str = "title") -> Column:
    return F.col(col).contains("(disambiguation)")


def after(yyyymmdd: str, ts: str = "ts") -> Column:
    """Whether the date is strictly after ``yyyymmdd``: ``ts >= day + 1`` (a pushable range)."""
    return F.col(ts) >= F.lit(dt.datetime.strptime(yyyymmdd, "%Y%m%d") + dt.timedelta(days=1))


def filter_after(pages: DataFrame, yyyymmdd: str = "20010115", ts: str = "ts") -> DataFrame:
    """Pages whose date is strictly after ``yyyymmdd``."""
    return pages.where(after(yyyymmdd, ts))


def titles_table(pages: DataFrame) -> DataFrame:
    """(id, title) of non-redirect pages of every namespace; a repeated title keeps the largest id."""
    return R.unique_titles(pages.where(~is_redirect()).select("id", "title"))


def redirects_table(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """(title, target_title, target_id): one hop, the target must exist."""
    red = pages.where(is_redirect()).select("title", F.col("redirect").alias("target_title"))
    return R.resolve_redirects(red, titles)


def build_tables(pages: DataFrame, cutoff: str | None = "20010115",
                 truncate_at_bullet: bool = False, titles: DataFrame | None = None,
                 redirects: DataFrame | None = None) -> dict[str, DataFrame]:
    """All keyed tables of a dump (``pages`` as from ``read_dump``).

    ``titles``/``redirects`` of the whole corpus may be passed in when
    ``pages`` is only a part of it (incremental ingest)."""
    titles = titles if titles is not None else titles_table(pages)
    # links are resolved over all redirects, the broken ones too: those drop the link
    every = redirects if redirects is not None else pages.where(is_redirect()).select(
        "title", F.col("redirect").alias("target_title"))
    redirects = redirects if redirects is not None else redirects_table(pages, titles)
    body = filter_after(pages, cutoff) if cutoff else pages
    body = body.where(~is_redirect())
    articles = body.where(is_article()).select("id", "raw_text")
    cats_pages = body.where(is_category()).select("id", "raw_text")
    talk = body.where(is_talk()).select("id", "title", "raw_text")

    text = articles.select("id", M.clean_text("raw_text", truncate_at_bullet).alias("text"))

    def cat_edges(df: DataFrame) -> DataFrame:
        raw = df.select("id", F.posexplode(M.extract_categories("raw_text")).alias("pos", "category"))
        return R.resolve_categories(raw, titles)

    categories = cat_edges(articles)
    parents = cat_edges(cats_pages).select(F.col("id").alias("child_id"),
                                           F.col("category_id").alias("parent_id"), "pos")
    raw_links = articles.select("id", F.posexplode(M.extract_links("raw_text")).alias("pos", "link"))
    links = R.resolve_links(raw_links, titles, every.select("title", "target_title"))

    cites = articles.select("id", M.extract_citations("raw_text").alias("c"))
    domains = cites.select("id", F.posexplode(M.extract_domains("c")).alias("pos", "domain"))
    authors = cites.select("id", F.posexplode(M.extract_authors("c")).alias("pos", "author"))

    talk_clean = talk.select(F.col("id").alias("talk_id"), "title", M.clean_talk("raw_text").alias("t"))
    talk_map = R.talk_to_article(talk_clean.select(F.col("talk_id").alias("id"), "title"), titles)
    rated = talk_clean.join(talk_map, "talk_id", "inner")
    quality = rated.select(F.col("real_id").alias("id"), M.extract_quality("t").alias("quality"))
    importance = rated.select(F.col("real_id").alias("id"), M.extract_importance("t").alias("importance"))
    return {"titles": titles, "redirects": redirects, "text": text, "categories": categories,
            "links": links, "domains": domains, "authors": authors, "quality": quality,
            "importance": importance, "category_parents": parents}
