"""Key resolution joins: titles, redirects, links, categories, talk pages.

All joins are equi-joins on a key column; the planner chooses broadcast or
sort-merge from sizes, AQE splits hot keys (a hub article that a third of all
links point to lands in one partition of the big side only, and that
partition is split while the one-row-per-key lookup side is replicated).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_titles(titles: DataFrame) -> DataFrame:
    """One id per title: a repeated title keeps the largest id (the last page wins)."""
    return titles.groupBy("title").agg(F.max("id").alias("id"))


def resolve_redirects(redirects: DataFrame, titles: DataFrame) -> DataFrame:
    """(title, target_title) -> (title, target_title, target_id); one hop, target must exist."""
    t = titles.select(F.col("title").alias("target_title"), F.col("id").alias("target_id"))
    return redirects.join(t, "target_title", "inner").select("title", "target_title", "target_id")


def title_resolver(titles: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """A single ``(title, id)`` lookup covering page titles and redirect titles.

    Resolving a link through a redirect and then to an id is two look-ups; the
    resolver folds them into one table so the (large) link side is shuffled
    once.  A redirect title wins over a page title of the same spelling, as the
    redirect map is consulted first.
    """
    direct = titles.select("title", "id", F.lit(1).alias("prio"))
    if redirects is None:
        return direct.groupBy("title").agg(F.max("id").alias("id"))
    # a broken redirect keeps its title with no id, so the link is dropped and
    # never falls back to a page of the same spelling
    t = titles.select(F.col("title").alias("target_title"), "id")
    via = (redirects.select("title", "target_title").join(t, "target_title", "left")
           .select("title", "id", F.lit(0).alias("prio")))
    both = direct.unionByName(via)
    best = (both.groupBy("title")
            .agg(F.min_by(F.struct("id"), F.struct(F.col("prio"), F.col("id").isNull(), -F.col("id"))).alias("b")))
    return best.select("title", "b.id").where(F.col("id").isNotNull())


def resolve_titles(df: DataFrame, titles: DataFrame, col: str = "title",
                   out: str = "id", how: str = "left") -> DataFrame:
    """Attach the id of ``df[col]``; NULL when the title is unknown (``how='left'``)."""
    t = titles.select(F.col("title").alias(col), F.col("id").alias(out))
    return df.join(t, col, how)


def attach_titles(df: DataFrame, titles: DataFrame, id_col: str = "id",
                  out: str = "title", how: str = "left") -> DataFrame:
    """Attach the title of ``df[id_col]``; NULL for an absent id (never a neighbour's)."""
    t = titles.select(F.col("id").alias(id_col), F.col("title").alias(out))
    return df.join(t, id_col, how)


def resolve_links(raw_links: DataFrame, titles: DataFrame,
                  redirects: DataFrame | None = None) -> DataFrame:
    """(id, pos, link title) -> (id, pos, link_id).

    The link goes through at most one redirect, then to an id; unresolved links
    are dropped, duplicates and positions kept.
    """
    resolver = title_resolver(titles, redirects).select(
        F.col("title").alias("link"), F.col("id").alias("link_id"))
    return raw_links.join(resolver, "link", "inner").select("id", "pos", "link_id")


def resolve_categories(raw_categories: DataFrame, titles: DataFrame) -> DataFrame:
    """(id, pos, category title) -> (id, pos, category_id); unresolved dropped."""
    t = titles.select(F.col("title").alias("category"), F.col("id").alias("category_id"))
    return raw_categories.join(t, "category", "inner").select("id", "pos", "category_id")


def talk_to_article(talk: DataFrame, titles: DataFrame, prefix: str = "Talk:") -> DataFrame:
    """(talk_id, talk title) -> (talk_id, real_id): the article titled like the talk page minus its prefix."""
    t = talk.where(F.col("title").startswith(prefix)).select(
        F.col("id").alias("talk_id"),
        F.expr(f"substring(title, {len(prefix) + 1})").alias("article_title"))
    a = titles.select(F.col("title").alias("article_title"), F.col("id").alias("real_id"))
    return t.join(a, "article_title", "inner").select("talk_id", "real_id")


def titles_for_lists(edges: DataFrame, titles: DataFrame, key: str = "id",
                     member: str = "category_id", pos: str = "pos",
                     sep: str = " | ", out: str = "titles") -> DataFrame:
    """Per key, the titles of its members joined by ``sep`` in ``pos`` order.

    A key with any member without a title is dropped entirely.  The group is
    one article's own list (bounded by the size of one page), never a
    category's member list.
    """
    t = titles.select(F.col("id").alias(member), F.col("title").alias("_t"))
    j = edges.join(t, member, "left")
    g = (j.groupBy(key)
         .agg(F.count(F.lit(1)).alias("_n"), F.count("_t").alias("_m"),
              F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("_t").alias("t"))))
              .alias("_l")))
    return (g.where(F.col("_n") == F.col("_m"))
            .select(key, F.array_join(F.col("_l.t"), sep).alias(out)))


def validate_words(queries: DataFrame, vocabulary: DataFrame, col: str = "word") -> tuple[DataFrame, DataFrame]:
    """(present, missing) query rows by membership of ``col`` in the vocabulary."""
    v = vocabulary.select(col).distinct()
    return queries.join(v, col, "left_semi"), queries.join(v, col, "left_anti")
