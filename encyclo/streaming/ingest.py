"""Incremental page ingest with Structured Streaming.

Page files (Parquet rows as produced by ``read_dump``) are picked up by a file
stream in any order: a talk page before or after its article, a category page
after the articles in it, a redirect after the links through it.  Each
micro-batch is merged into keyed tables (``sources.keyed``), so it reads and
rewrites only the buckets of the keys it touches:

* ``titles``   every non-redirect page by title
* ``redirects`` redirect pages by title
* ``facts``    what an article's own page says, by id; the first page of an id counts
* ``ratings``  talk-page ratings by the article's title
* ``members``  articles by the title of a category they name
* ``articles`` the result by id: rows as in ``articles_projection``

A batch brings articles up to date that are new, whose title came again, whose
talk page came, or that name a category whose page came; their rows are made
from the stored tables and merged.  After any sequence of batches the articles
(and ``links``) equal those of one batch of all pages; of pages that repeat a
title the one with the largest id counts, as there.  A batch that is replayed
writes nothing, and so does a batch of known pages from another stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..operators import resolve as R
from ..operators.pages import after, filter_after, is_article, is_category, is_redirect, is_talk
from ..session import reliable_checkpoint
from ..sources.keyed import Batch, KeyedTable
from ..sources.sinks import article_columns

PAGE_COLUMNS = "id bigint, ns int, title string, redirect string, ts timestamp, raw_text string"
TALK = "Talk:"
CATEGORY = "Category:"
ARTICLE = ("id bigint, title string, categories string, cited_domains string, cited_authors string, quality string, "
           "importance string, created_at timestamp, updated_at timestamp, slug string, current boolean")


class IngestState:
    """The stored tables of an ingest under ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        def table(name: str, key: str, schema: str, spread: int = 1) -> KeyedTable:
            return KeyedTable(spark, f"{path.rstrip('/')}/{name}", key, schema, buckets, spread)

        self.titles = table("titles", "title", "title string, id bigint")
        self.redirects = table("redirects", "title", "title string, target_title string")
        self.facts = table("facts", "id", "id bigint, title string, categories array<string>, domains array<string>, "
                           "authors array<string>, links array<string>")
        self.ratings = table("ratings", "title", "title string, talk_id bigint, quality string, importance string")
        # a category may hold a third of all articles: its rows lie in many buckets
        self.members = table("members", "category", "category string, id bigint", spread=min(16, buckets))
        self.articles_table = table("articles", "id", ARTICLE)

    def articles(self) -> DataFrame:
        """The articles as of the last batch."""
        return self.articles_table.read().where("current").drop("current")

    def links(self) -> DataFrame:
        """(id, pos, link_id) of the articles, through the redirects known by now."""
        raw = self.facts.read().select("id", F.posexplode("links").alias("pos", "link"))
        return R.resolve_links(raw, R.unique_titles(self.titles.read()), self.redirects.read())

    def add(self, pages: DataFrame, batch: Batch, cutoff: str | None = None) -> None:
        """Merge one batch of pages.  Every step leaves the tables fit for the next attempt:
        tables that have the batch already skip it, the others go on."""
        if self.articles_table.done(batch):
            return
        pages = reliable_checkpoint(pages.select("id", "ns", "title", "redirect", "ts", "raw_text"))
        plain = pages.where(~is_redirect())
        inside = filter_after(plain, cutoff) if cutoff else plain

        self.titles.append(plain.select("title", "id"), batch)
        self.redirects.append(pages.where(is_redirect()).select("title", F.col("redirect").alias("target_title")), batch)
        self.facts.insert_ignore(_facts(plain.where(is_article()), cutoff), batch)
        talk = inside.where(is_talk() & F.col("title").startswith(TALK)).select(
            F.expr(f"substring(title, {len(TALK) + 1})").alias("title"), F.col("id").alias("talk_id"),
            M.clean_talk("raw_text").alias("t"))
        self.ratings.append(talk.select("title", "talk_id", M.extract_quality("t").alias("quality"),
                                        M.extract_importance("t").alias("importance")), batch)
        own = self.facts.lookup(plain.where(is_article()).select("id"))
        self.members.append(own.select(F.explode("categories").alias("category"), "id"), batch)

        titles = plain.select("title").unionByName(talk.select("title"))
        touched = self.titles.lookup(titles).select("id").unionByName(
            self.members.lookup(plain.where(is_category() | F.col("title").startswith(CATEGORY))
                                .select(F.col("title").alias("category"))).select("id"))
        rows = self._rows(reliable_checkpoint(touched.distinct()))
        self.articles_table.merge(rows, batch, keep=lambda old, new, c: (old if c == "created_at" else new)[c],
                                  ignore=("created_at", "updated_at"))

    def _rows(self, ids: DataFrame) -> DataFrame:
        """Rows of the articles among ``ids`` from the stored tables."""
        facts = reliable_checkpoint(self.facts.lookup(ids))
        named = facts.select("id", F.posexplode("categories").alias("pos", "title"))
        known = self.titles.lookup(named.select("title")).select("title").distinct()
        cats = (named.join(known, "title", "left_semi").groupBy("id")
                .agg(F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("l"))
                .select("id", F.col("l.title").alias("_cats")))
        current = self.titles.lookup(facts.select("title")).groupBy("title").agg(F.max("id").alias("_current"))
        rated = (self.ratings.lookup(facts.select("title")).groupBy("title")
                 .agg(F.max_by(F.struct("quality", "importance"), "talk_id").alias("r"))
                 .select("title", "r.quality", "r.importance"))
        return (facts.drop("categories").join(cats, "id", "left").join(current, "title").join(rated, "title", "left")
                .select("id", *article_columns("_cats", "domains", "authors", F.current_timestamp()),
                        (F.col("_current") == F.col("id")).alias("current")))


def _facts(articles: DataFrame, cutoff: str | None) -> DataFrame:
    """What the article pages say by themselves; those before the cut-off say nothing but their title."""
    text = F.when(F.lit(True) if cutoff is None else after(cutoff), F.coalesce("raw_text", F.lit(""))).otherwise(F.lit(""))
    cites = articles.select("id", "title", text.alias("t")).withColumn("c", M.extract_citations("t"))
    return cites.select("id", "title", M.extract_categories("t").alias("categories"), M.extract_domains("c").alias("domains"),
                        M.extract_authors("c").alias("authors"), M.extract_links("t").alias("links"))


def stream_ingest(spark: SparkSession, pages_dir: str, state: IngestState, checkpoint: str, cutoff: str | None = None,
                  available_now: bool = True, files_per_batch: int | None = None):
    """Start the ingest stream; with ``available_now`` it processes what is there and stops."""
    src = spark.readStream.schema(PAGE_COLUMNS)
    if files_per_batch:
        src = src.option("maxFilesPerTrigger", files_per_batch)
    src = src.parquet(pages_dir)

    def each(batch: DataFrame, epoch_id: int) -> None:
        state.add(batch, (checkpoint, epoch_id), cutoff)

    w = src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
