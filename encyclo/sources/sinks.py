"""Sinks: table export, the ``articles`` server table, keyed updates.

The server table is any DataFrame target: Parquet (default) or JDBC, with
connection options passed in by the caller (no credentials in code).
Updates are written as a new version (``join`` + ``coalesce``) rather than
row-by-row statements; inserts ignore ids already present (``left_anti``).
"""

from __future__ import annotations

from functools import reduce

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve as R

NONE = "NONE"


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write every table under ``path/<name>``; ``fmt='tsv'`` writes keyed text lines."""
    for name, df in tables.items():
        if fmt == "parquet":
            df.write.mode(mode).parquet(f"{path}/{name}")
        else:
            to_tsv_lines(df).write.mode(mode).text(f"{path}/{name}")


def to_tsv_lines(df: DataFrame) -> DataFrame:
    """One text line per row, fields joined by tabs; arrays joined by spaces.  Tabs and line
    breaks inside a field become spaces, so a row stays a line."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() == "array":
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
        c = c.cast("string")
        if f.dataType.typeName() in ("string", "array"):
            c = F.translate(c, "\t\n\r", "   ")
        cols.append(F.coalesce(c, F.lit("")))
    return df.select(F.concat_ws("\t", *cols).alias("value"))


def export_sorted(df: DataFrame, path: str, key: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as text lines sorted by ``key``, its first column, and return the manifest.

    Rows are range-partitioned and sorted inside each part: the part files, read in the order
    of their names, are one sorted table, and no task sorts more than its range.  The
    manifest is read back from the files: (file, n_rows, first_key, last_key); it is stored
    as JSON under ``path``/_manifest, where readers of the lines do not see it.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType
    df = df.select(key, *[c for c in df.columns if c != key])
    parts = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    to_tsv_lines(parts.sortWithinPartitions(key)).write.mode("overwrite").text(path)
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\t")[0].cast(kind).alias("k"))
    manifest = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.min("k").alias("first_key"), F.max("k").alias("last_key"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/_manifest")
    return spark.read.schema(manifest.schema).json(f"{path.rstrip('/')}/_manifest")


def keyed_lists(edges: DataFrame, key: str = "id", item: str = "link_id", pos: str = "pos") -> DataFrame:
    """Edge table -> (key, items array) in position order (one article's own list)."""
    return (edges.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct(pos, item))).alias("_l"))
            .select(key, F.col(f"_l.{item}").alias(item + "s")))


def _multi(col: Column) -> Column:
    """' | '-joined values, or NONE when empty; quotes escaped."""
    s = F.array_join(col, " | ")
    return F.when(F.coalesce(F.size(col), F.lit(0)) > 0, _escape(s)).otherwise(F.lit(NONE))


def _escape(c: Column) -> Column:
    return F.replace(c, F.lit("'"), F.lit("&squot"))


def articles_projection(titles: DataFrame, pages: DataFrame | None = None, *, categories: DataFrame | None = None,
                        domains: DataFrame | None = None, authors: DataFrame | None = None,
                        quality: DataFrame | None = None, importance: DataFrame | None = None,
                        now: Column | None = None, all_titles: DataFrame | None = None) -> DataFrame:
    """Rows of the ``articles`` table for non-redirect articles:
    id, title, categories, cited_domains, cited_authors, quality, importance,
    created_at, updated_at, slug.  ``all_titles`` (default ``titles``) names
    the categories."""
    now = now if now is not None else F.current_timestamp()
    base = titles.select("id", "title")
    if pages is not None:
        base = base.join(pages.where((F.col("ns") == 0) & F.col("redirect").isNull()).select("id"), "id", "left_semi")

    def lists(df, item, out):
        if df is None:
            return None
        return df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", item))).alias("_l")) \
                 .select("id", F.col(f"_l.{item}").alias(out))
    out = base
    if categories is not None:
        names = all_titles if all_titles is not None else titles
        cat_titles = R.attach_titles(categories, names, id_col="category_id", out="cat_title", how="inner")
        out = out.join(lists(cat_titles, "cat_title", "_cats"), "id", "left")
    else:
        out = out.withColumn("_cats", F.lit(None).cast("array<string>"))
    for df, item, name in ((domains, "domain", "_doms"), (authors, "author", "_auths")):
        out = out.join(lists(df, item, name), "id", "left") if df is not None else \
            out.withColumn(name, F.lit(None).cast("array<string>"))
    for df, c in ((quality, "quality"), (importance, "importance")):
        out = out.join(df.select("id", c), "id", "left") if df is not None else out.withColumn(c, F.lit(None))
    return out.select("id", *article_columns("_cats", "_doms", "_auths", now))


def article_columns(categories: str, domains: str, authors: str, now: Column) -> list[Column]:
    """Columns of an ``articles`` row after its id, from title, the three lists, quality and importance."""
    return [
        _escape(F.col("title")).alias("title"),
        _multi(F.col(categories)).alias("categories"),
        _multi(F.col(domains)).alias("cited_domains"),
        _multi(F.col(authors)).alias("cited_authors"),
        F.coalesce(F.col("quality").cast("string"), F.lit("N/A")).alias("quality"),
        F.coalesce(F.col("importance").cast("string"), F.lit("N/A")).alias("importance"),
        now.alias("created_at"), now.alias("updated_at"),
        _escape(F.replace(F.col("title"), F.lit(" "), F.lit("_"))).alias("slug")]


def insert_ignore(target: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """``target`` plus the rows whose key is not there yet (ON CONFLICT DO NOTHING)."""
    fresh = rows.dropDuplicates([key]).join(target.select(key), key, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def update_columns(target: DataFrame, updates: DataFrame, key: str = "id",
                   cols: list[str] | None = None, touch: str | None = "updated_at") -> DataFrame:
    """New version of ``target`` with ``cols`` taken from ``updates`` where given."""
    cols = cols or [c for c in updates.columns if c != key]
    u = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    j = target.join(u, key, "left")
    out = []
    for c in target.columns:
        if c in cols:
            out.append(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c))
        elif c == touch:
            hit = reduce(lambda a, b: a | b, [F.col(f"_new_{x}").isNotNull() for x in cols])
            out.append(F.when(hit, F.current_timestamp()).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    extra = [F.col(f"_new_{c}").alias(c) for c in cols if c not in target.columns]
    return j.select(*out, *extra)


def delete_rows(target: DataFrame, keys: DataFrame | None = None, key: str = "id",
                title: str | None = None) -> DataFrame:
    """Without ``keys``/``title``: empty table.  Else drop matching keys / the title."""
    if keys is None and title is None:
        return target.limit(0)
    out = target
    if keys is not None:
        out = out.join(keys.select(key), key, "left_anti")
    if title is not None:
        out = out.where(F.col("title") != title)
    return out


def read_articles(spark: SparkSession, path: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """The articles table from Parquet, or through JDBC with caller-given options."""
    if jdbc:
        return spark.read.format("jdbc").options(**jdbc).load()
    return spark.read.parquet(path)


def write_articles(df: DataFrame, path: str | None = None, jdbc: dict | None = None, mode: str = "append",
                   batchsize: int = 20000) -> None:
    if jdbc:
        df.write.format("jdbc").options(batchsize=str(batchsize), **jdbc).mode(mode).save()
    else:
        df.write.mode(mode).parquet(path)


def table_stats(spark: SparkSession, path: str) -> DataFrame:
    """Row count and bytes on disk of a Parquet table: (n_rows, n_files, n_bytes).
    The row count is a scalar subquery next to the file-size aggregate."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.parquet").load(path).select("length"))
    n_rows = spark.read.parquet(path).select(F.count(F.lit(1))).scalar()
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes")) \
        .select(n_rows.alias("n_rows"), "n_files", "n_bytes")


def category_report(largest: DataFrame) -> DataFrame:
    """``String | ID | Article Count`` report lines: header, then largest first."""
    head = largest.sparkSession.createDataFrame([(0, "String | ID | Article Count")], "g int, value string")
    body = largest.select(F.lit(1).alias("g"), "size", "category_id",
                          F.concat_ws(" | ", "title", F.col("category_id").cast("string"),
                                      F.col("size").cast("string")).alias("value"))
    return (head.unionByName(body, allowMissingColumns=True)
            .orderBy("g", F.col("size").desc(), "category_id").select("value"))


_VERSION = re.compile(r"(\d{4}-\d{2}-\d{2}[_T]\d{2}[-:]\d{2}[-:]\d{2})")


def latest_version(paths: list[str]) -> str | None:
    """The path whose name holds the newest ``YYYY-MM-DD_HH-MM-SS`` stamp."""
    stamped = [(m.group(1).replace("T", "_").replace(":", "-"), p) for p in paths if (m := _VERSION.search(p))]
    return max(stamped)[1] if stamped else None


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def write_vocab(word2vec_model, path: str) -> None:
    word2vec_model.getVectors().select("word").write.mode("overwrite").text(path)
