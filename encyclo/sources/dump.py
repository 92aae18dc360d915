"""MediaWiki XML dump reader.

A dump is read as text records that end at ``</page>``: the text source cuts a
file into byte ranges (``spark.sql.files.maxPartitionBytes``), every task
starts at the first record end in its range and reads its last record to the
end, so one file of any length is read by as many tasks as it has ranges --
also a ``.bz2``, whose codec can be split; a ``.gz`` is one task.  Each record
is parsed on its own with an explicit schema, so a broken page spoils no other
and is kept with the reason instead of vanishing:

* ``unclosed``   a page that another one starts inside of
* ``malformed``  not well-formed XML, or a field that has not its type
* ``no id``, ``no title``, ``no namespace``

Text before the first page, between pages and after the last is no page.  A
file that ends inside a page gives a broken page (``malformed``).  Nothing runs
in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import norm_key

PAGE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("ns", T.IntegerType()),
    T.StructField("id", T.LongType()),
    T.StructField("redirect", T.StructType([T.StructField("_title", T.StringType())])),
    T.StructField("revision", T.StructType([
        T.StructField("timestamp", T.StringType()),
        T.StructField("text", T.StructType([T.StructField("_VALUE", T.StringType())])),
    ])),
    T.StructField("_broken", T.StringType()),
])

OPEN, CLOSE = "<page>", "</page>"
PAGE_COLUMNS = ["id", "ns", "title", "redirect", "ts", "raw_text"]


def _problem(page: Column) -> Column:
    return (F.when(page.isNull() | page["_broken"].isNotNull(), "malformed")
            .when(page["id"].isNull(), "no id")
            .when(F.coalesce(F.length(page["title"]), F.lit(0)) == 0, "no title")
            .when(page["ns"].isNull(), "no namespace"))


def scan_dump(spark: SparkSession, path: str) -> DataFrame:
    """Every ``<page>`` of a dump, sound or broken:
    (id, ns, title, redirect, ts, raw_text, problem, source, file).

    ``problem`` is null for a sound page; a broken one has its XML in
    ``source``, null otherwise, and null page fields.  ``file`` is the file it comes from.
    """
    records = (spark.read.option("lineSep", CLOSE).text(path)
               .select(F.col("_metadata.file_path").alias("file"), F.split("value", OPEN).alias("parts")))
    # the last start in a record is the page that the record's end closes
    starts = records.select("file", F.posexplode("parts").alias("at", "body"), F.size("parts").alias("n")).where("at > 0")
    parsed = starts.select("file", "body", (F.col("at") == F.col("n") - 1).alias("closed"), F.when(
        F.col("at") == F.col("n") - 1,
        F.from_xml(F.concat(F.lit(OPEN), "body", F.lit(CLOSE)), PAGE_SCHEMA,
                   {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})).alias("p"))
    problem = F.when(~F.col("closed"), "unclosed").otherwise(_problem(F.col("p")))
    sound = F.col("problem").isNull()
    target = F.col("p.redirect._title")
    fields = {
        "id": F.col("p.id"), "ns": F.col("p.ns"), "title": norm_key(F.col("p.title"), capitalize=False),
        "redirect": F.when(F.length(target) > 0, norm_key(target)),
        "ts": F.to_timestamp(F.col("p.revision.timestamp")),
        "raw_text": F.coalesce(F.col("p.revision.text._VALUE"), F.lit("")),
    }
    return parsed.withColumn("problem", problem).select(
        *[F.when(sound, c).alias(n) for n, c in fields.items()], "problem",
        F.when(~sound, F.concat(F.lit(OPEN), "body")).alias("source"), "file")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Sound pages of a dump: (id, ns, title, redirect, ts, raw_text).

    Titles keep their spelling with spaces -> '_'; a redirect target is
    normalized like a link (first letter upper-cased, spaces -> '_'); NULL for
    non-redirect pages.  Broken pages are in ``broken_pages`` and, counted, in
    ``stage_dump``.
    """
    return scan_dump(spark, path).where(F.col("problem").isNull()).select(*PAGE_COLUMNS)


def broken_pages(spark: SparkSession, path: str) -> DataFrame:
    """(problem, file, source) of the pages that ``read_dump`` leaves out."""
    return scan_dump(spark, path).where(F.col("problem").isNotNull()).select("problem", "file", "source")


def stage_dump(spark: SparkSession, path: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Parse a dump once into ``out``, broken pages apart and sound ones by namespace.
    Returns (pages as from ``read_dump``, pages as from ``broken_pages``), both stored."""
    scan_dump(spark, path).withColumn("broken", F.col("problem").isNotNull().cast("int")) \
        .write.mode("overwrite").partitionBy("broken", "ns").parquet(out)
    stored = spark.read.parquet(out)
    pages = stored.where("broken = 0").select("id", F.col("ns").cast("int").alias("ns"), "title", "redirect", "ts", "raw_text")
    return pages, stored.where("broken = 1").select("problem", "file", "source")


def write_pages(pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store parsed pages once as Parquet, partitioned by namespace.

    Every table of ``build_tables`` filters one namespace (articles 0, talk 1,
    categories 14): on the stored table those filters prune whole partitions,
    and only the needed columns are read -- the XML is parsed once, not once
    per output table.
    """
    pages.write.mode(mode).partitionBy("ns").parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The stored pages table (see ``write_pages``)."""
    return spark.read.parquet(path).select(*PAGE_COLUMNS)
