"""Readers for the keyed text tables (TSV and friends).

All readers use the ``text`` source with an explicit split, so malformed
lines (wrong field count) are filtered -- and can be counted -- instead of
failing a 100 TB scan.  Files are split by Spark; compressed inputs are read
through the Hadoop codecs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.text(path).select(F.split("value", sep, -1).alias("f"))


def read_keyed_tsv(spark: SparkSession, path: str, key: str = "id", value: str = "value",
                   key_type: str = "bigint") -> DataFrame:
    """Two-field lines ``key \\t value``; other lines are dropped."""
    f = _fields(spark, path)
    return (f.where(F.size("f") == 2)
            .select(F.col("f")[0].try_cast(key_type).alias(key), F.col("f")[1].alias(value))
            .where(F.col(key).isNotNull()))


def count_malformed(spark: SparkSession, path: str, n_fields: int = 2) -> int:
    return _fields(spark, path).where(F.size("f") != n_fields).count()


def read_tsv_column(spark: SparkSession, path: str, col_idx: int = 0, name: str = "value") -> DataFrame:
    """Column ``col_idx`` of lines that have it."""
    f = _fields(spark, path)
    return f.where(F.size("f") > col_idx).select(F.col("f")[col_idx].alias(name))


def read_list_tsv(spark: SparkSession, path: str, key: str = "id", item: str = "item_id",
                  item_type: str = "bigint") -> DataFrame:
    """``key \\t item item item`` -> edge table (key, pos, item)."""
    kv = read_keyed_tsv(spark, path, key, "_v")
    return (kv.select(key, F.posexplode(F.split(F.trim("_v"), " ", -1)).alias("pos", "_i"))
            .where(F.col("_i") != "")
            .select(key, "pos", F.col("_i").try_cast(item_type).alias(item)))


def read_category_report(spark: SparkSession, path: str) -> DataFrame:
    """`` title | category_id | size`` report lines (3 fields; the header is dropped)."""
    f = _fields(spark, path, r" \| ")
    return (f.where(F.size("f") == 3)
            .select(F.trim(F.col("f")[0]).alias("title"), F.trim(F.col("f")[1]).try_cast("bigint").alias("category_id"),
                    F.trim(F.col("f")[2]).try_cast("bigint").alias("size"))
            .where(F.col("category_id").isNotNull()))


def read_corpus(spark: SparkSession, path: str, n_examples: int | None = None) -> DataFrame:
    """Tagged corpus ``id \\t text`` (malformed lines dropped); ``n_examples`` caps
    the number of documents when given (the reader's own option)."""
    df = read_keyed_tsv(spark, path, "id", "text", key_type="string")
    return df.limit(n_examples) if n_examples else df


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """One word per line; apostrophes removed, blank lines dropped."""
    w = F.trim(F.replace(F.col("value"), F.lit("'"), F.lit("")))
    return spark.read.text(path).select(w.alias("word")).where(F.col("word") != "").distinct()


def read_word_list(spark: SparkSession, path: str, min_count: int | None = None) -> DataFrame:
    """``word_id \\t word \\t count`` lines; ``count > min_count`` when given."""
    f = _fields(spark, path)
    df = (f.where(F.size("f") == 3)
          .select(F.col("f")[0].try_cast("bigint").alias("word_id"), F.col("f")[1].alias("word"),
                  F.col("f")[2].try_cast("bigint").alias("count")))
    return df.where(F.col("count") > min_count) if min_count is not None else df


def read_class_list(spark: SparkSession, path: str) -> DataFrame:
    """Class names, one per line: trimmed, lower-cased, spaces -> '_', length > 2."""
    n = F.replace(F.lower(F.trim("value")), F.lit(" "), F.lit("_"))
    return spark.read.text(path).select(n.alias("name")).where(F.length("name") > 2)


def read_analogies(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """Analogy questions ``a b c d``; lines starting with ':' name sections."""
    raw = spark.read.text(path).where(~F.col("value").startswith(":"))
    f = raw.select(F.split(F.trim("value"), r"\s+", -1).alias("f")).where(F.size("f") == 4)
    cols = [F.col("f")[i] for i in range(4)]
    if lower:
        cols = [F.lower(c) for c in cols]
    return f.select(*[c.alias(n) for c, n in zip(cols, "abcd")])


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Word vectors in text form ``word v1 v2 ...`` (a first ``count dim`` header line is skipped)."""
    f = spark.read.text(path).select(F.split(F.trim("value"), " ", -1).alias("f")).where(F.size("f") > 2)
    return f.select(F.col("f")[0].alias("word"),
                    F.transform(F.slice("f", 2, 1 << 30), lambda x: x.cast("float")).alias("vec"))


def intersect_vectors(own: DataFrame, pretrained: DataFrame) -> DataFrame:
    """Own vocabulary, with the pre-trained vector where the word has one."""
    p = pretrained.select("word", F.col("vec").alias("_pre"))
    return own.join(p, "word", "left").select("word", F.coalesce("_pre", "vec").alias("vec"))
