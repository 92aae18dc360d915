"""Role views that give the driver's TPC-H-like tables the roles of wiki tables.

Every view is plain SQL that runs unchanged in Spark and DuckDB.  Table names
are written as ``{name}`` placeholders: Spark binds them to DataFrames through
``spark.sql(text, **frames)``; for DuckDB the braces are dropped and the
pre-registered views of the same names are used.  The views cover whole
tables; modulo expressions only decide which role a row plays.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# The role views (ids offsets, title prefixes, quality and
# importance codes) that define the wiki roles of the driver tables.
VIEWS: dict[str, str] = {
    "w_titles": """
        select cast(p_partkey as bigint) id, concat('Part_', cast(p_partkey as string)) title from {part}
        union all select 1000000000 + s_suppkey, concat('Category:Supplier_', cast(s_suppkey as string)) from {supplier}
        union all select 1100000000 + n_nationkey, concat('Category:', n_name) from {nation}
        union all select 1200000000 + r_regionkey, concat('Category:', r_name) from {region}""",
    "w_redirects": """
        select concat('Alias_', cast(p_partkey as string)) title,
               concat('Part_', cast(p_partkey as string)) target_title from {part} where p_partkey % 10 = 0""",
    "w_raw_links": """
        select l_orderkey id, l_linenumber pos,
               case when l_partkey % 10 = 0 then concat('Alias_', cast(l_partkey as string))
                    when l_partkey % 10 = 1 then concat('Missing_', cast(l_partkey as string))
                    else concat('Part_', cast(l_partkey as string)) end link
        from {lineitem}""",
    "w_links": """
        select l_orderkey id, l_partkey link_id, l_linenumber pos from {lineitem}""",
    "w_quality": """
        select cast(p_partkey as bigint) id,
               case p_partkey % 8 when 0 then 'fa' when 1 then 'a' when 2 then 'ga' when 3 then 'b'
                    when 4 then 'c' when 5 then 'start' when 6 then 'stub' else 'unknown' end quality from {part}""",
    "w_importance": """
        select cast(p_partkey as bigint) id,
               case p_size % 5 when 0 then 'low' when 1 then 'mid' when 2 then 'high' when 3 then 'top'
                    else 'unknown' end importance from {part}""",
    "w_categories": """
        select distinct l_partkey id, 1000000000 + l_suppkey category_id from {lineitem}""",
    "w_category_parents": """
        select 1000000000 + s_suppkey child_id, 1100000000 + cast(s_nationkey as bigint) parent_id from {supplier}
        union all select 1100000000 + cast(n_nationkey as bigint), 1200000000 + cast(n_regionkey as bigint) from {nation}""",
    "w_text": """
        select doc_id id, text from {documents}""",
    # talk pages: one per part article, title 'Talk:' + article title
    "w_talk_titles": """
        select 1300000000 + p_partkey id, concat('Talk:Part_', cast(p_partkey as string)) title from {part}""",
}

_PLACEHOLDER = re.compile(r"\{(" + "|".join(TABLES) + r")\}")


def view_sql(name: str) -> str:
    return VIEWS[name]


def duckdb_sql(text: str) -> str:
    """Drop the ``{table}`` placeholders for DuckDB."""
    return _PLACEHOLDER.sub(lambda m: m.group(1), text)


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """DuckDB oracle text: ``WITH <views...> <body>``.

    ``extra`` adds further CTEs (name -> SQL) after the role views.
    """
    parts = [f"{n} AS ({duckdb_sql(VIEWS[n])})" for n in names]
    for n, sql in (extra or {}).items():
        parts.append(f"{n} AS ({sql})")
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


class Tables:
    """Lazily loaded driver tables plus the role views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name in VIEWS:
            return self.view(name)
        raise AttributeError(name)

    def view(self, name: str) -> DataFrame:
        key = "view:" + name
        if key not in self._cache:
            text = VIEWS[name]
            deps = {m for m in _PLACEHOLDER.findall(text)}
            self._cache[key] = self.spark.sql(text, **{d: self.table(d) for d in deps})
        return self._cache[key]
