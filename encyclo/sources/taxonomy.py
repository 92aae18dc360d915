"""Class taxonomy files: blocks ``name`` / ``=`` / tag lines / ``]``.

``/* ... */`` comments are skipped.  Tags are split on ``/`` and ``&``,
lower-cased, spaces -> ``_``, and stripped of ``_``; the class name itself is
a tag of its class.  Output: (class_idx, class_name, tag), class_idx in file
order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK = r"(?s)([^\n\]=]+?)\s*\n\s*=\s*\n(.*?)\n\s*\]"


def _norm(tag: str) -> str:
    return tag.strip().lower().replace(" ", "_").strip("_")


def parse_taxonomy_lines(text: str) -> list[tuple[int, str, str]]:
    """Parse a small taxonomy given inline (configuration, not data)."""
    text = re.sub(r"(?s)/\*.*?\*/", "", text)
    out = []
    for idx, (name, body) in enumerate(re.findall(_BLOCK, text)):
        name = name.strip()
        tags = [_norm(name)]
        for line in body.split("\n"):
            tags += [_norm(t) for t in re.split(r"[/&]", line)]
        seen = set()
        for t in tags:
            if t and t not in seen:
                seen.add(t)
                out.append((idx, name, t))
    return out


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """The same parse on Spark: whole-file text source, regex blocks, explode."""
    raw = spark.read.text(path, wholetext=True)
    txt = F.regexp_replace("value", r"(?s)/\*.*?\*/", "")
    blocks = raw.select(F.posexplode(F.regexp_extract_all(txt, F.lit(_BLOCK), 0)).alias("class_idx", "b"))
    parsed = blocks.select("class_idx",
                           F.trim(F.regexp_extract("b", _BLOCK, 1)).alias("class_name"),
                           F.regexp_extract("b", _BLOCK, 2).alias("body"))
    tags = parsed.select("class_idx", "class_name", F.explode(F.concat(
        F.array("class_name"), F.split("body", r"[/&\n]"))).alias("t"))
    norm = F.regexp_replace(F.replace(F.lower(F.trim("t")), F.lit(" "), F.lit("_")), "^_+|_+$", "")
    return (tags.select("class_idx", "class_name", norm.alias("tag")).where(F.col("tag") != "")
            .dropDuplicates(["class_idx", "tag"]))
