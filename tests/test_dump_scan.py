"""Dump scan by byte ranges: one file over many tasks, broken pages kept with their reason."""

import bz2
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import FIXTURES
from encyclo.sources.dump import broken_pages, read_dump, scan_dump, stage_dump


def page(i, text, title=None, ns="0", ident=None):
    return (f"  <page>\n    <title>{title or f'Page {i}'}</title>\n    <ns>{ns}</ns>\n    <id>{ident or i}</id>\n    <revision>\n"
            f"      <id>{i + 7}</id>\n      <timestamp>2005-03-01T10:00:00Z</timestamp>\n"
            f"      <text bytes=\"1\" xml:space=\"preserve\">{text}</text>\n    </revision>\n  </page>\n")


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_one_file_over_many_tasks(spark, tmp_path, small_ranges):
    """Every page once, whatever range border it lies over: short pages, one of many ranges, letters of two to four bytes."""
    rnd = random.Random(3)
    words = "one two [[Link|x]] äö 漢字 😀 {{cite}} page /page".split(" ")
    texts = {i: " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 5, 300]))) for i in range(1, 1500)}
    texts[700] = " ".join(rnd.choice(words) for _ in range(60_000))
    whole = "<mediawiki>\n  <siteinfo>x</siteinfo>\n" + "".join(page(i, t) for i, t in texts.items()) + "</mediawiki>\n"
    plain, packed = tmp_path / "dump.xml", tmp_path / "dump.xml.bz2"
    plain.write_text(whole)
    packed.write_bytes(bz2.compress(whole.encode(), 1))
    for path in (plain, packed):
        pages = read_dump(spark, str(path))
        assert pages.select(F.spark_partition_id().alias("p")).distinct().count() > 1, path
        rows = pages.collect()
        assert len(rows) == len(texts) and {r.id: r.raw_text for r in rows} == texts
        assert broken_pages(spark, str(path)).count() == 0
    assert Counter(r.title for r in rows)["Page_700"] == 1


def test_broken_pages_are_counted(spark, tmp_path):
    path = tmp_path / "dump.xml"
    path.write_text("<mediawiki>\n" + page(1, "fine &amp; whole") + page(2, "a <b> never closed") + page(3, "x & y")
                    + page(4, "not a number", ident="four") + "  <page>\n    <title>Lost</title>\n" + page(5, "after an unclosed one")
                    + page(6, "no ns", ns="") + page(7, "no title", title=" ") + page(8, "blank") + "  <page>\n <title>Cut off")
    assert [r.id for r in read_dump(spark, str(path)).orderBy("id").collect()] == [1, 5, 8]
    pages, broken = stage_dump(spark, str(path), str(tmp_path / "staged"))
    assert sorted(r.id for r in pages.collect()) == [1, 5, 8]
    assert Counter(r.problem for r in broken.collect()) == {"malformed": 4, "unclosed": 1, "no namespace": 1, "no title": 1}
    (lost,) = broken.where("problem = 'unclosed'").collect()
    assert lost.source.startswith("<page>") and "Lost" in lost.source and lost.file.endswith("dump.xml")
    assert scan_dump(spark, str(path)).count() == pages.count() + broken.count()


def test_dump_without_pages(spark, tmp_path):
    for name, text in (("empty.xml", ""), ("head.xml", "<mediawiki>\n</mediawiki>\n")):
        (tmp_path / name).write_text(text)
        assert scan_dump(spark, str(tmp_path / name)).count() == 0
    assert read_dump(spark, str(tmp_path / "*.xml")).count() == 0


def test_pages_are_parsed_once(spark):
    """The parser's call is no part of each field."""
    plan = scan_dump(spark, os.path.join(FIXTURES, "mini_dump.xml"))._jdf.queryExecution().executedPlan().toString()
    assert plan.lower().count("from_xml(") == 1 and "ArrowEval" not in plan and "BatchEval" not in plan
