"""Sources, sinks and the streaming ingest (round trips through files under tmp_path)."""

import os

from pyspark.sql import functions as F

from conftest import FIXTURES
from encyclo.operators.pages import build_tables
from encyclo.sources import sinks as S
from encyclo.sources import tsv as T
from encyclo.sources.dump import read_dump
from encyclo.sources.taxonomy import parse_taxonomy_lines, read_taxonomy


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_tsv_readers(spark, tmp_path):
    p = _write(tmp_path / "links.tsv", "1\t2 3 4\n2\t5\nbad line\n3\t\t\nx\t7\n")
    kv = T.read_keyed_tsv(spark, p)
    assert sorted((r.id, r.value) for r in kv.collect()) == [(1, "2 3 4"), (2, "5")]
    assert T.count_malformed(spark, p) == 2
    edges = T.read_list_tsv(spark, p, item="link_id")
    assert sorted((r.id, r.pos, r.link_id) for r in edges.collect()) == [(1, 0, 2), (1, 1, 3), (1, 2, 4), (2, 0, 5)]
    assert [r.value for r in T.read_tsv_column(spark, p, 1).collect()][:2] == ["2 3 4", "5"]
    rep = _write(tmp_path / "rep.txt", "String | ID | Article Count\nCategory:A | 100 | 7\n")
    assert [(r.title, r.category_id, r.size) for r in T.read_category_report(spark, rep).collect()] == [
        ("Category:A", 100, 7)]
    sw = _write(tmp_path / "stop.txt", "don't\n\nthe\n")
    assert sorted(r.word for r in T.read_stopwords(spark, sw).collect()) == ["dont", "the"]
    wl = _write(tmp_path / "words.tsv", "0\ta\t10\n1\tb\t3\n")
    assert [r.word for r in T.read_word_list(spark, wl, min_count=3).collect()] == ["a"]
    cl = _write(tmp_path / "states.txt", " New York \nUT\nOhio\n")
    assert sorted(r.name for r in T.read_class_list(spark, cl).collect()) == ["new_york", "ohio"]
    an = _write(tmp_path / "q.txt", ": capital\nAthens Greece Oslo Norway\nbad\n")
    assert [tuple(r) for r in T.read_analogies(spark, an, lower=True).collect()] == [
        ("athens", "greece", "oslo", "norway")]
    vec = _write(tmp_path / "vec.txt", "2 3\nx 1 2 3\ny 4 5 6\n")
    v = T.load_vectors(spark, vec)
    own = spark.createDataFrame([("x", [0.0, 0.0, 0.0]), ("z", [1.0, 1.0, 1.0])], "word string, vec array<float>")
    got = {r.word: list(r.vec) for r in T.intersect_vectors(own, v).collect()}
    assert got == {"x": [1.0, 2.0, 3.0], "z": [1.0, 1.0, 1.0]}


def test_taxonomy_spark_equals_inline(spark, tmp_path):
    text = "/* c */\nUS states\n=\nNew York / Ohio & Utah\n]\nOther\n=\n_misc_\n]\n"
    p = _write(tmp_path / "tax.txt", text)
    inline = sorted(parse_taxonomy_lines(text))
    assert inline == [(0, "US states", "new_york"), (0, "US states", "ohio"), (0, "US states", "us_states"),
                      (0, "US states", "utah"), (1, "Other", "misc"), (1, "Other", "other")]
    assert sorted(tuple(r) for r in read_taxonomy(spark, p).collect()) == inline


def test_sinks_round_trip(spark, tmp_path):
    pages = read_dump(spark, os.path.join(FIXTURES, "mini_dump.xml"))
    t = build_tables(pages)
    S.write_tables({"links": t["links"]}, str(tmp_path / "pq"))
    S.write_tables({"links": S.keyed_lists(t["links"])}, str(tmp_path / "tsv"), fmt="tsv")
    back = T.read_list_tsv(spark, str(tmp_path / "tsv" / "links"), item="link_id")
    assert sorted((r.id, r.link_id) for r in back.collect()) == sorted(
        (r.id, r.link_id) for r in t["links"].collect())
    stats = S.table_stats(spark, str(tmp_path / "pq" / "links")).first()
    assert stats.n_rows == t["links"].count() and stats.n_bytes > 0
    arts = S.articles_projection(t["titles"], pages, categories=t["categories"], domains=t["domains"],
                                 authors=t["authors"], quality=t["quality"], importance=t["importance"])
    a = {r.id: r for r in arts.collect()}
    assert set(a) == {10, 11, 12, 13, 30}
    assert a[10].categories == "Category:Greek_letters | Category:Symbols"
    assert a[10].cited_domains == "www.example.com | example.com"
    assert a[13].categories == "NONE" and a[13].quality == "N/A" and a[10].quality == "ga"
    upd = S.update_columns(arts, spark.createDataFrame([(10, "Good")], "id long, source_quality string"))
    assert {r.id: r.source_quality for r in upd.collect()}[10] == "Good"
    again = S.insert_ignore(arts, arts)
    assert again.count() == arts.count()
    assert S.delete_rows(arts, title="Alpha").count() == arts.count() - 1
    rep = [r.value for r in S.category_report(spark.createDataFrame(
        [("Category:A", 1, 5), ("Category:B", 2, 9)], "title string, category_id long, size long")).collect()]
    assert rep == ["String | ID | Article Count", "Category:B | 2 | 9", "Category:A | 1 | 5"]
    assert S.latest_version(["m/model_2020-01-01_10-00-00", "m/model_2021-05-01_09-00-00"]).endswith("2021-05-01_09-00-00")


def test_read_compressed_dump(spark, tmp_path):
    import bz2
    src = os.path.join(FIXTURES, "mini_dump.xml")
    dst = tmp_path / "dump.xml.bz2"
    with open(src, "rb") as f, bz2.open(dst, "wb") as g:
        g.write(f.read())
    plain = read_dump(spark, src)
    packed = read_dump(spark, str(dst))
    cols = ["id", "ns", "title", "redirect", "raw_text"]
    assert sorted(tuple(r) for r in packed.select(*cols).collect()) == \
        sorted(tuple(r) for r in plain.select(*cols).collect())


def test_staged_pages_prune_and_match(spark, tmp_path):
    from encyclo.sources.dump import read_pages, write_pages
    pages = read_dump(spark, os.path.join(FIXTURES, "mini_dump.xml"))
    write_pages(pages, str(tmp_path / "pages"))
    staged = read_pages(spark, str(tmp_path / "pages"))
    a, b = build_tables(pages), build_tables(staged)
    for name in ("titles", "links", "categories", "quality", "importance", "text"):
        assert sorted(map(tuple, a[name].collect())) == sorted(map(tuple, b[name].collect())), name
    plan = b["links"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "ns" in plan
