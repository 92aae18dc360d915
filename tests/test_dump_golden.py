"""Golden results on the hand-written mini dump (values derived by hand)."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import FIXTURES
from encyclo.functions import markup as M
from encyclo.functions import text as X
from encyclo.operators.pages import build_tables, filter_after, is_disambiguation
from encyclo.sources.dump import read_dump


@pytest.fixture(scope="module")
def tables(spark):
    pages = read_dump(spark, os.path.join(FIXTURES, "mini_dump.xml")).cache()
    return pages, build_tables(pages)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_pages_and_titles(tables):
    pages, t = tables
    assert pages.count() == 13
    assert rows(t["titles"].where(F.col("id") < 50), "id", "title") == [
        (10, "Alpha"), (11, "Beta"), (12, "Gamma_ray"), (13, "Delta"), (30, "Mercury_(disambiguation)")]
    assert pages.where(is_disambiguation()).count() == 1


def test_redirects_one_hop_target_must_exist(tables):
    _, t = tables
    assert rows(t["redirects"], "title", "target_title", "target_id") == [("Old_Beta", "Beta", 11)]


def test_links(tables):
    _, t = tables
    # Alpha: Beta, Gamma_ray, Old_Beta->Beta, (Older_Beta dropped), (Nowhere dropped), Delta
    assert rows(t["links"], "id", "pos", "link_id") == [
        (10, 0, 11), (10, 1, 12), (10, 2, 11), (10, 5, 13),
        (11, 0, 10), (11, 1, 10), (11, 2, 12), (13, 0, 10), (30, 0, 10)]


def test_cutoff_excludes_old_page(tables):
    pages, t = tables
    assert 12 not in {r.id for r in t["text"].collect()}
    assert filter_after(pages, "20010115").where(F.col("id") == 11).count() == 1


def test_categories_and_parents(tables):
    _, t = tables
    assert rows(t["categories"], "id", "pos", "category_id") == [(10, 0, 100), (10, 1, 101), (11, 0, 100)]
    assert rows(t["category_parents"], "child_id", "parent_id") == [(100, 101), (100, 102), (102, 101)]


def test_domains_and_authors(tables):
    _, t = tables
    assert [r.domain for r in t["domains"].orderBy("pos").collect()] == ["www.example.com", "example.com"]
    assert [r.author for r in t["authors"].orderBy("pos").collect()] == [
        "J._Smith", "Ann_Lee", "Carl_Sanders", "A"]


def test_quality_importance(tables):
    _, t = tables
    assert rows(t["quality"], "id", "quality") == [(10, "ga"), (11, "unknown")]
    # Alpha: high(2), top(3) -> 2.5 -> top; Beta: low, mid -> 0.5 -> mid
    assert rows(t["importance"], "id", "importance") == [(10, "top"), (11, "mid")]


def test_text(tables):
    pages, t = tables
    txt = dict(rows(t["text"], "id", "text"))
    cut = dict(rows(build_tables(pages, truncate_at_bullet=True)["text"], "id", "text"))
    assert cut[11] == "Beta links Alpha twice alpha."         # cut at the first '*', when asked for
    assert txt[11] == "Beta links Alpha twice alpha.  * bullet tail Gamma ray"
    assert txt[13] == "Unclosed"                              # unclosed template erases the rest
    assert txt[10].startswith("Alpha is the first letter before Gamma, see Old Beta")
    assert "Infobox" not in txt[10] and "Pic.png" not in txt[10] and "cite" not in txt[10]
    assert "and e." in txt[10]                                # [[Delta|d|e]] -> e


def test_string_functions(spark):
    df = spark.createDataFrame([("  a  b\t",)], ["s"])
    r = df.select(
        X.wtrim("s").alias("trim"),
        X.between(F.lit("x<a>1</a><a>2</a>"), "<a>", "</a>").alias("b1"),
        X.between_all(F.lit("x<a>1</a><a>2</a>"), "<a>", "</a>").alias("ball"),
        X.count_string(F.lit("abab ab"), "ab").alias("cnt"),
        X.remove_between(F.lit("a<!--x-->b<!--y"), "<!--", "-->").alias("rb"),
        X.remove_target(F.lit("a(())b"), "()").alias("rt"),
        X.decode_entities(F.lit("&amp;amp;lt; &lt;b&gt; &quot;q&quot;")).alias("dec"),
        X.tokenize(F.lit("Hello, wörld!")).alias("tok"),
        X.whitespace_tokens(F.lit("   ")).alias("ws"),
        X.norm_key(F.lit("gamma ray")).alias("key"),
        X.query_key(F.lit("New York")).alias("qk"),
        X.algebra_terms(F.lit("king - man + woman queen")).alias("alg"),
    ).first()
    assert r.trim == "a  b"
    assert r.b1 == "1" and r.ball == ["1", "2"] and r.cnt == 3
    assert r.rb == "ab<!--y"
    assert r.rt == "ab"
    assert r.dec == '&lt; <b> "q"'
    assert r.tok == ["hello", "w", "rld", ""]           # ASCII \W: accented letters split words
    assert r.ws == []
    assert r.key == "Gamma_ray" and r.qk == "new_york"
    assert [(s.sign, s.word) for s in r.alg] == [(1, "king"), (-1, "man"), (1, "woman"), (1, "queen")]


def test_nested_removal_python_and_spark(spark):
    s = "a {{x {{y}} z}} b {{open"
    assert M.remove_nested_py(s, "{{", "}}") == "a  b "
    assert M.remove_nested_py("k [[File:p|[[q]]]] m", "[[", "]]", "[[File:") == "k  m"
    deep = "{{" * 301 + "}}" * 301
    assert M.remove_nested_py(deep, "{{", "}}") == ""
    got = spark.createDataFrame([(s,)], ["t"]).select(M.remove_nested("t", "{{", "}}").alias("r")).first().r
    assert got == "a  b "


def test_more_string_functions(spark):
    df = spark.createDataFrame([("One, two (x). Three&nbsp;  four.",)], ["s"])
    r = df.select(
        X.sentence_tokens("s").alias("sent"),
        X.drop_stopwords(F.array(F.lit("the"), F.lit("cat"), F.lit("a")), ["the", "a"]).alias("stop"),
        X.has_junk_token(F.lit("foo_bar")).alias("j1"), X.has_junk_token(F.lit("ndash")).alias("j2"),
        X.has_junk_token(F.lit("plain")).alias("j3"),
        X.sanitize(F.lit("a\tb\nc")).alias("san"),
        X.squeeze(F.lit("a    b  c")).alias("sq"),
        X.remove_between(F.lit("x<b>short</b>y<b>" + "z" * 80 + "</b>"), "<b>", "</b>", max_gap=20).alias("gap"),
        X.whitespace_tokens(F.lit(" a  b\tc ")).alias("ws"),
    ).first()
    assert [list(x) for x in r.sent] == [["one", "two", "x"], ["three", "four."]]
    assert list(r.stop) == ["cat"]
    assert (r.j1, r.j2, r.j3) == (True, True, False)
    assert r.san == "a b c" and r.sq == "a b c"
    assert r.gap == "xy<b>" + "z" * 80 + "</b>"
    assert list(r.ws) == ["a", "b", "c"]
