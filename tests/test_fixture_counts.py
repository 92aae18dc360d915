"""Row counts of the role views and flagship queries at sf0.01, as stated in FIXTURES.md."""

import __spark_entry__ as E
from conftest import SF01
from encyclo.sources.fixtures import Tables


def test_role_view_counts(spark):
    t = Tables(spark, SF01)
    assert t.w_titles.count() == 2130
    assert t.w_redirects.count() == 200
    assert t.w_raw_links.count() == 60000
    assert t.w_quality.count() == 2000
    assert t.w_categories.count() == 51731
    assert t.w_category_parents.count() == 125
    assert t.w_text.count() == 1000


def test_stated_query_counts(spark):
    q = E.queries()
    assert q["a5_source_quality"](spark, SF01).count() == 14560
    assert q["j4_resolve_links"](spark, SF01).count() == 53905
    assert q["a1_category_sizes"](spark, SF01).count() == 100
    assert q["g1_ancestors"](spark, SF01).count() == 225
    assert q["f16_corpus_stats"](spark, SF01).count() == 1000
