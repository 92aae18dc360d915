"""Hot keys: one link target / one category holding a third of all rows."""

import pandas as pd
from pyspark.sql import functions as F

from encyclo.operators import categories as C
from encyclo.operators import quality as Q
from encyclo.operators import resolve as R


def test_hot_link_target(spark):
    n = 30000
    raw = pd.DataFrame({"id": [i % 3000 for i in range(n)], "pos": list(range(n)),
                        "link": ["Hub" if i % 3 == 0 else f"P{i % 500}" for i in range(n)]})
    titles = pd.DataFrame({"id": list(range(10000, 10500)) + [99], "title": [f"P{i}" for i in range(500)] + ["Hub"]})
    redirects = pd.DataFrame({"title": ["P7"], "target_title": ["Hub"]})
    quality = pd.DataFrame({"id": [99] + list(range(10000, 10500)),
                            "quality": ["FA"] + ["stub" if i % 2 else "b" for i in range(500)]})
    got = R.resolve_links(spark.createDataFrame(raw), spark.createDataFrame(titles),
                          spark.createDataFrame(redirects)).toPandas()
    # expected by pandas: redirect first, then title -> id
    tmap = dict(zip(titles.title, titles.id))
    exp = raw.assign(link_id=raw.link.map(lambda x: tmap.get("Hub" if x == "P7" else x)))
    assert len(got) == len(exp) == n
    assert sorted(map(tuple, got[["id", "pos", "link_id"]].values.tolist())) == \
        sorted(map(tuple, exp[["id", "pos", "link_id"]].astype("int64").values.tolist()))
    sq = Q.source_quality(spark.createDataFrame(got), spark.createDataFrame(quality)).toPandas()
    rank = {"fa": 6, "b": 3, "stub": 0}
    qm = {r.id: rank[r.quality.lower()] for r in quality.itertuples()}
    m = got.assign(r=got.link_id.map(qm)).groupby("id").r.mean()
    labels = {6: "Featured", 5: "A-Class", 4: "Good", 3: "B", 2: "C", 1: "Start", 0: "Stub"}
    exp_sq = {i: labels[int(v + 0.5)] for i, v in m.items()}
    assert dict(zip(sq.id, sq.source_quality)) == exp_sq


def test_hot_category(spark):
    rows = [(i, 1 if i % 3 == 0 else 2 + i % 50) for i in range(30000)]
    cats = spark.createDataFrame(rows, "id long, category_id long")
    titles = spark.createDataFrame([(c, f"Category:C{c}") for c in range(1, 60)] +
                                   [(i, f"A{i}") for i in range(30000)], "id long, title string")
    sizes = {r.category_id: r.size for r in C.category_sizes(cats).collect()}
    assert sizes[1] == 10000 and sum(sizes.values()) == 30000
    out = C.compile_categories(cats, titles, n=5)
    largest = out["largest"].collect()
    assert largest[0].category_id == 1 and largest[0].size == 10000
    eff = {r.category_id: r.effective_size for r in out["effective"].collect()}
    assert sum(eff.values()) == out["assigned"].count()
    # the articles of the hot category have no other category, so all of them stay there
    assert eff[1] == 10000
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    assert out["assigned"].where(F.col("category_id").isNull()).count() == 0
