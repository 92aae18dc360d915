"""Steps whose memory or time must not grow faster than the input (findings of round 3)."""

from pyspark.sql import functions as F

from encyclo.functions import markup as M
from encyclo.functions import text as X
from encyclo.operators import hierarchy as H
from encyclo.operators import learn as L


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


ODD = ["plain (()) text", "a {{x {{y}} z}} b [[Category:c]] d", "[[File:p|[[q]]]] k [[Image:r]] m", "cut {{ open",
       "[[Fi[http://u]le:p [[q]]]] n", "[[Ima[[Category:c]]ge:r]] o", "[[File:a]][[Category:b", "x [[File:open", "", None]


def test_clean_text_has_two_python_steps(spark):
    """each Python step of a plan is a further worker for every task."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id long, t string")
    assert sum("ArrowEvalPython" in line for line in plan(df.select(M.clean_text("t"))).splitlines()) <= 2


def test_one_step_removes_what_five_do(spark):
    """the joined step equals the five removals one after the other."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id long, t string").repartition(3)
    five = M.remove_nested("t", "{{", "}}")
    for tags in (("[[Category:", "]]"), ("[http://", "]")):
        five = X.remove_between(five, *tags)
    for anchor in ("[[File:", "[[Image:"):
        five = M.remove_nested(five, "[[", "]]", anchor=anchor)
    got = {r.id: (r.one, r.five) for r in df.select("id", M.remove_templates_and_links("t").alias("one"), five.alias("five")).collect()}
    assert all(one == five for one, five in got.values())
    assert got[1][0] == "a  b  d" and got[2][0] == " k  m" and got[3][0] == "cut " and got[4][0] == " n" and got[9][0] is None


def test_long_column_through_by_text(spark):
    """slices of a batch come back whole and in order, nulls kept."""
    df = spark.range(0, 1000, numPartitions=2).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("(()"), "id", F.lit(")"))).alias("t"))
    for r in df.select("id", X.remove_target("t", "()").alias("r")).collect():
        assert r.r == (f"({r.id})" if r.id % 7 else None)


def test_deepen_reads_categories_once_and_is_not_coalesced(spark):
    """F16: one scan, one grouping, over all shuffle partitions; rows that repeat or are null stay right."""
    cats = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 20), (3, None), (None, 10)], "id long, category_id long")
    anc = spark.createDataFrame([(10, 11, 1), (10, 12, 2), (10, 12, 2), (11, 12, 1), (None, 9, 1)],
                                "category_id long, ancestor_id long, depth int")
    out = H.deepen_categories(cats, anc)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([
        (1, 10, 0), (1, 11, 0), (1, 12, 1), (2, 20, 0), (3, None, 0), (None, 10, 0), (None, 11, 1), (None, 12, 2)], key=str)
    assert "REPARTITION_BY_NUM" in plan(out) and "Union" not in plan(out)


def test_word_vectors_need_no_local_table(spark):
    """the vectors of known words equal the model's, without its vocabulary in the plan."""
    tok = spark.createDataFrame([(i, ["a", "b", "c", f"w{i % 5}"]) for i in range(40)], "id long, tokens array<string>")
    w2v = L.train_embeddings(tok, vector_size=4, min_count=3)
    words = spark.createDataFrame([("a",), ("w3",), ("unknown",)], "word string").repartition(2)
    out = L.word_vectors(w2v, words)
    want = {r.word: list(r.vector) for r in w2v.getVectors().collect() if r.word in ("a", "w3")}
    assert {r.word: list(r.vec) for r in out.collect()} == want
    assert "LocalTableScan" not in plan(out)
