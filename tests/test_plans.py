"""Plan guards for every query with a SQL oracle: no cartesian products, no
nested-loop joins, and single-partition exchanges only where the input is
bounded (a top-k ranking or per-partition / per-class counts)."""

import __spark_entry__ as E
from conftest import SF001

# queries whose plans legitimately hold an Exchange SinglePartition, and why
BOUNDED_SINGLE_PARTITION = {
    "a12_dictionary": "ranking of the <= keep_n dictionary words",
    "t7_vocab_band": "same ranking",
    "m1_sequence_dataset": "same ranking",
    "j17_validate_words": "same ranking",
    "a13_word_ids": "per-partition counts of dense_index",
    "t4_class_batches": "per-partition counts of dense_index",
    "a14_collocations": "vocabulary size scalar subqueries (one row each)",
    "a11_class_weights": "largest class count (one row)",
    "v10_category_distribution": "class vectors packed by a scalar subquery after a size check",
    "a15_confusion_matrix": "class vectors scalar subquery",
    "a16_accuracy": "class vectors scalar subquery; fold aggregate over one row per fold",
    "a18_argmax_label": "class vectors scalar subquery",
    "a10_list_stats": "global aggregates (one row)",
    "v13_analogy_accuracy": "global aggregate (one row)",
    "t2_sorted_export": "order of the manifest, one row a part file",
    "t8_category_pages": "dense_index of at most rows_per_bucket rows, counted first",
}


def test_no_cartesian_or_unbounded_single_partition(spark):
    qs, orc = E.queries(), E.oracle_sql()
    for name in sorted(orc):
        plan = qs[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
        if "SinglePartition" in plan:
            assert name in BOUNDED_SINGLE_PARTITION, name
