"""Plans are those that large tables need."""

from lodestrand import catalogue


def plan(spark, sf, name):
    return catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(spark, sf, "block_point_lookup")
    assert "EqualTo(doc_id,42)" in text and "ReadSchema: struct<doc_id:bigint,lang:string,source:string,n_chars:bigint>" in text
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan(spark, sf, "columnar_projection")


def test_top_k_doesnt_sort_the_table(spark, sf):
    for name in ("cosine_topk", "audit_query_recent", "audit_top_users"):
        assert "TakeOrderedAndProject" in plan(spark, sf, name)
    assert "WindowGroupLimit" in plan(spark, sf, "batched_topk")


def test_no_python_where_expressions_do(spark, sf):
    for name in ("pii_mask", "entity_extract", "agent_profile", "tfidf_search", "cosine_topk", "latest_state", "forensic_timeline", "split_by_size_bins", "quantise"):
        text = plan(spark, sf, name)
        assert "Python" not in text and "Pandas" not in text and "CartesianProduct" not in text, name


def test_counts_in_time_windows_run_in_parts(spark, sf):
    for name in ("rapid_changes", "timeline_density", "forensic_timeline"):
        assert "SinglePartition" not in plan(spark, sf, name), name
