import os

import pytest
from sql_compare import assert_same, have_data

from viewloom.plans.registry import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not have_data(), reason="no test tables")



# some of each section, and all of them with TEST_ALL=1 (the driver compares all)
SOME = """main_table column_pruned_read malformed_lines_dropped latin1_table clean_text split_tags matched_slugs tags_per_dataset refilled_selection tag_vocabulary doc_tag_tfidf doc_tag_ppmi doc_word_bm25_a tag_ppmi_topk
text_binary_cosine embedding_knn sym_max_rownorm sym_sum_topk graph_statistics fusion_adaptive_cons fusion_rrf fusion_selective fusion_blend fusion_weighted_views view_consistency evaluation ndcg_candidate_union ndcg_global_ideal
weight_sweep four_view_grid dilution_sizes k_sweep quality_thresholds walk_step tag_total_related alias_mass creator_neighbours creator_pairs_of_queries cooccurrence_matrix tag_statistics engagement_by_tags profile_columns top_values
content_quality dataset_vectors tag_cooccurrence cumulative_coverage engagement_windows edge_round_trip resumed_stage p4_found p4_report p4_valid_versions p4_valid_datasets p5_found p5_report""".split()


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("TEST_ALL") else SOME)
def test_query_equals_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", ["cell_knn_recall", "walk_graph_fusion", "content_ablation", "column_descriptions"])
def test_query_without_sql_runs(spark, name):
    from sql_compare import FOLDER

    assert QUERIES[name](spark, FOLDER).count() > 0


def test_cells_find_the_neighbours(spark):
    from sql_compare import FOLDER

    assert QUERIES["cell_knn_recall"](spark, FOLDER).first().recall >= 0.9


def test_walk_graph_finds_documents_of_like_tags(spark):
    from sql_compare import FOLDER

    got = {r.method: r.tag_jaccard for r in QUERIES["walk_graph_quality"](spark, FOLDER).collect()}
    assert got["walk"] > 1.15 * got["random"]
