"""Registered queries against their SQL, at the smallest scale."""

import os

import duckdb
import pytest

from sparkwell import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query of each shape that is quick; the whole catalogue is compared by the driver.
QUICK = [
    "fn_normalize", "fn_fold_accents", "fn_slug", "fn_trigrams", "fn_trgm_similarity", "fn_canonical_hash", "fn_uuid5", "fn_valid_date", "fn_embed_fixture",
    "ck_hard_split", "ck_paragraph_pack", "ck_inherit", "pr_rule_dimensions", "pr_lifecycle", "pr_effective_window", "tk_vector", "tk_fulltext", "jn_similarity",
    "wn_selection_group", "wn_pack", "wn_keyset_page", "ag_percentiles", "st_except", "gr_closure", "gr_cycles", "as_render", "as_budgets", "bd_plan", "bd_embed_work",
    "dq_summary", "br_list", "br_children", "sm_metrics", "sm_ingest", "src_entities",
    "pr_rules", "pr_operators", "pr_simulate", "pr_context_validate", "st_hits_union", "qp_retrieve", "qp_profile", "qp_degrade", "gr_dep_closure", "gr_cycles", "gr_expand", "dq_self_and_cycles",
    "gr_neighbourhood", "as_fragments", "dq_rules", "src_documents", "as_provenance", "as_removed_skills", "as_usage", "pr_hard_filters", "br_backlinks", "br_list_items", "ag_metric_counts", "sink_apply_plan", "bd_vector_store",
    "dq_ref_suggestions", "dq_domain_values", "fn_edit_distance_suggest", "br_get", "br_list_kinds", "br_list_all", "as_discover", "as_groups", "as_skill_select", "ev_assembly",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    def one(v):
        if v is None or v != v:
            return "-"
        return f"{v:.7g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    got = catalog.queries()[name](spark, DATA)
    want = con.execute(catalog.sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(tuple(r) for r in got.select(names).collect()) == plain(want.fetchall())


def test_every_sql_has_a_query():
    assert set(catalog.sql()) <= set(catalog.queries())
