"""Every query runs on the smallest tables, and equals its SQL in DuckDB."""

import math

import duckdb
import pytest

from surveyloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "macro_nll_frequency", "curated_rows", "stratified_split", "protocol_b_units", "group_js", "main_table_pivot", "item_conditional_tables",
    "pair_divergence", "cell_donor", "mutual_information", "knn_neighbours", "prompt_render", "json_props", "logsoftmax_from_coefficients",
    "flatten_json", "saved_folds", "completed_labels", "materialised_prompts", "cluster_split", "matched_donor_shuffle", "trait_scores", "one_sample_bootstrap",
]


def flat(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0:.7g}"
    return str(v)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in found.description]
    want = sorted(tuple(flat(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(names) == columns
    assert sorted(tuple(flat(r[c]) for c in columns) for r in df.collect()) == want


def test_registry_is_complete():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 150 and len(catalogue.ORACLES) > 140


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
