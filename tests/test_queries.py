"""Registered queries against their SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from tests.conftest import SF
from treeline.plans import catalogue

#: One or two of each kind; all of them take minutes. TREELINE_ALL_QUERIES=1 runs all.
SOME = "flagship ax2_wildcard ax5_ancestor ax7_following_sibling ax8_preceding nt5_open_content jn1_bag jn3_columns xsd15_parent_of_shared agg2_sum agg3_count_in_predicate set1_union flt6_last fn14_substring_from fn23_number arith2_mod key1_node_keys snk2_tab_separated val1_invalid_values val3_invalid_documents xsd13_orphans pub1_round_trip pub5_json_columns fts6_next_words fts7_trigrams spl1_split syn1_synchronize syn4_classify str1_stream_of_documents pub1_recursive pub1_schema_order_and_zones ax3_below_at_any_depth xsd16_inline_condition val3_order_of_children syn5_index_update srt1_document_order ax7_following_in_predicate snk1_created_tables src8_xmlpipe2".split()
NAMES = list(catalogue.oracle_sql()) if os.environ.get("TREELINE_ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "[" + ",".join(map(norm, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    result = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted("|".join(norm(r[c]) for c in columns) for r in df.collect())
    assert got == sorted("|".join(map(norm, r)) for r in result.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["name"]
