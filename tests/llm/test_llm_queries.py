import pytest

from conftest import DATA, same_as_sql
from tallyline.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    same_as_sql(spark, duck, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    n = QUERIES[name](spark, DATA).count()
    assert n > 0 or name == "p4_limits"  # a table this small need not show a limit


COLUMNS = {
    "p1_found": ["stratum string", "run_id string"], "p3_found": ["set_id string", "run_id string"], "p4_found": ["call_id bigint"], "p5_found": ["call_id bigint", "defect string"],
    "p6_found": ["run_id string", "item_id string", "dim_name string", "grade int"], "p8_found": ["doc_id bigint", "item_id string"], "p9_found": ["doc_id bigint", "level int"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_columns_and_distinct_rows(spark, name):
    df = QUERIES[name](spark, DATA)
    assert [" ".join(x) for x in df.dtypes] == COLUMNS[name]
    assert df.count() == df.distinct().count()
