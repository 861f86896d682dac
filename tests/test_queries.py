"""Every query of the core with SQL beside it, over the smallest tables."""

import pytest

import __spark_entry__ as entry
from millrace.session import load
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
CORE = {k: v for m in map(entry.import_module, entry._MODULES) for k, v in m.QUERIES.items()}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in CORE if n in SQL])
def test_query(spark, con, name):
    assert not compare(spark, con, name, CORE[name], SQL[name], SF)


def test_snippets(spark):
    got = [r["snippet"] for r in CORE["fts_snippet"](spark, SF).collect()]
    assert got and all("screen" in x.lower() and len(x.replace("...", "").split()) <= 12 for x in got)


def test_recall(spark):
    assert CORE["vec_ivf_recall"](spark, SF).first()["recall"] >= 0.9


def test_unified(spark):
    """No field goes by a name that was changed later, and no payload is lost."""
    changed = {(r["table_name"], r["old_field"]) for r in CORE["p3_found"](spark, SF).where("change_kind = 'renamed'").collect()}
    got = {(r["table_name"], r["field"]): r["payloads"] for r in CORE["p3_unified"](spark, SF).collect()}
    assert changed and not changed & set(got)
    landed = dict(map(tuple, load(spark, SF, "cdc_events").where("after_json is not null").groupBy("table_name").count().collect()))
    assert all(max(n for (t, _), n in got.items() if t == x) <= landed[x] for x in landed)


def test_likely_renames(spark):
    """Told from values and names alone, most renames are those that deliveries prove."""
    proven = {tuple(r) for r in CORE["p3_found"](spark, SF).where("change_kind = 'renamed'").select("table_name", "snapshot_id", "old_field", "new_field").collect()}
    got = {tuple(r) for r in CORE["p3_likely_renames"](spark, SF).select("table_name", "snapshot_id", "old_field", "new_field").collect()}
    assert 2 * len(got & proven) >= len(got)


def test_few_have_no_sql():
    assert set(CORE) - set(SQL) == {"fts_snippet", "vec_ivf_recall", "p3_unified", "p3_likely_renames"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(SQL) <= set(entry.queries())
