"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations events part customer supplier nation region orders lineitem".split()


def registered():
    from lexloom.plans import registry

    return sorted(registry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame, columns):
    rows = frame[columns].astype(object)
    return sorted(map(repr, rows.where(rows.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", registered())
def test_query_equals_its_sql(spark, duck, name):
    from lexloom.plans import registry

    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = duck.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got, columns) == plain(want, columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["segment_greedy", "segment_nbest"])
def test_words_of_all_lengths_are_segmented(spark, name):
    from lexloom.plans import registry

    sizes = {len(r["w"]) for r in registry.queries()[name](spark, SF).select("w").distinct().collect()}
    assert min(sizes) < 6 and max(sizes) > 10


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)
