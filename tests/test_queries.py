import glob
import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from workload.oracle import ORACLE as LOG_ORACLE
from workload.queries import QUERIES as LOG_QUERIES

SCALE = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in glob.glob(f"{SCALE}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


pytestmark = pytest.mark.skipif(not glob.glob(f"{SCALE}/*.parquet"), reason="needs the given tables")


# queries of the optional folder that SQL cannot express are tested there
@pytest.mark.parametrize("name", [name for name in QUERIES if name in ORACLE])
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SCALE)
    columns = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    relation = duck.sql(ORACLE[name])
    assert sorted(relation.columns) == columns
    want = Counter(relation.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(LOG_QUERIES) == set(LOG_ORACLE)
    assert set(ORACLE) <= set(QUERIES)


def test_nested_all_of_gives_every_pair(spark, tmp_path):
    """One row per match and nested match of a line, also where two parents end before the same child."""
    texts = {7: "the er, é the her her\nno child: the\nno parent: er", 8: "er there the\n\nthe er", 9: "", 10: None}
    table = spark.createDataFrame([(d, "s", t) for d, t in texts.items()], "doc_id bigint, source string, text string")
    table.write.parquet(str(tmp_path / "documents.parquet"))

    def places(line, word):
        raw = line.encode()
        return [n for n in range(len(raw)) if raw.startswith(word, n)]

    want = Counter(
        (d, n, parent + 3, child)
        for d, text in texts.items()
        for n, line in enumerate((text or "").split("\n"))
        for parent in places(line, b"the")
        for child in places(line, b"er")
    )
    columns = ["doc_id", "lineno", "parent_end", "match_pos"]
    got = Counter(tuple(r) for r in QUERIES["nested_all_of"](spark, str(tmp_path)).select(*columns).collect())
    assert got == want and sum(got.values()) == 6 + 4 + 1
    duck = pytest.importorskip("duckdb").connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert Counter(duck.sql(ORACLE["nested_all_of"]).project(", ".join(columns)).fetchall()) == want
