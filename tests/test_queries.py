"""Registered queries against their SQL, and that the library stands without its optional parts."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from loomline.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in ("events", "documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def clean(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(set(Q.ORACLE_SQL) - {"equal_budget_invariant"}))
def test_query_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(clean(r[c]) for c in columns) for r in df.collect()), key=repr)
    duck.execute(Q.ORACLE_SQL[name])
    names = [c[0] for c in duck.description]
    assert sorted(names) == columns
    want = sorted((tuple(clean(r[names.index(c)]) for c in columns) for r in duck.fetchall()), key=repr)
    assert got == want


def test_rest_stands_alone():
    code = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("loomline.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert "event_detection" in e.queries() and not any(k.startswith("op") for k in e.queries())
assert "event_detection" in e.oracle_sql()
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == "no_such_library":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path[0] = Missing()
sys.modules.pop("loomline.llm", None)
import os, tempfile
folder = tempfile.mkdtemp()
open(os.path.join(folder, "corpus_pipeline.py"), "w").write("import no_such_library")
sys.path.insert(0, folder)
sys.modules.pop("corpus_pipeline", None)
try:
    e._optional("corpus_pipeline")
    raise SystemExit("a missing library was passed over")
except ModuleNotFoundError:
    pass
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)


def test_pool_shuffles_no_texts(spark, duck, tmp_path):
    texts = [None, None, "", "", "a", "a ", "A", "a", "é", "é", "é", "line\n" * 400, "line\n" * 400, "line\n" * 399]
    docs = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i != 4), i % 2) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for made in (Q._sources(spark, tmp_path), Q.QUERIES["success_dedup_global"](spark, tmp_path)):
        for line in made._jdf.queryExecution().executedPlan().toString().split("\n"):
            assert not ("SortMergeJoin" in line or "Aggregate" in line or "Exchange" in line) or "text#" not in line, line
    got = {tuple(r) for r in Q.QUERIES["success_dedup_global"](spark, tmp_path).collect()}
    sql = Q.ORACLE_SQL["success_dedup_global"].replace("FROM documents d JOIN labels l", f"FROM '{tmp_path}/documents.parquet/*.parquet' d JOIN '{tmp_path}/labels.parquet/*.parquet' l")
    assert got == set(duck.execute(sql).fetchall()) and len(got) == 9
