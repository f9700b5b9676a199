"""Every query against its DuckDB counterpart."""

import math

import duckdb
import pytest

from quillsift.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_duckdb(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    result = duck.execute(catalog.ORACLE[name])
    own = [d[0] for d in result.description]
    assert sorted(own) == columns
    assert got == sorted(([plain(r[own.index(c)]) for c in columns] for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_others_run(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() >= 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_llm():
    from pathlib import Path

    root = Path(__file__).parent.parent / "quillsift"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert ".llm" not in p.read_text() and "import llm" not in p.read_text(), p


def test_evaluation_slices_over_more_vectors(spark, tmp_path):
    """6,000 vectors and 120 cases, each slice against the SQL."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT vec_id + 2000 * i AS vec_id, embedding, label FROM '/root/testdata/sf0.1/embeddings.parquet', range(3) t(i)) TO '{tmp_path}/embeddings.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    for name in ("retrieval_eval", "retrieval_eval_slices"):
        result = con.execute(catalog.ORACLE[name])
        own = [d[0] for d in result.description]
        found = [[plain(r[c]) for c in own] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(found, key=repr) == sorted(([plain(x) for x in r] for r in result.fetchall()), key=repr)
