"""Every query with SQL gives the SQL's rows; the others are held to their own facts."""

import os

import duckdb
import pytest

from textloom.plans import catalog

DIR = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 5) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DIR)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns)


def test_inverted_file_with_all_cells_is_exact(spark):
    rows = {r.nprobe: r.recall for r in catalog.queries()["ivf_topk_recall"](spark, DIR).collect()}
    assert rows[16] == 1.0 and rows[1] <= rows[4] <= rows[16]


def test_packed_chunks(spark):
    rows = catalog.queries()["chunk_paragraph_pack"](spark, DIR).collect()
    assert rows and all(50 <= r.char_len <= 800 for r in rows)
    assert len({r.chunk_id for r in rows}) == len(rows)


@pytest.mark.parametrize("name", ["run_alignment", "search_modes", "gate_rrf", "metrics_by_slice", "cc_minmax", "lead_by_winner", "rerank_topk"])
def test_documents_are_scored_once(spark, name):
    """What comes after the scoring reads its written lists; no reader of a pool scores all documents again."""
    plan = catalog.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
