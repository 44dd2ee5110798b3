"""Registered queries against their SQL, and the pipeline against brute force, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from tidemark.llm.queries import oracle_sql, queries  # noqa: E402
from tidemark.plans.check import compare, duckdb_con  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_small):
    return duckdb_con(sf_small)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(lspark, sf_small, con, name):
    df = queries()[name](lspark, sf_small)
    rows = [tuple(r) for r in df.collect()]
    con.execute(oracle_sql()[name])
    cols = [d[0] for d in con.description]
    err = compare(rows, df.columns, con.fetchall(), cols)
    assert err is None, err


def test_reruns_agree(lspark, sf_small):
    one, two = (sorted(tuple(r) for r in queries()["op1_pareto_mix"](lspark, sf_small).collect()) for _ in range(2))
    assert one == two


def test_pipeline_matches_brute_force(lspark, sf_small, con):
    import corpus_pipeline as cp
    docs = lspark.read.parquet(f"{sf_small}/documents.parquet")
    clean = {r["doc_id"]: r for r in cp.toxicity(lspark, docs, sf_small).collect()}
    first, kept = {}, []
    for i in sorted(clean):
        if first.setdefault(brute.norm(clean[i]["text"]), i) == i:
            kept.append(i)
    groups = brute.near_groups([(i, clean[i]["text"]) for i in kept])
    kept = sorted(min(kept[j] for j in groups if groups[j] == g) for g in set(groups.values()))
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    kept = [i for i in kept if not brute.hits(clean[i]["text"], items)[1]]
    con.execute("CREATE TEMP TABLE left_over(doc_id BIGINT)")
    con.executemany("INSERT INTO left_over VALUES (?)", [[i] for i in kept])
    sql = oracle_sql()["op1_pareto_mix"].replace("FROM documents", "FROM documents SEMI JOIN left_over USING (doc_id)")
    got = cp.run(lspark, sf_small).select("doc_id", "size", "source_size", "target", "copies", "taken")
    con.execute(sql)
    cols = [d[0] for d in con.description]
    assert compare([tuple(r) for r in got.collect()], got.columns, con.fetchall(), cols) is None
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
