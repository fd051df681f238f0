"""Operators on training data that once did less than the whole job."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from retort.llm import leaks, variety
from retort.llm import queries as llm


def test_leaks_of_any_size(spark, monkeypatch):
    item = "The keeper of Zandor measured 120 tons of silt while the old mill near Varnby turned slowly for 3 days"
    swapped = item.replace("Zandor", "Kelmo").replace("120", "77").replace("tons", "kg").replace("Varnby", "Oster")
    docs = [(1, item.upper()), (2, swapped), (3, None), (4, ""), (5, "noise " * 5_000 + item.lower()), (6, item.replace("silt", "sand")), (7, item.replace("Varnby", "Zandor")), (2, item), (None, swapped)]
    df = spark.createDataFrame([*docs, *[(i, f"the old mill {i}") for i in range(100, 200)]], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, item), (10, None), (11, "too short"), (12, item.replace("mill", "Kelmo"))], "item_id bigint, text string")
    got = []
    for sent in (leaks.SENT, 10, 0):
        monkeypatch.setattr(leaks, "SENT", sent)
        got.append({tuple(r) for r in leaks.leaks(df, items).collect()})
    assert got[0] == got[1] == got[2] and {(1, 9, 8, 0), (None, 9, 0, 8)} <= got[0]
    assert leaks.leaks(df.limit(0), items).count() == 0 and leaks.leaks(df, items.limit(0)).count() == 0


def test_subset_of_copies_is_filled(spark, tmp_path):
    rows = [(i, "C" * (1 + i % 25) + "O", "a" if i % 2 else "b") for i in range(100)] + [(200, "bad(", "a"), (201, None, "a"), (None, "CO", "a")]
    spark.createDataFrame(rows, "mol_id bigint, smiles string, source string").write.parquet(f"{tmp_path}/smiles.parquet")
    spark.createDataFrame([(1, None, 60), (2, "a", 500), (3, "none", 4), (4, "b", 30), (5, "b", 3)], "plan_id int, source string, subset_size int").write.parquet(f"{tmp_path}/subset_plan.parquet")
    got = {}
    for r in llm.p3_subset(spark, str(tmp_path)).collect():
        got.setdefault(r.plan_id, {})[r.place] = r.mol_id
    assert {p: len(v) for p, v in got.items()} == {1: 60, 2: 50, 4: 30, 5: 3} and all(set(v) == set(range(1, len(v) + 1)) and len(set(v.values())) == len(v) for v in got.values())
    assert set(got[2].values()) == set(range(1, 100, 2)) and all(i % 2 == 0 for i in got[4].values())
    copies = [sum(i % 25 == k for i in got[1].values()) for k in range(25)]
    assert sorted(copies) == [2] * 15 + [3] * 10 and {i % 25 for p, i in got[1].items() if p <= 25} == set(range(25))


def test_subset_of_many_places_is_one_choice(spark, monkeypatch):
    """A plan of more places than one task gives is still chosen among all pooled candidates: the choice of one task, not a choice for each part of the candidates."""
    rng = np.random.default_rng(1)
    sizes = [300] + [3] * 11
    words = np.repeat(rng.integers(0, 1 << 63, (12, 32), dtype=np.uint64), sizes, 0)
    words[:, 0] ^= np.uint64(1) << rng.integers(0, 60, len(words), dtype=np.uint64)
    kind = np.repeat(np.arange(12), sizes)
    rows = [(i, "b" if i % 3 else "a", str(i), w.tobytes()) for i, w in enumerate(words)]
    cand = spark.createDataFrame(rows, "id bigint, source string, text string, fp binary")
    # The third plan takes all it can get, the last one stays below the places of a task.
    plan = spark.createDataFrame([(1, None, 12), (2, "b", 40), (3, "a", 500), (4, "a", 3), (None, "a", 9)], "plan_id int, source string, subset_size int")
    monkeypatch.setattr(variety, "BLOCK", 50, raising=False)
    got = {}
    for bucket in (20_000, 40):
        monkeypatch.setattr(variety, "BUCKET", bucket)
        for places in (10_000, 4):
            monkeypatch.setattr(variety, "PLACES", places)
            found = {1: [], 2: [], 3: [], 4: []}
            for r in variety.varied_subsets(cand, plan).orderBy("plan_id", "place").collect():
                found[r.plan_id].append(r.id)
                assert r.place == len(found[r.plan_id])
            assert set(kind[found[1]]) == set(range(12)) and sorted(found.pop(3)) == list(range(0, len(rows), 3))
            got[bucket, places] = found
        assert got[bucket, 10_000] == got[bucket, 4]
    assert got[20_000, 4][1] == variety.farthest_first(words, np.arange(len(words)), 12)


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_queries_against_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("smiles", "selfies", "documents", "eval_items", "mix_targets", "subset_plan"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    df = llm.QUERIES[name](spark, data)
    want = con.execute(llm.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr([r[c] for c in names]) for r in df.collect()) == sorted(repr(list(r)) for r in want.fetchall())
