"""Operators on training data against brute force on small tables, with nulls, ties, empty tables and clashing names."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.llm import dedup, leaks, mixing, overlap, queries, spam, splits, unionfind, variety


def rows_of(folder: str, name: str, *columns: str):
    import pyarrow.parquet as pq

    return list(zip(*[pq.read_table(f"{folder}/{name}.parquet")[c].to_pylist() for c in columns], strict=True))


def structure(text):
    if text is None:
        return None
    text = re.sub("[‐-―−]", "-", unicodedata.normalize("NFKC", text))
    text = re.sub(r"[^A-Za-z0-9()\[\]=#\-+@/\\%:.*]", "", text).replace("CL", "Cl").replace("BR", "Br")
    return tuple(sorted(p for p in text.split(".") if p)) or None


def author(text):
    text = None if text is None else unicodedata.normalize("NFKC", text).lower()
    if text is None or text.strip() in ("unknown", "anonymous", "n/a"):
        return None
    return frozenset(re.findall(r"[^\W_]+", text)) or None


def forest(edges, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[top(a)] = top(b)
    return {n: top(n) for n in nodes}


# --- splits ------------------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["path", "random", "star", "empty"])
@pytest.mark.parametrize("size", [25, 1_000_000])
def test_components(spark, kind, size):
    rnd = random.Random(3)
    n = 60
    names = rnd.sample(range(10_000), n)
    pairs = {"path": [(i, i + 1) for i in range(n - 1)], "random": [(rnd.randrange(n), rnd.randrange(n)) for _ in range(50)], "star": [(0, i) for i in range(1, n)], "empty": []}[kind]
    edges = [(names[a], names[b]) for a, b in pairs]
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "a bigint, b bigint").repartition(4)
    got = dict(unionfind.components(df, size).collect())
    want = forest(edges, {x for e in edges for x in e})
    assert set(got) == set(want)
    assert len(set(zip(got.values(), (want[k] for k in got), strict=True))) == len(set(got.values())) == len(set(want.values()))


def test_forest_folds_in_proportion(monkeypatch):
    import pyarrow as pa

    calls = []
    kept = unionfind.roots
    monkeypatch.setattr(unionfind, "FOREST_EDGES", 5_000)
    monkeypatch.setattr(unionfind, "roots", lambda a, b: calls.append(len(a)) or kept(a, b))
    for n in (20_000, 80_000):
        calls.clear()
        # Disjoint edges: nothing a fold could save.
        batches = (pa.RecordBatch.from_arrays([pa.array(range(2 * k, 2 * k + 2000, 2)), pa.array(range(2 * k + 1, 2 * k + 2001, 2))], ["a", "b"]) for k in range(0, n, 1000))
        out = {x: y for b in unionfind._forest(batches) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        assert len(out) == 2 * n and all(y == x - x % 2 for x, y in out.items())
        assert sum(calls) <= 4 * n and len(calls) <= 6


def test_found_groups(spark, data):
    rows = rows_of(data, "smiles", "mol_id", "smiles", "author")
    edges = [(("id", i), ("s", structure(s))) for i, s, _ in rows if structure(s)] + [(("id", i), ("a", author(a))) for i, _, a in rows if author(a)]
    top = forest(edges, {x for e in edges for x in e} | {("id", i) for i, _, _ in rows})
    groups = defaultdict(list)
    for i, _, _ in rows:
        groups[top["id", i]].append(i)
    want = {(min(g), i) for g in groups.values() if len(g) > 1 for i in g}
    got = [tuple(r) for r in queries.p1_found(spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_split_edges(spark):
    rows = [(1, "CCO", "A B", 9), (2, "OCC", "b, a", 9), (3, "CCO", None, 9), (3, "CCO", "unknown", 9), (None, None, None, 9), (None, None, None, 9), (5, "", "", 9)] + [(100 + i, "C" * 6, None, 9) for i in range(40)]
    df = spark.createDataFrame(rows, "mol_id bigint, smiles string, author string, label int")
    groups = splits.related_groups(df, splits.molecule_ties(df))
    out = splits.assign_splits(groups, [("train", 0.5), ("test", 0.5)]).collect()
    assert len(out) == len(rows) and {r.n for r in out if r.id in (1, 2, 3)} == {4} and sorted(r.n for r in out if r.id is None) == [1, 1]
    assert len({r.split_name for r in out if r.id and r.id >= 100}) == 1
    assert all(len(s) == 1 for s in (lambda d: [d[k] for k in d])({g: {r.split_name for r in out if r.label == g} for g in {r.label for r in out}}))
    assert {r.split_name for r in splits.assign_splits(groups, []).collect()} == {None}
    empty = splits.related_groups(df.limit(0), splits.molecule_ties(df))
    assert splits.assign_splits(empty, [("train", 1.0)]).count() == 0
    wanted = [("train", 0.5), ("test", 0.3), ("none", 0.0)]
    report = {r.split_name: r for r in splits.achieved_shares(splits.assign_splits(groups, wanted), wanted).collect()}
    assert set(report) == {"train", "test", "none"} and sum(r.rows for r in report.values()) == len(rows) and abs(sum(r.share for r in report.values()) - 1) < 1e-9
    assert report["train"].target_share == 0.5 / 0.8 and report["none"].rows == 0
    assert {r.share for r in splits.achieved_shares(splits.assign_splits(empty, wanted), wanted).collect()} == {None}


def test_greedy_is_greedy():
    rnd = random.Random(5)
    for _ in range(30):
        sizes = Counter(rnd.choice([1, 1, 1, 2, 3, 7, 40]) for _ in range(rnd.randint(1, 900)))
        shares = [("a", 0.8), ("b", 0.1), ("c", 0.1)]
        total = sum(s * n for s, n in sizes.items())
        need = [total * x for _, x in shares]
        for s in sorted(sizes, reverse=True):
            for _ in range(sizes[s]):
                k = max(range(3), key=lambda i: (need[i], -i))
                need[k] -= s
        plan = splits.greedy_plan(list(sizes.items()), shares)
        assert {s: sum(g) for s, g in plan} == dict(sizes)
        left = [total * x - sum(s * g[i] for s, g in plan) for i, (_, x) in enumerate(shares)]
        assert np.abs(np.array(left) - need).max() <= max(1e-6, 0.0) + 1


# --- varied subsets ----------------------------------------------------------------------------------------------------------------------------------


def test_farthest_first_covers():
    rng = np.random.default_rng(1)
    # One series of 300 near copies and five other kinds: six places are one of each.
    kinds = rng.integers(0, 1 << 63, (6, 32), dtype=np.uint64)
    words = np.repeat(kinds, [300, 3, 3, 3, 3, 3], 0)
    words[:, 0] ^= np.uint64(1) << rng.integers(0, 60, len(words), dtype=np.uint64)
    picked = variety.farthest_first(words, np.arange(len(words)), 6)
    assert sorted(np.searchsorted(np.cumsum([300, 3, 3, 3, 3, 3]), picked, "right")) == [0, 1, 2, 3, 4, 5]
    assert variety.farthest_first(words, np.arange(len(words)), 6) == picked and len(variety.farthest_first(words[:2], np.arange(2), 6)) == 2


def test_subsets(spark, monkeypatch):
    monkeypatch.setattr(variety, "BUCKET", 30)
    rows = [(i, "C" * (1 + i % 25) + "O", "a" if i % 2 else "b", 1) for i in range(100)] + [(200, "bad(", "a", 1), (201, None, "a", 1), (None, "C#N", "a", 1)]
    df = spark.createDataFrame(rows, "mol_id bigint, smiles string, source string, fp int")
    plan = spark.createDataFrame([(1, None, 5), (2, "a", 500), (3, "none", 4), (4, "b", None), (5, "b", 3)], "plan_id int, source string, subset_size int")
    got = defaultdict(list)
    for r in variety.varied_subsets(variety.candidates(df), plan).collect():
        got[r.plan_id].append(r.id)
    assert {k: len(v) for k, v in got.items()} == {1: 5, 2: 25, 5: 3} and all(len(v) == len(set(v)) for v in got.values())
    assert variety.varied_subsets(variety.candidates(df.limit(0)), plan).count() == 0


def test_subsets_of_any_size(spark, monkeypatch):
    """Either side of the size from which the candidates are cut into shards: as many rows as asked for, each kind taken before its copies."""
    rows = [(i, "C" * (1 + i % 97) + "OCCN"[: 1 + i % 4], "a") for i in range(300)]
    df = spark.createDataFrame(rows, "mol_id bigint, smiles string, source string")
    cand = variety.candidates(df)
    n = cand.count()
    plan = spark.createDataFrame([(1, None, 20), (2, "a", n - 1), (3, "a", n), (4, "a", n + 50), (5, "a", 7), (None, "a", 3), (5, "a", 21)], "plan_id int, source string, subset_size int")
    for places in (10_000, 20, 6):
        monkeypatch.setattr(variety, "PLACES", places)
        monkeypatch.setattr(variety, "BUCKET", 40)
        got = defaultdict(list)
        for r in variety.varied_subsets(cand, plan).collect():
            got[r.plan_id].append((r.place, r.id))
        assert {p: len(v) for p, v in got.items()} == {1: 20, 2: n - 1, 3: n, 4: n, 5: 21}
        assert all(sorted(p for p, _ in v) == list(range(1, len(v) + 1)) and len({i for _, i in v}) == len(v) for v in got.values())


# --- similar pairs -----------------------------------------------------------------------------------------------------------------------------------


def brute_pairs(sets, t):
    items = sorted(sets.items())
    return {(i, j) for x, (i, a) in enumerate(items) for j, b in items[x + 1 :] if 10 * len(a & b) >= round(10 * t) * len(a | b)}


@pytest.mark.parametrize("small", [3, 6, 30])
def test_pairs_brute(spark, small):
    rnd = random.Random(small)
    rows = []
    for i in range(150):
        base = [f"t{rnd.randrange(12)}" for _ in range(rnd.randint(0, 9))]
        rows.append((i, base if i % 3 else [f"t{k}" for k in range(i % 7 + 3)]))
    rows += [(1000, None), (1001, [None, "t1", "t2", "t3"]), (1002, []), (None, ["t1", "t2", "t3"])]
    df = spark.createDataFrame([(i, s, 1) for i, s in rows], "mol_id bigint, tags array<string>, n int")
    sets, members = overlap.distinct_sets(df, F.col("tags"))
    want = brute_pairs({i: frozenset(x for x in s if x) for i, s in rows if i is not None and s and len({x for x in s if x}) >= 3}, 0.6)
    got = [tuple(r) for r in overlap.similar_rows(sets, members, overlap.similar_classes(sets, small=small)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links = Counter(x for pair in want for x in pair)
    held = {r.id: r for r in overlap.similar_members(sets, members, overlap.similar_classes(sets, small=small)).collect()}
    kept = {i: frozenset(x for x in s if x) for i, s in rows if i is not None and s and len({x for x in s if x}) >= 3}
    assert set(held) == set(kept) and all(held[i].links == links[i] for i in kept)
    assert all((held[i].class_id, held[i].copies) == (min(j for j in kept if kept[j] == kept[i]), sum(k == kept[i] for k in kept.values())) for i in kept)
    empty = overlap.distinct_sets(df.limit(0), F.col("tags"))
    assert overlap.similar_rows(*empty, overlap.similar_classes(empty[0])).count() == 0


def test_meet_blocks(spark):
    rows = [(k, i) for i in range(60) for k in ([1] if i < 40 else [i % 5])]
    df = spark.createDataFrame(rows, "k bigint, i bigint")
    got = [(r.x.i, r.y.i) for r in overlap.meet(df, df, "k", group=7).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for k, a in rows for m, b in rows if k == m}


def test_found_pairs(spark, data):
    sets = {i: frozenset(structure(s)) for i, s in rows_of(data, "smiles", "mol_id", "smiles") if structure(s) and len(set(structure(s))) >= 3}
    got = [tuple(r) for r in queries.p4_found(spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(sets, 0.6)


# --- hidden duplicates -------------------------------------------------------------------------------------------------------------------------------


def name_key(text):
    return None if text is None else "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())


def test_found_copies(spark, data):
    groups = defaultdict(list)
    for table in ("smiles", "selfies"):
        for i, n, s in rows_of(data, table, "mol_id", "name", "smiles"):
            if n is not None and structure(s):
                groups[name_key(n), structure(s)].append(i)
    got = [tuple(r) for r in queries.p5_found(spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == {(min(g), i) for g in groups.values() for i in g if i != min(g)}


def test_copies_edges(spark, monkeypatch):
    rows = [(1, "A-b", "C.O", 7), (2, "ab", "O.C", 7), (3, "AB", "ＣC", 7), (4, None, "C.O", 7), (5, "ab", "", 7), (6, "", "C.O", 7), (7, " ", "O.C", 7), (8, "ab", "C.C.O", 7), (9, "ab", "C.O.O", 7), (2, "ab", "C.O", 7), (10, "x" * 20_000, "C" * 20_000, 7)]
    df = spark.createDataFrame(rows, "mol_id bigint, name string, smiles string, copies int")
    want = Counter([(1, 1, 3), (2, 1, 3), (2, 1, 3), (3, 3, 1), (4, 4, 1), (5, 5, 1), (6, 6, 2), (7, 6, 2), (8, 8, 1), (9, 9, 1), (10, 10, 1)])
    assert Counter(tuple(r) for r in dedup.duplicates(df, dedup.molecule_fields(df), {"smiles"}).collect()) == want
    # A fingerprint that says nothing in the first rounds: only the check of the fields keeps different records apart.
    real = dedup.fingerprint
    monkeypatch.setattr(dedup, "fingerprint", lambda f, m, seed: F.lit(1).cast("bigint") if seed < 4 else real(f, m, seed))
    assert Counter(tuple(r) for r in dedup.duplicates(df, dedup.molecule_fields(df), {"smiles"}).collect()) == want
    monkeypatch.undo()
    assert dedup.duplicates(df.limit(0), dedup.molecule_fields(df), {"smiles"}).count() == 0


# --- leaking items -----------------------------------------------------------------------------------------------------------------------------------


def test_found_leaks(spark, data):
    words = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t or "")]
    windows = defaultdict(set)
    for i, t in rows_of(data, "eval_items", "item_id", "text"):
        w = words(t)
        for k in range(len(w) - 12):
            windows[tuple(w[k : k + 13])].add(i)
    want = set()
    for i, t in rows_of(data, "documents", "doc_id", "text"):
        w = words(t)
        want |= {(i, x) for k in range(len(w) - 12) for x in windows.get(tuple(w[k : k + 13]), ())}
    got = [tuple(r) for r in queries.p6_found(spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_leak_kinds(spark, monkeypatch):
    item = "The keeper of Zandor measured 120 tons of silt while the old mill near Varnby turned slowly for 3 days"
    swapped = item.replace("Zandor", "Kelmo").replace("120", "77").replace("tons", "kg").replace("Varnby", "Oster")
    docs = [(1, f"x. # {item.upper()}!"), (2, f"intro\n# {swapped}"), (3, item[:40]), (4, None), (5, ""), (6, ("noise " * 50_000) + item.lower()), (7, item.replace(" ", "_\n")), (8, item.replace("silt", "sand"))]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, window int")
    items = spark.createDataFrame([(9, item), (10, None), (11, "too short")], "item_id bigint, text string")
    for small in (leaks.SENT, 0):
        monkeypatch.setattr(leaks, "SENT", small)
        got = {r.doc_id: (r.verbatim, r.altered) for r in leaks.leaks(df, items).collect() if r.item_id == 9}
        assert {d for d, (v, _) in got.items() if v} == {1, 6, 7} and got[1][0] == 8
        if small:
            assert got[2] == (0, 8) and 3 not in got
    assert leaks.leaks(df.limit(0), items).count() == 0 and leaks.leaks(df, items.limit(0)).count() == 0


def test_window_hashes_shift():
    codes = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64)
    powers = leaks.Powers()
    whole = leaks.window_hashes(codes, 13, powers)
    assert len(set(whole.tolist())) == 488 and all(whole[k] == leaks.window_hashes(codes[k : k + 13], 13, powers)[0] for k in range(0, 488, 37))
    assert len(leaks.window_hashes(codes[:12], 13, powers)) == 0


# --- mixing ------------------------------------------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    if not Path(mixing.TOKENIZERS, mixing.VOCABULARY).exists():
        pytest.skip("no vocabulary files here")
    rows = [(i, "word " * (1 + i % 9), [" A ", "b", "C", None][i % 4], 1) for i in range(4000)] + [(9000, None, "a", 1), (9001, "", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies int")
    table = spark.createDataFrame([("a", 0.5, 3), ("B", 0.2, 2), ("c", 0.2, 5), ("gone", 0.1, 2), (None, 0.3, 1), ("b", None, 1)], "source string, target_share double, max_repeats int")
    targets = mixing.read_targets(table)
    docs = mixing.counted(df, targets)
    mixture, report = mixing.mix(docs, targets)
    shares = {r.source: r for r in report.collect()}
    assert set(shares) == {"a", "b", "c", "gone"} and shares["gone"].share == 0 and abs(shares["a"].share - 0.5 / 0.9) < 0.03 and abs(shares["b"].share - 0.2 / 0.9) < 0.03
    copies = Counter((r.source, r.doc_id) for r in mixture.collect())
    assert max(n for (s, _), n in copies.items() if s == "a") == 3 and sum(n for n in copies.values()) == mixture.count()
    assert {(s, n) for (s, _), n in Counter((r.source, r.doc_id) for r in mixing.mix(docs, targets)[0].collect()).items()} == {(s, n) for (s, _), n in copies.items()}
    _, few = mixing.mix(docs, targets, total=1e12)
    assert {r.source: r.rate for r in few.collect()} == {"a": 3.0, "b": 2.0, "c": 5.0, "gone": 0.0}
    mixture, report = mixing.mix(mixing.counted(df.limit(0), targets), targets)
    assert mixture.count() == 0 and {r.share for r in report.collect()} == {None}


def test_pieces():
    for text in ("", "a" * 50, "ab cd " * 20, " " * 30, "x1y22z " * 9):
        assert "".join(mixing.pieces(text, 10)) == text
    assert max(map(len, mixing.pieces("ab cd " * 20, 10))) <= 16 and mixing.pieces("a" * 50, 10) == ["a" * 50]


def test_tokens_do_not_depend_on_pieces():
    path = Path(mixing.TOKENIZERS, mixing.VOCABULARY)
    if not path.exists():
        pytest.skip("no vocabulary files here")
    encode = mixing._encoding("test", path.read_bytes()).encode_ordinary
    rnd = random.Random(4)
    image = "".join(rnd.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(3000))
    texts = [image, "it's 12ab  two\n\n three's\t x1 " * 60, "é²Ⅷ1a ٣b " * 80, "don't we'll I've " * 90, "   lead  " * 90, "}{;:\n  if (x==1)  {\n" * 60, "aaaa" * 500]
    for text in texts:
        for size in (1, 7, 64, 1000, 1 << 20):
            assert [t for p in mixing.pieces(text, size) for t in encode(p)] == encode(text)


# --- stuffed pages -----------------------------------------------------------------------------------------------------------------------------------

PROSE = "# %% [markdown]\nWe fit the model to the data and look at what it says about the price of the shop.\n\n# %% [code] In[1]\nimport pandas as pd\ndf = pd.read_csv('a.csv')\n\n# %% [output]\n   a  b\n0  1.2  3.4\n"
LINKS = "# %% [markdown]\n" + "\n".join(f"* [cheap item {i}](http://shop{i}.example/buy)" for i in range(40))
TAGS = "# %% [markdown]\n" + " ".join(f"#tag{i}shop" for i in range(60))
WORDS = "# %% [markdown]\n" + "cheap shoes buy shoes best shoes " * 40
LISTS = "# %% [output]\n" + "\n".join(f"package{i}-kit==1.{i}.0" for i in range(200)) + "\n" + "\n".join(f"{i}  https://x{i}.example/a  {i}" for i in range(30))


def test_pages(spark, data):
    rng = random.Random(1)
    pages = [PROSE * rng.randint(1, 4) for _ in range(60)] + [LINKS] * 3 + [TAGS] * 3 + [WORDS] * 3 + [PROSE + LISTS] * 6 + [None, "", "!!!", "# %% [markdown]\n", PROSE * 3 + LINKS[:200]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(pages)], "doc_id bigint, text string, links int")
    got = {r.doc_id: r for r in spam.page_labels(df).collect()}
    assert len(got) == len(pages) and {i for i, r in got.items() if r.share is not None and r.share > 0.5} == set(range(60, 69))
    assert [got[i].share for i in range(75, 79)] == [None] * 4
    assert spam.page_labels(df.limit(0)).count() == 0
    assert queries.p8_found(spark, data).count() < queries.p8_pages(spark, data).count()


def test_sample_is_bounded(spark):
    pages = spark.createDataFrame([(i % 40, "x" * (1 + i)) for i in range(200)] + [(500, None)], "id bigint, text string")
    everything = spam.sample(pages, 1000)
    assert len(everything) == 200
    few = spam.sample(pages, 1000, 3000)
    assert sum(map(len, few)) <= 3000 and set(few) <= set(everything) and few and sorted(spam.sample(pages.repartition(3), 1000, 3000)) == sorted(few)
    assert spam.sample(pages, 1000, 0) == [] and spam.sample(pages.limit(0)) == []


def test_multisets(spark):
    rows = [(["a", "b"], ["b", "a"], True), (["a", "a", "b"], ["a", "b", "b"], False), (["a", "b", "a"], ["b", "a", "a"], True), ([], [], True), (["a"], ["b"], False), (["a", "b"], ["a"], False)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, want boolean")
    assert df.filter(dedup.same_multiset(F.col("a"), F.col("b")) == F.col("want")).count() == len(rows)


def test_viterbi_brute():
    import itertools

    rng = np.random.default_rng(2)
    n = 7
    lines = spam.Lines(np.array([0, 0, 0, 0, 2, 2, 3]), np.ones(n, int), np.stack([rng.integers(0, k, n) for k in spam.LEVELS], 1).astype(np.int8))
    model = spam.fit(lines, rng.integers(0, 5, n))
    scores, got = model.scores(lines), spam.viterbi(model, lines)

    def value(path, rows):
        return model.start[path[0]] + sum(scores[r, s] for r, s in zip(rows, path, strict=True)) + sum(model.step[a, b] for a, b in itertools.pairwise(path))

    for rows in ([0, 1, 2, 3], [4, 5], [6]):
        best = max(value(p, rows) for p in itertools.product(range(5), repeat=len(rows)))
        assert abs(value(tuple(got[rows]), rows) - best) < 1e-9


def test_line_counts():
    lines = spam.describe("one two two\n\n# %% [code]\nx = 1\n#a #b".encode().split(b"\x00"))
    assert lines.words.tolist() == [3, 2, 2] and lines.levels[:, 1].tolist() == [0, 0, 3]
    assert len(spam.describe([b"", b"\n"]).page) == 0
