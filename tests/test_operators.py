"""Core operators on small tables: empty tables, nulls, ties, clashing names."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from retort.functions import molecules as M
from retort.functions.screening import metrics_by_group
from retort.operators import records
from retort.operators.skew import lookup
from retort.plans import formats, golden, queries, workflows


def test_records(spark):
    lines = [
        (1, 'a,CCO,C2H6O,3,2', None), (2, '"a,CCO,C2H6O,3,2', "quoting"), (3, "a,CCO", "column_count"), (4, "a,C(,x,1,1", "invalid_value"), (5, "a,CCO,x,2147483648,1", "invalid_value"),
        (6, "a,CCO,,,", None), (7, 'a,"CCO",x,"3",0002147483647', None), (8, "", "column_count"), (9, None, "column_count"), (10, "a,,x,1,1", "invalid_value"),
        (11, "a,CCO,x, 3,1", "invalid_value"), (12, 'a,C"C,x,3,1', "quoting"), (13, '"a\nb",CCO,x,3,1', None), (14, "a," + "C" * 5000 + ",x,1,1", None),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in lines], "line_id bigint, line string, reason string")
    checked = records.check_records(df, records.SMILES)
    assert {r.line_id: r.reason for r in checked.select("line_id", "reason").collect()} == {i: r for i, _, r in lines}
    good = {r.line_id: r for r in records.typed(checked, records.SMILES, ["line_id"]).collect()}
    assert good[7].expected_bonds == 2147483647 and good[6].expected_atoms is None and good[13].name == "a\nb"
    assert records.rejected(checked).filter("line_id = 12").first()["at"] == 3
    assert records.check_records(df.limit(0), records.INCHI).count() == 0
    inchi = spark.createDataFrame([(1, "a,InChI=1S/CH4,CH4,TRUE,1"), (2, "a,InChI=1S,CH4,yes,1"), (3, "a,InChI=1S/C,CH4,,")], "line_id bigint, line string")
    assert [r.reason for r in records.check_records(inchi, records.INCHI).orderBy("line_id").collect()] == [None, "invalid_value", None]


def test_lookup_hot_key(spark):
    big = spark.range(30_000).select(F.when(F.col("id") < 25_000, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    for rows in (None, small.count()):
        out = lookup(big, small.filter("k <> 3"), "k", "n", 30_000, rows)
        assert out.count() == 30_000 and out.filter("top is null").count() == big.filter("k = 3").count()
        assert out.filter("k = 7").select("top").distinct().first()[0] == big.filter("k = 7").agg(F.max("id")).first()[0]


def test_lookup_long_hot_rows(spark):
    # A hot key of 20,000 characters: its row in the small table goes out in parts, and no task gets more than the limit of its rows.
    text = F.when(F.col("id") < 60_000, F.lit("x" * 20_000)).when(F.col("id") < 80_000, F.lit(None).cast("string")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))
    big = spark.range(100_000).select(text.alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    out = lookup(big, small, "k", "n", 100_000)
    got = out.groupBy(F.length("k") > 1000).agg(F.count("*").alias("n"), F.min("least").alias("a"), F.max("least").alias("b"), F.sum((F.col("least") == F.col("id")).cast("int")).alias("own")).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {True: (60_000, 0, 0, 1), None: (20_000, None, None, None), False: (20_000, 80_000, 99_999, 20_000)}


def test_profile_columns(spark):
    df = spark.createDataFrame([(1, "CCO", 9), (2, None, 9), (3, "bad", 9), (4, "", 9), (5, "CCO", 9)], "id int, smiles string, mol_weight int")
    for distinct in (False, True):
        rows = {r.id: r for r in M.profile(df, "smiles", ["mol_weight", "mol_formula"], distinct).collect()}
        assert len(rows) == 5 and rows[1].mol_formula == rows[5].mol_formula == "C2H6O" and rows[2].valid is None and rows[3].valid is False and rows[4].mol_weight is None
    assert M.profile(df.limit(0), "smiles", ["mol_formula"]).count() == 0


def test_threshold_join_brute(spark):
    texts = ["CCO", "CCCO", "CCCCO", "CCCCCO", "c1ccccc1C", "c1ccccc1CC", "c1ccccc1CCC", "CC(=O)O", "CC(=O)N", "bad", None, "CCO"]
    fps = workflows.fingerprints(spark.createDataFrame(list(enumerate(texts)), "mol_id bigint, smiles string"), "smiles")
    bits = {i: int.from_bytes(M.FIELDS["morgan_fp_bits"].make(M.molecule(t)), "little") for i, t in enumerate(texts) if t and M.molecule(t)}
    for t in (0.3, 0.6, 1.0):
        want = {(i, j) for i in bits for j in bits if i < j and bits[i] != bits[j] and (bits[i] & bits[j]).bit_count() / (bits[i] | bits[j]).bit_count() >= t and 11 not in (i, j)}
        assert {(r.a, r.b) for r in workflows.threshold_join(fps, t, group=2).collect()} == want
    assert workflows.threshold_join(fps.limit(0), 0.5).count() == 0


def test_written_and_released(spark):
    from retort.session import checkpoint_dir, folder_for, path_of, release, written

    df = written(spark.range(5), "five")
    assert df.count() == 5 and path_of(df.inputFiles()[0]).startswith(path_of(checkpoint_dir(spark)))
    assert release(spark) >= 1 and release(spark) == 0
    assert path_of("file:///tmp/x") == path_of("file:/tmp/x") == path_of("/tmp/x")
    assert folder_for("s3://shared/x", "yarn") == "s3://shared/x" and "retort-" in folder_for(None, "local[4]")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            folder_for(None, master)


def test_metrics_edges(spark):
    rows = [("a", 1.0, True, 1), ("a", 1.0, False, 2), ("a", 2.0, False, 3), ("b", 1.0, True, 1), ("c", None, True, 1), ("c", float("nan"), True, 2), (None, 1.0, True, 1), (None, 2.0, False, 2)]
    df = spark.createDataFrame(rows, "g string, s double, l boolean, t int")
    got = {r.g: r for r in metrics_by_group(df, ["g"], "s", "l", ["t"]).collect()}
    assert set(got) == {"a", "b", None} and got["a"].roc_auc == 0.75 and got["b"].roc_auc is None and got[None].roc_auc == 1.0 and got["a"].enrichment == 3.0
    assert metrics_by_group(df.limit(0), ["g"], "s", "l", ["t"]).count() == 0


def test_metrics_of_large_groups(spark):
    """One group holds most rows; either side of the size from which groups are cut into ranges, and with lists instead, the metrics are the same."""
    from retort.functions import screening

    rows = spark.range(6_000).select(
        F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, None).otherwise("other").alias("g"), F.col("id").alias("t"), (F.xxhash64("id") % 7 == 0).alias("l"),
        F.when(F.col("id") % 50 == 0, 1e12).when(F.col("id") % 3 == 0, F.round(F.xxhash64("id", F.lit(1)) / 1e18, 0)).otherwise(F.xxhash64("id", F.lit(2)) / 1e17).alias("s"),
    )
    got = [{r.g: tuple(None if x is None else round(x, 9) for x in r[1:]) for r in metrics_by_group(rows, ["g"], "s", "l", ["l", "t"], large=large).collect()} for large in (None, 100)]
    lists = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("s", "l", "t"))).alias("r"))
    s, l = F.col("r.s"), F.col("r.l")
    listed = lists.select("g", F.size("r").alias("n"), F.size(F.filter(l, lambda x: x)).alias("a"), screening.roc_auc(s, l), screening.enrichment_factor(s, l, F.lit(0.1)), screening.bedroc(s, l, F.lit(20.0)))
    assert got[0] == got[1] == {r.g: tuple(round(x, 9) for x in r[1:]) for r in listed.collect()} and got[0]["hot"][0] == 4_800


def test_metrics_of_one_tie(spark):
    """One score holds most rows, half of them the same; the order within it counts for the best tenth."""
    from retort.functions import screening

    rows = spark.range(4_000).select(F.lit("g").alias("g"), F.when(F.col("id") < 3_600, 1.5).otherwise(F.col("id") / 1e3).alias("s"), (F.xxhash64("id") % 5 == 0).alias("l"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("t"))
    got = metrics_by_group(rows, ["g"], "s", "l", ["t", "l"]).first()
    r = F.array_sort(F.collect_list(F.struct("s", "t", "l")))
    lists = rows.groupBy("g").agg(r.alias("r")).select(screening.roc_auc(F.col("r.s"), F.col("r.l")), screening.enrichment_factor(F.col("r.s"), F.col("r.l"), F.lit(0.1)), screening.bedroc(F.col("r.s"), F.col("r.l"), F.lit(20.0)))
    assert [round(x, 9) for x in got[3:]] == [round(x, 9) for x in lists.first()]


def test_lists_either_side(spark, data, monkeypatch):
    monkeypatch.setattr(queries, "LIST_ROWS", 3)
    some = {tuple(r) for r in queries.vs_lists(spark, data).collect()}
    monkeypatch.undo()
    assert some == {tuple(r) for r in queries.vs_lists(spark, data).collect()}


def test_sdf_source(spark, tmp_path):
    from retort.sources.sdf import read_csv, read_sdf, read_texts
    from tests.test_functions_sql import SDF

    (tmp_path / "a.sdf").write_text(SDF)
    rows = read_sdf(spark, str(tmp_path / "a.sdf")).select("mol.name", F.size("mol.atoms").alias("n")).collect()
    assert {(r.name, r.n) for r in rows} == {("sample a", 4), ("sample b", 2)}
    assert read_texts(spark, str(tmp_path / "a.sdf")).count() == 1
    (tmp_path / "a.csv").write_text('name,smiles\n"a ""b""",CCO\n"two\nlines",C\n')
    assert {r.name for r in read_csv(spark, str(tmp_path / "a.csv"), "name string, smiles string").collect()} == {'a "b"', "two\nlines"}


def test_asof_edges(spark):
    from retort.operators.ranges import asof_join

    left = spark.createDataFrame([("a", 5.0, 1), ("a", 0.5, 2), ("b", 9.0, 3), (None, 9.0, 4), ("a", None, 5), ("a", 5.0, 1), ("a", 900.0, 6)], "k string, t double, prior_v int")
    right = spark.createDataFrame([("a", 1.0, 10), ("a", 5.0, 11), ("a", 5.0, 12), ("a", 6.0, 13), ("b", 10.0, 14), ("b", None, 15), (None, 1.0, 16)], "k string, t double, v int")
    for width in (0.7, 3.0, 1e6):
        got = sorted((tuple(r) for r in asof_join(left, right, ["k"], "t", width).collect()), key=repr)
        want = [("a", 5.0, 5.0, 12), ("a", 0.5, None, None), ("b", 9.0, None, None), (None, 9.0, None, None), ("a", None, None, None), ("a", 5.0, 5.0, 12), ("a", 900.0, 6.0, 13)]
        assert got == sorted(want, key=repr)
    assert asof_join(left.limit(0), right, ["k"], "t", 1.0).count() == 0 and asof_join(left, right.limit(0), ["k"], "t", 1.0).filter("prior_v is null").count() == 7


def test_range_edges(spark):
    from retort.operators.ranges import range_join

    points = spark.createDataFrame([(0.0,), (1.0,), (-3.5,), (None,), (1.0,)], "p double")
    ranges = spark.createDataFrame([(0.0, 1.0, "x"), (1.0, 1.0, "empty"), (-4.0, 2.0, "wide"), (None, 2.0, "null"), (1.0, 9.0, "y")], "a double, b double, n string")
    got = sorted((r.p, r.n) for r in range_join(points, ranges, "p", "a", "b", 0.4).collect())
    assert got == sorted([(0.0, "x"), (0.0, "wide"), (1.0, "wide"), (1.0, "y"), (1.0, "wide"), (1.0, "y"), (-3.5, "wide")])
    assert range_join(points.limit(0), ranges, "p", "a", "b", 1.0).count() == 0


def test_typed_twins_and_tables(spark):
    from retort.functions import typed

    typed.register_typed(spark)
    spark.createDataFrame([(1, "CC(=O)O"), (2, None), (3, "bad("), (4, "")], "id int, s string").createOrReplaceTempView("texts")
    rows = {r.id: r for r in spark.sql("SELECT id, ring_systems(s) AS r, structural_alerts(s) AS a, mol_substructure_matches(s, 'C=O') AS m, mcs(s, 'CC(=O)N') AS c, scaffold_network(s) AS n FROM texts").collect()}
    assert rows[1].r == [] and rows[1].m[0].atom_indices == [2, 3] and rows[1].m[0].symbols == ["C", "O"] and rows[1].c.smarts == "C(C)=O" and rows[1].n.nodes[0].kind == "molecule"
    assert all(v is None for i in (2, 3, 4) for v in rows[i][1:])
    assert [tuple(r) for r in spark.sql("SELECT id, m.match FROM texts, LATERAL substructure_matches(s, 'C~O') m ORDER BY 1, 2").collect()] == [(1, 1), (1, 2)]
    assert spark.sql("SELECT * FROM texts, LATERAL structure_atoms(s) a").count() == 0
    words = spark.createDataFrame([("a", [3, -1]), ("a", [5, 0]), ("a", None), ("b", None)], "k string, w array<bigint>")
    got = {r.k: (list(r.x), list(r.y)) for r in words.groupBy("k").agg(typed.any_words(F.col("w"), 2).alias("x"), typed.all_words(F.col("w"), 2).alias("y")).collect()}
    assert got == {"a": ([7, -1], [1, 0]), "b": ([None, None], [None, None])}


def test_feeds_in_one_pass(spark):
    lines = [(1, "smiles", "a,CCO,C2H6O,3,2"), (2, "inchi", "a,InChI=1S/CH4,CH4,TRUE,1"), (3, "inchi", "a,CCO,x,,"), (4, "smiles", "a,InChI=1S/CH4,x,,"), (5, "other", "a"), (6, None, "a"), (7, "inchi", '"a,x'), (8, "smiles", None), (9, "inchi", "a,InChI=1S/CH4,CH4,TRUE,-1")]
    df = spark.createDataFrame(lines, "line_id bigint, feed string, line string")
    got = {r.line_id: (r.reason, r.column) for r in records.check_feeds(df, {"smiles": records.SMILES, "inchi": records.INCHI}).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: ("invalid_value", "inchi"), 4: ("invalid_value", "smiles"), 7: ("quoting", None), 8: ("column_count", None), 9: ("invalid_value", "stereo_centers")}
    typed = records.typed(records.check_records(df.filter("feed = 'inchi'"), records.INCHI), records.INCHI, ["line_id"]).collect()
    assert [(r.line_id, r.has_stereo, r.stereo_centers) for r in typed] == [(2, True, 1)]


ALL_SQL = {name: (part, sql) for part in (queries, golden, formats) for name, sql in part.SQL.items()}


@pytest.mark.parametrize("name", sorted(ALL_SQL))
def test_queries_against_sql(spark, data, name):
    con = duckdb.connect()
    from pathlib import Path

    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    part, sql = ALL_SQL[name]
    df = part.QUERIES[name](spark, data)
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    order = sorted(df.columns)
    assert sorted(names) == order
    got = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    assert got == sorted(repr([plain(r[names.index(c)]) for c in order]) for r in want.fetchall())
