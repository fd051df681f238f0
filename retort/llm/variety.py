"""Choosing a varied subset: distributed farthest-first k-center selection on fingerprints.

Distinct structures are spread evenly over buckets by hash; in each bucket
representatives are chosen greedily, each the one farthest from all chosen so
far; the buckets' representatives are pooled and chosen among again, in rounds
of smaller pools, until one pool is left and gives the required number. A big
series of similar molecules thus costs one or few places, and copies none. A
pool too large for one task is chosen among by all tasks, in rounds, with the
choice that one task would make.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from retort.functions.normal import structure
from retort.kernel.mol import parse
from retort.kernel.morgan import morgan_bits
from retort.session import erase, shared, written

#: Candidates of one bucket, about; 256 bytes of fingerprint each. A bucket holds at least four times the places it gives.
BUCKET = 20_000
#: Places that one task chooses at most, out of four times as many candidates; the buckets and pools of a plan of more places are chosen among in rounds, by all tasks.
PLACES = 10_000
#: Candidates of one block of a bucket that is chosen among in rounds, and those that all its blocks together propose in one round, about.
BLOCK, PROPOSED = 10_000, 10_000
RADIUS, BITS = 2, 2048
#: Texts that one task fingerprints, about.
TEXTS = 20_000


#: Components whose fingerprints a worker remembers.
REMEMBERED = 50_000
# A bond symbol left over at the end of a component, or behind its last branch, would apply to the next one.
_LEFT_OVER = re.compile(r"[=#\-:/\\]\)*\Z|[=#\-:/\\]\)")


@lru_cache(maxsize=REMEMBERED)
def _component_bits(text: str) -> int | None:
    """Fingerprint of one component as an integer, null where it isn't a molecule by itself or doesn't end cleanly."""
    mol = None if _LEFT_OVER.search(text) else parse(text)
    return None if mol is None else int.from_bytes(morgan_bits(mol, RADIUS, BITS), "little")


def fingerprint(text: str) -> bytes | None:
    """Circular fingerprint of a structure text, null if it isn't valid.

    Environments don't reach beyond a component, so the bits of a mixture are those of its components, each of which is computed once per worker. Where
    components aren't molecules by themselves - a ring or a bond may reach across the dot - the text is taken as a whole.
    """
    bits = 0
    for part in text.split("."):
        of_part = _component_bits(part)
        if of_part is None:
            mol = parse(text)
            return None if mol is None else morgan_bits(mol, RADIUS, BITS)
        bits |= of_part
    return bits.to_bytes(BITS // 8, "little")


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else fingerprint(t) for t in texts.to_pylist()], pa.binary())


# Declared not deterministic, so that a filter on the result stays above and each text is fingerprinted once.
_fingerprint = arrow_udf(_fingerprints, T.BinaryType()).asNondeterministic()


def _words(prints: pd.Series) -> np.ndarray:
    """Fingerprints as rows of words."""
    return np.frombuffer(b"".join(prints), np.uint64).reshape(-1, BITS // 64)


def _sizes(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(1).astype(np.int32)


def _distances(turned: np.ndarray, size: np.ndarray, one: np.ndarray) -> np.ndarray:
    """1 - Tanimoto of ``one`` to rows of fingerprint words that are given as columns."""
    common = np.bitwise_count(turned & one[:, None]).sum(0, dtype=np.uint16).astype(np.int32)
    return 1 - common / np.maximum(size + int(np.bitwise_count(one).sum()) - common, 1)


def _density(words: np.ndarray) -> np.ndarray:
    """How many rows have each bit. Whole numbers, so that sums don't hang on their order."""
    return sum(np.unpackbits(words[i : i + 1024].view(np.uint8), axis=1).sum(0) for i in range(0, len(words), 1024)).astype(np.float64)


def _typical(words: np.ndarray, density: np.ndarray) -> np.ndarray:
    """How common the bits of each row are on average."""
    common = np.concatenate([np.unpackbits(words[i : i + 1024].view(np.uint8), axis=1).astype(np.float64) @ density for i in range(0, len(words), 1024)])
    return common / np.maximum(_sizes(words), 1)


def farthest_first(words: np.ndarray, order: np.ndarray, k: int) -> list[int]:
    """Positions of up to k rows of fingerprint words, each the farthest (1 - Tanimoto) from those before; ties go to the smallest ``order``.

    The first is the row whose bits are on average the most common ones, so that the choice doesn't hang on row order.
    """
    n = len(words)
    if n <= k:
        return list(range(n))
    rank = np.argsort(order, kind="stable")
    words = words[rank]
    size, turned = _sizes(words), np.ascontiguousarray(words.T)
    chosen = [int(_typical(words, _density(words)).argmax())]
    nearest = np.full(n, np.inf)
    while len(chosen) < k:
        one = chosen[-1]
        nearest = np.minimum(nearest, _distances(turned, size, words[one]))
        nearest[one] = -1
        chosen.append(int(nearest.argmax()))
    return [int(rank[i]) for i in chosen]


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["id", "key"], ignore_index=True)
    picked = farthest_first(_words(pdf["fp"]), pdf.index.to_numpy(), int(pdf["k"].iloc[0]))
    return pdf.iloc[picked].assign(place=np.arange(1, len(picked) + 1, dtype=np.int32))


_GROUP = "plan_id int, bucket int"
#: The rows of a bucket that is chosen among in rounds. ``near`` is the distance to the nearest row chosen; ``mark`` is 1 for rows proposed, 2 for the last one of a block that holds more.
_STATE = f"{_GROUP}, block int, key bigint, id bigint, fp binary, near double, mark int"
_CHOSEN = f"{_GROUP}, key bigint, id bigint, fp binary, place int"


def _proposed(rows: pd.DataFrame, near: np.ndarray, most: int) -> pd.DataFrame:
    """``rows`` with their ``near``; the ``most`` farthest are marked."""
    best = np.lexsort((rows["key"].to_numpy(), rows["id"].to_numpy(), -near))[:most]
    mark = np.zeros(len(rows), np.int32)
    mark[best] = 1
    if len(rows) > most:
        mark[best[-1]] = 2
    return rows.assign(near=near, mark=mark)


def _block_density(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.iloc[:1][["plan_id", "bucket"]].assign(fp=[_density(_words(pdf["fp"])).tobytes()])


def _bucket_density(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.iloc[:1][["plan_id", "bucket"]].assign(fp=[sum(np.frombuffer(d) for d in pdf["fp"]).tobytes()])


def _first(rows: pd.DataFrame, density: pd.DataFrame) -> pd.DataFrame:
    """For the first choice the most typical row counts as the farthest."""
    return rows if rows.empty else _proposed(rows, _typical(_words(rows["fp"]), np.frombuffer(density["fp"].iloc[0])), int(density["most"].iloc[0]))


def _next(rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
    """The rows left, nearer by those chosen last."""
    rows = rows[~rows["key"].isin(chosen["key"])]
    if rows.empty:
        return rows
    words = _words(rows["fp"])
    size, turned = _sizes(words), np.ascontiguousarray(words.T)
    near = rows["near"].to_numpy(copy=True)
    for one in _words(chosen["fp"]):
        np.minimum(near, _distances(turned, size, one), out=near)
    return _proposed(rows, near, int(chosen["most"].iloc[0]))


def _pick(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the rows proposed, those that are next in turn: as long as the farthest of them comes before every row that wasn't proposed. That holds for the first, at least."""
    pdf = pdf.sort_values(["id", "key"], ignore_index=True)
    words, near, at = _words(pdf["fp"]), pdf["near"].to_numpy(copy=True), np.arange(len(pdf))
    # Rows not proposed come after the last proposed row of their block, and choices only bring them nearer.
    ends = at[pdf["mark"].to_numpy() == 2]
    floor, last = (-np.inf, 0) if len(ends) == 0 else (near[ends].max(), int(ends[near[ends].argmax()]))
    size, turned, left, picked = _sizes(words), np.ascontiguousarray(words.T), int(pdf["left"].iloc[0]), []
    while len(picked) < left:
        i = int(near.argmax())
        if near[i] < max(floor, 0) or (near[i] == floor and at[i] > last):
            break
        picked.append(int(at[i]))
        near = np.minimum(near, _distances(turned, size, words[at[i]]))
        near[i] = -1
        if len(picked) % 64 == 0:
            # Rows nearer than the floor have no turn in this round.
            still = near >= max(floor, 0)
            if 0 < still.sum() < 0.7 * len(near):
                near, at, size, turned = near[still], at[still], size[still], np.ascontiguousarray(turned[:, still])
    return pdf.iloc[picked][["plan_id", "bucket", "key", "id", "fp"]].assign(place=(int(pdf["given"].iloc[0]) + np.arange(1, len(picked) + 1)).astype(np.int32))


def _in_rounds(rows: DataFrame) -> DataFrame:
    """``(plan_id, bucket, key, id, fp, place)``: what ``farthest_first`` chooses of each bucket of ``rows`` (plan_id, bucket, k, key, id, fp), found by all tasks together.

    A bucket is cut into blocks by hash. In each round every block proposes its farthest rows, one task makes the next choices among them, as many as are certain to come before all rows
    not proposed, and every block brings its distances up to date. A series of near copies that fills all proposals costs a round.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # As many rows as there are buckets, each of which holds at least four times PLACES on average.
    groups = {(r.plan_id, r.bucket): (r.k, r.held) for r in rows.groupBy("plan_id", "bucket").agg(F.max("k").alias("k"), F.count("*").alias("held")).collect()}
    cuts = []
    for (p, b), (_, held) in groups.items():
        blocks = max(-(-held // BLOCK), 2 * cores)
        cuts.append((p, b, blocks, max(16, -(-PROPOSED // blocks))))
    cut = spark.createDataFrame(cuts, f"{_GROUP}, blocks int, most int")
    parts = max(4 * cores, sum(c[2] for c in cuts) // 8)
    block = F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).cast("int").alias("block")
    held = rows.join(F.broadcast(cut), ["plan_id", "bucket"])
    state = held.select("plan_id", "bucket", block, "key", "id", "fp", F.lit(float("inf")).alias("near"), F.lit(0).alias("mark"))
    by, path = ["plan_id", "bucket", "block"], shared(spark, "chosen")

    def store(df: DataFrame, schema: str, where: str) -> DataFrame:
        df.write.parquet(where)
        return spark.read.schema(schema).parquet(where)

    def meet(state: DataFrame, news: DataFrame, f) -> DataFrame:
        """Each block with the ``news`` of its bucket."""
        news = news.join(F.broadcast(cut), ["plan_id", "bucket"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        # A stated number of partitions is left alone by adaptive execution.
        left, right = (df.repartition(parts, *by).groupBy(*by) for df in (state, news))
        return left.cogroup(right).applyInPandas(f, _STATE)

    kept = shared(spark, "state")
    state = store(state, _STATE, kept)
    everything = [g for g, (k, n) in groups.items() if n <= k]
    given = {g: 0 for g in groups if g not in set(everything)}
    found = []
    if everything:
        # Nothing to choose: places are handed out block by block.
        whole = state.join(F.broadcast(spark.createDataFrame(everything, _GROUP)), ["plan_id", "bucket"])
        before = F.sum("held").over(W.partitionBy("plan_id", "bucket").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
        sizes = whole.groupBy(*by).agg(F.count("*").alias("held")).withColumn("before", F.coalesce(before, F.lit(0)))
        place = (F.col("before") + F.row_number().over(W.partitionBy(*by).orderBy("id", "key"))).cast("int").alias("place")
        found.append(store(whole.join(F.broadcast(sizes), by).select("plan_id", "bucket", "key", "id", "fp", place), _CHOSEN, f"{path}/all"))
    def still(todo: DataFrame) -> DataFrame:
        return state.join(F.broadcast(todo), ["plan_id", "bucket"])

    def turn() -> DataFrame:
        left = [(*g, groups[g][0] - n if n else 1, n) for g, n in given.items()]
        return spark.createDataFrame(left, f"{_GROUP}, left int, given int")

    density = still(turn()).groupBy(*by).applyInPandas(_block_density, f"{_GROUP}, fp binary").groupBy("plan_id", "bucket").applyInPandas(_bucket_density, f"{_GROUP}, fp binary")
    news, f, number = store(density, f"{_GROUP}, fp binary", shared(spark, "density")), _first, 0
    while given:
        todo = turn()
        old, kept = kept, shared(spark, "state")
        state = store(meet(still(todo.select("plan_id", "bucket")), news, f), _STATE, kept)
        erase(spark, old)
        news = store(still(todo).filter("mark > 0").groupBy("plan_id", "bucket").applyInPandas(_pick, _CHOSEN), _CHOSEN, f"{path}/rounds/{number}")
        for r in news.groupBy("plan_id", "bucket").count().collect():
            given[r.plan_id, r.bucket] += r["count"]
        given = {g: n for g, n in given.items() if n < groups[g][0]}
        if number == 0:
            state = state.withColumn("near", F.lit(float("inf")))
        f, number = _next, number + 1
    erase(spark, kept)
    if number:
        found.append(spark.read.schema(_CHOSEN).option("recursiveFileLookup", True).parquet(f"{path}/rounds"))
    return reduce(DataFrame.unionByName, found)


def candidates(df: DataFrame, id_col: str = "mol_id", text_col: str = "smiles", source_col: str = "source") -> DataFrame:
    """``(id, source, text, fp)``: for every source one row per distinct valid structure, the one with the smallest id. Null ids are left out."""
    spark = df.sparkSession
    parts = F.array_join(F.sort_array(structure(F.col(text_col))), ".")
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), parts.alias("text")).filter("text is not null and id is not null")
    one = written(rows.groupBy("source", "text").agg(F.min("id").alias("id")), "structures")
    # A stated number of partitions is left alone, where adaptive execution would merge these small ones: the work is in the fingerprints, not in the bytes.
    parts = max(spark.sparkContext.defaultParallelism, -(-one.count() // TEXTS))
    texts = one.select("text").distinct().repartition(parts, "text")
    prints = written(texts.withColumn("fp", _fingerprint("text")).filter("fp is not null"), "prints")
    return one.join(prints, "text").select("id", "source", "text", "fp")


def varied_subsets(cand: DataFrame, plan: DataFrame) -> DataFrame:
    """``(plan_id, place, id)``: for each plan row (plan_id, source, subset_size; a null source means all) that many varied ids, in the order chosen.

    ``cand`` as ``candidates`` gives it. If a plan asks for more than there are distinct structures, all of them are chosen. Plans are a table of settings: more than 1000
    are refused; of several rows with one plan_id the largest counts. Plans without an id and those with a null or non-positive size choose nothing. Sizes have no bound: buckets and
    pools of a plan of more than PLACES places are chosen among in rounds, with the same result.
    """
    rows = [(r[0], r[1], r[2]) for r in plan.select("plan_id", "source", "subset_size").limit(1001).collect()]
    if len(rows) > 1000:
        raise ValueError("a subset plan holds at most 1000 plans")
    plans = list({p: (p, s, k) for p, s, k in sorted((r for r in rows if r[0] is not None and r[2] and r[2] > 0), key=lambda r: r[2])}.values())
    spark = cand.sparkSession
    if not plans:
        return spark.createDataFrame([], "plan_id int, place int, id bigint")
    # A plan is a constant of the query: each candidate is handed to the plans that want it, without a join.
    wants = F.array(*[F.struct(F.lit(s).cast("string").alias("source"), F.lit(p).cast("int").alias("plan_id")) for p, s, _ in plans])
    named = F.filter(wants, lambda w: w["source"] == F.col("source"))
    pool = cand.select("id", "fp", F.explode(F.transform(named, lambda w: w["plan_id"])).alias("plan_id"))
    general = [F.lit(p).cast("int") for p, s, _ in plans if s is None]
    if general:
        # Where all sources count, a structure stands once, with its smallest id.
        once = cand.groupBy("text").agg(F.min("id").alias("id"), F.first("fp").alias("fp"))
        pool = pool.unionAll(once.select("id", "fp", F.explode(F.array(*general)).alias("plan_id")))
    # Ids need not be unique; keys are, once written.
    pool = written(pool.select("plan_id", "id", "fp", F.monotonically_increasing_id().alias("key")), "pool")
    names, done = ["plan_id", "bucket", "key", "id", "fp"], []
    while True:
        # As many rows as there are plans.
        held = {r[0]: r[1] for r in pool.groupBy("plan_id").count().collect()}
        # Each bucket of several gives at most a quarter of what it holds on average, so the pools shrink.
        cut = [(p, k, max(1, -(-held[p] // max(BUCKET, 4 * k)))) for p, _, k in plans if p in held]
        table = F.broadcast(spark.createDataFrame(cut, "plan_id int, k int, buckets int"))
        bucket = F.pmod(F.xxhash64("id", "buckets"), F.col("buckets")).cast("int")
        placed = pool.join(table, "plan_id").withColumn("bucket", bucket)

        def chosen(last: bool) -> DataFrame | None:
            """What the plans choose whose last pool this is, or the other plans."""
            of = [k for _, k, n in cut if (n == 1) == last]
            rows, found = placed.filter("buckets = 1" if last else "buckets > 1"), []
            if any(k <= PLACES for k in of):
                small = rows.filter(F.col("k") <= PLACES).groupBy("plan_id", "bucket")
                found.append(small.applyInPandas(lambda pdf: _choose(pdf)[[*names, "place"]], _CHOSEN))
            if any(k > PLACES for k in of):
                found.append(_in_rounds(rows.filter(F.col("k") > PLACES).select("k", *names)))
            return reduce(DataFrame.unionByName, found) if found else None

        final, more = chosen(True), chosen(False)
        if final is not None:
            done.append(final.select("plan_id", "place", "id"))
        if more is None:
            break
        pool = written(more.select("plan_id", "id", "fp", "key"), "pool")
    return reduce(DataFrame.unionAll, done) if done else spark.createDataFrame([], "plan_id int, place int, id bigint")


def filled_subsets(chosen: DataFrame, plan: DataFrame, df: DataFrame, id_col: str = "mol_id", text_col: str = "smiles", source_col: str = "source") -> DataFrame:
    """``chosen`` (as ``varied_subsets`` gives it), and where a plan has more places than distinct structures, further rows of them from ``df``: evenly over the structures, in rounds by id."""
    spark = chosen.sparkSession
    chosen = written(chosen, "chosen")
    # At most as many rows as there are plans.
    given = {r[0]: r[1] for r in chosen.groupBy("plan_id").count().collect()}
    short = [(p, s, k, given[p]) for p, s, k in plan.select("plan_id", "source", "subset_size").collect() if p in given and k and k > given[p]]
    if not short:
        return chosen
    wants = spark.createDataFrame(short, "plan_id int, wanted_source string, size int, given int")
    parts = F.array_join(F.sort_array(structure(F.col(text_col))), ".")
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), parts.alias("text")).filter("text is not null and id is not null")
    rows = written(rows, "rows")
    heads = chosen.join(F.broadcast(wants), "plan_id").join(rows.select("id", "text"), "id").withColumnRenamed("id", "head")
    more = rows.join(heads, "text").filter((F.col("id") != F.col("head")) & (F.col("wanted_source").isNull() | (F.col("source") == F.col("wanted_source"))))
    # The structure's n-th further row comes in the n-th round.
    more = more.withColumn("round", F.row_number().over(W.partitionBy("plan_id", "head").orderBy("id"))).filter(F.col("round") <= F.col("size") - F.col("given"))
    more = more.withColumn("next", F.row_number().over(W.partitionBy("plan_id").orderBy("round", "place"))).filter(F.col("next") <= F.col("size") - F.col("given"))
    return chosen.unionByName(more.select("plan_id", (F.col("given") + F.col("next")).alias("place"), "id"))
