"""k-NN, context expansion and packing against brute force."""

import math
import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfspark.config import Settings
from shelfspark.functions import tokens as tok
from shelfspark.operators import context, knn, pack
from shelfspark.storage import fresh_path

VECTORS = "user_id string, kb_id string, file_id string, chunk_idx int, embedding array<float>"
QUERIES = "query_id string, user_id string, kb_ids array<string>, qvec array<float>"


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    users = ["hot"] * 300 + ["small"] * 20
    rows = [
        (u, f"kb{i % 3}", f"f{i // 10:03d}", i % 10, [float(x) for x in rng.normal(size=8)])
        for i, u in enumerate(users)
    ]
    rows += [(u, k, "twin", c, e) for (u, k, _, c, e) in rows[:5]]  # exact ties
    asked = [
        (f"q{i}", "hot" if i % 4 else "small", ["kb0", "kb1"], [float(x) for x in rng.normal(size=8)])
        for i in range(30)
    ]
    asked.append(("nobody", "absent", ["kb0"], [1.0] * 8))
    return rows, asked, spark.createDataFrame(rows, VECTORS), spark.createDataFrame(asked, QUERIES)


def brute(rows, asked, k, kbs=False):
    out = {}
    for qid, user, kb_ids, q in asked:
        scored = [
            (-round(float(np.dot(np.float32(q).astype(float), np.float32(e).astype(float))), 10), f, c)
            for u, kb, f, c, e in rows
            if u == user and (not kbs or kb in kb_ids)
        ]
        for rank, (ip, f, c) in enumerate(sorted(scored)[:k], 1):
            out[(qid, rank)] = (f, c, round(1 + ip, 9))
    return out


def as_dict(df):
    return {
        (r["query_id"], r["rank"]): (r["file_id"], r["chunk_idx"], round(r["dist"], 9))
        for r in df.collect()
    }


@pytest.mark.parametrize(
    "options", [{"plan": "scan"}, {"plan": "tile"}, {"plan": "tile", "query_tile": 3, "vector_tile": 11}]
)
def test_knn(points, options):
    rows, asked, vectors, queries = points
    assert as_dict(knn.knn(queries, vectors, 7, **options)) == brute(rows, asked, 7)


def test_knn_takes_tiles_when_queries_exceed_the_bound(points):
    rows, asked, vectors, queries = points
    assert as_dict(knn.knn(queries, vectors, 3, query_bytes=500)) == brute(rows, asked, 3)
    with pytest.raises(ValueError):
        knn.knn(queries, vectors, 3, plan="scan", query_bytes=500)


@pytest.mark.parametrize("block_rows", [1, 16, 4096])
def test_knn_blocks(points, block_rows):
    rows, asked, vectors, queries = points
    pivots = knn.choose_pivots(vectors, 5)
    blocks = knn.pack_blocks(vectors, pivots, block_rows)
    assert blocks.agg(F.sum("n")).head()[0] == len(rows)
    assert as_dict(knn.knn_blocks(queries, blocks, pivots, 7)) == brute(rows, asked, 7)
    no_pivots = np.zeros((0, 8))
    plain = knn.pack_blocks(vectors, no_pivots, block_rows)
    assert as_dict(knn.knn_blocks(queries, plain, no_pivots, 7)) == brute(rows, asked, 7)


def test_bounds_hold(points):
    rows, _, _, _ = points
    rng = np.random.default_rng(1)
    block = np.array([r[4] for r in rows[:50]]) * rng.uniform(0.1, 3, (50, 1))
    queries = rng.normal(size=(40, 8))
    pivots = np.linalg.qr(rng.normal(size=(8, 8)))[0][:3]
    along = block @ pivots.T
    norm = np.linalg.norm(block, axis=1)
    zone = {
        "max_norm": norm.max(), "low": along.min(0), "high": along.max(0),
        "rest": np.sqrt(norm[:, None] ** 2 - along**2).max(0),
    }
    assert (knn.upper_bounds(queries, pivots, zone) >= (queries @ block.T).max(1)).all()


def test_blocks_are_skipped(spark):
    """Vectors in far corners and of falling length: most blocks are never scored."""
    rng = np.random.default_rng(3)
    corners = np.eye(8)
    rows = [
        ("hot", "kb", f"f{i:05d}", 0, [float(x) for x in (corners[i % 8] + rng.normal(size=8) * 0.05) * (1 + i % 50)])
        for i in range(4000)
    ]
    asked = [(f"q{i}", "hot", ["kb"], [float(x) for x in corners[i % 8]]) for i in range(16)]
    vectors = spark.createDataFrame(rows, VECTORS)
    queries = spark.createDataFrame(asked, QUERIES)
    pivots = knn.choose_pivots(vectors, 8)
    path = fresh_path(spark, "test-blocks")
    knn.pack_blocks(vectors, pivots, 50).write.parquet(path)
    blocks = spark.read.parquet(path)
    skipped = spark.sparkContext.accumulator(0)
    got = as_dict(knn.knn_blocks(queries, blocks, pivots, 5, skipped=skipped))
    assert got == brute(rows, asked, 5)
    pairs = blocks.count() * len(asked)
    assert pairs >= 80 * len(asked) and 0.9 * pairs <= skipped.value < pairs


@pytest.mark.parametrize("k,batch", [(1, 3), (5, 7), (50, 10)])
def test_best_keeps_the_first_of_equal_scores(k, batch):
    """Heaps fed in batches, with many equal vectors, next to one sort."""
    import pyarrow as pa

    rng = np.random.default_rng(k)
    points = rng.integers(-1, 2, size=(200, 3)).astype(float)
    queries = rng.integers(-2, 3, size=(9, 3)).astype(float)
    files, chunks = [f"f{i % 37}" for i in range(200)], [i // 37 for i in range(200)]
    best = knn.Best(queries, k)
    for at in range(0, 200, batch):
        names = pa.table({"file_id": files[at : at + batch], "chunk_idx": pa.array(chunks[at : at + batch], pa.int32())})
        best.add(names, points[at : at + batch])
    hits = best.hits(np.array([f"q{i}" for i in range(9)], object), "u").to_pylist()
    for i, q in enumerate(queries):
        want = sorted(zip(-(points @ q), files, chunks))[:k]
        got = sorted((-h["ip"], h["file_id"], h["chunk_idx"]) for h in hits if h["query_id"] == f"q{i}")
        assert got == want


def test_merging_in_parts_changes_nothing(points):
    rows, asked, vectors, queries = points
    assert as_dict(knn.knn(queries, vectors, 7, merge=4)) == brute(rows, asked, 7)


def test_knn_within_kbs_reads_only_the_bases_asked_for(spark, points):
    _, _, vectors, queries = points
    path = fresh_path(spark, "test-bases")
    vectors.write.partitionBy("kb_id").parquet(path)
    df = knn.knn_within_kbs(queries, spark.read.parquet(path), 4)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "IN (kb0,kb1)" in plan


def test_knn_within_kbs(points):
    rows, asked, vectors, queries = points
    assert as_dict(knn.knn_within_kbs(queries, vectors, 4)) == brute(rows, asked, 4, kbs=True)


def test_distance_fallback(spark):
    hits = spark.createDataFrame(
        [("a", 0.2), ("a", 1.1), ("a", 1.2), ("b", 1.5), ("b", 1.3)], "query_id string, dist double"
    )
    kept = sorted(tuple(r) for r in knn.within_distance(hits, 1.1).collect())
    assert kept == [("a", 0.2), ("a", 1.1), ("b", 1.3), ("b", 1.5)]


def walk(sizes, centre, budget, window):
    kept, total = {centre}, sizes[centre]
    for k in range(1, window):
        for at in (centre + k, centre - k):
            if at in sizes:
                if total + sizes[at] > budget:
                    return kept
                total += sizes[at]
                kept.add(at)
    return kept


def test_reach(spark):
    rng = random.Random(3)
    sizes = {("e", i): 1 for i in range(500)}
    sizes |= {("g", i): s for i, s in enumerate([0, 1, 799, 800, 801, 0, 0, 5])}
    sizes |= {("r", i): rng.choice([0, 3, 90, 400]) for i in range(120) if i % 11}
    df = spark.createDataFrame(
        [(f, i, s) for (f, i), s in sizes.items()], "file_id string, chunk_idx int, size int"
    )
    centres = [("e", i) for i in (0, 199, 200, 499)] + [k for k in sizes if k[0] in "gr"]
    asked = spark.createDataFrame(centres, "file_id string, chunk_idx int")
    got = {}
    for r in context.reach(asked, df).collect():
        got.setdefault((r["file_id"], r["chunk_idx"]), set()).add(r["idx"])
    for f, c in centres:
        own = {i: s for (g, i), s in sizes.items() if g == f}
        assert got[(f, c)] == walk(own, c, 800, 200), (f, c)


def chunk_rows(spark, files):
    rows = [("u", "k", f, n, i, f"{f}_{i}", t) for (f, n), ts in files.items() for i, t in ts]
    return spark.createDataFrame(
        rows,
        "user_id string, kb_id string, file_id string, file_name string, chunk_idx int, "
        "chunk_id string, content string",
    )


HITS = "query_id string, file_id string, chunk_idx int, dist double, rank int"


def test_contexts_runs_and_scores(spark):
    chunks = chunk_rows(
        spark,
        {
            ("f1", "a.txt"): [(i, f"t{i}") for i in (1, 2, 3, 5, 6)],
            ("f2", "b.CSV"): [(0, "row"), (1, "row2")],
            ("f3", "c.md"): [(i, "x" * 500) for i in range(4)],
        },
    )
    hits = spark.createDataFrame(
        [("q", "f1", 2, 0.5, 1), ("q", "f2", 0, 0.25, 2), ("q", "f2", 1, 0.3, 3),
         ("q", "f3", 1, 0.2, 4), ("q", "f3", 2, 0.7, 5), ("q", "gone", 0, 0.1, 6)],
        HITS,
    )
    rows = context.contexts(hits, chunks).collect()
    got = {(r["file_id"], r["run_start"]): r for r in rows}
    assert set(got) == {("f1", 1), ("f1", 5), ("f2", 0), ("f2", 1), ("f3", 1)}
    assert got[("f1", 1)]["content"] == "t1 t2 t3" and got[("f1", 1)]["kernel"] == "t2"
    assert got[("f1", 1)]["score"] == 0.5
    assert got[("f1", 5)]["score"] == round(1 - math.sqrt(2), 4) and got[("f1", 5)]["kernel"] == ""
    assert got[("f2", 0)]["score"] == 0.75 and got[("f2", 0)]["kernel"] == "row"
    assert got[("f3", 1)]["score"] == 0.8 and got[("f3", 1)]["run_end"] == 2
    ordered = context.in_order(context.deduplicate(context.contexts(hits, chunks)))
    order = [(r["file_id"], r["run_start"]) for r in ordered.orderBy("position").collect()]
    assert order == [("f3", 1), ("f2", 0), ("f2", 1), ("f1", 1), ("f1", 5)]


def test_runs(spark):
    df = spark.createDataFrame([("f", i) for i in (1, 2, 3, 5, 6)], "file_id string, i int")
    runs = {r["i"]: r["run_start"] for r in context.with_runs(df, ["file_id"], "i").collect()}
    assert runs == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}


def ordered_rows(spark, rows):
    return spark.createDataFrame(
        rows, "query_id string, file_id string, run_start int, content string, score double, position int"
    )


def asked(spark, questions, history=()):
    return spark.createDataFrame(
        [(f"q{i}", q, list(history)) for i, q in enumerate(questions)],
        "query_id string, question string, history array<struct<q:string,a:string>>",
    )


def pack_model(contents, budget, step=50):
    out, total = [], 0
    for body in contents:
        size = len(body) // 4
        if total + size <= budget:
            out.append(body)
            total += size
            continue
        while len(body) // 4 + 3 > budget - total:
            if len(body) <= 2 * step:
                body = ""
                break
            body = body[step:-step]
        out.append(body)
        break
    return out


@pytest.mark.parametrize("window", [20, 150, 400, 402, 404, 600, 900])
def test_pack_tokens(spark, window):
    cfg = replace(Settings(), token_window=window, prompt_template="{context}{question}")
    rng = random.Random(window)
    bodies = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in (0, 90, 333, 101, 400, 77)]
    question = "why?" * 3
    queries = asked(spark, [question], [("hi there", "hello you")])
    rows = ordered_rows(spark, [("q0", "f", i, b, 0.5, i) for i, b in enumerate(bodies)])
    got = [r["content"] for r in pack.pack_tokens(rows, queries, cfg).orderBy("position").collect()]
    budget = (
        window - window // 2 - 50 - (len(question) // 4 + 3) - (2 + 2 + 3) - (len(cfg.prompt_template) // 4 + 3)
    )
    assert got == pack_model(bodies, budget)
    same = pack.pack_tokens(rows, queries, cfg, measure=lambda t: len(t) // 4)
    assert [r["content"] for r in same.orderBy("position").collect()] == got


def test_gate_prompt_and_nan(spark):
    cfg = replace(Settings(), min_mean_score=0.65, prompt_template="C:{context}|Q:{question}")
    queries = asked(spark, ["is {context} filled", "cold", "none"])
    rows = ordered_rows(
        spark,
        [("q0", "f", 0, "one", 0.9, 1), ("q0", "f", 1, "two", 0.5, 2), ("q1", "f", 0, "x", 0.1, 1),
         ("q0", "f", 2, "nan", float("nan"), 3)],
    )
    out = {r["query_id"]: r for r in pack.build_prompts(pack.drop_nan(rows), queries, cfg).collect()}
    assert out["q0"]["prompt"] == "C:one\ntwo|Q:is one\ntwo filled" and out["q0"]["n_sources"] == 2
    assert out["q1"]["prompt"] == "cold" and not out["q1"]["grounded"]
    assert out["q2"]["mean_score"] == 0.0 and out["q2"]["prompt"] == "none"


def test_rerank_conditions(spark):
    queries = asked(spark, ["short", "l" * 301, "single", "failing"])
    rows = [("q0", "f", 0, "a", 0.9, 1), ("q0", "f", 1, "b", 0.8, 2), ("q1", "f", 0, "a", 0.9, 1),
            ("q1", "f", 1, "b", 0.8, 2), ("q2", "f", 0, "a", 0.9, 1), ("q3", "f", 0, "a", 0.9, 1),
            ("q3", "f", 1, "b", 0.8, 2)]
    ordered = ordered_rows(spark, rows)
    scored = ordered.select(
        "query_id", "file_id", "run_start",
        F.when((F.col("query_id") == "q3") & (F.col("run_start") == 1), None)
        .otherwise(F.col("run_start") * 1.0).alias("rerank_score"),
    )
    out = context.rerank(ordered, queries, scored).collect()
    got = {(r["query_id"], r["run_start"]): (r["score"], r["position"]) for r in out}
    assert got[("q0", 1)] == (1.0, 1) and got[("q0", 0)] == (0.0, 2)
    for other in ("q1", "q3"):
        assert got[(other, 0)] == (0.9, 1) and got[(other, 1)] == (0.8, 2)
    assert got[("q2", 0)] == (0.9, 1)
    assert context.rerank(ordered, queries, None) is ordered


def test_group_sources_keeps_unnamed_apart(spark):
    rows = ordered_rows(spark, [("q", f, i, "c", 0.5, i) for i, f in enumerate("abcde")]).withColumn(
        "file_name", F.when(F.col("position").isin(1, 3), "same").when(F.col("position") == 0, "")
    )
    groups = context.group_sources(rows).orderBy("group_no").collect()
    assert [(g["file_name"], len(g["chunks"])) for g in groups] == [
        ("", 1), ("same", 2), ("", 1), ("", 1)
    ]


def test_messages_and_next_history(spark):
    queries = asked(spark, ["now"], [("q1", "a1"), ("q2", "a2")])
    row = queries.select(
        tok.chat_messages(F.col("question"), F.col("history")).alias("m"),
        tok.next_history(F.col("history"), F.col("question"), F.lit("ans")).alias("h"),
    ).head()
    assert [m["role"] for m in row["m"]] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert [tuple(p) for p in row["h"]] == [("q1", "a1"), ("now", "ans")]


def test_scan_reads_only_the_users_who_ask(spark, points):
    rows, asked, vectors, queries = points
    path = fresh_path(spark, "vectors")
    vectors.write.partitionBy("user_id").parquet(path)
    small = queries.where("user_id = 'small'")
    df = knn.knn(small, spark.read.parquet(path), 3, plan="scan")
    plan = df._jdf.queryExecution().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "user_id" in filters and "small" in filters
    want = brute(rows, [a for a in asked if a[1] == "small"], 3)
    assert as_dict(df) == want


def test_hot_users_are_many_tiles(points):
    rows, asked, vectors, queries = points
    scored = knn.score(queries, vectors, 2, plan="tile", query_tile=5, vector_tile=30)
    per_query = scored.groupBy("query_id").count().agg(F.max("count")).head()[0]
    assert 2 < per_query <= 2 * math.ceil(305 / 30)


def test_small_tiles_do_not_multiply_copies(points):
    """Tiles of one row: only as many cells are made as the cores need, not one a pair."""
    rows, asked, vectors, queries = points
    scored = knn.score(queries, vectors, 2, plan="tile", query_tile=1, vector_tile=1)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    per_query = scored.groupBy("query_id").count().agg(F.max("count")).head()[0]
    assert per_query <= 2 * knn.CELLS * cores < 305
    assert as_dict(knn.rank_hits(scored, 2)) == brute(rows, asked, 2)


def test_pairs_of_a_cell_are_bounded_however_large_the_tables(spark, points, monkeypatch):
    monkeypatch.setattr(knn, "CELL_PAIRS", 100_000)
    user = F.when(F.col("id") % 10 == 0, "other").otherwise("hot").alias("user_id")
    for asked, stored in ((1000, 20_000), (2000, 40_000)):
        queries = spark.range(asked).select(user, F.array(F.lit(0.0), F.lit(1.0)).alias("qvec"))
        plan, parts = knn._plan(queries, spark.range(stored).select(user), 5, 100, 100)
        tiles = {r["user_id"]: (r["_qn"], r["_vn"]) for r in plan.collect()}
        for name, share in (("hot", 0.9), ("other", 0.1)):
            q, v = tiles[name]
            assert -(-asked * share // q) * -(-stored * share // v) <= 1.1 * knn.CELL_PAIRS
        assert parts == sum(q * v for q, v in tiles.values())
    rows, given, vectors, queries = points
    monkeypatch.setattr(knn, "CELL_PAIRS", 50)
    found = knn.knn(queries, vectors, 3, plan="tile", query_tile=2, vector_tile=5)
    assert as_dict(found) == brute(rows, given, 3)


def test_hits_travel_packed(points):
    """A row per query and cell, whose hits are merged in order, also those that tie."""
    rows, asked, vectors, queries = points
    packed = knn.score(queries, vectors, 40, plan="tile", query_tile=8, vector_tile=50, packed=True)
    got = packed.select("query_id", F.size("ips").alias("n")).collect()
    assert len(got) < sum(r["n"] for r in got) / 10 and max(r["n"] for r in got) == 40
    assert as_dict(knn.rank_packed(packed.repartition(7), 40)) == brute(rows, asked, 40)
    twice = packed.withColumn("query_id", F.when(F.col("query_id") != "q1", F.col("query_id")))
    ranked = knn.rank_packed(twice, 3).where("query_id is null").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3] and ranked[0]["dist"] <= ranked[1]["dist"] <= ranked[2]["dist"]


def test_many_hits_make_fewer_cells(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_PAIRS", 100_000)
    monkeypatch.setattr(knn, "CELL_ROWS", 1000)
    queries = spark.range(2000).select(F.lit("u").alias("user_id"), F.array(F.lit(0.0)).alias("qvec"))
    vectors = spark.range(40_000).select(F.lit("u").alias("user_id"))

    def tiles(k):
        return knn._plan(queries, vectors, k, 10, 10)[0].select("_qn", "_vn").head()

    (q5, v5), (q100, v100) = tiles(5), tiles(100)
    assert q100 * v100 < q5 * v5 / 3 and -(-2000 // q100) * -(-40_000 // v100) <= 4.4 * knn.CELL_PAIRS


def test_scan_is_left_when_its_hits_would_be_many(points, monkeypatch):
    rows, asked, vectors, queries = points
    monkeypatch.setattr(knn, "SCAN_HITS", 20)
    scans = []
    monkeypatch.setattr(knn, "_scan", lambda *given: scans.append(given))
    assert as_dict(knn.knn(queries, vectors, 7)) == brute(rows, asked, 7)
    assert not scans


def test_single_precision_loses_no_hit(spark):
    """Vectors that differ beyond single precision's error, many copies, and lengths too large for it."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    near = base + rng.normal(size=(3000, 16)) * 1e-7
    for points in (near, np.repeat(near[:3], 1000, axis=0), rng.normal(size=(3000, 16)) * 1e25):
        queries = np.concatenate([base[None], rng.normal(size=(4, 16))])
        order = rng.permutation(3000)
        names = pa.table({"file_id": [f"f{i:04d}" for i in order], "chunk_idx": pa.array([0] * 3000, pa.int32())})
        best = knn.Best(queries, 7)
        for at in range(0, 3000, 500):
            best.feed(names.slice(at, 500), points[at : at + 500])
        hits = best.hits(np.array([f"q{i}" for i in range(5)], object), "u").to_pylist()
        scores = np.round(np.array([[np.einsum("i,i", q, p) for p in points] for q in queries]), 10)
        for i, own in enumerate(scores):
            want = sorted(zip(-own, (f"f{i:04d}" for i in order)))[:7]
            got = sorted((-h["ip"], h["file_id"]) for h in hits if h["query_id"] == f"q{i}")
            assert [n for _, n in got] == [n for _, n in want]
            assert np.allclose([s for s, _ in got], [s for s, _ in want], rtol=1e-12, atol=2e-10)


def test_blocks_of_a_search_grow_with_k():
    """Few hits are found in blocks of few vectors, many in large ones; both are exact."""
    pick = np.random.default_rng(3)
    asked, stored = pick.standard_normal((300, 8)), pick.standard_normal((9000, 8))
    names = pa.table({"file_id": [f"{i:05d}" for i in range(9000)], "chunk_idx": pa.array([0] * 9000, pa.int32())})
    few, many = knn.Best(asked, 5), knn.Best(asked, 200)
    assert few.batch == knn.Best.LEAST and many.batch == knn.Best.BATCH
    want = np.round(-np.sort(-(asked @ stored.T), axis=1), knn.SCORE_DECIMALS)
    for best in (few, many):
        best.add(names, stored)
        assert best.scores == pytest.approx(want[:, : best.k], abs=2e-10)
