"""Stored tables, indexes and keyed state: equal to the scans and folds they stand for, and reading little of what is stored."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomfield.operators import dataflow, field, graph, postings, retrieval, sketches, standing, vector_index
from loomfield.sources import buckets, generate, tables
from loomfield.streaming import events, state
from test_field import by_hand, small


@pytest.fixture
def path(spark, request):
    return tables.scratch(spark, f"test-{request.node.name[:20]}")


def same_rows(a, b):
    rows = lambda df: Counter(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
    assert rows(a) == rows(b)


# Buckets


def test_buckets_answer_for_keys(spark, path):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("key"), F.col("id").alias("n"), F.array("id").alias("a"))
    held = buckets.create(rows, "key", path, per_bucket=200)
    assert held.buckets == 25
    for keys in (["hot"], ["k1", "k5", "none"], [], [f"k{i}" for i in range(400)] * 4):
        asked = spark.createDataFrame([(k,) for k in keys] + [(None,)], "wanted string")
        same_rows(held.of(asked), rows.where(F.col("key").isin(keys)))
    more = held.append(spark.createDataFrame([("k1", -1, [0])], "key string, n bigint, a array<bigint>"))
    assert {r["n"] for r in more.of(spark.createDataFrame([("k1",)], "k string")).collect()} >= {-1, 1, 401}
    assert buckets.opened(spark, path) == more and -1 not in {r["n"] for r in held.rows.collect()}  # an earlier reader keeps what it had
    one = more.replaced(more.rows.drop("bucket").where("n < 10"))
    assert one.rows.count() == buckets.opened(spark, path).rows.count() and len(one.segments) == 1


def test_many_keys_join_their_buckets(spark, path, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("n"))
    held = buckets.create(rows, "key", path, per_bucket=100)
    for named in (10_000, 5):
        monkeypatch.setattr(buckets, "NAMED", named)
        same_rows(held.of(spark.range(1500)), rows.where("key < 1500"))


def test_a_key_opens_as_few_files_however_large_the_table(spark, path):
    asked, opened = spark.createDataFrame([("load-0000000007",)], "id string"), []
    for n in (2000, 4000, 8000):
        walk = graph.ends(generate.load_edges(spark, n), "id")
        held = buckets.create(walk, "node", f"{path}/{n}", per_bucket=500)
        same_rows(held.of(asked), walk.where("node = 'load-0000000007'"))
        size = held.files(asked).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")).first()
        opened.append((size["files"], size["bytes"]))
    assert max(f for f, _ in opened) <= 2 and max(b for _, b in opened) < 3 * min(b for _, b in opened)


# Vector index


def nearest_ids(found):
    return {(r["query_id"], r["id"], r["rank"]) for r in found.select("query_id", "id", "rank").collect()}


def test_probing_all_cells_is_exact(spark, path):
    rng = random.Random(2)
    vec = lambda i: [rng.gauss(3 * math.cos(i % 7 + j), 1) for j in range(13)]
    rows = [(i, vec(i) if i % 11 else None if i % 2 else [0.0] * 13, f"t{i % 3}" if i % 10 else "paper") for i in range(600)]
    rows += [(1000 + i, rows[4][1], "t1") for i in range(5)]  # ties
    df = spark.createDataFrame(rows, "id bigint, vector array<double>, type string")
    asked = df.where("id % 60 = 4").withColumn("query_id", F.col("id").cast("string")).drop("id")
    index = vector_index.create(df, path, cells=9, parts=4)
    want = nearest_ids(retrieval.nearest(asked, df.select("id", "vector"), 10))
    assert nearest_ids(index.search(asked.drop("type"), 10, probes=9, rerank=None)) == want
    assert nearest_ids(index.search(asked.drop("type"), 10, probes=9, rerank=100, block=3)) == want
    # candidates are compared where they lie, none travels to meet its vector
    assert "Join" not in index.search(asked.drop("type"), 10, probes=9, rerank=2)._jdf.queryExecution().executedPlan().toString()
    assert nearest_ids(vector_index.opened(spark, path).search(asked.drop("type"), 10, 9, None, where=F.col("id") < 300)) == nearest_ids(retrieval.nearest(asked, df.where("id < 300").select("id", "vector"), 10))
    fit = df.select("id", F.col("type").alias("own"))
    typed = index.search(asked, 10, 9, None).join(fit, "id").join(asked.select("query_id", "type"), "query_id")
    assert typed.where("own <> type and own <> 'paper' and type <> 'paper'").count() == 0 and typed.count() == 10 * asked.count()
    more = index.insert(spark.createDataFrame([(5000, rows[64][1], "t2")], df.schema))
    assert {r["id"] for r in more.search(asked.where("query_id = '64'").drop("type"), 2, 1, 40).collect()} == {64, 5000}


def test_index_of_odd_tables(spark, path):
    empty = spark.createDataFrame([], "id string, vector array<float>")
    one = spark.createDataFrame([("a", [1.0, 2.0])], "id string, vector array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    assert [r["id"] for r in vector_index.create(one, f"{path}/one").search(asked, 3).collect()] == ["a"]
    assert vector_index.create(one, f"{path}/two").search(asked.limit(0), 3).collect() == []
    assert vector_index.recall(empty.select(F.lit("q").alias("query_id"), "id"), empty.select(F.lit("q").alias("query_id"), "id")) == 1.0


def test_recall_and_files_of_a_generated_graph(spark, path):
    n, asked_n = 20_000, 40
    _, vectors = generate.load_nodes(spark, n)
    vectors = tables.staged(vectors, "generated")
    asked = vectors.orderBy(F.xxhash64("id")).limit(asked_n).select(F.col("id").alias("query_id"), F.transform("vector", lambda x, i: x + F.sin(i * 7.0) / 16).alias("vector"))
    asked = tables.staged(asked, "generated-asked")
    index = vector_index.create(vectors, path, cells=64)
    exact = tables.staged(retrieval.nearest(asked, vectors, 10), "generated-exact")
    few, many = (vector_index.recall(index.search(asked, 10, probes, 40), exact) for probes in (8, 48))
    assert many >= 0.95 and many > few  # vectors without any structure need most of the cells; the codes alone are read there
    assert index.files(asked.first()["vector"], 8).count() <= 3 * 8


# Postings


def texts(rng, n):
    common = ["the", "river", "stone", "running", "runs"]
    return [(f"d{i}", " ".join(rng.choices(common, k=rng.randrange(0, 30)) + [f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 40))]) if i % 50 else [None, "", "..."][i // 50 % 3]) for i in range(n)]


@pytest.mark.parametrize("stemmed", [False, True])
def test_postings_rank_as_the_scan(spark, path, stemmed, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    rows = texts(random.Random(6), 900)
    docs = spark.createDataFrame(rows, "id string, text string")
    questions = {"a": "river stone", "b": "the w1", "c": "run w2 w3", "d": "", "e": "absent river", "f": "w7", "g": "River river RUNS"}
    asked = spark.createDataFrame(list(questions.items()), "query_id string, text string")
    want = retrieval.lexical(docs, "id", "text", questions, stemmed).withColumn("score", F.round("score", 12)).cache()
    whole = postings.create(docs, "id", "text", f"{path}/whole", stemmed, per_bucket=50)
    parts = postings.create(docs.where("id < 'd3'"), "id", "text", f"{path}/parts", stemmed, per_bucket=50).append(docs.where("id >= 'd3' and id < 'd7'"), "id", "text").append(docs.where("id >= 'd7'"), "id", "text")
    best = want.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("place <= 4").drop("place")
    for index in (whole, parts, parts.merged(), postings.opened(spark, f"{path}/parts", stemmed)):
        same_rows(index.search(asked), want)
        same_rows(index.search(asked, 4), best)


def test_blocks_that_cannot_count_are_not_opened(spark, path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    rows = [(f"d{i}", "rare " * (30 if i % 100 == 0 else 1) + "filler " * 40) for i in range(2000)]
    index = postings.create(spark.createDataFrame(rows, "id string, text string"), "id", "text", path, False, per_bucket=100)
    opened, all_ = index.opened(spark.createDataFrame([("q", "rare filler")], "query_id string, text string"), 5)
    assert opened < all_ / 4


# A domain at rest


@pytest.mark.parametrize("options", [field.Options(seeds=3, top_nodes=5, evidence=6, chars=70), field.Options(seeds=2, hops=2, nodes=9, candidates=20)])
def test_standing_retrieval_by_hand(spark, path, options):
    store, nodes, edges, vectors, props, asked = small(spark)
    held = standing.create(store, path, per_bucket=10, cells=4, probes=4, rerank=None)
    questions = spark.createDataFrame(asked, "query_id string, text string, vector array<double>")
    want = by_hand(nodes, edges, vectors, props, asked, options)
    for own in (held, standing.opened(spark, path, probes=4, rerank=None)):
        got = field.retrieve(own, questions, options=options)
        evidence, stats = {}, {r["query_id"]: r for r in got.stats.collect()}
        for r in got.evidence.orderBy("query_id", "place").collect():
            evidence.setdefault(r["query_id"], []).append(r["id"])
        for q, (taken, seen, kept, fused) in want.items():
            assert (evidence.get(q, []), stats[q]["subgraph_nodes"], stats[q]["subgraph_edges"], stats[q]["candidates"]) == (taken, seen, kept, fused)


# Keyed state


def log_of(df):
    return df.select("job", F.timestamp_seconds("at").alias("ts"), "at", "kind", "owner")


def leases_by_hand(rows, until):
    """How each job stands, event after event."""
    jobs = {}
    for job, at, kind, owner in sorted(rows, key=lambda r: r[1]):
        j = jobs.setdefault(job, None)
        if j and j["status"] == "running" and j["lease"] < at:
            j.update(status="queued" if j["claims"] < dataflow.MAX_CLAIMS else "failed", owner=None)
        if kind == "enqueue" and (j is None or j["status"] in ("completed", "failed")):
            jobs[job] = {"status": "queued", "owner": None, "claims": 0, "failures": 0}
        elif j and kind == "claim" and j["status"] == "queued":
            j.update(status="running", owner=owner, lease=at + dataflow.LEASE, claims=j["claims"] + 1)
        elif j and j["status"] == "running" and j["owner"] == owner:
            if kind == "heartbeat":
                j["lease"] = at + dataflow.LEASE
            elif kind == "complete":
                j.update(status="completed", owner=None)
            elif kind in ("fail", "permanent"):
                j["failures"] += 1
                j.update(status="failed" if kind == "permanent" or j["failures"] >= dataflow.MAX_FAILURES else "queued", owner=None)
    for j in jobs.values():
        if j and j["status"] == "running" and j["lease"] < until:
            j.update(status="queued" if j["claims"] < dataflow.MAX_CLAIMS else "failed", owner=None)
    return {k: (j["status"], j["owner"], j["claims"], j["failures"]) for k, j in jobs.items() if j}


def test_leases_by_stream_by_table_and_by_hand_over_a_restart(spark, path):
    rng = random.Random(12)
    kinds = ["enqueue", "claim", "claim", "claim", "heartbeat", "complete", "fail", "permanent"]
    rows = [(f"j{rng.randrange(12)}", 1.7e9 + 10 * i + rng.randrange(9), rng.choices(kinds, [4, 6, 6, 6, 6, 1, 2, 0.3])[0], f"w{rng.randrange(2)}") for i in range(1500)]
    rows += [("spent", 1.7e9 + 15005 + 200 * i, "claim" if i else "enqueue", "w") for i in range(30)] + [("late", 1.7e9 + 21100, "enqueue", "w"), ("late", 1.7e9 + 21101, "claim", "w"), ("end", 1.7e9 + 30000, "enqueue", "w")]
    schema, until = "job string, at double, kind string, owner string", 1.7e9 + 30000 - 60
    want = leases_by_hand(rows, until)
    assert {s for s, *_ in want.values()} >= {"queued", "failed"} and want["spent"][2] == dataflow.MAX_CLAIMS and want["late"][0] == "queued"
    folded = state.folded(spark.createDataFrame(rows, schema).repartition(4), until)
    stand = lambda df: {r["job"]: (r["status"], r["owner"], r["claims"], r["failures"]) for r in state.latest(df).collect()}
    assert stand(folded) == want
    ordered = sorted(rows, key=lambda r: r[1])
    for i, part in enumerate((ordered[:600], ordered[600:1100], ordered[1100:])):  # the stream ends and starts again in between
        log_of(spark.createDataFrame(part, schema)).coalesce(1).write.mode("append").parquet(f"{path}/log")
        stream = spark.readStream.schema("job string, ts timestamp, at double, kind string, owner string").option("maxFilesPerTrigger", 1).parquet(f"{path}/log")
        found = state.run(state.lease_changes(stream), "leases", f"{path}/run")
    assert stand(found) == want
    same_rows(found, folded)


def test_rate_windows_of_a_stream_equal_the_fold(spark, path):
    rng = random.Random(3)
    rows = [(i, f"k{rng.randrange(5)}", 1.7e9 + 7.0 * i) for i in range(600)]
    for part in (rows[:250], rows[250:]):
        spark.createDataFrame(part, "event_id bigint, k string, at double").withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(f"{path}/log")
        stream = spark.readStream.schema("event_id bigint, k string, at double, ts timestamp").parquet(f"{path}/log")
        found = state.run(state.rate_windows(stream, "k", 120, 3), "rates", f"{path}/run")
    want = dataflow.anchored_windows(spark.read.parquet(f"{path}/log"), "k", F.col("at"), 120, 3)
    same_rows(found.select("event_id", "window_start", "place", "allowed", "remaining", "reset"), want.select("event_id", "window_start", "place", "allowed", "remaining", "reset"))


def test_a_scope_deletes_its_own_tables_only(spark):
    before = tables.staged(spark.range(3), "outer")
    with tables.scope(spark) as own:
        kept, gone = tables.staged(spark.range(4), "gone"), tables.staged(spark.range(5), "kept")
        inner = [tables.staged(spark.range(2), "inner")]
        own.forget(but=2)
    assert (before.count(), gone.count(), inner[0].count()) == (3, 5, 2)
    with pytest.raises(Exception):
        kept.count()


def test_streams_of_events_stay_readable(spark, path):
    spark.createDataFrame([(1, "a")], "n bigint, k string").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("n bigint, k string").parquet(f"{path}/in")
    assert events.run_to_end(stream, "plain").count() == 1


def test_percentiles_of_merged_sketches(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 4}", i % 30, rng.choice([rng.gauss(0, 1), rng.expovariate(0.1), 5.0]) if i % 50 else None) for i in range(30_000)] + [("none", 1, None), ("one", 1, 2.5)]
    df = spark.createDataFrame(rows, "key string, day int, value double").repartition(7)
    days = sketches.sketched(df, "key", "day", value="value")
    got = {r["key"]: r for r in sketches.merged(days, "key").select("key", "n", *[sketches.percentile(p).alias(f"p{i}") for i, p in enumerate((0, 0.25, 0.5, 0.95, 1))]).collect()}
    assert set(got) == {"hot", "k0", "k1", "k2", "k3", "one"} and got["one"]["p2"] == 2.5
    for key, r in got.items():
        held = sorted(v for k, _, v in rows if k == key and v is not None)
        assert r["n"] == len(held) and (r["p0"], r["p4"]) == (held[0], held[-1])
        for i, p in ((1, 0.25), (2, 0.5), (3, 0.95)):
            low, high = sum(v < r[f"p{i}"] for v in held) / len(held), sum(v <= r[f"p{i}"] for v in held) / len(held)
            assert low - 2 * sketches.rank_error() <= p <= high + 2 * sketches.rank_error()
    part = sketches.merged(days.where("day < 10"), "key").where("key = 'hot'").first()  # any range of buckets
    assert part["n"] == sum(k == "hot" and d < 10 and v is not None for k, d, v in rows)


def test_hubs_read_their_edges_once(spark):
    from loomfield.plans import graph_queries

    plan = graph_queries.hubs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


@pytest.mark.parametrize("bound", [1e-2, 1e-5])
def test_pushed_walks_are_within_their_residuals(spark, bound):
    rng = random.Random(14)
    nodes = [f"n{i:02d}" for i in range(50)]
    edges = [(f"e{i}", "n00" if i % 5 == 0 else rng.choice(nodes[:45]), rng.choice(nodes[:45]), rng.choice([0.9, 0.5, 0.0, None])) for i in range(150)]
    df = spark.createDataFrame([(*e[:3], "uses", e[3]) for e in edges], "id string, source_id string, target_id string, type string, confidence double")
    seeds = [("a", "n03", 1.0), ("a", "n07", 3.0), ("b", "n00", 1.0), ("c", "n48", 1.0), ("c", "n05", 1.0), ("none", "n01", 0.0)]
    got = graph.forward_push(df, spark.createDataFrame(seeds, "query_id string, id string, weight double"), bound=bound).collect()
    assert {r["query_id"] for r in got} == {"a", "b", "c"}
    links = {}
    for _, a, b, w in edges:
        if a != b:
            w = 0.5 if w is None else w if w > 0 else 0.01
            for x, y in ((a, b), (b, a)):
                links.setdefault(x, Counter())[y] += w
    for q in "abc":
        start = Counter()
        for p, n, w in seeds:
            start[n] += w * (p == q)
        start = {n: w / sum(start.values()) for n, w in start.items() if w}
        mass = dict(start)
        for _ in range(400):
            nxt = Counter({n: 0.15 * w for n, w in start.items()})
            for n, m in mass.items():
                for peer, w in (links.get(n) or start).items():
                    nxt[peer] += 0.85 * m * w / sum((links.get(n) or start).values())
            mass = nxt
        own = {r["id"]: r for r in got if r["query_id"] == q}
        left = sum(r["residual"] for r in own.values())
        assert sum(abs(m - (own[n]["mass"] if n in own else 0)) for n, m in mass.items()) == pytest.approx(left, abs=1e-9)
        assert all(r["residual"] <= bound * max(len(links.get(n, ())), 1) + 1e-12 for n, r in own.items()) and left < 60 * bound * 8


def test_questions_of_one_set_of_terms_are_searched_once_and_no_block_is_spelt(spark, path):
    docs = spark.createDataFrame([(f"d{i:03d}", "river stone" if i % 9 == 0 else "river") for i in range(300)], "id string, text string")
    index = postings.create(docs, "id", "text", path, False, per_bucket=100)
    asked = spark.createDataFrame([("a", "river stone"), ("b", "Stone river river"), ("c", "river"), ("d", "absent")], "query_id string, text string")
    one, members = index._alike(asked)
    assert one.count() == 3 and {tuple(r) for r in members.select("query_id", "one").collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}
    got = index.search(asked, 5).collect()
    assert {r["id"] for r in got if r["query_id"] == "a"} == {r["id"] for r in got if r["query_id"] == "b"} and len([r for r in got if r["query_id"] == "c"]) == 5


def test_rows_of_a_stored_table_are_computed_once(spark, path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(500).mapInArrow(count, "id bigint")
    table = buckets.create(rows, "id", path, per_bucket=100)
    assert seen.value == 500 and table.rows.count() == 500
    table = table.append(rows)
    assert seen.value == 1000 and table.rows.count() == 1000


def test_postings_answer_many_questions_by_shards(spark, path, monkeypatch):
    """Questions whose rarest terms have more texts than there are postings: the same best texts, and no row for a question and a text."""
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 9))) for _ in range(120)]
    rows = [(i * 7 - 200, texts[i % 120] if i < 240 else "w0 w1 w2") for i in range(300)]  # every text twice, one sixty times
    docs = spark.createDataFrame(rows, "id bigint, text string")
    index = postings.create(docs.where("id < 500"), "id", "text", path, False, per_bucket=100).append(docs.where("id >= 500"), "id", "text")
    asked = [" ".join(rng.sample(vocabulary, rng.randrange(1, 5))) for _ in range(80)] + ["w0 nowhere", ""]
    asked = spark.createDataFrame([(f"q{i:02d}", x) for i, x in enumerate(asked)], "query_id string, text string")
    every = {}
    for r in index.search(asked).collect():
        every.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    want = sorted((q, i, -s) for q, x in every.items() for s, i in sorted(x)[:3])
    monkeypatch.setattr(postings.Postings, "_leads", None)
    monkeypatch.setattr(postings, "PACK", 16)
    assert sorted(map(tuple, index.search(asked, 3).collect())) == want and len(want) > 100
