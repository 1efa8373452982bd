import pytest
from pyspark.sql import functions as F

from loomfield.domains import Domain, Registry, UnknownDomainError, granted
from loomfield.functions.vectors import cosine
from loomfield.operators import dataflow, evaluation, graph, maintenance, resolution, retrieval


def mass_of(spark, edges, seeds, ids, **more):
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    links = spark.createDataFrame(edges, "source_id string, target_id string, confidence double")
    start = spark.createDataFrame(seeds, "id string, weight double")
    return {r["id"]: r["mass"] for r in graph.personalized_pagerank(nodes, links, start, **more).collect()}


def test_walk_on_a_chain(spark):
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)]
    mass = mass_of(spark, edges, [("a", 1.0)], ["a", "b", "c", "d", "island"])
    assert sum(mass.values()) == pytest.approx(1)
    assert mass["b"] > mass["c"] > mass["d"] > mass["island"] == 0
    assert mass_of(spark, edges, [("a", 500.0)], ["a", "b", "c", "d", "island"]) == pytest.approx(mass)


def test_walk_without_usable_seeds_or_with_isolated_ones(spark):
    mass = mass_of(spark, [("a", "b", 0.0)], [("a", 0.0)], ["a", "b", "c"], rounds=7)
    plain = [1 / 3] * 3
    for _ in range(7):
        a, b, c = plain
        plain = [(0.15 + 0.85 * c) / 3 + 0.85 * b, (0.15 + 0.85 * c) / 3 + 0.85 * a, (0.15 + 0.85 * c) / 3]
    assert mass == pytest.approx(dict(zip("abc", plain))) and sum(mass.values()) == pytest.approx(1)
    alone = mass_of(spark, [("a", "b", 1.0)], [("a", 1.0), ("c", 1.0)], ["a", "b", "c"], rounds=7)
    assert sum(alone.values()) == pytest.approx(1)


def test_expansion_and_contraction(spark):
    nodes = spark.createDataFrame([(x, x.upper(), None) for x in "abcde"], "id string, name string, domain string")
    edges = spark.createDataFrame([("1", "a", "b", "uses"), ("2", "b", "c", "uses"), ("3", "c", "d", "uses"), ("4", "e", "c", "uses")], "id string, source_id string, target_id string, type string")
    got = {r["id"]: r["hop"] for r in graph.expand(nodes.where("id = 'a'"), edges, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    kept, moved = graph.contract(nodes, edges, spark.createDataFrame([("e", "b"), ("d", "c")], "loser string, keeper string"))
    assert {r["id"] for r in kept.collect()} == {"a", "b", "c"}
    assert {(r["source_id"], r["target_id"]) for r in moved.collect()} == {("a", "b"), ("b", "c")}


def test_compression_prefers_the_diverse_one(spark):
    rows = [("q", "best", 1.0, 1.0, [1.0, 0.91]), ("q", "near", 0.999, 1.0, [1.0, 0.9]), ("q", "diverse", 0.998, 1.0, [0.9, 1.0])]
    df = spark.createDataFrame(rows, "query_id string, id string, relevance double, cost double, vector array<double>")
    got = retrieval.compress(df, items=2, balance=0.5).orderBy("place").collect()
    assert [r["id"] for r in got] == ["best", "diverse"]
    assert retrieval.compress(df.withColumn("cost", F.lit(5000.0)), budget=100).count() == 0


def test_fusion(spark):
    rows = [("q", "vector", "solo", 1, 1.0), ("q", "vector", "agreed", 2, 1.0), ("q", "lexical", "other", 1, 1.0), ("q", "lexical", "agreed", 2, 1.0), ("q", "off", "gone", 1, 0.0)]
    got = retrieval.fuse(spark.createDataFrame(rows, "query_id string, signal string, id string, rank int, weight double")).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["agreed", "other", "solo"]
    assert got[0]["score"] == pytest.approx(2 / 62) and got[0]["relevance"] == 1


def test_metrics_with_nothing_to_find_or_nothing_found(spark):
    gold = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "x")], "query_id string, id string")
    found = spark.createDataFrame([("1", "c", 1), ("1", "a", 2), ("3", "z", 1)], "query_id string, id string, rank int")
    got = {r["query_id"]: r for r in evaluation.ranking_metrics(found, gold).collect()}
    assert got["1"]["recall"] == 0.5 and got["1"]["reciprocal_rank"] == 0.5
    assert got["2"]["recall"] == 0 and got["2"]["precision"] == 0
    assert got["3"]["recall"] == 1


def test_relationship_rules(spark):
    rows = [
        (1, "NeRF", "method", "3DGS", "method", "improves", 0.9), (2, "NeRF", "method", " nerf ", "method", "improves", 0.9), (3, "D", "dataset", "M", "method", "improves", 0.9),
        (4, "M", "method", "N", "method", "evaluates_on", 0.9), (5, "M", "method", "N", "method", "uses", 0.1), (6, "nerf", "method", "3dgs", "method", "improves", 0.1), (7, "u", None, "v", None, "extends", None),
    ]
    df = spark.createDataFrame(rows, "id int, source string, source_type string, target string, target_type string, type string, confidence double")
    got = {r["id"]: r["reason"] for r in resolution.validate(df).collect()}
    assert got == {1: None, 2: "degenerate", 3: "type_mismatch", 4: "type_mismatch", 5: "low_confidence", 6: "duplicate", 7: None}


def test_resolution(spark):
    mentions = spark.createDataFrame([(1, "Helios", "method"), (2, "Helios system", "method"), (3, "Zeta", "method")], "mention_id int, name string, type string")
    nodes = spark.createDataFrame([("n1", "helios", "method"), ("n2", "Eta", "method")], "id string, name string, type string")
    near = spark.createDataFrame([(2, "n1", 0.91), (3, "n2", 0.95)], "mention_id int, id string, score double")
    got = {r["mention_id"]: (r["node_id"], r["how"]) for r in resolution.resolve(mentions, nodes, near).collect()}
    assert got == {1: ("n1", "exact"), 2: ("n1", "similar"), 3: (None, "new")}


def test_clearing_keeps_what_others_assert(spark):
    edges = spark.createDataFrame([("e0",), ("e1",), ("e2",)], "id string")
    sources = spark.createDataFrame([("e0", "p", 0), ("e1", "p", 1), ("e1", "q", 0), ("e2", "p", None)], "edge_id string, paper_id string, chunk_index int")
    kept, left = maintenance.clear_paper(edges, sources, "p", [0])
    assert {r["id"] for r in kept.collect()} == {"e0", "e1"} and left.count() == 2
    assert {r["id"] for r in maintenance.clear_paper(edges, sources, "p")[0].collect()} == {"e1"}


def test_expired_leases(spark):
    rows = [(1, "running", "w", 1, 10), (2, "running", "w", 25, 10), (3, "running", "w", 1, 99), (4, "done", None, 1, None)]
    got = dataflow.reap(spark.createDataFrame(rows, "id int, status string, owner string, attempts int, lease_expires_at int"), F.lit(50)).collect()
    assert {r["id"]: r["status"] for r in got} == {1: "queued", 2: "failed", 3: "running", 4: "done"}


def test_domains_and_grants(spark):
    known = Registry(Domain("nlp"))
    df = spark.createDataFrame([("nlp",), ("default",), (None,)], "domain string")
    assert known.scope(df, " NLP ").count() == 1 and known.scope(df, "").count() == 2 and known.scope(df, None).count() == 3
    with pytest.raises(UnknownDomainError):
        known.resolve("other")
    got = spark.createDataFrame([(["*"],), (["nlp"],), ([],), (None,)], "g array<string>").select(granted(F.col("g"), F.lit("nlp"))).collect()
    assert [r[0] for r in got] == [True, True, False, False]


def test_cosine(spark):
    one = spark.range(1)
    assert one.select(cosine(F.lit([0.0, 0.0]), F.lit([1.0, 0.0]))).first()[0] == 0
    with pytest.raises(Exception, match="widths differ"):
        one.select(cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.col("id").cast("double")))).collect()


def test_best_of_a_block_is_what_every_pair_would_give(spark):
    names = ["PPR", "personalized page rank", "P.P.R.", "3DGS", "3D Gaussian Splatting", "red ring", "Red  ring model", "ring red", "model", "models", "GNMT 2", "GNMT 3", "x", "xylophone", "", None, "éa ÉB", "éÉ"]
    rows = [(f"n{i:03d}", n, t, b, s) for i, (n, t, b, s) in enumerate((n, t, b, 0.8 + 0.01 * ((k * 7 + j) % 12)) for k, n in enumerate(names) for j, (t, b) in enumerate([("m", 1), ("m", 1), ("paper", 1), (None, 1), ("m", 2), ("x", 2), ("Paper_reference", 2)]))]
    nodes = spark.createDataFrame(rows, "id string, name string, type string, block int, score double")
    mentions = nodes.select(F.col("id").alias("mention_id"), F.upper("name").alias("name"), "type", "block")
    every = mentions.select("mention_id", "block").join(nodes.select("id", "block", "score"), "block")
    unnamed = nodes.withColumn("name", F.concat("name", F.lit(" models")))
    for held in (nodes, unnamed):
        whole = resolution.resolve(mentions, held.select("id", "name", "type"), every)
        few = resolution.nearest_of_block(mentions, held)
        assert few.count() == few.select("mention_id").distinct().count() > 0
        assert sorted(map(tuple, resolution.resolve(mentions, held.select("id", "name", "type"), few).collect())) == sorted(map(tuple, whole.collect()))


def test_copies_of_a_block_are_not_paired(spark):
    copies = spark.range(60_000)
    nodes = copies.select(F.format_string("n%06d", "id").alias("id"), F.lit("red ring").alias("name"), F.lit("m").alias("type"), F.lit(0).alias("block"), (F.lit(0.8) + F.col("id") % 10 / 100).alias("score"))
    mentions = copies.select(F.col("id").alias("mention_id"), F.lit("red ring model").alias("name"), F.lit("m").alias("type"), F.lit(0).alias("block"))
    found = resolution.nearest_of_block(mentions, nodes)
    assert [tuple(r) for r in found.groupBy("id").count().collect()] == [("n000009", 60_000)]


def test_contraction_moves_a_claim_once(spark):
    edges = spark.createDataFrame([("e2", "a", "c", "uses", 0.5), ("e1", "b", "c", "uses", 0.7), ("e3", "a", "b", "uses", 0.1)], "id string, source_id string, target_id string, type string, confidence double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    _, kept = graph.contract(nodes, edges, spark.createDataFrame([("b", "a")], "loser string, keeper string"))
    assert kept.columns == edges.columns and [tuple(r) for r in kept.collect()] == [("e1", "a", "c", "uses", 0.7)]
    assert "source_id" not in kept._jdf.queryExecution().analyzed().toString().split("min_by(")[1].split(") AS")[0]


def test_merged_rows_carry_their_claim_once(spark, monkeypatch):
    """what is shuffled beside a claim's key does not repeat it."""
    from loomfield.operators import audit

    held, staged = [], audit.staged
    monkeypatch.setattr(audit, "staged", lambda df, name: held.append(df) or staged(df, name))
    edges = spark.createDataFrame([("e2", "a", "x", "uses", 0.5), ("e1", "b", "x", "uses", 0.7), ("e3", "a", "b", "uses", 0.1)], "id string, source_id string, target_id string, type string, confidence double")
    nodes = spark.createDataFrame([("a",), ("b",), ("x",)], "id string")
    out = audit.merged({"nodes": nodes, "edges": edges}, spark.createDataFrame([("b", "a")], "loser string, keeper string"))["edges"]
    assert out.columns == edges.columns and [tuple(r) for r in out.collect()] == [("e1", "a", "x", "uses", 0.7)]
    assert held[-1].schema["row"].dataType.names == ["id", "confidence"]
