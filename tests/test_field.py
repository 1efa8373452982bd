"""Retrieval over a whole store: the constructed corpus' known scores, and every step against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomfield.functions import words
from loomfield.operators import evalset, field, retrieval
from loomfield.plans import paper_queries

STORE = {}


def test_scorecard_has_the_known_figures(spark):
    got = {(r["strategy"], r["family"]): r for r in evalset.run(spark).collect()}
    known = [
        ("vector", "all", 0.574, 0.650), ("keyword", "all", 0.667, 0.667), ("hybrid", "all", 0.877, 1.0), ("vector", "multi-hop", 0, 0), ("keyword", "multi-hop", 0, 0),
        ("hybrid", "multi-hop", 0.631, 1.0), ("vector", "hub", 0.759, 0.95), ("keyword", "hub", 1, 1), ("hybrid", "hub", 1, 1), ("vector", "single-hop", 0.963, 1),
        ("keyword", "single-hop", 1, 1), ("graph only", "single-hop", 1, 1), ("hybrid", "single-hop", 1, 1), ("graph only", "hub", 0.631, 1),
    ]
    for strategy, family, ndcg, recall in known:
        assert (got[strategy, family]["ndcg"], got[strategy, family]["recall"]) == (pytest.approx(ndcg, abs=1e-3), pytest.approx(recall, abs=1e-3)), (strategy, family)
    # ties among equal masses fall by id here, so the graph alone may do a little better than the published row
    assert got["graph only", "all"]["ndcg"] >= 0.721 and got["graph only", "all"]["recall"] >= 0.983


def test_stems():
    pairs = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
        "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam",
        "triplicate": "triplic", "hopefulness": "hope", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "effective": "effect", "rate": "rate", "controll": "control",
        "depends": "depend", "depend": "depend", "x7": "x7",
    }
    assert {w: words.stem(w) for w in pairs} == pairs
    assert words.terms("What does the vellum3 cistern3 DEPEND on?") == ["vellum3", "cistern3", "depend"]


def small(spark):
    rng = random.Random(8)
    nodes = [f"n{i:02d}" for i in range(40)]
    edges = [(f"e{i:03d}", rng.choice(nodes), rng.choice(nodes), "uses", rng.choice([0.9, 0.5, 0.0, -1.0, None]), rng.choice([None, None, "default"])) for i in range(70)]
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)]
    vectors = {n: vec() for n in nodes[:35]}
    props = [(f"p{i:02d}", f"{rng.choice(['red', 'blue'])} {rng.choice(['fish', 'birds'])} {i}", rng.sample(nodes, 2), vec()) for i in range(60)]
    asked = [("q1", "red fish", vec()), ("q2", "the blue bird", vec()), ("q3", "", vec())]
    store = field.Store(
        spark.createDataFrame([(n, f"name {n}", "method", None if i % 2 else "default") for i, n in enumerate(nodes)], "id string, name string, type string, domain string"),
        spark.createDataFrame(edges, "id string, source_id string, target_id string, type string, confidence double, domain string"),
        spark.createDataFrame(list(vectors.items()), "id string, vector array<double>"),
        spark.createDataFrame([(*p, None) for p in props], "id string, text string, node_ids array<string>, vector array<double>, domain string"),
    )
    return store, nodes, edges, vectors, props, asked


def cos(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def by_hand(nodes, edges, vectors, props, asked, options):
    """One question after the other, with dictionaries."""
    out = {}
    for q, text, vec in asked:
        seeds = sorted(((-round(cos(vec, v), 12), n) for n, v in vectors.items()))[: options.seeds]
        seen, frontier, kept = {n for _, n in seeds}, {n for _, n in seeds}, {}
        for _ in range(options.hops):
            if len(seen) >= options.nodes or not frontier:
                break
            met = sorted(e for e in edges if e[1] in frontier or e[2] in frontier)[: 4 * options.nodes]
            kept |= {e[0]: e for e in met}
            new = sorted({n for e in met for n in e[1:3]} - seen)[: options.nodes - len(seen)]
            seen, frontier = seen | set(new), set(new)
        start = {n: max(-s, 0) for s, n in seeds}
        total = sum(start.values())
        start = {n: start.get(n, 0) / total for n in seen}
        mass = dict(start)
        links = [(a, b, 0.5 if not w else w if w > 0 else 0.01) for _, a, b, _, w, _ in kept.values() if a != b and a in seen and b in seen]
        links += [(b, a, w) for a, b, w in links]
        sums = {n: sum(w for a, _, w in links if a == n) for n in seen}
        for _ in range(options.rounds):
            idle = sum(m for n, m in mass.items() if not sums[n])
            nxt = {n: (options.restart + (1 - options.restart) * idle) * start[n] for n in seen}
            for a, b, w in links:
                nxt[b] += (1 - options.restart) * mass[a] * w / sums[a]
            mass = nxt
        top = {n for n, _ in sorted(mass.items(), key=lambda x: (-round(x[1], 12), x[0]))[: options.top_nodes]}
        ranks = {"graph": [p[0] for p in sorted((p for p in props if top & set(p[2])), key=lambda p: (-round(sum(round(mass.get(n, 0), 12) for n in set(p[2])), 12), p[0]))[: options.depth]]}
        ranks["vector"] = [p[0] for p in sorted(props, key=lambda p: (-round(cos(vec, p[3]), 12), p[0]))[: options.depth]]
        want, listed = set(words.terms(text)), {p[0]: words.terms(p[1]) for p in props}
        mean = sum(map(len, listed.values())) / len(props)
        df = {t: sum(t in x for x in listed.values()) for t in want}
        bm25 = lambda x: sum(math.log(1 + (len(props) - df[t] + 0.5) / (df[t] + 0.5)) * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in want)
        ranks["lexical"] = sorted((p for p, x in listed.items() if want and want <= set(x)), key=lambda p: (-round(bm25(listed[p]), 12), p))[: options.depth]
        fused = {}
        for signal, ids in ranks.items():
            for place, p in enumerate(ids, 1):
                fused[p] = fused.get(p, 0) + options.weights[signal] / (60 + place)
        fused = dict(sorted(fused.items(), key=lambda x: (-x[1], x[0]))[: options.candidates])
        best, held, left, taken = max(fused.values()), {p[0]: p for p in props}, options.chars, []
        while len(taken) < options.evidence:
            fits = [p for p in fused if p not in taken and len(held[p][1]) <= left]
            if not fits:
                break
            gain = lambda p: options.balance * fused[p] / best - (1 - options.balance) * max([0] + [cos(held[p][3], held[t][3]) for t in taken])
            taken.append(max(fits, key=gain))
            left -= len(held[taken[-1]][1])
        out[q] = taken, len(seen), len(kept), len(fused)
    return out


@pytest.mark.parametrize("options", [field.Options(seeds=3, top_nodes=5, evidence=6, chars=70), field.Options(seeds=2, hops=2, nodes=9, candidates=20)])
def test_retrieval_by_hand(spark, options):
    store, nodes, edges, vectors, props, asked = small(spark)
    questions = spark.createDataFrame(asked, "query_id string, text string, vector array<double>")
    got = field.retrieve(store, questions, options=options)
    want = by_hand(nodes, edges, vectors, props, asked, options)
    evidence, stats = {}, {r["query_id"]: r for r in got.stats.collect()}
    for r in got.evidence.orderBy("query_id", "place").collect():
        evidence.setdefault(r["query_id"], []).append(r["id"])
    for q, (taken, seen, kept, fused) in want.items():
        assert evidence[q] == taken
        assert (stats[q]["subgraph_nodes"], stats[q]["subgraph_edges"], stats[q]["candidates"]) == (seen, kept, fused)
        assert stats[q]["chars"] <= options.chars and stats[q]["seeds"] == options.seeds
    assert all(stats[q]["truncated"] == (options.nodes == 9) for q in want)
    lines = {r["query_id"]: r["context"].split("\n") for r in field.context(got.evidence).collect()}
    assert lines["q1"][0].startswith("[1] ") and len(lines["q1"]) == len(evidence["q1"])
    assert {r["query_id"] for r in field.naive_baseline(store, questions, k=3).collect()} == {"q1", "q2", "q3"}


def test_other_domains_see_nothing(spark):
    store, *_, asked = small(spark)
    got = field.retrieve(store, spark.createDataFrame(asked, "query_id string, text string, vector array<double>"), "atlas")
    assert got.evidence.count() == 0 and all((r["seeds"], r["chars"], r["truncated"]) == (0, 0, False) for r in got.stats.collect())


def test_nearest_in_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(3)) for _ in range(4)]) for i in range(200)] + [(999, None)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>").repartition(5)
    asked = df.where("id < 30").select(F.col("id").cast("string").alias("query_id"), "vector")
    whole = sorted(map(tuple, retrieval.nearest(asked, df, 7).collect()))
    assert sorted(map(tuple, retrieval.nearest(asked, df, 7, block=4).collect())) == whole and len(whole) == 210
    norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1
    for q in range(30):
        best = sorted((-round(sum(a * b for a, b in zip(rows[q][1], v)) / norm(v) / norm(rows[q][1]), 9), i) for i, v in rows[:200])[:7]
        assert [r[1] for r in sorted((r for r in whole if r[0] == str(q)), key=lambda r: r[3])] == [i for _, i in best]
    with pytest.raises(Exception, match="unequal widths"):
        retrieval.nearest(asked, spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id bigint, vector array<double>").coalesce(1), 2).collect()


def test_the_whole_corpus_arm(spark):
    store, questions, gold = evalset.corpus(spark, 2)
    asked = questions.where("query_id in ('single-hop-0', 'hub-1')")
    got = field.retrieve_whole(store, asked, evalset.DOMAIN, field.Options(rounds=10)).collect()
    first = {r["query_id"]: r["id"] for r in got if r["place"] == 1}
    answers = {r["query_id"]: r["id"] for r in gold.collect()}
    assert set(first) == {"single-hop-0", "hub-1"} and first["single-hop-0"] == answers["single-hop-0"]


def test_compressed_evidence_by_hand(spark):
    from loomfield.plans import retrieval_queries

    sf = "/root/testdata/sf0.001"
    vec = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = {}
    for r in retrieval_queries.compressed_evidence(spark, sf).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for q in list(got)[:8]:
        near = sorted(vec, key=lambda i: (-round(cos(vec[int(q)], vec[i]), 12), i))[:50]
        rel, taken = {i: round(cos(vec[int(q)], vec[i]), 12) for i in near}, []
        while len(taken) < 5:
            taken.append(max((i for i in near if i not in taken), key=lambda i: 0.7 * rel[i] - 0.3 * max([0] + [cos(vec[i], vec[t]) for t in taken])))
        assert got[q] == taken


def test_walk_by_rounds_is_the_walk_of_one_task(spark):
    nodes = spark.createDataFrame([(q, f"n{i}") for q in "ab" for i in range(7)] + [("c", "n0"), ("c", "n1")], "query_id string, id string")
    links = [("a", "n0", "n1", 0.3), ("a", "n1", "n2", 0.7), ("a", "n0", "n1", 0.9), ("a", "n3", "n3", 1.0), ("a", "n4", "away", 1.0), ("b", "n0", "n5", 0.0), ("b", "n5", "n6", -1.0), ("b", "n0", "n2", 0.123456)]
    edges = spark.createDataFrame(links, "query_id string, source_id string, target_id string, w double")
    seeds = spark.createDataFrame([("a", "n0", 2.0), ("a", "n4", 1.0), ("b", "n0", 0.0), ("b", "away", 1.0)], "query_id string, id string, score double")
    want = {(r["query_id"], r["id"]): r["mass"] for r in field.walked(nodes, edges, seeds, rounds=4).collect()}
    by_rounds = field.walked_by_rounds(nodes, edges, seeds, rounds=4)
    got = {(r["query_id"], r["id"]): r["mass"] for r in by_rounds.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "Pandas" not in by_rounds._jdf.queryExecution().toString()


def test_walks_have_all_of_a_large_neighbourhood(spark, tmp_path, monkeypatch):
    """A nation of more customers than the million nodes that its walk once stopped at."""
    n = 10**6 + 5
    for name in ("region", "nation", "supplier", "part", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    spark.range(n).selectExpr("id AS c_custkey", "cast(0 AS bigint) AS c_nationkey", "concat('Customer#', id) AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(field, "walked_by_rounds", lambda near, *rest, **options: near.withColumn("mass", F.lit(0.0)))
    assert paper_queries.field_walks(spark, str(tmp_path)).where("query_id = 'nation#0' and id like 'customer#%'").count() == n


def test_whole_neighbourhoods_are_those_that_nothing_cuts(spark):
    rng = random.Random(4)
    links = spark.createDataFrame([(f"e{i:03d}", f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.random()) for i in range(90)], "id string, source_id string, target_id string, w double")
    seeds = spark.createDataFrame([("a", "n1"), ("a", "n2"), ("b", "n1"), ("c", "away")], "query_id string, id string")
    near, inner, _ = field.expand(seeds, links, 3, 10**6)
    for got, want in zip(field.whole(seeds, links, 3), (near, inner)):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
