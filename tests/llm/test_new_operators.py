"""Merkle manifest, HyperMinHash and spelling variants against plain Python, on odd rows, ties, hot groups and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import duck
from loomfield.llm import hyperminhash, merkle, spelling

SF = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Merkle manifest


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(leaves, fan):
    """Root, and the proof of each leaf as (place, siblings) from below."""
    levels, proofs = [leaves], [[] for _ in leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        runs = [low[i : i + fan] for i in range(0, len(low), fan)]
        for i, proof in enumerate(proofs):
            at = i // fan ** (len(levels) - 1)
            run = runs[at // fan]
            proof.append((at % fan, run[: at % fan] + run[at % fan + 1 :]))
        levels.append([sha("".join(r)) for r in runs])
    return levels[-1][0] if leaves else None, proofs


def manifest_by_hand(rows, fan):
    """(group, id, leaf) -> Counter of (place, subroot, root, proof)."""
    groups = {}
    for g, i, h in rows:
        groups.setdefault(g, []).append((i is not None, i, h))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    held = {g: tree([h for _, _, h in sorted(groups[g])], fan) for g in order}
    root, over = tree([held[g][0] for g in order], fan)
    out = Counter()
    for n, g in enumerate(order):
        subroot, proofs = held[g]
        for place, (_, i, h) in enumerate(sorted(groups[g])):
            out[g, i, h, place, subroot, root, tuple((p, tuple(s)) for p, s in proofs[place] + over[n])] += 1
    return out


@pytest.mark.parametrize("fan, parts", [(16, "8"), (2, "8"), (3, "1"), (4, "40")])
def test_manifest_by_hand(spark, fan, parts):
    rng = random.Random(fan)
    rows = [("hot", i, sha(f"hot{i}")) for i in range(700)] + [(f"é{g}", i, sha(f"{g}/{i}")) for g in range(30) for i in range(rng.choice([1, 1, 2, 5, 17, 33]))]
    rows += [(None, i, sha(f"none{i}")) for i in range(40)] + [("Z", None, sha(f"z{i % 3}")) for i in range(20)] + [("same", 7, sha("same"))] * 50
    rng.shuffle(rows)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(*r, "x", {"k": 1}) for r in rows], "group string, id bigint, leaf string, PLACE string, extra map<string,int>")
        got = merkle.manifest(df, fan).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert got[0]["extra"] == {"k": 1}
    told = Counter((r["group"], r["id"], r["leaf"], r["place"], r["subroot"], r["root"], tuple((s["place"], tuple(s["siblings"])) for s in r["proof"])) for r in got)
    assert told == manifest_by_hand(rows, fan)


def test_manifest_folds_and_finds_what_was_changed(spark):
    df = spark.createDataFrame([("a", i, sha(str(i))) for i in range(50)], "group string, id bigint, leaf string")
    got = merkle.manifest(df).withColumn("same", merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root"))
    got = got.withColumn("other", merkle.folded(F.sha2("leaf", 256), F.col("proof")) == F.col("root"))
    assert [tuple(r) for r in got.groupBy("same", "other").count().collect()] == [(True, False, 50)]


def test_manifest_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([("a", 1, sha("1"))], "group string, id bigint, leaf string")
    r = merkle.manifest(df).first()
    assert (r["subroot"], r["root"], r["proof"]) == (sha("1"), sha("1"), [])
    assert merkle.manifest(df.limit(0)).collect() == []


def test_leaves_tell_nulls_lengths_and_bytes(spark):
    df = spark.createDataFrame([(1, None, "é")], "a bigint, b string, c string")
    assert df.select(merkle.leaf_of(F.col("a"), F.col("b"), F.col("c"))).first()[0] == sha("1:1-2:é")


# HyperMinHash


def links_by_hand(texts):
    """(set size, smallest linked id) of each text."""
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(ASCII))
        sets.append({" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(rng):
    """Copies with few and with many edits around the line, chains, short texts, odd ones."""
    texts = [None, "", " \t\n", "one", "One", "one two", "ONE two", "one two three", "two one", "é😀 ü", "é😀 Ü"]
    for size in (8, 12, 20, 45, 150, 600):
        base = [f"{size}w{rng.randrange(10**6)}" for _ in range(size)]
        texts += [edited(rng, base, rng.randrange(0, max(2, size // 18))) for _ in range(40)]
        chain = list(base)
        for _ in range(12):  # each near the one before, the ends far apart
            chain = edited(rng, chain, max(1, size // 60)).split(" ")
            texts.append(" ".join(chain))
    same = " ".join(f"s{i}" for i in range(80))
    texts += [same, same.upper(), same.replace(" ", "\n ")] * 30
    texts += [" ".join(f"u{i}-{j}" for j in range(60)) for i in range(40)]
    return texts


@pytest.mark.parametrize("cell, star, family, held", [(2048, 256, 512, 1 << 20), (16, 4, 5, 300)])
def test_links_by_hand(spark, monkeypatch, cell, star, family, held):
    monkeypatch.setattr(hyperminhash, "CELL", cell)
    monkeypatch.setattr(hyperminhash, "STAR", star)
    monkeypatch.setattr(hyperminhash, "FAMILY", family)
    monkeypatch.setattr(hyperminhash, "HELD", held)
    texts = corpus(random.Random(5))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, regs string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in hyperminhash.near_duplicates(df).collect()}
    want = links_by_hand(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert 60 < len({c for _, c in want}) < len(texts)


def test_hyperminhash_odd_tables(spark):
    rows = [("b", "q w e r"), ("a", "q w e r"), (None, "q w e r"), ("a", "q w e r"), (None, "other words here now"), ("c", None)]
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == Counter([("b", "a", False), ("a", "a", True), (None, "a", False), ("a", "a", True), (None, None, True), ("c", "c", True)])
    assert hyperminhash.near_duplicates(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_registers_estimate_similarity():
    rng = random.Random(1)
    from loomfield.llm import ragged
    import numpy as np

    for share in (0.5, 0.85, 0.95):
        both = [rng.getrandbits(64) for _ in range(int(4000 * share))]
        sets = [sorted(both + [rng.getrandbits(64) for _ in range((4000 - len(both)) // 2)]) for _ in range(2)]
        x, y = hyperminhash.registers(np.array(sum(sets, []), ragged.U64), np.array([0, len(sets[0]), sum(map(len, sets))]))
        assert abs(((x == y) & (x != 0)).mean() - share) < 0.12


# Spelling variants


def variants_by_hand(n):
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_variants_by_hand(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(4, 7))) for _ in range(700)} | {"ÀÉîôû", "ÀÉîôü", "×÷×÷×", "aaaaa", "aaaaaa", "aaaaaaa"}
    n = {w: rng.choice([3, 3, 6, 7, 12, 12, 50, 200]) for w in words}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n bigint"))
    assert {r["word"]: tuple(r)[1:] for r in got.collect()} == variants_by_hand(n)
    assert spelling.variants(spark.createDataFrame([], "word string, n bigint")).collect() == []


def test_vocabulary_by_hand(spark):
    rng = random.Random(9)
    words = ["Maison", "maison", "MAISON", "Église", "église", "house", "houses", "abcd", "x" * 300, "don't", "naïve", "a1b2c", "schön"]
    texts = [None, "", "...", *[" ".join(rng.choices(words, k=rng.randrange(1, 400))) for _ in range(60)]]
    rows = [(i if i % 7 else None, t, "n") for i, t in enumerate(texts)]
    want = Counter()
    for i, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(ASCII)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w
            want[w] += len(w) >= 5
    got = spelling.vocabulary(spark.createDataFrame(rows, "doc_id bigint, text string, n string"))
    assert {r["word"]: r["n"] for r in got.collect()} == {w: n for w, n in want.items() if n >= 3}


@pytest.mark.parametrize("query, sql", [(merkle.op11_merkle_manifest, merkle.manifest_sql()), (spelling.op13_spelling_variants, spelling.variants_sql())])
def test_queries_match_sql(spark, query, sql):
    duck.same(query(spark, SF), SF, sql)


def test_op12_matches_every_pair(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = links_by_hand([r["text"] for r in rows])
    got = {r["doc_id"]: r for r in hyperminhash.op12_hyperminhash(spark, SF).collect()}
    for r, (n, low) in zip(rows, want, strict=True):
        own = got[r["doc_id"]]
        assert (own["n_shingles"], own["component_id"], own["kept"]) == (n, rows[low]["doc_id"], rows[low]["doc_id"] == r["doc_id"])
