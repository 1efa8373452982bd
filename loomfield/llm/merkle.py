"""A Merkle manifest of a dataset: one tree for each group of rows, one over the groups, a proof for each row."""

from __future__ import annotations

import hashlib
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

FAN_OUT = 16
#: Levels that a tree can have: FAN_OUT ** LEVELS leaves still fit a long.
LEVELS = 15
#: Proofs of one Arrow batch.
BATCH = 1024
PROOF = "array<struct<place:int,siblings:array<string>>>"
SOURCES = -1


def leaf_of(*columns: Column) -> Column:
    """SHA-256 over the columns: ``-`` for null, else byte count, ``:`` and value, so that no two rows write the same bytes."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def digest_of(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


class Segment:
    """The nodes that consecutive leaves ``first``, ``first + 1``, ... of a tree of ``total`` leaves have in full below them.

    ``levels`` holds, bottom up, the index of the first known node and the nodes' digests. Runs of FAN_OUT are aligned
    to the tree, so a run is complete here when all of it lies in the segment; the tree's last run may be shorter.
    """

    def __init__(self, first: int, leaves: list[str], total: int, fan_out: int):
        self.fan_out, self.total, self.levels = fan_out, total, [(first, leaves)]
        while self.width() > 1 and self.levels[-1][1]:
            lo, hi = self.runs()
            base, nodes = self.levels[-1]
            self.levels.append((lo, [digest_of(nodes[max(0, r * fan_out - base) : (r + 1) * fan_out - base]) for r in range(lo, hi)]))

    def width(self, level: int | None = None) -> int:
        """Nodes of the whole tree on a level."""
        return -(-self.total // self.fan_out ** (len(self.levels) - 1 if level is None else level))

    def runs(self) -> tuple[int, int]:
        """First and last (exclusive) complete run of the topmost level so far."""
        base, nodes = self.levels[-1]
        lo, end = -(-base // self.fan_out), base + len(nodes)
        hi = -(-end // self.fan_out) if end == self.width() else end // self.fan_out
        return lo, max(lo, hi)

    def ragged(self):
        """(level, index, digest) of every node whose run is not complete here, and of the top node if it is known."""
        for k, (base, nodes) in enumerate(self.levels):
            lo, above = self.levels[k + 1] if k + 1 < len(self.levels) else (0, [])
            for i, digest in enumerate(nodes, base):
                if not lo <= i // self.fan_out < lo + len(above):
                    yield k, i, digest

    def children(self, level: int, run: int) -> list[str] | None:
        if level + 1 < len(self.levels):
            base, nodes = self.levels[level]
            lo, above = self.levels[level + 1]
            if lo <= run < lo + len(above):
                return nodes[max(0, run * self.fan_out - base) : (run + 1) * self.fan_out - base]
        return None


def _offsets(measured: list[tuple]) -> tuple[dict[int, tuple], int, int]:
    """By partition: leaves of its first group that come before it, that group's number, its groups, and the full sizes of its first
    and last group; then the number of groups and the largest group's size."""
    place, sizes, number, held, upto, largest = {}, {}, -1, None, 0, 0
    for part, groups, first, n_first, last, n_last, most in sorted(measured, key=itemgetter(0)):
        goes_on = number >= 0 and first == held
        before, number = (upto, number) if goes_on else (0, number + 1)
        place[part] = (before, number, groups)
        sizes[number] = before + n_first
        if groups > 1:
            number += groups - 1
            sizes[number] = n_last
        held, upto, largest = last, sizes[number], max(largest, most, before + n_first)
    return {p: (*x, sizes[x[1]], sizes[x[1] + x[2] - 1]) for p, x in place.items()}, number + 1, largest


def _climb(nodes: DataFrame, largest: int, fan_out: int) -> tuple[list[DataFrame], DataFrame]:
    """Runs that no partition had in full, level by level, and the top node of each tree."""
    spark, runs, tops, below = nodes.sparkSession, [], [], None
    for level in range(LEVELS + 1):
        here = nodes.where(F.col("level") == level).select("tree", "total", "idx", "digest")
        here = here if below is None else here.union(below)
        tops.append(here.where(F.col("total") <= fan_out**level))
        if fan_out**level >= largest:
            break
        kids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
        run = here.where(F.col("total") > fan_out**level).groupBy("tree", "total", F.expr(f"idx div {fan_out}").alias("run")).agg(kids.alias("children"))
        run = staged(run.withColumn("level", F.lit(level)).withColumn("digest", F.sha2(F.array_join("children", ""), 256)), "merkle-runs")
        runs.append(run)
        below = run.select("tree", "total", F.col("run").alias("idx"), "digest")
    top = tops[0]
    for t in tops[1:]:
        top = top.union(t)
    return runs, top if tops else spark.createDataFrame([], top.schema)


def _above(nodes: DataFrame, fan_out: int) -> DataFrame:
    """(part, tree, level, run) of every run that a node's way to the top goes through."""
    power = F.array(*[F.lit(fan_out**k).cast("long") for k in range(LEVELS + 1)])
    step = nodes.select("part", "tree", "total", "idx", F.col("level").alias("own"), F.explode(F.sequence("level", F.lit(LEVELS - 1))).alias("level"))
    step = step.where(F.col("total") > power[F.col("level")]).withColumn("power", power[F.col("level") - F.col("own") + 1])
    return step.select("part", "tree", "level", F.expr("idx div power").alias("run"))


def manifest(leaves: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """Rows of ``leaves`` (group, id, leaf, ...) with place, subroot, root and proof.

    Leaves of a group ascend by id (null first), ties by digest; every ``fan_out`` consecutive nodes become the SHA-256 of
    their digests' text until one, the subroot, is left; subroots ascend by group (null first, bytewise) and likewise give
    the root. ``proof`` lists, from the leaf's run up to the root, the leaf's or node's place in its run and the others' digests.

    The leaves are range-sorted into an RDD. Its partitions count their groups; the driver gets the first and last
    group of each partition, no more, and knows then where a partition stands in its groups' trees. Each partition
    builds the aligned subtrees that it has in full; the few nodes at its ragged edges shuffle by coordinate and finish
    the upper levels, which go back to the partitions that lie below them. A hot group is only a tree that spans more
    partitions; rows that repeat spread by a number of the row.

    Defined results: repeated rows are leaves of their own; a group of one row has that leaf as subroot, one group its
    subroot as root, with empty proofs; an empty table gives no rows; other columns pass through, those named like an
    added one are replaced.
    """
    spark = leaves.sparkSession
    added = ("place", "subroot", "root", "proof")
    leaves = leaves.drop(*[c for c in leaves.columns if c.lower() in added])
    at = {c: i for i, c in enumerate(leaves.columns)}
    order = [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.monotonically_increasing_id()]
    rows = staged(leaves, "merkle-leaves").repartitionByRange(*order).sortWithinPartitions(*order).rdd
    group, leaf = itemgetter(at["group"]), itemgetter(at["leaf"])

    def measure(part, rows):
        seen = None
        for key, run in groupby(rows, group):
            n = sum(1 for _ in run)
            seen = (part, 1, key, n, key, n, n) if seen is None else (part, seen[1] + 1, seen[2], seen[3], key, n, max(n, seen[6]))
        return [] if seen is None else [seen]

    where, n_groups, largest = _offsets(rows.mapPartitionsWithIndex(measure).collect())
    sent = spark.sparkContext.broadcast(where)  # some hundred bytes for each partition

    def build(part, rows):
        for i, (_, run) in enumerate(groupby(rows, group)):
            before, number, groups, of_first, of_last = sent.value[part]
            before, digests = before if i == 0 else 0, []
            for row in run:
                yield part, number + i, -1, before + len(digests), 0, leaf(row), row
                digests.append(leaf(row))
            total = of_first if i == 0 else of_last if i == groups - 1 else len(digests)
            for level, idx, digest in Segment(before, digests, total, fan_out).ragged():
                yield part, number + i, level, idx, total, digest, None

    kind = leaves.schema.simpleString()
    built = spark.createDataFrame(rows.mapPartitionsWithIndex(build), f"part int, tree bigint, level int, idx bigint, total bigint, digest string, row {kind}", verifySchema=False)
    built = staged(built, "merkle-built")
    nodes = built.where("level >= 0").drop("row")
    runs, tops = _climb(nodes, largest, fan_out)
    over, top = _climb(tops.select(F.lit(SOURCES).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.lit(n_groups).cast("long").alias("total"), "digest"), n_groups, fan_out)
    root = (top.first() or {"digest": None})["digest"]
    sources = nodes.select("part", F.lit(SOURCES).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.lit(n_groups).cast("long").alias("total")).distinct()
    way = _above(nodes.drop("digest"), fan_out).unionByName(_above(sources, fan_out)).distinct()
    shape = ["part", "kind", "tree", "level", "idx", "total", "digest", "children", "row"]
    whole = nodes.select("part", F.lit(0).alias("kind"), "tree", "level", "idx", "total", "digest", F.lit(None).cast("array<string>").alias("children"), F.lit(None).cast(kind).alias("row"))
    for run in [*runs, *over]:
        mine = way.join(run.select("tree", "level", "run", "children"), ["tree", "level", "run"])
        whole = whole.union(mine.select("part", F.lit(1), "tree", "level", "run", F.lit(0).cast("long"), F.lit(None).cast("string"), "children", F.lit(None).cast(kind)))
    whole = whole.union(built.where("level = -1").select("part", F.lit(2), "tree", "level", "idx", "total", "digest", F.lit(None).cast("array<string>"), "row"))

    def prove(batches):
        part, totals, known, held = None, {}, {}, []

        def finished():
            if held:
                table = pa.Table.from_batches(held).combine_chunks()
                tree = table.column("tree")[0].as_py()
                yield from _proofs(table, tree, Segment(table.column("idx")[0].as_py(), table.column("digest").to_pylist(), totals[tree], fan_out), known, n_groups)

        for batch in batches:
            parts, kinds, trees = (batch.column(i).to_numpy() for i in (0, 1, 2))
            cuts = [0, *(np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0) | (np.diff(trees) != 0)) + 1).tolist(), len(parts)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                key = (int(parts[lo]), int(kinds[lo]), int(trees[lo]))
                if held and key != held_key:
                    yield from finished()
                    held = []
                if key[0] != part:
                    part, totals, known = key[0], {}, {}
                piece = batch.slice(lo, hi - lo)
                if key[1] == 0:
                    totals[key[2]] = piece.column(5)[0].as_py()
                elif key[1] == 1:
                    known.update({(key[2], level, run): kids for level, run, kids in zip(*(piece.column(i).to_pylist() for i in (3, 4, 7)), strict=True)})
                else:
                    held_key = key
                    held.append(piece)
        yield from finished()

    told = whole.select(*shape).repartition("part").sortWithinPartitions("part", "kind", "tree", "idx").mapInArrow(prove, f"row {kind}, place bigint, subroot string, proof {PROOF}")
    return told.select(*[F.col(f"row.`{c}`") for c in leaves.columns], "place", "subroot", F.lit(root).cast("string").alias("root"), "proof")


def _proofs(table: pa.Table, tree: int, segment: Segment, known: dict, n_groups: int):
    """Batches of (row, place, subroot, proof) for the leaves of one tree in one partition."""
    fan_out = segment.fan_out

    def steps(tree, level, idx, total, children):
        """Places and siblings from a node up to its tree's top, and the top's digest if there was a run."""
        places, siblings, top = [], [], None
        while total > fan_out**level:
            kids = children(level, idx // fan_out)
            kids = known[tree, level, idx // fan_out] if kids is None else kids
            places.append(idx % fan_out)
            siblings.append(kids[: idx % fan_out] + kids[idx % fan_out + 1 :])
            level, idx, top = level + 1, idx // fan_out, kids
        return places, siblings, top and digest_of(top)

    over_places, over_siblings, _ = steps(SOURCES, 0, tree, n_groups, lambda *_: None)
    first, leaves = segment.levels[0]
    subroot, above = leaves[0], (over_places, over_siblings)
    above_run = None
    rows = table.column("row").combine_chunks() if isinstance(table.column("row"), pa.ChunkedArray) else table.column("row")
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
    for lo in range(0, len(leaves), BATCH):
        places, siblings, ends, roots = [], [], [0], []
        for i in range(lo, min(lo + BATCH, len(leaves))):
            idx = first + i
            if segment.total > 1:
                run = idx // fan_out
                if run != above_run:  # what lies above is the same for all leaves of a run
                    kids = segment.children(0, run)
                    kids = known[tree, 0, run] if kids is None else kids
                    p, s, top = steps(tree, 1, run, segment.total, segment.children)
                    above, subroot, above_run = (p + over_places, s + over_siblings), top or digest_of(kids), run
                places.append(idx % fan_out)
                siblings.append(kids[: idx % fan_out] + kids[idx % fan_out + 1 :])
            places += above[0]
            siblings += above[1]
            ends.append(len(places))
            roots.append(subroot)
        step = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(siblings, pa.list_(pa.string()))], names=["place", "siblings"])
        n = len(roots)
        yield pa.RecordBatch.from_arrays(
            [rows.slice(lo, n), pa.array(range(first + lo, first + lo + n), pa.int64()), pa.array(roots, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), step)],
            names=["row", "place", "subroot", "proof"],
        )


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def up(h, s):
        return F.sha2(F.concat(F.array_join(F.slice(s["siblings"], 1, s["place"]), ""), h, F.array_join(F.slice(s["siblings"], s["place"] + 1, F.size(s["siblings"])), "")), 256)

    return F.aggregate(proof, leaf, up)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = lambda text: leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    leaves = docs.select(F.col("source").alias("group"), F.col("doc_id").alias("id"), fields(F.col("text")).alias("leaf"), F.when(tampered, fields(lowered)).alias("tampered"))
    got = manifest(leaves).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    told = F.sha2(F.array_join(F.flatten(F.transform("proof", lambda s: s["siblings"])), ""), 256)
    return got.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", told.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a string expression whose characters stand for bytes, bit by bit."""
    bits = f"list_transform(range(0, 8 * length({text})), lambda i: (ord(substr({text}, (i // 8 + 1)::bigint, 1)) >> (i % 8)::integer) & 1)"
    step = "lambda c, b: xor(c >> 1, case when xor(c & 1, b) = 1 then 3988292384 else 0 end)"
    return f"xor(list_reduce(list_transform({bits}, lambda b: b::bigint), {step}, 4294967295::bigint), 4294967295::bigint)"


def manifest_sql(docs: str = "documents", levels: int = 6, over: int = 4) -> str:
    """DuckDB SQL of op11 for up to 16**levels rows of a source and 16**over sources."""
    field = lambda x: f"coalesce(strlen({x}::varchar)::varchar || ':' || {x}::varchar, '-')"
    leaf = lambda t: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", t))) + ")"
    out = [f"""own as (select doc_id, source, {leaf('text')} as leaf, case when {crc32_sql('doc_id::varchar')} % 5 = 0 then {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as tampered from {docs}),
placed as (select *, dense_rank() over (order by source nulls first) - 1 as tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by source) as total from own),
a0 as (select tree, idx, total, leaf as digest from placed)"""]
    tree = lambda a, k, of: f"{a}r{k} as (select tree, idx // 16 as run, any_value(total) as total, list(digest order by idx) as kids from {a}{k} where total > {16**k} group by tree, idx // 16),\n{a}{k + 1} as (select tree, run as idx, total, sha256(array_to_string(kids, '')) as digest from {a}r{k})"
    out += [tree("a", k, "tree") for k in range(levels)]
    tops = " union all ".join(f"select tree, digest from a{k} where total <= {16**k} and total > {16**k // 16}" for k in range(levels + 1))
    out.append(f"subroots as ({tops}),\nb0 as (select 0 as tree, tree as idx, count(*) over () as total, digest from subroots)")
    out += [tree("b", k, "0") for k in range(over)]
    roots = " union all ".join(f"select digest as root from b{k} where total <= {16**k} and total > {16**k // 16}" for k in range(over + 1))
    out.append(f"top as ({roots}),\nf0 as (select p.*, s.digest as subroot, '' as proof, coalesce(tampered, leaf) as h from placed p join subroots s using (tree))")
    now = 0
    for a, n, key, place in (("a", levels, "r.tree = f.tree", "f.idx"), ("b", over, "true", "f.tree")):
        for k in range(n):
            at = f"({place} // {16**k} % 16 + 1)"
            out.append(f"""f{now + 1} as (select f.* exclude (proof, h), f.proof || coalesce(array_to_string(list_filter(r.kids, lambda x, i: i <> {at}), ''), '') as proof,
case when r.kids is null then f.h else sha256(array_to_string(list_transform(r.kids, lambda x, i: case when i = {at} then f.h else x end), '')) end as h from f{now} f left join {a}r{k} r on {key} and r.run = {place} // {16 ** (k + 1)})""")
            now += 1
    return "with " + ",\n".join(out) + f"\nselect doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, h as folded_root, h = root as verified from f{now}, top"
