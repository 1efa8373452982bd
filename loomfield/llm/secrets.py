"""Secret scans over an incremental ledger of content-addressed texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, staged
from .spans import Rule, joined_spans, matches, text_key

#: What secrets look like. The first three are the base kinds, their order is the order in lists of spans.
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 2),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]{24,}", r"[0-9a-f]{24}"),
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-[A-Za-z0-9-]{10}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ"),
]
BASE = ("assign", "access", "hex")
#: Least length of the judged part of a match.
LEAST = {"assign": 6, "access": 20}


class Ledger:
    """What was scanned, in a folder: (blob, rules) with rules as kind@version, and (blob, place, kind, version, start, end)."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return self.spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("row")).select("row.*")

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob string, rules array<string>")

    def findings(self) -> DataFrame:
        return self._read("findings", "blob string, place int, kind string, version int, start bigint, end bigint")


def scan(versions: DataFrame, ledger: Ledger | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """(blob, spans) for every text of ``versions`` (text) with secrets; spans hold (start, place, kind, end).

    Texts are addressed by SHA-256. Only pairs of a text and a rule version that the ledger lacks are scanned, each
    text once however many paths and versions hold it; findings are appended before the pairs, so a scan that was
    cut off is repeated, and repeated findings count once. Without a ledger every distinct text is scanned.
    """
    names = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    texts = versions.select(text_key(F.col("text")).alias("blob"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).dropDuplicates(["blob"])
    texts = texts.withColumn("missing", names)
    if ledger:
        seen = ledger.scanned().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        texts = texts.drop("missing").join(seen, "blob", "left").withColumn("missing", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("missing") > 0)
    texts = texts.withColumn("todo", F.transform("missing", lambda x: F.split_part(x, F.lit("@"), F.lit(1))))
    least = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, LEAST.get(r.kind, 0))])
    version = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    new = matches(texts, rules).where(F.length("part") >= least[F.col("kind")])
    new = staged(new.select("blob", "place", "kind", version[F.col("kind")].alias("version"), "start", "end"), "secrets")
    if ledger:
        pairs = staged(texts.select("blob", F.col("missing").alias("rules")), "secrets-scanned")
        new.write.mode("append").parquet(f"{ledger.path}/findings")
        pairs.write.mode("append").parquet(f"{ledger.path}/scanned")
        held = names
        new = ledger.findings().where(F.array_contains(held, F.concat_ws("@", "kind", "version"))).join(versions.select(text_key(F.col("text")).alias("blob")).distinct(), "blob", "left_semi").dropDuplicates()
        places = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
        new = new.withColumn("place", places[F.col("kind")])
    return new.groupBy("blob").agg(F.collect_list(F.struct("start", "place", "kind", "end")).alias("spans"))


def report(versions: DataFrame, found: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Add n_assign, n_access, n_hex, base_sha256 and spans to (doc_id, text): findings joined back to every path.

    Defined results: a null text counts as empty; without findings the counts are 0, spans is empty and base_sha256
    is that of the empty string; paths of one text get the same; an empty table gives no rows.
    """
    held = versions.select("doc_id", text_key(F.col("text")).alias("blob")).join(found, "blob", "left")
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return held.select("doc_id", *[count(k) for k in BASE], F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(spans).alias("spans"))


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """A first scan, through a ledger of its own in the shared folder, which goes with the process."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return report(docs, scan(docs, ledger_in_shared_folder(spark, "op1")))


def ledger_in_shared_folder(spark, name: str) -> Ledger:
    return Ledger(spark, scratch(spark, f"ledger-{name}"))


def secrets_sql(docs: str = "documents") -> str:
    """DuckDB SQL of op1."""
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    words = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    patterns = {r.kind: r.pattern for r in RULES} | {"assign": f"({words})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""}
    per = " union all ".join(
        "select id, {place} as place, '{kind}' as kind, text, regexp_split_to_array(text, '{p}') as gaps, regexp_extract_all(text, '{p}') as whole, regexp_extract_all(text, '{p}', {g}) as part from d".format(place=i, kind=r.kind, p=patterns[r.kind].replace("'", "''"), g=r.group)
        for i, r in enumerate(RULES)
    )
    least = "case kind " + " ".join(f"when '{k}' then {v}" for k, v in LEAST.items()) + " else 0 end"
    return f"""
with d as (select row_number() over () as id, doc_id, coalesce(text, '') as text from {docs}), r as ({per}
), m as (
  select id, place, kind, i, length(gaps[i]) as gap, whole[i] as whole, part[i] as part from (select *, unnest(range(1, len(whole) + 1)) as i from r)
), s as (
  select *, sum(gap + length(whole)) over (partition by id, place order by i) - length(whole) as a, sum(gap + length(whole)) over (partition by id, place order by i) as b from m
), f as (
  select id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
         string_agg(kind || ':' || a::bigint || ':' || b::bigint, ',' order by a, place) filter (place < {len(BASE)}) as base, string_agg(kind || ':' || a::bigint || ':' || b::bigint, ',' order by a, place) as spans
  from s where length(part) >= {least} group by id
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join f using (id)
"""
