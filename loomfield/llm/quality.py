"""Quality rules whose limits come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, let, staged, words_of

#: Metric -> (slack above the fence, whether low values are odd too). All metrics are whole numbers.
METRICS = {"symbols": (40, False), "dup_lines": (350, False), "repeats": (260, False), "capitals": (120, False), "word_length": (120, True)}
#: Metrics that are not shares.
OPEN = ("word_length",)
#: A fence stands FENCE times the spread of the half on the other side of the median beyond it, so that odd documents, a
#: third of a group or more, do not move it; a metric in parts of TOP is fenced at half its way from the median at most.
FENCE, TOP = 8, 1000
#: Groups with fewer documents take the sketch of their language, then that of all documents.
LEAST_DOCS = 200
#: Exact buckets below this; above, this many buckets for each power of two.
STEPS = 16
#: Positions fit beside a hash in one long up to this many words; longer texts take a slower path with the same result.
PACKED = 1 << 20


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, the first occurrence included.

    Packs 44 bits of each window's hash over its position, sorts primitive longs, and compares neighbours' words,
    so only true repeats count. Texts with unlike windows of one hash, or of PACKED words or more, sort (window,
    position) pairs instead; the result is the same.
    """

    def window(w: Column, i: Column) -> Column:
        return F.struct(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def covered(starts: Column) -> Column:
        last = F.size(starts) - 1
        return F.aggregate(
            F.transform(starts, lambda x, i: F.when(i < last, F.least(F.lit(3), F.get(starts, i + 1) - x)).otherwise(3)),
            F.lit(0).cast("long"), lambda a, x: a + x,
        )

    def repeated(w: Column, ordered: Column, at, same) -> Column:
        """Positions whose window equals a neighbour's in hash order."""
        last = F.size(ordered) - 1

        def near(x: Column, j: Column, ok: Column) -> Column:
            other = F.get(ordered, j)
            return ok & same(x, other) & (window(w, at(x)) == window(w, at(other)))

        hit = F.filter(ordered, lambda x, i: near(x, i - 1, i > 0) | near(x, i + 1, i < last))
        return F.sort_array(F.transform(hit, at))

    def full(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(window(w, i).alias("w"), i.alias("i")))
        return let(F.sort_array(keys), lambda k: let(repeated(w, k, lambda x: x["i"], lambda x, y: F.lit(True)), covered))

    def packed(w: Column) -> Column:
        keys = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.shiftleft(F.shiftright(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 20), 20).bitwiseOR(i.cast("long")),
        )
        at = lambda x: x.bitwiseAND(F.lit(PACKED - 1)).cast("int")
        same = lambda x, y: F.shiftright(x, 20) == F.shiftright(y, 20)

        def count(k: Column) -> Column:
            clash = F.filter(k, lambda x, i: (i > 0) & same(x, F.get(k, i - 1)) & (window(w, at(x)) != window(w, at(F.get(k, i - 1)))))
            return F.when(F.size(clash) > 0, full(w)).otherwise(let(repeated(w, k, at, same), covered))

        return let(F.sort_array(keys), count)

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).when(F.size(words) < PACKED, packed(words)).otherwise(full(words))


def bucket_of(value: Column) -> Column:
    """Bucket of a whole number in the log-linear sketch: exact below STEPS, then STEPS buckets for each power of two."""
    shift = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.when(value < STEPS, value).otherwise(shift * STEPS + F.floor(value / F.pow(F.lit(2.0), shift))).cast("int")


def bucket_top(bucket: Column) -> Column:
    """Largest value of a bucket."""
    shift = F.greatest(F.floor(bucket / STEPS) - 1, F.lit(0))
    return F.when(bucket < 2 * STEPS, bucket.cast("long")).otherwise(((bucket - shift * STEPS + 1) * F.pow(F.lit(2.0), shift) - 1).cast("long"))


def features(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the metrics in whole numbers."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    df = docs.withColumn("__words", words_of(F.col("text"))).withColumn("__lines", lines)
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "__n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("__words")),
        "__capitals": (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
    }).drop("__words", "__lines")
    per = lambda a, b, k=1000: F.when(F.col(b) > 0, F.floor(F.col(a) * k / F.col(b))).otherwise(0).cast("long")
    return df.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "m_symbols": per("n_symbols", "word_chars"), "m_dup_lines": per("n_dup_lines", "__n_lines"), "m_repeats": per("n_repeat_words", "n_words"),
        "m_capitals": per("__capitals", "word_chars"), "m_word_length": per("word_chars", "n_words", 100),
    }).drop("__n_lines", "__capitals")


def sketches(feats: DataFrame) -> DataFrame:
    """Bucket counts per (lang, source, metric): partial sums merge by addition, at any level of grouping."""
    long = feats.where(F.col("n_words") >= 50).select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket_of(F.col(f"m_{m}")).alias("bucket")) for m in METRICS])).alias("x")
    )
    return long.groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def limits(sketch: DataFrame) -> DataFrame:
    """Per (lang, source): lo_ and hi_ of each metric, from the smallest level with LEAST_DOCS documents.

    The upper fence stands on the median and the spread below it, the lower one on the median and the spread above.
    """

    def quartiles(df: DataFrame, keys: list[str]) -> DataFrame:
        merged = df.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n")).groupBy(*keys, "metric").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("hist"))
        total = F.aggregate("hist", F.lit(0).cast("long"), lambda a, x: a + x["n"])

        def at(share: int) -> Column:  # value of rank ceil(total * share / 4), by buckets in order
            start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("bucket"))
            step = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["bucket"].isNull() & (4 * (a["seen"] + x["n"]) >= share * F.col("docs")), x["bucket"]).otherwise(a["bucket"]).alias("bucket"))
            return F.aggregate("hist", start, step)["bucket"]

        return merged.withColumn("docs", total).select(*keys, "metric", "docs", *[bucket_top(at(i)).alias(f"q{i}") for i in (1, 2, 3)])

    near, wide, every = quartiles(sketch, ["lang", "source"]), quartiles(sketch, ["lang"]), quartiles(sketch, [])
    every = every.select("metric", *[F.col(f"q{i}").alias(f"e{i}") for i in (1, 2, 3)])  # one row for each metric
    wide = wide.select(F.col("lang").alias("__lang"), F.col("metric").alias("__metric"), F.col("docs").alias("wdocs"), *[F.col(f"q{i}").alias(f"w{i}") for i in (1, 2, 3)])
    df = near.join(wide, F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("metric") == F.col("__metric"))).join(F.broadcast(every), "metric")
    pick = lambda i: F.when(F.col("docs") >= LEAST_DOCS, F.col(f"q{i}")).when(F.col("wdocs") >= LEAST_DOCS, F.col(f"w{i}")).otherwise(F.col(f"e{i}"))
    df = df.withColumns({"a": pick(1), "b": pick(2), "c": pick(3)})
    slack = F.create_map(*[F.lit(x) for m, (s, _) in METRICS.items() for x in (m, s)])[F.col("metric")]
    high = F.col("b") + FENCE * (F.col("b") - F.col("a")) + slack
    high = F.when(F.col("metric").isin(*OPEN), high).otherwise(F.least(high, F.floor((F.col("b") + TOP) / 2)))
    df = df.withColumn("hi", high).withColumn("lo", F.col("b") - FENCE * (F.col("c") - F.col("b")) - slack)
    return df.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col(k))).alias(f"{k}_{m}") for m in METRICS for k in ("lo", "hi")])


def judge(docs: DataFrame) -> DataFrame:
    """Add the counts of ``features`` and ``kept`` to every row of ``docs`` (text, lang, source, ...).

    A document is kept when it passes the base rules and no metric lies beyond its group's fence. The features are
    staged once in the shared folder; sketches are summed from them, and limits joined back.

    Defined results: null and blank texts have no words and fail the base rules; null languages and sources are
    groups of their own; groups that the sketches lack (only short texts) keep what the base rules keep; repeated
    rows are judged alike; an empty table gives no rows; columns named like an added one are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[f"m_{m}" for m in METRICS]]
    held = _held(docs, [c for c in docs.columns if c.lower() not in made])
    return _judged(staged(features(held).drop("text"), "quality")).select("row.*", *made)


def _held(docs: DataFrame, columns: list[str]) -> DataFrame:
    """What the rules read, and the row in one column, so that its names cannot clash."""
    return docs.select("text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``judge`` keeps, with their own columns only, whatever their names."""
    return _judged(staged(features(_held(docs, docs.columns)).drop("text"), "quality")).where("kept").select("row.*")


def _judged(feats: DataFrame) -> DataFrame:
    limit = staged(limits(sketches(feats)), "quality-limits")
    limit = limit.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    df = feats.join(bounded(limit), F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    odd = F.lit(False)
    for m, (_, low) in METRICS.items():
        odd = odd | F.coalesce(F.col(f"m_{m}") > F.col(f"hi_{m}"), F.lit(False))
        if low:
            odd = odd | F.coalesce(F.col(f"m_{m}") < F.col(f"lo_{m}"), F.lit(False))
    return df.withColumn("kept", ~F.col("base_failed") & ~odd).drop("__lang", "__source", *[f"{k}_{m}" for m in METRICS for k in ("lo", "hi")])


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[f"m_{m}" for m in METRICS]]
    return judge(docs).select(*cols)


def quality_sql(docs: str = "documents") -> str:
    """DuckDB SQL of op2 over ``docs`` (doc_id, text, lang, source)."""
    metrics = list(METRICS)
    slack = "case metric " + " ".join(f"when '{m}' then {s}" for m, (s, _) in METRICS.items()) + " end"
    odd = " or ".join([f"coalesce(m_{m} > hi_{m}, false)" for m in metrics] + [f"coalesce(m_{m} < lo_{m}, false)" for m, (_, low) in METRICS.items() if low])
    high = lambda m: f"b + {FENCE} * (b - a) + {slack}" if m in OPEN else f"least(b + {FENCE} * (b - a) + {slack}, (b + {TOP}) // 2)"
    bucket = lambda v: f"case when {v} < {STEPS} then {v} else greatest(length(bin({v})) - 5, 0) * {STEPS} + ({v} >> greatest(length(bin({v})) - 5, 0)::int)::bigint end"
    quart = lambda keys: f"""
      select {keys}metric, max(docs) as docs, min(bucket) filter (4 * seen >= docs) as b1, min(bucket) filter (2 * seen >= docs) as b2, min(bucket) filter (4 * seen >= 3 * docs) as b3 from (
        select {keys}metric, bucket, sum(n) over (partition by {keys}metric order by bucket) as seen, sum(n) over (partition by {keys}metric) as docs
        from (select {keys}metric, bucket, sum(n) as n from sk group by {keys}metric, bucket)) group by {keys}metric"""  # noqa: E731
    top = lambda b: f"case when {b} < {2 * STEPS} then {b} else (({b} - ({b} // {STEPS} - 1) * {STEPS} + 1) * (1::bigint << ({b} // {STEPS} - 1)::int) - 1)::bigint end"
    return f"""
with words as (
  select rowid as id, doc_id, lang, source, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls
  from (select *, row_number() over () as rowid from {docs})
), tri as (
  select id, i, [w[i], w[i + 1], w[i + 2]] as t from (select id, w, unnest(range(1, len(w) - 1)) as i from words)
), twice as (
  select id, i from (select id, i, count(*) over (partition by id, t) as c from tri) where c > 1
), rep as (
  select id, sum(least(3, coalesce(nxt - i, 3))) as n from (select id, i, lead(i) over (partition by id order by i) as nxt from twice) group by id
), f0 as (
  select words.id, doc_id, lang, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         coalesce(rep.n, 0)::bigint as n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g'))::bigint as capitals
  from words left join rep using (id)
), f as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         case when word_chars > 0 then n_symbols * 1000 // word_chars else 0 end as m_symbols, case when n_lines > 0 then n_dup_lines * 1000 // n_lines else 0 end as m_dup_lines,
         case when n_words > 0 then n_repeat_words * 1000 // n_words else 0 end as m_repeats, case when word_chars > 0 then capitals * 1000 // word_chars else 0 end as m_capitals,
         case when n_words > 0 then word_chars * 100 // n_words else 0 end as m_word_length
  from f0
), sk as (
  select lang, source, metric, bucket, count(*) as n from (
    {" union all ".join(f"select lang, source, '{m}' as metric, {bucket(f'm_{m}')} as bucket from f where n_words >= 50" for m in metrics)}
  ) group by all
), near as ({quart("lang, source, ")}), wide as ({quart("lang, ")}), every as ({quart("")}
), lim as (
  select n.lang, n.source, n.metric, {", ".join(f"{top(f'(case when n.docs >= {LEAST_DOCS} then n.b{i} when w.docs >= {LEAST_DOCS} then w.b{i} else e.b{i} end)')} as {k}" for i, k in ((1, "a"), (2, "b"), (3, "c")))}
  from near n join wide w on n.lang is not distinct from w.lang and n.metric = w.metric join every e on n.metric = e.metric
), fence as (
  select lang, source, {", ".join(f"max(case when metric = '{m}' then {high(m)} end) as hi_{m}, max(case when metric = '{m}' then b - {FENCE} * (c - b) - {slack} end) as lo_{m}" for m in metrics)}
  from lim group by lang, source
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({odd}) as kept, {", ".join(f"m_{m}" for m in metrics)}
from f left join fence on f.lang is not distinct from fence.lang and f.source is not distinct from fence.source
"""
