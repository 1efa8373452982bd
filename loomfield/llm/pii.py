"""Personal data: generous candidates, boosted trees over their format and context, calibrated thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, fresh, staged
from .spans import Rule, joined_spans, matches, text_key

#: The candidates. Runs are possessive and start at their first character, so long runs take linear
#: time; each finds what the plain form would. The first four are the base kinds.
RULES = [
    Rule("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Rule("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    Rule("card", r"[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9](?:[\x20-]?[0-9]){11}"),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    Rule("local_phone", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"),
    Rule("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    Rule("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
]
BASE = ("email", "ip", "card", "phone")
#: Quick test of a text that a match of any rule implies: ip, card, local_phone and ssn have three digits near each other.
ANY = r"@|\+[0-9]|[A-Z]{2}[0-9]{2}|[0-9][^0-9]{0,3}[0-9][^0-9]{0,3}[0-9]"
#: Words near a candidate that speak for or against it. They label candidates and are no features.
FOR = r"(?i)\b(?:e-?mail|mail|phone|tel|mobile|cell|call|fax|contact|card|visa|account|iban|ssn|social|ip|address|host|from)\b"
AGAINST = r"(?i)(?:\b(?:version|ver|build|release|id|ref|isbn|sku|order|invoice|total|page|rev)\b|[$#=])"
CONTEXT = 24
#: Rounds of boosting, step, depth of two, and the share of true candidates above which a calibrated score redacts.
ROUNDS, STEP, PRECISION = 30, 0.3, 0.95
#: Candidates that the curve of all kinds counts for in a kind's own: few candidates follow it, many outweigh it, without a step.
PRIOR = 20
FEATURES = ("clean_left", "clean_right", "separated", "usual_length", "varied", "lettered", "digits_left", "digits_right")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda a, i: a + F.when((n - i) % 2 == 1, F.get(F.array(*[F.lit(2 * d - 9 * (d > 4)) for d in range(10)]), F.substring(digits, i, F.lit(1)).cast("int"))).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return F.when(n > 0, total % 10 == 0).otherwise(False)


def valid(kind: Column, whole: Column) -> Column:
    """The kind's own test of a candidate; for base kinds the definition of a base span."""
    d = _digits(whole)
    octet = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")), F.lit(0)) <= 255)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", F.forall(F.split(whole, r"\."), octet))
        .when(kind == "card", F.length(d).between(12, 19) & luhn(d))
        .when(kind == "phone", F.length(d).between(9, 15))
        .when(kind == "local_phone", d.rlike("^[2-9][0-9]{2}[2-9]"))
        .when(kind == "ssn", ~d.rlike("^(?:000|666|9)|^...00|0000$"))
        .otherwise(_iban(whole))
    )


def _iban(whole: Column) -> Column:
    """ISO 13616: the rearranged number, letters as two digits, leaves 1 modulo 97."""
    x = F.regexp_replace(whole, " ", "")
    y = F.concat(F.substr(x, F.lit(5)), F.left(x, F.lit(4)))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(y, "(?<=.)(?=.)"), F.lit(0), step) == 1


def candidates(texts: DataFrame) -> DataFrame:
    """All candidates with features of form and surroundings as bits of ``mask``, ``ok`` (the kind's own test) and ``label``.

    The label is a vote that no feature repeats: a word against makes it false; else a word for, or the own test, makes it true.
    """
    c = matches(texts, RULES, CONTEXT)
    d = _digits(F.col("whole"))
    c = c.where((F.col("kind") != "card") | F.length(d).between(12, 19))
    usual = {"email": (0, 6), "ip": (4, 12), "card": (15, 16), "phone": (10, 13), "local_phone": (10, 10), "ssn": (9, 9), "iban": (12, 28)}
    span = reduce(lambda a, k: F.when(F.col("kind") == k, F.length(d).between(*usual[k])).otherwise(a), usual, F.lit(False))
    seen = {
        "clean_left": (F.col("before") == "") | F.col("before").rlike(r"[\s(\[<\"',;:|]$"),
        "clean_right": (F.col("after") == "") | F.col("after").rlike(r"^(?:[\s)\]>\"',;:|!?]|\.(?:\s|$)|\*|%|#|&|\$)"),
        "separated": F.col("whole").rlike(r"[\x20()-]"), "usual_length": span,
        "varied": F.size(F.array_distinct(F.split(d, ""))) > 3, "lettered": F.col("whole").rlike("[A-Za-z]"),
        "digits_left": F.col("before").rlike("[0-9]"), "digits_right": F.col("after").rlike("[0-9]"),
    }
    mask = reduce(lambda a, b: a + b, [F.when(seen[f], 1 << i).otherwise(0) for i, f in enumerate(FEATURES)])
    c = c.withColumn("mask", mask.cast("int")).withColumn("ok", F.coalesce(valid(F.col("kind"), F.col("whole")), F.lit(False)))
    return c.withColumn("label", ~F.col("before").rlike(AGAINST) & (F.col("ok") | F.col("before").rlike(FOR)))


def boosted(table: list[tuple[int, int, int, int]], kept_out: list[tuple[int, int, int, int]] | None = None):
    """Gradient boosting with logistic loss over (place, mask, n, n_true): trees of two levels of yes-no splits.

    The table has a row for each kind and mask at most, so it is small whatever the corpus. Splits ask for a bit of
    the mask or for a kind. Returns (start, trees, thresholds); a tree is (split, (split, no, yes), (split, no, yes)).
    Thresholds are calibrated on ``kept_out``, rows that no tree was fitted to (on the table itself where none are given).
    A kind's shares are shrunk toward those of all kinds at the same score, which count for PRIOR candidates; without any
    candidate to calibrate on, the threshold is the score of PRECISION.
    """
    from math import exp, log

    asks = [("bit", i) for i in range(len(FEATURES))] + [("place", i) for i in range(len(RULES))]
    answer = lambda ask, row: bool(row[1] >> ask[1] & 1) if ask[0] == "bit" else row[0] == ask[1]
    n, pos = sum(r[2] for r in table), sum(r[3] for r in table)
    start = log((pos + 1) / (n - pos + 1))
    score = {(r[0], r[1]): start for r in table}

    def leaf(rows):
        g = h = 0.0
        for r in rows:
            p = 1 / (1 + exp(-score[r[0], r[1]]))
            g, h = g + r[3] - r[2] * p, h + r[2] * p * (1 - p)
        return g, h

    def best(rows):
        top = (0.0, None, 0.0, 0.0)
        for ask in asks:
            yes = [r for r in rows if answer(ask, r)]
            no = [r for r in rows if not answer(ask, r)]
            (g1, h1), (g0, h0) = leaf(yes), leaf(no)
            gain = g1 * g1 / (h1 + 1) + g0 * g0 / (h0 + 1)
            if gain > top[0] + 1e-9:
                top = (gain, ask, STEP * g0 / (h0 + 1), STEP * g1 / (h1 + 1))
        return top

    trees = []
    for _ in range(ROUNDS if table else 0):
        _, ask, _, _ = best(table)
        if ask is None:
            break
        sides = []
        for side in (False, True):
            rows = [r for r in table if answer(ask, r) is side]
            _, inner, no, yes = best(rows) if rows else (0, None, 0.0, 0.0)
            sides.append((inner or ask, no, yes))
        trees.append((ask, *sides))
        for r in table:
            inner, no, yes = sides[answer(ask, r)]
            score[r[0], r[1]] += yes if answer(inner, r) else no

    def scored(r) -> float:
        out = start
        for ask, *sides in trees:
            inner, no, yes = sides[answer(ask, r)]
            out += yes if answer(inner, r) else no
        return out

    kept_out = table if kept_out is None else kept_out

    def pooled(rows) -> list[list[float]]:
        # isotonic calibration of (score, n, n_true): neighbours in score pool until the share of true candidates rises with the score
        pools: list[list[float]] = []
        for low, k, t in sorted(rows):
            pools.append([low, k, t])
            while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
                _, k, t = pools.pop()
                pools[-1][1] += k
                pools[-1][2] += t
        return pools

    def threshold(pools, above: float = float("-inf")) -> float:
        """Lowest score of share PRECISION; if no pool has it, that of the model's own share, above all scores that were calibrated."""
        good = [p[0] for p in pools if p[2] >= PRECISION * p[1] - 1e-9]
        return good[0] if good else max(log(PRECISION / (1 - PRECISION)), above + 1e-6)

    every = pooled((scored(r), r[2], r[3]) for r in kept_out)
    share = lambda x: next((t / k for low, k, t in reversed(every) if low <= x), every[0][2] / every[0][1])
    thresholds: dict[int, float] = {}
    for place in range(len(RULES)):
        rows = [(scored(r), r[2], r[3]) for r in kept_out if r[0] == place]
        own = sum(k for _, k, _ in rows)
        if rows:
            shrunk = pooled((x, k + PRIOR * k / own, t + PRIOR * k / own * share(x)) for x, k, t in rows)
            thresholds[place] = threshold(shrunk, max(x for x, _, _ in rows))
        else:
            thresholds[place] = threshold(every)
    return start, trees, thresholds


def _score(start: float, trees) -> Column:
    asked = lambda ask: F.col("mask").bitwiseAND(F.lit(1 << ask[1])) != 0 if ask[0] == "bit" else F.col("place") == ask[1]
    side = lambda s: F.when(asked(s[0]), F.lit(s[2])).otherwise(F.lit(s[1]))
    return reduce(lambda a, t: a + F.when(asked(t[0]), side(t[2])).otherwise(side(t[1])), trees, F.lit(start))


def find(docs: DataFrame) -> DataFrame:
    """(blob, spans) for every distinct text of ``docs`` (text) with personal data; spans hold (start, place, kind, end).

    Candidates that pass their kind's test always stay, however few the table holds. Others stay where their calibrated
    score redacts: the trees learn, over the candidates of half of the texts, what form and surroundings the ones have
    that words near them or their test speak for; over the other half, isotonic calibration turns scores to shares, and a
    kind's threshold is the lowest score of share PRECISION, the kind's shares shrunk toward those of all kinds. An added span that a base span or an earlier added one overlaps goes.

    Defined results: a null text counts as empty; empty texts and texts without a candidate have no row; repeated texts
    are one text, found in and learnt from once; an empty table gives no rows; other columns are ignored.
    """
    texts = docs.select(text_key(F.col("text")).alias("blob"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.where(F.col("text").rlike(ANY)).dropDuplicates(["blob"]).withColumn("todo", F.array(*[F.lit(r.kind) for r in RULES]))
    c = staged(candidates(texts).select("blob", "place", "kind", "start", "end", "mask", "ok", "label"), "pii")
    half = F.col("blob").rlike("^[0-7]").alias("half")  # of the texts, by content
    counted = c.groupBy(half, "place", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("label").alias("t")).orderBy("place", "mask").collect()
    start, trees, thresholds = boosted(*[[tuple(r)[1:] for r in counted if r["half"] is side] for side in (True, False)])
    limit = reduce(lambda a, kv: F.when(F.col("place") == kv[0], F.lit(kv[1])).otherwise(a), thresholds.items(), F.lit(None).cast("double"))
    base = F.col("ok") & (F.col("place") < len(BASE))
    c = c.withColumn("base", base).withColumn("score", _score(start, trees)).where(F.col("ok") | F.coalesce(F.col("score") >= limit - 1e-9, F.lit(False)))
    order = Window.partitionBy("blob").orderBy("start", "place")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    base_end, base_start = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    clash = (F.coalesce(F.max(base_end).over(before), F.lit(-1)) > F.col("start")) | (F.coalesce(F.min(base_start).over(after), F.col("end")) < F.col("end"))
    c = c.withColumn("__clash", clash).where(F.col("base") | ~F.col("__clash"))
    c = c.withColumn("__late", F.coalesce(F.max("end").over(before), F.lit(-1)) > F.col("start")).where(F.col("base") | ~F.col("__late"))
    kind = F.when(F.col("base") | (F.col("place") >= len(BASE)), F.col("kind")).otherwise(F.concat("kind", F.lit("_like")))
    return c.groupBy("blob").agg(F.collect_list(F.struct("start", "place", kind.alias("kind"), "end")).alias("spans"))


def redact(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``docs`` with personal data in text replaced by [KIND]; overlapping spans become one, named by the first.

    Null texts stay null; other columns, doc_id included, pass through, with n_chars (if there) recounted.
    """
    found = bounded(staged(find(docs) if found is None else found, "pii-found"))
    row, columns = fresh(docs, "row"), docs.columns  # the row travels in one column: its names cannot clash
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias(row), F.col("text"), *([F.col("n_chars")] if "n_chars" in columns else []))
    held = docs.withColumn("__blob", text_key(F.col("text"))).join(found.withColumnsRenamed({"blob": "__blob", "spans": "__spans"}), "__blob", "left")
    kind = "array<struct<start:bigint,end:bigint,kind:string>>"
    joined = F.aggregate(
        F.sort_array("__spans"), F.array().cast(kind),
        lambda a, s: F.when((F.size(a) > 0) & (F.coalesce(F.get(a, F.size(a) - 1)["end"], F.lit(-1)) > s["start"]), F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.get(a, F.size(a) - 1)["start"].alias("start"), F.greatest(F.get(a, F.size(a) - 1)["end"], s["end"]).alias("end"), F.get(a, F.size(a) - 1)["kind"].alias("kind")))).cast(kind)).otherwise(F.concat(a, F.array(F.struct(s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end"), s["kind"].alias("kind")))).cast(kind)),
    )
    held = held.withColumn("__spans", joined)
    text = F.col("text").cast("string")
    part = F.transform("__spans", lambda s, i: F.concat(F.substr(text, (F.coalesce(F.get("__spans", i - 1)["end"], F.lit(0)) + 1).cast("int"), (s["start"] - F.coalesce(F.get("__spans", i - 1)["end"], F.lit(0))).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    tail = F.substr(text, (F.get("__spans", F.size("__spans") - 1)["end"] + 1).cast("int"))
    new = F.when(F.col("text").isNull() | F.col("__spans").isNull(), F.col("text")).otherwise(F.concat(F.array_join(part, ""), tail))
    out = held.withColumn("text", new)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return out.select(*[F.col(c) if c in ("text", "n_chars") else F.col(row).getField(c).alias(c) for c in columns])


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Defined results: a null text counts as empty; texts without personal data have no spans; copies get the same."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = staged(find(docs), "pii-found")  # a join of plain tables: Spark can split the copies of a hot text
    held = docs.select("doc_id", text_key(F.col("text")).alias("blob")).join(found, "blob", "left")
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return held.select("doc_id", *[count(k) for k in BASE], F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(spans).alias("spans"))
