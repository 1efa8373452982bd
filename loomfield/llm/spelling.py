"""Spelling variants: anagram hashing finds words one letter apart, counts decide which of them is the form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged
from .merkle import crc32_sql

#: Letters of a word; only A-Z are lower-cased, so that a word holds a-z and these.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, RATIO, NOISE = 5, 3, 2, 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, noise: int | None = NOISE, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least ``least_letters`` code points that occur at least ``least_count`` times in all texts.

    With ``noise``, a run of letters whose CRC-32 of ``<doc_id>:<run>`` it divides loses one code point first, as a source of
    misspellings. Counts are summed within tasks before the shuffle, so a frequent word is one row for each task.

    Defined results: null and empty texts have no words; a null doc_id is written as nothing; rows that repeat count again;
    an empty table gives no rows; other columns are ignored.
    """
    runs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))).alias("run"))
    word = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    if noise:
        runs = runs.select(word.alias("run"), F.crc32(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), word).cast("binary")).alias("h"))
        place = (F.col("h") % F.length("run")).cast("int")
        runs = runs.select("run", F.when(F.col("h") % noise == 0, place).alias("place"))
        word = F.when(F.col("place").isNull(), F.col("run")).otherwise(F.concat(F.expr("left(run, place)"), F.expr("substring(run, place + 2)")))
    words = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.where(F.when(F.length("word") >= least_letters, F.col("n")) >= least_count)  # one condition: length alone would be tested per occurrence


def letter_value(letter: Column) -> Column:
    """Fifth power of a letter's number: no two sums or differences of two such powers agree, and a gigabyte of letters fits a long."""
    code = F.ascii(letter).cast("long")
    number = F.when(code < 0x7F, code - 0x60).otherwise(code - 0xC0 + 27) + 9
    return number * number * number * number * number


def anagram_key(word: Column) -> Column:
    """Sum of the letters' values: the same for words of the same letters in any order."""
    return F.aggregate(F.transform(F.split(word, ""), letter_value), F.lit(0).cast("long"), lambda a, b: a + b)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), once for each two of ``words`` (word, n; each word once) that one inserted, deleted or replaced code point parts.

    A word gives its key and, for each of its letters, the key without that letter's value. Words whose keys differ by the
    value of a letter meet where one's whole key is the other's without it; words whose keys differ by an exchange meet where
    both are without a letter, so a word gives as many rows as it has letters and never tries an alphabet. The join keeps
    a pair only if the order of its letters agrees as well.
    """
    keyed = words.select("word", "n", F.split("word", "").alias("letters"), anagram_key(F.col("word")).alias("key"))
    less = keyed.select("word", "n", "key", F.explode(F.array_distinct(F.filter("letters", lambda x: x != ""))).alias("letter"))
    less = staged(less.select((F.col("key") - letter_value(F.col("letter"))).alias("key"), "letter", "word", "n").unionByName(keyed.select("key", F.lit("").alias("letter"), "word", "n")), "spelling-keys")
    a = less.where("letter <> ''").select("key", F.col("letter").alias("letter_a"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = less.select("key", F.col("letter").alias("letter_b"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    meet = (F.col("letter_b") == "") | (F.col("letter_a") < F.col("letter_b"))
    pairs = a.join(b, (a["key"] == b["key"]) & meet & (F.levenshtein("a", "b", 1) == 1))
    return pairs.select("a", "n_a", "b", "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: counts at least double on the way, so ways are short, and each round halves them."""
    links = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = staged(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = further.where("moved").limit(1).count()
        dropped(links)
        links = further.drop("moved")
        if not moved:
            return links


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n).

    A word's form is its near word of largest n, ties by code point, if that is at least ``ratio`` times its own n; its root is where
    forms lead. Nothing is gathered by word: the best of its near words is a minimum that sums before the shuffle.

    Defined results: a word without a near word has n_near 0, no form and itself as root; words must not repeat; an empty
    table gives no rows.
    """
    words = staged(words.select("word", "n"), "spelling-words")
    pairs = staged(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("word")).alias("near")).union(pairs.select("b", F.struct((-F.col("n_a")).alias("n"), F.col("a").alias("word"))))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("best"))
    best = words.join(best, "word", "left").withColumn("led", F.coalesce(-F.col("best.n") >= ratio * F.col("n"), F.lit(False)))
    best = staged(best.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("led"), F.col("best.word")).alias("form"), F.when(F.col("led"), -F.col("best.n")).alias("form_n")), "spelling-forms")
    return best.join(_roots(best.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def variants_sql(docs: str = "documents") -> str:
    """DuckDB SQL of op13: words meet by the texts that one deleted letter leaves."""
    return f"""
with recursive runs as (
  select doc_id, unnest(regexp_extract_all(text, '[{LETTERS}]+')) as raw from {docs}
), occurring as (
  select doc_id, translate(raw, '{UPPER}', '{LOWER}') as run, count(*) as n from runs where length(raw) >= {LEAST_LETTERS} group by doc_id, run
), bytes as (
  select run, n, array_to_string(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda c: case when ord(c) < 128 then c else chr(195) || chr(ord(c) - 64) end), '') as said from occurring
), hashed as (
  select run, n, {crc32_sql("said")} as h from bytes
), words as (
  select case when h % {NOISE} = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run) + 2)::bigint) else run end as word, n from hashed
), v as (
  select word, sum(n)::bigint as n from words where length(word) >= {LEAST_LETTERS} group by word having sum(n) >= {LEAST_COUNT}
), cut as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from v)
), near as (
  select a.word, b.word as other, b.n as m from cut a join cut b using (i, rest) where a.word <> b.word
  union select a.word, b.word, b.n from cut a join v b on a.rest = b.word union select b.word, a.word, a.n from cut a join v b on a.rest = b.word
), best as (
  select word, count(*) as n_near, (list(other order by m desc, other))[1] as other, max(m) as m from near group by word
), forms as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when m >= {RATIO} * v.n then other end as form, case when m >= {RATIO} * v.n then m end as form_n from v left join best using (word)
), way(word, last) as (
  select word, word from forms union all select w.word, f.form from way w join forms f on f.word = w.last where f.form is not null
), root as (
  select w.word, w.last as root from way w join forms f on f.word = w.last where f.form is null
)
select word, form, root, n, n_near, form_n from forms join root using (word)
"""
