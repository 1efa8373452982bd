"""Names, texts, sections and hashes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions import names, text
from loomfield.operators import ingestion
from loomfield.sources.tables import table


#: Phrases and endings that meet every rule of the ladders.
PHRASES = [" exposes_", "extends the ", "Improved by ", "presents a ", "is cited in ", "was tested on ", "Compared to ", "written by ", "x ", "fine_tuned on ", "based on ", "beats "]
ENDINGS = ["", " = x", " et al., 2015", " which is what we want to have in the end here", " as it was written down in a text that ended on the", " set apart here by so many words, one after another, for one long name of things made", " to be led along a very long way so as to predict"]


def fnv1a_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", text.fnv1a(F.col("p_name")).alias("hash"))


def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.content_hash(F.col("source"), F.col("text")).alias("hash"))


def clean_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha1(text.clean_text(F.col("text"))).alias("hash"))


def sections(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").join(table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("total")), "conv_id")
    return turns.select("conv_id", "turn", text.section_of(F.col("text"), F.col("turn"), F.col("total")).alias("section"))


def _phrases(spark: SparkSession, sf: str) -> DataFrame:
    """A phrase for each part: one of PHRASES, then its name."""
    return table(spark, sf, "part").select("p_partkey", F.concat(F.get(F.array(*map(F.lit, PHRASES)), (F.col("p_partkey") % len(PHRASES)).cast("int")), "p_name").alias("phrase"))


def part_roles(spark: SparkSession, sf: str) -> DataFrame:
    said = F.col("phrase")
    return _phrases(spark, sf).select("p_partkey", text.edge_type(said).alias("edge_type"), text.role(said).alias("role"), text.role(said, F.lit(True)).alias("role_in"), text.slugify(said).alias("slug"))


def part_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names judged after an ending by the part's key: whole, a formula, a citation, a clause, cut short, or too long."""
    ending = F.get(F.array(*map(F.lit, ENDINGS)), (F.col("p_partkey") % len(ENDINGS)).cast("int"))
    name = F.concat("p_name", ending)
    says = names.judge_name(name)
    return table(spark, sf, "part").select("p_partkey", says["verdict"].alias("verdict"), says["confidence"].alias("confidence"), says["reason"].alias("reason"), F.size(names.tokens(name)).cast("long").alias("n_tokens"))


def ilike_search(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a search with a total order."""
    return table(spark, sf, "part").where(F.col("p_name").ilike("%a%")).orderBy("p_name", "p_partkey").offset(10).limit(20).select("p_partkey", "p_name")


def text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    found = ingestion.chunks(table(spark, sf, "documents"), "doc_id", "text")
    return found.select("doc_id", "chunk_index", "section", "content_hash")


def hashed_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    found = ingestion.hashed_embedding(table(spark, sf, "part"), "p_partkey", "p_name")
    return found.select("p_partkey", "place", F.round("value", 6).alias("value"))


def _fnv(seed: int) -> str:
    return f"list_reduce(list_prepend({seed}::HUGEINT, list_transform(string_split(f, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


QUERIES = {
    "text_chunks": (text_chunks, None),
    "hashed_embeddings": (hashed_embeddings, f"""WITH w AS (SELECT p_partkey, regexp_extract_all(lower(coalesce(p_name, '')), '[a-z0-9]+') AS w FROM part),
      words AS (SELECT p_partkey, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
      f AS (SELECT p_partkey, x AS f FROM words UNION ALL SELECT p_partkey, '#' || substr(x, k, 3) FROM (SELECT p_partkey, x, unnest(range(1, length(x) - 1)) AS k FROM words WHERE length(x) > 3)
        UNION ALL SELECT a.p_partkey, a.x || '_' || b.x FROM words a JOIN words b ON a.p_partkey = b.p_partkey AND b.i = a.i + 1),
      s AS (SELECT p_partkey, ({_fnv(0x811C9DC5)} % {ingestion.WIDTH})::INTEGER AS place, sum(CASE WHEN {_fnv(ingestion.SIGN_SEED)} % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS s FROM f GROUP BY 1, 2)
      SELECT p_partkey, place, round(sign(s) * sqrt(abs(s)) / sqrt(sum(abs(s)) OVER (PARTITION BY p_partkey)), 6) AS value FROM s WHERE s <> 0
      UNION ALL SELECT p_partkey, 0, 1.0 FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM s WHERE s <> 0)"""),
    "fnv1a_hash": (fnv1a_hash, """SELECT p_partkey, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::HUGEINT)),
      lambda h, c: (xor(h, c) * 16777619) % 4294967296)::BIGINT AS hash FROM part"""),
    "content_hashes": (content_hashes, "SELECT doc_id, sha1(coalesce(source, '') || chr(0) || coalesce(text, '')) AS hash FROM documents"),
    "clean_texts": (clean_texts, """SELECT doc_id, sha1(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '-\\n', '', 'g'),
      '[^\\x00-\\x7F]', ' ', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))) AS hash FROM documents"""),
    "sections": (sections, """SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'abstract' WHEN contains(h, 'introduction') THEN 'introduction' WHEN regexp_matches(h, 'related work|background|prior work') THEN 'related_work'
      WHEN regexp_matches(h, 'method|approach|our model') THEN 'methods' WHEN regexp_matches(h, 'experiment|evaluation|results') THEN 'results' WHEN regexp_matches(h, 'conclusion|discussion|future work') THEN 'conclusion'
      WHEN regexp_matches(h, 'reference|bibliography') THEN 'references' WHEN turn / total < 0.2 THEN 'introduction' WHEN turn / total < 0.6 THEN 'methods' WHEN turn / total < 0.85 THEN 'results' ELSE 'conclusion' END AS section
      FROM (SELECT conv_id, turn, left(lower(text), 500) AS h, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)"""),
    "part_roles": (part_roles, f"""WITH p AS (SELECT p_partkey, ['{"', '".join(PHRASES)}'][p_partkey % {len(PHRASES)} + 1] || p_name AS s FROM part), l AS (SELECT *, trim(s) AS t, lower(s) AS w FROM p),
      r AS (SELECT *, CASE WHEN s = 'mentions' THEN 'covers' WHEN regexp_matches(w, 'introduc|propos|present|contribut') THEN 'contributes' WHEN regexp_matches(w, 'extend|improv|build|fine_tune|based') THEN 'builds_on'
        WHEN regexp_matches(w, 'evaluat|achiev|measur|trained_on|tested') THEN 'validated_on' WHEN regexp_matches(w, 'outperform|compar|beat|versus') THEN 'compared_with' WHEN regexp_matches(w, 'use|comput|appl|requir') THEN 'uses' ELSE 'covers' END AS role FROM l)
      SELECT p_partkey, CASE WHEN regexp_full_match(t, '[a-z][a-z0-9_]*') THEN t WHEN contains(w, 'extend') THEN 'extends' WHEN regexp_matches(w, 'improv|outperform|better than') THEN 'improves' WHEN regexp_matches(w, 'introduc|propos|present') THEN 'introduces'
        WHEN regexp_matches(w, 'cite|referenc') THEN 'cites' WHEN regexp_matches(w, 'evaluat|benchmark|tested on|trained on') THEN 'evaluates_on' WHEN contains(w, 'compar') THEN 'compares_to' WHEN regexp_matches(w, 'author|written by') THEN 'authored_by' ELSE 'uses' END AS edge_type,
        role, CASE role WHEN 'contributes' THEN 'builds_on' WHEN 'builds_on' THEN 'contributes' ELSE role END AS role_in, regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM r"""),
    "part_names": (part_names, f"""WITH p AS (SELECT p_partkey, trim(p_name || ['{"', '".join(ENDINGS)}'][p_partkey % {len(ENDINGS)} + 1]) AS s FROM part),
      j AS (SELECT *, CASE WHEN contains(s, '=') THEN ['drop', 'high', 'formula'] WHEN length(s) > 45 AND regexp_matches(s, '(?i)\\b(we|which|that|when|where|whose|because|while|although|however|therefore|thus|hence)\\b') THEN ['drop', 'high', 'clause']
        WHEN length(s) > 45 AND regexp_matches(s, '(?i)\\b(of|in|on|to|for|with|and|or|the|a|an|at|by|from)$') THEN ['drop', 'high', 'cut short'] WHEN length(s) > 45 AND regexp_matches(s, '(?i)\\bto\\s+\\w+$') THEN ['drop', 'high', 'cut at an infinitive']
        WHEN length(s) > 45 AND regexp_matches(s, '(?i)^(a|an|the)\\s+') THEN ['drop', 'high', 'begins with an article'] WHEN regexp_matches(s, '(?i)\\bet\\s+al\\.?,?\\s*[0-9]{{4}}') THEN ['review', 'medium', 'citation'] WHEN length(s) > 80 THEN ['review', 'low', 'too long'] ELSE ['keep', 'high', 'a name'] END AS v FROM p)
      SELECT p_partkey, v[1] AS verdict, v[2] AS confidence, v[3] AS reason, len(list_filter(regexp_split_to_array(lower(s), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS n_tokens FROM j"""),
    "ilike_search": (ilike_search, "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%' ORDER BY p_name, p_partkey LIMIT 20 OFFSET 10"),
}
