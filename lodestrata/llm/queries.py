"""The subpackage's registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import audit, bpe, chat, decontam, langid, lexical, mixing, neardup, neighbours, quality, secrets, tokencount, urlfilter
from lodestrata.llm.shared import table

#: The rules that op10 applies (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine and, being part of a library, on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found_secrets(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tokencount.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    return got.select("doc_id", "n_tokens", "n_pretokens")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ratings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Lines of raw transcripts: each conversation in one of four marker styles, one turn in eight without its marker."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    name = F.when(style == 1, F.element_at(F.create_map(*[F.lit(x) for x in ("system", "Instructions", "user", "Human", "assistant", "AI")]), F.col("role"))).otherwise(F.initcap("role"))
    marker = F.when(style < 2, F.concat(name, F.lit(": "))).when(style == 2, F.concat(F.lit("### "), name, F.lit("\n"))).otherwise(F.concat(F.lit("["), name, F.lit("] ")))
    marker = F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0, "").otherwise(F.coalesce(marker, F.lit("")))
    whole = F.split(F.concat(marker, F.coalesce("text", F.lit(""))), "\n")
    return conversations.select("conv_id", "turn", F.posexplode(whole).alias("line", "text"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return chat.rendered(chat.roles(transcripts(conversations), model=chat.fit(conversations))).drop("content")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), reach(node, other) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT doc_id, n AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM sizes JOIN reach ON node = doc_id GROUP BY doc_id, n
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 100 = 0"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


OP10_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(r_host, r_path, r_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fit AS (
  SELECT p.page_id, p.host, p.path, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r_host) + length(r_path) DESC NULLS LAST) AS n
  FROM parts p LEFT JOIN rules ON (p.host = r_host OR ends_with(p.host, '.' || r_host)) AND starts_with(p.path, r_path)
)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM fit WHERE n = 1
"""

def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), docs AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_terms FROM docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), spread AS (SELECT doc_id, n, unnest(w) AS term FROM docs),
held AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM spread SEMI JOIN asked USING (term) GROUP BY doc_id, n, term),
weights AS (SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, totals GROUP BY term, all_docs),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * all_docs) // all_terms))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id
), ranked AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select("doc_id", "size", "source_size", "target", "taken")


OP12_SQL = r"""
WITH sized AS (
  SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS stop FROM sized GROUP BY source),
ranked AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w FROM per),
summed AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
         coalesce(sum(stop) OVER (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops,
         coalesce(sum(w) OVER (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws
  FROM ranked
), flagged AS (SELECT *, (total - stops) * w > stop * (all_w - ws) AS above FROM summed),
ends AS (SELECT coalesce(sum(stop) FILTER (WHERE above), 0) AS given, coalesce(sum(w) FILTER (WHERE NOT above), 1) AS weighing FROM flagged),
targets AS (
  SELECT source, source_size, CASE WHEN above THEN stop::DOUBLE ELSE least((total - given)::DOUBLE * w / weighing::DOUBLE, stop::DOUBLE) END AS target FROM flagged, ends
), rates AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM targets)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('lodestrata mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS id FROM docs GROUP BY t),
told AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cut AS (
  SELECT docs.doc_id, part, t, coalesce(docs.doc_id > firsts.id, false) AS again, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w
  FROM docs JOIN firsts USING (t) LEFT JOIN told ON told.doc_id = docs.doc_id
), masks AS (
  SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * again::INT AS mask, good, toxic, count(*) AS n
  FROM cut GROUP BY ALL
), letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, (SELECT unnest(range(1, 6))::INT AS step)
), sums AS (
  SELECT part, filter_order, step, own,
         sum(n * (mask & (before | own) = 0)::INT)::BIGINT AS kept, sum(n * (mask & before = 0 AND mask & own <> 0)::INT)::BIGINT AS removed,
         sum(n * (mask & before <> 0 AND mask & own <> 0)::INT)::BIGINT AS redundant, sum(n * (mask = own)::INT)::BIGINT AS unique_fails,
         sum(n * good * (mask & before = 0 AND mask & own <> 0)::INT)::BIGINT AS good_lost,
         sum(n * toxic * (mask & before = 0 AND mask & own <> 0)::INT)::BIGINT AS toxic_lost
  FROM steps, masks GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM sums
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_quality": op4_quality,
    "op5_chat_format": op5_chat_format,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_bpe": op7_bpe,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_language_id": op9_language_id,
    "op10_url_filter": op10_url_filter,
    "op11_lexical_search": op11_lexical_search,
    "op12_mixing": op12_mixing,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL: dict[str, str] = {"op6_near_duplicates": OP6_SQL, "op10_url_filter": OP10_SQL, "op11_lexical_search": OP11_SQL, "op12_mixing": OP12_SQL, "op13_filter_audit": OP13_SQL}
