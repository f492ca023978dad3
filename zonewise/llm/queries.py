"""The queries of this subpackage, each with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, colloc, decontam, jaccard, langid, lm, quality, rans, secretscan, toxicity, urlfilter, vqcodes, warc
from .store import Scratch, table

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"
PLAIN_TOKENIZER = "byte_bpe_50k.json"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), scratch.path("archives"), scratch)
    return warc.read_pages(spark, scratch.path("archives"), scratch)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict_languages(docs, langid.train(docs))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "jaccard"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    n_items, n_matches = (F.size(c).cast("bigint").alias(f"n_{c}") for c in ("items", "matches"))
    longest = F.coalesce(F.array_max(F.col("matches.length")), F.lit(0)).alias("longest_match")
    return found.select("doc_id", "n_words", "n_hit", n_items, digest, "contaminated", n_matches, longest)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), Scratch(spark, "quality"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(MULTI_RANKS), public_tokenizers.PATTERN)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), Scratch(spark, "lm"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.through_files(table(spark, sf_dir, "documents"), public_tokenizers.path(PLAIN_TOKENIZER), Scratch(spark, "rans"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vqcodes.compress(table(spark, sf_dir, "embeddings"), Scratch(spark, "vectors"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return colloc.Collocations(table(spark, sf_dir, "documents"), Scratch(spark, "collocations")).best()


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


OP4_SQL = r"""
WITH cut AS (
    SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
    SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
    FROM cut
), judged AS (
    SELECT *, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
    FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""

def _op11_sql() -> str:
    """Six rounds, each a pair of common tables: nearest entries, then the entries' floors of means."""
    rounds = []
    for r in range(vqcodes.ROUNDS + 1):
        rounds.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, min(d * 16 + k) AS m FROM (SELECT vec_id, p, k, sum((x - y) * (x - y)) AS d FROM comp JOIN b{r} USING (p, j) GROUP BY ALL) GROUP BY ALL)")
        if r < vqcodes.ROUNDS:
            rounds.append(f"s{r} AS (SELECT p, m % 16 AS k, j, sum(x) AS s, count(*) AS n FROM comp JOIN a{r} USING (vec_id, p) GROUP BY ALL)")
            rounds.append(f"b{r + 1} AS MATERIALIZED (SELECT p, k, j, CAST(coalesce((s - (s % n + n) % n) // n, y) AS BIGINT) AS y FROM b{r} LEFT JOIN s{r} USING (p, k, j))")
    last = vqcodes.ROUNDS
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comp AS MATERIALIZED (SELECT vec_id, i // w AS p, i % w AS j, CAST(floor(4096 * CAST(e[i + 1] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT vec_id, e, len(e) // 8 AS w, unnest(range(len(e))) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT p, k, j, x AS y FROM comp JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT 16) USING (vec_id)),
{", ".join(rounds)},
coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(m % 16 AS INT)), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a{last} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, k, j)) FROM b{last}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


OP12_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
    SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces
), grams AS (
    SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase FROM worded, range(1, 5) t(size)
), counted AS MATERIALIZED (
    SELECT lang, phrase, size, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), totals AS (
    SELECT lang, sum(len(ws)) AS n FROM worded GROUP BY ALL
), cuts AS (
    SELECT c.lang, c.phrase, c.a, cut, array_to_string(string_split(c.phrase, ' ')[1:cut], ' ') AS head, array_to_string(string_split(c.phrase, ' ')[cut + 1:], ' ') AS tail
    FROM counted c, range(1, 4) t(cut) WHERE cut < size
), scored AS (
    SELECT u.lang, u.phrase, u.a, cut, h.a AS l, t.a AS r, CAST(2000000::HUGEINT * u.a // (h.a + t.a) AS BIGINT) AS score
    FROM cuts u JOIN counted h ON h.lang = u.lang AND h.phrase = u.head JOIN counted t ON t.lang = u.lang AND t.phrase = u.tail
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_ AS (
    SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase, max(a) AS around FROM counted, range(2, 4) s(m), range(1, 4) t(i) WHERE size > m AND i + m - 1 <= size GROUP BY ALL
), left_ AS (
    SELECT b.* FROM lowest b LEFT JOIN inner_ i USING (lang, phrase) WHERE i.around IS NULL OR 100::HUGEINT * i.around < 80::HUGEINT * b.a
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_
) JOIN totals USING (lang) WHERE rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_url_filters": op4_url_filters,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_toxicity": op9_toxicity,
    "op10_token_files": op10_token_files,
    "op11_vector_codes": op11_vector_codes,
    "op12_collocations": op12_collocations,
    "op13_secret_scan": op13_secret_scan,
}

ORACLE_SQL: dict[str, str] = {"op4_url_filters": OP4_SQL, "op11_vector_codes": _op11_sql(), "op12_collocations": OP12_SQL}
