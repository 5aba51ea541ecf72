"""The ``opN_*`` queries with production parameters, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronolith.llm import bpe, html, mixing, near, phrases, pieces, quality, rules, runs, secrets, substring, tokens, topk
from chronolith.llm.common import documents


def _tokenizer(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.scored(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), *_tokenizer("byte_bpe_50k.json"), limit=512)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(documents(spark, sf_dir), text=False)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, scale=64, every=20)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), *_tokenizer("byte_bpe_multi_50k.tiktoken"), ids=False)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("copies", "pi")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(documents(spark, sf_dir))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir), least=30, limit=2000, share=80)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model")[0], ids=False)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(documents(spark, sf_dir), edit=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for n, f in globals().items() if n.startswith("op") and callable(f)]
    return {f.__name__: f for f in found} | _pipeline()


def _pipeline() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run}


_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]"

_OP3 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
p AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM w WHERE len(w) >= 50)),
f AS (SELECT win, min(doc_id) AS first FROM p GROUP BY 1),
g AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(k, k + 50)) AS i FROM p JOIN f USING (win) WHERE first < doc_id) GROUP BY 1),
x AS (SELECT w.doc_id, w, coalesce(gone, []::BIGINT[]) AS gone FROM w LEFT JOIN g USING (doc_id)),
i AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, gone, unnest(range(1, len(w) + 1)) AS i FROM x) WHERE NOT list_contains(gone, i)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM i GROUP BY 1)
SELECT x.doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM x LEFT JOIN k USING (doc_id)"""

_OP4 = """WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= 20"""

_OP8 = f"""WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce('=' || source, 'null') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
p AS (SELECT row, k, w[k:k + 2] AS tri FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS k FROM t WHERE len(w) >= 3)),
a AS (SELECT row, count(DISTINCT i) AS n FROM (SELECT row, unnest([k, k + 1, k + 2]) AS i FROM p QUALIFY count(*) OVER (PARTITION BY row, tri) > 1) GROUP BY 1),
l AS (SELECT row, host, text, line FROM (SELECT row, host, text, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '{_WORD}')),
d AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM l GROUP BY 1),
n AS (SELECT row, host, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '{_SPACE}+', ' ', 'g'), ' ') AS norm, len(regexp_extract_all(line, '{_WORD}')) AS words FROM l),
o AS (SELECT host, norm FROM n GROUP BY host, norm HAVING count(DISTINCT row) > 10),
g AS (SELECT row, sum(words) AS n FROM n JOIN o USING (host, norm) GROUP BY 1),
x AS (SELECT t.doc_id, len(t.w)::BIGINT AS n_words, length(regexp_replace(t.text, '{_SPACE}', '', 'g'))::BIGINT AS word_chars, (length(t.text) - length(regexp_replace(t.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(a.n, 0)::BIGINT AS n_repeat_words, coalesce(g.n, 0)::BIGINT AS n_removed
  FROM t LEFT JOIN a USING (row) LEFT JOIN d USING (row) LEFT JOIN g USING (row))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed >= 0.5 * n_words AS kept FROM x"""


_OP11 = """WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
g AS (SELECT lang, w[i:i + k - 1] AS p, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(k) WHERE len(w) >= k) GROUP BY 1, 2),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE len(p) = 1 GROUP BY 1),
f AS (SELECT * FROM g WHERE f >= 30),
c AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1),
s AS (SELECT c.lang, c.p, a, l.f AS l, r.f AS r, k, (2000000 * a::HUGEINT // (l.f + r.f))::BIGINT AS score FROM c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN f r ON r.lang = c.lang AND r.p = c.p[k + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
i AS (SELECT lang, p[j:j + m - 1] AS p, max(f) AS longer FROM (SELECT lang, p, f, m, unnest(range(1, len(p) - m + 2)) AS j FROM f, (VALUES (2), (3)) v(m) WHERE len(p) > m) GROUP BY 1, 2),
k AS (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN i ON i.lang = b.lang AND i.p = b.p WHERE longer IS NULL OR 100 * longer < 80 * a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT t.lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the whole query: not models, tokenizers, sampling by hash, HTML or spans of patterns."""
    return {"op3_substring_dedup": _OP3, "op4_top_k": _OP4, "op8_quality_rules": _OP8, "op11_phrase_collocations": _OP11}
