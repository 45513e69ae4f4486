"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarium.llm import decontam, divergence, langid, lm, ngram_join, packing, pieces, prefix_trie, rollup, secrets, sketch, suffix_dedup, wavelet
from planarium.llm._store import new_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(modulus: int) -> F.Column:
    """crc32 of doc_id as text, modulo `modulus`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return wavelet.token_shards(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = langid.train_hierarchy(docs.where(fold(5) != 0))
    out = langid.identify(docs, model)
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_documents(spark, sf_dir))


def op6_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_documents(spark, sf_dir), fold(5) == 1)


def op7_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compared(_documents(spark, sf_dir))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in; those of one fold are counted anew by a second tokenizer, those of another leave."""
    import public_tokenizers

    docs = _documents(spark, sf_dir)
    ledger = rollup.TokenLedger(spark, new_path(spark, "rollup"))
    bytes_, words = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    ledger.commit(1, rollup.count_tokens(docs, "byte_bpe_50k", bytes_).withColumn("op", F.lit("insert")))
    ledger.commit(2, rollup.count_tokens(docs.where(F.col("doc_id") % 10 == 3), "word_bpe_49k", words).withColumn("op", F.lit("revise")))
    gone = docs.where(F.col("doc_id") % 10 == 7).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.lit("byte_bpe_50k").alias("version"), F.lit(0).cast("long").alias("n_tokens"))
    ledger.commit(3, gone.withColumn("op", F.lit("delete")))
    return ledger.totals()


def op9_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digests(pieces.encode(_documents(spark, sf_dir), model), model)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_wavelet_tokens, op2_ngram_jaccard, op3_language_id, op4_secret_scan, op5_best_fit_packing, op6_backoff_lm, op7_bottom_k, op8_token_rollup, op9_template_decontam, op10_repeated_bytes, op11_sentencepiece, op12_prefix_trie, op13_source_divergence)
}


#: crc32 of a decimal number in DuckDB SQL, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"""

_TRIE_SQL = f"""
WITH t AS (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), x := coalesce("text", '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce("text", '')) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
r AS (SELECT a.c, list_concat(list_slice(coalesce(b.own, []), 1, a.h), list_slice(a.own, a.h + 1, len(a.own))) AS turns
    FROM (SELECT *, ({_CRC32}) % 9 AS h FROM t) a LEFT JOIN t b ON b.c = a.c - a.c % 5),
p AS (SELECT c, d, list_slice(turns, 1, d) AS pre, len(turns) = d AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)),
n AS (SELECT pre, d, min(c) AS low, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ended FROM p GROUP BY pre, d),
k AS (SELECT u.*, u.d - 1 AS up_d, list_slice(u.pre, 1, u.d - 1) AS up, CASE WHEN u.d = 0 THEN 0 ELSE strlen(u.pre[u.d].x) END AS b FROM n u),
w AS (SELECT k.*, q.low AS up_low, (SELECT count(*) FROM k z WHERE z.up_d = k.d AND z.d > 0 AND z.up = k.pre) AS kids
    FROM k LEFT JOIN n q ON q.d = k.up_d AND q.pre = k.up AND k.d > 0),
s AS (SELECT u.low, u.d, sum(CASE WHEN v.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((v.n - 1) * v.b) AS saved
    FROM w u JOIN w v ON v.d >= u.d AND list_slice(v.pre, 1, u.d) = u.pre GROUP BY u.low, u.d)
SELECT w.low AS conv_id, w.d::BIGINT AS depth, w.up_low AS parent_conv_id, w.n AS n_convs, w.kids::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
    s.saved::BIGINT AS saved_tokens, sha256(w.ended) AS ends_sha256 FROM w JOIN s ON s.low = w.low AND s.d = w.d
"""

_DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce("text", '') AS x FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT s.lang, s.source, coalesce(v.v, 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = s.lang AND c.source = s.source), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS p
    FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v.v)) AS q FROM c JOIN v USING (lang) GROUP BY lang, term),
a AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
t AS (SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
u AS (SELECT *, 'pair' AS part FROM a UNION ALL SELECT *, 'term' AS part FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM u)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""

#: The others can't be put in SQL: they depend on tokenizers, trained models, whole-set joins or packing orders.
ORACLE_SQL: dict[str, str] = {"op12_prefix_trie": _TRIE_SQL, "op13_source_divergence": _DIVERGENCE_SQL}
