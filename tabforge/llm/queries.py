"""The queries of the corpus operators over the given tables, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.bpe import encode_texts
from tabforge.llm.chat import echo_pairs, format_preferences, gather_turns
from tabforge.llm.embeddings import similar_vectors
from tabforge.llm.exact import exact_duplicates
from tabforge.llm.forest import nearest_vectors
from tabforge.llm.langid import predict_language, train_language_model
from tabforge.llm.lines import dedup_lines
from tabforge.llm.minhash import near_duplicates
from tabforge.llm.negatives import hard_negatives
from tabforge.llm.packing import pack_documents
from tabforge.llm.sharding import shard_rows
from tabforge.llm.token_counts import count_tokens
from tabforge.llm.variants import count_words, spelling_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = encode_texts(_table(spark, sf_dir, "documents"), path, pattern, offsets=True, decoded=True)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.xxhash64("starts", "ends").alias("offsets_xxhash64"))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.PATTERN)


@query
def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(_table(spark, sf_dir, "documents"), shards=40, seed=20)


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


SQL["op8_exact_dedup"] = """
    WITH t AS (
        SELECT doc_id, coalesce(text, '') AS text,
               regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
    r AS (
        SELECT doc_id, norm, first_value(doc_id) OVER (
                   PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size FROM t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"), "text")


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of a byte-level model: a token for each UTF-8 byte and one that ends the document."""
    docs = _table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("n_tokens"))
    return pack_documents(sized, PACK_LENGTHS, "n_tokens")


#: Permitted sequence lengths of the packing queries, in byte tokens.
PACK_LENGTHS = (2048, 4096, 8192, 16384)


@query
def op10_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = format_preferences(echo_pairs(gather_turns(_table(spark, sf_dir, "conversations"))))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(
        s["first"].cast("string"), F.lit("-"), s["last"].cast("string"))), ",")
    return formatted.select(
        F.col("pair_id").alias("conv_id"), "status", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), "prompt",
        "chosen", "rejected", spans("chosen_spans").alias("chosen_spans"), spans("rejected_spans").alias("rejected_spans"))


SQL["op10_preference_chat"] = """
    WITH t AS (
        SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
    n AS (
        SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS turns,
               '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown
        FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
    l AS (SELECT conv_id, max(k) AS m FROM n WHERE role = 'assistant' GROUP BY conv_id HAVING max(k) > 1),
    r AS (  -- the answer that echoes the turn before it
        SELECT l.conv_id, l.m, p.text AS echo, a.text = p.text AS equal
        FROM l JOIN n a ON a.conv_id IS NOT DISTINCT FROM l.conv_id AND a.k = l.m
               JOIN n p ON p.conv_id IS NOT DISTINCT FROM l.conv_id AND p.k = l.m - 1),
    c AS (
        SELECT n.*, CASE WHEN r.m IS NULL THEN 0 WHEN r.equal THEN r.m ELSE r.m - 1 END AS prefix, r.echo, r.equal, r.m,
               r.m IS NULL AS missing
        FROM n LEFT JOIN r ON n.conv_id IS NOT DISTINCT FROM r.conv_id),
    s AS (
        SELECT *, coalesce(sum(CASE WHEN k > prefix THEN length(shown) END) OVER (
                   PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM c),
    g AS (
        SELECT conv_id, any_value(missing) AS missing, any_value(prefix) AS n_prompt_turns, any_value(turns) AS turns,
               any_value(equal) AS equal, any_value(echo) AS echo,
               coalesce(string_agg(shown, '' ORDER BY k) FILTER (k <= prefix), '') AS prompt,
               coalesce(string_agg(shown, '' ORDER BY k) FILTER (k > prefix), '') AS chosen,
               coalesce(string_agg((pos + 14)::BIGINT::VARCHAR || '-' || (pos + 21 + length(text))::BIGINT::VARCHAR, ',' ORDER BY k)
                   FILTER (k > prefix AND role = 'assistant'), '') AS chosen_spans
        FROM s GROUP BY conv_id),
    o AS (
        SELECT *, CASE WHEN missing OR equal THEN '' ELSE '<|assistant|>' || chr(10) || echo || '<|end|>' || chr(10) END AS rejected,
               CASE WHEN missing OR equal THEN '' ELSE '14-' || (21 + length(echo))::VARCHAR END AS rejected_spans FROM g)
    SELECT conv_id, CASE WHEN missing THEN 'missing' WHEN chosen = '' AND rejected = '' THEN 'same'
                         WHEN chosen_spans = '' OR rejected_spans = '' THEN 'no_loss' ELSE 'pair' END AS status,
           n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans FROM o
"""


@query
def op6_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


@query
def op2_collision_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(_table(spark, sf_dir, "embeddings"), similarity=0.93)


def held_out() -> Column:
    """Documents that no model learns from: the checksum of the id leaves 2 by 4; false without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = train_language_model(docs.where("not held_out and doc_id is not null"))
    return predict_language(docs, model, keep=("doc_id", "held_out"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives(vectors, anchors=F.col("vec_id") % 50 == 0)


SQL["op11_hard_negatives"] = """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
               list_dot_product(a.e, b.e)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
    n AS (
        SELECT p.anchor_id, positive_id, positive_score, s.other_id AS negative_id, s.score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
         AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(count_words(_table(spark, sf_dir, "documents"), drop_every=199))


SQL["op12_spelling_variants"] = """
    WITH RECURSIVE bits AS (
        SELECT b, b AS v, 0 AS k FROM range(256) t(b)
        UNION ALL
        SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
    crc AS (SELECT list(v ORDER BY b) AS steps FROM bits WHERE k = 8),
    r AS (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
        FROM documents),
    d AS (
        SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS named, count(*) AS times
        FROM r WHERE length(run) >= 6 GROUP BY ALL),
    c AS (  -- the checksum of the UTF-8 bytes, one step for each
        SELECT run, times, xor(list_reduce(
                   [byte::BIGINT FOR byte IN [('0x' || hex(encode(named))[2 * i + 1:2 * i + 2])::INTEGER FOR i IN range(octet_length(encode(named)))]],
                   LAMBDA state, byte: xor(state // 256, steps[xor(state % 256, byte) + 1]), 4294967295), 4294967295) AS h
        FROM d, crc),
    w AS (
        SELECT CASE WHEN h % 199 = 0 THEN run[:(h % length(run))::INTEGER] || run[(h % length(run))::INTEGER + 2:] ELSE run END AS word, times FROM c),
    v AS (SELECT word, sum(times)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
    e AS (  -- what is left of a word without one letter, and the word itself
        SELECT word, n, 0 AS at, word AS part FROM v
        UNION ALL
        SELECT word, n, i, word[:i - 1] || word[i + 1:] FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
    p AS (
        SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n
        FROM e a JOIN e b ON a.part = b.part AND a.word <> b.word AND (a.at = b.at OR a.at = 0 OR b.at = 0)),
    f AS (
        SELECT word, count(*) AS n_near, max(other_n) AS top, min(struct_pack(less := -other_n, other := other)).other AS best
        FROM p GROUP BY word),
    g AS (
        SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * v.n THEN best END AS form,
               CASE WHEN top >= 5 * v.n THEN top END AS form_n
        FROM v LEFT JOIN f USING (word)),
    chain AS (
        SELECT word, coalesce(form, word) AS root FROM g
        UNION ALL
        SELECT chain.word, g.form FROM chain JOIN g ON g.word = chain.root WHERE g.form IS NOT NULL AND chain.root <> chain.word)
    SELECT g.word, g.form, arg_max(chain.root, t.n) AS root, g.n, g.n_near, g.form_n
    FROM g JOIN chain USING (word) JOIN g t ON t.word = chain.root GROUP BY ALL
"""


@query
def op13_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)
