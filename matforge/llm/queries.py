"""The registered queries of the training-data operators and, where SQL can say it, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matforge.llm import byte_ppm, chat_tree, exact_dedup, feistel, langid, ledger, main_text, near_dup, packing, ranked_search, sentencepiece_viterbi, sharding, training_order, vector_codes
from matforge.runtime import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the binary shards with all its ids, read back from them."""
    layout, _ = training_order.write_training_order(table(spark, sf_dir, "documents"), scratch_path(spark, "training-order"))
    return training_order.read_training_order(spark, layout).withColumnRenamed("closed", "n_closed")


def stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.write_ledger(table(spark, sf_dir, "documents"), scratch_path(spark, "ledger"))


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = stored_ledger(spark, sf_dir)
    base, verdict = ledger.rejects(ledger.BASE), ledger.rejects(ledger.PRODUCTION)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~verdict).alias("kept"), F.col("failed").alias("failure_bits"))


def op2_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ablation(stored_ledger(spark, sf_dir))


def op3_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return chat_tree.read_back(chat_tree.build_segments(turns.unionByName(probe)))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents")).drop("row_no")


def op5_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(table(spark, sf_dir, "documents"))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_ppm.score_documents(table(spark, sf_dir, "documents"))


def op8_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encode_documents(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_vectors(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_training_order, op2_quality_ledger, op3_chat_tree, op4_feistel_shards, op5_probminhash, op6_digest_index, op7_ppm, op8_viterbi_pieces, op9_language, op10_pack, op11_ranked_search, op12_main_text, op13_vector_codes, op2_rule_ablation, pipeline)
    return {q.__name__: q for q in named}


OP6_SQL = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

_ESC = "regexp_replace({0}, '([\\\\\\[\\]<>])', '\\\\\\1', 'g')"
OP3_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('[TURN ' || {_ESC.format("role")} || ']' || {_ESC.format("text")} || '[/TURN]')) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

#: The ledger's measurements, rules and verdict in SQL.
_LEDGER_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM pos),
again AS (SELECT doc_id, unnest(list(i)) AS i FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM again, range(8) r(o) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), flat AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
tops AS (SELECT doc_id, max(n) AS top_word FROM (SELECT doc_id, word, count(*) AS n FROM flat GROUP BY 1, 2) GROUP BY 1),
stutter AS (SELECT doc_id, count(*) AS n_stutter FROM (SELECT doc_id, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM flat) WHERE word = before GROUP BY 1),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
    strlen(regexp_replace(text, '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]', '', 'g')) AS n_letter_bytes,
    coalesce(top_word, 0) AS top_word, coalesce(n_stutter, 0) AS n_stutter
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN tops USING (doc_id) LEFT JOIN stutter USING (doc_id)
), book AS (
  SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (100 * n_symbols > 20 * n_words)::INT
    + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 25 * n_words)::INT
    + 32 * (100 * n_upper > 60 * (n_upper + n_lower))::INT + 64 * (100 * top_word > 30 * n_words)::INT
    + 128 * (100 * n_letter_bytes < 50 * word_chars)::INT + 256 * (100 * n_stutter > 30 * n_words)::INT AS BIGINT) AS failure_bits FROM m
)
"""
OP2_SQL = _LEDGER_SQL + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failure_bits & 3 <> 0 AS base_failed, failure_bits = 0 AS kept, failure_bits FROM book"
OP2_ABLATION_SQL = _LEDGER_SQL + ", rules AS (SELECT unnest([{rules}]) AS rule, unnest(range({n})) AS k) SELECT 'v1' AS policy, rule, CAST(count(*) FILTER (failure_bits & (1::BIGINT << k) <> 0) AS BIGINT) AS failed, count(*) FILTER (failure_bits = (1::BIGINT << k)) AS only_this, count(*) FILTER (failure_bits & ~(1::BIGINT << k) = 0) AS kept_without FROM book, rules GROUP BY rule".format(
    rules=", ".join(f"'{r}'" for r in ledger.RULES), n=len(ledger.RULES)
)


def _op4_sql(key: str = "corpus-v1", shards: int = 8) -> str:
    """Checksums by a table-driven fold over the bytes; the permutation by a recursive query, one round a step."""
    keys = ", ".join(f"[{a}, {b}, {c}]" for a, b, c in feistel.round_keys(key))
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    h = "(xor(x, x >> 13))"
    hashed = f"(SELECT {h} FROM (SELECT (xor(y, y >> 15) * keys[k % 8 + 1][3]) % {feistel.PRIME} AS x FROM (SELECT (V * keys[k % 8 + 1][1] + keys[k % 8 + 1][2]) % {feistel.PRIME} AS y)))"
    return f"""
WITH RECURSIVE crc_steps(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, {step}, k + 1 FROM crc_steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS crc FROM crc_steps WHERE k = 8),
bytes AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (
  SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: CAST(instr('0123456789ABCDEF', h[2 * i + 1]) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 17 AS BIGINT))), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]))) AS text_crc32
  FROM bytes, crc_table
), n AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM documents),
g AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b, [{keys}] AS keys FROM n),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_no FROM d),
walk(row_no, l, r, k) AS (
  SELECT row_no, row_no // b, row_no % b, 0 FROM numbered, g
  UNION ALL
  SELECT row_no, CASE WHEN k % 2 = 0 THEN (l + {hashed.replace("V", "r")}) % a ELSE l END, CASE WHEN k % 2 = 0 THEN r ELSE (r + {hashed.replace("V", "l")}) % b END, k + 1
  FROM walk, g WHERE k % 8 <> 0 OR k = 0 OR l * b + r >= n
), placed AS (SELECT row_no, l * b + r AS p FROM walk, g WHERE k > 0 AND k % 8 = 0 AND l * b + r < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % {shards} AS INT) AS shard, CAST(p // {shards} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM numbered JOIN placed USING (row_no)
"""


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_TERMS}, []) AS ws FROM documents),
whole AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS total FROM d),
cells AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM cells) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), whole),
scored AS (
  SELECT item_id, rid, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(ws) * n_docs) // total)))) AS BIGINT) AS score
  FROM p JOIN w USING (term) JOIN cells USING (term) JOIN d USING (rid), whole GROUP BY item_id, rid
), ranked AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INT) AS rank FROM scored JOIN d USING (rid) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def _op13_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Every part against every entry, one pair of common table expressions a round."""
    assign = "SELECT rid, p, arg_min(e, d * {n} + e) AS e, min(d) AS d FROM (SELECT rid, p, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN c{k} USING (p)) GROUP BY rid, p"
    update = """SELECT c{k}.p, c{k}.e, coalesce(m.c, c{k}.c) AS c FROM c{k} LEFT JOIN (
      SELECT p, e, list(q ORDER BY i) AS c FROM (SELECT p, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS q FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{k} JOIN parts USING (rid, p)) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e)"""
    steps = "".join(f", a{k} AS ({assign.format(n=entries, k=k)}), c{k + 1} AS ({update.format(k=k)})" for k in range(rounds))
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS rid FROM kept),
parts AS (SELECT rid, p, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] AS v FROM numbered, range({parts}) t(p)),
c0 AS (SELECT p, rid AS e, v AS c FROM parts WHERE rid < {entries}){steps}, a AS ({assign.format(n=entries, k=rounds)}),
coded AS (SELECT rid, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY rid),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN numbered USING (rid), book
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_feistel_shards": _op4_sql(), "op2_quality_ledger": OP2_SQL, "op2_rule_ablation": OP2_ABLATION_SQL, "op3_chat_tree": OP3_SQL, "op6_digest_index": OP6_SQL, "op11_ranked_search": OP11_SQL, "op13_vector_codes": _op13_sql()}
