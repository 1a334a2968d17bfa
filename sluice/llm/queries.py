"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import alignment, chat, decontaminate, minhash, neighbours, pieces, quality, resampling, simhash, substrings, tokens, urls
from sluice.llm.common import new_path

WORD_BPE = str(Path(public_tokenizers.path("word_bpe_49k.json")))
PIECES = str(Path(public_tokenizers.path("piece_bpe_32k.model")))
BYTE_BPE = str(Path(public_tokenizers.path("byte_bpe_50k.json")))
RANKS, PATTERN = str(Path(public_tokenizers.path("byte_bpe_50k.tiktoken"))), public_tokenizers.PATTERN
END_ID = 1
RULES = [
    urls.Rule("allow", "org/"),
    urls.Rule("block", "example.org/es/"),
    urls.Rule("block", "example.org/en/1"),
    urls.Rule("allow", "com/fr/"),
    urls.Rule("block", "com/de/"),
]
#: A conversation whose texts look like marks and escapes.
PROBE = (-7, "\\### Assistant: </turn> ok")
#: Words of a window that may stand only once, and of one that must not be in a benchmark.
REPEAT_WORDS, LEAK_WORDS = 13, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.with_suffix_sums(tokens.length_histogram(table(spark, sf_dir, "documents"), WORD_BPE))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2 that SQL can express: host, path, and what the rules say."""
    return urls.with_rules(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv_id, text = PROBE
    probe = spark.createDataFrame([(conv_id, 0, "user", text), (conv_id, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_conversations(chat.format_conversations(turns, RANKS, PATTERN), RANKS, PATTERN).drop("n_tokens", "loss_tokens")


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), REPEAT_WORDS)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.with_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), LEAK_WORDS)
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        decontaminate.items_digest().alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES, verify=True)
    return ids.select("doc_id", "n_tokens", "parity", F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ids")
    tokens.write_ids(table(spark, sf_dir, "documents"), path, WORD_BPE, END_ID)
    return tokens.with_crc32(tokens.read_ids(spark, path))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_groups(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", minhash.kept())


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


#: Host, path and rule of each page: the longest rule of its host or a domain above it, whose path it starts with.
RULES_SQL = r"""
WITH parts AS (SELECT row_number() OVER () AS i, page_id, coalesce(url, '') AS u FROM pages),
named AS (
  SELECT i, page_id, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(verdict, pattern) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
split AS (SELECT verdict, pattern, regexp_extract(pattern, '^[^/]*') AS name, regexp_extract(pattern, '/.*') AS rest FROM rules),
fits AS (
  SELECT i, arg_max(verdict, length(pattern)) AS verdict, arg_max(pattern, length(pattern)) AS rule
  FROM named JOIN split ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, rest) GROUP BY i)
SELECT page_id, host, path, rule, verdict FROM named LEFT JOIN fits USING (i)
"""

#: The rows of op3: digests of the turns, and the length of the escaped text form with its three marks.
OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(replace(replace(replace(replace(role || text, '\', '\\'), '<turn>', '<\turn>'), '<says>', '<\says>'), '</turn>', '<\/turn>'))
    + length('<turn><says></turn>') AS chars
  FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

#: The rows of op5: a window's first document, the words that windows of earlier documents cover, and what is left.
OP5_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 12, 0))) AS i FROM words),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM spots),
firsts AS (SELECT s, min(doc_id) AS d FROM windows GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i
  FROM windows JOIN firsts USING (s) WHERE d < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM words),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t, count(*) AS n
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i WHERE g.i IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

#: The rows of op6.
OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_spots AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM item_spots),
sizes AS (SELECT DISTINCT n FROM item_windows),
spots AS (SELECT doc_id, w, n, unnest(generate_series(1, greatest(len(w) - n + 1, 0))) AS i FROM words, sizes),
windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM spots),
found AS (SELECT doc_id, item_id, i, n FROM windows JOIN item_windows USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit h ON w.doc_id = h.doc_id LEFT JOIN named n ON w.doc_id = n.doc_id
"""

#: The rows of op12: all pairs that share a shingle, and the components of the links.
OP12_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(list_transform(generate_series(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
linked AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id <= coalesce(m, w.doc_id) AS kept
FROM words w LEFT JOIN sizes s ON w.doc_id = s.doc_id LEFT JOIN least l ON w.doc_id = l.a
"""

#: The rows of op11: CRC-32 by its table, over the bytes of each distinct run once.
OP11_SQL = r"""
WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
texts AS (SELECT doc_id, -1 AS item, text FROM documents UNION ALL SELECT NULL, row_number() OVER (), text FROM benchmark),
words AS (
  SELECT doc_id, item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
runs AS (
  SELECT doc_id, item, unnest(w) AS f FROM words
  UNION ALL SELECT doc_id, item, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM words WHERE len(w) > 1),
counted AS (SELECT doc_id, item, f, count(*) AS n FROM runs GROUP BY ALL),
hexed AS (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM counted)),
bytes AS (SELECT f, list_transform(generate_series(1, len(h) // 2), lambda i: ('0x' || h[2 * i - 1:2 * i])::BIGINT) AS b FROM hexed),
buckets AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS k
  FROM bytes, crc),
placed AS (SELECT doc_id, item, k, sum(n)::BIGINT AS n FROM counted JOIN buckets USING (f) GROUP BY ALL),
s AS (SELECT k, sum(n) AS s FROM placed WHERE item = -1 GROUP BY k),
t AS (SELECT k, sum(n) AS t FROM placed WHERE item <> -1 GROUP BY k),
totals AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS ss, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS tt),
gains AS (
  SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (tt + 10000))))::BIGINT AS g
  FROM range(10000) r(k) LEFT JOIN s USING (k) LEFT JOIN t USING (k), totals),
weights AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM placed JOIN gains USING (k) WHERE item = -1 GROUP BY doc_id),
scored AS (
  SELECT w.doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words w LEFT JOIN weights x ON w.doc_id = x.doc_id WHERE w.item = -1),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END::BIGINT AS rank
FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id
"""

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_url_filter": op2_url_filter,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_permutation_index": op4_permutation_index,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_token_files": op9_token_files,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_minhash_near_dedup": op12_minhash_near_dedup,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
    "url_rules": url_rules,
}
ORACLES: dict[str, str] = {"op3_chat_formatting": OP3_SQL, "op5_substring_dedup": OP5_SQL, "op6_decontamination": OP6_SQL, "op11_importance_resampling": OP11_SQL, "op12_minhash_near_dedup": OP12_SQL, "url_rules": RULES_SQL}
