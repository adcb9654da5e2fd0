"""The queries of this subpackage over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat_format, decontaminate, minhash, mixing, pii, quality, sharding, suffix_dedup, url_filter, warc
from tidemark.llm.common import read

SHARD_BYTES = 64 << 20
SMALL_SHARD_BYTES = 64 << 10
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, SHARD_BYTES).select("doc_id", *sharding.OUT)


def small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 with a limit that the small tables exceed many times, so that buckets split."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, SMALL_SHARD_BYTES).select("doc_id", *sharding.OUT)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat_format.read_back(chat_format.format_trees(chat_format.messages_of(rows)))
    per_turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(per_turn, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.clean_documents(docs, with_text=False).drop("text")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, with_text=False).select("doc_id", *mixing.OUT)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, with_text=False)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.find_personal_data(docs).drop("text")
    digest = F.sha2(F.col("base_spans").cast("binary"), 256)
    return out.select("doc_id", *[f"n_{k}" for k in pii.KINDS], digest.alias("base_sha256"), "spans", "n_spans")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")
    out = decontaminate.decontaminate(docs, items)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{host}', '{path}', '{action}')" for host, path, action in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, action)")
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = minhash.label_documents(docs)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_chat_format": op2_chat_format,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_warc": op6_warc,
    "op7_pii": op7_pii,
    "op8_decontamination": op8_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "small_shards": small_shards,
}

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x09-\x0D ]+'), lambda w: w <> '')"

ORACLE_SQL: dict[str, str] = {}

def _shards_sql(limit: int) -> str:
    return f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(0) || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
sums AS (
  SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs
  FROM d, (SELECT unnest(range(0, 40))::INTEGER AS depth) GROUP BY ALL),
best AS (
  SELECT d.doc_id, d.n_bytes, d.h, min(s.depth) AS depth
  FROM d JOIN sums s ON s.prefix = d.h >> (60 - s.depth) AND s.shard_bytes <= {limit} GROUP BY ALL)
SELECT b.doc_id, b.n_bytes,
       'b' || CASE WHEN b.depth = 0 THEN '' ELSE lpad(bin(s.prefix), b.depth, '0') END AS shard_id,
       b.depth::INTEGER AS shard_depth, s.shard_bytes, s.shard_docs
FROM best b JOIN sums s ON s.depth = b.depth AND s.prefix = b.h >> (60 - b.depth)
"""


ORACLE_SQL["op1_sharding"], ORACLE_SQL["small_shards"] = _shards_sql(SHARD_BYTES), _shards_sql(SMALL_SHARD_BYTES)

ORACLE_SQL["op2_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(23 + length(role) + length(text) + len(regexp_extract_all(role || text, '[\\\\<\\[]')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

ORACLE_SQL["op3_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {_WORDS.format('text')} AS w FROM d),
g AS (
  SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
often AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g JOIN often USING (doc_id, g)) GROUP BY doc_id),
l AS (
  SELECT doc_id, line, pos, len({_WORDS.format('line')}) AS k FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d)),
lines AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS dup,
    CASE WHEN regexp_matches(lower(line), '{quality.BOILERPLATE}') THEN true
         WHEN len(regexp_extract_all(line, '{quality.SEPARATORS}')) >= {quality.NAV_SEPARATORS}
              AND len(regexp_extract_all(line, '{quality.SEPARATORS}')) * {quality.NAV_WORDS} >= k THEN true
         WHEN k < {quality.FRAGMENT_WORDS} THEN NOT regexp_matches(regexp_replace(line, '[\x09-\x0D ]+$', ''), '{quality.TERMINAL.replace("'", "''")}')
         ELSE NOT regexp_matches(line, '[.!?…。！？]') END AS bad
  FROM l WHERE k > 0),
per AS (
  SELECT doc_id, count(*) FILTER (dup) AS dups, count(*) FILTER (bad) AS bad, coalesce(sum(k) FILTER (bad), 0)::BIGINT AS lost FROM lines GROUP BY doc_id),
a AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words,
    (length(text) - len(regexp_extract_all(text, '[\x09-\x0D ]')))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    coalesce(bad, 0)::BIGINT AS n_bad_lines, coalesce(lost, 0)::BIGINT AS n_lost_words
  FROM w LEFT JOIN per USING (doc_id) LEFT JOIN covered c USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * n_lost_words <= {quality.MAX_LOST_PERCENT} * n_words AS kept
FROM a
"""

ORACLE_SQL["op5_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (
  SELECT doc_id, i, hash(substr(x, 2 * i + 1, 800)) AS h
  FROM (SELECT doc_id, x, unnest(range(0, length(x)::BIGINT // 2 - 399)) AS i FROM d WHERE length(x) >= 800)),
r AS (SELECT doc_id, i FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
e AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER w + 400, true) AS opens, lag(i) OVER w AS prev FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM e),
spans AS (SELECT doc_id, n, min(i) AS a, max(i) + 400 AS b FROM s GROUP BY doc_id, n),
gaps AS (
  SELECT doc_id, n, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY n), 0) AS since FROM spans),
k AS (
  SELECT doc_id, count(*)::BIGINT AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last,
    string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY n) AS front
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(front || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

ORACLE_SQL["op6_warc"] = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT *, list_reduce(list_transform(string_split(h, ''), lambda c: lpad(bin(('0x' || c)::BIGINT), 4, '0')), lambda a, c: a || c) AS bits FROM p),
d AS (
  SELECT *, list_reduce(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + instr('0123456789ABCDEF', '0') - 1
        + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
        + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), lambda a, c: a || c) AS payload_digest,
    max(page_id) OVER (PARTITION BY h) AS last FROM b)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM d
"""

_ALNUM = (
    r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
)

ORACLE_SQL["op8_decontamination"] = rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN win USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLE_SQL["op9_url_filter"] = r"""
WITH r(rh, rp, act) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
                               ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages))
SELECT page_id, host, path,
  (SELECT arg_max(rh || rp, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  coalesce((SELECT arg_max(act, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict
FROM p
"""

ORACLE_SQL["op10_minhash_near_dedup"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, b FROM reach r JOIN link ON a = r.other),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)
"""
