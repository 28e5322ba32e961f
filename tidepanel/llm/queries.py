"""One registered query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel.llm import chat, convrepair, decontam, edits, langid, linededup, perplexity, quality, secrets, simhash, urlfilter, whitening
from tidepanel.llm.packing import pack_documents
from tidepanel.llm.registry import query, table


@query("op3_packing")
def op3_packing(spark, sf_dir) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def remainder(divisor: int):
    """crc32 of the id as text, by the divisor; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


@query("op8_langid")
def op8_langid(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.fit(docs.filter(remainder(4) != 2))
    return docs.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), langid.identify(model, F.col("text")).alias("r")) \
        .select("doc_id", "held_out", F.col("r.language").alias("lang_pred"), "r.score", "r.ambiguous")


@query("op6_quality")
def op6_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.fit(docs.filter(remainder(5) != 0), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return docs.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), quality.score(model, F.col("text")).alias("score")) \
        .select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op4_perplexity")
def op4_perplexity(spark, sf_dir) -> DataFrame:
    return perplexity.judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


@query("op5_simhash")
def op5_simhash(spark, sf_dir) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


PROBE = "\\### Assistant: </turn> ok"


def probe_events(spark) -> DataFrame:
    """Conversation -7 as a log with a draft that is edited and an answer that is regenerated after a follow-up."""
    half = len(PROBE) // 2
    log = [("message", 0, "user", "a draft"), ("edit", 0, None, PROBE), ("message", 1, "assistant", "a first answer"), ("message", 2, "user", "again"),
           ("regenerate", 1, None, None), ("delta", 1, None, PROBE[:half]), ("delta", 1, None, PROBE[half:])]
    rows = spark.createDataFrame([(-7, k, *e) for k, e in enumerate(log)], "conv_id long, k int, kind string, turn long, role string, text string")
    return rows.select("conv_id", F.struct(F.col("k").cast("long").alias("turn"), F.lit(1).alias("copy"), F.lit(0).alias("k")).alias("seq"),
                       "kind", "turn", F.lit(1).alias("copy"), "role", "text")


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(text) + length(text) - length(translate(text, '\#<', '')) AS escaped,
         length(role) + length(role) - length(translate(role, '\#<:', '')) AS escaped_role FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + escaped_role + escaped) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op1_chat", OP1_SQL)
def op1_chat(spark, sf_dir) -> DataFrame:
    log = chat.as_events(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")).unionByName(probe_events(spark))
    return chat.digests(chat.render(chat.fold_events(log)))


@query("op10_edits")
def op10_edits(spark, sf_dir) -> DataFrame:
    return edits.count_edited(table(spark, sf_dir, "documents", "doc_id", "text"), edits.cleaning_edits)


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT r, item_id, i, dw.n FROM dw JOIN bw USING (x)),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
       FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""


@query("op7_decontam", OP7_SQL)
def op7_decontam(spark, sf_dir) -> DataFrame:
    hits = decontam.find_hits(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    n_hit = F.size(decontam.hit_words(F.col("hits"))).cast("long")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op9_secrets")
def op9_secrets(spark, sf_dir) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda kind: F.size(kind).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), count("random"),
                        F.sha2(secrets.joined("assign", "access", "hex"), 256).alias("base_sha256"), secrets.joined(*secrets.KINDS).alias("spans"))


@query("op2_linededup")
def op2_linededup(spark, sf_dir) -> DataFrame:
    # every line with a word is judged
    found = linededup.match_lines(table(spark, sf_dir, "documents", "doc_id", "text"), min_words=1)
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.array_sort("removed"), ",").alias("removed"), "n_links")


OP12_SQL = r"""
WITH RECURSIVE bytes AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS tab FROM range(256) AS r(b)),
crcs AS (
  SELECT conv_id, turn, xor(list_reduce([ord(k) FOR k IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')],
         lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS crc
  FROM (SELECT DISTINCT conv_id, turn FROM conversations), bytes),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, h
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc % 20 AS h
        FROM conversations JOIN crcs USING (conv_id, turn)) WHERE h <> 0),
spread AS (SELECT conv_id, turn, role, text FROM damaged UNION ALL SELECT conv_id, turn, role, text FROM damaged WHERE h = 3),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM spread),
judged AS (
  SELECT *, CASE WHEN rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
-- states: 0 at the start, 1 after s, 2 after u, 3 after a; pre: inserts from p to q
pre(p, q, cost, word, gone) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 2, 'I', 'user:|'), (0, 3, 4, 'II', 'user:|assistant:|'),
  (1, 2, 2, 'I', 'user:|'), (1, 3, 4, 'II', 'user:|assistant:|'), (2, 3, 2, 'I', 'assistant:|'), (3, 2, 2, 'I', 'user:|')),
own(q, t, letter, c, cost) AS (VALUES (0, 0, 'D', '', 3), (1, 1, 'D', '', 3), (2, 2, 'D', '', 3), (3, 3, 'D', '', 3), (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0),
  (3, 2, 'K', 'u', 0), (2, 3, 'K', 'a', 0), (0, 2, 'R', '', 2), (1, 2, 'R', '', 2), (3, 2, 'R', '', 2), (2, 3, 'R', '', 2)),
step AS (SELECT p, t, letter, c, pre.cost + own.cost AS cost, word || letter AS word, replace(gone, '|', chr(10)) AS gone FROM pre JOIN own USING (q)),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS p, {'cost': 0, 'audit': '', 'out': ''} AS best FROM (SELECT DISTINCT conv_id FROM numbered)
  UNION ALL
  SELECT w.conv_id, w.i + 1, s.t, min({'cost': w.best.cost + s.cost + CASE WHEN j.fault = 'truncated' AND s.letter <> 'D' THEN 1 ELSE 0 END, 'audit': w.best.audit || s.word,
         'out': w.best.out || s.gone || CASE s.letter WHEN 'D' THEN '' WHEN 'K' THEN j.role || ':' || j.text || chr(10)
                ELSE CASE s.t WHEN 2 THEN 'user:' ELSE 'assistant:' END || j.text || chr(10) END})
  FROM walk w JOIN judged j ON j.conv_id = w.conv_id AND j.i = w.i + 1
       JOIN step s ON s.p = w.p AND (s.c = '' OR s.c = j.c) AND (s.letter = 'D' OR j.fault NOT IN ('blank', 'duplicate'))
  GROUP BY w.conv_id, w.i, s.t),
ends AS (
  SELECT conv_id, min({'cost': best.cost + pre.cost, 'audit': best.audit || pre.word, 'out': best.out || replace(pre.gone, '|', chr(10))}) AS done
  FROM walk JOIN pre USING (p) JOIN (SELECT conv_id, max(i) AS i FROM numbered GROUP BY conv_id) USING (conv_id, i)
  WHERE q = 3 OR (q = 0 AND pre.word = '') GROUP BY conv_id),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(done.cost, 0) AS BIGINT) AS cost, coalesce(done.audit, '') AS audit, sha256(coalesce(left(done.out, greatest(length(done.out) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN figures USING (conv_id) LEFT JOIN ends USING (conv_id)
"""


@query("op12_convrepair", OP12_SQL)
def op12_convrepair(spark, sf_dir) -> DataFrame:
    given = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return convrepair.summary(given, convrepair.number_rows(convrepair.damage(given)))


#: The rules of the contract.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

OP13_SQL = r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + r"""),
split AS (
  SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
won AS (
  SELECT r, max({'size': length(rule_host) + length(rule_path), 'rule': rule_host || rule_path, 'verdict': rule_verdict}) AS w
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r)
SELECT page_id, host, path, w.rule AS rule, coalesce(w.verdict, 'allow') AS verdict FROM parts LEFT JOIN won USING (r)
"""


@query("op13_urlfilter", OP13_SQL)
def op13_urlfilter(spark, sf_dir) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages", "page_id", "url"), rules).select("row.page_id", "host", "path", "rule", "verdict")


@query("op11_whitening")
def op11_whitening(spark, sf_dir) -> DataFrame:
    made = whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")
    # exact while it fits a long; null beyond, where the operator still has it as a decimal
    return made.select(F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation as long)").alias("deviation"), "whitened", "explained", "identity_error")
