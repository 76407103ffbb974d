"""The registered queries of the operators, with SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from .chat import conversations, format_preferences, last_answer_swapped
from .common import crc_mod, lower_ascii
from .decontaminate import find_leaks, split_items
from .fingerprints import fingerprint_edits
from .langid import fit, identify
from .merkle import leaf_digest, merkle_proofs
from .minhash import near_duplicates
from .mixing import mix_sources
from .passages import repeated_passages
from .periodic import longest_run, periodic_runs, with_repeated_tail
from .pitman_yor import score_texts
from .registry import ORACLES, QUERIES, query, read
from .set_join import jaccard_classes
from .url_rules import judge_urls
from .warc import round_trip

__all__ = ["ORACLES", "QUERIES"]

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


# For DuckDB, which has no crc32: its table (0xEDB88320), and the value of a document's id.
_CRC_TABLE = """crc AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(n)))"""
_CRC_OF_ID = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"""
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf_sql(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in fields) + ")"


@query("op1_preferences", """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, i, text, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM t WHERE role = 'assistant'),
c AS (
  SELECT t.conv_id, count(*) AS n, max(l.i) AS last, max(l.text) AS told, coalesce(max(p.text), '') AS swapped
  FROM t LEFT JOIN a l ON l.conv_id = t.conv_id AND l.back = 1 LEFT JOIN a p ON p.conv_id = t.conv_id AND p.back = 2
  GROUP BY t.conv_id),
k AS (SELECT *, CASE WHEN last IS NULL THEN n - 1 WHEN told = swapped THEN n ELSE last - 1 END AS k FROM c),
b AS (
  SELECT t.conv_id, i, role, 'c' AS side, text, k FROM t JOIN k USING (conv_id)
  UNION ALL
  SELECT t.conv_id, i, role, 'r', CASE WHEN i = last THEN swapped ELSE text END, k FROM t JOIN k USING (conv_id)
  WHERE last IS NOT NULL OR i < n),
r AS (SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown FROM b),
o AS (
  SELECT *, coalesce(sum(length(shown)) FILTER (WHERE i > k) OVER (PARTITION BY conv_id, side ORDER BY i
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 13 + length(role) AS start FROM r)
SELECT conv_id, k::INT AS n_prompt_turns,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 'c' AND i <= k), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 'c' AND i > k), '') AS chosen,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 'r' AND i > k), '') AS rejected,
       coalesce(string_agg(start::BIGINT || '-' || (start + length(text) + 10)::BIGINT, ',' ORDER BY i)
                FILTER (WHERE side = 'c' AND i > k AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(start::BIGINT || '-' || (start + length(text) + 10)::BIGINT, ',' ORDER BY i)
                FILTER (WHERE side = 'r' AND i > k AND role = 'assistant'), '') AS rejected_spans
FROM o GROUP BY conv_id, k""")
def op1_preferences(spark, sf_dir):
    told = conversations(read(spark, sf_dir, "conversations"))
    pairs = told.select("id", F.col("turns").alias("chosen"), last_answer_swapped(F.col("turns")).alias("rejected"))
    return format_preferences(pairs).withColumnRenamed("id", "conv_id")


@query("op2_language_id")
def op2_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit(docs, ~held_out)
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op3_warc", """
WITH h AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM h GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM h JOIN f USING (h)""")
def op3_warc(spark, sf_dir):
    return round_trip(read(spark, sf_dir, "pages"), scratch_path(spark, "archives"))


@query("op4_pitman_yor")
def op4_pitman_yor(spark, sf_dir):
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    scored = score_texts(read(spark, sf_dir, "documents"), ~held_out)
    return scored.withColumn("held_out", held_out)


@query("op5_mix_sources", r"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS place
  FROM documents),
s AS (SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
             2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
             1.5::DOUBLE * (SELECT sum(size) FROM d) AS total FROM w),
l AS (SELECT (total - held) / rest AS level FROM o WHERE (total - held) / rest * weight <= cap
      ORDER BY cap / weight, key LIMIT 1),
t AS (SELECT key, source_size, least(cap, weight * level)::DOUBLE AS target,
             coalesce(floor(least(cap, weight * level) / nullif(source_size, 0)), 0) AS whole FROM w, l),
j AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS need,
             sum(size) OVER (PARTITION BY key ORDER BY place) AS upto,
             sum(size) OVER (PARTITION BY key, place) AS peers
      FROM d JOIN t USING (key))
SELECT doc_id, size, source_size, target,
       (whole + CASE WHEN need > 0 AND upto - peers / 2 <= need THEN 1 ELSE 0 END)::BIGINT AS copies,
       ((whole + CASE WHEN need > 0 AND upto - peers / 2 <= need THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM j""")
def op5_mix_sources(spark, sf_dir):
    return mix_sources(read(spark, sf_dir, "documents"))


@query("op6_near_duplicates", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[]
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g
  FROM w),
n AS (SELECT doc_id, len(g) AS n FROM g),
s AS (SELECT doc_id, unnest(g) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 85 * (x.n + y.n - met)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON a = doc_id""")
def op6_near_duplicates(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))


@query("op7_fingerprints")
def op7_fingerprints(spark, sf_dir):
    return fingerprint_edits(read(spark, sf_dir, "documents"))


@query("op8_url_rules", """
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rule_host, rule_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT q.*, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS nth
  FROM q LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE nth = 1""")
def op8_url_rules(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(read(spark, sf_dir, "pages"), rules)


@query("op9_decontaminate")
def op9_decontaminate(spark, sf_dir):
    return find_leaks(read(spark, sf_dir, "documents"), split_items(read(spark, sf_dir, "benchmark")))


@query("op10_repeated_passages")
def op10_repeated_passages(spark, sf_dir):
    return repeated_passages(read(spark, sf_dir, "documents"))


@query("op11_periodic_runs", rf"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, {_CRC_OF_ID} AS h, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents, crc),
a AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
m AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]) ELSE w END AS w
  FROM a),
i AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM m),
j AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM i x JOIN i y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
b AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM j),
s AS (
  SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM b GROUP BY doc_id, q, island
  HAVING count(*) + q >= greatest(12, 2 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
k AS (
  SELECT i.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM i
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = i.doc_id AND i >= start + period AND i < start + length) GROUP BY i.doc_id),
t AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told,
         first({{'start': start, 'length': length, 'period': period}} ORDER BY length DESC, start, period) AS best
  FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
       (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""")
def op11_periodic_runs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    text = with_repeated_tail(F.col("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")))
    found = periodic_runs(docs.select("doc_id", text.alias("text")))
    best = found.withColumn("best", longest_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_merkle", f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (
  SELECT doc_id, coalesce('1' || source, '0') AS tree, {_leaf_sql('text')} AS leaf,
         CASE WHEN {_CRC_OF_ID} % 5 = 0 THEN {_leaf_sql(_LOWER)} END AS claimed
  FROM documents, crc),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
v AS (
  SELECT tree, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1 : i + 16], '')))
  FROM v WHERE len(nodes) > 1),
s AS (SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS rank FROM v WHERE len(nodes) = 1),
w AS (
  SELECT 0 AS level, list(subroot ORDER BY rank) AS nodes FROM s
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1 : i + 16], ''))) FROM w WHERE len(nodes) > 1),
g AS (
  SELECT tree, level, i AS grp, nodes[i * 16 + 1 : i * 16 + 16] AS run FROM v, unnest(range(0, (len(nodes) + 15) // 16)) u(i) WHERE len(nodes) > 1
  UNION ALL
  SELECT NULL, level, i, nodes[i * 16 + 1 : i * 16 + 16] FROM w, unnest(range(0, (len(nodes) + 15) // 16)) u(i) WHERE len(nodes) > 1),
k AS (
  SELECT doc_id, leaf, pos, tree, false AS up, level, pos // (16 ** level)::BIGINT AS place FROM p JOIN (SELECT DISTINCT tree, level FROM g) USING (tree)
  UNION ALL
  SELECT doc_id, leaf, pos, tree, true, level, rank // (16 ** level)::BIGINT FROM p JOIN s USING (tree), (SELECT DISTINCT level FROM g WHERE tree IS NULL)),
o AS (
  SELECT k.doc_id, k.leaf, k.tree, k.pos, array_to_string(run[: place % 16], '') AS front, array_to_string(run[place % 16 + 2 :], '') AS behind,
         row_number() OVER (PARTITION BY k.tree, k.pos ORDER BY up, k.level) AS step
  FROM k JOIN g ON g.level = k.level AND grp = place // 16 AND (NOT up AND g.tree = k.tree OR up AND g.tree IS NULL)),
f AS (
  SELECT tree, pos, 0 AS step, coalesce(claimed, leaf) AS digest FROM p
  UNION ALL
  SELECT f.tree, f.pos, o.step, sha256(front || digest || behind) FROM f JOIN o ON o.tree = f.tree AND o.pos = f.pos AND o.step = f.step + 1),
e AS (SELECT tree, pos, arg_max(digest, step) AS folded_root FROM f GROUP BY tree, pos),
x AS (SELECT tree, pos, sha256(string_agg(front || behind, '' ORDER BY step)) AS proof_sha256 FROM o GROUP BY tree, pos)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN s USING (tree) JOIN e USING (tree, pos) LEFT JOIN x USING (tree, pos), (SELECT nodes[1] AS root FROM w WHERE len(nodes) = 1)""")
def op13_merkle(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    fields = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    tampered = F.when(crc_mod(F.col("doc_id"), 5) == 0, leaf_digest(fields(lower_ascii(F.col("text")))))
    leaves = docs.select(F.col("doc_id").alias("id"), "source", leaf_digest(fields(F.col("text"))).alias("leaf"), tampered.alias("claimed"))
    return merkle_proofs(leaves).withColumnRenamed("id", "doc_id")


@query("op12_jaccard_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[]
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g
  FROM w),
n AS (SELECT doc_id, len(g) AS n FROM g),
s AS (SELECT doc_id, unnest(g) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 85 * (x.n + y.n - met)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n::BIGINT AS n_shingles, component_id FROM n JOIN c ON a = doc_id""")
def op12_jaccard_join(spark, sf_dir):
    return jaccard_classes(read(spark, sf_dir, "documents"))
