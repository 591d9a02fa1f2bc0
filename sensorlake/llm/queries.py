"""Queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.llm import chat_format, decontaminate, hard_negatives, html_extract, jaccard_join, language_id, line_dedup, packing, quality_rules, spelling, substring_dedup, url_filter, warc
from sensorlake.scratch import scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = (
    url_filter.UrlRule("allow", "com"), url_filter.UrlRule("block", "example.com", "/en/"),
    url_filter.UrlRule("allow", "www.example.com", "/en/"), url_filter.UrlRule("block", "net", "/es/"),
    url_filter.UrlRule("block", "net", "/fr/"),
)
URL_FALLBACK = (url_filter.UrlRule("block", globs=("*spam*", "*spam*/**", "*casino*", "*casino*/**", "*pills*", "*pills*/**")),)


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, fallback=URL_FALLBACK)


ORACLES["op5_url_filter"] = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(h, q, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                          ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS verdict
         FROM p JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, host, path, rule,
       coalesce(verdict, CASE WHEN contains(host, 'spam') OR contains(host, 'casino') OR contains(host, 'pills') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (page_id)
"""


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    records = chat_format.conversation_records(rows.unionByName(extra))
    return chat_format.read_back(chat_format.format_chats(records))


ORACLES["op6_chat_format"] = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS t FROM conversations
              UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
e AS (SELECT *, length(t) + length(t) - length(replace(t, '\', '')) + (length(t) - length(replace(t, '<|', ''))) // 2 AS n,
             length(role) + length(role) - length(replace(role, '\', '')) + (length(role) - length(replace(role, '<|', ''))) // 2
             + length(role) - length(replace(role, chr(10), '')) AS m FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN t END, '' ORDER BY turn, role, t), '')) AS loss_sha256,
       CAST(sum(12 + m + 1 + n + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_components(table(spark, sf_dir, "documents"))


#: Words [^\x20\x09-\x0D]+ of a text as a list.
SQL_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL_LOWER = SQL_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

ORACLES["op4_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {SQL_LOWER} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
meets AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM meets JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM comp LEFT JOIN n USING (doc_id)
"""


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit_field(docs, table(spark, sf_dir, "labels"))).drop("labels")


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op2_decontamination"] = f"""
WITH i AS (SELECT item_id, {SQL_LOWER} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda j: array_to_string(w[j:j + least(5, len(w)) - 1], ' '))) AS g
      FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM q GROUP BY item_id),
d AS (SELECT doc_id, {SQL_LOWER} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, CAST(len(w) - k + 2 AS BIGINT)), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS g
      FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k)
SELECT doc_id, item_id, any_value(n_shingles) AS n_shingles, count(*) AS n_common
FROM s JOIN q USING (k, g) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n_shingles)
"""


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op3_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS h FROM x),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM g),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM r, range(0, 20) AS t(j) WHERE nth > 1),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda v, p: NOT list_contains(ps, p)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    model = language_id.fit_languages(docs.where("NOT held_out"))
    found = language_id.identify(docs.withColumn("key", F.struct("doc_id", "held_out")), model, id_col="key")
    return found.select("key.doc_id", "key.held_out", "lang_pred", "score")


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, exact_chars=1).select("doc_id", "n_lines", "n_removed", "text")


ORACLES["op8_line_dedup"] = r"""
WITH l AS (SELECT doc_id, p, a[p] AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, len(a) + 1)) AS p)),
f AS (SELECT s, min((doc_id, p)) AS first, length(s) AS n FROM l WHERE length(s) >= 20 OR regexp_matches(s, '[\p{L}\p{N}]') GROUP BY s),
c AS (SELECT s, first, n, n AS c FROM f WHERE n >= 20 UNION ALL SELECT s, first, n, n - 1 FROM f WHERE n >= 20),
k AS (SELECT s, first, n, c, 'l' AS side, left(s, c // 2) AS h FROM c UNION ALL SELECT s, first, n, c, 'r', right(s, c - c // 2) FROM c),
near AS (SELECT DISTINCT b.s FROM k a JOIN k b USING (c, side, h) WHERE a.first < b.first AND levenshtein(a.s, b.s) <= 1),
gone AS (SELECT l.doc_id, l.p, l.s FROM l JOIN f USING (s) WHERE (l.doc_id, l.p) <> f.first OR l.s IN (SELECT s FROM near)),
m AS (SELECT l.doc_id, count(*) AS n_lines, count(g.p) AS n_removed, string_agg(CASE WHEN g.p IS NULL THEN l.s END, chr(10) ORDER BY l.p) AS kept
      FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.p = l.p GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text
FROM documents d LEFT JOIN m USING (doc_id)
"""


@query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


ORACLES["op11_hard_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
             CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
      FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"), typo=31)


ORACLES["op12_spelling_variants"] = r"""
WITH RECURSIVE table_of(t) AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i)
                     FROM (SELECT unnest(range(256)) AS i)),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) WHERE length(r) >= 7 GROUP BY ALL),
bytes AS (SELECT r, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS x FROM runs),
crc AS (SELECT r, n, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
                                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, table_of),
words AS (SELECT w AS word, sum(n)::BIGINT AS n
          FROM (SELECT CASE WHEN h % 31 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS w, n FROM crc)
          WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
keys AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
         UNION SELECT word, n, word FROM words),
letters(a, b) AS (SELECT string_agg(chr(192 + i), '' ORDER BY i), string_agg(chr(33 + i), '' ORDER BY i) FROM (SELECT unnest(range(64))::INTEGER AS i)),
pairs AS (SELECT DISTINCT x.word, x.n, y.word AS near, y.n AS near_n FROM keys x JOIN keys y USING (k), letters
          WHERE x.word <> y.word AND levenshtein(translate(x.word, a, b), translate(y.word, a, b)) = 1),  -- levenshtein counts bytes
best AS (SELECT word, count(*) AS n_near, CASE WHEN max(near_n) >= 10 * any_value(n) THEN max(near_n) END AS form_n,
                CASE WHEN max(near_n) >= 10 * any_value(n) THEN min((-near_n, near))[2] END AS form FROM pairs GROUP BY word),
follow(word, root) AS (SELECT word, form FROM best WHERE form IS NOT NULL UNION SELECT f.word, b.form FROM follow f JOIN best b ON b.word = f.root WHERE b.form IS NOT NULL),
last AS (SELECT word, root FROM follow WHERE root NOT IN (SELECT word FROM best WHERE form IS NOT NULL))
SELECT words.word, n, coalesce(n_near, 0) AS n_near, form, form_n, coalesce(root, words.word) AS root
FROM words LEFT JOIN best ON best.word = words.word LEFT JOIN last ON last.word = words.word
"""


@query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    found = warc.read_archives(spark, path, payload=False).where("gap IS NULL")
    page = lambda c: F.regexp_extract(c, r"<urn:record:(-?\d+)>", 1).cast("long")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


ORACLES["op13_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
o AS (SELECT *, octet_length(encode(h)) AS n, max(page_id) OVER (PARTITION BY h) AS original FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM original AND original IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM original AND original IS NOT NULL THEN original END AS refers_to
FROM o
"""
