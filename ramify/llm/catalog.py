"""The queries of this subpackage and, where SQL can express them, SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify.llm import chat, collocations, decontaminate, licenses, line_dedup, ngram_join, orc_tokens, packing, quality, simhash, spelling, topk, toxicity
from ramify.llm.labelled import remainder
from ramify.llm.staging import staged
from ramify.store import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=2)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4)
    return found.select("doc_id", "fingerprint", "component_id")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat.rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return views.select("conv_id", "perspective", "block", "n_turns", "text", spans.alias("mask"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), max_edits=1, min_chars=20)
    return cleaned.select("doc_id", "n_removed", "text")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), least=0.8)
    return found.select("doc_id", "unit", "number", "license", F.round("dice", 6).alias("dice"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"), steps=256)
    found = topk.top_products(vectors.filter("id % 50 = 0"), vectors, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 3) == 1
    found = staged(quality.figures(docs), "figures")
    scored = quality.scored(found, quality.learn(found, table(spark, sf_dir, "labels").filter(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )


def op9_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    orc_tokens.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=1)
    digests = orc_tokens.token_digests(orc_tokens.read_tokens(spark, path))
    return orc_tokens.token_starts(digests).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), least_chars=7, least_count=2, spoiled=31)
    return spelling.spelling_variants(words, ratio=10)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), support=100, longest=5, top=2000)


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_join(table(spark, sf_dir, "documents"), shingle=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_simhash, op3_chat, op4_line_dedup, op5_licenses,
        op6_topk, op7_quality, op8_toxicity, op9_orc_tokens, op10_decontaminate,
        op11_spelling, op12_collocations, op13_ngram_join,
    )
}

_quoted = lambda s: "'" + s.replace("'", "''") + "'"

_CHAT_SQL = rf"""
WITH said AS (
  SELECT conv_id, turn,
    CASE WHEN role IS NULL OR role = '' THEN 'unknown' ELSE regexp_replace(role, '[\s<>|]+', '_', 'g') END AS speaker,
    replace(coalesce(text, ''), '<|', '< |') AS said
  FROM conversations),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, said) AS nr FROM said),
views AS (
  SELECT r.*, p.perspective, (nr - 1) // {chat.BLOCK_TURNS} AS block,
    '{chat.OPEN}' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system'
      ELSE 'user name=' || speaker END || chr(10) AS head,
    said || '{chat.CLOSE}' AS body
  FROM ranked r JOIN (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM said WHERE speaker <> 'system') p
    ON r.conv_id IS NOT DISTINCT FROM p.c),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, block ORDER BY nr
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS s FROM views)
SELECT conv_id, perspective, CAST(block AS BIGINT) AS block, CAST(count(*) AS INTEGER) AS n_turns,
  string_agg(head || body || chr(10), '' ORDER BY nr) AS text,
  coalesce(string_agg(CAST(CAST(s AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(s + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY nr)
    FILTER (WHERE speaker = perspective), '') AS mask
FROM placed GROUP BY conv_id, perspective, block
"""

# One edit apart: equal without the same character, or one equals the other without one character.
_LINES_SQL = rf"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS no FROM split),
lines AS (
  SELECT * FROM (SELECT doc_id, no, trim(regexp_replace(translate(raw, '{UPPER}', '{LOWER}'), '[ \t\r\f\x0B]+', ' ', 'g'), ' ') AS line FROM numbered)
  WHERE length(line) >= {line_dedup.MIN_CHARS}),
firsts AS (SELECT line, min((doc_id, no)) AS f, length(line) AS n, hash(line) AS h FROM lines GROUP BY line),
shorter AS (SELECT line, f, n, i, hash(substr(line, 1, i - 1) || substr(line, i + 1)) AS h FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM firsts)),
pairs AS (
  SELECT a.f AS x, b.f AS y FROM shorter a JOIN shorter b ON a.h = b.h AND a.n = b.n AND a.i = b.i AND a.f < b.f
  UNION ALL SELECT a.f, b.f FROM shorter a JOIN firsts b ON a.h = b.h AND a.n = b.n + 1),
later AS (SELECT DISTINCT greatest(x, y) AS f FROM pairs),
gone AS (
  SELECT l.doc_id, l.no FROM lines l JOIN firsts f ON l.line = f.line
  WHERE (l.doc_id, l.no) <> f.f OR f.f IN (SELECT f FROM later)),
kept AS (
  SELECT n.doc_id, string_agg(n.raw, chr(10) ORDER BY n.no) FILTER (WHERE g.no IS NULL) AS text, count(g.no) AS n_removed
  FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.no = g.no GROUP BY n.doc_id)
SELECT d.doc_id, CAST(coalesce(k.n_removed, 0) AS INTEGER) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

_WORDS_SQL = rf"regexp_extract_all(translate({{}}, '{UPPER}', '{LOWER}'), '[0-9a-z\x{{{{80}}}}-\x{{{{10FFFF}}}}]+')"


def _words_sql(text: str) -> str:
    return _WORDS_SQL.format(text).replace("{{", "{").replace("}}", "}")


def _bigrams_sql(words: str) -> str:
    return f"list_distinct(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]))"


_LICENSES_SQL = rf"""
WITH templates AS (
  SELECT license, {_bigrams_sql("w")} AS b FROM (
    SELECT license, {_words_sql("x")} AS w FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in licenses.TEMPLATES.items())}) AS v(license, x))),
texts AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, regexp_split_to_array(text, '\n[ \t\r]*\n') AS p FROM documents WHERE length(text) > 0),
units AS (
  SELECT doc_id, 'line' AS unit, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS number FROM texts
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph' AS unit, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS number FROM texts WHERE len(l) > 1) WHERE contains(x, chr(10))
  UNION ALL SELECT doc_id, 'document', text, 0 FROM texts WHERE len(p) > 1),
counted AS (SELECT *, {_words_sql("x")} AS w FROM units),
grams AS (SELECT doc_id, unit, number, {_bigrams_sql("w")} AS b FROM counted WHERE len(w) BETWEEN 2 AND 1000),
compared AS (
  SELECT doc_id, unit, number, license, 2.0 * len(list_intersect(g.b, t.b)) / (len(g.b) + len(t.b)) AS dice
  FROM grams g JOIN templates t ON len(g.b) BETWEEN len(t.b) * 0.6 AND len(t.b) * 1.6)
SELECT doc_id, unit, CAST(number AS BIGINT) AS number, license, round(CAST(dice AS DOUBLE), 6) AS dice FROM compared WHERE dice >= 0.8
"""

_TOPK_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id % 50 = 0 AND c.id <> q.id AND len(c.v) = len(q.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

_DECONTAMINATE_SQL = rf"""
WITH items AS (SELECT item_id, {_words_sql("coalesce(text, '')")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + {decontaminate.WINDOW} - 1], ' ') AS x, least(len(w), {decontaminate.WINDOW}) AS n
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {decontaminate.WINDOW} + 1, 1) + 1)) AS s FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_words_sql("coalesce(text, '')")} AS w FROM documents),
parts AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS x
  FROM (SELECT d.doc_id, d.w, z.n, unnest(range(1, len(d.w) - z.n + 2)) AS s FROM docs d JOIN (SELECT DISTINCT n FROM windows) z ON len(d.w) >= z.n)),
hits AS (SELECT p.doc_id, p.s, p.n, w.item_id FROM parts p JOIN windows w ON p.n = w.n AND p.x = w.x),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN words h ON d.doc_id = h.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id
"""

_COLLOCATIONS_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\n\x0B\f\r]')) AS p FROM documents),
split AS (SELECT lang, regexp_extract_all(p, '[^ \t]+') AS w FROM pieces),
phrases AS (
  SELECT lang, phrase, words, count(*) AS f FROM (
    SELECT lang, words, array_to_string(w[s:s + words - 1], ' ') AS phrase
    FROM (SELECT lang, w, words, unnest(range(1, len(w) - words + 2)) AS s FROM split, range(1, 6) AS z(words) WHERE len(w) >= words))
  GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM phrases WHERE words = 1 GROUP BY lang),
found AS (SELECT *, string_split(phrase, ' ') AS w FROM phrases WHERE f >= 100),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, words)) AS k FROM found WHERE words > 1)),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n,
    (1000 * CAST(c.a AS HUGEINT) * CAST(n AS HUGEINT)) // (CAST(x.f AS HUGEINT) * y.f) AS score, k
  FROM cuts c JOIN found x ON x.lang = c.lang AND x.phrase = c.x JOIN found y ON y.lang = c.lang AND y.phrase = c.y JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM found o WHERE o.lang = b.lang AND o.f >= b.a AND len(o.phrase) > len(b.phrase) AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""

_JACCARD_SQL = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^ \t\n\r\f\x0B]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
    FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON r = x),
smallest AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id),
counted AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM documents d JOIN smallest m ON d.doc_id = m.doc_id LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN counted c ON d.doc_id = c.x
"""

ORACLES: dict[str, str] = {
    "op3_chat": _CHAT_SQL,
    "op4_line_dedup": _LINES_SQL,
    "op5_licenses": _LICENSES_SQL,
    "op6_topk": _TOPK_SQL,
    "op10_decontaminate": _DECONTAMINATE_SQL,
    "op12_collocations": _COLLOCATIONS_SQL,
    "op13_ngram_join": _JACCARD_SQL,
}
