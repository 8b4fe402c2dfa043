"""One query per operator with production parameters, each over its whole table, and their SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    fill_middle, importance, language_id, line_dedup, ngram_join, piece_fst, quality_rank, quality_rules, source_mix, token_counts,
    token_files, top_k, url_filter,
)
from millrace.llm.common import fresh_folder, table
from millrace.plans.numbering import number_rows

TOKENIZER, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
END_ID = 2
URL_RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
MIX_SHARE, MIX_WEIGHTS = 1.5, (3, 1, 2)


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers are installed; every executor has them at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def fold(key: Column, of: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % of


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.ngram_join(docs, n=4, num=85, den=100, count_links=False)


def op1_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join with the number of links of each document."""
    return ngram_join.ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, num=85, den=100)


def source_weights(docs: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """The weights in turn, by the sources' order with NULL last."""
    names = docs.select("source").distinct().withColumn("rows", F.lit(1).cast("long"))
    numbered = number_rows(names, [F.col("source").asc_nulls_last()], "n", counted="rows")
    turns = F.array(*(F.lit(float(w)) for w in weights))
    return numbered.select("source", F.get(turns, ((F.col("n") - 1) % len(weights)).cast("int")).alias("weight"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = source_mix.mix(docs, source_weights(docs, MIX_WEIGHTS), MIX_SHARE)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge_quality(docs, keep_metrics=True)
    failed = F.lit(False)
    for rule in quality_rules.BASE:
        failed = failed | F.expr(rule.fails)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "kept",
    )


def op3_quality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts alone: a document that an early rule rejects costs nothing more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge_quality(docs).select("doc_id", "kept")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op5_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    ranking = quality_rank.learn(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    scored = quality_rank.score_documents(docs, ranking)
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs.filter(fold(F.col("doc_id"), 4) != 2))
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", "rejected"
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = piece_fst.encode_documents(docs, tokenizer_path(PIECE_MODEL), keep_text=False)
    return encoded.select("doc_id", "n_tokens", "ids", "round_trip")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = fresh_folder(spark)
    files = token_files.write_tokens(docs, folder, tokenizer_path(TOKENIZER), END_ID)
    return token_files.read_tokens(spark, folder, files, "ids_crc32 long", zlib.crc32)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path(TOKENIZER), limit=512)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_middle.fill_in_middle(docs, seed=42, rate=50, spm_rate=80)
    digests = {
        "output_sha256": F.col("fim_text"), "restored_sha256": fill_middle.restored(F.col("fim_text"), F.col("form")),
    }
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        *(F.sha2(c.cast("binary"), 256).alias(name) for name, c in digests.items()),
    )


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = importance.resample(docs, table(spark, sf_dir, "benchmark"), share=(5, 100), min_words=20, buckets=10_000, seed=42)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op1_ngram_jaccard_links, op2_mix_sources, op3_quality_rules, op3_quality_verdicts, op4_url_filter, op5_quality_ranking, op6_language_id,
        op7_sentencepiece, op8_top_k, op9_line_dedup, op10_token_files,
        op11_token_counts, op12_fill_in_middle, op13_importance_resampling,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEVEL = """
    SELECT greatest(0, (1.5::DOUBLE * any_value(s.total) - sum(CASE WHEN s.ratio < c.ratio THEN s.cap ELSE 0 END))
        / sum(CASE WHEN s.ratio >= c.ratio THEN s.weight ELSE 0 END)) AS level, c.ratio
    FROM sources s, (SELECT DISTINCT ratio FROM sources) c GROUP BY c.ratio
"""

ORACLES = {
    "op1_ngram_jaccard_join": rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)] END) AS g
  FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
""",
    "op1_ngram_jaccard_links": rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)] END) AS g
  FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y, c = p.n AND c = q.n AS equal FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 85 * (p.n + q.n - c)),
counted AS (SELECT x, count(*) FILTER (WHERE NOT equal) AS n_links FROM links GROUP BY x),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id,
  coalesce(any_value(n_links), 0)::BIGINT AS n_links
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) LEFT JOIN counted ON counted.x = d.doc_id
GROUP BY d.doc_id
""",
    "op2_mix_sources": rf"""
WITH docs AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(concat('17:', doc_id)) AS place FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
sources AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, cap / weight AS ratio, sum(source_size) OVER () AS total FROM (
    SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sized)),
levels AS ({_LEVEL}),
level AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio LIMIT 1),
targets AS (
  SELECT source, source_size, least(cap, weight * level) AS target,
    CASE WHEN source_size > 0 THEN floor(least(cap, weight * level) / source_size) ELSE 0 END AS whole
  FROM sources, level),
placed AS (
  SELECT docs.*, source_size, target, whole,
    sum(size) OVER (PARTITION BY docs.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN start + size / 2 < target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
""",
    "op3_quality_rules": rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
    [l FOR l IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS ls FROM documents),
grams AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest([[w[j], w[j + 1], w[j + 2]] FOR j IN range(1, len(w) - 1)]) AS g FROM docs),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
counted AS (
  SELECT docs.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT ({" OR ".join(f"({rule.fails})" for rule in quality_rules.RULES)}) AS kept
FROM counted
""",
    "op4_url_filter": rf"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
parsed AS (
  SELECT page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages)
SELECT page_id, p.host, p.path, r.host || r.path AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN rules r
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) = 1
""",
    "op8_top_k": """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([x[1] * x[2] FOR x IN list_zip(q.e, c.e)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER best)::INT AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 5
""",
    "op9_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (SELECT *, {_LOWER.format("trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')")} AS key FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(common.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (key) GROUP BY doc_id
""",
    "op12_fill_in_middle": r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(concat('42:', doc_id)) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
drawn AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM docs),
cut AS (
  SELECT *, array_to_string(units[1:least(x, y)], '') AS p, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS m,
    array_to_string(units[greatest(x, y) + 1:n], '') AS s FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256
FROM cut
""",
    "op13_importance_resampling": rf"""
WITH RECURSIVE steps(k, c, i) AS (
  SELECT k, k, 0 FROM range(256) t(k)
  UNION ALL SELECT k, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), i + 1 FROM steps WHERE i < 8),
crc AS (SELECT list(c ORDER BY k) AS step FROM steps WHERE i = 8),
texts AS (SELECT 'ours' AS side, doc_id, text FROM documents UNION ALL SELECT 'theirs', NULL, text FROM benchmark),
split AS (
  SELECT side, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT side, doc_id, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]
    || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS f FROM split),
found AS (SELECT side, doc_id, f, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT f, xor(4294967295, list_reduce([('0x' || h[2 * i - 1:2 * i])::BIGINT FOR i IN range(1, len(h) // 2 + 1)],
    lambda c, b: xor(c >> 8, step[xor(c & 255, b) + 1]), 4294967295)) % 10000 AS bucket
  FROM (SELECT DISTINCT f, hex(encode(f)) AS h FROM found), crc),
placed AS (SELECT side, doc_id, bucket, n FROM found JOIN hashed USING (f)),
totals AS (
  SELECT coalesce(sum(n) FILTER (WHERE side = 'ours'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 'theirs'), 0)::DOUBLE AS t FROM placed),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(sum(n) FILTER (WHERE side = 'theirs'), 0) + 1)::DOUBLE * (any_value(totals.s) + 10000)
    / ((coalesce(sum(n) FILTER (WHERE side = 'ours'), 0) + 1)::DOUBLE * (any_value(totals.t) + 10000))))::BIGINT AS gain
  FROM placed, totals GROUP BY bucket),
weighed AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket)
  WHERE side = 'ours' GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256(concat('42:', doc_id))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weighed USING (doc_id) WHERE side = 'ours'),
best AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS eligible FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, rank::BIGINT AS rank
FROM scored s LEFT JOIN (SELECT * FROM best WHERE rank <= 5 * eligible // 100) b ON b.doc_id = s.doc_id
""",
}
ORACLES["op3_quality_verdicts"] = f"SELECT doc_id, kept FROM ({ORACLES['op3_quality_rules']})"
