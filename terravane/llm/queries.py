"""The queries of this subpackage over the given tables, and their SQL where SQL can express them."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprints, html_extract, importance, langid_ecoc, lexical, mixing, pieces, pii, quality_knn, secret_scan, simhash_neardup, substring
from .common import crc32_of, cut, sha_hex, table


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_neardup.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_neardup.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_of(F.col("doc_id")) % 5 == 0
    labels = table(spark, sf_dir, "labels").where(~held_out)
    model = quality_knn.fit(docs, labels, "quality")
    scored = docs.select("doc_id", held_out.alias("held_out"), quality_knn.quality(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality_knn.THRESHOLD).cast("int"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op4_langid_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc32_of(F.col("doc_id")) % 4 == 2
    model = langid_ecoc.fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), langid_ecoc.identify(docs, model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.ambiguous")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(
        fingerprints.compare_with_edits(table(spark, sf_dir, "documents")).select(
            F.col("id").alias("doc_id"), "n_chars", sha_hex(F.col("edited")).alias("edited_sha256"), "fp", "edited_fp", "near_edited", "near_next"
        )
    )
    # The search asks for the documents whose id is divisible by 100, over distinct fingerprints.
    classes = found.groupBy("fp").agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))).alias("asked"), F.min("doc_id").alias("first"))
    near = fingerprints.within_radius(classes.where("asked").select("fp"), classes.select("fp"))
    # Of each fingerprint found, the smallest id stands for its documents.
    others = F.array_sort(F.collect_set(F.when(F.col("fp") != F.col("query"), F.col("first"))))
    near = near.join(classes.select("fp", "n", "first"), "fp").groupBy(F.col("query").alias("fp")).agg((F.sum("n") - 1).alias("n_within"), others.alias("near"))
    joined = found.join(near, "fp", "left")
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        simhash_neardup.hex16(F.col("fp")).alias("fingerprint"),
        simhash_neardup.hex16(F.col("edited_fp")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.when(F.col("doc_id") % 100 == 0, F.col("n_within")).alias("n_within_radius"),
        F.when(F.col("doc_id") % 100 == 0, F.col("near")).alias("near_doc_ids"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", sha_hex(F.col("kept")).alias("kept_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", "n_chars")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontam.items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.Model(spark, public_tokenizers.path("piece_bpe_32k.model"))
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, decoded="decoded")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha_hex(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), sha_hex(F.col("decoded")).alias("decoded_sha256"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_simhash_neardup": op1_simhash_neardup,
    "op2_quality_knn": op2_quality_knn,
    "op3_mixing": op3_mixing,
    "op4_langid_ecoc": op4_langid_ecoc,
    "op5_pii": op5_pii,
    "op6_fingerprints": op6_fingerprints,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op10_html_extract": op10_html_extract,
    "op9_decontaminate": op9_decontaminate,
    "op11_lexical_search": op11_lexical_search,
    "op12_pieces": op12_pieces,
    "op13_importance": op13_importance,
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3_SQL = rf"""
WITH RECURSIVE counted AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS n_tokens FROM documents),
totals AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM counted GROUP BY source),
sums AS (SELECT * FROM totals WHERE tokens > 0),
top AS (SELECT CAST(max(tokens) AS DOUBLE) AS most FROM sums),
shape AS (SELECT list(ln(tokens / most) ORDER BY tokens, source) AS logs, {mixing.ENTROPY}::DOUBLE * ln(count(*)::DOUBLE) AS target FROM sums, top),
by_entropy AS (
  SELECT 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi, 0.5::DOUBLE AS mid
  UNION ALL
  SELECT i + 1, lo, hi, (lo + hi) / 2 FROM (
    SELECT i,
      CASE WHEN ln(list_sum([exp(mid * x) for x in logs])) - mid * list_sum([x * exp(mid * x) for x in logs]) / list_sum([exp(mid * x) for x in logs]) >= target THEN mid ELSE lo END AS lo,
      CASE WHEN ln(list_sum([exp(mid * x) for x in logs])) - mid * list_sum([x * exp(mid * x) for x in logs]) / list_sum([exp(mid * x) for x in logs]) >= target THEN hi ELSE mid END AS hi
    FROM by_entropy, shape WHERE i < {mixing.STEPS})),
over AS (
  SELECT 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi, 0.5::DOUBLE AS mid
  UNION ALL
  SELECT i + 1, lo, hi, (lo + hi) / 2 FROM (
    SELECT i, CASE WHEN exp((mid - 1) * list_min(logs)) > {mixing.REPEATS} THEN mid ELSE lo END AS lo, CASE WHEN exp((mid - 1) * list_min(logs)) > {mixing.REPEATS} THEN hi ELSE mid END AS hi
    FROM over, shape WHERE i < {mixing.STEPS})),
chosen AS (
  SELECT round(greatest(
    CASE WHEN ln(list_sum([exp(x) for x in logs])) - list_sum([x * exp(x) for x in logs]) / list_sum([exp(x) for x in logs]) >= target THEN 1 ELSE (SELECT lo FROM by_entropy WHERE i = {mixing.STEPS}) END,
    CASE WHEN exp(-list_min(logs)) > {mixing.REPEATS} THEN (SELECT lo FROM over WHERE i = {mixing.STEPS}) ELSE 0 END), 6) AS alpha, logs FROM shape),
weighted AS (SELECT source, tokens, round(exp(alpha * ln(tokens / most)) / list_sum([exp(alpha * x) for x in logs]), 12) AS weight FROM sums, top, chosen),
whole AS (SELECT ceil(max(round(tokens / weight, 3))) AS whole FROM weighted),
budgets AS (SELECT source, tokens, weight, greatest(CAST(floor(round(weight * whole, 3)) AS BIGINT), tokens) AS budget FROM weighted, whole
  UNION ALL SELECT source, tokens, 0::DOUBLE, 0 FROM totals WHERE tokens = 0),
turns AS (
  SELECT doc_id, c.source, n_tokens, tokens, weight, budget, unnest(range(0, CASE WHEN tokens > 0 THEN CAST(greatest(ceil(budget / tokens), 1) AS BIGINT) ELSE 1 END)) AS pass
  FROM counted c JOIN budgets b ON c.source IS NOT DISTINCT FROM b.source),
placed AS (
  SELECT *, CAST(pass * tokens + sum(n_tokens) OVER (PARTITION BY source, pass ORDER BY md5('{mixing.SEED}:' || pass || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS BIGINT) AS place
  FROM turns)
SELECT doc_id, source, n_tokens, weight, pass, CASE WHEN budget > 0 THEN least(CAST(floor(place * {mixing.BLOCKS} / budget) AS BIGINT), {mixing.BLOCKS - 1}) ELSE 0 END AS block, place
FROM placed WHERE place < budget OR pass = 0
"""

OP7_SQL = rf"""
WITH worded AS (SELECT doc_id, {WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM worded),
windows AS (SELECT doc_id, p, w[p] AS word, CASE WHEN p + {substring.WINDOW - 1} <= len(w) THEN array_to_string(w[p : p + {substring.WINDOW - 1}], ' ') END AS win FROM places),
marked AS (SELECT doc_id, p, word, CAST(win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1 AS INT) AS again FROM windows),
covered AS (SELECT doc_id, p, word, max(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {substring.WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM marked),
kept AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM covered GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM worded LEFT JOIN kept USING (doc_id)
"""

ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9_SQL = rf"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {ITEM_WORDS} AS w FROM benchmark),
cuts AS (SELECT item, w, least(len(w), {decontam.WINDOW}) AS n, unnest(range(1, greatest(len(w) - {decontam.WINDOW - 1}, 1) + 1)) AS p FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS win FROM cuts),
worded AS (SELECT doc_id, {ITEM_WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM worded),
spots AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS win FROM places, (SELECT DISTINCT n FROM wins) WHERE p + n - 1 <= len(w)),
hits AS (SELECT doc_id, p, n, item FROM spots JOIN wins USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = rf"""
WITH worded AS (SELECT row_number() OVER () AS doc, doc_id, {TERMS} AS w FROM documents),
docs AS (SELECT doc, doc_id, CAST(len(w) AS BIGINT) AS n FROM worded WHERE len(w) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM docs),
counted AS (SELECT doc, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc, unnest(w) AS term FROM worded) GROUP BY doc, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM counted, whole GROUP BY term, docs),
asked AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
scored AS (
  SELECT item_id, doc, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN docs USING (doc), whole GROUP BY item_id, doc),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored JOIN docs USING (doc) WHERE score > 0)
SELECT item_id, CAST(place AS INT) AS "rank", doc_id, score FROM ranked WHERE place <= {lexical.K}
"""

OP13_SQL = rf"""
WITH signs AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
worded AS (SELECT row_number() OVER () AS doc, doc_id, FALSE AS target, {ITEM_WORDS} AS w FROM documents UNION ALL SELECT -row_number() OVER (), NULL, TRUE, {ITEM_WORDS} FROM benchmark),
runs AS (SELECT doc, target, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) AS run FROM worded),
named AS (SELECT run, hex(encode(run)) AS h FROM (SELECT DISTINCT run FROM runs)),
hashed AS (SELECT run, xor(list_reduce(list_prepend(4294967295, [(strpos('123456789ABCDEF', h[i]) * 16 + strpos('123456789ABCDEF', h[i + 1]))::BIGINT for i in range(1, len(h), 2)]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {importance.BUCKETS} AS bucket FROM named, signs),
held AS (SELECT doc, target, bucket, CAST(count(*) AS BIGINT) AS n FROM runs JOIN hashed USING (run) GROUP BY doc, target, bucket),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (NOT target), 0) AS s, coalesce(sum(n) FILTER (target), 0) AS t FROM held GROUP BY bucket),
whole AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM sums),
gains AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (s_all + {importance.BUCKETS})) / ((s + 1)::DOUBLE * (t_all + {importance.BUCKETS})))) AS BIGINT) AS gain FROM sums, whole),
weighed AS (SELECT doc, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM held JOIN gains USING (bucket) WHERE NOT target GROUP BY doc),
drawn AS (
  SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM worded LEFT JOIN weighed USING (doc) WHERE NOT target),
placed AS (SELECT *, row_number() OVER (PARTITION BY words >= {importance.LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (words >= {importance.LEAST_WORDS}) OVER () AS able FROM drawn)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= {importance.LEAST_WORDS} AND place <= {importance.SHARE} * able // 100 THEN place END AS "rank" FROM placed
"""

ORACLE_SQL: dict[str, str] = {"op3_mixing": OP3_SQL, "op7_substring_dedup": OP7_SQL, "op9_decontaminate": OP9_SQL, "op11_lexical_search": OP11_SQL, "op13_importance": OP13_SQL}
