"""The corpus queries by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.collocations import collocations
from plumbline.llm.exact_dedup import exact_duplicates
from plumbline.llm.language_id import fit_centroids, held_out, predict_languages
from plumbline.llm.mixing import mix
from plumbline.llm.order_minhash import near_duplicates
from plumbline.llm.packing import packing_digest
from plumbline.llm.pii import find_personal_data
from plumbline.llm.quality_crf import fit_quality, score_quality
from plumbline.llm.sentencepiece_bpe import encoding_digest
from plumbline.llm.spelling import spelling_variants
from plumbline.llm.substring_dedup import remove_repeated_passages
from plumbline.llm.token_counts import count_by_files
from plumbline.llm.word_bpe import word_bpe_digest


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_centroids(docs.where(~held_out()))
    found = predict_languages(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digest(documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op7_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digest(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by_files(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe_digest(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_pii": op5_pii,
    "op6_order_minhash": op6_order_minhash,
    "op7_token_packing": op7_token_packing,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
    "op11_spelling": op11_spelling,
    "op12_collocations": op12_collocations,
    "op13_word_bpe": op13_word_bpe,
}

#: Words of op11 in SQL: CRC-32 by its polynomial, a byte at a time, from a table that the query makes.
_SPELLING_WORDS = r"""
bits AS (SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc FROM range(256) t(i)),
steps AS (SELECT list(crc ORDER BY i) AS crcs FROM bits),
runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
codes AS (SELECT *, lower(hex(encode(concat(doc_id, ':', run)))) AS h FROM runs),
sums AS (
  SELECT run, k,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
             lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM codes, steps),
words AS (
  SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, CAST(crc % length(run) AS BIGINT)) || substr(run, CAST(crc % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM sums),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM words GROUP BY word HAVING sum(k) >= 3 AND length(word) >= 5)"""

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d""",
    "op11_spelling": f"""
WITH RECURSIVE {_SPELLING_WORDS},
cuts AS (SELECT word, n, i, substr(word, 1, CAST(i AS BIGINT)) || substr(word, CAST(i AS BIGINT) + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cuts c JOIN v ON c.rest = v.word
  UNION SELECT v.word, c.word, c.n FROM cuts c JOIN v ON c.rest = v.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word),
pick AS (SELECT near.word, min(encode(near.other)) AS other FROM near JOIN best ON near.word = best.word AND near.n = best.most GROUP BY near.word),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * v.n THEN decode(other) END AS form, CASE WHEN most >= 2 * v.n THEN most END AS form_n
  FROM v LEFT JOIN best ON v.word = best.word LEFT JOIN pick ON v.word = pick.word),
paths AS (SELECT word, coalesce(form, word) AS root FROM forms UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON p.root = f.word AND f.form IS NOT NULL WHERE p.root <> p.word),
ends AS (SELECT p.word, p.root FROM paths p JOIN forms f ON p.root = f.word WHERE f.form IS NULL)
SELECT forms.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN ends ON forms.word = ends.word""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
grams AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase FROM words, range(1, 5) t(size)),
f AS (SELECT lang, phrase, size, CAST(count(*) AS BIGINT) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM words GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM c),
scores AS (
  SELECT cuts.lang, cuts.phrase, cuts.f AS a, cuts.size, k, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * cuts.f // (x.f + y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(ws[i:i + part - 1], ' ') AS phrase, max(f) AS f FROM c, range(2, 4) t(part), range(1, 4) s(i) WHERE part < size AND i + part - 1 <= size GROUP BY ALL),
kept AS (SELECT l.* FROM lowest l LEFT JOIN inside i ON i.lang = l.lang AND i.phrase = l.phrase WHERE i.f IS NULL OR 100::HUGEINT * i.f < 80::HUGEINT * l.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000""",
    "op10_mixing": r"""
WITH d AS (
  SELECT doc_id, source, md5('42:' || doc_id) AS k,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
c AS (
  SELECT *, coalesce(sum(cap) OVER p, 0.0) AS full_, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0.0) AS open_,
         1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS size_
  FROM w WINDOW p AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max(CASE WHEN (size_ - full_) / open_ * weight <= cap THEN (size_ - full_) / open_ END) OVER () AS level FROM c),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END AS target FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, whole + CASE WHEN size > 0 AND start + size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END AS repeats FROM r)
SELECT doc_id, size, source_size, target, CAST(size * repeats AS BIGINT) AS taken, CAST(repeats AS BIGINT) AS repeats FROM f""",
}
