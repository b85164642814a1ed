"""The opN_ queries: each operator on its whole table with production parameters, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import ann, digest, langid, mixing, packing, periodic, phrases, pieces, pitman_yor, quality, simhash, tokenfile, urls
from tidewright.llm.common import crc_mod, table


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    filters = langid.train(docs.where(~held_out))
    return langid.predict(docs, filters, "doc_id", held_out)


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """Documents labelled good weigh 2, those labelled bad 0.5; the others 1."""
    return labels.where("quality is not null").select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels")))


OP3_SQL = """
WITH sized AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    -ln(((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || '|mix'), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0) / coalesce(w.weight, 1.0) AS key
  FROM documents d LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END) AS weight FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) w ON d.doc_id = w.doc_id),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
    (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight
  FROM sources),
levels AS (
  SELECT *, cap / weight AS fills_at,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS level
  FROM ranked WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (
  SELECT source, source_size, least(cap, weight * coalesce((SELECT level FROM levels WHERE level <= fills_at ORDER BY fills_at, level LIMIT 1), 1e300)) AS target FROM levels),
placed AS (
  SELECT s.*, a.source_size, a.target,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
    CASE WHEN a.source_size > 0 THEN floor(a.target / a.source_size) ELSE 0 END AS epochs
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, source, size, source_size, target,
  (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - place)))::BIGINT AS taken
FROM placed"""

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    # by the mean n-gram, as in the pipeline: a document's length does not decide, and the noise does where the ratio is near its limit
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), temperature=0.005, mean=True)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write_token_files(table(spark, sf_dir, "documents"), tokenizer(), end_id=2)
    return tokenfile.read_token_files(manifest)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer(), end_id=1)


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op10_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compare_with_next(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH lowered AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM lowered),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
sizes AS (SELECT unnest([1, 2, 3, 4, 5]) AS m),
starts AS (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM worded, sizes WHERE len(w) >= m),
counted AS (SELECT lang, m, w[i:i + m - 1] AS ws, count(*)::BIGINT AS f FROM starts GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, m, ws, f, unnest(range(1, m)) AS k FROM counted WHERE m > 1),
scored AS (
  SELECT c.lang, c.ws, c.f AS a, c.k, x.f AS l, y.f AS r, t.n, ((1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.ws = c.ws[1:c.k] JOIN counted y ON y.lang = c.lang AND y.ws = c.ws[c.k + 1:c.m] JOIN totals t ON t.lang = c.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, f, m, ws, unnest(range(1, m + 1)) AS i FROM counted WHERE m > 2),
covers AS (
  SELECT lang, ws[i:i + s - 1] AS part, max(f) AS cover FROM inner_parts, (SELECT unnest([2, 3, 4]) AS s) WHERE s < m AND i + s - 1 <= m GROUP BY ALL),
free AS (
  SELECT w.* FROM worst w LEFT JOIN covers v ON v.lang = w.lang AND v.part = w.ws WHERE v.cover IS NULL OR 100 * v.cover < 100 * w.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank, array_to_string(ws, ' ') AS phrase, a, l, r, n, score FROM free)
WHERE rank <= 2000"""


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_pitman_yor, op3_mixing, op4_url_filter, op5_importance_resampling, op6_token_files, op7_simhash, op8_packing, op9_cross_polytope, op10_digest, op11_periodic_runs, op12_phrases, op13_pieces)}
ORACLES: dict[str, str] = {"op3_mixing": OP3_SQL, "op12_phrases": OP12_SQL}
