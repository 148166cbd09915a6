"""Registered queries of the text operators and the SQL that checks them where SQL can express the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer_path

from benefica.llm import (
    collocations, embedding_dedup, exact_dedup, language_id, license_scan, packing, phrase_dedup, piece_sampling, secret_scan, simhash_dedup, token_count, whitening,
    window_packing,
)
from benefica.llm.common import stage


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, folder, "embeddings"))


def op2_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, folder, "documents"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.mark_duplicates(_table(spark, folder, "documents"))


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt")))
    return license_scan.scan(_table(spark, folder, "documents").withColumn("path", name))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(_table(spark, folder, "documents"))


def op6_piece_sampling(spark: SparkSession, folder: str) -> DataFrame:
    rows = piece_sampling.encode(_table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"), seed=1, check=True)
    return rows.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), "lossless")


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packing.pack(stage(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces"))


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, folder, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(of("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_dedup.remove_repeats(_table(spark, folder, "documents"))


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op13_window_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = window_packing.pack_in_order(_table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_simhash_near_dedup, op3_exact_dedup, op4_license_scan, op5_language_id, op6_piece_sampling,
                                  op7_best_fit_packing, op8_secret_scan, op9_token_counts, op10_substring_dedup, op11_phrase_collocations,
                                  op12_embedding_whitening, op13_window_packing)}

_NOTICES = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(license_scan.TEMPLATES.items()))
_LICENCES = f"""
WITH t AS (SELECT doc_id, concat_ws('/', source, lang, doc_id || '.txt') AS path, text FROM documents),
  tpl(k, name, body) AS (VALUES {_NOTICES}),
  tw AS (SELECT k, unnest(list_filter(regexp_split_to_array(lower(body), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM tpl),
  vocab AS (SELECT DISTINCT w FROM tw), total AS (SELECT count(*) AS n FROM t),
  df AS (SELECT w, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM t)
    JOIN vocab USING (w) GROUP BY w),
  idf AS (SELECT w, ln((1 + total.n) / (1 + coalesce(df.n, 0))) + 1 AS x FROM vocab LEFT JOIN df USING (w), total),
  tv AS (SELECT k, w, count(*) * x AS v FROM tw JOIN idf USING (w) GROUP BY k, w, x),
  tn AS (SELECT k, sqrt(sum(v * v)) AS n FROM tv GROUP BY k),
  lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS said FROM t),
  lw AS (SELECT doc_id, line, w, count(*) AS c FROM (SELECT doc_id, line, unnest(regexp_split_to_array(lower(said), '[^a-z0-9]+')) AS w
    FROM lines) WHERE w <> '' GROUP BY ALL),
  lv AS (SELECT doc_id, line, w, c * coalesce(x, (SELECT ln(1 + n) + 1 FROM total)) AS v FROM lw LEFT JOIN idf USING (w)),
  lnorm AS (SELECT doc_id, line, sqrt(sum(v * v)) AS n FROM lv GROUP BY ALL),
  dot AS (SELECT doc_id, line, k, sum(lv.v * tv.v) AS d FROM lv JOIN tv USING (w) GROUP BY ALL),
  cosine AS (SELECT doc_id, k, d / (lnorm.n * tn.n) AS c FROM dot JOIN lnorm USING (doc_id, line) JOIN tn USING (k)),
  own AS (SELECT doc_id, name AS own_license, round(c, 6) AS own_cosine FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
    ORDER BY c DESC, k) AS z FROM cosine WHERE c >= {license_scan.THRESHOLD}) JOIN tpl USING (k) WHERE z = 1),
  known AS (SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, own_license, own_cosine,
    len(regexp_split_to_array(trim(coalesce(text, '')), '\\s+')) AS n_words FROM t LEFT JOIN own USING (doc_id)),
  speaks AS (SELECT dir, max_by(own_license, (own_cosine, own_license)) AS license FROM known
    WHERE own_license IS NOT NULL AND n_words <= {license_scan.FILE_WORDS} GROUP BY dir),
  above AS (SELECT k.dir AS of, max_by((s.license, s.dir), len(s.dir)) AS f FROM (SELECT DISTINCT dir FROM known) k
    JOIN speaks s ON k.dir = s.dir OR starts_with(k.dir, s.dir || '/') GROUP BY 1)
SELECT doc_id, path, own_license, own_cosine, coalesce(own_license, f[1]) AS license,
  CASE WHEN own_license IS NOT NULL THEN 'own' WHEN f IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own_license IS NULL THEN f[2] END AS from_dir FROM known LEFT JOIN above ON above.of = known.dir
"""

_COLLOCATIONS = rf"""
WITH t AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents),
  pieces AS (SELECT row, lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
  w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
  f1 AS (SELECT lang, x, count(*) AS a FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY ALL),
  n AS (SELECT lang, sum(a)::BIGINT AS n FROM f1 GROUP BY lang),
  spots AS (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w),
  f2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS a FROM spots GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
  f3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS a FROM spots WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
  held AS (SELECT lang, x, y, max(a) AS a FROM (SELECT lang, x, y, a FROM f3 UNION ALL SELECT lang, y, z, a FROM f3) GROUP BY ALL),
  cuts AS (
    SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, 1 AS k, f2.a, p.a AS l, q.a AS r FROM f2 JOIN f1 p ON p.lang = f2.lang AND p.x = f2.x
      JOIN f1 q ON q.lang = f2.lang AND q.x = f2.y LEFT JOIN held h ON h.lang = f2.lang AND h.x = f2.x AND h.y = f2.y WHERE h.a IS NULL OR 100 * h.a < 50 * f2.a
    UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, 1, f3.a, p.a, q.a FROM f3 JOIN f1 p ON p.lang = f3.lang AND p.x = f3.x
      JOIN f2 q ON q.lang = f3.lang AND q.x = f3.y AND q.y = f3.z
    UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, 2, f3.a, p.a, q.a FROM f3 JOIN f2 p ON p.lang = f3.lang AND p.x = f3.x AND p.y = f3.y
      JOIN f1 q ON q.lang = f3.lang AND q.x = f3.z),
  scored AS (SELECT *, (1000000::HUGEINT * a::HUGEINT * a::HUGEINT // (l::HUGEINT * r::HUGEINT))::BIGINT AS score FROM cuts),
  best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

SQL = {
    "op11_phrase_collocations": _COLLOCATIONS,
    "op4_license_scan": _LICENCES,
    "op1_embedding_near_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach(node, seen) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.b, r.seen FROM reach r JOIN links l ON l.a = r.node
), part AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN part ON part.node = vec_id
""",
    "op3_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM n
""",
}
