"""The queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import (
    bpe, decontaminate, language, main_text, manifest, packing, pii, quality, repeats, resampling, secret_scan,
    simhash, warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _span_text(spans: Column) -> Column:
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text.extract_main_text(_table(spark, sf_dir, "pages"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; ``n_random`` counts the spans that the models add."""
    return secret_scan.scan(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", _sha256(F.col("base")).alias("base_sha256"), "spans", "n_random")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", digits.alias("fingerprint"), "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and posterior verdict of every document."""
    slim = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = quality.judge(slim, carry=["doc_id"])
    return counted.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "p_good")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        _sha256(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that stand in repeated 200-byte strings."""
    return repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.detect(_table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    base = F.filter("spans", lambda s: s["is_base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["is_base"] & (s["kind"] == kind))).cast("long")

    return found.select(
        "row.doc_id", *[count(kind).alias(f"n_{kind}") for kind in pii.BASE],
        _sha256(_span_text(base)).alias("base_sha256"), _span_text(F.col("spans")).alias("spans"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read back from the deduplicated archives of all pages."""
    return warc.archived(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every document."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and verification of every document."""
    return manifest.manifest(_table(spark, sf_dir, "documents")).select(
        "doc_id", "leaf", "subroot", "root", _sha256(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark texts."""
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of what they decode to."""
    vocabulary = bpe.load(spark)
    tokens = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    listed = tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha256(F.array_join("ids", ",")).alias("ids_sha256"), "ids")
    return bpe.decode(listed, vocabulary).select("doc_id", "n_tokens", "ids_sha256", _sha256(F.col("text")).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_main_text, op2_secrets, op3_simhash, op4_quality, op5_decontaminate, op6_language,
              op7_repeats, op8_pii, op9_warc, op10_packing, op11_manifest, op12_resampling, op13_bpe)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# CRC-32 of a string as SQL: the table of the 256 byte steps, then one step per byte.
_CRC_TABLE = """crc AS (SELECT list(step ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS step
  FROM range(256) AS t(i)))"""


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of the UTF-8 bytes of ``text``; needs ``crc`` in FROM."""
    byte = f"CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT)"
    return (f"xor(list_reduce([4294967295] || [{byte} FOR i IN range(strlen({text}))], "
            "lambda c, b: xor(c >> 8, tab[CAST(1 + (xor(c, b) & 255) AS INTEGER)])), 4294967295)")


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


ORACLES: dict[str, str] = {
    "op5_decontaminate": f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, w[s:s + 9] AS words, len(w[s:s + 9]) AS n
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM item WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT r, s, n, w[s:s + n - 1] AS words
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM doc, lengths WHERE len(w) >= n)),
hit AS (SELECT r, s, place.n AS n, item FROM place JOIN win ON place.words = win.words),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN items USING (r)""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM p),
b AS (
  SELECT page_id, payload_bytes, array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
      (CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)
    FOR i IN range(32)], '') AS payload_digest
  FROM d),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM b GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM b JOIN f USING (payload_digest)""",
    "op11_manifest": f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, {_leaf('text')} AS leaf,
      CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS changed
    FROM documents, crc)),
lower_tree AS (
  SELECT source, 0 AS k, pos, n, leaf AS h FROM d
  UNION ALL
  SELECT source, k + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM lower_tree WHERE n > 1 GROUP BY source, k, n, pos // 3),
s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lower_tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS k, pos, n, h FROM s
  UNION ALL
  SELECT k + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM upper_tree WHERE n > 1 GROUP BY k, n, pos // 3),
lower_runs AS (SELECT source, k, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM lower_tree WHERE n > 1 GROUP BY source, k, pos // 3),
upper_runs AS (SELECT k, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM upper_tree WHERE n > 1 GROUP BY k, pos // 3),
steps AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY half, k) AS i, idx, hs FROM (
  SELECT r, 0 AS half, k, hs, CAST((pos // CAST(pow(3, k) AS BIGINT)) % 3 AS INTEGER) AS idx
  FROM d JOIN lower_runs ON d.source IS NOT DISTINCT FROM lower_runs.source AND run = pos // CAST(pow(3, k + 1) AS BIGINT)
  UNION ALL
  SELECT r, 1, k, hs, CAST((s.pos // CAST(pow(3, k) AS BIGINT)) % 3 AS INTEGER)
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN upper_runs ON run = s.pos // CAST(pow(3, k + 1) AS BIGINT))),
fold AS (
  SELECT r, CAST(1 AS BIGINT) AS i, changed AS h FROM d
  UNION ALL
  SELECT r, i + 1, sha256(array_to_string(list_concat(hs[:idx], [h], hs[idx + 2:]), '')) FROM fold JOIN steps USING (r, i)),
ends AS (SELECT r, arg_max(h, i) AS folded_root FROM fold GROUP BY r),
proofs AS (SELECT r, string_agg(array_to_string(list_concat(hs[:idx], hs[idx + 2:]), ''), '' ORDER BY i) AS proof FROM steps GROUP BY r),
apex AS (SELECT h AS root FROM upper_tree WHERE n = 1)
SELECT doc_id, leaf, s.h AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN ends USING (r) LEFT JOIN proofs USING (r), apex""",
    "op12_resampling": f"""
WITH {_CRC_TABLE},
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
own AS (SELECT r, unnest(w) AS word FROM doc),
theirs AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
hashed AS (SELECT word, {_crc32('word')} % 10000 AS bucket FROM (SELECT word FROM own UNION SELECT word FROM theirs), crc),
s AS (SELECT bucket, count(*) AS s FROM own JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM theirs JOIN hashed USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000)
    / ((s::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000)))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (bucket)),
mean AS (SELECT r, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS total FROM own JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
weights AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS weight,
    (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE AS u
  FROM doc LEFT JOIN mean USING (r)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM weights),
able AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM able
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 20""",
}
