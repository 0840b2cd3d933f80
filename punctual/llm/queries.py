"""The operators of this subpackage as named queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, extraction, fill_in_middle, fingerprints, language, mixing, neardup, packing, periodic_runs, personal_data, quality_rules, quality_score, toxicity
from .storage import new_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def bradley_terry_quality(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: its quality score; ids whose crc32 leaves 1 modulo 3 are held out of training."""
    docs, held_out = _table(spark, folder, "documents"), language.is_held_out(F.col("doc_id"), 3, 1)
    model = quality_score.train(docs, _table(spark, folder, "labels"), eligible=~held_out)
    return quality_score.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def viterbi_language(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: its language; ids whose crc32 leaves 2 modulo 4 are held out of training."""
    docs, held_out = _table(spark, folder, "documents"), language.is_held_out(F.col("doc_id"), 4, 2)
    model = language.train(docs.where(~held_out))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def ordinal_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: its expected severity and whether it is toxic."""
    docs = _table(spark, folder, "documents")
    return toxicity.graded(docs, toxicity.train(docs, _table(spark, folder, "labels")))


def divergence_rules(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: base counts, base verdict and the verdict of the divergence rules."""
    return quality_rules.judged(_table(spark, folder, "documents")).drop("language", "char_distance", "word_distance")


def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: its near-duplicate class and whether it is the one that stays."""
    return neardup.near_duplicates(_table(spark, folder, "documents")).selectExpr(
        "doc_id", "class_id", "doc_id <=> class_id as kept"
    )


def crf_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page: its main text."""
    pages = _table(spark, folder, "pages")
    return extraction.extract(pages, extraction.train(pages))


def packed_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and a checksum of its ids."""
    return packing.pack(_table(spark, folder, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def winnowing(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: fingerprints of its text and its edited text, and how alike they are."""
    return fingerprints.edited_fingerprints(_table(spark, folder, "documents"))


def mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes."""
    return mixing.mixture(_table(spark, folder, "documents"))


def warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page, read back from the archives written for all pages."""
    at = new_folder(spark, "archives")
    archives.write_archives(_table(spark, folder, "pages"), at)
    return archives.read_archives(spark, at).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def personal_spans(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: the rules' personal data by kind, its digest, and all spans with those of the field."""
    docs = _table(spark, folder, "documents")
    found = personal_data.personal_data(docs, personal_data.train(docs))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in personal_data.KINDS],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def periodic_words(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, some of them rewritten to repeat words: its periodic runs and its text without them."""
    found = periodic_runs.periodic_runs(_table(spark, folder, "documents"), periodic_runs.planted)
    best = found.withColumn("best", periodic_runs.strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        periodic_runs.runs_digest(F.col("runs")).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def fim_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: how it is transformed, and digests of its output and of the text restored from it."""
    return fill_in_middle.digests(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bradley_terry_quality": bradley_terry_quality,
        "op2_minhash_near_dedup": minhash_near_dedup,
        "op3_crf_main_text": crf_main_text,
        "op4_power_of_two_packing": packed_pieces,
        "op5_winnowing": winnowing,
        "op6_viterbi_language": viterbi_language,
        "op7_source_mix": mixed_sources,
        "op8_ordinal_toxicity": ordinal_toxicity,
        "op9_divergence_rules": divergence_rules,
        "op10_warc_revisits": warc_revisits,
        "op11_semi_markov_pii": personal_spans,
        "op12_periodic_runs": periodic_words,
        "op13_fill_in_middle": fim_documents,
    }


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, {1 + 5 * (i // 4)}, 5))::BIGINT >> {15 - 5 * (i % 4)}) % 32, 1)"
    for i in range(32)
)

_MIX = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM sized GROUP BY source),
w AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights,
         coalesce(sum(cap) OVER o, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER o, 0)::BIGINT AS weight_before
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * (weights - weight_before) <= weight * (total - cap_before) AS capped FROM l),
t AS (
  SELECT source, source_size, cap,
         CASE WHEN capped THEN cap::DOUBLE
              ELSE weight::DOUBLE * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE
                   / (weights - sum(CASE WHEN capped THEN weight ELSE 0 END) OVER ())::DOUBLE END AS target
  FROM c),
p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, least(floor(t.target + 0.5), t.cap)::BIGINT AS quota,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
  FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
-- Slots: every golden-ratio point falls into one source's share; the k-th point of a source takes its k-th block.
need AS (
  SELECT source, ceil(least(floor(target + 0.5), cap)::BIGINT / 4096)::BIGINT AS n FROM t
  WHERE least(floor(target + 0.5), cap) > 0),
share AS (
  SELECT source, n, sum(n) OVER (ORDER BY source NULLS LAST)::BIGINT AS upto, sum(n) OVER ()::BIGINT AS slots FROM need),
point AS (
  SELECT i AS position, ((i // 1048576) * golden_high + (i % 1048576) * golden + 0.5 * golden) % 1.0 AS u
  FROM (SELECT unnest(range((SELECT max(slots) FROM share))) AS i),
       (SELECT '0.6180339887498949'::DOUBLE AS golden, '0.6077874097402969'::DOUBLE AS golden_high)),
hit AS (
  SELECT source, n, position, row_number() OVER (PARTITION BY source ORDER BY position) - 1 AS block
  FROM point JOIN share ON u >= (upto - n)::DOUBLE / slots AND u < upto::DOUBLE / slots),
got AS (SELECT s.source, any_value(s.n) AS n, any_value(s.slots) AS slots, count(h.position) AS got
        FROM share s LEFT JOIN hit h ON s.source IS NOT DISTINCT FROM h.source GROUP BY s.source),
late AS (
  SELECT *, coalesce(sum(n - got) OVER (ORDER BY source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM got WHERE got < n),
slot AS (
  SELECT source, block, position FROM hit WHERE block < n
  UNION ALL
  SELECT source, got + j, slots + earlier + j FROM (SELECT *, unnest(range(n - got)) AS j FROM late)),
-- Passes of the stream over a document, and its pieces in blocks of 4,096 words.
pass AS (
  SELECT doc_id, source, size, z, z * source_size + b AS start, least(size, quota - z * source_size - b) AS words
  FROM p, (SELECT unnest(range(3)) AS z) WHERE size > 0 AND z * source_size + b < quota),
cut AS (SELECT *, unnest(range(start // 4096, (start + words - 1) // 4096 + 1)) AS block FROM pass),
piece AS (
  SELECT doc_id, z, block = start // 4096 AS opens, position,
         least(start + words, (cut.block + 1) * 4096) - greatest(start, cut.block * 4096) AS words
  FROM cut JOIN slot USING (block) WHERE cut.source IS NOT DISTINCT FROM slot.source),
taken AS (
  SELECT doc_id, min(CASE WHEN z = 0 AND opens THEN position END)::BIGINT AS first_slot, sum(position * words)::BIGINT AS slot_words
  FROM piece GROUP BY doc_id)
SELECT p.doc_id, size, source_size, target,
       (greatest(0, least(size, quota - b)) + greatest(0, least(size, quota - b - source_size))
        + greatest(0, least(size, quota - b - 2 * source_size)))::BIGINT AS taken,
       first_slot, coalesce(slot_words, 0)::BIGINT AS slot_words
FROM p LEFT JOIN taken ON p.doc_id = taken.doc_id
"""

_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
d AS (SELECT page_id, octet_length(encode(x))::BIGINT AS payload_bytes, sha1(x) AS h FROM p),
f AS (SELECT h AS fh, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d JOIN f ON h = fh
"""

# CRC-32 of a text of ASCII characters, bit by bit.
_CRC = """xor(4294967295, list_reduce([CASE WHEN i % 8 = 0 THEN ord({0}[i // 8 + 1]) ELSE 0 END::BIGINT for i in range(8 * length({0}))],
                      lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END::BIGINT), 4294967295::BIGINT))"""

_RUNS = rf"""
WITH i AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS id, coalesce(text, '') AS x FROM documents),
d AS (
  SELECT r, doc_id, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws,
         {_CRC.format('id')}::BIGINT AS h FROM i),
n AS (SELECT *, len(ws)::BIGINT AS n, h // 10 AS g FROM d),
e AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM n),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
w AS (
  SELECT r, i, ws[CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM p)),
-- Places whose words agree at a lag that leaves room for a run; neighbouring ones make a stretch.
same AS (
  SELECT x.r, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.r = y.r AND x.w = y.w AND x.i < y.i JOIN n ON n.r = x.r
  WHERE greatest({periodic_runs.LEAST}, {periodic_runs.TURNS} * (y.i - x.i)) <= n.n),
stretches AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS part FROM same) GROUP BY r, q, part
  HAVING count(*) + q >= greatest({periodic_runs.LEAST}, {periodic_runs.TURNS} * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DECIMAL(18, 0) / period DESC, start, period) = 1),
told AS (
  SELECT r, count(*) AS n_runs,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT w.r, string_agg(w.w, ' ' ORDER BY w.i) AS x FROM w LEFT JOIN gone ON gone.r = w.r AND gone.i = w.i
         WHERE gone.i IS NULL GROUP BY w.r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(x, '')) AS collapsed_sha256
FROM n LEFT JOIN best USING (r) LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""

_FIM = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= {fill_in_middle.FILLED} THEN 'plain'
              WHEN h4 % 100 < {fill_in_middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM k),
s AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix
  FROM c),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM s),
m AS (
  SELECT *, string_split(output, '<P>') AS at_p, string_split(output, '<S>') AS at_s, string_split(output, '<M>') AS at_m FROM o),
t AS (
  SELECT *, CASE form WHEN 'plain' THEN output
                      WHEN 'psm' THEN string_split(at_p[2], '<S>')[1] || at_m[2] || string_split(at_s[2], '<M>')[1]
                      ELSE string_split(at_p[2], '<M>')[1] || at_m[2] || string_split(at_s[2], '<P>')[1] END AS restored FROM m)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(output) AS output_sha256, sha256(restored) AS restored_sha256
FROM t
"""

_CHAR_CLASSES = {
    "lower": "[^a-z]",
    "upper": "[^A-Z]",
    "digit": "[^0-9]",
    "sentence": r"""[^.,;:?'"()-]""",
    "symbol": "[^#*$%&|<>]",
    "other": r"""[^\x21-\x7E]|[a-zA-Z0-9.,;:?'"()#*$%&|<>-]""",
    "latin": r"[^\x{80}-\x{27F}]",
    "foreign": r"[\x{0}-\x{27F}]",
}


def _rules_sql() -> str:
    """The base counts and the divergence verdict of ``quality_rules`` over ``documents``."""
    kept = lambda pattern: f"length(regexp_replace(x, {_quoted(pattern)}, '', 'g'))"
    classes = " UNION ALL ".join(f"SELECT r, '{name}' AS k, {kept(pattern)} AS n FROM d" for name, pattern in _CHAR_CLASSES.items())
    divergence = "sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x, lang FROM documents),
ws AS (SELECT r, lang, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT r, lang, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM ws),
win AS (SELECT r, p, w, list(w) OVER ahead AS g, count(*) OVER ahead AS n FROM w
        WINDOW ahead AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {quality_rules.REPEAT_WINDOW - 1} FOLLOWING)),
twice AS (SELECT r, p, w, (n = {quality_rules.REPEAT_WINDOW} AND count(*) OVER (PARTITION BY r, g, n) > 1)::INT AS again FROM win),
inside AS (SELECT r, w, max(again) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN {quality_rules.REPEAT_WINDOW - 1} PRECEDING AND CURRENT ROW) AS again FROM twice),
counts AS (SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, sum(again)::BIGINT AS n_repeat_words FROM inside GROUP BY r),
lines AS (SELECT r, unnest(string_split(x, chr(10))) AS line FROM d),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (
  SELECT r, doc_id, lang, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         {kept(_CHAR_CLASSES['symbol'])} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_words, 0) < {quality_rules.MIN_WORDS}
           OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM d LEFT JOIN counts USING (r) LEFT JOIN dups USING (r)),
good AS (SELECT r, lang FROM base WHERE NOT base_failed AND lang IS NOT NULL),
langs AS (SELECT DISTINCT lang FROM good),
chars AS ({classes}),
total AS (SELECT r, sum(n) AS t FROM chars GROUP BY r),
class_ref AS (SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM chars JOIN good USING (r) GROUP BY lang, k),
class_far AS (
  SELECT r, lang, {divergence} AS far
  FROM (SELECT r, lang, q, CASE WHEN t > 0 THEN n / t ELSE 0 END AS p FROM chars JOIN total USING (r) JOIN class_ref USING (k))
  GROUP BY r, lang),
word_ref AS (
  SELECT lang, w, q FROM (SELECT g.lang, w, count(*) / sum(count(*)) OVER (PARTITION BY g.lang) AS q
                          FROM w JOIN good g USING (r) GROUP BY g.lang, w) WHERE q >= {quality_rules.COMMON_SHARE}),
seen AS (SELECT r, w, count(*) AS n FROM w WHERE w IN (SELECT w FROM word_ref) GROUP BY r, w),
shares AS (
  SELECT b.r, f.lang, f.q, coalesce(s.n, 0) / greatest(b.n_words, 1) AS p
  FROM base b CROSS JOIN word_ref f LEFT JOIN seen s ON s.r = b.r AND s.w = f.w),
both_bins AS (
  SELECT r, lang, q, p FROM shares
  UNION ALL
  SELECT b.r, l.lang, greatest(0, 1 - coalesce((SELECT sum(q) FROM word_ref x WHERE x.lang = l.lang), 0)) AS q,
         least(1, greatest(0, 1 - coalesce(sum(s.p), 0))) AS p
  FROM base b CROSS JOIN langs l LEFT JOIN shares s ON s.r = b.r AND s.lang = l.lang GROUP BY b.r, l.lang),
word_far AS (SELECT r, lang, {divergence} AS far FROM both_bins GROUP BY r, lang),
near AS (
  SELECT r, bool_or((t < {quality_rules.MIN_CHARS} OR c.far <= {quality_rules.MAX_CHAR_DISTANCE})
                    AND (n_words < {quality_rules.MIN_HISTOGRAM_WORDS} OR f.far <= {quality_rules.MAX_WORD_DISTANCE})) AS near
  FROM class_far c JOIN word_far f USING (r, lang) JOIN total USING (r) JOIN base USING (r) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(near, true) AS kept
FROM base LEFT JOIN near USING (r)
"""


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def oracle_sql() -> dict[str, str]:
    return {
        "op7_source_mix": _MIX,
        "op9_divergence_rules": _rules_sql(),
        "op10_warc_revisits": _WARC,
        "op12_periodic_runs": _RUNS,
        "op13_fill_in_middle": _FIM,
    }
