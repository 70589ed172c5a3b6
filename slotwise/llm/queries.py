"""The registered queries of the dealt operators and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm.byte_runs import without_copies
from slotwise.llm.decontaminate import contaminated, contamination, items_digest
from slotwise.llm.fill_middle import fill_middle, restored
from slotwise.llm.fingerprints import distinct_count, printed, resemblance, with_edited
from slotwise.llm.kd_shards import sharded
from slotwise.llm.language import predict_documents
from slotwise.llm.line_runs import without_repeats
from slotwise.llm.near_copies import near_copies
from slotwise.llm.passages import repeats
from slotwise.llm.pseudonyms import pseudonymise
from slotwise.llm.secret_scan import BASE, secrets
from slotwise.llm.shelf import Shelf
from slotwise.llm.texts import read
from slotwise.llm.unigram import encode
from slotwise.llm.vector_codes import encode as encode_vectors
from slotwise.llm.vector_codes import fit as fit_codebooks

#: Public piece vocabulary with byte fallback; any SentencePiece model file will do.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

#: Key of the pseudonyms in the registered query; a user gives a secret one.
PSEUDONYM_KEY = b"slotwise-public-demonstration-key"

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    found = with_edited(read(spark, sf, "documents").select("doc_id", "text"))
    own, edited = F.col("sketch"), F.col("edited_sketch")
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed(own).alias("fingerprint"),
        printed(edited).alias("edited_fingerprint"), resemblance(own, edited).alias("near_edited"),
        resemblance(own, F.col("next_sketch")).alias("near_next"), distinct_count(own).alias("n_distinct"))


def op2_kd_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharded(read(spark, sf, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = contamination(read(spark, sf, "documents").select("doc_id", "text"), read(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_digest().alias("items_sha256"),
        contaminated().alias("contaminated"), "hits")


def op4_line_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = without_repeats(read(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "n_lines", F.size("deleted").cast("long").alias("n_deleted"), "deleted")


def op5_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets(read(spark, sf, "documents").select("doc_id", "text"))
    base = F.expr(f"filter(secrets, s -> s.kind in ({', '.join(repr(r.kind) for r in BASE)}))")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.begin, s.end)), ",")
    count = lambda kind: F.size(F.expr(f"filter(secrets, s -> s.kind = '{kind}')")).cast("long")
    return found.select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("secrets")).alias("spans"))


def op6_sentencepiece(spark: SparkSession, sf: str, path: str = PIECES) -> DataFrame:
    return encode(read(spark, sf, "documents").select("doc_id", "text"), path).drop("text")


def op7_pseudonyms(spark: SparkSession, sf: str, key: bytes = PSEUDONYM_KEY) -> DataFrame:
    found = pseudonymise(read(spark, sf, "documents").select("doc_id", "text"), key)
    numbers = F.size(F.expr("filter(pii, s -> not startswith(s.kind, 'date'))")).cast("long")
    return found.select(
        "doc_id", "text", numbers.alias("n_numbers"), (F.size("pii") - numbers).alias("n_dates"),
        F.array_join(F.transform("pii", lambda s: F.concat_ws(":", s.kind, s.begin, s.end)), ",").alias("spans"))


def op8_language(spark: SparkSession, sf: str) -> DataFrame:
    return predict_documents(read(spark, sf, "documents").select("doc_id", "text", "lang"))


def op9_passages(spark: SparkSession, sf: str) -> DataFrame:
    return repeats(read(spark, sf, "documents"))


def op10_near_copies(spark: SparkSession, sf: str) -> DataFrame:
    return near_copies(read(spark, sf, "documents"))


def op11_fill_middle(spark: SparkSession, sf: str) -> DataFrame:
    found = fill_middle(read(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"))


def op12_byte_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = without_copies(read(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    books = fit_codebooks(rows)
    # stored, as both the sums by label and the rows read it
    coded = Shelf(spark).put(encode_vectors(rows, books).select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"))
    sums = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256((books.text() if books else "").encode()).hexdigest()
    return coded.join(sums, F.col("label").eqNullSafe(F.col("l"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


QUERIES: dict[str, Query] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_kd_shards": op2_kd_shards,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_runs": op4_line_runs,
    "op5_secrets": op5_secrets,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_pseudonyms": op7_pseudonyms,
    "op8_language": op8_language,
    "op9_passages": op9_passages,
    "op10_near_copies": op10_near_copies,
    "op11_fill_middle": op11_fill_middle,
    "op12_byte_runs": op12_byte_runs,
    "op13_vector_codes": op13_vector_codes,
}

FILL_MIDDLE = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
numbers AS (
  SELECT doc_id, text, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d
  FROM drawn),
formed AS (
  SELECT doc_id, text, n, least(a, b) AS low, greatest(a, b) AS high,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain'
      WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
parted AS (
  SELECT *, substring(text, 1, low) AS prefix, substring(text, low + 1, high - low) AS middle, substring(text, high + 1) AS suffix
  FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parted"""

#: One round of the codebooks: every part to its nearest entry, then floor of the means.
_ROUND = """
nearest{i} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, far * 64 + entry) AS entry, min(far) AS far FROM (
    SELECT v.vec_id, v.part, b.entry,
      list_sum(list_transform(list_zip(v.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS far
    FROM parts v JOIN book{i} b ON v.part = b.part)
  GROUP BY vec_id, part),
means{i} AS (
  SELECT part, entry, list(m ORDER BY place) AS x FROM (
    SELECT n.part, n.entry, p.place, CAST(floor(sum(v.x[p.place])::DOUBLE / count(*)) AS BIGINT) AS m
    FROM nearest{i} n JOIN parts v ON n.vec_id = v.vec_id AND n.part = v.part CROSS JOIN places p
    GROUP BY n.part, n.entry, p.place)
  GROUP BY part, entry),
book{j} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN means{i} m ON b.part = m.part AND b.entry = m.entry),"""

VECTOR_CODES = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
places AS (SELECT unnest(range(1, (SELECT any_value(len(x)) // 16 FROM kept) + 1)) AS place),
parts AS MATERIALIZED (
  SELECT vec_id, part, x[part * (len(x) // 16) + 1 : (part + 1) * (len(x) // 16)] AS x
  FROM kept, (SELECT unnest(range(16)) AS part)),
book0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{_ROUND.format(i=0, j=1)}
{_ROUND.format(i=1, j=2)}
final AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, far * 64 + entry) AS entry, min(far) AS far FROM (
    SELECT v.vec_id, v.part, b.entry,
      list_sum(list_transform(list_zip(v.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS far
    FROM parts v JOIN book2 b ON v.part = b.part)
  GROUP BY vec_id, part),
coded AS (
  SELECT k.vec_id, k.label, string_agg(lpad(lower(to_hex(f.entry)), 2, '0'), '' ORDER BY f.part) AS code, sum(f.far)::BIGINT AS error
  FROM kept k JOIN final f ON k.vec_id = f.vec_id GROUP BY k.vec_id, k.label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256
FROM coded"""

BYTE_RUNS = """
WITH hexed AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (
  SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS key, md5_number(substr(h, 2 * i + 1, 100)) AS code
  FROM hexed, unnest(range(n - 49)) AS u(i) WHERE n >= 50),
late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key, code) AS first FROM windows) WHERE first < doc_id),
marked AS (
  SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL
    THEN 1 ELSE 0 END AS head
  FROM late),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs
  UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY doc_id),
kept AS (
  SELECT p.doc_id, string_agg(CASE WHEN p.b IS NULL THEN substr(h.h, 2 * p.a + 1) ELSE substr(h.h, 2 * p.a + 1, 2 * (p.b - p.a)) END, '' ORDER BY p.a)
    AS h
  FROM pieces p JOIN hexed h ON p.doc_id = h.doc_id GROUP BY p.doc_id)
SELECT h.doc_id, h.n::BIGINT AS n_bytes, coalesce(r.lost, 0)::BIGINT AS n_removed, coalesce(r.spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k.h, h.h))) AS kept_sha256
FROM hexed h LEFT JOIN kept k ON h.doc_id = k.doc_id
LEFT JOIN (SELECT doc_id, sum(b - a) AS lost, count(*) AS spans FROM runs GROUP BY doc_id) r ON h.doc_id = r.doc_id"""

NEAR_COPIES = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')))) END AS s
  FROM split),
classes AS MATERIALIZED (SELECT min(doc_id) AS id, s FROM sets WHERE len(s) > 0 GROUP BY s),
spread AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS shingle FROM classes),
links AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM spread a JOIN spread b ON a.shingle = b.shingle AND a.id <> b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached(id, other) AS (
  SELECT id, id FROM classes UNION SELECT r.id, l.b FROM reached r JOIN links l ON r.other = l.a),
roots AS (SELECT id, min(other) AS root FROM reached GROUP BY id),
named AS (SELECT c.s, r.root FROM classes c JOIN roots r ON c.id = r.id)
SELECT t.doc_id, len(t.s)::BIGINT AS n_shingles, coalesce(n.root, t.doc_id) AS component_id, coalesce(n.root, t.doc_id) = t.doc_id AS kept
FROM sets t LEFT JOIN named n ON t.s = n.s"""

SQL: dict[str, str] = {"op10_near_copies": NEAR_COPIES, "op11_fill_middle": FILL_MIDDLE, "op12_byte_runs": BYTE_RUNS, "op13_vector_codes": VECTOR_CODES}
