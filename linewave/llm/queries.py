"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document under the 32k piece vocabulary."""
    import public_tokenizers

    from linewave.llm.tokens import token_counts

    docs = _documents(spark, sf_dir, "doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items found in documents, by exact containment of their five-word shingles."""
    from linewave.llm.decontam import leaks

    return leaks(_documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an Ogg bitstream, stored, read back, verified and summed up."""
    from linewave.llm.media import media_digests, stored_media

    return media_digests(stored_media(_documents(spark, sf_dir, "doc_id", "text")))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents on two-word shingles."""
    from linewave.llm.neardup import near_duplicates

    return near_duplicates(_documents(spark, sf_dir, "doc_id", "text"), k=2)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the documents outside the held-out quarter."""
    import public_tokenizers

    from linewave.llm.language import fit_languages, identify

    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    return identify(docs, fit_languages(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from linewave.llm.pages import extract_text

    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    from linewave.llm.pii import find_personal_data

    return find_personal_data(_documents(spark, sf_dir, "doc_id", "text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources takes from each document."""
    from linewave.llm.mixing import mix_counts

    docs = _documents(spark, sf_dir, "doc_id", "text", "source")
    return mix_counts(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels outside the held-out quarter."""
    from linewave.llm.quality import fit_quality, quality

    docs = _documents(spark, sf_dir, "doc_id", "text")
    return quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, written as a token file and read back."""
    import public_tokenizers

    from linewave.llm.tokenfile import stored_tokens

    return stored_tokens(_documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op11_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every conversation after set damage."""
    from linewave.llm.conversations import repairs_of_damaged

    return repairs_of_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark, and the quarter that is drawn by them."""
    from linewave.llm.resample import resampled

    docs, target = _documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a string of 100 bytes which starts earlier too, removed."""
    from linewave.llm.repeats import without_repeats

    found = without_repeats(_documents(spark, sf_dir, "doc_id", "text"), least=100)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_decontamination, op3_media, op4_near_duplicates, op5_language, op6_main_text, op7_personal_data, op8_mixing, op9_quality, op10_token_file, op11_repairs, op12_resampling, op13_repeats)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _shingles(table: str, key: str, k: int) -> str:
    """Distinct k-word shingles; a text of fewer words is one."""
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k - 2}), lambda i: w[i:i + {k - 1}]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS s
  FROM (SELECT {key}, {_WORDS} AS w FROM {table})"""


# crc32 of the ``text`` rows of ``keyed``: a table of 256 by shifts, then a byte a round. ``crc`` has (text, crc).
_CRC = r"""tab AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM (SELECT unnest(range(256)) AS i)),
walk(text, h, k, c) AS (SELECT text, hex(encode(text)), 0::BIGINT, 4294967295::BIGINT FROM keyed
  UNION ALL SELECT text, h, k + 1, xor(c >> 8, v) FROM walk JOIN tab ON i = xor(c, CAST('0x' || h[2 * k + 1:2 * k + 2] AS BIGINT)) & 255 WHERE 2 * k < len(h)),
crc AS (SELECT text, xor(c, 4294967295) AS crc FROM walk WHERE 2 * k = len(h))"""

SQL: dict[str, str] = {
    "op2_decontamination": f"""WITH own AS ({_shingles("documents", "doc_id", 5)}), item AS ({_shingles("benchmark", "item_id", 5)}),
sized AS (SELECT item_id, count(*) AS n_shingles FROM item GROUP BY 1)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM own JOIN item USING (s) JOIN sized USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING 100 * count(*) >= 80 * n_shingles""",
    "op4_near_duplicates": f"""WITH RECURSIVE own AS ({_shingles("documents", "doc_id", 2)}),
sized AS (SELECT doc_id, count(s) AS n FROM documents LEFT JOIN own USING (doc_id) GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM own a JOIN own b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN sized x ON a = x.doc_id JOIN sized y ON b = y.doc_id WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM sized UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT doc_id, n AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept FROM sized JOIN reach ON doc_id = a GROUP BY doc_id, n""",
    # Sources fill up in the order of size by weight: those before the first that stays below its bound are full.
    "op8_mixing": r"""WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, coalesce(strlen(text), -1) AS n_bytes FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
weighed AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sums),
filled AS (SELECT *, 1.5 * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER w, 0) AS left_over, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weights
  FROM weighed WINDOW w AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(left_over, 2 * source_size / weight) AS left_over, arg_min(weights, 2 * source_size / weight) AS weights FROM filled WHERE 2 * source_size >= left_over * weight / weights),
aimed AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), CAST(level.left_over AS DOUBLE) * weight / level.weights) AS target FROM weighed, level),
ranked AS (SELECT sized.*, source_size, target, row_number() OVER (PARTITION BY sized.source ORDER BY floor(8 * (ln(size + 1) / ln(2))), md5(CAST(doc_id AS VARCHAR)), size, n_bytes) - 1 AS rank,
  CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS expected,
  CAST('0x' || md5('7:' || coalesce('s' || sized.source, 'n'))[1:13] AS BIGINT) / 4503599627370496.0::DOUBLE AS shift
  FROM sized JOIN aimed ON sized.source IS NOT DISTINCT FROM aimed.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies
FROM (SELECT *, CAST(floor((rank + 1) * expected + shift) - floor(rank * expected + shift) AS BIGINT) AS copies FROM ranked)""",
    # back has the least cost from each state before a row, from the end on; step walks forward and takes the least letter that fits.
    "op11_repairs": rf"""WITH RECURSIVE source AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS body, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS text FROM conversations),
keyed AS (SELECT DISTINCT text FROM source), {_CRC},
kinds AS (SELECT conv_id, turn, role, body, crc % 20 AS kind FROM source JOIN crc USING (text)),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(body, '.!?', '') ELSE body END AS body, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, body ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(body, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail FROM damaged),
coded AS (SELECT *, role[1:1] AS initial, CASE WHEN tail = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN tail[-1:] NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM placed),
costed AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM coded),
sized AS (SELECT conv_id, count(*) AS n FROM costed GROUP BY 1),
back(conv_id, i, f) AS (SELECT conv_id, n + 1, [0, 6, 3, 0]::BIGINT[] FROM sized
  UNION ALL SELECT conv_id, i, [least(g[1], 3 + least(g[3], 3 + g[4])), least(g[2], 3 + least(g[3], 3 + g[4])), least(g[3], 3 + g[4]), least(g[4], 3 + g[3])] FROM (
    SELECT b.conv_id, c.i, list_transform([0, 1, 2, 3], lambda s: least(4 + f[s + 1], CASE WHEN gone THEN 1000000000 ELSE more + least(3 + CASE s WHEN 2 THEN f[4] ELSE f[3] END,
      CASE WHEN initial = 'u' AND s <> 2 THEN f[3] WHEN initial = 'a' AND s = 2 THEN f[4] WHEN initial = 's' AND s = 0 THEN f[2] ELSE 1000000000 END) END)) AS g
    FROM back b JOIN costed c ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND c.i = b.i - 1)),
step(conv_id, i, s, audit, out) AS (SELECT conv_id, 1::BIGINT, 0, '', []::VARCHAR[] FROM sized
  UNION ALL SELECT conv_id, CASE e WHEN 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE s WHEN 2 THEN 3 ELSE 2 END END, audit || e,
    CASE e WHEN 'D' THEN out WHEN 'K' THEN list_append(out, role || ':' || body) ELSE list_append(out, CASE s WHEN 2 THEN 'assistant:' ELSE 'user:' END || CASE e WHEN 'R' THEN body ELSE '' END) END FROM (
    SELECT t.*, c.role, c.body, c.initial, CASE WHEN c.i IS NULL THEN CASE WHEN s IN (1, 2) THEN 'I' END WHEN 4 + z.f[s + 1] = a.f[s + 1] THEN 'D' WHEN 3 + a.f[CASE s WHEN 2 THEN 4 ELSE 3 END] = a.f[s + 1] THEN 'I'
      WHEN NOT gone AND more + CASE WHEN initial = 'u' AND s <> 2 THEN z.f[3] WHEN initial = 'a' AND s = 2 THEN z.f[4] WHEN initial = 's' AND s = 0 THEN z.f[2] ELSE 1000000000 END = a.f[s + 1] THEN 'K' ELSE 'R' END AS e
    FROM step t JOIN back a ON t.conv_id IS NOT DISTINCT FROM a.conv_id AND t.i = a.i LEFT JOIN costed c ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.i = c.i LEFT JOIN back z ON t.conv_id IS NOT DISTINCT FROM z.conv_id AND z.i = t.i + 1) WHERE e IS NOT NULL),
ends AS (SELECT conv_id, audit, out FROM step JOIN sized USING (conv_id) WHERE i = n + 1 AND s IN (0, 3)),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM costed GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.f[1], 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1 LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op12_resampling": rf"""WITH RECURSIVE words AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 't', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
feature AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS text FROM words),
keyed AS (SELECT DISTINCT text FROM feature), {_CRC},
posted AS (SELECT side, id, crc % 10000 AS bucket, count(*) AS n FROM feature JOIN crc USING (text) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM posted GROUP BY 1),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM sums),
part AS (SELECT id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS g FROM posted JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1),
weighed AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END AS weight, CAST('0x' || sha256('7:' || doc_id)[1:8] AS BIGINT)::DOUBLE AS h
  FROM documents JOIN words ON side = 'd' AND doc_id = words.id LEFT JOIN part ON doc_id = part.id),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM weighed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_words >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 25 * able // 100 THEN r END AS rank FROM ranked""",
    # Two hexadecimal digits a byte, in pieces of 500. A byte is gone if one of the 100 strings that cover it is not the first of its kind.
    "op13_repeats": """WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
piece AS (SELECT doc_id, 500 * q AS base, n - 99 - 500 * q AS n, substr(h, 1000 * q + 1, 1200) AS h FROM (SELECT doc_id, h, len(h) // 2 AS n, unnest(range(0, len(h) // 1000 + 1)) AS q FROM doc)),
own AS (SELECT doc_id * 4294967296::HUGEINT + base + i AS spot, md5_number(substr(h, 2 * i + 1, 200)) AS w FROM (SELECT *, unnest(range(0, greatest(least(500, n), 0))) AS i FROM piece)),
early AS (SELECT w, min(spot) AS spot FROM own GROUP BY w),
later AS (SELECT CAST(own.spot // 4294967296 AS BIGINT) AS doc_id, CAST(own.spot % 4294967296 AS BIGINT) AS p FROM own JOIN early USING (w) WHERE early.spot < own.spot),
span AS (SELECT doc_id, p, p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -101) > 100 AS fresh FROM later),
run AS (SELECT doc_id, p, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM span),
gone AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM run GROUP BY doc_id, r),
cut AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a) AS n_removed FROM gone GROUP BY 1)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(len(a), 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda i: substr(h, CASE WHEN i = 0 THEN 1 ELSE 2 * z[i] + 1 END, CASE WHEN i = len(a) THEN len(h) ELSE 2 * a[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE 2 * z[i] END)), '') END)) AS kept_sha256
FROM doc LEFT JOIN cut USING (doc_id)""",
}
