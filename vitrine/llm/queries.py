"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import quality
from vitrine.llm.ann import search
from vitrine.llm.audit import audit_filters
from vitrine.llm.decontaminate import find_leaks
from vitrine.llm.langid import fit, held_out, predict
from vitrine.llm.linededup import dedup_lines
from vitrine.llm.packing import pack_documents
from vitrine.llm.resample import resample
from vitrine.llm.secrets import RULES, scan_blobs, secret_findings, spans_text
from vitrine.llm.sharding import shard_documents
from vitrine.llm.simhash import near_duplicates
from vitrine.llm.tokenfile import read_documents, write_token_file
from vitrine.llm.warc import read_records, write_warc
from vitrine.sources.shared import materialize, shared_path, table

#: Words that a worker remembers in each of two generations where encoding is all that it does.
ALONE_WORDS = 300_000


def vocabulary(name: str) -> str:
    """A public tokenizer's file; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces packed into sequences of 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2, emit="crc32", cache_words=ALONE_WORDS)


def _only(kind: int) -> Callable[[Column], Column]:
    return lambda x: F.when(x == kind, x)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that at least 10 documents have."""
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1, keep="none")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to archives and read back."""
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_records(spark, path)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a benchmark item in it, as it is or with other numbers, names or units."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards."""
    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written in bit-packed blocks and read back."""
    path = shared_path(spark, "tokens")
    write_token_file(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2, cache_words=ALONE_WORDS)
    return read_documents(spark, path, emit="crc32")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, with a ledger of an earlier pass: French texts, with all rules but one.

    The pass that tells the findings scans other texts with all rules, and the French ones with that one.
    """
    docs = table(spark, sf_dir, "documents")
    ledger = materialize(scan_blobs(docs.where("lang = 'fr'"), rules=RULES[:2]), "ledger")
    found = secret_findings(docs, ledger=ledger)
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, _only(k)))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(RULES)]
    return found.select("doc_id", *counts, spans_text(F.col("spans")).alias("spans")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows nearest to every twentieth embedding."""
    return search(table(spark, sf_dir, "embeddings"), queries_every=20, k=20)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels of those that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.fit(docs.where(~quality.held_out()), labels.where(~quality.held_out()))
    told = quality.score(docs.withColumn("held_out", quality.held_out()), model)
    return told.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove at each place in each of their orders, by language."""
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's texts, and the rank of those drawn."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_line_dedup": op3_line_dedup,
        "op4_warc": op4_warc,
        "op5_decontamination": op5_decontamination,
        "op6_sharding": op6_sharding,
        "op7_token_file": op7_token_file,
        "op8_secret_scans": op8_secret_scans,
        "op9_language_id": op9_language_id,
        "op10_nearest_neighbours": op10_nearest_neighbours,
        "op11_quality": op11_quality,
        "op12_filter_audit": op12_filter_audit,
        "op13_resampling": op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can tell the same rows; the others are held against brute force in the tests."""
    return {"op3_line_dedup": OP3_SQL, "op4_warc": OP4_SQL, "op12_filter_audit": OP12_SQL, "op13_resampling": OP13_SQL}


OP3_SQL = r"""
WITH split AS (SELECT row_number() OVER () AS nr, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT nr, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT nr) >= 10),
marked AS (SELECT k.*, r.key IS NOT NULL AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY nr, doc_id"""

OP4_SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
firsts AS (SELECT html, min(page_id) AS first FROM payloads WHERE n >= 100 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha256(p.html) AS payload_digest,
    CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, nullif(first, page_id) AS refers_to
FROM payloads p LEFT JOIN firsts f ON p.html = f.html AND n >= 100"""

OP12_SQL = r"""
WITH split AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
judged AS (SELECT s.part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
    100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
    FROM split s LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
masks AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY ALL),
letters AS (SELECT chr(65 + i::INT) AS l, (1 << i)::INT AS bit FROM range(5) t(i)),
orders AS (SELECT v.l || w.l || x.l || y.l || z.l AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
    FROM letters v, letters w, letters x, letters y, letters z WHERE len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5),
steps AS (SELECT filter_order, i::INT AS step, bits[i] AS bit, list_sum(bits[1:i - 1])::INT AS before FROM orders, range(1, 6) t(i)),
told AS (SELECT part, filter_order, step, bit, sum(n) FILTER ((mask & (coalesce(before, 0) | bit)) = 0) AS kept,
    sum(n) FILTER ((mask & coalesce(before, 0)) = 0 AND (mask & bit) > 0) AS removed, sum(n) FILTER ((mask & coalesce(before, 0)) > 0 AND (mask & bit) > 0) AS redundant,
    sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER ((mask & coalesce(before, 0)) = 0 AND (mask & bit) > 0) AS good_lost,
    sum(toxic) FILTER ((mask & coalesce(before, 0)) = 0 AND (mask & bit) > 0) AS toxic_lost FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
    coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM told"""

OP13_SQL = r"""
WITH RECURSIVE bits AS (SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crcs AS MATERIALIZED (SELECT list(c ORDER BY byte) AS crc FROM bits WHERE k = 8),
texts AS (SELECT row_number() OVER () AS nr, doc_id, text, true AS own FROM documents UNION ALL SELECT NULL, NULL, text, false FROM benchmark),
split AS (SELECT nr, doc_id, own, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM texts),
runs AS (SELECT nr, own, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM split),
counted AS MATERIALIZED (SELECT nr, own, run, count(*) AS n FROM runs GROUP BY ALL),
hexed AS (SELECT run, hex(encode(run)) AS digits FROM (SELECT DISTINCT run FROM counted)),
known AS (SELECT run, xor(list_reduce(list_transform(range(1, len(digits), 2), lambda i: ('0x' || digits[i:i + 1])::BIGINT), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM hexed, crcs),
placed AS MATERIALIZED (SELECT nr, own, bucket, sum(n) AS n FROM counted JOIN known USING (run) GROUP BY ALL),
sums AS (SELECT sum(n) FILTER (own) AS more_s, sum(n) FILTER (NOT own) AS more_t FROM placed),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce(more_s, 0) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce(more_t, 0) + 10000)::DOUBLE)))::BIGINT AS gain
    FROM (SELECT bucket, sum(n) FILTER (own) AS s, sum(n) FILTER (NOT own) AS t FROM placed GROUP BY bucket), sums),
weighed AS (SELECT nr, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE own GROUP BY nr),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM split LEFT JOIN weighed USING (nr) WHERE own),
ranked AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place, 5 * count(*) FILTER (n_words >= 20) OVER () // 100 AS most FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM ranked"""
