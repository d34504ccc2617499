"""The registered queries of the corpus operators, and the SQL that says the same where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, lm, media, quality, tokencounts, toxicity
from .decontam import contaminated
from .mixing import mix
from .neardup import near_duplicates
from .pii import pseudonymise
from .runtime import Scratch, shared_dir

#: Where the vocabulary files of public tokenizers lie on the driver, and the splitting pattern of byte-level BPE.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The key of registered queries; a real run takes its own from a secret store.
KEY = "tidemark"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(4) != 2)
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "segments")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), KEY).select("doc_id", "n_pii", "pii_kinds", "text")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_tokencounts(spark: SparkSession, sf_dir: str, tokenizers: str | None = None) -> DataFrame:
    """Totals by source, language and tokenizer version as a ledger keeps them over its life, each batch over all rows: loaded
    with estimates (a token for 4 characters) while texts wait for the tokenizers, revised to the counts, every row deleted
    and put in again (a reload of the sources), with batches that come twice, and folded in between.

    ``tokenizers`` is the folder of the vocabulary files on the driver: by default the session's
    ``spark.tidemark.tokenizers``, else TOKENIZERS.
    """
    tokenizers = tokenizers or spark.conf.get("spark.tidemark.tokenizers", TOKENIZERS)
    versions = {"byte_bpe_50k": (f"{tokenizers}/byte_bpe_50k.tiktoken", BYTE_BPE), "words_1": (None, r"[^\x20\x09-\x0D]+")}
    counts = Scratch(spark, "tokencounts").write(tokencounts.counted(table(spark, sf_dir, "documents"), versions), "counts")
    estimates = counts.withColumn("tokens", F.expr("chars div 4"))
    ledger = tokencounts.Ledger(spark, f"{shared_dir(spark)}/tidemark/ledger-{uuid.uuid4().hex}")
    for version in versions:
        ledger.apply(f"load {version}", tokencounts.deltas(inserted=estimates.where(F.col("tokenizer") == version)))
    ledger.fold()
    for version in versions:
        own = F.col("tokenizer") == version
        ledger.apply(f"count {version}", tokencounts.deltas(revised=(estimates.where(own), counts.where(own))))
    ledger.apply("delete", tokencounts.deltas(deleted=counts))
    ledger.apply("load words_1", tokencounts.deltas(inserted=estimates))  # came before: changes nothing
    ledger.apply("insert", tokencounts.deltas(inserted=counts))
    ledger.fold()
    ledger.apply("delete", tokencounts.deltas(deleted=counts))  # so did this one
    return ledger.totals()


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_neardup": op3_neardup,
    "op6_quality": op6_quality,
    "op4_html": op4_html,
    "op5_pii": op5_pii,
    "op7_tokencounts": op7_tokencounts,
    "op8_media": op8_media,
    "op9_lm": op9_lm,
    "op10_mixing": op10_mixing,
}

#: DuckDB: a text's words, then its distinct shingles; A-Z alone become a-z.
_SHINGLES = r"""
words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words)"""

#: DuckDB: the shares of a period of 1000 slots, and the earliest-deadline-first choice at each slot, one by one.
_PERIOD = """
units AS (SELECT source, greatest(floor(1000 * sqrt(count(*)::DOUBLE))::BIGINT, 1) AS u FROM documents GROUP BY source),
small AS (SELECT *, u * 1000 < sum(u) OVER () AS tiny FROM units),
free AS (SELECT *, 1000 - count(*) FILTER (tiny) OVER () AS f, sum(u) FILTER (NOT tiny) OVER ()::BIGINT AS s FROM small),
quota AS (SELECT source, CASE WHEN tiny THEN 1 ELSE greatest((u * f) // s, 1) END AS base, CASE WHEN tiny THEN -1 ELSE (u * f) % s END AS over_ FROM free),
share AS (SELECT source, (base + (row_number() OVER (ORDER BY over_ DESC, source NULLS FIRST) <= 1000 - sum(base) OVER ())::INT
  + CASE WHEN row_number() OVER (ORDER BY base DESC, source NULLS FIRST) = 1 THEN least(1000 - sum(base) OVER (), 0) ELSE 0 END)::BIGINT AS share FROM quota),
srcs AS (SELECT list(source ORDER BY source NULLS FIRST) AS s, list(share ORDER BY source NULLS FIRST) AS a FROM share),
sim AS (
  SELECT 0 AS t, list_transform(a, lambda x: 0::BIGINT) AS done, NULL::BIGINT AS pick FROM srcs
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + (i = p)::INT), p
  FROM (SELECT t, done, list_min(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN (done[i] * 1000) // a[i] <= t
               THEN (((done[i] + 1) * 1000 + a[i] - 1) // a[i]) * 1000000 + i END)) % 1000000 AS p FROM sim, srcs WHERE t < 1000)),
plan AS (SELECT s[pick] AS source, a[pick] AS share, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS ordinal FROM sim, srcs WHERE pick IS NOT NULL)"""

SQL = {
    "op1_decontamination": rf"""
WITH {_SHINGLES},
item_words AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
item_shingles AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 5 THEN [] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM item_words),
sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id),
hits AS (SELECT doc_id, item_id, count(*) AS i FROM shingles JOIN item_shingles USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item, i AS n_shared, i / n AS containment FROM hits JOIN sizes USING (item_id) WHERE 100 * i >= 80 * n
UNION ALL
SELECT doc_id, item_id, 1, 1, 1.0 FROM item_words i JOIN words d ON contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' ')
WHERE len(i.w) BETWEEN 1 AND 4""",
    "op10_mixing": f"""
WITH RECURSIVE {_PERIOD},
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS r FROM documents),
blocks AS (SELECT doc_id, source, r // 16 AS block, (r % 16)::INT AS place FROM ranked)
SELECT doc_id, b.source, share, block, place, (block * 1000) // share AS release, ((block + 1) * 1000 + share - 1) // share AS deadline, (block // share) * 1000 + slot AS slot
FROM blocks b JOIN plan p ON p.source IS NOT DISTINCT FROM b.source AND p.ordinal = block % share""",
    "op3_neardup": rf"""
WITH RECURSIVE {_SHINGLES},
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT d AS doc_id, min(r) AS component_id FROM reach GROUP BY d) r USING (doc_id)""",
}
