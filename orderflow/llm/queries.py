"""A registered query per operator, over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm import bincompletion, classlm, decontaminate, htmltext, jaccard, mixing, onebit, parttrie, quality
from orderflow.llm import sharding, shallot, tokenfiles, vectorsql, warc
from orderflow.llm.common import doc_crc, table
from orderflow.session import Stage

TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def sharded(spark: SparkSession, folder: str) -> DataFrame:
    found = sharding.shard(table(spark, folder, "documents"), shards=24)
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def mixed(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mix(table(spark, folder, "documents"))
    times = mixing.in_millionths("positions").alias("training_times")
    return found.select("doc_id", "size", "source_size", "target", "taken", times)


def training_order(spark: SparkSession, folder: str) -> DataFrame:
    """A row per copy the mix takes, with its time and its place in the training order."""
    found = mixing.mix(table(spark, folder, "documents")).select("doc_id", "source", "size", "positions")
    return mixing.training_ranks(found, "source", "doc_id").select("doc_id", "source", "size", "position", "rank")


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = Stage(spark).path("tokens")
    tokenfiles.write_tokens(table(spark, folder, "documents"), path, tokenizer_path())
    return tokenfiles.with_starts(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def similar_documents(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard.similar(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, folder, "labels")), keep=["doc_id"])
    return scored.select(
        "doc_id",
        (doc_crc("doc_id") % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def class_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return classlm.scored(table(spark, folder, "documents"))


def leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    found = decontaminate.find_leaks(docs, items, keep=["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return htmltext.main_text(pages).withColumn("n_chars", F.length("text").cast("long"))


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return onebit.nearest(table(spark, folder, "embeddings"))


def warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, folder, "pages")), keep=["page_id"])


def part_codes(spark: SparkSession, folder: str) -> DataFrame:
    found = parttrie.compress(table(spark, folder, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    return shallot.cluster(table(spark, folder, "embeddings"))


def packed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = bincompletion.pack(docs, tokenizer_path(WORD_TOKENIZER), keep_tokens=False)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {
    "op1_decontamination": leaked_items,
    "op2_html_templates": page_texts,
    "op3_sampled_splitters": sharded,
    "op4_one_bit_codes": nearest_vectors,
    "op5_warc_derivatives": warc_derivatives,
    "op6_quality_attention": quality_scores,
    "op7_token_files": token_files,
    "op8_class_lm": class_lm_scores,
    "op9_curriculum_mix": mixed,
    "curriculum_training_order": training_order,
    "op10_jaccard_join": similar_documents,
    "op11_part_trie": part_codes,
    "op12_shallot_clusters": clusters,
    "op13_bin_completion": packed,
}

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

# crc32 by its table of 256 remainders, folded over the bytes of the text.
HALF = "list_transform({0}, lambda r: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END))"
REMAINDERS = "list_transform(range(256), lambda b: CAST(b AS BIGINT))"
for _ in range(8):
    REMAINDERS = HALF.format(REMAINDERS)
CRC_STEPS = f"crc_table AS (SELECT {REMAINDERS} AS remainders)"
CODES = "list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: CAST('0x' || x AS BIGINT))"
CRC = (
    f"xor(list_reduce(list_prepend(4294967295, {CODES}), "
    "lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1])), 4294967295)"
)

ORACLE = {
    "op11_part_trie": vectorsql.part_codes(),
    "op12_shallot_clusters": vectorsql.clusters(),
    # Order by (hash of the text, hash of the id), then place each middle byte; crc32 comes from
    # a table the bytes of the text are folded through.
    "op3_sampled_splitters": f"""
WITH {CRC_STEPS}, sized AS (
    SELECT doc_id, coalesce(text, '') AS body, CAST(strlen(coalesce(text, '')) AS BIGINT) + 8 AS size,
           left(md5(coalesce(text, '')), 16) AS k1, left(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 16) AS k2
    FROM documents
), spots AS (
    SELECT *, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY k1) AS together,
           sum(size) OVER (ORDER BY k1, k2, size ROWS UNBOUNDED PRECEDING) - size AS here,
           row_number() OVER (ORDER BY k1, k2, size) AS place
    FROM sized
), middle AS (
    SELECT *, CASE WHEN together <= 0.005 * total / 24
                   THEN 2 * min(here) OVER (PARTITION BY k1) + together ELSE 2 * here + size END AS twice
    FROM spots
), placed AS (
    SELECT *, least(CAST(twice * 24 // (2 * total) AS INTEGER), 23) AS shard FROM middle
)
SELECT doc_id, size, {CRC} AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed, crc_table""",
    "op9_curriculum_mix": f"""
WITH sized AS (
    SELECT doc_id, source, CAST({WORDS} AS BIGINT) AS size,
           md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), '7', md5(coalesce(text, '')))) AS h
    FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n
    FROM sized GROUP BY source
), weighed AS (
    SELECT *, [5, 2, 1][CAST(n % 3 AS INTEGER) + 1] AS w, source_size * 3 AS cap,
           sum(source_size) OVER () AS total
    FROM sources
), leveled AS (
    SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY cap / w, n
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
              / CAST(sum(w) OVER (ORDER BY cap / w, n
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
    FROM weighed
), wanted AS (
    SELECT source, source_size, n AS number, CASE WHEN cap / w >= max(level) FILTER (level * w <= cap) OVER ()
        THEN max(level) FILTER (level * w <= cap) OVER () * w ELSE CAST(cap AS DOUBLE) END AS target
    FROM leveled
), placed AS (
    SELECT s.doc_id, s.source, s.h, s.size, t.source_size, t.target, [0.5, -0.5, 0.0][CAST(t.number % 3 AS INTEGER) + 1]::DOUBLE AS slope,
           sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.size ROWS UNBOUNDED PRECEDING) - s.size AS here
    FROM sized s JOIN wanted t ON s.source IS NOT DISTINCT FROM t.source
), due AS (
    SELECT *, CASE WHEN size > 0 THEN (here + size / 2 < target)::INT + (source_size + here + size / 2 < target)::INT
        + (2 * source_size + here + size / 2 < target)::INT ELSE 0 END AS n
    FROM placed
), gapped AS (
    SELECT *, target - CAST(sum(n * size) OVER (PARTITION BY source) AS DOUBLE) AS gap FROM due
), offered AS (
    SELECT *, CASE WHEN size > 0 AND (CASE WHEN gap > 0 THEN n < 3 ELSE n > 0 END) AND abs(size - abs(gap)) < abs(gap)
        THEN abs(size - abs(gap)) END AS beyond
    FROM gapped
), swapped AS (
    SELECT *, first_value(CASE WHEN beyond IS NOT NULL THEN h END)
        OVER (PARTITION BY source ORDER BY beyond NULLS LAST, h, here) AS best,
        first_value(CASE WHEN beyond IS NOT NULL THEN here END)
        OVER (PARTITION BY source ORDER BY beyond NULLS LAST, h, here) AS best_here
    FROM offered
), counted AS (
    SELECT *, CAST(n + CASE WHEN h = best AND here = best_here AND size > 0 THEN sign(gap) ELSE 0 END AS BIGINT) AS copies
    FROM swapped
)
SELECT doc_id, size, source_size, target, size * copies AS taken,
       coalesce(array_to_string(list_transform(
           list_transform(range(copies), lambda p: least(CAST(p * source_size + here AS DOUBLE) / target, 1.0::DOUBLE)),
           lambda d: CAST(floor(CASE WHEN abs(slope) < 1e-9 THEN d
               ELSE 2 * d / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * d)) END * 1000000) AS BIGINT)
       ), ','), '') AS training_times
FROM counted""",
}
