"""The dealt queries and their SQL twins."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squallframe.llm import chats, fingerprints, jaccard, language, mixing, negatives, neighbours, packing, pii, quality, sharding, substrings, whitening

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return keep


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
listed AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, 3 * source_size AS cap FROM totals),
filled AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place,
         (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM listed),
opened AS (SELECT min(place) AS p, min_by(level, place) AS common FROM filled WHERE cap > level * w),
goals AS (
  SELECT source, source_size, CASE WHEN p IS NULL OR place < p THEN CAST(cap AS DOUBLE) ELSE common * w END AS target FROM filled, opened),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS base FROM goals),
hashes AS (SELECT source, h, sum(size) AS words FROM sized GROUP BY source, h),
run AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM hashes),
edge AS (
  SELECT r.source, min_by(r.h + CASE WHEN r.upto - (s.target - s.base * s.source_size) < (s.target - s.base * s.source_size) - (r.upto - r.words) THEN 1 ELSE 0 END, r.h) AS bound
  FROM run r JOIN split s ON r.source IS NOT DISTINCT FROM s.source
  WHERE r.upto > s.target - s.base * s.source_size GROUP BY r.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, s.source_size, s.target,
       CAST(d.size * (s.base + CASE WHEN coalesce(d.h < e.bound, s.target - s.base * s.source_size > 0 AND s.base < 3) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN split s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN edge e ON d.source IS NOT DISTINCT FROM e.source
"""


@query("op1_mix_sources", MIX_SQL)
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "source")
    mixed = mixing.mix(docs, "doc_id", "text", "source", weights=[5, 2, 1], share=1.0, most=3)
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


SHARD_SQL = r"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, CAST(i AS UBIGINT) FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
bytes AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS UBIGINT)) AS b,
         list_transform(range(9), lambda s: -ln((CAST(CAST('0x' || substr(md5('shard:' || s || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)) AS times
  FROM documents),
placed AS (
  SELECT doc_id, CAST(len(b) + 1 AS BIGINT) AS size,
         CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda c, x: xor(c >> 8, t[CAST(xor(c & 255, x) AS BIGINT) + 1])), 4294967295::UBIGINT) AS BIGINT) AS text_crc32,
         CAST(list_position(times, list_min(times[1:8])) - 1 AS INT) AS shard,
         CAST(list_position(times, list_min(times)) - 1 AS INT) AS grown_shard
  FROM bytes, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM placed
"""


@query("op9_rendezvous_shards", SHARD_SQL)
def rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    placed = sharding.shard_records(docs, "doc_id", "text", weights=[1.0] * 8, more=[1.0])
    return placed.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op3_format_chats")
def format_chats(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chats.digests(chats.format_chats(rows.unionByName(added)))


@query("op5_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    found = language.identify(docs, "doc_id", "text", "lang")
    return found.select(F.col("key").alias("doc_id"), "held_out", F.col("lang").alias("lang_pred"), "score")


@query("op7_pack_documents")
def pack_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    packed = packing.pack(packing.pieces(docs, "doc_id", "text", window=2048, end_id=1), window=2048)
    return packed.withColumnRenamed("key", "doc_id")


@query("op8_personal_data")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.scan(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    base = F.filter("found", lambda s: s["kind"].isin(pii.BASE))

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("key").alias("doc_id"),
        *[count(k) for k in pii.BASE],
        F.sha2(pii.written(base), 256).alias("base_sha256"),
        pii.written(F.col("found")).alias("spans"),
        F.size("found").cast("long").alias("n_spans"),
        pii.scores(F.col("found")).alias("scores"),
    )


@query("op4_fingerprints")
def document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return fingerprints.edit_and_compare(docs, "doc_id", "text").withColumnRenamed("key", "doc_id")


@query("op2_substring_dedup")
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = substrings.remove_repeated(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", window=35)
    return cleaned.select(F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op6_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings", "vec_id", "embedding")
    return neighbours.search(rows, "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=10)


@query("op10_jaccard_components")
def jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    linked = jaccard.link_documents(docs, "doc_id", "text", shingle=4, percent=85)
    return linked.select(F.col("key").alias("doc_id"), "n_shingles", "component_id")


@query("op11_whiten_embeddings")
def whiten_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    done = whitening.whiten(table(spark, folder, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", k=8)
    each = done.select(F.col("key").alias("vec_id"), "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")


QUALITY_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         len(regexp_extract_all(text, '\p{L}[^\x20\x09-\x0D]*')) AS lettered
  FROM docs),
windows AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, w FROM split WHERE len(w) > 8),
counted AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(list_slice(w, i, i + 7), ' ')) AS times FROM windows),
gaps AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS words FROM counted WHERE times > 1),
again AS (SELECT rid, CAST(sum(words) AS BIGINT) AS n FROM gaps GROUP BY rid),
found AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, lettered
  FROM split LEFT JOIN again USING (rid)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM found)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words OR 10 * lettered < 8 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM based
"""


@query("op12_quality_cascade", QUALITY_SQL)
def quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    report = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality.judge(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", report=report)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select(F.col("key").alias("doc_id"), *report, failed.alias("base_failed"), "kept")


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS alike, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
found AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id
  WHERE NOT s.alike AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 10
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, "vec_id", "embedding", "label", F.col("vec_id") % 100 == 0)
