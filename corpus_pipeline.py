"""From raw documents to packed training windows: language, near duplicates, personal data, mixture, packing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squallframe.llm import jaccard, language, mixing, packing, pii
from squallframe.session import settle


MOST_EXCESS = 2.0  # how much less likely than usual, in mean log probability, n-grams may be: clean texts stay below 1.4, letter junk is above 3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without letters go, those of which no language is likelier than all others
    together, and those whose n-grams are much less likely than that language's own (letter junk, languages not learned).

    A null, empty or letterless text goes whatever its other columns; repeated rows stay; without labelled rows, or with an empty
    table, nothing stays.  Texts are judged whole; other columns stay as they are, whatever their names."""
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))), "text", "lang", "doc_id")
    found = language.predictor(spark, model)(F.col("text"))
    return docs.where((found["lang"] != "und") & (found["score"] >= 0.5) & (found["excess"] <= MOST_EXCESS))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard 0.8 or more): the smallest id stays, null
    ids last, then the smallest text hash.  Documents without words stay, null and empty texts among them; of rows that repeat id and
    text one stays; texts are compared whole; an empty table stays empty; other columns go along, whatever their names."""
    name = "__key"
    while name in docs.columns:
        name += "_"
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text"))
    keyed = docs.withColumn(name, key)
    linked = jaccard.link_documents(keyed, name, "text", shingle=5, percent=80).where("component is not null")
    dropped = settle(linked.where("key <> component_id").select(F.col("key").alias(name)).distinct())
    # only what a filter of bounded size takes for dropped has to meet the dropped keys
    hashed = F.xxhash64(name)
    maybe = jaccard.lookup(dropped.select(hashed), dropped.count())(hashed)
    kept = keyed.where(~maybe).unionByName(keyed.where(maybe).join(dropped, name, "left_anti"))
    # a row that repeats the id and the text of the one that stays
    again = settle(linked.where("key = component_id").groupBy("key").count().where("count > 1").select(F.col("key").alias(name)))
    if not again.isEmpty():
        once = kept.join(again, name, "left_semi").dropDuplicates([name])
        kept = kept.join(again, name, "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the kind of what stood there, and n_chars counted anew.

    A null text stays null, with a null n_chars; texts are read whole; repeated rows stay, an empty table stays empty, other columns
    stay as they are."""
    clean = docs.withColumn("text", pii.redact(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them: 5, 2, 1 in turn, three times at most.

    A null source is one of its own, last in order; documents without words are taken as often as their draw says; repeated rows
    share a draw; an empty table stays empty; other columns go along."""
    return mixing.mixture(docs, "doc_id", "text", "source", weights=[5, 2, 1], share=1.0, most=3)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its token ids, its window of 2048 tokens and its place there.

    A null or empty text gives its end id alone; long texts are cut at multiples of the window; repeated rows, which mixing makes, give
    pieces of their own; an empty table gives an empty result; of the other columns none is kept."""
    cut = packing.pieces(docs, "doc_id", "text", window=2048, end_id=1, keep_ids=True)
    return packing.pack(cut, window=2048).withColumnRenamed("key", "doc_id")


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each),
    ("personal_data", without_personal_data),
    ("mix_sources", mixed),
    ("packing", packed),
]

ORACLE_SQL = None  # tokenizing and naive Bayes have no SQL; the tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is written and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
