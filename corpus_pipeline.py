"""Corpus pipeline: language, near duplicates, decontamination, mixing, token ids.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's docs, and what it read is deleted.
All but the last return the columns of ``documents``, whatever others there are.

In all stages a row is known by its id and its whole text: equal texts under
several ids, an id with several texts, rows without an id and rows without a
text are told apart; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloneweave.llm import decontaminate, jaccard, langid, mixing, tokenio
from cloneweave.llm.common import discard, fresh_path, made, table
from cloneweave.llm.queries import token_params

LEAST_SCORE = 0.3  # of a language's probability
SEED = 23


def _key() -> Column:
    """One for each id and text, nulls included; 256 bits, so that two never fall together."""
    part = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat(part("doc_id"), F.lit(" "), part("text")), 256)


def _keyed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), key: names of the docs' columns can't clash with a stage's."""
    return docs.select(F.struct(*docs.columns).alias("row"), _key().alias("key"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones too) and those that no language fits: the language is learned from docs.

    Where docs name no language, every text with a letter stays.  Repeated rows
    share their fate; the score of a tie is that of its languages alike.
    """
    model = langid.fit(docs)
    if not model[0]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    fits = (F.col("lang_pred") != langid.UND) & (F.col("lang_score") >= LEAST_SCORE)
    return langid.identify(rows, model).filter(fits).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links from 0.8 on over five-word shingles, the document of smallest id stays.

    Rows without an id take part and give way to documents with one.  Of rows of
    one id and text one stays (that of the smallest hash of its columns); an id
    that stays keeps all its texts.  Texts without words are alone.
    """
    spare = F.lit(1 << 62) + F.pmod(F.xxhash64(F.lit(SEED), "text"), F.lit(1 << 62))  # above all ids
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), spare).alias("at"), F.col("text").alias("text"), F.xxhash64(*docs.columns).alias("tie"))
    found = jaccard.join_components(rows, jaccard.JoinParams(k=5, num=80, den=100), id_col="at")
    stay = found.filter("doc_id = component_id").select(F.col("doc_id").alias("stays")).distinct()
    rows = rows.join(stay, F.col("at") == F.col("stays"), "left_semi").withColumn("text", F.sha2("text", 256))
    first = Window.partitionBy("at", "text").orderBy("tie")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").select("row.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, all rows of the same id and text with them; null and empty texts hold none."""
    held = decontaminate.leaks(docs.select(_key().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _keyed(docs).join(held.select(F.col("doc_id").alias("held")).distinct(), F.col("key") == F.col("held"), "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a part of a document stays whole or goes, by a seeded draw with that part's odds.

    So a source's words come near its target whatever its documents' sizes.
    Texts without words go.  Rows of one id and text share what they are taken.
    """
    taken = mixing.mix(docs.select(_key().alias("doc_id"), "text", "source")).filter("taken > 0")
    odds = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.sum(F.col("taken") / F.col("size"))
    times = taken.groupBy("doc_id").agg(share.alias("share")).select(F.col("doc_id").alias("taken"), F.floor(F.col("share") + odds).cast("int").alias("times")).filter("times > 0")
    rows = _keyed(docs).join(times, F.col("key") == F.col("taken"))
    among = Window.partitionBy("key")
    rows = rows.withColumns({"n": F.row_number().over(among.orderBy("key")), "of": F.count(F.lit(1)).over(among)})
    # the n-th of the rows takes the n-th, the (n + of)-th, ... time
    rows = rows.withColumn("each", F.floor((F.col("times") - F.col("n")) / F.col("of")) + 1).filter("each > 0")
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("each")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in record files; what their index and the files hold of each document.

    A null text is empty and has the end id alone; rows without an id come
    first; equal ids stand by a hash of their texts; repeated rows are records each.
    """
    p = token_params()
    _, index = tokenio.write_records(docs, p)
    return tokenio.read_records(index, p)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", clean), ("mixing", mixed), ("tokens", tokens)]
ORACLE_SQL = None  # SQL can't express the first stage; tests/llm hold the others against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        old = list(made)
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        # what the stage staged and the stage before wrote
        discard(spark, [x for x in made if x not in old and x != path or "/pipeline-" in x and x in old])
    return docs
