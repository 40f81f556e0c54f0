"""The corpus pipeline: language, near-duplicates, benchmark passages, personal data, tokens.

Each stage is written as Parquet and read again as the next one's documents. All but the last keep
the columns of documents. Where a stage decides about documents, it does so by id and text, so that
documents that share an id stand for themselves; rows without an id are kept there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, language, personal, sentence_pieces, simhash
from panelspark.llm.common import held_out, join_small, table
from panelspark.session import ship, stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without a letter or with a score below the fit's bound go."""
    ship(spark)
    model = language.fit(docs.where(~held_out("doc_id")))
    if model is None:
        return docs
    names = ("_language_found", "_language_score")
    found = language.predict(docs, model, keep=tuple(docs.columns), names=names)
    return found.where((F.col(names[0]) != language.UNKNOWN) & (F.col(names[1]) >= model.bound)).select(docs.columns)


KEY = "_document_key"


def keyed(docs: DataFrame) -> DataFrame:
    """With a key that tells documents apart whose ids repeat: the id and a hash of the text; null without an id."""
    text = F.lower(F.hex(F.xxhash64(F.coalesce("text", F.lit("")))))
    return docs.withColumn(KEY, F.when(F.col("doc_id").isNotNull(), F.concat(F.col("doc_id").cast("string"), F.lit(":"), text)))


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """Documents whose key is not among `bad`."""
    return join_small(keyed(docs), bad, KEY, 64 * bad.count(), "n_chars", "left_anti").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: of its smallest id, the one of the smallest key.

    Documents of one id and different texts are told apart; of rows that agree in id and text one stays.
    """
    ship(spark)
    found = simhash.classes(keyed(docs), keep=(KEY,)).where("doc_id is not null")
    found = stage(found.select("root", "doc_id", KEY), "classes")
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", KEY))[KEY].alias(KEY))
    lost = stage(found.select(KEY).distinct().join(first.select(KEY), KEY, "left_anti"), "lost")
    kept = without(docs, lost)
    again = stage(found.groupBy(KEY).count().where("count > 1").select(KEY).join(lost, KEY, "left_anti"), "repeated")
    n = again.count()
    if not n:
        return kept
    more = keyed(kept)
    once = join_small(more, again, KEY, 64 * n, "n_chars", "left_semi").dropDuplicates([KEY])
    return join_small(more, again, KEY, 64 * n, "n_chars", "left_anti").unionByName(once).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    found = decontaminate.overlaps(keyed(docs), table(spark, sf_dir, "benchmark"), id_col=KEY)
    return without(docs, stage(found.select(F.col("id").alias(KEY)).where(f"{KEY} is not null").distinct(), "overlaps"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars is that of the new text."""
    ship(spark)
    out = personal.redact(docs, personal.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document."""
    ship(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentence_pieces.digests(docs, model, keep_ids=True)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("personal_data", redacted),
    ("sentence_pieces", encoded),
]

ORACLE_SQL = None  # a string kernel, boosted trees and merges by score are not expressible


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
