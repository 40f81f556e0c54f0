"""One registered query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import byte_pairs, decontaminate, html_text, language, licenses, merkle, personal, sentence_pieces, simhash, token_files, top_k, toxicity, va_file
from panelspark.llm.common import held_out, table
from panelspark.session import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@query("op9_language")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = language.fit(docs.where(~held_out("doc_id")))
    found = language.predict(docs, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query("op6_simhash")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.classes(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_decontaminate")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark")).withColumnRenamed(
        "id", "doc_id")


@query("op2_personal")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = personal.find(docs, personal.fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query("op1_sentence_pieces")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_pieces.digests(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    found = toxicity.score(docs, toxicity.fit(docs, labels.where(~held_out("doc_id"))))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                        (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


@query("op10_top_k", """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) v
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
s as (
  select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(rank as int) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
where rank <= 5""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return top_k.search(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op4_licenses", licenses.oracle())
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return licenses.scan(docs, licenses.idf(docs))


@query("op8_html_text")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return html_text.extract(pages, html_text.fit(pages))


@query("op5_token_files")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    rows = token_files.blocks(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2,
                              id_bits=16)
    return token_files.digests(stage(rows, "token-files"))


@query("op13_byte_pairs")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return byte_pairs.digests(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op12_manifest", merkle.oracle())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    return merkle.manifest(table(spark, sf, "documents"), changed=tampered, changes={"n_chars": more})


@query("op11_centroids", va_file.oracle())
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return va_file.inertia(va_file.clustered(table(spark, sf, "embeddings")))
