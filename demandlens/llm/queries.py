"""Registered queries of this package: thin contracts over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm import (
    ann, cotrain, dag_manifest, decontaminate, edit_lattice, html_text, langid, licenses, merkle, mixing,
    ngram_join, pii, quotes,
)
from demandlens.llm.common import cut, table


def op1_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    scored = cotrain.with_scores(docs, table(spark, sf_dir, "labels"))
    s = F.col(cotrain.SCORES)
    return scored.select("doc_id", s["score"].alias("score"), s["content"].alias("content_score"),
                         s["meta"].alias("meta_score"), (s["score"] >= cotrain.KEEP).alias("keep"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item that it contains)."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes from it."""
    mixed = mixing.pareto_mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op6_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of ``conversations`` with its thread, without quotes."""
    return quotes.link(table(spark, sf_dir, "conversations"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and discovered personal data of every document."""
    return pii.report(pii.find_pii(table(spark, sf_dir, "documents")))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of Jaccard links."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).drop("set_id")


def pages_as_warc(pages: DataFrame) -> DataFrame:
    """(file, pos, record): every page as a record, 250 page ids a file."""
    name = F.concat(F.lit("pages-"), F.coalesce(F.floor(F.col("page_id") / 250).cast("string"), F.lit("none")), F.lit(".warc"))
    return pages.select(name.alias("file"), F.col("page_id").alias("pos"), merkle.warc_record(F.col("url"), F.col("html")).alias("record"))


def damaged(records: DataFrame) -> DataFrame:
    """A replica with known damage, of a size with the table: a byte of the
    record end changed in every 211th page, every 503rd page's record blanked
    (its length stays)."""
    size = F.octet_length("record")
    rot = F.concat(F.substring("record", 1, size - 4), F.lit("\r\n\r ").cast("binary"))
    blank = F.repeat(F.lit(" "), size).cast("binary")
    record = F.when(F.col("pos") % 503 == 11, blank).when(F.col("pos") % 211 == 7, rot).otherwise(F.col("record"))
    return records.select("file", "pos", record.alias("record"))


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages' WARC files in which a damaged replica differs."""
    records = pages_as_warc(table(spark, sf_dir, "pages"))
    a = cut(merkle.manifest(records), "warc-a")
    b = cut(merkle.manifest(damaged(records)), "warc-b")
    return merkle.audit(a, b)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence labels of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its proof and the root a tampered copy gives."""
    return dag_manifest.audit_tampered(table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage and its cheapest repair."""
    conversations = table(spark, sf_dir, "conversations")
    return edit_lattice.repair(conversations, edit_lattice.damage(conversations))


QUERIES = {
    "op1_cotrain": op1_cotrain,
    "op2_ann": op2_ann,
    "op3_decontaminate": op3_decontaminate,
    "op4_html_text": op4_html_text,
    "op5_mixing": op5_mixing,
    "op6_quotes": op6_quotes,
    "op7_pii": op7_pii,
    "op8_ngram_join": op8_ngram_join,
    "op9_merkle": op9_merkle,
    "op10_langid": op10_langid,
    "op11_licenses": op11_licenses,
    "op12_manifest": op12_manifest,
    "op13_repair": op13_repair,
}
