"""A training corpus from raw documents: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm.common import bounded, new_path, save, table
from tokenledger.llm.decontamination import contamination
from tokenledger.llm.jaccard import jaccard_components
from tokenledger.llm.language_id import scored, train
from tokenledger.llm.line_dedup import deduped
from tokenledger.llm.mixing import mix_sources


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """docs but for the rows of gone (doc_id, t: the hash of the text); only what goes is broadcast, where it is few, or joined."""
    gone = save(gone.select(F.col("doc_id").alias("gone_id"), F.col("t").alias("gone_text")).distinct(), name)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id_"), F.xxhash64("text").alias("t_"))
    small = bounded(gone)
    return rows.join(small, rows["id_"].eqNullSafe(small["gone_id"]) & (rows["t_"] == small["gone_text"]), "left_anti").select("row.*")


def _once(docs: DataFrame) -> DataFrame:
    """docs with one of the rows of each doc_id and text, the least; only hashes of the others are shuffled."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id_"), F.xxhash64("text").alias("t_"))
    twice = save(rows.groupBy("id_", "t_").count().where("count > 1").select(F.col("id_").alias("i"), F.col("t_").alias("t")), "pipeline-twice")
    if not twice.limit(1).count():
        return docs
    small = bounded(twice)
    same = rows["id_"].eqNullSafe(small["i"]) & (rows["t_"] == small["t"])
    least = rows.join(small, same, "left_semi").groupBy("id_", "t_").agg(F.min("row").alias("row"))
    return rows.join(small, same, "left_anti").select("row.*").unionByName(least.select("row.*"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is of a language learnt from these documents' own labels; letterless and unlike texts go.

    Without any labelled text nothing is learnt, and all documents stay.
    """
    model = train(docs)
    return scored(docs, model).where("NOT rejected").select("row.*") if model["langs"] else docs


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that occur earlier, exactly or within two edits; n_chars counts what is kept."""
    made = {"text": F.col("text"), "n_chars": F.length("text")}
    out = deduped(docs)
    return out.select(*[made[c].cast(docs.schema[c].dataType).alias(c) if c in made else F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 of five-word shingles the one with the smallest doc_id; of repeated rows one."""
    groups = jaccard_components(docs, 5, 80)
    return _once(_without(docs, groups.where("doc_id <> component_id"), "pipeline-near"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with a benchmark item, nor a whole shorter one."""
    leaks = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    return _without(docs, leaks.select("doc_id", F.col("text_hash").alias("t")), "pipeline-leaks")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes at least once, with size, source_size, target, copies (how often it takes them) and taken (words).

    Repeated rows are one row with the copies of all. A column of docs of such a name gives way.
    """
    mixed = mix_sources(docs).groupBy("doc_id", "t").agg(F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("copies").cast("int").alias("copies"), F.sum("taken").alias("taken")).where("copies > 0")
    figures = ["size", "source_size", "target", "copies", "taken"]
    rows = _once(docs)
    rows = rows.select(F.struct(*[c for c in docs.columns if c not in figures]).alias("row"), F.col("doc_id").cast("long").alias("id_"), F.xxhash64("text").alias("t_"))
    return rows.join(mixed, rows["id_"].eqNullSafe(mixed["doc_id"]) & (rows["t_"] == mixed["t"])).select("row.*", *figures)


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", clean), ("mixing sources to target weights", mix)]

#: Language models and the mix's draws are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
