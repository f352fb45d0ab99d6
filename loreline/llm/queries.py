"""Queries over the operators for training data, with SQL where it can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.llm.cut import cut_rates, score_cuts
from loreline.llm.language import document_languages, relabelled
from loreline.llm.lookalike import same_looking_classes, same_looking_pairs
from loreline.llm.markup import clean_text, marked_fields
from loreline.llm.names import map_redirects, unmatched_values
from loreline.llm.mixing import mix, reached_shares
from loreline.llm.packing import fill_rates, pack
from loreline.llm.tokens import document_sizes
from loreline.session import materialise


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of all documents, counted once and written."""
    return materialise(document_sizes(_table(spark, d, "documents")), "sizes")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return map_redirects(_table(spark, d, "redirects"), _table(spark, d, "canon_list")).select("redirect_id", "entry_id")


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return unmatched_values(_table(spark, d, "redirects"), _table(spark, d, "canon_list"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    silver, docs = _table(spark, d, "silver"), _table(spark, d, "documents")
    notes = F.array_join(F.filter("notes", lambda x: x.isNotNull()), "\n\n")
    fields = silver.select(F.lit("silver").alias("origin"), F.col("number").cast("long").alias("rec_id"), F.explode(F.array(
        F.struct(F.lit("long_summary").alias("field"), F.col("long_summary").alias("text")), F.struct(F.lit("notes").alias("field"), notes.alias("text")))).alias("f")).select("origin", "rec_id", "f.*")
    return marked_fields(fields.unionByName(docs.select(F.lit("documents").alias("origin"), F.col("doc_id").alias("rec_id"), F.lit("text").alias("field"), "text")))


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    """Readable text of every chapter line and document and of the summaries and notes."""
    c = _table(spark, d, "chapters").select(F.lit("chapters").alias("origin"), F.col("line_no").alias("rec_id"), F.col("wikitext").alias("text"))
    t = _table(spark, d, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("rec_id"), "text")
    s = _table(spark, d, "silver").select(F.col("number").cast("long").alias("rec_id"), F.explode(F.concat(
        F.array(F.struct(F.lit("silver.long_summary").alias("origin"), F.col("long_summary").alias("text"))),
        F.coalesce(F.transform("notes", lambda n: F.struct(F.lit("silver.notes").alias("origin"), n.alias("text"))), F.array()))).alias("f")).select("f.origin", "rec_id", "f.text")
    return clean_text(c.unionByName(t).unionByName(s), "text").drop("text")


def _looks(spark: SparkSession, d: str) -> DataFrame:
    a = _table(spark, d, "suspicious_aliases").select(F.lit("suspicious_aliases").alias("origin"), F.lit(0).alias("scope"), F.col("alias_id").alias("id"), F.col("alias").alias("text"))
    c = _table(spark, d, "chapters").where((F.col("number") > 0) & F.col("wikitext").rlike(r"[^\s\p{Z}\x{FEFF}\x{200B}]"))
    c = c.select(F.lit("chapters").alias("origin"), F.col("number").alias("scope"), F.col("line_no").alias("id"), F.col("wikitext").alias("text"))
    return a.unionByName(c)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return same_looking_pairs(_looks(spark, d))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every text with the class of those that look like it."""
    return same_looking_classes(_looks(spark, d)).select("origin", "id", "form", "members")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    s = _table(spark, d, "silver").select(F.lit("silver").alias("origin"), F.col("number").cast("long").alias("rec_id"), "source", F.col("long_summary").alias("text"))
    t = _table(spark, d, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("rec_id"), "source", "text")
    return score_cuts(s.unionByName(t))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("p_cut >= 0.5").select("origin", "rec_id").distinct()


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of cut texts per source."""
    return cut_rates(_scored(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return relabelled(_table(spark, d, "documents")).select("doc_id", "seg_no", "lang")


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language of every document and of each of its paragraphs, with confidence."""
    read = document_languages(_table(spark, d, "documents").select("doc_id", "text", "lang"))
    return read.select("doc_id", "main", F.round("main_confidence", 4).alias("main_confidence"), F.to_json("segments").alias("segments"))


def _packed(spark: SparkSession, d: str) -> list[tuple[str, int, DataFrame]]:
    sizes = _sizes(spark, d).select(F.col("doc_id").alias("item"), "tokens")
    kinds = sorted({(r.capacity_tokens, r.profile) for r in _table(spark, d, "containers").collect()})
    return [(profile, c, pack(sizes, c)) for c, profile in kinds]


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's containers, for each profile."""
    return reduce(DataFrame.unionByName, (p.select(F.lit(name).alias("profile"), F.col("item").alias("doc_id"), "part", "tokens", "container") for name, _, p in _packed(spark, d)))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each profile are."""
    return reduce(DataFrame.unionByName, (fill_rates(p, c).withColumn("profile", F.lit(name)) for name, c, p in _packed(spark, d)))


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    """The documents' token ranges in mixed order."""
    return mix(_sizes(spark, d), _table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every wanted source."""
    return reached_shares(p9_selection(spark, d), _table(spark, d, "mix_targets"))


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_text, p4_found, p4_classes, p6_found, p6_rates, p8_containers, p8_fill, p9_selection, p9_shares, p10_found, p10_languages)}
ORACLES: dict[str, str] = {}
