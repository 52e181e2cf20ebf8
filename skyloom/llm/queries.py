"""Queries of the training-data operators, run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.numeric import finite_or_null
from skyloom.llm.cutoff import fraction_cutoffs, keep_fraction
from skyloom.llm.leaks import leaked_items
from skyloom.llm.packing import pack, packing_certificates, packing_checks, packing_report, token_counts
from skyloom.llm.percentiles import add_up, from_ladder, ladder, magnitude, percentiles
from skyloom.llm.sample import register, sampled
from skyloom.llm.stuffing import fitted, stuffed_pages
from skyloom.llm.topn import top_n
from skyloom.runtime import bounded, materialize, scratch_path

SCORE, CELL = "i_cmodelmag_dered", "__icov__"


def _read(spark: SparkSession, where: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{where}/{table}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return keep_fraction(_read(spark, d, "dp1_objects"), _read(spark, d, "cut_targets"), CELL, SCORE, "record_id")


def p1_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return fraction_cutoffs(_read(spark, d, "dp1_objects"), _read(spark, d, "cut_targets"), CELL, SCORE)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    objects = _read(spark, d, "dp1_objects").where(F.col(CELL) >= 0).select(CELL, "record_id", SCORE, "coord_ra", "coord_dec")
    return top_n(objects, CELL, SCORE, ["coord_ra", "coord_dec", "record_id"], 5).select(CELL, "record_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(_read(spark, d, "documents"), _read(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffed_pages(_read(spark, d, "documents")).select("doc_id")


SEED = 20_250_301
#: Share of positions picked, by the batch in which an object or source was first seen.
RATES, LATER = {1: 0.2, 2: 0.2, 3: 0.1, 4: 0.1}, 0.05


def _sample(rows: DataFrame, identifier: str, batch: str) -> DataFrame:
    """Two deliveries, as they would come: the first batches are registered, later ones only add to the registry."""
    registry = scratch_path(rows.sparkSession)
    register(rows.where(F.col(batch) <= 4), identifier, batch, RATES, LATER, registry)
    return sampled(rows, identifier, register(rows, identifier, batch, RATES, LATER, registry), SEED)


def p3_sample_objects(spark: SparkSession, d: str) -> DataFrame:
    """The picked rows; a coordinate that is no finite number is NULL."""
    place = [finite_or_null(F.col(c)).alias(c) for c in ("coord_ra", "coord_dec")]
    return _sample(_read(spark, d, "dp1_objects").select("record_id", "objectid", *place, "ingest_batch"), "objectid", "ingest_batch")


def p3_sample_sources(spark: SparkSession, d: str) -> DataFrame:
    """The picked rows; a coordinate that is no finite number is NULL."""
    place = [finite_or_null(F.col(c)).alias(c) for c in ("ra", "dec")]
    return _sample(_read(spark, d, "des_sources").select("coadd_object_id", *place, "load_batch"), "coadd_object_id", "load_batch")


PROBABILITIES = (0.05, 0.25, 0.5, 0.75, 0.95)
ERROR = 0.005


def _magnitudes(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Field, night and one magnitude read as a number, once for all passes."""
    catalog = _read(spark, d, "tmpl_catalog")
    return materialize(catalog.select("field_name", "night", magnitude(F.col(name)).alias(name)).where(F.col(name).isNotNull()))


def p6_by_field(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(_magnitudes(spark, d, "mag_r"), ["field_name"], "mag_r", PROBABILITIES)


def p6_by_night(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(_magnitudes(spark, d, "mag_r"), ["night"], "mag_r", PROBABILITIES)


def p6_g_by_field_night(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(_magnitudes(spark, d, "mag_g"), ["field_name", "night"], "mag_g", PROBABILITIES)


def p6_nights_combined(spark: SparkSession, d: str) -> DataFrame:
    nights = materialize(ladder(_magnitudes(spark, d, "mag_r"), ["field_name", "night"], "mag_r", ERROR))
    return from_ladder(add_up(nights, ["field_name"]), ["field_name"], PROBABILITIES, ERROR)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_counts(_read(spark, d, "documents")))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing_report(materialize(p7_containers(spark, d)))


def p7_certificates(spark: SparkSession, d: str) -> DataFrame:
    return packing_certificates(materialize(p7_containers(spark, d)))


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """Whether every page is placed whole, cut only if it must be, in containers that hold it."""
    sizes = materialize(token_counts(_read(spark, d, "documents")))
    return packing_checks(materialize(pack(sizes)), sizes)


_PLAIN_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+', 0)"


def p8_exact_found(spark: SparkSession, d: str) -> DataFrame:
    """Of the leaked pairs those whose page quotes 15 words exactly: all that plain 15-word shingles find must be among the leaks."""
    pages, items = _read(spark, d, "documents"), _read(spark, d, "eval_items")
    leaks = materialize(leaked_items(pages, items).select("doc_id", "item_id").distinct())
    rest = F.regexp_replace(F.trim("text"), r"^[^\n]*?(?:[.!?:][ \t]|\n)", "")
    heads = items.withColumn("rest", rest).withColumn("head", F.expr("substring(trim(text), 1, length(trim(text)) - length(rest))"))
    shared = heads.where("head <> ''").groupBy("head").agg(F.countDistinct("text").alias("n")).where("n >= 3").select(F.col("head").alias("_head"))
    body = heads.join(shared, F.col("head") == F.col("_head"), "left").select("item_id", F.when(F.col("_head").isNotNull(), F.col("rest")).otherwise(F.col("text")).alias("text"))

    def shingles(rows: DataFrame, key: str) -> DataFrame:
        words = rows.select(key, F.expr(_PLAIN_WORDS.format("text")).alias("w")).where("size(w) >= 15")
        at = words.select(key, "w", F.explode(F.expr("sequence(1, size(w) - 14)")).alias("i"))
        return at.select(key, F.expr("xxhash64(array_join(slice(w, i, 15), ' '))").alias("s"))

    wanted = materialize(shingles(body, "item_id").distinct())
    quoted = shingles(pages, "doc_id").join(bounded(wanted, wanted.count()), "s").select("doc_id", "item_id").distinct()
    return quoted.join(leaks, ["doc_id", "item_id"])


def p9_rank_curves(spark: SparkSession, d: str) -> DataFrame:
    """The curve fit by itself, on plain words: slope and residual of every page."""
    words = _read(spark, d, "documents").select("doc_id", F.explode(F.expr(_PLAIN_WORDS.format("text"))).alias("w"))
    points = words.groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("f")).groupBy("doc_id", "f").agg(F.count(F.lit(1)).alias("n"))
    return fitted(points, ["doc_id"]).select("doc_id", F.round("slope", 6).alias("slope"), F.round("residual", 6).alias("residual"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found,
        p1_cutoffs,
        p2_found,
        p3_sample_objects,
        p3_sample_sources,
        p6_by_field,
        p6_by_night,
        p6_g_by_field_night,
        p6_nights_combined,
        p7_containers,
        p7_report,
        p7_certificates,
        p7_checked,
        p8_found,
        p8_exact_found,
        p9_found,
        p9_rank_curves,
    )
}
