"""One query for each catalogue operator, over whole tables.

``orders`` is the point catalogue (positions derived from the key by integer arithmetic, score ``o_totalprice``), ``events`` the magnitude
catalogue (``value / 20``, many ties), ``customer`` the one with negative scores, ``dp1_objects`` the dirty one with given cells.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.config import Algorithm, config_from_mapping
from skyloom.functions.healpix import parent, with_pixel
from skyloom.functions.numeric import as_double, finite_or_null
from skyloom.functions.score import score_expression
from skyloom.operators import coverage as cv
from skyloom.operators import magnitude as mg
from skyloom.operators.clean import needs_ra_shift, position_extrema, shifted_ra
from skyloom.operators.densmap import compact_cells, coverage_cells, density_maps, density_stats
from skyloom.operators.report import column_report
from skyloom.plans.pipeline import hats_ordinals
from skyloom.runtime import bounded, materialize, scratch_path
from skyloom.sinks.tiles import ALLSKY_ORDERS, clean_text, tile_path_column
from skyloom.sources.catalog import hats_index_order, read_catalog, read_hats, roles

DEEPEST, CELL_ORDER, LEVELS = 8, 3, 5
TIES = ("ra", "dec", "id")
MAG_LOW, MAG_HIGH, BINS, MAG_LEVELS = 1.0, 20.0, 64, 5
SEED = 12_345


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _placed(df: DataFrame, key: str, order: int = DEEPEST) -> DataFrame:
    """``df`` with ra, dec and the pixel ``deep`` at ``order``, from a whole-number key."""
    sky = df.withColumn("ra", F.expr(f"(({key} * 2654435761) % 3600000) / 10000.0D + 0.00003D"))
    sky = sky.withColumn("dec", F.expr(f"(({key} * 40503 + 17) % 1799998) / 10000.0D - 89.99993D"))
    return with_pixel(sky, F.col("ra"), F.col("dec"), order, "deep")


def orders_sky(spark: SparkSession, d: str, order: int = DEEPEST) -> DataFrame:
    o = _read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_totalprice").alias(cv.SCORE), F.col("o_orderkey").alias("o_orderkey"))
    return _placed(o, "o_orderkey", order).drop("o_orderkey")


def orders_cells(spark: SparkSession, d: str) -> DataFrame:
    return orders_sky(spark, d).withColumn(cv.CELL, parent(F.col("deep"), DEEPEST - CELL_ORDER))


def events_sky(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events").select("event_id", (F.col("value") / 20).alias(mg.MAG))
    return _placed(e, "event_id")


def _best(descending: bool = False) -> list:
    return cv.best_first(TIES, descending)


def ipix_orders(spark, d):
    deep = orders_sky(spark, d, 11)
    return deep.select("id", *[parent(F.col("deep"), 11 - o).alias(f"ipix{o}") for o in (0, 4, 8, 11)])


def densmap_all(spark, d):
    return density_maps(orders_sky(spark, d), "deep", DEEPEST)


def densmap_stats(spark, d):
    return density_stats(densmap_all(spark, d))


def moc_cells(spark, d):
    return coverage_cells(densmap_all(spark, d), 6)


def moc_compacted(spark, d):
    return compact_cells(coverage_cells(densmap_all(spark, d), 5), 5)


def radec_extrema(spark, d):
    return position_extrema(_read(spark, d, "dp1_objects"), "coord_ra", "coord_dec")


def ra_shift(spark, d):
    c = _placed(_read(spark, d, "customer"), "c_custkey").select("c_custkey", (F.col("ra") - 180).alias("ra"), "dec")
    e = position_extrema(c, "ra", "dec").first()
    shift = needs_ra_shift(e.ra_min, e.ra_max, e.dec_min, e.dec_max)
    return c.select("c_custkey", (shifted_ra(F.col("ra")) if shift else F.col("ra")).alias("ra"))


def _config(**algorithm):
    given = {"input": {"paths": ["-"]}, "columns": {"ra": "ra", "dec": "dec", "score": "o_totalprice", "keep": ["o_orderstatus", "missing"]}, "algorithm": {"level_limit": LEVELS, **algorithm}, "cluster": {}, "output": {"out_dir": "-", "cat_name": "-"}}
    return config_from_mapping(given)


def keep_projection(spark, d):
    o = _placed(_read(spark, d, "orders"), "o_orderkey").drop("deep")
    return o.select("o_orderkey", *roles(o, _config()).keep)


def score_expressions(spark, d):
    o = _read(spark, d, "orders")
    score = score_expression("np.sqrt(o_totalprice) * 2 - o_custkey / 7 + (o_custkey % 5) ** 2", lambda c: as_double(o, c), o.columns)
    return o.select("o_orderkey", score.alias("score"))


def mag_coerce_window(spark, d):
    t = _read(spark, d, "tmpl_catalog")
    return mg.in_window(t.select("row_id", "night", as_double(t, "mag_r").alias(mg.MAG)), 15.0, 20.0)


def mag_extrema(spark, d):
    return mg.magnitude_extrema(events_sky(spark, d))


def mag_histogram(spark, d):
    return mg.magnitude_histogram(events_sky(spark, d), MAG_LOW, MAG_HIGH, BINS)


def mag_auto_max(spark, d):
    events = events_sky(spark, d)
    e = mg.magnitude_extrema(events).first()
    low, most = mg.bounds(e.mag_low, e.mag_high, None, None)
    counts = mg.histogram_counts(mg.magnitude_histogram(events, low, most, BINS), BINS)
    return spark.createDataFrame([(low, mg.peak_magnitude(counts, mg.bin_edges(low, most, BINS), most))], "mag_min double, mag_max double")


def _mag_weights(spark, d):
    inside = mg.in_window(events_sky(spark, d), MAG_LOW, MAG_HIGH)
    return density_stats(density_maps(inside, "deep", DEEPEST)).where(F.col("depth").between(1, MAG_LEVELS))


def mag_depth_weights(spark, d):
    return _mag_weights(spark, d).select("depth", F.greatest(F.lit(1).cast("long"), "n_pixels").alias("weight"))


def _mag_edges(spark, d) -> list[float]:
    weights = {r["depth"]: r["n_pixels"] for r in _mag_weights(spark, d).collect()}
    counts = mg.histogram_counts(mag_histogram(spark, d), BINS)
    targets = mg.depth_targets(int(counts.sum()), [weights.get(i, 0) for i in range(1, MAG_LEVELS + 1)], [500, None, None])
    return mg.slice_edges(counts, mg.bin_edges(MAG_LOW, MAG_HIGH, BINS), targets)


def mag_cdf_edges(spark, d):
    edges = _mag_edges(spark, d)
    return spark.createDataFrame(list(enumerate(edges)), "i int, edge double")


def mag_slices(spark, d):
    edges = _mag_edges(spark, d)
    inside = mg.in_window(events_sky(spark, d), MAG_LOW, MAG_HIGH).withColumn("depth", mg.slice_depth(F.col(mg.MAG), edges))
    return inside.where(F.col("depth").isNotNull()).select("event_id", "depth", F.expr(f"shiftright(deep, 2 * ({DEEPEST} - depth))").alias("ipix"))


def cov_topk(spark, d):
    return cv.top_k(orders_cells(spark, d), 2, _best()).select("id", cv.CELL, F.col(cv.RANK).alias("rank"))


def cov_topk_objects(spark, d):
    o = _read(spark, d, "dp1_objects").select("record_id", "coord_ra", "coord_dec", cv.CELL, finite_or_null(F.col("i_cmodelmag_dered")).alias(cv.SCORE))
    return cv.top_k(o, 3, cv.best_first(("coord_ra", "coord_dec", "record_id"), False)).select("record_id", cv.CELL)


def cov_topk_desc(spark, d):
    c = _placed(_read(spark, d, "customer").withColumn(cv.SCORE, F.col("c_acctbal")).withColumnRenamed("c_custkey", "id"), "id")
    c = c.withColumn(cv.CELL, parent(F.col("deep"), DEEPEST - 2))
    return cv.top_k(c, 3, _best(True)).select("id", cv.CELL)


def _density(spark, d) -> DataFrame:
    return density_maps(orders_cells(spark, d), cv.CELL, CELL_ORDER).where(F.col("depth") == CELL_ORDER).select(F.col("ipix").alias(cv.CELL), "n")


def bias_weights(spark, d):
    return cv.bias_weights(_density(spark, d), "proportional", 0.5).select(cv.CELL, F.round("weight", 9).alias("weight"))


def cov_topk_biased(spark, d):
    limits = cv.integer_limits(cv.bias_weights(_density(spark, d), "inverse", 1.0), 1.5)
    return cv.top_k_by_cell(orders_cells(spark, d), limits, _best()).select("id", cv.CELL)


def cov_candidates_with_buffer(spark, d):
    return cv.top_k(orders_cells(spark, d), 2 + 10, _best()).select("id", cv.CELL, F.col(cv.RANK).alias("rank"))


def _two_best(spark, d) -> DataFrame:
    return cv.top_k(orders_cells(spark, d), 2, _best()).drop(cv.RANK)


def cov_thresholds(spark, d):
    return cv.thresholds(_two_best(spark, d), False)


def cov_remainder(spark, d):
    cuts = materialize(cov_thresholds(spark, d))
    return cv.remainder(orders_cells(spark, d), cuts, False, cuts.count()).select("id", cv.CELL)


_PROFILES = ("constant", "linear", "exp", "log")


def k_profile(spark, d):
    rows = [(m, i, round(cv.profile(m, 1.5, i, 3.0), 9)) for m in _PROFILES for i in range(1, 12)]
    return spark.createDataFrame(rows, "density_mode string, depth int, k double")


def k_total_cap(spark, d):
    n = orders_cells(spark, d).select(cv.CELL).distinct().count()
    a = Algorithm(level_limit=LEVELS, targets_total_per_level={2: 1000, 4: 0, 5: 2000}, k_per_cov_per_level={3: 7.5})
    return spark.createDataFrame([(i, n, round(cv.rows_per_cell(a, i, n), 9)) for i in range(1, LEVELS + 1)], "depth int, n_cells long, k double")


def _fractional(spark, d, mode, logic, k=1.4):
    chosen = cv.top_k(orders_cells(spark, d), cv.whole_k(k), _best()).drop(cv.RANK)
    return cv.fractional(chosen, k, mode, logic, _best(), F.col("id"), SEED).select("id", cv.CELL)


def frac_score_local(spark, d):
    return _fractional(spark, d, "score", "local")


def frac_score_global(spark, d):
    return _fractional(spark, d, "score", "global")


def frac_random_local(spark, d):
    return _fractional(spark, d, "random", "local", 2.3)


def frac_random_global(spark, d):
    return _fractional(spark, d, "random", "global")


def _dirty(spark, d) -> DataFrame:
    """dp1_objects with its cells and its score: ties, missing and infinite scores, missing positions, rows without a cell."""
    score = finite_or_null(F.col("i_cmodelmag_dered"))
    return _read(spark, d, "dp1_objects").select("record_id", "coord_ra", "coord_dec", cv.CELL, score.alias(cv.SCORE))


def _dirty_hierarchy(spark, d, **algorithm) -> DataFrame:
    a = replace(Algorithm(level_limit=4), **algorithm)
    chosen = cv.select_hierarchy(_dirty(spark, d), cv.Selection(a, ("coord_ra", "coord_dec", "record_id"), "record_id", None))
    return chosen.select("record_id", "depth")


def hierarchy_ties_reference(spark, d):
    """The default: rows tied with a cut are lost, rows with missing scores may come again."""
    return _dirty_hierarchy(spark, d)


def hierarchy_ties_descending(spark, d):
    return _dirty_hierarchy(spark, d, order_desc=True, density_mode="linear")


def hierarchy_ties_keep(spark, d):
    return _dirty_hierarchy(spark, d, tie_policy="keep", k_per_cov_per_level={3: 5.0})


def hierarchy_fraction_local(spark, d):
    """Half a row a cell and depth, drawn afresh at each depth."""
    return _dirty_hierarchy(spark, d, tie_policy="keep", density_mode="constant", k_per_cov_initial=0.5, fractional_mode_logic="local", seed=SEED)


def hierarchy_fraction_global(spark, d):
    """A fraction settled over all cells, depth by depth."""
    return _dirty_hierarchy(spark, d, density_mode="constant", k_per_cov_initial=1.4, fractional_mode_logic="global")


def hierarchy_total_profile(spark, d):
    """Totals shared out among the cells that are left."""
    return _dirty_hierarchy(spark, d, density_mode="linear", targets_total_initial=3000.0, fractional_mode_logic="global")


def hierarchy_total_caps(spark, d):
    return _dirty_hierarchy(spark, d, targets_total_per_level={2: 500, 4: 700}, fractional_mode_logic="global")


def hats_index_pixels(spark, d):
    """Upper orders from a HATS index by shifting, without positions."""
    indexed = orders_sky(spark, d, 11).withColumnRenamed("deep", "_healpix_11")
    name, order = hats_index_order(indexed)
    return indexed.select("id", *[parent(F.col(name), order - o).alias(f"ipix{o}") for o in (1, 5, 9)])


def moc_numbers(spark, d):
    """The numbers the coverage map's file holds."""
    return moc_compacted(spark, d).selectExpr("shiftleft(4L, 2 * depth) + ipix AS uniq")


def _text_round(spark, d, kind: str, header: bool) -> DataFrame:
    """supplier written as text files and read back as a catalogue."""
    path = scratch_path(spark)
    table = _read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    table.write.option("sep", "\t" if kind == "tsv" else ",").option("header", header).csv(path)
    given = {"input": {"paths": [path if "://" in path else "file://" + path], "format": kind, "header": header}, "columns": {"ra": "-", "dec": "-", "score": "-"}, "algorithm": {"level_limit": LEVELS}, "cluster": {}, "output": {"out_dir": "-", "cat_name": "-"}}
    return read_catalog(spark, config_from_mapping(given)).toDF(*table.columns)


def scan_csv(spark, d):
    return _text_round(spark, d, "csv", True)


def scan_tsv(spark, d):
    return _text_round(spark, d, "tsv", True)


def scan_headerless(spark, d):
    return _text_round(spark, d, "csv", False)


def scan_hats(spark, d):
    """A HATS folder written from dp1_objects' partitions and read back."""
    path = scratch_path(spark)
    table = _read(spark, d, "dp1_objects").select("record_id", F.col("norder").alias("Norder"), F.lit(0).alias("Dir"), F.col("npix").alias("Npix"))
    table.repartition("Norder", "Npix").write.partitionBy("Norder", "Dir", "Npix").parquet(f"{path}/dataset")
    return read_hats(spark, path).select("record_id", F.col("Norder").alias("norder"), F.col("Npix").alias("npix"))


def _hierarchy(spark, d, rows: DataFrame, **algorithm) -> DataFrame:
    a = replace(Algorithm(level_limit=LEVELS, level_coverage=CELL_ORDER, coverage_order=CELL_ORDER), **algorithm)
    chosen = cv.select_hierarchy(rows, cv.Selection(a, TIES, "id", _density(spark, d)))
    return chosen.withColumn("ipix", F.expr(f"shiftright(deep, 2 * ({DEEPEST} - depth))"))


def _whole(spark, d) -> DataFrame:
    return _hierarchy(spark, d, orders_cells(spark, d), tie_policy="keep")


def coverage_hierarchy(spark, d):
    return _whole(spark, d).select("id", "depth", "ipix")


def coverage_hierarchy_loop(spark, d):
    """Depth by depth, as with ties, totals or bias, on scores without ties."""
    unique = materialize(orders_cells(spark, d).withColumn(cv.SCORE, F.col("id").cast("double") * -1))
    return _hierarchy(spark, d, unique, k_per_cov_per_level={2: 3.0}, tie_policy="reference").select("id", "depth")


def hats_partition_coverage(spark, d):
    o = _read(spark, d, "dp1_objects").select("record_id", "coord_ra", "coord_dec", "norder", "npix", finite_or_null(F.col("i_cmodelmag_dered")).alias(cv.SCORE))
    ordinals = materialize(hats_ordinals(_read(spark, d, "partition_info"), "norder", "npix"))
    cells = o.join(bounded(ordinals, ordinals.count()), ["norder", "npix"]).withColumnRenamed("ordinal", cv.CELL)
    return cv.top_k(cells, 2, cv.best_first(("coord_ra", "coord_dec", "record_id"), False)).select("record_id", F.col(cv.CELL).alias("ordinal"))


def tile_completeness(spark, d):
    written = _whole(spark, d).groupBy("depth", "ipix").agg(F.count(F.lit(1)).alias("n_written"))
    counts = densmap_all(spark, d).withColumnRenamed("n", "n_src")
    return written.join(counts, ["depth", "ipix"]).withColumn("n_remaining", F.greatest(F.lit(0).cast("long"), F.col("n_src") - F.col("n_written")))


def tile_rows_sanitised(spark, d):
    return _read(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("text"))


def allsky_rows(spark, d):
    return _whole(spark, d).where(F.col("depth").isin(*ALLSKY_ORDERS)).select("depth", "ipix", "id")


def tile_paths(spark, d):
    return _whole(spark, d).select(tile_path_column(F.col("depth"), F.col("ipix")).alias("path")).distinct()


def column_reports(spark, d):
    r = column_report(_read(spark, d, "dp1_objects").drop("obs_ts", "ingest_ts"))
    return r.where("example IS NULL").select("column", "n_null", "min", "max")


def column_reports_whole(spark, d):
    """Every column, and every part of the report; of an example, which may be any value, whether there is one."""
    r = column_report(_read(spark, d, "dp1_objects"))
    mean = F.format_string("%.9e", "mean")
    return r.select("column", "type", "n_null", "min", "max", F.when(F.col("mean").isNotNull(), mean).cast("double").alias("mean"), F.col("example").isNotNull().alias("shown"))


def best_of_cells(spark, d):
    """The best-scoring order of each cell at order 2, with the cell's count."""
    o = orders_sky(spark, d).withColumn(cv.CELL, parent(F.col("deep"), DEEPEST - 2))
    counts = density_maps(o, cv.CELL, 2).where(F.col("depth") == 2).select(F.col("ipix").alias(cv.CELL), F.col("n").alias("n_cell"))
    return cv.top_k(o, 1, _best()).join(counts, cv.CELL).select(cv.CELL, "id", F.col(cv.SCORE).alias("score"), "n_cell")


QUERIES = {
    f.__name__: f
    for f in (
        best_of_cells,
        ipix_orders,
        densmap_all,
        densmap_stats,
        moc_cells,
        moc_compacted,
        radec_extrema,
        ra_shift,
        keep_projection,
        score_expressions,
        mag_coerce_window,
        mag_extrema,
        mag_histogram,
        mag_cdf_edges,
        mag_auto_max,
        mag_depth_weights,
        mag_slices,
        cov_topk,
        cov_topk_objects,
        cov_topk_desc,
        cov_topk_biased,
        cov_candidates_with_buffer,
        cov_thresholds,
        cov_remainder,
        k_profile,
        k_total_cap,
        bias_weights,
        frac_score_local,
        frac_score_global,
        frac_random_local,
        frac_random_global,
        coverage_hierarchy,
        coverage_hierarchy_loop,
        hats_partition_coverage,
        tile_completeness,
        tile_rows_sanitised,
        allsky_rows,
        tile_paths,
        column_reports,
        column_reports_whole,
        hierarchy_ties_reference,
        hierarchy_ties_descending,
        hierarchy_ties_keep,
        hierarchy_fraction_local,
        hierarchy_fraction_global,
        hierarchy_total_profile,
        hierarchy_total_caps,
        hats_index_pixels,
        moc_numbers,
        scan_csv,
        scan_tsv,
        scan_headerless,
        scan_hats,
    )
}
