"""A whole run: catalogue in, tile hierarchy out.

The input is prepared lazily (positions, deepest pixel, cell, score): the density maps read its positions, the selection reads the kept columns
and writes only rows that may be chosen, and executors write the tiles. Text input is parsed once and written to the shared folder. The driver sees scalars, histograms of at most
``mag_hist_nbins`` bins, one row per file written (counted, not collected), and the compact coverage map.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.config import Config, check_for_run
from skyloom.functions.healpix import parent, with_pixel
from skyloom.functions.numeric import as_double, column, finite_or_null
from skyloom.functions.score import score_expression
from skyloom.operators import magnitude as mg
from skyloom.operators.clean import normalise_positions
from skyloom.operators.coverage import CELL, SCORE, Selection, best_first, select_hierarchy
from skyloom.operators.densmap import compact_cells, coverage_cells, density_maps, density_stats
from skyloom.runtime import GROUP_LIMITS, bounded, materialize, scratch, settings, settled
from skyloom.sinks.fits import write_density_map
from skyloom.sinks.metadata import RunLog, arguments, now, properties, write_coverage_map, write_votables
from skyloom.sinks.store import Store, absolute
from skyloom.sinks.tiles import ALLSKY_ORDERS, write_allsky, write_tiles
from skyloom.sources.catalog import Roles, find_hats_root, hats_index_order, read_catalog, roles

DEEP, ROW = "__deep__", "__row__"


@dataclass(frozen=True)
class Prepared:
    rows: DataFrame  # kept columns, __deep__, __icov__, __score__, __row__, and __mag__ in mag_global
    roles: Roles
    order: int  # order of __deep__


@dataclass(frozen=True)
class RunResult:
    n_rows: int
    n_written: dict[int, int]  # by depth
    n_tiles: dict[int, int]
    mag_range: tuple[float, float] | None = None
    edges: tuple[float, ...] = ()


@contextmanager
def _step(spark: SparkSession, config: Config, name: str):
    """Names Spark's jobs after the run's step."""
    if config.cluster.diagnostics_mode == "off":
        yield
        return
    spark.sparkContext.setJobDescription(f"{config.output.cat_name}: {name}" if config.cluster.diagnostics_mode == "per_step" else config.output.cat_name)
    try:
        yield
    finally:
        spark.sparkContext.setJobDescription(None)


def hats_ordinals(rows: DataFrame, norder: str, npix: str) -> DataFrame:
    """(norder, npix, ordinal) of the partitions, numbered by order and pixel (a few thousand rows at most: one per file of the catalogue)."""
    # numbered in one task: as many rows as the catalogue has partitions
    return rows.select(norder, npix).distinct().withColumn("ordinal", (F.row_number().over(Window.orderBy(norder, npix)) - 1).cast("long"))


def prepare(spark: SparkSession, config: Config) -> Prepared:
    """Read, check and project the input. Raises what roles() and normalise_positions() raise."""
    a = config.algorithm
    source = read_catalog(spark, config)
    r = roles(source, config)
    index = hats_index_order(source) if config.input.format.lower() == "hats" else None
    keys = ["Norder", "Npix"] if a.use_hats_as_coverage else []
    rows = source.select(*[column(c) for c in dict.fromkeys([*r.keep, *([index[0]] if index else []), *keys])])
    rows = normalise_positions(rows, r.ra, r.dec)
    order = max(a.level_limit, a.coverage_order)
    if index and index[1] >= order:
        rows = rows.withColumn(DEEP, parent(column(index[0]), index[1] - order))
    else:
        rows = with_pixel(rows, as_double(rows, r.ra), as_double(rows, r.dec), order, DEEP)
    if a.use_hats_as_coverage:
        ordinals = materialize(hats_ordinals(source, "Norder", "Npix").select(F.col("Norder").alias("_o"), F.col("Npix").alias("_p"), F.col("ordinal").alias(CELL)))
        rows = rows.join(bounded(ordinals, ordinals.count()), (F.col("Norder") == F.col("_o")) & (F.col("Npix") == F.col("_p")), "left").drop("_o", "_p")
    else:
        rows = rows.withColumn(CELL, parent(F.col(DEEP), order - a.coverage_order))
    available = list(r.keep)
    score = finite_or_null(score_expression(r.score, lambda c: as_double(rows, c), available)) if a.selection_mode != "mag_global" else F.lit(None).cast("double")
    rows = rows.withColumn(SCORE, score)
    extra = [DEEP, CELL, SCORE]
    if a.selection_mode == "mag_global":
        if not r.mag:
            raise ValueError("mag_global needs algorithm.mag_column")
        rows = rows.withColumn(mg.MAG, as_double(rows, r.mag))
        extra.append(mg.MAG)
    # the row's content decides its place among equals: the same on every layout
    content = F.xxhash64(*[F.to_json(column(c)) if "map<" in rows.schema[c].dataType.simpleString() else column(c) for c in r.keep])
    rows = rows.select(*[column(c) for c in r.keep], *extra, content.alias("__content__"), F.monotonically_increasing_id().alias(ROW))
    return Prepared(rows.persist() if config.cluster.persist_ddfs else rows, r, order)


def _magnitude_window(p: Prepared, config: Config) -> tuple[float, float]:
    a = config.algorithm
    e = mg.magnitude_extrema(p.rows).first()
    low, most = mg.bounds(e.mag_low, e.mag_high, a.mag_min, a.mag_max)
    if a.mag_max is not None:
        high = float(a.mag_max)
    else:
        counts = mg.histogram_counts(mg.magnitude_histogram(p.rows, low, most, a.mag_hist_nbins), a.mag_hist_nbins)
        if not counts.sum():
            raise ValueError("no magnitude lies in the automatic range")
        high = mg.peak_magnitude(counts, mg.bin_edges(low, most, a.mag_hist_nbins), most)
    if low >= high:
        raise ValueError(f"mag_min {low} is not below mag_max {high}")
    return low, high


def _magnitude_selection(p: Prepared, rows: DataFrame, stats: dict[int, int], config: Config, window: tuple[float, float]) -> tuple[DataFrame | None, tuple[float, ...]]:
    a = config.algorithm
    edges = mg.bin_edges(*window, a.mag_hist_nbins)
    counts = mg.histogram_counts(mg.magnitude_histogram(rows, *window, a.mag_hist_nbins), a.mag_hist_nbins)
    total = int(counts.sum())
    if not total:
        return None, ()
    targets = mg.depth_targets(total, [stats.get(d, 0) for d in range(1, a.level_limit + 1)], [a.n_1, a.n_2, a.n_3])
    cuts = mg.slice_edges(counts, edges, targets)
    return rows.withColumn("depth", mg.slice_depth(F.col(mg.MAG), cuts)).where(F.col("depth").isNotNull()), tuple(cuts)


def _by_depth(df: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    rows = df.groupBy("depth").agg(F.sum("n_written").alias("rows"), F.count(F.lit(1)).alias("files")).collect()  # at most 11 rows
    return {r["depth"]: r["rows"] for r in rows}, {r["depth"]: r["files"] for r in rows}


def run(spark: SparkSession, config: Config) -> RunResult:
    """Build the hierarchy described by ``config`` under its output folder, which may be a URI (see sinks.store)."""
    config = check_for_run(config)
    store = Store(config.output.out_dir)
    store.make_folder()
    with scratch(), settings(spark, GROUP_LIMITS):
        return _run(spark, config, store)


def _run(spark: SparkSession, config: Config, store: Store) -> RunResult:
    a, root = config.algorithm, absolute(config.output.out_dir)
    log = RunLog(store)
    log(f"start: {a.selection_mode}, orders 1 to {a.level_limit}")
    if config.input.format.lower() != "hats" and any(find_hats_root(path, spark) for path in config.input.paths):
        log("the input lies in a HATS catalogue; format hats would use its partitions")
    with _step(spark, config, "prepare"):
        p = prepare(spark, config)
    window = None
    rows = p.rows
    if a.selection_mode == "mag_global":
        with _step(spark, config, "magnitude range"):
            window = _magnitude_window(p, config)
        rows = mg.in_window(rows, *window)
    with _step(spark, config, "density maps"):
        limit = rows.withColumn("_limit", parent(F.col(DEEP), p.order - a.level_limit))
        maps = materialize(density_maps(limit, "_limit", a.level_limit))
        stats = {r["depth"]: (r["n_total"], r["n_pixels"]) for r in density_stats(maps).collect()}  # one row an order
    n_rows = stats.get(0, (0, 0))[0]
    log(f"{n_rows} rows; pixels by order: {({d: s[1] for d, s in sorted(stats.items())})}")
    with _step(spark, config, "metadata"):
        for depth in range(a.level_limit + 1):
            write_density_map(maps, depth, store)
        write_coverage_map(compact_cells(coverage_cells(maps, a.level_coverage), a.level_coverage), a.level_coverage, store)
        write_votables(p.rows.schema, p.roles.keep, p.roles.ra, p.roles.dec, store)
        store.write_text("properties", properties(config.output, a.level_limit, n_rows, now()))
        store.write_text("arguments", arguments(config, {"mag_min": window[0], "mag_max": window[1]} if window else {}))
    edges: tuple[float, ...] = ()
    order: list[Column] = [F.col(ROW)]

    def with_tile(chosen: DataFrame) -> DataFrame:
        return chosen.withColumn("ipix", F.expr(f"shiftright({DEEP}, 2 * ({p.order} - depth))"))

    with _step(spark, config, "select"):
        if a.selection_mode == "mag_global":
            selected, edges = _magnitude_selection(p, rows, {d: s[1] for d, s in stats.items()}, config, window)
            if edges:
                log(f"magnitude edges: {', '.join(f'{e:.6f}' for e in edges)}")
        else:
            ties = (p.roles.ra, p.roles.dec, "__content__", ROW)
            order = [F.col(CELL), *best_first(ties, a.order_desc)]
            density = None
            if a.density_bias_mode in ("proportional", "inverse") and a.coverage_order <= a.level_limit and not a.use_hats_as_coverage:
                density = maps.where(F.col("depth") == a.coverage_order).select(F.col("ipix").alias(CELL), "n")
            # random choices go by the row's content, so that they are the same on every layout
            how = Selection(a, ties, "__content__", density, ROW)
            selected = settled(lambda: with_tile(select_hierarchy(p.rows, how, lambda d, k, cells, n: log(f"depth {d}: k {k:g}{f', {cells} cells' if cells else ''}, {n} rows chosen"))))
        if selected is None:
            log("nothing to select")
            return RunResult(n_rows, {}, {}, window, edges)
        if a.selection_mode == "mag_global":
            selected = materialize(with_tile(selected))
    with _step(spark, config, "write tiles"):
        written, tiles = _by_depth(materialize(write_tiles(selected, maps, p.roles.keep, order, root)))
        allsky = {d: stats[d][0] for d in ALLSKY_ORDERS if d in stats}
        materialize(write_allsky(selected, allsky, p.roles.keep, order, root))
    if config.cluster.persist_ddfs:
        p.rows.unpersist()
    left = n_rows
    for d in range(1, a.level_limit + 1):
        start, left = left, left - written.get(d, 0)
        log(f"depth {d}: {start} rows to choose from, {written.get(d, 0)} written in {tiles.get(d, 0)} tiles, {left} remaining")
    log("done")
    return RunResult(n_rows, written, tiles, window, edges)


def run_with(spark: SparkSession, config: Config, **algorithm) -> RunResult:
    """``run`` with some algorithm options replaced."""
    return run(spark, replace(config, algorithm=replace(config.algorithm, **algorithm)))
