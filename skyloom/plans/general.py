"""Queries and SQL of the general problems: near points, heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.operators.eager import eager_join_aggregate, heavy_keys
from skyloom.operators.spatial import pairs_within


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs_within(spark.read.parquet(f"{d}/des_sources.parquet"), "coadd_object_id", "ra", "dec", 2.0)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    objects, partitions = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("dp1_objects", "partition_info"))
    return heavy_keys(objects, partitions, "__icov__", "norder", "npix", 8)


def p5_partition_totals(spark: SparkSession, d: str) -> DataFrame:
    objects, partitions = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("dp1_objects", "partition_info"))
    return eager_join_aggregate(objects, partitions, ["norder", "npix"], ["norder", "npix"], {"tract": "tract"}, {"order": "norder"})


def p5_cell_totals(spark: SparkSession, d: str) -> DataFrame:
    objects, partitions = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("dp1_objects", "partition_info"))
    return eager_join_aggregate(objects, partitions, ["norder", "npix"], ["__icov__"], {"tract": "tract"}, {"order": "norder"})


QUERIES = {f.__name__: f for f in (p4_found, p5_found, p5_partition_totals, p5_cell_totals)}

_TOTALS = """
SELECT {keys}, count(*) AS n_rows, CAST(sum(o.tract) AS DOUBLE) AS sum_tract, count(o.tract) AS cnt_tract,
       CAST(sum(p.norder) AS DOUBLE) AS sum_order, count(p.norder) AS cnt_order
FROM dp1_objects o JOIN partition_info p ON o.norder = p.norder AND o.npix = p.npix GROUP BY {by}"""

SQL = {
    "p5_found": """
WITH a AS (SELECT count(*) AS n FROM dp1_objects)
SELECT 'icov' AS key_name, CAST(8 AS INTEGER) AS norder, __icov__ AS key_value FROM dp1_objects WHERE __icov__ >= 0
GROUP BY __icov__ HAVING count(*) * 100 >= (SELECT n FROM a)
UNION ALL
SELECT 'npix', norder, npix FROM dp1_objects GROUP BY norder, npix HAVING count(*) * 20 >= (SELECT n FROM a)""",
    "p5_partition_totals": _TOTALS.format(keys="o.norder, o.npix", by="o.norder, o.npix"),
    "p5_cell_totals": _TOTALS.format(keys="o.__icov__", by="o.__icov__"),
    # neighbours by rounded unit vectors: a chord test on a 3-D grid, nothing in common with the strips
    "p4_found": """
WITH p AS (SELECT DISTINCT coadd_object_id AS id, ra, dec FROM des_sources
           WHERE isfinite(ra) AND isfinite(dec) AND dec BETWEEN -90 AND 90),
v AS (SELECT id, cos(radians(dec)) * cos(radians(ra)) AS x, cos(radians(dec)) * sin(radians(ra)) AS y, sin(radians(dec)) AS z FROM p),
g AS (SELECT *, CAST(floor(x / 1e-5) AS BIGINT) AS i, CAST(floor(y / 1e-5) AS BIGINT) AS j, CAST(floor(z / 1e-5) AS BIGINT) AS k FROM v),
o AS (SELECT * FROM (VALUES (-1), (0), (1)) a(di), (VALUES (-1), (0), (1)) b(dj), (VALUES (-1), (0), (1)) c(dk)),
h AS (SELECT id, x, y, z, i + di AS i, j + dj AS j, k + dk AS k FROM g, o)
SELECT DISTINCT g.id AS id_a, h.id AS id_b
FROM g JOIN h ON g.i = h.i AND g.j = h.j AND g.k = h.k AND g.id < h.id
WHERE (g.x - h.x) * (g.x - h.x) + (g.y - h.y) * (g.y - h.y) + (g.z - h.z) * (g.z - h.z) <= pow(2 * sin(radians(2.0 / 3600) / 2), 2)""",
}
