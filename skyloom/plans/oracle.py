"""SQL for the catalogue queries, written without the engine's operators: counting queries instead of windows where that is possible."""

from __future__ import annotations

_D = "CAST({} AS DOUBLE)"


def placed(select: str, table: str, key: str, order: int) -> str:
    """CTEs ending in ``p``: ``select`` columns of ``table``, ra, dec and the NESTED pixel ``pix`` at ``order``, one step each."""
    n = 1 << order
    spread = []
    before = "f"
    for i, (s, m) in enumerate(((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))):
        spread.append(f"i{i} AS (SELECT * EXCLUDE (x, y), (x | (x << {s})) & {m} AS x, (y | (y << {s})) & {m} AS y FROM {before})")
        before = f"i{i}"
    return f"""
WITH s AS (SELECT {select}, (({key} * 2654435761) % 3600000) / {_D.format("10000.0")} + {_D.format("0.00003")} AS ra,
           (({key} * 40503 + 17) % 1799998) / {_D.format("10000.0")} - {_D.format("89.99993")} AS dec FROM {table}),
z AS (SELECT *, cos(radians(90 - dec)) AS z, sin(radians(90 - dec)) AS sn, (radians(ra) / (pi() / 2)) % 4 AS t FROM s),
j AS (SELECT *, CAST(floor({n} * (0.5::DOUBLE + t) - {n} * z * 0.75::DOUBLE) AS BIGINT) AS jp, CAST(floor({n} * (0.5::DOUBLE + t) + {n} * z * 0.75::DOUBLE) AS BIGINT) AS jm,
      least(3, CAST(floor(t) AS BIGINT)) AS q,
      CASE WHEN abs(z) > 0.99995 THEN {n} * sn / sqrt((1 + abs(z)) / 3) ELSE {n} * sqrt(3 * (1 - abs(z))) END AS r FROM z),
c AS (SELECT *, least({n - 1}, CAST(floor((t - q) * r) AS BIGINT)) AS a, least({n - 1}, CAST(floor((1 - (t - q)) * r) AS BIGINT)) AS b,
      jp >> {order} AS fp, jm >> {order} AS fm FROM j),
f AS (SELECT *, CASE WHEN abs(z) <= 2.0::DOUBLE / 3 THEN CASE WHEN fp = fm THEN fp % 4 + 4 WHEN fp < fm THEN fp % 4 ELSE fm % 4 + 8 END WHEN z > 0 THEN q ELSE q + 8 END AS face,
      CASE WHEN abs(z) <= 2.0::DOUBLE / 3 THEN jm & {n - 1} WHEN z > 0 THEN {n - 1} - b ELSE a END AS x,
      CASE WHEN abs(z) <= 2.0::DOUBLE / 3 THEN {n - 1} - (jp & {n - 1}) WHEN z > 0 THEN {n - 1} - a ELSE b END AS y FROM c),
{", ".join(spread)},
p AS (SELECT * EXCLUDE (z, sn, t, jp, jm, q, r, a, b, fp, fm, face, x, y), face * {n * n} + x + (y << 1) AS pix FROM {before})"""


_ORDERS = placed("o_orderkey AS id, o_custkey, o_totalprice AS score", "orders", "o_orderkey", 8)
_CELLS = _ORDERS + ", o AS (SELECT *, pix >> 10 AS cell FROM p)"
_RANKED = _CELLS + ", k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY score, ra, dec, id) AS rank, count(*) OVER (PARTITION BY cell) AS n_cell FROM o)"
_EVENTS = placed("event_id, value / 20 AS mag", "events", "event_id", 8)
_LOW, _HIGH, _BINS = 1.0, 20.0, 64
_DEPTHS = "g AS (SELECT unnest(range(0, 9)) AS depth)"
_MAPS = _ORDERS + f", {_DEPTHS}, m AS (SELECT g.depth, p.pix >> (2 * (8 - g.depth)) AS ipix, count(*) AS n FROM p, g GROUP BY ALL)"
_FINITE = "CASE WHEN isfinite(i_cmodelmag_dered) THEN i_cmodelmag_dered END"
_WIDTH = f"(({_HIGH} - {_LOW})::DOUBLE / {_BINS})"
# the bin of a magnitude, by counting the edges at or below it
_HIST = (
    _EVENTS
    + f""", w AS (SELECT * FROM p WHERE mag BETWEEN {_LOW} AND {_HIGH}),
edges AS (SELECT i, {_LOW}::DOUBLE + i * {_WIDTH} AS e FROM range(0, {_BINS}) t(i)),
h AS (SELECT v.bin, sum(v.c)::BIGINT AS n FROM (SELECT (SELECT max(i) FROM edges WHERE e <= d.mag) AS bin, d.c FROM (SELECT mag, count(*) AS c FROM w GROUP BY mag) d) v GROUP BY 1)"""
)
_WEIGHTS = ", wt AS (SELECT g.depth, count(DISTINCT w.pix >> (2 * (8 - g.depth))) AS weight FROM w, (SELECT unnest(range(1, 6)) AS depth) g GROUP BY 1)"
_EDGES = (
    _HIST
    + _WEIGHTS
    + f""", tot AS (SELECT count(*)::DOUBLE AS n FROM w),
free AS (SELECT sum(weight)::DOUBLE AS f FROM wt WHERE depth > 1),
tg AS (SELECT depth, CASE WHEN depth = 1 THEN least(500, n) ELSE (n - least(500, n)) * (weight::DOUBLE / f) END AS t FROM wt, tot, free),
q AS (SELECT depth, sum(t) OVER (ORDER BY depth) / n AS q FROM tg, tot),
full_h AS (SELECT e.i, e.e, coalesce(h.n, 0) AS n FROM edges e LEFT JOIN h ON h.bin = e.i),
cdf AS (SELECT i, e, sum(full_h.n) OVER (ORDER BY i) / tot.n AS c FROM full_h, tot),
cut AS (SELECT 0 AS i, {_LOW}::DOUBLE AS edge UNION ALL SELECT 5, {_HIGH}::DOUBLE
        UNION ALL SELECT depth, (SELECT min(e) FROM cdf WHERE c >= q.q) FROM q WHERE depth < 5)"""
)


def philox(key: int, table: str, counter: str, tag: str) -> str:
    """CTEs ending in ``tag(c, u)``: the Philox 2x32-10 number in [0, 1) of each different counter of ``table``, in 128-bit integers."""
    steps = [f"{tag}0 AS (SELECT DISTINCT {counter} AS c, CAST({counter} AS HUGEINT) & 4294967295 AS a, (CAST({counter} AS HUGEINT) >> 32) & 4294967295 AS b FROM {table})"]
    for i in range(10):
        steps.append(f"{tag}{i + 1} AS (SELECT c, xor(xor((a * 3528905107) >> 32, b), CAST({key} AS HUGEINT)) AS a, (a * 3528905107) & 4294967295 AS b FROM {tag}{i})")
        key = (key + 2654435769) % 4294967296
    return ", ".join(steps) + f", {tag} AS (SELECT c, CAST(a AS DOUBLE) / 4294967296.0::DOUBLE AS u FROM {tag}10)"


def _depth_key(seed: int, depth: int) -> int:
    return (seed + depth * 2246822519) % 4294967296


def _fraction(k: float, random: bool) -> str:
    order = "u, score, ra, dec, id" if random else "score, ra, dec, id"
    return (
        _RANKED
        + f""", t0 AS (SELECT * FROM k WHERE rank <= ceil({k})), {philox(12345, "t0", "id", "ru")}, {philox(12345, "t0", "cell", "cu")},
t AS (SELECT t0.*, ru.u AS u, cu.u AS uc FROM t0 JOIN ru ON t0.id = ru.c JOIN cu ON t0.cell = cu.c),
a AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {order}) AS at_, count(*) OVER (PARTITION BY cell) AS n FROM t)
SELECT id, cell AS __icov__ FROM a
WHERE at_ <= floor(least({k}::DOUBLE, n)) + CASE WHEN uc < least({k}::DOUBLE, n) - floor(least({k}::DOUBLE, n)) THEN 1 ELSE 0 END"""
    )


def _fraction_all(k: float, random: bool) -> str:
    order = "u, score, ra, dec, id" if random else "score, ra, dec, id"
    return (
        _RANKED
        + f""", t0 AS (SELECT * FROM k WHERE rank <= ceil({k})), {philox(12345, "t0", "id", "ru")},
t AS (SELECT t0.*, ru.u AS u FROM t0 JOIN ru ON t0.id = ru.c),
n AS (SELECT CAST(round_even({k} * count(DISTINCT cell), 0) AS BIGINT) AS n FROM t),
a AS (SELECT *, row_number() OVER (ORDER BY {order}) AS at_ FROM t)
SELECT id, cell AS __icov__ FROM a, n WHERE at_ <= n.n"""
    )


def _depths(wanted: str, levels: int = 4, descending: bool = False, overall: bool = False) -> str:
    """The loop over depths, one after the other, on dp1_objects: ``wanted`` is k at depth {d} with {n} cells left; rows tied with a cut are lost.

    ``overall``: of the cells' ceil(k) best rows the round_even(k * cells) best of all.
    """
    by = f"s {'DESC' if descending else ''} NULLS LAST, coord_ra NULLS LAST, coord_dec NULLS LAST, record_id"
    cut, worse = ("min(s)", "r.s < c.cut") if descending else ("max(s)", "r.s > c.cut")
    steps = [f"r0 AS (SELECT record_id, __icov__ AS cell, coord_ra, coord_dec, {_FINITE} AS s FROM dp1_objects WHERE __icov__ IS NOT NULL)"]
    for d in range(1, levels + 1):
        k = wanted.format(d=d, n=f"(SELECT count(DISTINCT cell) FROM r{d - 1})")
        steps.append(f"k{d} AS (SELECT ({k})::DOUBLE AS k)")
        best = f"q{d} AS (SELECT r{d - 1}.* FROM r{d - 1}, k{d} QUALIFY row_number() OVER (PARTITION BY cell ORDER BY {by}) <= greatest(1, ceil(k)))"
        steps.append(best)
        if overall:
            steps.append(f"p{d} AS (SELECT * FROM q{d} QUALIFY row_number() OVER (ORDER BY {by}) <= (SELECT round_even((SELECT k FROM k{d}) * count(DISTINCT cell), 0) FROM q{d}))")
        else:
            steps.append(f"p{d} AS (SELECT * FROM q{d})")
        steps.append(f"c{d} AS (SELECT cell, {cut} AS cut FROM p{d} GROUP BY cell)")
        steps.append(f"r{d} AS (SELECT r.* FROM r{d - 1} r LEFT JOIN c{d} c ON r.cell = c.cell WHERE c.cell IS NULL OR (c.cut IS NOT NULL AND (r.s IS NULL OR {worse})))")
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT record_id, CAST({d} AS INTEGER) AS depth FROM p{d}" for d in range(1, levels + 1))


def _depths_kept(sums: tuple[int, ...]) -> str:
    case = " ".join(f"WHEN rank <= {n} THEN {d}" for d, n in enumerate(sums, 1))
    return f"""
WITH r AS (SELECT record_id, row_number() OVER (PARTITION BY __icov__ ORDER BY {_FINITE} NULLS LAST, coord_ra NULLS LAST, coord_dec NULLS LAST, record_id) AS rank
           FROM dp1_objects WHERE __icov__ IS NOT NULL)
SELECT record_id, CAST(CASE {case} END AS INTEGER) AS depth FROM r WHERE rank <= {sums[-1]}"""


def _half_a_row(levels: int = 4) -> str:
    """k = 0.5, every row not chosen stays: a cell's next best row comes at each depth whose draw is below one half."""
    draws = ", ".join(philox(_depth_key(12345, d), "r", "cell", f"u{d}_") for d in range(1, levels + 1))
    hit = " UNION ALL ".join(f"SELECT c AS cell, {d} AS depth FROM u{d}_ WHERE u < 0.5" for d in range(1, levels + 1))
    return f"""
WITH r AS (SELECT record_id, __icov__ AS cell, row_number() OVER (PARTITION BY __icov__ ORDER BY {_FINITE} NULLS LAST, coord_ra NULLS LAST, coord_dec NULLS LAST, record_id) AS rank
           FROM dp1_objects WHERE __icov__ IS NOT NULL), {draws},
h AS (SELECT cell, depth, row_number() OVER (PARTITION BY cell ORDER BY depth) AS turn FROM ({hit}))
SELECT r.record_id, CAST(h.depth AS INTEGER) AS depth FROM r JOIN h ON r.cell = h.cell AND r.rank = h.turn"""


_WHOLE = (
    _RANKED
    + """, w AS (SELECT *, CASE WHEN rank <= 1 THEN 1 WHEN rank <= 3 THEN 2 WHEN rank <= 7 THEN 3 WHEN rank <= 15 THEN 4 ELSE 5 END AS depth FROM k WHERE rank <= 31),
d AS (SELECT *, pix >> (2 * (8 - depth)) AS ipix FROM w)"""
)
_BIAS = _CELLS + ", n AS (SELECT cell, count(*) AS n FROM o GROUP BY 1), r AS (SELECT cell, pow(n + 1e-6::DOUBLE, {power}::DOUBLE) AS w FROM n), bw AS (SELECT cell, w / (SELECT avg(w) FROM r) AS weight FROM r)"
_NUMBERS = ("refextendedness", *[f"{b}_cmodelmag{e}_dered" for e in ("", "err") for b in "ugrizy"], "coord_ra", "coord_dec")
_INTEGERS = ("record_id", "objectid", "__icov__", "norder", "npix", "tract", "patch", "ingest_batch")
_FLAGS, _TIMES = ("detect_fromblend", "detect_isdeblendedmodelsource", "detect_isisolated"), ("obs_ts", "ingest_ts")

SQL = {
    "best_of_cells": _ORDERS
    + """, o AS (SELECT *, pix >> 12 AS cell FROM p)
SELECT cell AS __icov__, id, score, (SELECT count(*) FROM o b WHERE b.cell = a.cell) AS n_cell
FROM o a WHERE (score, ra, dec, id) = (SELECT min((score, ra, dec, id)) FROM o b WHERE b.cell = a.cell)""",
    "ipix_orders": placed("o_orderkey AS id", "orders", "o_orderkey", 11) + " SELECT id, pix >> 22 AS ipix0, pix >> 14 AS ipix4, pix >> 6 AS ipix8, pix AS ipix11 FROM p",
    "densmap_all": _MAPS + " SELECT CAST(depth AS INTEGER) AS depth, ipix, n FROM m",
    "densmap_stats": _MAPS + " SELECT CAST(depth AS INTEGER) AS depth, CAST(sum(n) AS BIGINT) AS n_total, count(*) AS n_pixels FROM m GROUP BY depth",
    "moc_cells": _ORDERS + " SELECT DISTINCT pix >> 4 AS ipix FROM p",
    "moc_compacted": _ORDERS
    + """, c5 AS (SELECT DISTINCT pix >> 6 AS i FROM p), c4 AS (SELECT i >> 2 AS i FROM c5 GROUP BY 1 HAVING count(*) = 4),
c3 AS (SELECT i >> 2 AS i FROM c4 GROUP BY 1 HAVING count(*) = 4), c2 AS (SELECT i >> 2 AS i FROM c3 GROUP BY 1 HAVING count(*) = 4),
c1 AS (SELECT i >> 2 AS i FROM c2 GROUP BY 1 HAVING count(*) = 4), c0 AS (SELECT i >> 2 AS i FROM c1 GROUP BY 1 HAVING count(*) = 4)
SELECT 5 AS depth, i AS ipix FROM c5 WHERE i >> 2 NOT IN (SELECT i FROM c4) UNION ALL SELECT 4, i FROM c4 WHERE i >> 2 NOT IN (SELECT i FROM c3)
UNION ALL SELECT 3, i FROM c3 WHERE i >> 2 NOT IN (SELECT i FROM c2) UNION ALL SELECT 2, i FROM c2 WHERE i >> 2 NOT IN (SELECT i FROM c1)
UNION ALL SELECT 1, i FROM c1 WHERE i >> 2 NOT IN (SELECT i FROM c0) UNION ALL SELECT 0, i FROM c0""",
    "radec_extrema": """
SELECT min(coord_ra) FILTER (NOT isnan(coord_ra)) AS ra_min, max(coord_ra) FILTER (NOT isnan(coord_ra)) AS ra_max,
       min(coord_dec) FILTER (NOT isnan(coord_dec)) AS dec_min, max(coord_dec) FILTER (NOT isnan(coord_dec)) AS dec_max,
       count(*) FILTER (coord_ra IS NULL OR isnan(coord_ra) OR coord_dec IS NULL OR isnan(coord_dec)) AS n_missing FROM dp1_objects""",
    "ra_shift": placed("c_custkey", "customer", "c_custkey", 0) + " SELECT c_custkey, CASE WHEN ra - 180 + 360 >= 360 THEN ra - 180 + 360 - 360 ELSE ra - 180 + 360 END AS ra FROM p",
    "keep_projection": placed("o_orderkey, o_totalprice, o_orderstatus", "orders", "o_orderkey", 0) + " SELECT o_orderkey, ra, dec, o_totalprice, o_orderstatus FROM p",
    "score_expressions": "SELECT o_orderkey, sqrt(o_totalprice) * 2 - o_custkey::DOUBLE / 7 + pow(o_custkey::DOUBLE % 5, 2) AS score FROM orders",
    "mag_coerce_window": "SELECT row_id, night, TRY_CAST(mag_r AS DOUBLE) AS __mag__ FROM tmpl_catalog WHERE TRY_CAST(mag_r AS DOUBLE) BETWEEN 15 AND 20",
    "mag_extrema": "SELECT min(value / 20) AS mag_low, max(value / 20) AS mag_high FROM events",
    "mag_histogram": _HIST + " SELECT CAST(bin AS INTEGER) AS bin, n FROM h",
    "mag_cdf_edges": _EDGES + " SELECT CAST(i AS INTEGER) AS i, edge FROM cut",
    "mag_auto_max": f"""
WITH v AS (SELECT value / 20 AS mag FROM events), b AS (SELECT greatest(min(mag), -2) AS lo, least(max(mag), 40) AS hi FROM v),
e AS (SELECT i, lo + i * ((hi - lo) / {_BINS}) AS e, lo, hi FROM range(0, {_BINS}) t(i), b),
h AS (SELECT (SELECT max(i) FROM e WHERE e.e <= d.mag) AS bin, d.c FROM (SELECT mag, count(*) AS c FROM v, b WHERE mag BETWEEN lo AND hi GROUP BY mag) d),
s AS (SELECT bin, sum(c) AS n FROM h GROUP BY 1),
best AS (SELECT min(bin) AS bin FROM s WHERE n = (SELECT max(n) FROM s))
SELECT lo AS mag_min, round(least((e.e + CASE WHEN i = {_BINS} - 1 THEN hi ELSE lo + (i + 1) * ((hi - lo) / {_BINS}) END) / 2, hi), 2) AS mag_max FROM e JOIN best ON e.i = best.bin""",
    "mag_depth_weights": _HIST + _WEIGHTS + " SELECT CAST(depth AS INTEGER) AS depth, weight FROM wt",
    "mag_slices": _EDGES
    + """, d AS (SELECT event_id, pix, mag, CASE WHEN mag >= (SELECT edge FROM cut WHERE i = 4) THEN 5 ELSE (SELECT min(i) FROM cut WHERE edge > mag) END AS depth FROM w)
SELECT event_id, CAST(depth AS INTEGER) AS depth, pix >> (2 * (8 - depth)) AS ipix FROM d""",
    "cov_topk": _RANKED + " SELECT id, cell AS __icov__, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 2",
    "cov_topk_objects": f"""
SELECT record_id, __icov__ FROM dp1_objects WHERE __icov__ IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY __icov__ ORDER BY {_FINITE} NULLS LAST, coord_ra NULLS LAST, coord_dec NULLS LAST, record_id) <= 3""",
    "cov_topk_desc": placed("c_custkey AS id, c_acctbal AS score", "customer", "c_custkey", 2)
    + " SELECT id, pix AS __icov__ FROM p QUALIFY row_number() OVER (PARTITION BY pix ORDER BY score DESC, ra, dec, id) <= 3",
    "cov_topk_biased": _BIAS.format(power=-1)
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY score, ra, dec, id) AS rank FROM o)
SELECT k.id, k.cell AS __icov__ FROM k JOIN bw ON k.cell = bw.cell WHERE k.rank <= greatest(1, ceil(bw.weight * 1.5::DOUBLE))""",
    "cov_candidates_with_buffer": _RANKED + " SELECT id, cell AS __icov__, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 12",
    "cov_thresholds": _RANKED + " SELECT cell AS __icov__, max(score) AS threshold FROM k WHERE rank <= 2 GROUP BY 1",
    "cov_remainder": _RANKED + ", t AS (SELECT cell, max(score) AS s FROM k WHERE rank <= 2 GROUP BY 1) SELECT k.id, k.cell AS __icov__ FROM k JOIN t ON k.cell = t.cell WHERE k.score > t.s",
    "k_profile": """
SELECT m AS density_mode, CAST(d AS INTEGER) AS depth,
       round(CASE m WHEN 'constant' THEN 1.5 WHEN 'linear' THEN 1.5 * d WHEN 'exp' THEN 1.5 * pow(3, d - 1) ELSE 1.5 * log2(d + 1) END::DOUBLE, 9) AS k
FROM (VALUES ('constant'), ('linear'), ('exp'), ('log')) a(m), range(1, 12) b(d)""",
    "k_total_cap": _CELLS
    + """, n AS (SELECT count(DISTINCT cell) AS n FROM o)
SELECT CAST(d AS INTEGER) AS depth, n AS n_cells, round(least(CASE d WHEN 3 THEN 7.5 ELSE pow(2, d - 1) END::DOUBLE,
       CASE d WHEN 2 THEN 1000.0 / n WHEN 5 THEN 2000.0 / n ELSE 1e9 END::DOUBLE), 9) AS k FROM range(1, 6) t(d), n""",
    "bias_weights": _BIAS.format(power=0.5) + " SELECT cell AS __icov__, round(weight, 9) AS weight FROM bw",
    "frac_score_local": _fraction(1.4, False),
    "frac_score_global": _fraction_all(1.4, False),
    "frac_random_local": _fraction(2.3, True),
    "frac_random_global": _fraction_all(1.4, True),
    "coverage_hierarchy": _WHOLE + " SELECT id, CAST(depth AS INTEGER) AS depth, ipix FROM d",
    "coverage_hierarchy_loop": _CELLS
    + """, k AS (SELECT id, row_number() OVER (PARTITION BY cell ORDER BY id DESC) AS rank FROM o)
SELECT id, CASE WHEN rank <= 1 THEN 1 WHEN rank <= 4 THEN 2 WHEN rank <= 8 THEN 3 WHEN rank <= 16 THEN 4 ELSE 5 END AS depth FROM k WHERE rank <= 32""",
    "hats_partition_coverage": f"""
WITH i AS (SELECT norder, npix, (SELECT count(*) FROM partition_info b WHERE (b.norder, b.npix) < (a.norder, a.npix)) AS ordinal FROM partition_info a)
SELECT o.record_id, i.ordinal FROM dp1_objects o JOIN i ON o.norder = i.norder AND o.npix = i.npix
QUALIFY row_number() OVER (PARTITION BY i.ordinal ORDER BY {_FINITE} NULLS LAST, o.coord_ra NULLS LAST, o.coord_dec NULLS LAST, o.record_id) <= 2""",
    "tile_completeness": _WHOLE
    + f""", {_DEPTHS}, m AS (SELECT g.depth, p.pix >> (2 * (8 - g.depth)) AS ipix, count(*) AS n FROM p, g GROUP BY ALL),
wr AS (SELECT depth, ipix, count(*) AS n_written FROM d GROUP BY 1, 2)
SELECT CAST(wr.depth AS INTEGER) AS depth, wr.ipix, wr.n_written, m.n AS n_src, m.n - wr.n_written AS n_remaining FROM wr JOIN m ON wr.depth = m.depth AND wr.ipix = m.ipix""",
    "tile_rows_sanitised": "SELECT doc_id, translate(text, chr(9) || chr(10) || chr(13), '   ') AS text FROM documents",
    "allsky_rows": _WHOLE + " SELECT CAST(depth AS INTEGER) AS depth, ipix, id FROM d WHERE depth <= 2",
    "tile_paths": _WHOLE + " SELECT DISTINCT 'Norder' || depth || '/Dir' || (ipix - ipix % 10000) || '/Npix' || ipix || '.tsv' AS path FROM d",
    "column_reports": " UNION ALL ".join(
        [f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL OR isnan({c})) AS n_null, min({c}) FILTER (NOT isnan({c})) AS min, max({c}) FILTER (NOT isnan({c})) AS max FROM dp1_objects" for c in _NUMBERS]
        + [f"SELECT '{c}', count(*) FILTER ({c} IS NULL), min({c})::DOUBLE, max({c})::DOUBLE FROM dp1_objects" for c in _INTEGERS]
    ),
    "column_reports_whole": " UNION ALL ".join(
        [f"SELECT '{c}' AS \"column\", 'double' AS type, count(*) FILTER ({c} IS NULL OR isnan({c})) AS n_null, min({c}) FILTER (NOT isnan({c})) AS min, max({c}) FILTER (NOT isnan({c})) AS max, CASE WHEN NOT (count(*) FILTER ({c} = 'inf'::DOUBLE) > 0 AND count(*) FILTER ({c} = '-inf'::DOUBLE) > 0) THEN format('{{:.9e}}', avg({c}) FILTER (NOT isnan({c})))::DOUBLE END AS mean, false AS shown FROM dp1_objects" for c in _NUMBERS]
        + [f"SELECT '{c}', '{'int' if c in ('norder', 'ingest_batch') else 'bigint'}', count(*) FILTER ({c} IS NULL), min({c})::DOUBLE, max({c})::DOUBLE, format('{{:.9e}}', avg({c}::DOUBLE))::DOUBLE, false FROM dp1_objects" for c in _INTEGERS]
        + [f"SELECT '{c}', 'boolean', count(*) FILTER ({c} IS NULL), NULL, NULL, NULL, count({c}) > 0 FROM dp1_objects" for c in _FLAGS]
        + [f"SELECT '{c}', 'timestamp', count(*) FILTER ({c} IS NULL), NULL, NULL, NULL, count({c}) > 0 FROM dp1_objects" for c in _TIMES]
    ),
    "hierarchy_ties_reference": _depths("pow(2, {d} - 1)"),
    "hierarchy_ties_descending": _depths("{d}", descending=True),
    "hierarchy_ties_keep": _depths_kept((1, 3, 8, 16)),
    "hierarchy_fraction_local": _half_a_row(),
    "hierarchy_fraction_global": _depths("1.4", overall=True),
    "hierarchy_total_profile": _depths("3000.0::DOUBLE * {d} / {n}", overall=True),
    "hierarchy_total_caps": _depths("least(pow(2, {d} - 1), CASE {d} WHEN 2 THEN 500.0::DOUBLE / {n} WHEN 4 THEN 700.0::DOUBLE / {n} ELSE 1e9 END)", overall=True),
    "hats_index_pixels": placed("o_orderkey AS id", "orders", "o_orderkey", 11) + " SELECT id, pix >> 20 AS ipix1, pix >> 12 AS ipix5, pix >> 4 AS ipix9 FROM p",
    "scan_csv": "SELECT s_suppkey::DOUBLE AS s_suppkey, s_name, s_nationkey::DOUBLE AS s_nationkey, s_acctbal FROM supplier",
    "scan_tsv": "SELECT s_suppkey::DOUBLE AS s_suppkey, s_name, s_nationkey::DOUBLE AS s_nationkey, s_acctbal FROM supplier",
    "scan_headerless": "SELECT s_suppkey::DOUBLE AS s_suppkey, s_name, s_nationkey::DOUBLE AS s_nationkey, s_acctbal FROM supplier",
    "scan_hats": "SELECT record_id, norder, npix FROM dp1_objects",
}
SQL["moc_numbers"] = f"SELECT (CAST(4 AS BIGINT) << (2 * depth)) + ipix AS uniq FROM ({SQL['moc_compacted']})"
