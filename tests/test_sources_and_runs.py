import json
import math
import random
import shutil
import xml.etree.ElementTree as ET
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import skyloom
from skyloom import cli
from skyloom.config import config_from_mapping
from skyloom.functions.healpix import pixels_at
from skyloom.operators.densmap import compact_cells
from skyloom.sinks.fits import PIECE, dense_map, map_pieces, read_integer_table, write_integer_table
from skyloom.runtime import shared_dir
from skyloom.sinks.metadata import properties, votable, write_coverage_map
from skyloom.sinks.store import Store, absolute
from skyloom.sinks.tiles import cell_text, completeness_line, header_line, tile_path
from skyloom.sources.catalog import expand_paths, find_hats_root, read_catalog, read_properties, resolve, roles

N = 600


def catalogue(n=N, seed=1):
    rng = random.Random(seed)
    return [(i, rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1))), round(rng.uniform(10, 25), 3), f'n"{i}\t{i % 3}', rng.choice([True, False]), None if i % 7 == 0 else i) for i in range(n)]


SCHEMA = "id long, ra double, dec double, mag double, name string, flag boolean, odd int"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("cat") / "cat.parquet"
    spark.createDataFrame(catalogue(), SCHEMA).repartition(3).write.parquet(str(path))
    return str(path)


def config(source, out="-", fmt="parquet", columns=None, header=True, **algorithm):
    return config_from_mapping(
        {
            "input": {"paths": [source], "format": fmt, "header": header},
            "columns": {"ra": "ra", "dec": "dec", "score": "mag"} | (columns or {}),
            "algorithm": {"level_limit": 4, "coverage_order": 2} | algorithm,
            "cluster": {},
            "output": {"out_dir": str(out), "cat_name": "cat", "target": "10 -5"},
        }
    )


def test_paths(tmp_path):
    (tmp_path / "a1").touch()
    (tmp_path / "a2").touch()
    assert [Path(p).name for p in expand_paths([str(tmp_path / "a*")])] == ["a1", "a2"]
    assert expand_paths(["hdfs://x/y"]) == ["hdfs://x/y"]
    with pytest.raises(FileNotFoundError):
        expand_paths([str(tmp_path / "b*")])


def test_resolve():
    assert resolve("b", ["a", "b"]) == "b" and resolve(2, ["a", "b"], header=False) == "b"
    with pytest.raises(KeyError):
        resolve("c", ["a", "b"])
    for bad in (0, 3):
        with pytest.raises(IndexError):
            resolve(bad, ["a", "b"], header=False)


@pytest.mark.parametrize("keep, want", [(None, ["ra", "dec", "m", "a"]), ([], ["ra", "dec", "m"]), (["a", "zz"], ["ra", "dec", "m", "a"])])
def test_kept_columns(spark, keep, want):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "a int, ra double, dec double, m double")
    assert list(roles(df, config("-", columns={"score": "m", "keep": keep})).keep) == want


def test_text_sources(spark, tmp_path):
    rows = spark.createDataFrame(catalogue(50), SCHEMA).select("id", "ra", "dec", "mag")
    for fmt, sep in (("csv", ","), ("tsv", "\t")):
        rows.write.option("header", True).option("sep", sep).csv(str(tmp_path / fmt))
        df = read_catalog(spark, config(str(tmp_path / fmt), fmt=fmt))
        assert df.dtypes == [("id", "double"), ("ra", "double"), ("dec", "double"), ("mag", "double")] and df.count() == 50
        rows.write.option("sep", sep).csv(str(tmp_path / f"{fmt}_bare"))
        bare = config(str(tmp_path / f"{fmt}_bare"), fmt=fmt, header=False, columns={"ra": "2", "dec": "3", "score": "4", "keep": ["1"]})
        assert list(roles(read_catalog(spark, bare), bare).keep) == ["_c1", "_c2", "_c3", "_c0"]
    with pytest.raises(ValueError):
        read_catalog(spark, config(str(tmp_path / "csv"), fmt="fits"))


@pytest.fixture(scope="module")
def hats(spark, tmp_path_factory):
    """A collection with two partitions of order 0, one of order 1."""
    root = tmp_path_factory.mktemp("hats") / "coll"
    from skyloom.functions.healpix import with_pixel

    df = with_pixel(spark.createDataFrame(catalogue(), SCHEMA), F.col("ra"), F.col("dec"), 6, "_healpix_6")
    base = df.withColumn("b", F.shiftright("_healpix_6", 12)).persist()
    for norder, npix, part in ((0, 1, base.where("b = 1")), (0, 7, base.where("b = 7")), (1, 16, base.where("shiftright(_healpix_6, 10) = 16"))):
        part.drop("b").coalesce(1).write.parquet(str(root / "catalog/dataset" / f"Norder={norder}" / "Dir=0" / f"Npix={npix}"))
    (root / "collection.properties").write_text("# made here\nobs_collection = coll\nhats_primary_table_url = catalog\n")
    (root / "catalog/hats.properties").write_text("hats_order=1\n")
    return root, base.where("b in (1, 7) or shiftright(_healpix_6, 10) = 16").count()


def test_hats(spark, hats, tmp_path):
    root, n = hats
    df = read_catalog(spark, config(str(root), fmt="hats"))
    assert df.count() == n and {(r.Norder, r.Npix) for r in df.select("Norder", "Npix").distinct().collect()} == {(0, 1), (0, 7), (1, 16)}
    assert find_hats_root(str(root / "catalog/dataset")) == (root / "catalog").resolve()
    assert read_properties(root / "collection.properties")["hats_primary_table_url"] == "catalog"
    kept = roles(df, config(str(root), fmt="hats")).keep
    assert "Norder" not in kept and "_healpix_6" in kept
    result = skyloom.run(spark, config(str(root), tmp_path / "out", fmt="hats", use_hats_as_coverage=True, k_per_cov_initial=2, density_bias_mode="proportional"))
    assert result.n_rows == n and result.n_written[1] == 6
    with pytest.raises(FileNotFoundError):
        read_catalog(spark, config(str(tmp_path), fmt="hats"))


def test_hats_leaves_as_files(spark, hats, tmp_path):
    root, n = hats
    for leaf in (root / "catalog/dataset").glob("Norder=*/Dir=*/Npix=*"):
        to = tmp_path / "cat/dataset" / leaf.relative_to(root / "catalog/dataset").parent
        to.mkdir(parents=True, exist_ok=True)
        shutil.copy(next(leaf.glob("part-*.parquet")), to / f"{leaf.name}.parquet")
    df = read_catalog(spark, config(str(tmp_path / "cat"), fmt="hats"))
    assert df.count() == n and {(r.Norder, r.Npix) for r in df.select("Norder", "Npix").distinct().collect()} == {(0, 1), (0, 7), (1, 16)}


def test_no_rows(spark, source, tmp_path):
    spark.read.parquet(source).limit(0).write.parquet(str(tmp_path / "none"))
    result = skyloom.run(spark, config(str(tmp_path / "none"), tmp_path / "h"))
    assert result.n_rows == 0 and result.n_written == {} and read_integer_table(tmp_path / "h/densmap_o2.fits")[1].sum() == 0
    with pytest.raises(ValueError):
        skyloom.run(spark, config(str(tmp_path / "none"), tmp_path / "h", selection_mode="mag_global", mag_column="mag"))


def read_tile(path):
    lines = path.read_text(encoding="utf-8").split("\n")
    assert lines[-1] == ""
    return lines[0], lines[1].split("\t"), [line.split("\t") for line in lines[2:-1]]


def test_coverage_run(spark, source, tmp_path):
    out = tmp_path / "hips"
    result = skyloom.run(spark, config(source, out, columns={"keep": ["id", "name", "flag", "odd"]}))
    assert result.n_rows == N
    rows = {r[0]: r for r in catalogue()}
    seen = set()
    for depth in range(1, 5):
        _, counts = read_integer_table(out / f"densmap_o{depth}.fits")
        assert len(counts) == pixels_at(depth) and counts.sum() == N
        files = list((out / f"Norder{depth}").glob("Dir*/Npix*.tsv"))
        assert len(files) == result.n_tiles.get(depth, 0)
        total = 0
        for f in files:
            pixel = int(f.stem.removeprefix("Npix"))
            head, header, body = read_tile(f)
            assert header == ["ra", "dec", "mag", "id", "name", "flag", "odd"]
            assert head == f"# Completeness = {counts[pixel] - len(body)} / {counts[pixel]}"
            total += len(body)
            for ra, dec, mag, i, name, flag, odd in body:
                want = rows[int(i)]
                assert (float(ra), float(dec), float(mag)) == want[1:4] and flag == str(want[5]) and odd == ("" if want[6] is None else str(want[6]))
                assert name == '"' + want[4].replace("\t", " ").replace('"', '""') + '"'
                assert int(i) not in seen
                seen.add(int(i))
        assert total == result.n_written.get(depth, 0)
    for depth in (1, 2):
        head, _, body = read_tile(out / f"Norder{depth}/Allsky.tsv")
        assert len(body) == result.n_written[depth] and head == f"# Completeness = {N - len(body)} / {N}"
    assert not (out / "Norder3/Allsky.tsv").exists() and not list(out.rglob("*.tmp"))
    assert (out / "metadata.xml").read_text() == (out / "Metadata.xml").read_text()
    text = (out / "properties").read_text()
    assert "hips_initial_ra   = 10" in text and f"hips_cat_nrows    = {N}" in text and "hips_order        = 4" in text
    assert "level_limit: 4" in (out / "arguments").read_text() and "done" in (out / "process.log").read_text()


def test_magnitude_run_covers_the_window(spark, source, tmp_path):
    out = tmp_path / "hips"
    result = skyloom.run(spark, config(source, out, selection_mode="mag_global", mag_column="mag", mag_min=12, n_1=20, columns={"keep": []}))
    low, high = result.mag_range
    inside = [r for r in catalogue() if low <= r[3] <= high]
    assert result.n_rows == len(inside) == sum(result.n_written.values())
    assert list(result.edges) == sorted(result.edges) and result.edges[0] == 12.0 and result.edges[-1] == high
    assert f"mag_max: {high}" in (out / "arguments").read_text()
    _, header, _ = read_tile(next((out / "Norder4").glob("Dir*/Npix*.tsv")))
    assert header == ["ra", "dec", "mag"]


def test_expression_scores_and_bias_run(spark, source, tmp_path):
    result = skyloom.run(spark, config(source, tmp_path / "h", columns={"score": "np.sqrt(mag) + dec * 0", "keep": []}, density_bias_mode="inverse", k_per_cov_initial=0.7, targets_total_per_level={3: 10}))
    assert not list((tmp_path / "h").rglob("*.tmp"))
    assert 0 < result.n_written[1] and result.n_written.get(3, 0) <= pixels_at(2)


def test_run_from_a_dictionary(spark, source, tmp_path, capsys):
    c = skyloom.load_config_from_dict({"input": {"paths": [source]}, "columns": {"ra": "ra", "dec": "dec", "score": "mag"}, "algorithm": {"level_limit": 4}, "cluster": {"persist_ddfs": True, "diagnostics_mode": "per_step"}, "output": {"out_dir": str(tmp_path / "o"), "cat_name": "c"}})
    assert skyloom.run_pipeline(c).n_rows == N
    skyloom.display_available_configs()
    assert "coverage_order" in capsys.readouterr().out


def test_hint_at_hats(spark, hats, tmp_path):
    leaf = next((hats[0] / "catalog/dataset").glob("Norder=*/Dir=*/Npix=*"))
    skyloom.run(spark, config(str(leaf), tmp_path / "h", k_per_cov_initial=0))
    assert "HATS" in (tmp_path / "h/process.log").read_text()


def test_empty_selection(spark, source, tmp_path):
    out = tmp_path / "h"
    result = skyloom.run(spark, config(source, out, k_per_cov_initial=0))
    assert result.n_written == {} and (out / "densmap_o4.fits").exists()


def test_bad_input(spark, tmp_path):
    spark.createDataFrame([(1.0, 95.0, 1.0)], "ra double, dec double, mag double").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        skyloom.run(spark, config(str(tmp_path / "bad"), tmp_path / "h"))


def test_command_line(spark, source, tmp_path, capsys):
    yaml = pytest.importorskip("yaml")
    assert cli.main(["--options"]) == 0 and "level_limit" in capsys.readouterr().out
    c = {"input": {"paths": [source]}, "columns": {"ra": "ra", "dec": "dec", "score": "mag"}, "algorithm": {"level_limit": 4}, "cluster": {"mode": "slurm"}, "output": {"out_dir": str(tmp_path / "o"), "cat_name": "c"}}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(c))
    assert cli.main(["--config", str(tmp_path / "c.yaml")]) == 0 and f"{N} rows" in capsys.readouterr().out


def test_tile_texts():
    assert [tile_path(7, p) for p in (12345, 9999, 10000)] == ["Norder7/Dir10000/Npix12345.tsv", "Norder7/Dir0/Npix9999.tsv", "Norder7/Dir10000/Npix10000.tsv"]
    assert [cell_text(v) for v in ('a"b', "x\ty", float("nan"), True, None, 0.1 + 0.2, 1e7, 2**53 + 1)] == ['"a""b"', "x y", "", "True", "", "0.30000000000000004", "10000000.0", "9007199254740993"]
    assert completeness_line(5, 2) == "# Completeness = 3 / 5\n" and completeness_line(1, 2) == "# Completeness = 0 / 1\n"
    assert header_line(["a", "b"]) == "a\tb\n"


def test_fits(spark, tmp_path):
    path = tmp_path / "t.fits"
    write_integer_table(path, "VALUE", 3, [np.array([1, -2, 2**60], ">i8").tobytes()])
    info, values = read_integer_table(path)
    assert values.tolist() == [1, -2, 2**60] and info["TTYPE1"] == "VALUE" and info["TFORM1"] == "K" and path.stat().st_size % 2880 == 0
    with pytest.raises(ValueError):
        write_integer_table(path, "VALUE", 4, [b"\0" * 8])
    last = pixels_at(8) - 1
    maps = spark.createDataFrame([(8, 0, 5), (8, PIECE * 3 + 7, 6), (8, last, 7), (1, 0, 9)], "depth int, ipix long, n long")
    dense = np.frombuffer(b"".join(map_pieces(maps, 8)), ">i8")
    assert len(dense) == last + 1 and dense.nonzero()[0].tolist() == [0, PIECE * 3 + 7, last] and dense.sum() == 18
    assert np.frombuffer(b"".join(map_pieces(maps, 1)), ">i8").tolist() == [9] + [0] * 47
    assert sum(map(len, map_pieces(maps, 2))) == 8 * pixels_at(2)
    assert dense_map(maps, 1).tolist() == [9] + [0] * 47
    with pytest.raises(ValueError):
        dense_map(maps, 13)


def test_coverage_files(spark, tmp_path):
    cells = spark.createDataFrame([(c,) for c in (0, 1, 2, 3, 5)], "ipix long")
    write_coverage_map(compact_cells(cells, 2), 2, tmp_path)
    assert json.loads((tmp_path / "Moc.json").read_text()) == {"1": [0], "2": [5]}
    info, uniq = read_integer_table(tmp_path / "Moc.fits")
    assert uniq.tolist() == [16, 69] and info["ORDERING"] == "NUNIQ" and info["MOCORD_S"] == "2"
    write_coverage_map(compact_cells(cells.limit(0), 2), 2, tmp_path)
    assert json.loads((tmp_path / "Moc.json").read_text()) == {"2": []}


def test_table_description(spark):
    df = spark.createDataFrame([(1, 1.0, "x", True)], "`a b` int, ra double, s string, f boolean")
    root = ET.fromstring(votable(df.schema, ["ra", "a b", "s", "f"], "ra", "dec").split("\n", 1)[1])
    fields = [(f.get("name"), f.get("datatype"), f.get("ucd")) for f in root.iter("{http://www.ivoa.net/xml/VOTable/v1.3}FIELD")]
    assert fields == [("ra", "double", "pos.eq.ra;meta.main"), ("a b", "long", None), ("s", "char", None), ("f", "char", None)]


def test_properties_defaults():
    text = properties(config("-").output, 4, 9, "now")
    assert "creator_did       = ivo://PRIVATE_USER/cat" in text
    assert "hips_initial_ra   = 0\n" in properties(config_from_mapping({**_mapping(), "output": {"out_dir": "x", "cat_name": "y", "target": "5"}}).output, 4, 9, "now")


def _mapping():
    return {"input": {"paths": ["-"]}, "columns": {"ra": "a", "dec": "b", "score": "c"}, "algorithm": {"level_limit": 4}, "cluster": {}, "output": {"out_dir": "x", "cat_name": "y"}}


def tree(folder):
    """Every tile and all-sky file by name, with its contents."""
    return {str(p.relative_to(folder)): p.read_bytes() for p in sorted(folder.rglob("*.tsv"))}


@pytest.mark.parametrize("mode, logic, k", [("random", "local", 2.5), ("random", "global", 0.4), ("score", "local", 0.3)])
def test_random_choices_do_not_depend_on_the_layout(spark, tmp_path, mode, logic, k):
    rows = catalogue(1500, 3) + catalogue(20, 3)
    trees = []
    for parts in (2, 7):
        path = str(tmp_path / f"in{parts}")
        spark.createDataFrame(random.Random(parts).sample(rows, len(rows)), SCHEMA).repartition(parts).write.parquet(path)
        out = tmp_path / f"out{parts}"
        skyloom.run(spark, config(path, out, fractional_mode=mode, fractional_mode_logic=logic, k_per_cov_initial=k, density_mode="constant"))
        trees.append(tree(out))
    assert trees[0] and trees[0] == trees[1]


def test_a_run_on_uris(spark, source, hats, tmp_path):
    plain = skyloom.run(spark, config(source, tmp_path / "plain"))
    there = skyloom.run(spark, config(f"file://{source}", f"file://{tmp_path}/there"))
    assert plain == there and tree(tmp_path / "plain") == tree(tmp_path / "there")
    names = lambda p: sorted(str(x.relative_to(p)) for x in p.rglob("*") if x.is_file())
    assert names(tmp_path / "plain") == names(tmp_path / "there")
    root, n = hats
    assert read_catalog(spark, config(f"file://{root}", fmt="hats")).count() == n
    assert find_hats_root(f"file://{root}/catalog/dataset", spark) == f"file:{root}/catalog"
    assert find_hats_root(f"file://{tmp_path}", spark) is None
    with pytest.raises(ValueError):
        skyloom.run(spark, config(source, "unknown9://bucket/x"))
    with pytest.raises(FileNotFoundError):
        read_catalog(spark, config(f"file://{tmp_path}/none*"))


def test_stores(tmp_path):
    assert absolute("s3a://bucket/x") == "s3://bucket/x" and absolute("out") == str(Path("out").resolve())
    store = Store(str(tmp_path / "s"))
    store.append_text("log", "a\n")
    store.append_text("log", "b\n")
    assert store.read("log") == b"a\nb\n" and store.read("none") is None
    with pytest.raises(RuntimeError):
        with store.open("d/x.tsv") as f:
            f.write(b"half")
            raise RuntimeError
    assert list((tmp_path / "s/d").iterdir()) == []


def test_scratch_tables_are_deleted(spark, source, tmp_path):
    where = Path(shared_dir(spark).removeprefix("file://")) / "skyloom-tables"
    before = set(where.iterdir()) if where.exists() else set()
    skyloom.run(spark, config(source, tmp_path / "h", fractional_mode_logic="global", k_per_cov_initial=1.5))
    assert set(where.iterdir()) == before


def test_text_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c,d,e\n1,true,007x,2020-01-01,\n2.5e3,False,x,2020-01-02,\n,,1d,,\nNaN,TRUE,5,,\n")
    df = read_catalog(spark, config(str(tmp_path / "t.csv"), fmt="csv"))
    assert [f.dataType.simpleString() for f in df.schema] == ["double", "boolean", "string", "string", "string"]
    assert df.select("b", "c", "d").collect()[1:3] == [(False, "x", "2020-01-02"), (None, "1d", None)]
