import pytest

from skyloom.config import check_for_run, config_from_mapping, describe_options, load_config


def given(**algorithm):
    return {
        "input": {"paths": ["x/*.parquet"]},
        "columns": {"ra": "ra", "dec": "dec", "score": "mag"},
        "algorithm": {"level_limit": 10, **algorithm},
        "cluster": {},
        "output": {"out_dir": "out", "cat_name": "c"},
    }


def algorithm(**options):
    return config_from_mapping(given(**options)).algorithm


def test_defaults():
    c = config_from_mapping(given())
    a = c.algorithm
    assert (a.level_coverage, a.coverage_order, a.tie_buffer, a.density_mode, a.k_per_cov_initial) == (8, 8, 10, "exp", 1.0)
    assert (a.fractional_mode, a.fractional_mode_logic, a.mag_hist_nbins, a.order_desc, a.selection_mode) == ("score", "local", 256, False, "coverage")
    assert (c.cluster.n_workers, c.cluster.threads_per_worker, c.cluster.memory_per_worker, c.cluster.persist_ddfs) == (3, 1, "2GB", False)
    assert c.input.format == "parquet" and c.columns.keep is None and c.output.target == "0 0"


def test_orders_follow_each_other():
    assert algorithm(level_limit=6).level_coverage == algorithm(level_limit=6).coverage_order == 6
    only = algorithm(level_limit=8, coverage_order=6)
    assert (only.level_coverage, only.coverage_order) == (6, 6)
    clamped = algorithm(level_limit=7, level_coverage=9, coverage_order=10)
    assert (clamped.level_coverage, clamped.coverage_order) == (7, 10)


@pytest.mark.parametrize("options", [{"k_per_cov_initial": 1, "targets_total_initial": 5}, {"n_2": 1}, {"n_1": 1, "n_3": 1}, {"n_1": -1}, {"n_1": "x"}, {"tie_policy": "maybe"}])
def test_conflicts(options):
    with pytest.raises(ValueError):
        algorithm(**options)


def test_totals_leave_k_alone():
    a = algorithm(targets_total_initial=50)
    assert (a.k_per_cov_initial, a.targets_total_initial) == (1.0, 50.0)


def test_per_level_values():
    a = algorithm(k_per_cov_per_level={"3": "0.5"}, targets_total_per_level=[1, 2])
    assert a.k_per_cov_per_level == {3: 0.5} and a.targets_total_per_level is None


@pytest.mark.parametrize("path", [("input", "paths"), ("columns", "score"), ("algorithm", "level_limit"), ("output", "cat_name")])
def test_required(path):
    g = given()
    del g[path[0]][path[1]]
    with pytest.raises(KeyError):
        config_from_mapping(g)


def test_required_sections():
    g = given()
    del g["cluster"]
    with pytest.raises(KeyError):
        config_from_mapping(g)


@pytest.mark.parametrize("level", [3, 12])
def test_level_limit_is_checked_at_run(level):
    c = config_from_mapping(given(level_limit=level))
    with pytest.raises(ValueError):
        check_for_run(c)


def test_hats_cells_need_hats_and_stop_the_bias():
    g = given(use_hats_as_coverage=True, density_bias_mode="inverse")
    assert not check_for_run(config_from_mapping(g)).algorithm.use_hats_as_coverage
    g["input"]["format"] = "hats"
    a = check_for_run(config_from_mapping(g)).algorithm
    assert a.use_hats_as_coverage and a.density_bias_mode == "none"


def test_yaml_and_help(tmp_path):
    yaml = pytest.importorskip("yaml")
    p = tmp_path / "c.yaml"
    p.write_text(yaml.safe_dump(given(selection_mode="MAG_GLOBAL", mag_column="mag")))
    assert load_config(str(p)).algorithm.selection_mode == "mag_global"
    text = describe_options()
    assert "level_limit" in text and "required" in text and "mag_hist_nbins" in text


def test_cluster_settings():
    from skyloom import in_megabytes, session_settings
    from skyloom.config import Cluster

    assert [in_megabytes(m) for m in ("2g", "512m", "1t", "1048576", "1.5g")] == [2048, 512, 1048576, 1, 1536]
    assert session_settings(Cluster(slurm={"spark.executor.cores": 4, "queue": "x"})) == {"spark.executor.cores": "4"}
    assert session_settings(Cluster()) == {}
