"""Run configuration: frozen sections, their rules, and a help text made from the sections themselves.

Every field carries its own help, so the reference printed by ``describe_options`` cannot drift from the code. Rules:

* ``input.paths``, ``columns.ra/dec/score``, ``algorithm.level_limit``, ``output.out_dir/cat_name`` and all five sections are required.
* With neither coverage order given both are 8 (or ``level_limit`` if smaller); one given serves for both. ``level_coverage`` never
  exceeds ``level_limit``; ``coverage_order`` may.
* ``k_per_cov_initial`` and ``targets_total_initial`` exclude each other. ``n_2`` needs ``n_1``, ``n_3`` needs both.
* Any ``selection_mode`` other than "mag_global" means coverage. ``level_limit`` is checked (4 to 11) when a run starts.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import MISSING, dataclass, field, fields, replace
from typing import Any

LOWEST_LIMIT, HIGHEST_LIMIT, USUAL_COVERAGE = 4, 11, 8


def option(text: str, default: Any = MISSING):
    return field(metadata={"help": text}) if default is MISSING else field(default=default, metadata={"help": text})


@dataclass(frozen=True)
class Input:
    paths: tuple[str, ...] = option("glob patterns of the input files; for hats the one catalogue folder")
    format: str = option("parquet, csv, tsv or hats", "parquet")
    header: bool = option("whether csv and tsv files start with a header line", True)
    ascii_format: str | None = option("CSV or TSV, where the format doesn't tell the separator", None)


@dataclass(frozen=True)
class Columns:
    ra: str = option("right ascension: a name, or a number from 1 without header")
    dec: str = option("declination, likewise")
    score: str = option("column or expression by which rows are ranked")
    keep: tuple[str, ...] | None = option("further columns of the tiles; not set: all, empty: only those the run needs", None)


@dataclass(frozen=True)
class Algorithm:
    level_limit: int = option("deepest order, 4 to 11")
    selection_mode: str = option("coverage: best rows of every cell; mag_global: slices of one magnitude distribution", "coverage")
    level_coverage: int = option("order of the coverage map", USUAL_COVERAGE)
    coverage_order: int = option("order of the coverage cells", USUAL_COVERAGE)
    order_desc: bool = option("whether higher scores are better", False)
    k_per_cov_per_level: Mapping[int, float] | None = option("rows per cell at given depths, instead of the profile", None)
    targets_total_per_level: Mapping[int, int] | None = option("most rows at given depths", None)
    tie_buffer: int = option("accepted and without effect: the exact selection needs no buffer", 10)
    density_mode: str = option("how rows per cell (or totals) grow with depth: constant, linear, exp or log", "exp")
    k_per_cov_initial: float = option("rows per cell at depth 1", 1.0)
    targets_total_initial: float | None = option("rows in total at depth 1, instead of k_per_cov_initial", None)
    density_exp_base: float = option("growth per depth of the exp profile; 1 or less counts as 2", 2.0)
    density_bias_mode: str = option("none, proportional or inverse: cells weighted by their density", "none")
    density_bias_exponent: float = option("strength of the weighting", 1.0)
    fractional_mode: str = option("score or random: who gets the fraction of a row per cell", "score")
    fractional_mode_logic: str = option("local, global or auto (score: global, random: local)", "local")
    use_hats_as_coverage: bool = option("take hats partitions as coverage cells", False)
    mag_column: str | None = option("magnitude column, required by mag_global", None)
    mag_min: float | None = option("smallest magnitude; not set: the smallest present, at least -2", None)
    mag_max: float | None = option("largest magnitude; not set: the fullest histogram bin's middle, at most 40", None)
    mag_hist_nbins: int = option("bins of the magnitude histogram", 256)
    n_1: int | None = option("rows wanted at depth 1 of mag_global", None)
    n_2: int | None = option("rows wanted at depth 2; needs n_1", None)
    n_3: int | None = option("rows wanted at depth 3; needs n_1 and n_2", None)
    tie_policy: str = option("keep: rows tied with a cut go deeper; reference: they are lost, as strict comparison has it", "reference")
    seed: int = option("seed of all random choices", 0)


@dataclass(frozen=True)
class Cluster:
    mode: str = option("local or slurm (then the submitted session is used)", "local")
    n_workers: int = option("workers", 3)
    threads_per_worker: int = option("threads of a worker", 1)
    memory_per_worker: str = option("memory of a worker", "2GB")
    slurm: Mapping[str, Any] | None = option("further settings: those named spark.* are set in the session", None)
    persist_ddfs: bool = option("keep the prepared rows in memory and on disk", False)
    avoid_computes_wherever_possible: bool = option("accepted and without effect: plans are lazy anyway", True)
    diagnostics_mode: str = option("per_step, global or off: labels on Spark's jobs", "global")


@dataclass(frozen=True)
class Output:
    out_dir: str = option("folder of the hierarchy")
    cat_name: str = option("name of the catalogue")
    target: str = option("first view: right ascension and declination", "0 0")
    creator_did: str | None = option("identifier of the creator", None)
    obs_title: str | None = option("title", None)


@dataclass(frozen=True)
class Config:
    input: Input
    columns: Columns
    algorithm: Algorithm
    cluster: Cluster
    output: Output


_SECTIONS = {"input": Input, "columns": Columns, "algorithm": Algorithm, "cluster": Cluster, "output": Output}


def _count(name: str, value: Any) -> int | None:
    if value is None:
        return None
    try:
        number = int(value)
    except (TypeError, ValueError) as error:
        raise ValueError(f"algorithm.{name} must be a whole number, not {value!r}") from error
    if number < 0:
        raise ValueError(f"algorithm.{name} must not be negative, but is {number}")
    return number


def _per_level(value: Any, kind: type) -> dict[int, Any] | None:
    return {int(k): kind(v) for k, v in value.items()} if isinstance(value, dict) else None


def _algorithm(given: Mapping[str, Any]) -> dict[str, Any]:
    out = dict(given)
    limit = out["level_limit"] = int(out["level_limit"])
    orders = [out.get("level_coverage"), out.get("coverage_order")]
    usual = next((o for o in orders if o is not None), min(USUAL_COVERAGE, limit))
    level, cell = (int(usual if o is None else o) for o in orders)
    out |= {"level_coverage": min(level, limit), "coverage_order": cell}
    if out.get("k_per_cov_initial") is not None and out.get("targets_total_initial") is not None:
        raise ValueError("algorithm.k_per_cov_initial and algorithm.targets_total_initial exclude each other")
    for later, earlier in (("n_2", ("n_1",)), ("n_3", ("n_1", "n_2"))):
        if out.get(later) is not None and any(out.get(e) is None for e in earlier):
            raise ValueError(f"algorithm.{later} needs {' and '.join(earlier)}")
    out |= {n: _count(n, out.get(n)) for n in ("n_1", "n_2", "n_3")}
    out["k_per_cov_per_level"] = _per_level(out.get("k_per_cov_per_level"), float)
    out["targets_total_per_level"] = _per_level(out.get("targets_total_per_level"), int)
    return out


def _section(name: str, given: Mapping[str, Any]) -> Any:
    """A section's dataclass: unknown keys are ignored, missing required ones raise KeyError, values take the defaults' types."""
    kinds = {"bool": bool, "int": int, "float": float, "str": str}
    values = {}
    for f in fields(_SECTIONS[name]):
        value = given.get(f.name)
        if value is None:
            if f.default is MISSING:
                raise KeyError(f"{name}.{f.name}")
            continue
        values[f.name] = kinds[f.type](value) if f.type in kinds else value
    return _SECTIONS[name](**values)


def config_from_mapping(given: Mapping[str, Any]) -> Config:
    """Configuration from nested mappings, as in the YAML file. Raises KeyError for what is missing, ValueError for what conflicts."""
    parts = {name: given[name] for name in _SECTIONS}
    parts["algorithm"] = _algorithm(parts["algorithm"])
    config = Config(**{name: _section(name, part or {}) for name, part in parts.items()})
    paths = config.input.paths
    columns = config.columns if config.columns.keep is None else replace(config.columns, keep=tuple(map(str, config.columns.keep)))
    algorithm = replace(config.algorithm, selection_mode=config.algorithm.selection_mode.lower())
    if algorithm.tie_policy not in ("keep", "reference"):
        raise ValueError("algorithm.tie_policy must be keep or reference")
    return replace(config, input=replace(config.input, paths=(paths,) if isinstance(paths, str) else tuple(paths)), columns=columns, algorithm=algorithm)


def load_config(path: str) -> Config:
    """Configuration from a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return config_from_mapping(yaml.safe_load(f))


def check_for_run(config: Config) -> Config:
    """What is checked when a run starts; returns the configuration the run uses."""
    a = config.algorithm
    if not LOWEST_LIMIT <= a.level_limit <= HIGHEST_LIMIT:
        raise ValueError(f"algorithm.level_limit must lie between {LOWEST_LIMIT} and {HIGHEST_LIMIT}")
    if a.use_hats_as_coverage:
        hats = config.input.format.lower() == "hats"
        a = replace(a, density_bias_mode="none") if hats else replace(a, use_hats_as_coverage=False)
    return replace(config, algorithm=a)


def describe_options() -> str:
    """All options by section, with defaults."""
    lines = []
    for name, kind in _SECTIONS.items():
        lines += [name, "-" * len(name)]
        for f in fields(kind):
            lines.append(f"{f.name}: {f.metadata['help']} ({'required' if f.default is MISSING else f'default {f.default!r}'})")
        lines.append("")
    return "\n".join(lines)
