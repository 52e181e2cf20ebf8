"""Catalogue hierarchies and large-scale data operators on Spark."""

from skyloom.config import Config, config_from_mapping, describe_options, load_config

__all__ = ["Config", "config_from_mapping", "describe_options", "display_available_configs", "load_config", "load_config_from_dict", "run", "run_pipeline"]

#: The same function under the name used where a configuration is a plain dictionary.
load_config_from_dict = config_from_mapping


def display_available_configs() -> None:
    """Print all options by section."""
    print(describe_options())


def run(spark, config):
    """See skyloom.plans.pipeline.run."""
    from skyloom.plans.pipeline import run as run_

    return run_(spark, config)


def run_pipeline(config):
    """``run`` in the active session, or one made after the configuration's cluster section (workers and threads; slurm: as submitted)."""
    from skyloom.runtime import build_session

    c = config.cluster
    memory = c.memory_per_worker.lower().removesuffix("b")
    if c.mode == "slurm":
        return run(build_session(config.output.cat_name, None, **{"spark.executor.memory": memory, **session_settings(c)}), config)
    # one process holds all workers of a local session
    megabytes = c.n_workers * in_megabytes(memory)
    return run(build_session(config.output.cat_name, f"local[{c.n_workers * c.threads_per_worker}]", **{"spark.driver.memory": f"{megabytes}m"}), config)


def session_settings(cluster) -> dict[str, str]:
    """Session settings of the slurm section: its entries named spark.*; all else is for whoever submits the job."""
    return {k: str(v) for k, v in (cluster.slurm or {}).items() if k.startswith("spark.")}


def in_megabytes(memory: str) -> int:
    """"2g", "512m" or "1t" in megabytes; a bare number counts bytes."""
    factor = {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024 * 1024}.get(memory[-1])
    return max(1, round(float(memory[:-1]) * factor if factor else float(memory) / (1 << 20)))
