"""Command line: ``python -m skyloom.cli --config run.yaml``."""

from __future__ import annotations

import argparse

from skyloom import describe_options, load_config, run_pipeline


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="skyloom", description="Build a tile hierarchy from a catalogue.")
    parser.add_argument("--config", help="YAML file of the run")
    parser.add_argument("--options", action="store_true", help="print all options and end")
    given = parser.parse_args(arguments)
    if given.options:
        print(describe_options())
        return 0
    if not given.config:
        parser.error("--config is required")
    result = run_pipeline(load_config(given.config))
    print(f"{result.n_rows} rows, {sum(result.n_written.values())} written in {sum(result.n_tiles.values())} tiles")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
