"""``python -m cadenza --config-dir config``: run the configured tasks; exit 1 if one failed."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .plans.config import Config, arguments
from .plans.runner import JsonTracker, run_all
from .sources.catalog import register_folders


def main(argv: list[str] | None = None) -> int:
    given = arguments(argv)
    config = Config.load(given.config_dir)
    spark = SparkSession.builder.appName("cadenza").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if config.data:
        register_folders(config.data)
    states = run_all(spark, config, tuple(given.task), JsonTracker(Path(given.tracker)) if given.tracker else None)
    for name, state in states.items():
        print(f"{name}: {state}")
    return int(any(s.startswith("failed") for s in states.values()))


if __name__ == "__main__":
    sys.exit(main())
