"""A session with the settings that the library's queries are tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    base = {
        "spark.sql.shuffle.partitions": str(cpus) if str(cpus).isdigit() else "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{cpus}]").appName("setforge").config(map=base | conf).getOrCreate()
