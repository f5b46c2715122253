"""Settings of a scan and tables of other stores (sources 13 and 14)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def read_config(path: str) -> dict:
    """Settings from a .yaml, .yml or .json file; an ending of any other kind is an error (source 13)."""
    ending = path.lower().rpartition(".")[2]
    if ending not in ("yaml", "yml", "json"):
        raise ValueError(f"settings are .yaml, .yml or .json: {path}")
    with open(path, encoding="utf-8") as f:
        if ending == "json":
            held = json.load(f)
        else:
            import yaml  # gated: only YAML settings need it

            held = yaml.safe_load(f)
    return held if isinstance(held, dict) else {}


def merge_config(given: dict, held: dict, given_wins: bool = True) -> dict:
    """Settings of the command line with those of a file (source 13).

    given_wins: a setting that is given stays even where it is None, as every setting of the command line is always there;
    otherwise the file's value replaces one that is None.
    """
    return held | {k: v for k, v in given.items() if given_wins or v is not None or k not in held}


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database (source 14); with a numeric key and its bounds it is read in `parts` ranges at once."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()
