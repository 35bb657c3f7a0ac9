"""Parquet against text: size on disk and time of one report.

    python -m workload.storage /root/testdata/sf0.1
"""

from __future__ import annotations

import json
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import functions as F

from workload.session import local_session


def size(folder: str) -> int:
    return sum(f.stat().st_size for f in Path(folder).rglob("part-*"))


def main(sf_dir: str) -> None:
    spark = local_session()
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    root = tempfile.mkdtemp(prefix="lendmend-storage-")
    lines.write.option("header", "true").csv(f"{root}/text")
    lines.write.parquet(f"{root}/parquet")
    readers = {
        "text": lambda: spark.read.schema(lines.schema).option("header", "true").csv(f"{root}/text"),
        "parquet": lambda: spark.read.parquet(f"{root}/parquet"),
    }
    out = {}
    for name, read in readers.items():
        best = 1e9
        for _ in range(5):
            start = time.perf_counter()
            read().groupBy("l_returnflag").agg(F.sum("l_extendedprice")).collect()
            best = min(best, time.perf_counter() - start)
        out[name] = {"bytes": size(f"{root}/{name}"), "seconds": round(best, 3)}
    print(json.dumps(out))


if __name__ == "__main__":
    main(sys.argv[1])
