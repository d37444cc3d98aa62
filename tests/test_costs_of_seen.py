"""The stream holds many keys in a group: Python is called for groups, and days beyond the horizon are let go of one by one."""

import datetime as dt
import random

from paperflow.session import reachable
from paperflow.streaming import seen


def test_keys_share_few_groups(spark, tmp_path):
    reachable(spark)
    rng = random.Random(8)
    days = sorted(dt.date(2023, 1, 1) + dt.timedelta(days=rng.randrange(700)) for _ in range(3000))
    rows = [(k, f"k{rng.randrange(900)}", d) for k, d in enumerate(days)]
    for part in range(3):
        spark.createDataFrame(rows[part * 1000 : part * 1000 + 1000], "id long, key string, day date").coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema("id long, key string, day date").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = seen.seen_within(stream, groups=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    assert out.awaitTermination(200)
    got = sorted(tuple(r) for r in spark.read.schema(seen.OUTPUT).parquet(str(tmp_path / "out")).collect())
    want = sorted(tuple(r) for r in seen.seen_before(spark.createDataFrame(rows, "id long, key string, day date")).collect())
    assert got == want and 0 < sum(r[3] for r in want) < 3000
    held = out.lastProgress["stateOperators"][0]["numRowsTotal"] if out.lastProgress else 0
    assert held <= 2
