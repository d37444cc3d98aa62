"""The stateful stream against one pass over all rows, cut into micro-batches at random."""

import datetime as dt
import random

from pyspark.sql import functions as F

from paperflow.session import reachable
from paperflow.streaming import seen


def test_replay_in_random_micro_batches(spark, tmp_path):
    reachable(spark)
    rng = random.Random(6)
    days = sorted(dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(900)) for _ in range(240))
    rows = [(k, rng.choice([None, *(f"k{j}" for j in range(25))]), d) for k, d in enumerate(days)] + [(900, "k1", None)]
    at, part = 0, 0
    while at < len(rows):
        n = rng.randint(20, 90)
        spark.createDataFrame(rows[at : at + n], "id long, key string, day date").coalesce(1).write.parquet(str(tmp_path / f"in/{part:03}"))
        at, part = at + n, part + 1
    stream = spark.readStream.schema("id long, key string, day date").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = seen.seen_within(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    assert out.awaitTermination(200)
    got = sorted((r.id, r.key, r.day, r.seen) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r.id, r.key, r.day, r.seen) for r in seen.seen_before(spark.createDataFrame(rows, "id long, key string, day date")).collect())
    assert got == want and any(r[3] for r in want) and len({r[1] for r in want if not r[3]}) == 25
    plain = []
    last = {}
    for k, key, d in rows:
        if key and d:
            plain.append((k, key, d, key in last and (d - last[key]).days <= 180))
            last[key] = max(last.get(key, d), d)
    assert sorted(plain) == want
    assert spark.createDataFrame([], "id long, key string, day date").transform(seen.seen_before).where(F.col("seen")).count() == 0
