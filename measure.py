"""Time what grows with a store: features by number of tickers; a full, a range and a day's rebuild.

MEASURE_SF_DIR (default /root/testdata/sf0.01), MEASURE_CPUS (default 8) and MEASURE_COPIES
(default 1,10,100: each ticker so many times) set the input; prints one JSON line a figure.
The stores are those of the first number of copies.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from datetime import timedelta

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chainsurf import adapter
from chainsurf.operators import merge
from chainsurf.plans import carry, jobs
from chainsurf.plans.features import daily_features
from chainsurf.sources import store


def seconds(work) -> float:
    began = time.time()
    work()
    return round(time.time() - began, 2)


def main() -> None:
    sf_dir, cpus = os.environ.get("MEASURE_SF_DIR", "/root/testdata/sf0.01"), os.environ.get("MEASURE_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{folder}")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chain, ohlc = adapter.chain(spark, sf_dir), adapter.ohlc(spark, sf_dir)
    all_copies = [int(n) for n in os.environ.get("MEASURE_COPIES", "1,10,100").split(",")]

    def say(name: str, work) -> None:
        print(json.dumps({"sf": os.path.basename(sf_dir), "cpus": cpus, "metric": name, "seconds": seconds(work)}), flush=True)

    daily_features(chain, ohlc).write.format("noop").mode("overwrite").save()  # the first run compiles
    for copies in all_copies:
        many = [x.crossJoin(F.broadcast(spark.range(copies))).withColumn("ticker", F.concat("ticker", F.col("id").cast("string"))).drop("id") for x in (chain, ohlc)]
        for name, df in zip(("chain", "ohlc"), many, strict=True):
            df.write.parquet(f"file://{folder}/{copies}/{name}")
        tables = [spark.read.parquet(f"file://{folder}/{copies}/{name}") for name in ("chain", "ohlc")]
        say(f"features of {3 * copies} tickers", lambda t=tables: daily_features(*t).write.format("noop").mode("overwrite").save())
    root = f"file://{folder}/store"
    chain, ohlc = (spark.read.parquet(f"file://{folder}/{all_copies[0]}/{name}") for name in ("chain", "ohlc"))
    merge.upsert_chain(chain, f"{root}/chain")
    merge.upsert_ohlc(ohlc, f"{root}/ohlc")
    last = store.read_chain(spark, f"{root}/chain").agg(F.max("trade_date")).first()[0]
    say("merge one day", lambda: merge.upsert_chain(chain.filter(F.col("trade_date") == F.lit(last)), f"{root}/chain"))
    say("rebuild full", lambda: jobs.rebuild(spark, root))
    say("rebuild 45 days", lambda: jobs.rebuild(spark, root, last - timedelta(days=45), last))
    say("add one day", lambda: carry.add_days(spark, root, last, last))
    spark.stop()


if __name__ == "__main__":
    main()
