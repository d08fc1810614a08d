import duckdb
import pytest

import __spark_entry__ as entry
from cardiolake.plans import catalog


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def cells(frame):
    out = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("null" if v is None or v != v else (f"{v:.6g}" if isinstance(v, float) else str(v)) for v in row) for row in out.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - {"group_benchmark"}))
def test_other_queries_run(spark, sf_dir, name):
    out = catalog.queries()[name](spark, sf_dir)
    assert out.count() > 0
    if "error" in out.columns:
        assert out.where("error IS NOT NULL").count() == 0


def test_streaming_windows(spark, sf_dir, tmp_path):
    import os
    import shutil

    from pyspark.sql import functions as F

    from cardiolake.streaming import events as ev

    os.makedirs(tmp_path / "in")
    for name in ("a", "b"):  # the same events twice
        shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "in" / f"{name}.parquet")
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")

    def rows(name, make):
        stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(180)
        return spark.table(name)

    rates = rows("rates", lambda s: ev.window_rates(ev.deduplicated(s, "1000 days"), "1 day", delay=None))
    assert rates.count() == 0 or rates.agg(F.max("n")).first()[0] <= batch.count()
    plain = rows("plain", lambda s: ev.window_rates(s, "1 day"))
    assert plain.agg(F.sum("n")).first()[0] > batch.count()
    assert rows("sessions", lambda s: ev.sessions(s)).count() > 0
    gaps = rows("gaps", lambda s: ev.running_intervals(s))
    assert gaps.count() == 2 * batch.count() and gaps.where("rr_s IS NULL").count() == batch.select("user_id").distinct().count()
