import pytest
from pyspark.sql import functions as F

from tessera.streaming import limits, windows


@pytest.fixture(scope="module")
def folders(spark, sf, tmp_path_factory):
    """The events in order of time, in several files that a stream takes one by one."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    path = tmp_path_factory.mktemp("events")
    bounds = sorted(r.ts for r in events.collect())
    bounds = [bounds[0], bounds[len(bounds) // 3], bounds[2 * len(bounds) // 3], None]
    for low, high in zip(bounds, bounds[1:]):
        part = events.filter(F.col("ts") >= F.lit(low))
        (part if high is None else part.filter(F.col("ts") < F.lit(high))).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return events, f"{path}/in"


def streamed(spark, folders, f, name):
    events, path = folders
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    mode = "append" if name == "limit" else "complete"
    query = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


@pytest.mark.parametrize("name", ["tumbling", "sliding", "sessions"])
def test_a_stream_gives_the_rows_of_the_table(spark, folders, name):
    f = getattr(windows, name)
    assert sorted(map(str, streamed(spark, folders, f, name).collect())) == sorted(map(str, f(folders[0]).collect()))


def test_events_just_the_gap_apart_are_two_sessions(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:29:59.999999"), (1, "2024-01-01 00:59:59.999999"), (2, "2024-01-01 00:00:00"), (2, "2024-01-01 00:30:00")]
    found = windows.sessions(spark.createDataFrame(rows, "user_id long, ts string"))
    got = sorted(tuple(map(str, r)) for r in found.collect())
    assert got == [
        ("1", "2024-01-01 00:00:00", "2024-01-01 00:59:59.999999", "2"), ("1", "2024-01-01 00:59:59.999999", "2024-01-01 01:29:59.999999", "1"),
        ("2", "2024-01-01 00:00:00", "2024-01-01 00:30:00", "1"), ("2", "2024-01-01 00:30:00", "2024-01-01 01:00:00", "1")]


def test_accepted_attempts_in_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = streamed(spark, (events, f"{tmp_path}/in"), lambda e: limits.accepted(e, 2, 86400), "limit")
    assert sorted(map(str, got.collect())) == sorted(map(str, limits.accepted(events, 2, 86400).collect()))


def test_only_accepted_attempts_count():
    assert limits._accept([0, 1, 2, 11, 12], [], 2, 10) == ([True, True, False, True, True], [11, 12])


def test_changes_are_maintained_from_a_checkpoint(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").limit(20)
    events.write.parquet(f"{tmp_path}/in")
    seen = []
    for _ in range(2):
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
        windows.maintain(stream, lambda batch, i: seen.append(batch.count()), f"{tmp_path}/checkpoint").awaitTermination(60)
    assert sum(seen) == 20


@pytest.mark.parametrize("seed", [1, 2])
def test_late_results_are_discarded_in_any_order(spark, tmp_path, seed):
    import random

    from tessera.streaming import enrichment

    rows = []
    for k in range(12):
        for version in range(1 + k % 3):
            rows.append((f"u{k}", "resource", version, f"h{k}-{version}", None))
            if (k + version) % 4:
                rows.append((f"u{k}", "result", None, f"h{k}-{version}", f"summary {k} {version}"))
    rows += [("gone", "resource", 0, "h", None), ("gone", "resource", 1, None, None), ("gone", "result", None, "h", "x"), ("waits", "result", None, "h", "y"), (None, "resource", 1, "h", None), ("u1", "other", 1, "h", None)]
    random.Random(seed).shuffle(rows)
    schema = "uri string, kind string, version long, content_hash string, result string"
    for n in range(3):
        spark.createDataFrame(rows[n::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    last = {}

    def keep(batch, _):
        last.update({r.uri: r for r in batch.collect()})

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = enrichment.enriched(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    whole = {r.uri: r for r in enrichment.enriched(spark.createDataFrame(rows, schema)).collect()}
    assert {u: tuple(r) for u, r in last.items()} == {u: tuple(r) for u, r in whole.items()} and len(whole) == 13
    assert whole["u2"].version == 2 and whole["u2"].content_hash == "h2-2" and whole["gone"].content_hash is None and whole["gone"].result is None and whole["gone"].n_discarded == 1
