import random

from pyspark.sql import functions as F

from docmill.streaming import windows

SCHEMA = "k int, ts timestamp, v string"


def rows_of(spark, rows, folder):
    df = spark.createDataFrame([(k, s, v) for k, s, v in rows], "k int, s long, v string")
    df.select("k", F.timestamp_seconds("s").alias("ts"), "v").coalesce(1).write.parquet(folder)


def test_recent_turns_of_a_user_of_several_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(1, s, f"v{s}") for s in range(25_000)] + [(2, s, f"w{s}") for s in range(5)] + [(3, 7, x) for x in "cab"] + [(3, None, "z"), (3, 9, None)]
    rng.shuffle(rows)
    rows_of(spark, rows, f"{tmp_path}/in")
    stream = windows.event_stream(spark, f"{tmp_path}/in", "*.parquet", SCHEMA)
    got = {r.k: (r.turns, ",".join(r.recent)) for r in windows.drained(windows.recent_by_user(stream, "k", "ts", "v"), "t", "update", "k").collect()}
    assert got == {1: (25_000, ",".join(f"v{s}" for s in range(24_988, 25_000))), 2: (5, "w0,w1,w2,w3,w4"), 3: (5, "a,b,c,z")}


def test_recent_turns_over_triggers(spark, tmp_path):
    """Values that hold a comma stay whole in the state, and late rows find their place."""
    for i, rows in enumerate(([(1, 10, "a,b"), (1, 30, "c")], [(1, 20, "d")], [(1, 40, "e"), (1, 5, "x")])):
        rows_of(spark, rows, f"{tmp_path}/in/p={i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/in")
    got = [(r.turns, r.recent) for r in windows.drained(windows.recent_by_user(stream, "k", "ts", "v", 4), "t", "update", "k").collect()]
    assert got == [(5, ["a,b", "d", "c", "e"])]


def test_late_rows_are_left_out_and_windows_close(spark):
    """One trigger a row group: rows of a closed window are dropped, those within the delay are not."""
    rows = [(1, 0, "a", 0), (1, 3000, "b", 0), (1, 8000, "c", 1), (1, 8100, "c", 2), (1, 100, "late", 3), (1, 7900, "in time", 3), (1, 20_000, "d", 4), (1, 20_100, "d", 5)]
    df = spark.createDataFrame(rows, "k int, s long, v string, batch int").select("k", F.timestamp_seconds("s").alias("ts"), "v", "batch")
    found = windows.drained(windows.windowed(windows.arriving(df, "batch", 6, files=1), "ts", ["k"], "batch"), "w")
    got = {int(r.window_start.timestamp()): r.n for r in found.collect()}
    assert got == {0: 2, 7200: 3}


def test_a_table_of_part_files(spark, tmp_path):
    spark.createDataFrame([(1, 10, "x"), (2, 20, "y")], "k int, s long, v string").select("k", F.timestamp_seconds("s").alias("ts"), "v").repartition(2).write.parquet(f"{tmp_path}/events.parquet")
    stream = windows.event_stream(spark, str(tmp_path), schema=SCHEMA)
    got = windows.drained(windows.recent_by_user(stream, "k", "ts", "v"), "t", "update", "k").collect()
    assert sorted((r.k, r.recent) for r in got) == [(1, ["x"]), (2, ["y"])]
