import random

from pyspark.sql import functions as F

from lorebase.sources import capture
from lorebase.streaming import ingest
from lorebase.streaming.kept_table import KeptTable
from tests.test_library import source_lines

SCHEMA = "k string, at int, h string, v string"


def rows_of(df):
    return {r["k"]: (r["at"], r["h"], r["v"]) for r in df.collect()}


def plain(rows):
    """The table of all rows, by a loop: latest time (none is the oldest), then hash."""
    held = {}
    for k, at, h, v in rows:
        if k is not None and (k not in held or (at is not None, at or 0, h) > (held[k][0] is not None, held[k][0] or 0, held[k][1])):
            held[k] = (at, h, v)
    return held


def test_any_order_of_batches_gives_the_batch_result(spark, tmp_path):
    rng = random.Random(5)
    kept = KeptTable(spark, str(tmp_path / "t"), SCHEMA, "k", "at", "h")
    every = []
    for n in range(9):
        batch = []
        for _ in range(rng.randint(0, 12)):
            v = f"v{rng.randint(0, 3)}"
            batch.append((rng.choice([None, "hot", *map(str, range(20))]), rng.choice([None, *range(6)]), "h" + v, v))
        if n == 4:
            batch = list(every)  # all that came before, again
        before = plain(every)
        every += batch
        done = kept.apply(spark.createDataFrame(batch, SCHEMA).withColumn("extra", F.lit(1)), n)
        after = plain(every)
        assert rows_of(kept.current()) == after
        assert done["new"] == len(after.keys() - before.keys()) and done["seen"] == sum(b[0] is not None for b in batch)
        assert done["changed"] + done["restated"] == sum(before[k] != after[k] for k in before)
        if n == 4:
            assert done["new"] == done["changed"] == done["restated"] == done["bytes"] == 0
        assert kept.apply(spark.createDataFrame(batch[:1], SCHEMA), n)["repeated"]
    assert kept.current().count() == len(after) and kept.manifest()["batches"] == {"stream": 8}
    kept.vacuum()
    assert rows_of(kept.current()) == after


def test_bytes_grow_with_the_batch(spark, tmp_path):
    kept = KeptTable(spark, str(tmp_path / "t"), SCHEMA, "k", "at", "h")
    made = lambda n, at: spark.range(n).select(F.col("id").cast("string").alias("k"), F.lit(at).alias("at"), F.sha2(F.concat("id", F.lit(at)), 256).alias("h"), F.sha2(F.concat(F.lit(at), "id"), 512).alias("v"))
    first = kept.apply(made(40000, 0))
    later = [kept.apply(made(400, at)) for at in range(1, 9)]
    assert all(x["changed"] == 400 and x["bytes"] < 0.04 * first["bytes"] for x in later)
    assert sum(x["merged_bytes"] for x in later) < 0.1 * first["bytes"] and len(kept.manifest()["segments"]) < 6
    assert kept.current().where("at = 8").count() == 400 and kept.current().count() == 40000


def test_a_failed_batch_is_taken_in_when_it_runs_again(spark, tmp_path):
    seen = []

    def fails(found):
        seen.append(found.count())
        if len(seen) == 2:
            raise RuntimeError("lost")

    kept = KeptTable(spark, str(tmp_path / "t"), SCHEMA, "k", "at", "h", change=fails)
    batch = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    kept.apply(batch(("a", 1, "x", "x")), 0)
    try:
        kept.apply(batch(("a", 2, "y", "y"), ("b", 1, "x", "x")), 1)
        raise AssertionError("it should have failed")
    except RuntimeError:
        pass
    assert rows_of(kept.current()) == {"a": (1, "x", "x")}
    assert kept.apply(batch(("a", 2, "y", "y"), ("b", 1, "x", "x")), 1)["new"] == 1
    assert rows_of(kept.current()) == {"a": (2, "y", "y"), "b": (1, "x", "x")} and seen == [1, 2, 2]
    assert kept.apply(batch(), 2)["bytes"] == 0 and kept.current().count() == 2


def test_stream_into_a_kept_table(spark, tmp_path):
    source = tmp_path / "in"
    schema = capture.normalise(spark.createDataFrame([], capture.ITEM)).schema
    writer = lambda **more: KeptTable(spark, str(tmp_path / "t"), schema, prepare=capture.normalise, **more)
    run = lambda w, **more: ingest.ingest(spark, str(source), "", str(tmp_path / "check"), writer=w, **more)
    source_lines(source, "1.json", (1, "hello", 0), (2, "two", 0), (1, "hello again", 1))
    assert run(writer())["new"] == 2
    source_lines(source, "2.json", (2, "late", 0), (1, "early", 0), (3, "three", 5))
    assert run(writer())["new"] == 1 and run(writer())["batches"] == 0
    read = capture.read_items(spark, str(source))
    want = {r["status_id"]: r["text"] for r in KeptTable(spark, str(tmp_path / "x"), schema).last_of(read).collect()}
    assert {r["status_id"]: r["text"] for r in writer().current().collect()} == want and want["1"] == "hello again"
    for n in range(3, 9):
        source_lines(source, f"{n}.json", (1, "t", 0))
    assert run(writer(), stop_after=2, files=1)["stagnant"] >= 2
