"""The page registry: replay in batches equals a rebuild, batches that are run twice or stopped change nothing, entries of pages."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexaloom.streaming import registry as R

SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("title", T.StringType())])
DDL = "key string, title string, op string, at long, state string"


def rows(df):
    return {r["key"]: r["title"] for r in df.collect()}


def test_replay_in_batches(spark, tmp_path):
    rng = random.Random(3)
    made = R.Registry(spark, str(tmp_path / "r"), SCHEMA)
    assert rows(made.state()) == {} and made.version() == -1 and made.compact() == -1
    want, history = {}, []
    for batch in range(6):
        changes = [(f"k{rng.randrange(12)}", f"t{batch}-{k}", rng.choice(["upsert", "upsert", "remove"]), k, "x") for k in range(15)]
        changes += [(None, "no key", "upsert", 99, "x")]
        for key, title, op, *_ in changes[:-1]:
            want.pop(key, None)
            if op == "upsert":
                want[key] = title
        frame = spark.createDataFrame(changes, DDL).repartition(3)
        history.append(frame)
        made.apply(batch, frame)
        if batch in (1, 4):
            assert made.compact() == batch
        assert rows(made.state()) == want, batch
    for batch in (0, 3, 5):  # run again: before a snapshot, within it, and behind it
        made.apply(batch, history[batch])
        assert rows(made.state()) == want
    again = R.Registry(spark, str(tmp_path / "other"), SCHEMA)
    again.rebuild(made.state(), 5)
    assert rows(again.state()) == want and again.version() == 5
    again.apply(6, spark.createDataFrame([("k0", None, "remove", 0, "x"), ("new", "N", "upsert", 0, "x")], DDL))
    want.pop("k0", None)
    assert rows(again.state()) == want | {"new": "N"}


def test_a_stopped_batch_does_not_count(spark, tmp_path):
    made = R.Registry(spark, str(tmp_path / "r"), SCHEMA)
    made.apply(0, spark.createDataFrame([("a", "A", "upsert", 0, "x")], DDL))
    made.apply(1, spark.createDataFrame([("b", "B", "upsert", 0, "x")], DDL))
    (tmp_path / "r" / "log" / f"{1:012d}" / "_SUCCESS").unlink()
    assert rows(made.state()) == {"a": "A"}
    made.apply(1, spark.createDataFrame([("b", "B", "upsert", 0, "x")], DDL))
    assert rows(made.state()) == {"a": "A", "b": "B"}
    tie = [("a", "A2", "upsert", 5, "x"), ("a", None, "remove", 5, "x"), ("b", "B2", "upsert", None, "x"), ("b", "B3", "upsert", 1, "x")]
    made.apply(2, spark.createDataFrame(tie, DDL))
    assert rows(made.state()) == {"b": "B3"}


def test_entries(spark):
    pages = [
        ("wiki/entities/foo.md", "---\ntitle: Foo Bar\ntype: Entity\n---\nx"), ("wiki/concepts/b-c.md", "no block"), ("wiki/index.md", "---\ntitle: I\n---\n"), ("wiki/queries/q.MD", "---\ntitle: [a]\ntype: ' '\n---\n"),
        ("wiki/null.md", None), ("other/log.md", ""), ("wiki/.md", "x"),
    ]
    got = {tuple(r) for r in R.entries(spark.createDataFrame(pages, "path string, content string")).collect()}
    assert got == {
        ("entities/foo", "wiki/entities/foo.md", "Foo Bar", "entity"), ("concepts/b-c", "wiki/concepts/b-c.md", "b-c", "query"), ("queries/q", "wiki/queries/q.MD", "q", "query"), ("null", "wiki/null.md", "null", "query"),
    }


def test_streamed_batches(spark, tmp_path):
    """foreachBatch keeps the registry; a restarted stream goes on where it was."""
    source, made = tmp_path / "in", R.Registry(spark, str(tmp_path / "r"), SCHEMA)

    def run():
        stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(source))
        q = stream.writeStream.foreachBatch(lambda df, n: made.apply(n, df)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    spark.createDataFrame([("a", "A", "upsert", 0, "x"), ("b", "B", "upsert", 0, "x")], DDL).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert rows(made.state()) == {"a": "A", "b": "B"}
    made.compact()
    spark.createDataFrame([("a", None, "remove", 0, "x"), ("b", "B2", "upsert", 1, "x")], DDL).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert rows(made.state()) == {"b": "B2"} and made._complete("log") == [0, 1]
    assert made.state().where(F.col("title") == "B2").count() == 1
