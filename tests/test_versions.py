"""Snapshots, composed changes and deletion bitmaps next to plain replays."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.config import FILE_STATUSES
from shelfspark.operators import dml, versions
from shelfspark.schema import FILE_EVENTS
from shelfspark.storage import fresh_path

ATTRIBUTES = dml.FILE_ATTRIBUTES


def random_events(rnd, seq):
    rows = []
    for file_id in rnd.sample([f"f{i}" for i in range(12)], 5):
        row = {"file_id": file_id, "seq": seq, "op": rnd.choice(["update", "update", "add", "delete"])}
        for name in ATTRIBUTES:
            if rnd.random() < 0.4:
                row[name] = rnd.randrange(99) if name in versions.SIZES else f"{name}{rnd.randrange(9)}"
        rows.append(row)
    return rows


def events(spark, rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in FILE_EVENTS) for r in rows], FILE_EVENTS)


def state(df):
    names = ["file_id", *ATTRIBUTES, "deleted"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_state_as_of_every_change(spark):
    """The log agrees with a fold of all events at each change, whatever was compacted."""
    rnd = random.Random(2)
    log = versions.file_log(spark, fresh_path(spark, "log"))
    assert log.read() is None and log.compact() is None
    done, rows = [], []
    for seq in range(1, 7):
        new = random_events(rnd, seq)
        rows += new
        log.append(events(spark, new), seq)
        done.append(list(rows))
        if seq in (2, 5):
            assert log.compact() == seq and log.compact() is None
    for seq, upto in enumerate(done, 1):
        assert state(log.read(as_of=seq)) == state(dml.fold_files(events(spark, upto))), seq
    log.append(events(spark, rows[-5:]), 6)  # a change that is written again
    assert state(log.read()) == state(dml.fold_files(events(spark, rows)))


def test_a_broken_snapshot_is_not_read(spark):
    log = versions.file_log(spark, fresh_path(spark, "log"))
    log.append(events(spark, [{"file_id": "a", "op": "add", "status": "gray"}]), 1)
    log.append(events(spark, [{"file_id": "a", "op": "update", "status": "green"}]), 2)
    half = spark.createDataFrame([("junk", 0)], "file_id string, bucket int")
    half.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{log.path}/snapshots/n=2")
    assert [(r["file_id"], r["status"]) for r in log.read().collect()] == [("a", "green")]
    assert log.compact() == 2
    assert [(r["file_id"], r["status"]) for r in log.read().collect()] == [("a", "green")]


def test_look_up_reads_the_buckets_of_the_keys(spark):
    log = versions.file_log(spark, fresh_path(spark, "log"))
    log.append(events(spark, [{"file_id": f"f{i}", "op": "add", "status": "gray"} for i in range(200)]), 1)
    only = spark.createDataFrame([("f7",)], "file_id string")
    found = log.read(only=only)
    assert [r["file_id"] for r in found.collect()] == ["f7"]
    assert "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().executedPlan().toString()


def test_kb_log(spark):
    log = versions.kb_log(spark, fresh_path(spark, "log"))
    schema = "kb_id string, user_id string, seq long, op string, kb_name string"
    log.append(spark.createDataFrame([("k", "u", 1, "add", "one"), ("l", "u", 1, "add", "x")], schema), 1)
    log.append(spark.createDataFrame([("k", "u", 2, "rename", "two"), ("l", "u", 2, "delete", None)], schema), 2)
    got = {r["kb_id"]: (r["kb_name"], r["deleted"]) for r in log.read().collect()}
    assert got == {"k": ("two", 0), "l": ("x", 1)}
    assert {r["kb_id"]: r["kb_name"] for r in log.read(as_of=1).collect()} == {"k": "one", "l": "x"}


def replay(files, changes):
    out = dict(files)
    for file_id, _, old, new in sorted(changes):
        if out.get(file_id) == old:
            out[file_id] = new
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_composed_changes_equal_a_replay(spark, seed):
    rnd = random.Random(seed)
    files = {f"f{i}": rnd.choice(FILE_STATUSES) for i in range(8)}
    names = [*files, *["f0"] * 60, "nobody"]  # most changes are to one file
    changes = [(rnd.choice(names), rnd.randrange(400), rnd.choice(FILE_STATUSES), rnd.choice(FILE_STATUSES)) for _ in range(700)]
    df = spark.createDataFrame([(*f, "n") for f in files.items()], "file_id string, status string, file_name string")
    rows = spark.createDataFrame(changes, "file_id string, seq int, old string, new string").repartition(6)
    got = {r["file_id"]: r["status"] for r in versions.compose_swaps(df, rows).collect()}
    assert got == replay(files, changes)


def test_composed_changes_are_many_tasks(spark):
    changes = spark.range(5000).select(
        F.lit("hot").alias("file_id"), F.col("id").alias("seq"),
        F.element_at(F.array(*map(F.lit, FILE_STATUSES)), (F.col("id") % 4 + 1).cast("int")).alias("old"),
        F.element_at(F.array(*map(F.lit, FILE_STATUSES)), ((F.col("id") + 1) % 4 + 1).cast("int")).alias("new"),
    )
    files = spark.createDataFrame([("hot", "green"), ("cold", "odd")], "file_id string, status string")
    got = {r["file_id"]: r["status"] for r in versions.compose_swaps(files, changes).collect()}
    assert got == {"hot": FILE_STATUSES[5000 % 4], "cold": "odd"}


@pytest.fixture
def table(spark):
    table = versions.VectorTable(spark, fresh_path(spark, "table"))
    schema = "user_id string, kb_id string, file_id string, chunk_idx int, embedding array<float>"
    for part in range(3):
        rows = [(f"u{i % 2}", f"k{i % 5}", f"p{part}f{i // 4}", i % 4, [float(i)]) for i in range(200)]
        table.append(spark.createDataFrame(rows, schema).coalesce(2))
    return table


def rows_of(table):
    return sorted((r["file_id"], r["chunk_idx"], r["user_id"]) for r in table.read().collect())


def stored(table):
    return sorted(r[0] for r in table._placed().select("_file").distinct().collect())


def test_deleted_rows_are_marked_not_rewritten(spark, table):
    before, files = rows_of(table), stored(table)
    asked = spark.createDataFrame([("p0f3",), ("p1f0",), ("absent",)], "file_id string")
    table.delete(asked)
    left = [r for r in before if r[0] not in ("p0f3", "p1f0")]
    assert rows_of(table) == left and stored(table) == files
    table.delete(asked)
    table.delete_kbs(spark.createDataFrame([("k1",)], "kb_id string"))
    # Files of four chunks: each fifth has none in the base.
    rest = [r for r in left if "k1" not in {f"k{(4 * int(r[0].split('f')[1]) + i) % 5}" for i in range(4)}]
    assert rest and rows_of(table) == rest and stored(table) == files
    assert versions.VectorTable(spark, table.path + "-none").read() is None


def test_compaction_rewrites_worn_files_only(spark, table):
    gone = [(f"p0f{i}",) for i in range(40)] + [("p1f0",)]
    table.delete(spark.createDataFrame(gone, "file_id string"))
    before, files = rows_of(table), stored(table)
    rewritten = table.compact(0.5)
    after = stored(table)
    assert 0 < rewritten < len(files) and len(set(files) - set(after)) == rewritten
    assert rows_of(table) == before
    assert table.compact(0.5) == 0
    table.delete(spark.createDataFrame([("p0f45",)], "file_id string"))  # in a rewritten file
    assert rows_of(table) == [r for r in before if r[0] != "p0f45"]


def test_a_compaction_that_dies_changes_nothing(spark, table):
    table.delete(spark.createDataFrame([(f"p0f{i}",) for i in range(50)], "file_id string"))
    before = rows_of(table)
    half = table.read().where("file_id like 'p1%'")
    half.write.partitionBy("user_id").parquet(table._next("retired").replace("/retired/", "/rewritten/"))
    assert rows_of(table) == before
    table.compact(0.5)
    assert rows_of(table) == before
