import os

import pytest
from pyspark.sql import functions as F

from tidewell.streaming import incremental
from tidewell.streaming.change_log import ChangeLog, ChangeReader, give_up


def changes(spark, *rows):
    df = spark.createDataFrame([(str(i), "page", a, at) for i, a, at in rows], "content_id string, content_type string, action string, at int")
    return df.select("content_id", "content_type", "action", F.timestamp_seconds("at").alias("changed_at"))


def run(log, check, seen, **options):
    """All that is there, in batches: each row that a batch has had is put into ``seen`` with its batch."""

    def one(batch, epoch):
        seen.append((epoch, sorted((r["content_id"], r["action"], int(r["changed_at"].timestamp())) for r in batch.collect())))

    log.stream(**options).writeStream.foreachBatch(one).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()


def test_nothing_is_lost_or_repeated(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    seen = []
    assert log.pending("a")[0].count() == 0
    assert [log.append(changes(spark, (i, "index", i), (100 + i, "delete", i))) for i in range(1, 4)] == [1, 2, 3]
    run(log, str(tmp_path / "c"), seen, consumer="a")
    log.append(changes(spark, (9, "index", 9)))
    log.append(changes(spark))
    run(log, str(tmp_path / "c"), seen, consumer="a")
    run(log, str(tmp_path / "c"), seen, consumer="a")
    got = sorted(x for _, rows in seen for x in rows)
    assert got == sorted([(str(i), "index", i) for i in (1, 2, 3, 9)] + [(str(100 + i), "delete", i) for i in (1, 2, 3)])
    # a new checkpoint goes on behind what was acknowledged; another consumer begins at the beginning
    more, all_ = [], []
    log.append(changes(spark, (10, "index", 10)))
    run(log, str(tmp_path / "d"), more, consumer="a")
    run(log, str(tmp_path / "e"), all_, consumer="b")
    assert ("10", "index", 10) in [x for _, rows in more for x in rows] and ("1", "index", 1) not in [x for _, rows in more for x in rows]
    assert sum(len(rows) for _, rows in all_) == 8


@pytest.mark.parametrize("point", ["before the batch", "in the batch", "after the batch"])
def test_restarts_at_every_point(spark, tmp_path, monkeypatch, point):
    """The table is what it would be without the loss, and no change is applied twice."""
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    table, check = f"file://{tmp_path}/table", str(tmp_path / "check")
    incremental.create_table(spark.createDataFrame([("0", 0)], "id string, n int"), table, buckets=4)
    store = spark.createDataFrame([(str(i), i) for i in range(20)], "id string, n int")

    def items(batch):
        if point == "in the batch" and not os.path.exists(tmp_path / "lost"):
            open(tmp_path / "lost", "w").close()
            raise RuntimeError("lost")
        return store.join(batch.select(F.col("content_id").alias("id")).distinct(), "id", "left_semi")

    def go():
        incremental.stream_changes(log.stream("s"), table, check, items).trigger(availableNow=True).start().awaitTermination()

    log.append(changes(spark, (1, "index", 1), (2, "index", 1)))
    log.append(changes(spark, (2, "delete", 2), (3, "index", 2)))
    if point != "after the batch":
        with monkeypatch.context() as m:
            if point == "before the batch":
                m.setattr(incremental, "_manifest", lambda *a: 1 / 0)
            with pytest.raises(Exception):
                go()
    go()
    if point == "after the batch":  # published, but Spark's own commit of the batch is lost
        commits = tmp_path / "check/commits"
        last = max(int(n) for n in os.listdir(commits) if n.isdigit())
        os.remove(commits / str(last))
        if os.path.exists(commits / f".{last}.crc"):
            os.remove(commits / f".{last}.crc")
        version = incremental.current_version(spark, table)
        go()
        assert incremental.current_version(spark, table) == version
    assert sorted((r["id"], r["n"]) for r in incremental.read_table(spark, table).collect()) == [("0", 0), ("1", 1), ("3", 3)]
    log.append(changes(spark, (1, "delete", 5)))
    go()
    assert sorted(r["id"] for r in incremental.read_table(spark, table).collect()) == ["0", "3"]


def test_offsets_batches_and_trimming(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    for i in range(1, 6):
        log.append(changes(spark, (i, "index", i)))
    reader = ChangeReader(log.folder, "x", 2)
    assert reader.initialOffset() == {"segment": 0}
    assert [reader.latestOffset()["segment"] for _ in range(4)] == [2, 4, 5, 5]
    assert len(reader.partitions({"segment": 1}, {"segment": 3})) >= 2
    reader.commit({"segment": 4})
    reader.commit({"segment": 2})
    assert ChangeReader(log.folder, "x", 0).initialOffset() == {"segment": 4}
    rest, upto = log.pending("x")
    assert [r["content_id"] for r in rest.collect()] == ["5"] and upto == 5
    assert log.trim(["x", "y"]) == 0 and log.trim(["x"]) == 4
    log.acknowledge("x", upto)
    assert log.pending("x")[0].count() == 0 and log.append(changes(spark, (6, "index", 6))) == 6
    assert [r["content_id"] for r in log.latest("x").collect()] == ["6"]


def test_a_lost_writer_holds_back_those_behind_it(spark, tmp_path, monkeypatch):
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    log.append(changes(spark, (1, "index", 1)))
    os.makedirs(tmp_path / "log/_taken", exist_ok=True)
    open(tmp_path / f"log/_taken/{2:012d}", "w").close()  # taken, and then lost
    assert log.append(changes(spark, (3, "index", 3))) == 3
    assert log.pending("x")[1] == 1
    give_up(log.folder, 2)
    assert sorted(r["content_id"] for r in log.pending("x")[0].collect()) == ["1", "3"] and log.pending("x")[1] == 3
