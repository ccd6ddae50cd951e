"""Landing with versions, deferred commits as state, the outbox, the lease, bursts and progress of streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from quire.streaming import files, lease, outbox, progress


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def collected(df):
    return sorted(map(tuple, df.collect()))


def test_commits_wait_for_their_page_across_a_restart(spark, tmp_path):
    noise = frame(spark, [(1, "g-1", 0), (1, "g-5", 1), (2, "g-0", 0), (1, "g-2", 0)], "doc_id long, seg_id string, page_idx int")
    pages = frame(spark, [(1, 1)], "doc_id long, page_idx int")
    out, schema = str(tmp_path / "out"), pages.schema
    progress.deliver(noise.where("seg_id <> 'g-2'"), f"{tmp_path}/noise", 1)
    progress.deliver(pages, f"{tmp_path}/in", 1)
    run = lambda: progress.bypass_commits(progress.arrivals(spark, noise.schema, f"{tmp_path}/noise", 1), progress.arrivals(spark, schema, f"{tmp_path}/in", 1), out)
    first = collected(run())
    assert [r[:3] for r in first] == [(1, "g-5", 1)]
    # the page of g-1 gets a translation, twice; g-2 comes only after it; page 0 of document 2 never does
    progress.deliver(frame(spark, [(1, 0), (1, 0), (1, 1)], "doc_id long, page_idx int"), f"{tmp_path}/in", 1)
    second = collected(run())
    assert [r[:3] for r in second] == [(1, "g-1", 0), (1, "g-5", 1)] and second[0][3] > first[0][3]
    progress.deliver(noise.where("seg_id = 'g-2'"), f"{tmp_path}/noise", 1)
    third = collected(run())
    assert [r[:3] for r in third] == [(1, "g-1", 0), (1, "g-2", 0), (1, "g-5", 1)] and third[1][3] > second[0][3]
    assert collected(run()) == third  # nothing new


def test_ties_inside_an_epoch_and_folds(spark, tmp_path):
    path, schema = str(tmp_path / "out"), "doc_id long, seg_id string, n int, translated string"
    keys = ["doc_id", "seg_id"]

    def deliver(rows):
        progress.deliver(frame(spark, rows, schema), f"{tmp_path}/in", 1)
        progress.land(progress.arrivals(spark, frame(spark, [], schema).schema, f"{tmp_path}/in", 1), path, compact=(3, keys, ["n"]))

    now = lambda: {r.seg_id: r.translated for r in progress.landed(spark, path, keys, ["translated"], ["n"]).collect()}
    deliver([(1, "a", 2, "later"), (1, "a", 1, "early"), (1, "b", 1, "b")])
    assert now() == {"a": "later", "b": "b"}
    want = {"a": "later", "b": "b"}
    for i in range(7):
        deliver([(1, "a", 0, f"a{i}"), (1, f"c{i}", 0, "c")])
        want |= {"a": f"a{i}", f"c{i}": "c"}
        assert now() == want
    assert files.numbered(spark, f"{path}/base", "upto") == [2, 5] and len(files.numbered(spark, f"{path}/rows", "epoch")) == 8
    read = {f.split("/")[-2] for f in progress._latest(spark, path, keys, ["n"]).inputFiles()}
    assert read == {"upto=5", "epoch=6", "epoch=7"}  # reads don't grow with epochs
    assert progress.expire(spark, path) == 6 and now() == want
    deliver([(1, "a", 0, "last")])
    assert now() == want | {"a": "last"}


def test_place_decides_without_an_order(spark, tmp_path):
    rows = frame(spark, [(1, str(i)) for i in range(50)], "k int, v string").coalesce(1)
    rows.write.parquet(f"{tmp_path}/in")
    progress.land(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), str(tmp_path / "out"))
    assert progress.landed(spark, str(tmp_path / "out"), ["k"], ["v"]).first().v == "49"


def test_outbox_numbers_without_gaps(spark, tmp_path):
    path, schema = str(tmp_path / "box"), "id long, v string"
    late, reader = outbox.Reader(spark, path, "late"), outbox.Reader(spark, path, "r")
    assert reader.poll() == (None, 0)
    seen, n = [], 0
    for size in (5, 0, 40, 1):
        if size:
            progress.deliver(frame(spark, [(i, "x") for i in range(n, n + size)], schema), f"{tmp_path}/in", 3)
            n += size
        outbox.publish(progress.arrivals(spark, frame(spark, [], schema).schema, f"{tmp_path}/in", 3), path)
        found, last = reader.poll()
        got = sorted((r.seq, r.id) for r in found.collect()) if found is not None else []
        seen += got
        if size != 40:  # as if the reader had failed before its commit: it gets them again
            reader.commit(last)
    again = [s for s in seen if s[0] > 5][:40]
    assert [s[0] for s in sorted(set(seen))] == list(range(1, n + 1)) and len(seen) == n + len(again) and len({s[1] for s in seen}) == n
    found, last = late.poll()
    assert sorted((r.seq, r.id) for r in found.collect()) == sorted(set(seen)) and last == n
    before = collected(outbox.events(spark, path))
    outbox.number(frame(spark, [(99, "other")], schema), path, 0)  # an epoch that is there is left alone
    files.clear(spark, f"{path}/ranges")
    assert collected(outbox.events(spark, path)) == before
    assert [r.seq for r in outbox.events(spark, path, 3, 6).orderBy("seq").collect()] == [4, 5, 6]


def test_one_run_across_sessions(spark, tmp_path):
    now = [100.0]
    take = lambda who: lease.Lease(spark.newSession(), str(tmp_path), who, 60, lambda: now[0])
    first = take("first")
    with pytest.raises(lease.Held, match="first holds"):
        take("second")
    now[0] += 50
    first.check()  # renewed
    now[0] += 50
    with pytest.raises(lease.Held):
        take("second")
    now[0] += 61
    second = take("second")
    assert second.token == first.token + 1
    with pytest.raises(lease.Held, match="later holder"):
        first.check()
    rows = frame(spark, [(1, 1)], "k int, v int")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="later holder"):  # a run that was thought dead commits nothing
        progress.land(stream, str(tmp_path / "out"), lease=first)
    assert not files.numbered(spark, str(tmp_path / "out" / "rows"), "epoch")
    progress.land(stream, str(tmp_path / "out"), lease=second)
    assert files.numbered(spark, str(tmp_path / "out" / "rows"), "epoch") == [0]
    second.release()
    with take("third") as third:
        assert third.token == 3
    assert take("fourth").token == 4


def test_bursts(spark, tmp_path):
    at = lambda ms: datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)
    schema = "k long, ts timestamp, v string, i int"
    rows = [(1, at(0), "a", 1), (1, at(250), "b", 2), (1, at(250), "c", 3), (1, at(900), "d", 4), (2, at(100), "e", 5)]
    table = progress.debounced(frame(spark, rows, schema), "k", "ts", ["v"], order="i")
    want = [(1, at(0), at(250), 3, "c"), (1, at(900), at(900), 1, "d"), (2, at(100), at(100), 1, "e")]
    assert collected(table) == want

    def land(part):
        progress.deliver(frame(spark, part, schema), f"{tmp_path}/in", 1)
        progress.land(progress.debounced(progress.arrivals(spark, frame(spark, [], schema).schema, f"{tmp_path}/in", 1), "k", "ts", ["v"], order="i"), str(tmp_path / "out"))
        return collected(spark.read.parquet(f"{tmp_path}/out/rows").select("k", "first_ts", "last_ts", "n", "v"))

    land(rows[:2])
    land(rows[2:])  # a burst goes on in the next micro-batch
    assert land([(9, at(60_000), "x", 0)]) == want
    assert land([(1, at(300), "late", 9), (9, at(120_000), "x", 0)])[:3] == want  # behind the watermark


def test_meter_tells_of_each_batch(spark, tmp_path):
    import time

    rows = frame(spark, [(i,) for i in range(30)], "i int")
    stream = progress.delivered(rows, f"{tmp_path}/in", "i", 3, width=1)
    seen = []
    meter = progress.Meter("metered", 30, lambda done, total, speed: seen.append((done, total, speed)))
    spark.streams.addListener(meter)
    try:
        progress.land(stream, str(tmp_path / "out"), name="metered")
        for _ in range(50):
            if seen and seen[-1][0] == 30:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(meter)
    assert len(seen) == 3 and seen[-1][:2] == (30, 30) and seen == sorted(seen) and all(s > 0 for _, _, s in seen)


def test_log_as_it_grows(spark, tmp_path):
    from quire.sources import tables

    log = lambda text: (tmp_path / f"log-{len(list(tmp_path.glob('log-*')))}").write_text(text)
    run = lambda: progress.land(tables.compile_progress(spark.readStream.text(str(tmp_path / "log-*"))), str(tmp_path / "out"))
    log("start\nWorking: 1/9\n")
    run()
    log("Working:  2/9 s\nend")
    run()
    assert sorted((r.current, r.total, r.epoch) for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()) == [(1, 9, 0), (2, 9, 1)]
