"""Snapshots that are swapped last, and moods of changed rooms alone."""

import random

import pytest
from pyspark.sql import functions as F

from correspond.operators import mood
from correspond.sources.snapshots import Snapshots
from correspond.streaming import jobs

ROWS = "account string, person string, n long, note string"


def rows(spark, data):
    return spark.createDataFrame(data, ROWS)


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/t", ROWS, ["account"], parts=8)
    have = lambda: {(r.account, r.person): (r.n, r.note) for r in s.current().collect()}
    assert have() == {}
    first = [(f"a{k % 6}", f"p{k}", k, f"x{k}") for k in range(30)]
    assert s.merge(rows(spark, first), ["account", "person"], batch=0)
    want = {(a, p): (n, t) for a, p, n, t in first}
    before = s.pointer()
    new = [("a1", "p1", 100, None), ("a1", "p99", 5, "new")]
    assert s.merge(rows(spark, new), ["account", "person"], batch=1, keep_if_null=("note",))
    want |= {("a1", "p1"): (100, "x1"), ("a1", "p99"): (5, "new")}
    assert have() == want
    after = s.pointer()["parts"]
    assert sum(before["parts"][p] != f for p, f in after.items()) == 1  # one part was written
    assert not s.merge(rows(spark, [("a2", "p2", -1, "late")]), ["account", "person"], batch=1) and have() == want  # replayed
    assert s.merge(rows(spark, [("a3", "q", 1, None)]), ["account"], batch=0, source="other")
    assert {k for k in have() if k[0] == "a3"} >= {("a3", "q")}


def test_killed_before_the_swap(spark, tmp_path, monkeypatch):
    """The old snapshot stays the current one, and the batch can be done again."""
    s = Snapshots(spark, f"file://{tmp_path}/t", ROWS, ["account"], parts=4)
    s.merge(rows(spark, [("a", "p", 1, "old")]), ["account", "person"], batch=0)

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(s, "_swap", killed)
    with pytest.raises(KeyboardInterrupt):
        s.merge(rows(spark, [("a", "p", 2, "new")]), ["account", "person"], batch=1)
    monkeypatch.undo()
    assert [tuple(r) for r in s.current().collect()] == [("a", "p", 1, "old")]
    assert s.merge(rows(spark, [("a", "p", 2, "new")]), ["account", "person"], batch=1) and [tuple(r) for r in s.current().collect()] == [("a", "p", 2, "new")]
    assert s.vacuum(1) == 2 and [tuple(r) for r in s.current().collect()] == [("a", "p", 2, "new")]
    with pytest.raises(Exception, match="exist"):  # two writers of one number
        s._swap(s.pointer())


def test_stream_into_snapshots(spark, tmp_path):
    for k in range(3):
        rows(spark, [("a", f"p{k}", k, None), ("a", "all", k, None)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = Snapshots(spark, f"file://{tmp_path}/t", ROWS, ["account"], parts=2)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(s.sink(["account", "person"])).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert s.pointer()["batches"] == {"": 2} and s.pointer()["number"] == 2 and s.current().count() == 4
    sink = s.sink(["account", "person"])
    sink(rows(spark, [("a", "all", -9, None)]), 2)
    assert s.pointer()["number"] == 2


def test_moods_of_changed_rooms(spark, tmp_path):
    """The same as working all out again; of the rooms that did not change no message is read."""
    r = random.Random(3)
    said = ["안녕하세요!", "ㅋㅋㅋ 뭐해", "x", "이모티콘", "^^ 좋아"]
    made = [(f"o{room % 4}", f"room{room}", f"2024-0{r.randrange(1, 5)}-{r.randrange(1, 28):02d} {r.randrange(24):02d}:{r.randrange(60):02d}:00", k, f"s{r.randrange(3)}", r.choice(said)) for room in range(12) for k in range(r.randrange(5, 40))]
    schema = "owner string, chatroom_id string, at string, seq long, sender string, text string"
    messages = lambda data: spark.createDataFrame(data, schema).withColumn("dt", F.col("at").cast("timestamp_ntz"))
    private = spark.createDataFrame([("room1", "month", "2024-01", 80.0), ("room5", "year", "2024", 10.0)], "chatroom_id string, unit string, period string, private_ratio double")
    told = lambda df: {(x.chatroom_id, x.unit, x.period): x.mood_score for x in df.collect()}
    store = Snapshots(spark, f"file://{tmp_path}/moods", mood.STATS, ["owner"], parts=8)
    assert told(mood.refresh(store, messages(made), private)) == told(mood.mood_scores(messages(made), private))
    gone = [m for m in made if not (m[1] == "room5" and m[2].startswith("2024-01"))]  # a period goes, and the room gets more messages
    later = gone + [("o1", "room5", f"2024-06-01 10:{k:02d}:00", 900 + k, "s0", "ㅋㅋㅋㅋ!") for k in range(50)]
    changed = [m for m in later if m[1] == "room5"]
    got = told(mood.refresh(store, messages(changed), private))
    whole = told(mood.mood_scores(messages(later), private))
    owned = {m[1] for m in later if m[0] == "o1"}
    assert got == {k: v for k, v in whole.items() if k[0] in owned} and len({k[0] for k in got}) == 3 and {m[1] for m in changed} == {"room5"}
    assert told(mood.scores(store.current())) == whole


def test_all_sessions(spark, tmp_path):
    """After each run of a stream, the sessions of all messages so far, late ones and replays included."""
    import datetime

    r = random.Random(6)
    base = datetime.datetime(2024, 1, 1)
    said = [(f"k{r.randrange(4)}", base + datetime.timedelta(minutes=r.randrange(3000))) for _ in range(120)] + [("k9", None)]
    seen = []
    for k in range(3):
        some = said[k::3]
        seen += some
        spark.createDataFrame(some, "key string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, ts timestamp_ntz").parquet(f"{tmp_path}/in")
        for gap, minutes in (("30 minutes", 30), ("10 seconds", 1 / 6)):
            got = sorted(map(tuple, jobs.all_sessions(spark, stream, "ts", ["key"], gap, f"file://{tmp_path}/{minutes > 1}", parts=3).collect()))
            want, step, newest = [], datetime.timedelta(minutes=minutes), max(t for _, t in seen if t)
            for key in {key for key, t in seen if t}:
                for t in sorted(t for n, t in seen if n == key and t):
                    if want and want[-1][0] == key and t - want[-1][2] <= step:
                        want[-1][2:4] = t, want[-1][3] + 1
                    else:
                        want.append([key, t, t, 1])
            assert got == sorted((*w, w[2] + step > newest) for w in want)
