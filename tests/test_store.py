"""The store from end to end, in a temporary folder."""

import random

import pytest

from tidemark.operators.batch import WriteBatch
from tidemark.plans import store as S
from tidemark.schema import Corruption, InvalidArgument, IOFailure

CREATE = S.Options(create_if_missing=True)


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/db"


def contents(db, snapshot=None):
    return {bytes(r.key): bytes(r.value) for r in db.state(snapshot).collect()}


def test_open_modes(spark, path):
    with pytest.raises(InvalidArgument, match="does not exist"):
        S.Store.open(spark, path)
    with S.Store.open(spark, path, CREATE), pytest.raises(IOFailure, match="lock"):
        S.Store.open(spark, path, CREATE)
    with pytest.raises(InvalidArgument, match="exists"):
        S.Store.open(spark, path, S.Options(create_if_missing=True, error_if_exists=True))
    with pytest.raises(InvalidArgument, match="does not match existing comparator"):
        S.Store.open(spark, path, S.Options(comparator="numeric_suffix"))
    with pytest.raises(IOFailure), S.Store.open(spark, path):
        S.destroy(spark, path)
    S.destroy(spark, path)
    S.destroy(spark, path)
    with pytest.raises(InvalidArgument):
        S.Store.open(spark, path)
    assert S.Options(write_buffer_size=1, max_file_size=1, block_size=1).clipped() == S.Options(write_buffer_size=64 << 10, max_file_size=1 << 20, block_size=1 << 10)


def test_reads_batches_and_recovery(spark, path):
    with S.Store.open(spark, path, CREATE) as db:
        assert db.get(b"foo") is None and contents(db) == {}
        db.put(b"foo", b"v1")
        pinned = db.snapshot()
        assert db.write(WriteBatch().put(b"foo", b"x").delete(b"foo").put(b"foo", b"v2").put(b"", b"").put(b"a\0b\xff", b"bin")) == 6
        db.delete(b"absent")
        assert db.get(b"foo") == b"v2" and db.get(b"foo", pinned) == b"v1" and db.get(b"") == b""
        assert db.multi_get([b"foo", b"nope", b"a\0b\xff"]) == {b"foo": b"v2", b"nope": None, b"a\0b\xff": b"bin"}
        db.write(WriteBatch())
        assert db.version.last_sequence == 7
    with S.Store.open(spark, path) as db:  # from log files alone
        assert db.version.last_sequence == 7 and not db.snapshots
        assert contents(db) == {b"foo": b"v2", b"": b"", b"a\0b\xff": b"bin"}
        db.write(None)
        assert not db.pending and db.property_value("x.num-files-at-level2") == "1"
        db.put(b"foo", b"v3")
    with S.Store.open(spark, path) as db:
        assert db.get(b"foo") == b"v3" and db.version.last_sequence == 8


def test_cursor(spark, path):
    with S.Store.open(spark, path, CREATE) as db:
        for k in (b"b", b"c", b"a", b"d"):
            db.put(k, b"v" + k)
        db.delete(b"b")
        cur = db.cursor(page=2)
        db.put(b"zz", b"later")
        assert list(cur) == [(b"a", b"va"), (b"c", b"vc"), (b"d", b"vd")] and not cur.valid
        assert cur.seek(b"b").key == b"c" and cur.prev().key == b"a" and not cur.prev().valid
        assert cur.seek_to_last().key == b"d" and cur.prev().key == b"c" and cur.next().key == b"d" and not cur.next().valid
        assert not cur.seek(b"e").valid and cur.seek_to_first().value == b"va"


def test_compaction_keeps_answers(spark, path):
    with S.Store.open(spark, path, CREATE) as db:
        db.put(b"k", b"original")
        s1 = db.snapshot()
        db.delete(b"k")
        s2 = db.snapshot()
        db.put(b"k", b"reborn")
        db.put(b"m", b"1")
        db.flush()
        db.put(b"k", b"newest")
        db.delete(b"m")
        db.flush()
        before = [db.get(b"k", s) for s in (s1, s2, None)]
        db.compact_range()
        assert [db.get(b"k", s) for s in (s1, s2, None)] == before == [b"original", None, b"newest"]
        db.release(s1)
        db.release(s2)
        db.put(b"l", b"2")
        db.compact_range()
        db.flush()
        db.compact_range()
        assert db.get(b"m") is None and contents(db) == {b"k": b"newest", b"l": b"2"}
        rows = sum(r.num_entries for r in db.version.runs.values())
        assert rows <= 3
        sizes = db.approximate_sizes([(b"", b"zz"), (b"z", b"a"), (b"k", b"k")])
        assert sizes[0] > 0 and sizes[1:] == [0, 0]
        assert db.property_value("x.stats").count("\n") > 3 and "--- level 6 ---" in db.property_value("x.sstables")
        assert db.property_value("num-files-at-level9") is None and db.property_value("nonsense") is None
        assert int(db.property_value("approximate-memory-usage")) == 0


def test_bulk_load_and_missing_run(spark, path):
    from pyspark.sql import functions as F

    with S.Store.open(spark, path, CREATE) as db:
        db.put(b"00000001", b"old")
        rows = spark.range(500).select(F.lpad(F.col("id").cast("string"), 8, "0").cast("binary").alias("key"), F.lit(1).alias("op"), F.col("id").cast("string").cast("binary").alias("value"), "id")
        assert db.write_df(rows, "id") == 501
        got = db.state().orderBy("key").select(F.col("seq")).collect()
        assert [r.seq for r in got] == list(range(2, 502)) and db.get(b"00000001") == b"1"
        gone = next(iter(db.version.runs.values())).path
        db.files.remove(gone)
    with pytest.raises(Corruption, match="missing files; e.g.: "):
        S.Store.open(spark, path)
    S.repair(spark, path)
    with S.Store.open(spark, path) as db:
        assert len(contents(db)) in (1, 500)


def test_repair_rebuilds_the_catalog(spark, path):
    with S.Store.open(spark, path, CREATE) as db:
        for i in range(20):
            db.put(b"key%04d" % i, b"value%04d" % i)
        db.flush()
        db.put(b"tail", b"log only")
        db.files.remove("_commits")
    S.repair(spark, path)
    with S.Store.open(spark, path) as db:
        assert db.get(b"key0007") == b"value0007" and db.get(b"tail") == b"log only" and len(contents(db)) == 21


def test_two_writers_conflict(spark, path):
    with S.Store.open(spark, path, CREATE) as db:
        db.put(b"a", b"1")
        db.catalog.commit(db.version.number + 1, next_file=50)
        with pytest.raises(IOFailure, match="another writer"):
            db.flush()
        with pytest.raises(IOFailure):
            db.put(b"b", b"2")  # after an error all writes fail


def test_model(spark, path):
    """A seeded mix of operations against a dictionary."""
    rng = random.Random(9)
    keys = [bytes(rng.choices(b"\0ab\xff", k=rng.randint(0, 3))) for _ in range(9)]
    model, pins = {}, []
    db = S.Store.open(spark, path, CREATE)
    for step in range(36):
        roll = rng.random()
        if roll < 0.55:
            batch = WriteBatch()
            for _ in range(rng.randint(1, 6)):
                k = rng.choice(keys)
                if rng.random() < 0.35:
                    batch.delete(k)
                    model.pop(k, None)
                else:
                    v = rng.randbytes(rng.randint(0, 30))
                    batch.put(k, v)
                    model[k] = v
            db.write(batch)
        elif roll < 0.65:
            db.flush()
        elif roll < 0.75:
            db.compact_range()
            assert all(contents(db, s) == m for s, m in pins)
        elif roll < 0.85:
            pins.append((db.snapshot(), dict(model)))
        else:
            db.close()
            pins = []
            db = S.Store.open(spark, path)
        if step % 6 == 5:
            assert contents(db) == model
    assert list(db.cursor(page=3)) == sorted(model.items())
    db.close()


def damaged(db, number, data):
    db.files.remove(f"_commits/{number:012d}.json")
    db.files.create(f"_commits/{number:012d}.json", data)


def three_flushes(spark, path, **options):
    with S.Store.open(spark, path, S.Options(create_if_missing=True, **options)) as db:
        for k in (b"x", b"y", b"z"):
            db.put(k, b"v" + k)
            db.flush()
    return db


def test_torn_commits(spark, path):
    db = three_flushes(spark, path)
    last = db.version.number
    whole = {n: db.files.read(f"_commits/{n:012d}.json") for n in range(1, last + 1)}
    for n in range(2, last):
        for data in (whole[n][:-9], b"", whole[n].replace(b"runs", b"rums")):
            damaged(db, n, data)
            with pytest.raises(Corruption):
                S.Store.open(spark, path)
        damaged(db, n, whole[n])
    damaged(db, last, whole[last].replace(b"runs", b"rums"))  # complete, and not what was written
    with pytest.raises(Corruption):
        S.Store.open(spark, path)
    damaged(db, last, whole[last][:-9])  # a crash while it was written
    with S.Store.open(spark, path) as db:
        assert set(contents(db)) == {b"x", b"y"}
        assert db.files.names("lost")  # the run that no commit names isn't deleted
        db.put(b"after", b"1")
        db.flush()
    with S.Store.open(spark, path) as db:
        assert set(contents(db)) == {b"x", b"y", b"after"}
        db.files.remove(f"_commits/{2:012d}.json")
    with pytest.raises(Corruption, match="missing"):
        S.Store.open(spark, path)


def test_checkpoints_shorten_the_replay(spark, path, monkeypatch):
    monkeypatch.setattr(S, "CHECKPOINT", 2)
    db = three_flushes(spark, path)
    assert any(n.endswith(".checkpoint") for n in db.files.names("_commits"))
    for n in (1, 2):  # replaced by the checkpoint
        db.files.remove(f"_commits/{n:012d}.json")
    with S.Store.open(spark, path) as db:
        assert set(contents(db)) == {b"x", b"y", b"z"} and db.version.last_sequence == 3


def test_a_crash_does_not_lock_the_store(spark, path):
    import json
    import subprocess

    gone = subprocess.Popen(["true"])
    gone.wait()
    db = three_flushes(spark, path)
    lock = lambda **x: json.dumps({"owner": "o", "host": S.socket.gethostname(), "pid": 1, "seconds": 60} | x).encode()
    db.files.create("LOCK", lock())  # a process that is there
    with pytest.raises(IOFailure, match="lock"):
        S.Store.open(spark, path)
    db.files.remove("LOCK")
    db.files.create("LOCK", lock(host="elsewhere"))
    with pytest.raises(IOFailure, match="lock"):
        S.Store.open(spark, path)
    for left in (lock(pid=gone.pid), lock(host="elsewhere", seconds=-1), b"", lock()[:20]):
        db.files.remove("LOCK")
        db.files.create("LOCK", left)
        with S.Store.open(spark, path) as again:
            assert set(contents(again)) == {b"x", b"y", b"z"}
        assert not again.files.exists("LOCK")


def test_a_lost_lease_ends_writes(spark, path):
    with S.Store.open(spark, path, S.Options(create_if_missing=True, lease=0.3)) as db:
        db.put(b"a", b"1")
        first = db.files.modified("LOCK")
        import time

        time.sleep(0.8)
        assert db.files.modified("LOCK") > first and db.lease.held()  # renewed
        db.files.remove("LOCK")
        db.files.publish("LOCK", b'{"owner": "another", "host": "h", "pid": 1, "seconds": 1e9}')
        with pytest.raises(IOFailure, match="taken over"):
            db.flush()
    assert db.files.exists("LOCK")


def test_readers_survive_compaction(spark, path):
    with S.Store.open(spark, path, S.Options(create_if_missing=True, retention=0)) as db:
        for i in range(6):
            db.put(b"k%d" % (i % 3), b"v%d" % i)
            if i % 2:
                db.flush()
        pin, cursor = db.snapshot(), db.cursor(page=1)
        cursor.seek_to_first()
        db.delete(b"k0")
        db.compact_range()
        assert [k for k, _ in cursor] == [b"k0", b"k1", b"k2"] and set(contents(db, pin)) == {b"k0", b"k1", b"k2"}
        assert db.obsolete
        cursor.close()
        assert not db.obsolete and set(contents(db)) == {b"k1", b"k2"}
        late = db.cursor()
        db.files.remove(next(iter(db.version.runs.values())).path)
        assert not late.seek_to_first().valid and isinstance(late.error, IOFailure)
        with pytest.raises(IOFailure):
            list(late)


def test_frames_survive_compaction_for_a_time(spark, path):
    with S.Store.open(spark, path, CREATE) as db:
        for v in (b"1", b"2"):
            db.write(WriteBatch().put(b"a", v).put(b"b", v))
            db.flush()
        frame = db.state()
        db.compact_range()
        assert {bytes(r.key): bytes(r.value) for r in frame.collect()} == {b"a": b"2", b"b": b"2"} and len(db.obsolete) == 2


@pytest.mark.parametrize("name", ["numeric_suffix", "reverse", "by_length"])
def test_orders(spark, path, name):
    from pyspark.sql import functions as F

    from pyspark.sql import functions as F

    from tidemark.functions import keys as K

    K.register_comparator(K.Comparator("by_length", LENGTH, len))
    with pytest.raises(ValueError):
        K.register_comparator(K.Comparator("bytewise", F.hex))
    order = K.COMPARATORS[name]
    keys = sorted([b"k%d" % i for i in (1, 2, 9, 10, 11, 100)] + [b"", b"k", b"\xff", b"k1\0"], key=order.of)
    with S.Store.open(spark, path, S.Options(create_if_missing=True, comparator=name)) as db:
        for i, k in enumerate(keys[::-1]):
            db.put(k, b"%d" % i)
            if i % 4 == 3:
                db.flush()
        for _ in range(2):
            assert [k for k, _ in db.cursor(page=2)] == keys
            assert [bytes(r.key) for r in db.scan(start=keys[2], limit=keys[7]).collect()] == keys[2:7]
            assert [bytes(r.key) for r in db.scan(start=keys[2], limit=keys[7], reverse=True).collect()] == keys[2:7][::-1]
            assert db.cursor(page=2).seek(keys[5]).key == keys[5] and db.cursor(page=2).seek(keys[5]).prev().key == keys[4]
            assert db.get(keys[3]) is not None and set(db.multi_get(keys).values()).isdisjoint({None})
            db.compact_range()
        assert db._range(list(db.version.runs.values())) == (keys[0], keys[-1])
        assert db.approximate_sizes([(keys[0], keys[-1]), (keys[-1], keys[0])])[1] == 0


def LENGTH(key):
    from pyspark.sql import functions as F

    return F.octet_length(key)


def test_runs_have_a_bounded_size(spark, path):
    from pyspark.sql import functions as F

    with S.Store.open(spark, path, S.Options(create_if_missing=True, max_file_size=1 << 20, compression="none", bloom_bits=10)) as db:
        noise = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))).cast("binary"), 512) for i in range(4)])
        rows = spark.range(12_000).select(F.lpad(F.col("id").cast("string"), 8, "0").cast("binary").alias("key"), F.lit(1).alias("op"), noise.cast("binary").alias("value"), "id")
        for part in range(2):
            db.write_df(rows.where(F.col("id") % 2 == part), "id")
        db.compact_range()
        runs = db.version.level(max(r.level for r in db.version.runs.values()))
        assert len(runs) > 4 and max(r.file_size for r in runs) < 2 << 20 and sum(r.num_entries for r in runs) == 12_000
        assert all(a.largest_key < b.smallest_key for a, b in zip(runs[:-1], runs[1:]))
        some = db.changelog(b"00000005", b"00000009").inputFiles()
        assert len(some) == 1  # the others can't hold the keys
        assert db.get(b"00000007", S.ReadOptions(verify_checksums=True)) is not None


def test_lookups_that_pass_runs_over_merge_them(spark, path, monkeypatch):
    monkeypatch.setattr(S, "LEAST_SEEKS", 3)
    with S.Store.open(spark, path, CREATE) as db:
        for v in (b"1", b"2"):
            db.write(WriteBatch().put(b"a", v).put(b"c", v))
            db.flush()
        db.seeks.clear()
        before = len(db.version.runs)
        assert before == 2
        for _ in range(3):
            assert db.get(b"b") is None
        assert db.wanted is not None
        db.put(b"d", b"x")
        assert db.wanted is None and len(db.version.runs) < before and db.get(b"a") == b"2"


def test_level_0_is_bounded(spark, path):
    with S.Store.open(spark, path, CREATE) as db:
        for i in range(14):
            db.write(WriteBatch().put(b"a", b"%d" % i).put(b"z", b"%d" % i))
            db.flush()
        assert len(db.version.level(0)) <= 9 and db.get(b"a") == b"13"


def test_repair_turns_logs_into_runs_and_sets_bad_files_aside(spark, path):
    db = three_flushes(spark, path)
    with S.Store.open(spark, path) as db:
        db.put(b"tail", b"log only")
        bad = next(iter(db.version.runs.values())).path
        db.files.remove(bad)
        db.files.create(bad, b"not parquet")
        db.files.remove("_commits")
    S.repair(spark, path)
    with S.Store.open(spark, path) as db:
        assert len(contents(db)) == 3 and db.get(b"tail") == b"log only" and not db.pending
        assert any("parquet" in n for n in db.files.names("lost"))


def test_two_writers_of_one_log(spark, path):
    from tidemark.sources import codec

    with S.Store.open(spark, path, CREATE) as db:
        db.put(b"a", b"1")
        other = WriteBatch().put(b"b", b"2").put(b"c", b"3")
        db.files.create("_log/" + f"{2:020d}.batch", codec.write_log([other.encode(2)]))
        assert db.write(WriteBatch().put(b"d", b"4")) == 4  # after the other's two
        assert contents(db) == {b"a": b"1", b"b": b"2", b"c": b"3", b"d": b"4"}


def test_runs_are_cut_by_rows_and_sorted_by_a_column(spark, path, monkeypatch):
    """Rows that take little in a file aren't one task's, whatever the order of
    keys, and no sort evaluates that order in its comparisons."""
    from pyspark.sql import functions as F

    from tidemark.functions import keys as K

    monkeypatch.setattr(S, "RUN_ROWS", 500, raising=False)
    rows = spark.range(4000).select(F.format_string("k%05d", F.col("id")).cast("binary").alias("key"), F.lit(1).alias("op"), F.lit(b"v").alias("value"), "id")
    with S.Store.open(spark, path, S.Options(create_if_missing=True, comparator="reverse")) as db:
        db.write_df(rows, "id")
        db.write_df(rows.where("id % 2 = 0").withColumn("value", F.lit(b"w")), "id")
        db.compact_range()
        runs = db.version.level(2, db.comparator.of)
        assert len(runs) > 4 and sum(r.num_entries for r in runs) == 4000 and max(r.num_entries for r in runs) < 2000
        assert all(a.smallest_key >= a.largest_key > b.smallest_key for a, b in zip(runs, runs[1:], strict=False))
        scan = db.scan()
        assert "translate" not in next(x for x in scan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Sort [" in x)
        got = [(bytes(r.key), bytes(r.value)) for r in scan.collect()]
    assert got == [(b"k%05d" % i, b"v" if i % 2 else b"w") for i in reversed(range(4000))]
    assert K.ordered_by(rows, K.COMPARATORS["bytewise"].order) == (rows, "key")
