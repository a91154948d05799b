"""Resolution, compaction and batches against plain Python; plans."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import keys as K
from tidemark.operators import batch, compaction, resolve

CHANGES = "key binary, seq long, op int, value binary"


def frame(spark, rows):
    return spark.createDataFrame([(bytearray(k), s, o, bytearray(v)) for k, s, o, v in rows], CHANGES)


def model_state(rows, snapshot):
    out = {}
    for k, s, o, v in sorted(rows, key=lambda r: r[1]):
        if s <= snapshot:
            out[k] = (o, v)
    return {k: v for k, (o, v) in out.items() if o}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(ops=st.lists(st.tuples(st.sampled_from([b"", b"a", b"a\0", b"\xff", b"b"]), st.integers(0, 1), st.binary(max_size=3)), max_size=25), at=st.integers(0, 25))
def test_state_and_compaction(spark, ops, at):
    rows = [(k, i + 1, o, v if o else b"") for i, (k, o, v) in enumerate(ops)]
    df = frame(spark, rows)
    got = {bytes(r.key): bytes(r.value) for r in resolve.state_at(df, at).collect()}
    assert got == model_state(rows, at)
    kept = [(bytes(r.key), r.seq, r.op, bytes(r.value)) for r in compaction.compact(df, at).collect()]
    for later in (at, 25):
        assert model_state(kept, later) == model_state(rows, later)
    assert len(kept) <= len(rows)


def test_as_of_join(spark):
    rng = random.Random(4)
    rows = [(b"k%d" % rng.randrange(5), s, rng.randrange(2), b"v%d" % s) for s in rng.sample(range(1, 1 << 22), 60)]
    probes = [(b"k%d" % rng.randrange(6), rng.randrange(1 << 22), i) for i in range(40)]
    df = spark.createDataFrame([(bytearray(k), s, i) for k, s, i in probes], "key binary, snapshot long, id int")
    got = {r.id: r.value and bytes(r.value) for r in resolve.as_of_join(frame(spark, rows), df).collect()}
    assert got == {i: model_state(rows, s).get(k) for k, s, i in probes}


def test_predicates_stand_on_the_right_side(spark, tmp_path):
    df = frame(spark, [(b"a", 1, 1, b"x"), (b"a", 2, 0, b""), (b"b", 3, 1, b"y")])
    df.write.parquet(str(tmp_path / "run"))
    plan = resolve.get(spark.read.parquet(str(tmp_path / "run")), bytearray(b"a"), 9)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "EqualTo(key" in pushed and "LessThanOrEqual(seq,9)" in pushed and "EqualTo(op" not in pushed
    assert not resolve.get(df, bytearray(b"a"), 9).count()


def test_rule_b_respects_deeper_levels(spark):
    df = frame(spark, [(b"a", 1, 0, b""), (b"m", 2, 0, b""), (b"z", 9, 0, b"")])
    deeper = spark.createDataFrame([(bytearray(b"k"), bytearray(b"n"))], "smallest_key binary, largest_key binary")
    kept = compaction.compact(df, 5, bottom=False, deeper=deeper).collect()
    assert sorted(bytes(r.key) for r in kept) == [b"m", b"z"]


def test_batches(spark):
    one = batch.WriteBatch().put(b"foo", b"bar").delete(b"box").put(b"foo", b"baz")
    two = batch.WriteBatch().put(b"q", b"")
    joined = batch.append(one.to_df(spark, 1), two.to_df(spark, 1)).orderBy("ord").collect()
    assert [(r.ord, r.op, bytes(r.key)) for r in joined] == [(0, 1, b"foo"), (1, 0, b"box"), (2, 1, b"foo"), (3, 1, b"q")]
    seen = []
    one.append(two).iterate(lambda k, v: seen.append((k, v)), lambda k: seen.append(k))
    assert seen == [(b"foo", b"bar"), b"box", (b"foo", b"baz"), (b"q", b"")]
    assert batch.WriteBatch.decode(one.encode(5))[0] == 5 and one.approximate_size() > 12
    one.clear()
    assert len(one) == 0


def test_key_encodings_keep_order(spark):
    numbers = [-(1 << 63), -5, -1, 0, 1, 77, (1 << 63) - 1]
    doubles = [float("-inf"), -1e300, -2.5, -1e-310, 0.0, 1e-310, 1.0, 1.5, 2.0, 3e200, float("inf")]
    texts = ["", "a", "a\0", "a\0b", "ab", "é", "😀"]
    for values, kind, encode in ((numbers, "long", K.encode_int), (doubles, "double", K.encode_double), (texts, "string", K.encode_text)):
        df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"v {kind}, i int")
        coded = [bytes(r.c) for r in df.select("i", encode(F.col("v")).alias("c")).orderBy("i").collect()]
        assert coded == sorted(coded) and len(set(coded)) == len(coded)


def test_streams_and_sources(spark, tmp_path):
    from tidemark.sources import codec, datasources
    from tidemark.streaming import tail

    folder = str(tmp_path / "changes")
    rows = [(b"a", 1, 1, b"x"), (b"a", 3, 0, b""), (b"b", 5, 1, b"new"), (b"b", 2, 1, b"late")]
    for part in (rows[:3], rows[3:]):
        frame(spark, part).withColumn("op", F.col("op").cast("byte")).write.mode("append").parquet(folder)
    q = tail.live_view(tail.read_changes(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("live_view").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {bytes(r.key): (r.seq, r.op) for r in spark.table("live_view").collect()}
    assert got == {b"a": (3, 0), b"b": (5, 1)}

    datasources.register(spark)
    wire = tmp_path / "wire"
    wire.mkdir()
    (wire / "000005.ldb").write_bytes(codec.write_table([(k, s, o, v) for k, s, o, v in sorted(rows, key=lambda r: codec.internal_order(*r[:3]))], policy=codec.BloomPolicy()))
    (wire / "000007.log").write_bytes(codec.write_log([codec.encode_batch(10, [(1, b"c", b"1"), (0, b"a", b"")])]))
    (wire / "MANIFEST-000002").write_bytes(codec.write_log([codec.encode_edit({"comparator": "bytewise", "added": [(0, 5, 99, codec.encode_key(b"a", 1, 1), codec.encode_key(b"b", 5, 1))]})]))
    both = spark.read.format("wire_table").load(str(wire)).unionByName(spark.read.format("wire_batches").load(str(wire)))
    assert {bytes(r.key): bytes(r.value) for r in resolve.state_at(both).collect()} == {b"b": b"new", b"c": b"1"}
    assert spark.read.format("wire_log").load(str(wire)).first().crc_ok
    assert spark.read.format("wire_catalog").load(str(wire)).first().added[0].file_size == 99
    assert {r.kind for r in datasources.listing(spark, f"file://{wire}").collect()} == {"table", "log", "catalog"}


def test_positions_at_size(spark):
    """Wide rows and more ranges than one sample shows."""
    rows = spark.range(0, 500_000, 1, 16).select(F.concat(F.lit("k"), F.xxhash64("id").cast("string")).alias("key"), F.repeat(F.lit("v"), 60).alias("value"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = resolve.positions(rows, F.col("key").desc())
        assert got.columns == ["key", "value", "pos"]
        x = got.agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.countDistinct("pos").alias("n")).first()
        assert (x.a, x.b, x.n) == (1, 500_000, 500_000)
        sample = [r.key for r in got.where("pos % 9973 = 0").orderBy("pos").collect()]
        assert sample == sorted(sample, reverse=True)
        least = got.orderBy("key").first()
        assert least.pos == 500_000
        probes = got.where("pos % 25000 = 0").select(F.concat("key", F.lit("!")).alias("target"), F.col("pos").alias("p"))
        changes = rows.select("key", F.lit(1).alias("seq"), F.lit(1).alias("op"), "value")
        found = {r.p: r.found for r in resolve.seek_each(changes, probes).collect()}
        after = {r.pos + 1: r.key for r in got.where("pos % 25000 = 24999").collect()}
        assert found == after
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert resolve.positions(rows.where("1 = 0"), "key").count() == 0


def test_wire_sinks(spark, tmp_path):
    import pytest

    from tidemark.schema import Corruption
    from tidemark.sources import codec, datasources

    datasources.register(spark)
    folder = str(tmp_path / "tables")
    rows = frame(spark, [(b"k%03d" % (i % 50), i + 1, int(i % 7 != 0), b"v%d" % i) for i in range(400)]).withColumn("op", F.col("op").cast("byte"))
    tables = rows.repartitionByRange(3, "key").sortWithinPartitions("key", F.col("seq").desc())
    tables.write.format("wire_table").mode("append").option("maxFileSize", 1500).option("firstNumber", 7).save(folder)
    names = sorted(p.name for p in (tmp_path / "tables").iterdir())
    assert names[0] == "000007.ldb" and len(names) > 4
    want = sorted((bytes(r.key), r.seq, r.op, bytes(r.value)) for r in rows.collect())
    both = [spark.read.format("wire_table").load(folder), datasources.read_files(spark, "wire_table", f"file://{folder}")]
    for got in both:
        assert sorted((bytes(r.key), r.seq, r.op, bytes(r.value)) for r in got.collect()) == want
    assert {bytes(r.key) for r in both[0].where(F.col("key") < F.lit(bytearray(b"k003"))).collect()} == {b"k000", b"k001", b"k002"}
    with pytest.raises(Exception, match="sorted"):
        rows.orderBy("seq").coalesce(1).write.format("wire_table").mode("append").save(str(tmp_path / "bad"))
    assert not [p for p in (tmp_path / "bad").glob("*.ldb")]

    # a table under its older name, and beside its newer one
    (tmp_path / "tables" / "000007.ldb").rename(tmp_path / "tables" / "000007.sst")
    assert spark.read.format("wire_table").load(folder).count() == 400
    (tmp_path / "tables" / "000007.ldb").write_bytes((tmp_path / "tables" / "000007.sst").read_bytes())
    assert spark.read.format("wire_table").load(folder).count() == 400

    logs = str(tmp_path / "logs")
    rows.withColumn("batch_id", F.expr("(seq - 1) div 10")).coalesce(1).sortWithinPartitions("seq").write.format("wire_batches").mode("append").save(logs)
    assert sorted((bytes(r.key), r.seq, r.op) for r in spark.read.format("wire_batches").load(logs).collect()) == [x[:3] for x in want]
    records = spark.read.format("wire_log").load(logs)
    assert records.count() == 40 and records.where("not crc_ok").count() == 0
    again = str(tmp_path / "again")
    records.coalesce(1).sortWithinPartitions("offset").select("payload").write.format("wire_log").mode("append").save(again)
    assert (tmp_path / "again" / "000001.log").read_bytes() == (tmp_path / "logs" / "000001.log").read_bytes()
    data = bytearray((tmp_path / "logs" / "000001.log").read_bytes())
    data[20] ^= 1
    (tmp_path / "logs" / "000001.log").write_bytes(data)
    assert spark.read.format("wire_log").load(logs).where("not crc_ok").count() == 1
    with pytest.raises(Exception, match=Corruption.prefix):
        spark.read.format("wire_log").option("paranoid", "true").load(logs).collect()


def test_newest_stream(spark, tmp_path):
    from tidemark.streaming import tail

    tail.use_state_store(spark)
    folder = str(tmp_path / "changes")
    for part in ([(b"a", 1, 1, b"x"), (b"a", 3, 0, b""), (b"b", 5, 1, b"new")], [(b"b", 2, 1, b"late"), (b"c", 6, 1, b"c")]):
        frame(spark, part).withColumn("op", F.col("op").cast("byte")).write.mode("append").parquet(folder)
    query = tail.newest_stream(tail.read_changes(spark, folder)).writeStream.outputMode("update").format("memory").queryName("newest").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {}
    for r in spark.table("newest").collect():
        got[bytes(r.key)] = max(got.get(bytes(r.key), (0, 0)), (r.seq, r.op))
    assert got == {b"a": (3, 0), b"b": (5, 1), b"c": (6, 1)}
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
