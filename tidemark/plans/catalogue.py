"""The registered queries of the key-value engine, each with its DuckDB SQL.

They read changelogs that are views of the driver's tables:

A  a user's state: key 'u' + user_id, an event is a version, 'error' deletes
B  (event type, user): every seventh event deletes; batches of 10 events, runs
   of 1000
C  a static table: orders by number

Keys and values are strings here, and order is a column where it matters, since
results are compared as sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import keys as K
from ..operators import batch, compaction, resolve

#: Snapshots: these per cent of all sequence numbers.
S1, S2, OLDEST, LATE = 40, 50, 60, 78
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

A_SQL = "a AS (SELECT 'u'||lpad(CAST(user_id AS VARCHAR),6,'0') AS key, event_id+1 AS seq, CASE WHEN event_type='error' THEN 0 ELSE 1 END AS op, props AS value FROM events)"
B_SQL = "b AS (SELECT event_type||'/'||lpad(CAST(user_id AS VARCHAR),6,'0') AS key, event_id+1 AS seq, CASE WHEN event_id%7=0 THEN 0 ELSE 1 END AS op, props AS value, event_id//10 AS batch_id, event_id%10 AS ord, event_id//1000 AS run FROM events)"
C_SQL = "c AS (SELECT lpad(CAST(o_orderkey AS VARCHAR),10,'0') AS key, o_orderkey+1 AS seq, o_orderstatus AS value FROM orders)"


def snapshot_sql(percent: int) -> str:
    return f"(SELECT CAST((max(event_id)+1)*{percent}//100 AS BIGINT) FROM events)"


def snapshot(spark: SparkSession, d: str, percent: int) -> int:
    """The sequence number that so many per cent of events are at or below."""
    return ((events(spark, d).agg(F.max("event_id")).first()[0] or 0) + 1) * percent // 100


def state_sql(name: str, view: str, bound: int | None = None) -> str:
    where = f" WHERE seq<={snapshot_sql(bound)}" if bound is not None else ""
    return f"{name} AS (SELECT key,value,seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {view}{where}) t WHERE rn=1 AND op=1)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def view_a(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), (F.col("event_id") + 1).alias("seq"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("op"), F.col("props").alias("value"))


def view_b(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return events(spark, d).select(F.concat("event_type", F.lit("/"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), (e + 1).alias("seq"), F.when(e % 7 == 0, 0).otherwise(1).alias("op"), F.col("props").alias("value"), F.expr("event_id div 10").alias("batch_id"), (e % 10).alias("ord"), F.expr("event_id div 1000").alias("run"))


def view_c(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("key"), (F.col("o_orderkey") + 1).alias("seq"), F.lit(1).alias("op"), F.col("o_orderstatus").alias("value"))


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def customer_keys(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("u"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key")).distinct()


ONE_KEY = "u000042"


@query("q01_point_get", f"WITH {A_SQL}, {state_sql('s', 'a')} SELECT key, value FROM s WHERE key='{ONE_KEY}'")
def _q01(spark, d):
    return resolve.get(view_a(spark, d), ONE_KEY).select("key", "value")


@query("q02_point_get_at_snapshot", f"WITH {A_SQL}, {state_sql('s', 'a', S2)} SELECT key, value FROM s WHERE key='{ONE_KEY}'")
def _q02(spark, d):
    return resolve.get(view_a(spark, d), ONE_KEY, snapshot(spark, d, S2)).select("key", "value")


@query("q03_state_at_snapshot", f"WITH {A_SQL}, {state_sql('s', 'a', S2)} SELECT key, value FROM s")
def _q03(spark, d):
    return resolve.state_at(view_a(spark, d), snapshot(spark, d, S2)).select("key", "value")


@query("q04_state_latest", f"WITH {A_SQL}, {state_sql('s', 'a')} SELECT key, value, seq FROM s")
def _q04(spark, d):
    return resolve.state_at(view_a(spark, d))


@query("q05_multi_get", f"WITH {A_SQL}, {state_sql('s', 'a')}, k AS (SELECT DISTINCT 'u'||lpad(CAST(c_custkey AS VARCHAR),6,'0') AS key FROM customer) SELECT k.key, s.value, s.seq FROM k LEFT JOIN s ON k.key=s.key")
def _q05(spark, d):
    return resolve.multi_get(view_a(spark, d), customer_keys(spark, d))


#: Ten customers ask for one user; their snapshots go over all events.
PROBES_SQL = "p AS (SELECT 'u'||lpad(CAST(c_custkey//10 AS VARCHAR),6,'0') AS key, c_custkey*7 AS snapshot, c_custkey AS probe FROM customer)"


@query("q06_as_of_join", f"WITH {A_SQL}, {PROBES_SQL}, j AS (SELECT p.probe, p.key, p.snapshot, a.op, a.value, a.seq, row_number() OVER (PARTITION BY p.probe ORDER BY a.seq DESC) AS rn FROM p LEFT JOIN a ON a.key=p.key AND a.seq<=p.snapshot) SELECT probe, key, snapshot, CASE WHEN op=1 THEN value END AS value, CASE WHEN op=1 THEN seq END AS seq FROM j WHERE rn=1")
def _q06(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    probes = c.select(F.concat(F.lit("u"), F.lpad(F.expr("c_custkey div 10").cast("string"), 6, "0")).alias("key"), (F.col("c_custkey") * 7).alias("snapshot"), F.col("c_custkey").alias("probe"))
    return resolve.as_of_join(view_a(spark, d), probes)


@query("q07_forward_scan", f"WITH {A_SQL}, {state_sql('s', 'a', S2)} SELECT row_number() OVER (ORDER BY key) AS pos, key, value FROM s")
def _q07(spark, d):
    return resolve.positions(resolve.state_at(view_a(spark, d), snapshot(spark, d, S2)), "key").select("pos", "key", "value")


@query("q08_reverse_scan", f"WITH {A_SQL}, {state_sql('s', 'a')} SELECT row_number() OVER (ORDER BY key DESC) AS pos, key, value FROM s")
def _q08(spark, d):
    return resolve.positions(resolve.state_at(view_a(spark, d)), F.col("key").desc()).select("pos", "key", "value")


TARGETS = ["", "u000000", "u000042", "u000042x", "u000099", "u0001", "v"]


@query("q09_seek_each", f"WITH {A_SQL}, {state_sql('s', 'a')}, t(target) AS (VALUES {', '.join(f'({chr(39)}{t}{chr(39)})' for t in TARGETS)}) SELECT target, (SELECT min(key) FROM s WHERE key>=target) AS found FROM t")
def _q09(spark, d):
    return resolve.seek_each(view_a(spark, d), spark.createDataFrame([(t,) for t in TARGETS], "target string"))


@query("q10_seek_next", f"WITH {A_SQL}, {state_sql('s', 'a', S2)} SELECT key, value, row_number() OVER (ORDER BY key) AS pos FROM s WHERE key>='u000060' ORDER BY key LIMIT 5")
def _q10(spark, d):
    found = resolve.seek_next(view_a(spark, d), "u000060", 5, snapshot(spark, d, S2))
    return found.select("key", "value", F.row_number().over(Window.orderBy("key")).cast("long").alias("pos"))


@query("q11_seek_prev", f"WITH {A_SQL}, {state_sql('s', 'a', S2)} SELECT key, value, row_number() OVER (ORDER BY key DESC) AS pos FROM s WHERE key<'u000060' ORDER BY key DESC LIMIT 5")
def _q11(spark, d):
    found = resolve.seek_prev(view_a(spark, d), "u000060", 5, snapshot(spark, d, S2))
    return found.select("key", "value", F.row_number().over(Window.orderBy(F.col("key").desc())).cast("long").alias("pos"))


@query("q12_range_scan", f"WITH {A_SQL}, {state_sql('s', 'a')} SELECT key, value FROM s WHERE key>='u000020' AND key<'u000080'")
def _q12(spark, d):
    return resolve.scan(view_a(spark, d), start="u000020", limit="u000080").select("key", "value")


@query("q13_prefix_scan", f"WITH {B_SQL}, {state_sql('s', 'b')} SELECT key, value FROM s WHERE starts_with(key,'click/')")
def _q13(spark, d):
    return resolve.prefix_scan(view_b(spark, d), "click/").select("key", "value")


@query("q14_first_last", f"WITH {A_SQL}, {state_sql('s', 'a')} SELECT min(key) AS first_key, max(key) AS last_key FROM s")
def _q14(spark, d):
    return resolve.first_last(view_a(spark, d))


@query("q15_raw_scan", f"WITH {B_SQL} SELECT key, seq, op, value FROM b")
def _q15(spark, d):
    return resolve.raw_scan(view_b(spark, d).select("key", "seq", "op", "value"))


@query("q16_history", f"WITH {A_SQL} SELECT key, seq, op, value, row_number() OVER (ORDER BY seq DESC) AS version, lead(value) OVER (ORDER BY seq DESC) AS replaced FROM a WHERE key='{ONE_KEY}'")
def _q16(spark, d):
    return resolve.history(view_a(spark, d), ONE_KEY).withColumn("version", F.col("version").cast("long"))


@query("q17_tombstones", f"WITH {A_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM a) SELECT key, seq FROM r WHERE rn=1 AND op=0")
def _q17(spark, d):
    return resolve.tombstones(view_a(spark, d))


@query("q18_census", f"WITH {A_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM a) SELECT count(*) FILTER (WHERE rn=1 AND op=1) AS live_keys, count(*) FILTER (WHERE rn=1 AND op=0) AS dead_keys, count(*) AS versions FROM r")
def _q18(spark, d):
    return resolve.census(view_a(spark, d))


@query("q19_snapshot_diff", f"WITH {A_SQL}, {state_sql('o', 'a', S1)}, {state_sql('n', 'a', S2)} SELECT coalesce(o.key,n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'changed' END AS change, o.value AS old_value, n.value AS new_value FROM o FULL JOIN n ON o.key=n.key WHERE o.key IS NULL OR n.key IS NULL OR o.value IS DISTINCT FROM n.value")
def _q19(spark, d):
    return resolve.diff(view_a(spark, d), snapshot(spark, d, S1), snapshot(spark, d, S2))


for _how, _op in (("except", "EXCEPT"), ("intersect", "INTERSECT"), ("union", "UNION")):

    @query(f"q20_keys_{_how}", f"WITH {A_SQL}, {state_sql('o', 'a', S1)}, {state_sql('n', 'a', S2)} SELECT key FROM o {_op} SELECT key FROM n")
    def _q20(spark, d, how=_how):
        return resolve.keys_set(view_a(spark, d), snapshot(spark, d, S1), snapshot(spark, d, S2), how)


@query("q21_last_in_batch", f"WITH {B_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY batch_id, key ORDER BY ord DESC) AS rn FROM b) SELECT batch_id, key, ord, op, value FROM r WHERE rn=1")
def _q21(spark, d):
    return batch.last_in_batch(view_b(spark, d).select("batch_id", "key", "ord", "op", "value"))


@query("q22_batch_append", f"WITH {B_SQL} SELECT batch_id, key, op, CASE WHEN batch_id%2=0 THEN ord ELSE ord+coalesce(max(ord) FILTER (WHERE batch_id%2=0) OVER (PARTITION BY batch_id//2)+1,0) END AS ord FROM b")
def _q22(spark, d):
    rows = view_b(spark, d).select("batch_id", "key", "op", "ord", F.expr("batch_id div 2").alias("pair"))
    return batch.append(rows.where("batch_id % 2 = 0"), rows.where("batch_id % 2 = 1"), "pair").drop("pair")


@query("q23_batch_sizes", f"WITH {B_SQL} SELECT batch_id, count(*) AS ops, count(*) FILTER (WHERE op=0) AS deletions, CAST(sum(strlen(key)+CASE WHEN op=1 THEN strlen(value) ELSE 0 END) AS BIGINT) AS bytes FROM b GROUP BY batch_id")
def _q23(spark, d):
    size = F.octet_length("key") + F.when(F.col("op") == 1, F.octet_length("value")).otherwise(0)
    return view_b(spark, d).groupBy("batch_id").agg(F.count("*").alias("ops"), F.count_if(F.col("op") == 0).alias("deletions"), F.sum(size).cast("long").alias("bytes"))


@query("q24_sequence_assignment", f"WITH {B_SQL} SELECT batch_id, ord, key, 100+row_number() OVER (ORDER BY batch_id, ord) AS seq FROM b")
def _q24(spark, d):
    return batch.assign_sequences(view_b(spark, d).select("batch_id", "ord", "key"), 100)


@query("q25_compact_latest", f"WITH {A_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM a) SELECT key, seq, op, value FROM r WHERE rn=1")
def _q25(spark, d):
    return compaction.drop_hidden(view_a(spark, d)).select("key", "seq", "op", "value")


HIDDEN_SQL = "h AS (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq DESC) AS newer FROM a)"


@query("q26_compact_with_snapshot", f"WITH {A_SQL}, {HIDDEN_SQL} SELECT key, seq, op, value FROM h WHERE newer IS NULL OR newer>{snapshot_sql(OLDEST)}")
def _q26(spark, d):
    return compaction.drop_hidden(view_a(spark, d), snapshot(spark, d, OLDEST))


@query("q27_compact_bottom", f"WITH {A_SQL}, {HIDDEN_SQL} SELECT key, seq, op, value FROM h WHERE (newer IS NULL OR newer>{snapshot_sql(OLDEST)}) AND NOT (op=0 AND seq<={snapshot_sql(OLDEST)})")
def _q27(spark, d):
    return compaction.compact(view_a(spark, d), snapshot(spark, d, OLDEST))


_at = lambda percent: f"SELECT {percent} AS percent, count(*) AS live, CAST(sum(seq) AS BIGINT) AS seqs, CAST(sum(strlen(key)+strlen(value)) AS BIGINT) AS bytes, min(key) AS first_key, max(key) AS last_key FROM s{percent}"


@query("q28_compaction_invariance", f"WITH {A_SQL}, {', '.join(state_sql(f's{p}', 'a', p) for p in (OLDEST, LATE))} {_at(OLDEST)} UNION ALL {_at(LATE)}")
def _q28(spark, d):
    """States after a compaction, at its oldest snapshot and a later one."""
    after, out = compaction.compact(view_a(spark, d), snapshot(spark, d, OLDEST)), None
    for percent in (OLDEST, LATE):
        s = resolve.state_at(after, snapshot(spark, d, percent))
        got = s.agg(F.count("*").alias("live"), F.sum("seq").alias("seqs"), F.sum(F.octet_length("key") + F.octet_length("value")).cast("long").alias("bytes"), F.min("key").alias("first_key"), F.max("key").alias("last_key")).select(F.lit(percent).alias("percent"), "*")
        out = got if out is None else out.unionByName(got)
    return out


@query("q29_deduplicate_replay", f"WITH {A_SQL}, d AS (SELECT * FROM a UNION ALL SELECT * FROM a WHERE seq%3=0) SELECT DISTINCT key, seq, op, value FROM d")
def _q29(spark, d):
    a = view_a(spark, d)
    return resolve.deduplicate(a.unionByName(a.where("seq % 3 = 0")))


@query("q30_merge_runs", f"WITH {B_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM b) SELECT key, seq, value, run FROM r WHERE rn=1 AND op=1")
def _q30(spark, d):
    b = view_b(spark, d).select("key", "seq", "op", "value", "run")
    return resolve.newest(resolve.merge_runs([b.where("run % 2 = 0"), b.where("run % 2 = 1")])).where("op = 1").select("key", "seq", "value", "run")


@query("q31_reverse_comparator", f"WITH {C_SQL} SELECT row_number() OVER (ORDER BY key DESC) AS pos, key FROM c")
def _q31(spark, d):
    order = K.COMPARATORS["reverse"].order
    return resolve.positions(*K.ordered_by(resolve.state_at(view_c(spark, d)), lambda key: order(key.cast("binary")))).select("pos", "key")


@query("q32_numeric_comparator", "WITH r AS (SELECT 'k'||CAST(o_orderkey AS VARCHAR) AS key, o_orderkey FROM orders) SELECT row_number() OVER (ORDER BY o_orderkey) AS pos, key FROM r")
def _q32(spark, d):
    plain = view_c(spark, d).withColumn("key", F.concat(F.lit("k"), F.col("key").cast("long").cast("string")))
    return resolve.positions(*K.ordered_by(resolve.state_at(plain), K.COMPARATORS["numeric_suffix"].order)).select("pos", "key")


@query("q33_composite_key_order", "SELECT event_type, user_id, dense_rank() OVER (ORDER BY event_type, user_id) AS pos FROM (SELECT DISTINCT event_type, user_id FROM events) t")
def _q33(spark, d):
    pairs = events(spark, d).select("event_type", "user_id").distinct()
    coded = pairs.withColumn("code", K.composite(K.encode_text(F.col("event_type")), K.encode_int(F.col("user_id"))))
    return resolve.positions(coded, "code").select("event_type", "user_id", "pos")


PREFIXES = ["u00001", "u0001", "u", "view", "zz"]


@query("q34_prefix_successor", f"WITH {A_SQL}, {state_sql('s', 'a')}, p(prefix) AS (VALUES {', '.join(f'({chr(39)}{p}{chr(39)})' for p in PREFIXES)}) SELECT prefix, count(s.key) AS live FROM p LEFT JOIN s ON starts_with(s.key, prefix) GROUP BY prefix")
def _q34(spark, d):
    bounds = F.broadcast(spark.createDataFrame([(p, K.prefix_successor(p)) for p in PREFIXES], "prefix string, stop string"))
    state = resolve.state_at(view_a(spark, d))
    return bounds.join(state, (F.col("key") >= F.col("prefix")) & (F.col("key") < F.col("stop")), "left").groupBy("prefix").agg(F.count("key").alias("live"))


def runs_of(spark: SparkSession, d: str) -> DataFrame:
    """Files of view B by run: 64 bytes an entry, levels by run number."""
    f = compaction.describe_files(view_b(spark, d), "run")
    return f.select(F.col("run").alias("number"), (F.col("run") % 3).cast("int").alias("level"), (F.col("num_entries") * 64).alias("file_size"), "smallest_key", "largest_key", "num_entries", "min_seq", "max_seq")


RUNS_SQL = f"{B_SQL}, f AS (SELECT run AS number, CAST(run%3 AS INTEGER) AS level, count(*)*64 AS file_size, min(key) AS smallest_key, max(key) AS largest_key, count(*) AS num_entries, min(seq) AS min_seq, max(seq) AS max_seq FROM b GROUP BY run)"


@query("q35_file_metadata", f"WITH {RUNS_SQL} SELECT * FROM f")
def _q35(spark, d):
    return runs_of(spark, d)


@query("q36_overlapping_runs", f"WITH {RUNS_SQL} SELECT x.number, y.number AS other FROM f x JOIN f y ON x.smallest_key<=y.largest_key AND y.smallest_key<=x.largest_key AND x.level=0 AND y.level=1")
def _q36(spark, d):
    f = runs_of(spark, d)
    return compaction.overlapping_pairs(f.where("level = 0"), f.where("level = 1"))


@query("q37_level_scores", f"WITH {RUNS_SQL} SELECT level, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes, CASE WHEN level=0 THEN count(*)/4.0 ELSE sum(file_size)/(10485760.0*power(10,level-1)) END AS score FROM f GROUP BY level")
def _q37(spark, d):
    return compaction.level_scores(runs_of(spark, d))


@query("q38_level_stats", f"WITH {RUNS_SQL} SELECT level, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM f GROUP BY level")
def _q38(spark, d):
    return compaction.level_stats(runs_of(spark, d))


RANGES = [(1, "", "zzz"), (2, "click/", "error/"), (3, "view", "click"), (4, "m", "m"), (5, "login/000100", "view/000050")]
_part = "CASE WHEN f.largest_key<{0} THEN file_size WHEN f.smallest_key<{0} THEN file_size//2 ELSE 0 END"


@query("q39_range_sizes", f"WITH {RUNS_SQL}, r(id,start,stop) AS (VALUES {', '.join(map(str, RANGES))}) SELECT id, CAST(greatest(sum({_part.format('stop')})-sum({_part.format('start')}),0) AS BIGINT) AS bytes FROM r, f GROUP BY id")
def _q39(spark, d):
    return compaction.range_sizes(runs_of(spark, d), spark.createDataFrame(RANGES, "id int, start string, stop string"))


@query("q40_missing_and_obsolete", f"WITH {RUNS_SQL}, l AS (SELECT number FROM f WHERE number%4<>1 UNION ALL SELECT number+1000 FROM f WHERE number%5=0) SELECT 'missing' AS kind, number FROM f WHERE number NOT IN (SELECT number FROM l) UNION ALL SELECT 'obsolete', number FROM l WHERE number NOT IN (SELECT number FROM f)")
def _q40(spark, d):
    f = runs_of(spark, d).select("number")
    listing = f.where("number % 4 <> 1").unionByName(f.where("number % 5 = 0").select((F.col("number") + 1000).alias("number")))
    return compaction.missing_files(f, listing).select(F.lit("missing").alias("kind"), "number").unionByName(compaction.obsolete_files(listing, f).select(F.lit("obsolete").alias("kind"), "number"))


WANTED = ["click/000001", "aaa", "zzz", "view/000149"]


@query("q41_file_pruning", f"WITH {RUNS_SQL} SELECT number, level FROM f WHERE EXISTS (SELECT 1 FROM (VALUES {', '.join(f'({chr(39)}{k}{chr(39)})' for k in WANTED)}) k(key) WHERE key BETWEEN smallest_key AND largest_key)")
def _q41(spark, d):
    return compaction.prune_files(runs_of(spark, d), spark.createDataFrame([(k,) for k in WANTED], "key string")).select("number", "level")


@query("q42_version_replay", f"WITH {RUNS_SQL}, e AS (SELECT number AS version, 'add' AS action, number, level FROM f UNION ALL SELECT number+3, 'remove', number, level FROM f WHERE number%2=0 UNION ALL SELECT number+3, 'add', number, level+1 FROM f WHERE number%4=0), r AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY version DESC, CASE WHEN action='add' THEN 1 ELSE 0 END DESC) AS rn FROM e) SELECT number, level FROM r WHERE rn=1 AND action='add'")
def _q42(spark, d):
    f = runs_of(spark, d).select("number", "level")
    act = lambda rows, shift, action, level: rows.select((F.col("number") + shift).alias("version"), F.lit(action).alias("action"), "number", (F.col("level") + level).alias("level"))
    edits = act(f, 0, "add", 0).unionByName(act(f.where("number % 2 = 0"), 3, "remove", 0)).unionByName(act(f.where("number % 4 = 0"), 3, "add", 1))
    return compaction.replay(edits)


@query("q43_bloom_filter", f"WITH {B_SQL}, k AS (SELECT DISTINCT split_part(key,'/',1) AS file, key FROM b) SELECT file, count(*) AS keys, count(*) AS found, CAST((greatest(64,count(*)*10)+7)//8+1 AS BIGINT) AS bytes FROM k GROUP BY file")
def _q43(spark, d):
    """A filter for each event type: none of its keys is missed."""
    from ..functions import blooms

    keys = view_b(spark, d).select(F.split_part("key", F.lit("/"), F.lit(1)).alias("file"), "key").distinct()
    filters = blooms.build(keys, bits=10)
    found = blooms.probe(filters, keys).groupBy("file").agg(F.count("*").alias("keys"), F.count_if("may_match").alias("found"))
    return found.join(filters.groupBy("file").agg(F.sum(F.octet_length("filter")).cast("long").alias("bytes")), "file").select("file", "keys", "found", "bytes")


@query("q44_state_join_dimension", f"WITH {A_SQL}, {state_sql('s', 'a')} SELECT c.c_mktsegment AS segment, count(*) AS live, CAST(max(s.seq) AS BIGINT) AS newest FROM s JOIN customer c ON s.key='u'||lpad(CAST(c.c_custkey AS VARCHAR),6,'0') GROUP BY c.c_mktsegment")
def _q44(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("u"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key"), F.col("c_mktsegment").alias("segment"))
    return resolve.state_at(view_a(spark, d)).join(c, "key").groupBy("segment").agg(F.count("*").alias("live"), F.max("seq").alias("newest"))


@query("q45_static_table_state", f"WITH {C_SQL} SELECT value, count(*) AS live, min(key) AS first_key, max(key) AS last_key FROM c GROUP BY value")
def _q45(spark, d):
    return resolve.state_at(view_c(spark, d)).groupBy("value").agg(F.count("*").alias("live"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


@query("q46_large_values", "WITH r AS (SELECT source||'/'||lpad(CAST(doc_id AS VARCHAR),8,'0') AS key, text AS value FROM documents) SELECT key, strlen(value) AS bytes, md5(value) AS digest FROM r")
def _q46(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("key"), (F.col("doc_id") + 1).alias("seq"), F.lit(1).alias("op"), F.col("text").alias("value"))
    return resolve.state_at(docs).select("key", F.octet_length("value").cast("long").alias("bytes"), F.md5(F.col("value").cast("binary")).alias("digest"))


@query("q47_turn_histories", "SELECT lpad(CAST(conv_id AS VARCHAR),8,'0') AS key, max(turn)+1 AS seq, arg_max(text, turn) AS value FROM conversations GROUP BY conv_id")
def _q47(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet").select(F.lpad(F.col("conv_id").cast("string"), 8, "0").alias("key"), (F.col("turn") + 1).alias("seq"), F.lit(1).alias("op"), F.col("text").alias("value"))
    return resolve.state_at(t).select("key", "seq", "value")


@query("q48_grandparent_overlap", f"WITH {RUNS_SQL} SELECT x.number, CAST(coalesce(sum(g.file_size),0) AS BIGINT) AS overlap_bytes FROM f x LEFT JOIN f g ON g.level=2 AND x.smallest_key<=g.largest_key AND g.smallest_key<=x.largest_key WHERE x.level=0 GROUP BY x.number")
def _q48(spark, d):
    f = runs_of(spark, d)
    return compaction.grandparent_bytes(f.where("level = 0"), f.where("level = 2"))


@query("q49_hidden_versions", f"WITH {A_SQL}, {HIDDEN_SQL} SELECT key, seq, newer AS hidden_by FROM h WHERE newer<={snapshot_sql(OLDEST)}")
def _q49(spark, d):
    return compaction.hidden_by_newer(view_a(spark, d)).where(F.col("hidden_by") <= snapshot(spark, d, OLDEST)).select("key", "seq", "hidden_by")


@query("q50_escaped_keys", "SELECT DISTINCT 'u\\x00'||CAST(user_id AS VARCHAR) AS shown FROM events")
def _q50(spark, d):
    from ..functions.scalars import escaped

    raw = F.concat(F.lit("u").cast("binary"), F.unhex(F.lit("00")), F.col("user_id").cast("string").cast("binary"))
    return events(spark, d).select("user_id").distinct().select(escaped(raw).alias("shown"))
