"""Parsers, sinks, transforms and durable state on small inputs."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caravel.functions.hashes import murmur3, murmur3_x64_128
from caravel.functions.serializers import ndjson
from caravel.middleware import chain
from caravel.operators import changelog, splits
from caravel.operators.identity import TableId
from caravel.sinks import partitioning, stores
from caravel.sources import objects, parsers, registry
from caravel.sources.json_parser import Field, JsonParser, parse, spark_pattern
from caravel.streaming import state


def messages(spark, values):
    return spark.createDataFrame([(v if isinstance(v, bytes | None) else v.encode(), False, i) for i, v in enumerate(values)], "value binary, tombstone boolean, offset long")


CASES = [
    (Field("x", "int8"), "300"), (Field("x", "uint8"), "-1"), (Field("x", "uint16"), "70000"), (Field("x", "int64"), '"5"'), (Field("x", "boolean"), '"true"'), (Field("x", "string"), "42"),
    (Field("x", "float32"), "1e39"), (Field("x", "int32"), "1.5"), (Field("x", "decimal(4,2)"), '"1.234"'), (Field("x", "decimal(4,2)"), '"123.45"'), (Field("x", "timestamp", time="yyyy-MM-dd"), '"never"'),
]


@pytest.mark.parametrize(("column", "text"), CASES)
def test_json_rejects_what_does_not_fit(spark, column, text):
    for line, c in ((f'{{"x":{text}}}', column), (f'{{"y":{{"x":{text}}}}}', Field("x", column.type, "$.y.x", time=column.time))):
        good, bad = parse(messages(spark, [line]), JsonParser((c,), system={"offset": "o"}))
        assert good.count() == 0
        assert [(r["error_message"], r["o"]) for r in bad.collect()] == [("x has another type or range", 0)]


def test_json_policies(spark):
    m = messages(spark, ['{"a":1}', "oops", '{"a":1,"b":2}', '{"a":null}'])
    one = (Field("a", "int64", nullable=False),)
    assert parse(m, JsonParser(one, on_error="drop"))[0].count() == 2
    assert parse(m, JsonParser(one, on_error="drop"))[1].count() == 0
    assert sorted(r["error_message"] for r in parse(m, JsonParser(one, unknown="fail"))[1].collect()) == ["a is missing", "not a JSON document", "unknown field b"]
    with pytest.raises(Exception, match="a is missing|not a JSON document"):
        parse(m, JsonParser(one, on_error="fail"))[0].collect()
    with pytest.raises(ValueError):
        JsonParser((Field("a", "int64"), Field("a", "string")))
    with pytest.raises(ValueError):
        JsonParser((Field("a", "int64", "$.b[?(@.c)]"),))
    with pytest.raises(Exception, match="write_timestamp_ms is missing"):
        parse(m.withColumn("write_ts_ms", F.lit(None).cast("long")), JsonParser(one, system={"write_timestamp_ms": "w"}))[0].collect()


def test_json_times_are_utc_in_any_session(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    fields = (Field("t", "timestamp", time="[year]-[month]-[day] [hour]:[minute]:[second]"), Field("n", "timestamp", time="ns"), Field("o", "timestamp", time="yyyy-MM-dd'T'HH:mm:ssXXX"))
    m = messages(spark, ['{"t":"1970-01-01 00:00:07","n":-1,"o":"1970-01-01T01:00:00+01:00"}'])
    try:
        for zone in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = parse(m, JsonParser(fields))[0].select(*[F.unix_micros(c) for c in "tno"]).first()
            assert tuple(got) == (7_000_000, -1, 0)  # a negative nanosecond is floored
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert spark_pattern("[day]/[month]/[year]") == "dd/MM/yyyy"


def test_avro_and_protobuf_round_trips():
    schema = {"type": "record", "name": "r", "fields": [
        {"name": "i", "type": "long"}, {"name": "s", "type": ["null", "string"]}, {"name": "l", "type": {"type": "array", "items": "int"}}, {"name": "m", "type": {"type": "map", "values": "double"}},
        {"name": "e", "type": {"type": "enum", "name": "e", "symbols": ["A", "B"]}}, {"name": "f", "type": {"type": "fixed", "name": "f", "size": 2}}, {"name": "b", "type": "boolean"},
    ]}
    value = {"i": -(2**62), "s": "é", "l": [1, -2, 300], "m": {"k": 1.5}, "e": "B", "f": b"xy", "b": True}
    data = registry.avro_bytes(schema, value, registry.avro_names(schema))
    assert registry.avro_decoder(schema)(data) == value
    for broken in (data[:-1], data + b"\0"):
        with pytest.raises(registry.Wrong):
            registry.avro_decoder(schema)(broken)
    with pytest.raises(registry.Wrong):
        registry.avro_names({"type": "record", "name": "n", "fields": [{"name": "next", "type": ["null", "n"]}]})
    with pytest.raises(registry.Wrong):
        registry.avro_names({"type": "record", "name": "n", "fields": [{"name": "u", "type": ["int", "string"]}]})
    proto = {1: {"name": "i", "type": "int64"}, 2: {"name": "z", "type": "sint32"}, 3: {"name": "l", "type": "int32", "repeated": True}, 4: {"name": "m", "type": "message", "fields": {1: {"name": "x", "type": "float"}}}, 5: {"name": "u", "type": "fixed32"}}
    value = {"i": -3, "z": -4, "l": [1, -2], "m": {"x": 0.5}, "u": 7}
    data = registry.protobuf_bytes(proto, value)
    assert registry.protobuf_value(proto, data) == value
    assert registry.protobuf_value({3: proto[3]}, b"\x1a\x02\x01\x05")["l"] == [1, 5]  # packed
    with pytest.raises(registry.Wrong):
        registry.protobuf_value({1: proto[1]}, data, "fail")
    for open_ in ({"type": "object", "properties": {}}, {"type": "object", "additionalProperties": False, "properties": {"n": {"type": "number"}}}):
        with pytest.raises(registry.Wrong):
            registry.json_decoder(open_)


def test_protoseq_goes_on_after_a_broken_stretch():
    frame = lambda b: len(b).to_bytes(4, "little") + b + b"MAGIC"
    got = list(registry.protoseq(frame(b"one") + b"junk junk MAGIC" + frame(b"") + frame(b"two") + b"end", b"MAGIC"))
    assert got == [(b"one", None), (None, b"junk junk MAGIC"), (b"", None), (b"two", None), (None, b"end")]


def test_tskv(spark):
    rows = ["tskv\ta=1\tb=x\\ty\\\\n\\0", "tskv\ta=1\ta=2", "a=1", "tskv\ta", "tskv\t=1", "tskv\tb=\\q", "tskv\ta=9999999999999999999"]
    good, bad = parsers.parse_tskv(messages(spark, rows).select("value"), {"a": "bigint", "b": "string"}, on_error="dlq")
    assert list(map(tuple, good.collect())) == [(1, "x\ty\\n\0")]
    assert sorted(r["error_message"] for r in bad.collect()) == ["a field has no value", "a has another type or range", "duplicate key", "empty key", "not a TSKV record", "unknown escape"]
    with pytest.raises(Exception, match="USER_RAISED_EXCEPTION"):  # of any of the rows
        parsers.parse_tskv(messages(spark, rows).select("value"), {"a": "bigint"}).collect()


def test_detection():
    assert parsers.detect([b'{"a":1,"b":"x","c":1,"1d":2}\n{"a":2,"c":"x","e":[1]}'])[1] == (Field("a", "int64", nullable=False), Field("b", "string"))
    assert parsers.detect([b"tskv\tn=1.5\tok=true"]) == ("tskv", (Field("n", "float64", nullable=False), Field("ok", "boolean", nullable=False)))
    assert parsers.detect([b"\xff"]) == parsers.detect([b"[1]"]) == ("raw", ())
    assert parsers.table_name("from_message", "a/b/c") == "c"


def test_paths_are_checked_not_encoded(spark):
    df = spark.createDataFrame([("a/b", 1)], "name string, n long")
    with pytest.raises(Exception, match="no path component"):
        df.select(partitioning.fields_path(df, ["name"])).collect()
    with pytest.raises(Exception, match="no path component"):
        none = df.withColumn("z", F.lit(None).cast("string"))
        none.select(partitioning.fields_path(none, ["z"])).collect()
    with pytest.raises(ValueError):
        partitioning.fields_path(df.withColumn("x", F.array("n")), ["x"])
    with pytest.raises(ValueError):
        partitioning.spark_time_pattern("%Q")
    long = df.select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.lit(1).alias("start_offset"), F.lit("x" * 1100).alias("partition_path"))
    with pytest.raises(Exception, match="longer than 1024"):
        long.select(partitioning.object_key("p", "t")).collect()


def test_rotation_is_a_fold(spark):
    import random

    rng = random.Random(5)
    rows = [("t", p, o, 0, o * 100, f"path{o // 40}", rng.randint(1, 30)) for p in range(2) for o in range(120)]
    df = spark.createDataFrame(rows, "topic string, partition long, offset long, message_index long, write_ts_ms long, partition_path string, cost long")
    got = {(r["partition"], r["offset"]): (r["epoch"], r["start_offset"]) for r in partitioning.epochs(df, 9, 100, 700, F.col("cost")).collect()}
    for p in range(2):
        epoch, start, n, size, first, path = -1, None, 0, 0, None, None
        for _, part, o, _, ms, where, cost in rows:
            if part != p:
                continue
            if path != where or n + 1 > 9 or size + cost > 100 or ms - first >= 700:
                epoch, start, n, size, first, path = epoch + 1, o, 0, 0, ms, where
            n, size = n + 1, size + cost
            assert got[p, o] == (epoch, start)


def test_object_sink_survives_a_repeated_batch(spark, tmp_path):
    root, journal = str(tmp_path / "out"), str(tmp_path / "journal")
    rows = spark.createDataFrame([("t", 0, i, f"v{i}") for i in range(10)], "topic string, partition long, offset long, v string").withColumn("partition_path", partitioning.source_path())
    found = stores.objects(partitioning.epochs(rows, max_rows=4), "", "tab", ["v"])
    assert [stores.write_objects(found, root, journal, 7) for _ in range(2)] == [True, False]
    back = spark.read.parquet(root)
    assert sorted((r["key"], r["lines"]) for r in back.collect()) == [(f"tab/topic=t/partition=0/t+0+{s}.json", n) for s, n in ((0, 4), (4, 4), (8, 2))]
    assert json.loads(back.orderBy("key").first()["body"].split("\n")[0]) == {"v": "v0"}
    p = str(tmp_path / "pq")
    for _ in range(2):
        stores.write_parquet(rows.select("partition", "offset", "v"), p, "tab", 1, max_rows=3)
    stores.write_parquet(rows.select("partition", "offset", "v"), p, "tab", 2)
    assert spark.read.parquet(f"{p}/tab").groupBy("delivery").count().count() == 2 and spark.read.parquet(f"{p}/tab").count() == 20


def test_replica_commits_once(spark, tmp_path):
    root = str(tmp_path / "replica")
    batch = lambda rows: spark.createDataFrame(rows, "id long, op string, v string")
    first, second = batch([(1, "c", "a"), (2, "c", "b")]), batch([(1, "d", None), (2, "c", "B"), (3, "c", "c")])
    assert stores.commit_replica(spark, root, first, ["id"], ["v"], "d", 0)
    assert stores.commit_replica(spark, root, second, ["id"], ["v"], "d", 1)
    assert not stores.commit_replica(spark, root, second, ["id"], ["v"], "d", 1)  # a commit in doubt is found
    assert sorted(map(tuple, spark.read.parquet(f"{root}/v2").collect())) == [(2, "B"), (3, "c")]


def test_merges_count_what_they_touch(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id long, v string")
    with pytest.raises(stores.Unmatched):
        stores.merge(now, new, ["id"], ["v"], "update")
    with pytest.raises(stores.Unmatched):
        stores.merge(now, new, ["id"], ["v"], "append")
    assert sorted(map(tuple, stores.merge(now, new, ["id"], ["v"], "upsert").collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert stores.discard(now) == 2
    assert stores.reconcile(3, now, lambda: spark.range(5)) == {"baseline": 3, "committed": 2, "final": 5}
    with pytest.raises(ValueError):
        stores.reconcile(3, now, lambda: spark.range(4))
    for bad in (now.select(F.create_map("v", "id").alias("m")), now.select(F.col("v").alias("x" * 80))):
        with pytest.raises(ValueError):
            stores.validate(bad, "relational", "t")


def test_changelog_contract_stops_the_job(spark):
    rows = [(1, "c", 1, 1), (1, "d", 2, 2), (1, "u", 3, 3)]
    df = spark.createDataFrame(rows, "id long, op string, pos long, version long").withColumn("v", F.lit(1))
    with pytest.raises(Exception, match="update after delete"):
        changelog.collapse(df, ["id"], ["v"], check=True).collect()
    state_ = spark.createDataFrame([(1, 10, 20)], "id long, a long, b long")
    update = spark.createDataFrame([(1, "u", 99, None, [True, False]), (2, "u", 5, None, [True, False])], "id long, op string, a long, b long, included array<boolean>")
    assert list(map(tuple, changelog.apply_to_state(state_, update, ["id"], ["a", "b"]).collect())) == [(1, 99, 20)]
    assert [r["id"] for r in changelog.unmatched(state_, update, ["id"]).collect()] == [2]
    with pytest.raises(Exception, match="no current row"):
        changelog.restore(state_, update, ["id"], ["a", "b"]).collect()
    moved = spark.createDataFrame([(2, 1, "u", bytearray([3]))], "id long, old long, op string, mask binary")
    with pytest.raises(Exception, match="moves the key"):
        changelog.full_image_upserts(moved, ["id"], ["old"]).collect()
    with pytest.raises(Exception, match="an old key is missing"):
        changelog.old_keys(moved.withColumn("old", F.lit(None).cast("long")), ["id"], ["old"]).collect()


def test_runs_break_at_other_columns(spark):
    rows = [("p", 1, "u", [True, False]), ("p", 2, "u", [True, False]), ("p", 3, "u", [False, True]), ("p", 4, "c", [True, True]), ("p", 5, "r", [True, True]), ("p", 6, "d", [False, False])]
    df = spark.createDataFrame(rows, "part string, pos long, op string, included array<boolean>")
    assert [r["run"] for r in changelog.runs(df, ["part"]).orderBy("pos").collect()] == [1, 1, 2, 3, 3, 4]


def test_chain_plans_before_it_reads(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, kind string")
    keyed = objects.stamped(df, {"id": {"primary_key": True}})
    c = chain.Chain.of([{"type": "sql", "config": {"query": "SELECT id, upper(kind) AS kind FROM input"}}, {"type": "rename_table", "config": {"source": "t", "target": "u"}}])
    (name, schema), = c.plan([chain.Dataset(TableId("s", "t"), keyed)]).items()
    assert name == TableId("s", "u") and schema["id"].metadata == {"primary_key": True} and schema["kind"].metadata == {}
    before, after = c.preview(chain.Dataset(TableId("s", "t"), keyed), 1)
    assert (before[0], after[0]) == ({"id": "1", "kind": "x"}, {"id": "1", "kind": "X"})
    with pytest.raises(ValueError):
        chain.transforms.make("filter", {"field": "a", "other": 1})
    with pytest.raises(ValueError):
        chain.transforms.make("nothing", {})
    two = [chain.Dataset(TableId("s", "t"), keyed), chain.Dataset(TableId("s", "u"), keyed)]
    with pytest.raises(ValueError):
        c.plan(two)  # both are s.u, and have a key
    with pytest.raises(Exception, match="kind is null"):
        chain.non_null(spark.createDataFrame([(None,)], "kind string"), ["kind"]).collect()
    with pytest.raises(ValueError):
        chain.exact(df.select("id", "id"))


def test_strict_objects(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for i in range(2):
        spark.range(i * 5, i * 5 + 5).coalesce(1).write.mode("append").parquet(a)
    assert objects.parquet(spark, a).count() == 10
    assert [p for p, _ in objects.listing(spark, a)] == sorted(p for p, _ in objects.listing(spark, a))
    spark.range(2).coalesce(1).write.parquet(b)
    spark.range(2).select(F.col("id").cast("int")).coalesce(1).write.mode("append").parquet(b)
    with pytest.raises(ValueError):
        objects.parquet(spark, b)
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "x.json").write_text('{"a":1}\n{"a":2}\nbad\n')
    (tmp_path / "j" / "empty.json").write_text("")
    good, bad = objects.json_objects(spark, str(tmp_path / "j"), JsonParser((Field("a", "int64"),)))
    assert (good.count(), bad.count()) == (2, 1)
    assert objects.sample(spark.range(100), 10, max_bytes=40).count() == 5


def test_planned_reads():
    listed, schema = objects.select_list("postgres", {"id": "bigint", "n": "numeric(10,2)", "p": "polygon"})
    assert listed == '"id", "n", "p"::text AS "p"' and [f.dataType for f in schema] == [T.LongType(), T.DecimalType(10, 2), T.StringType()]
    with pytest.raises(ValueError):
        objects.select_list("clickhouse", {"p": "Point"}, "fail")
    plans = objects.snapshot_options("mysql", "jdbc:x", "t", {"id": "int"}, splits.range_predicates("id", [10]))
    assert [p["query"] for p in plans] == ["SELECT `id` FROM t WHERE (id < 10 OR id IS NULL)", "SELECT `id` FROM t WHERE id >= 10"]
    assert objects.hidden("postgres", "pg_catalog", "x") and not objects.hidden("mysql", "shop", "x")
    assert splits.halved(0, 8, True) == [(0, 4), (4, 8)] and splits.halved(0, 8, False) == [(0, 8)] and splits.halved(3, 4, True) == [(3, 4)]
    assert len(splits.page_ranges(100, 4)) == 4 and splits.single() == ["TRUE"]
    assert splits.plan({"pages": True, "hash": True}, 1 << 34, 1 << 30, 10**8, 5, 8) == "pages"
    assert splits.plan({"hash": True}, 1 << 34, 1 << 30, None, 5, 8) == "single"  # unknown is not zero


def test_murmur_is_the_published_one(spark):
    assert murmur3_x64_128(b"hello").hex() == "cbd8a7b341bd9b025b1e906a48ae1d19"
    assert murmur3_x64_128(b"").hex() == "0" * 32
    got = spark.createDataFrame([("hello",), (None,)], "s string").select(murmur3(F.col("s")).alias("h")).collect()
    assert bytes(got[0]["h"]).hex() == "cbd8a7b341bd9b025b1e906a48ae1d19" and got[1]["h"] is None


def test_ndjson_refuses_before_any_row(spark):
    with pytest.raises(ValueError):
        ndjson(spark.createDataFrame([(b"x",)], "b binary"))
    df = spark.sql("SELECT date'1970-01-03' AS d, timestamp_ntz'1970-01-01 00:00:01' AS t, CAST(NULL AS INT) AS n")
    assert json.loads(df.select(ndjson(df)).first()[0]) == {"d": 2, "t": 1_000_000, "n": None}


def test_durable_state(spark, tmp_path):
    d = state.Durable(spark, str(tmp_path / "kv"))
    assert d.get("k") == (0, None)
    assert d.exchange("k", 0, "a") and not d.exchange("k", 0, "b")
    assert d.get("k") == (1, "a")
    now = [0.0]
    assert d.lease("l", "me", 10, lambda: now[0]) and not d.lease("l", "you", 10, lambda: now[0])
    now[0] = 11.0
    assert d.lease("l", "you", 10, lambda: now[0])
    ran = []
    for _ in range(2):
        assert state.snapshot_then_stream(d, "phase", lambda: ran.append("snapshot") or 42, lambda at: ran.append("stream") or at) == 42
    assert ran == ["snapshot", "stream", "stream"]
    drained = []
    a = state.Admission(d, drained.append)
    assert a.admit("t", spark.range(1)) and not a.admit("t", spark.range(1))
    assert a.admit("t", spark.range(1).withColumn("more", F.lit("x"))) and drained == ["t", "t"]
    with pytest.raises(state.Fatal):
        a.admit("t", spark.range(1).select(F.col("id").cast("int")))


def test_retries_begin_anew_after_progress():
    waits, left, at = [], [4], [0]

    def run():
        left[0] -= 1
        if left[0] == 2:
            at[0] += 1
        if left[0] > 0:
            raise OSError
        return "done"

    assert state.retried(run, lambda: at[0], sleep=waits.append, draw=lambda: 1.0) == "done"
    assert waits == [1.0, 1.0, 2.0]
    with pytest.raises(state.Fatal):
        state.retried(lambda: (_ for _ in ()).throw(state.Fatal()), lambda: 0)
    assert state.contiguous({2, 3, 5}, 1) == 3
    with pytest.raises(state.Fatal):
        state.contiguous({1}, 1)
