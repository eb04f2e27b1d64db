import base64
import random

import pytest
from pyspark.sql import functions as F

from caravel import queries
from caravel.operators import changelog, splits
from caravel.operators.filters import filter_eq
from caravel.operators.identity import Card, TableId, expand, rename, select_tables, union_renamed
from caravel.plans.semantics import guarantee
from caravel.plans.sqlgate import SqlRefused, run_sql
from caravel.sources import generator, parsers
from caravel.sources.json_parser import framed
from caravel.streaming.delivery import deliver


def test_sql_gate(spark):
    df = spark.createDataFrame([("pear", 4), ("fig", 7), ("plum", None)], "fruit string, weight long")
    got = run_sql(df, "SELECT fruit, weight + 1 AS heavier FROM input WHERE fruit LIKE 'p%' ORDER BY fruit")
    assert list(map(tuple, got.collect())) == [("pear", 5), ("plum", None)]
    for bad in ("   ", "INSERT INTO input VALUES ('a', 1)", "ALTER VIEW input AS SELECT 1", "CACHE TABLE input"):
        with pytest.raises(SqlRefused):
            run_sql(df, bad)
    assert run_sql(df, "SELECT weight % 0 AS rest FROM input").dtypes == [("rest", "bigint")]  # planned, not run


@pytest.mark.parametrize(
    "sql, split",
    [
        ("SELECT g, count(DISTINCT x) + 1 AS d, approx_percentile(x, 0.5) AS m, sum(x) AS s FROM input GROUP BY g", True),
        ("SELECT G AS k, concat(g, '!') AS loud, count( DISTINCT x ), array_sort(collect_list(x) FILTER (WHERE x > 8)) AS l FROM input WHERE x > 1 OR g IS NULL GROUP BY g", True),
        ("SELECT x % 3 AS r, median(x) AS m, sum(DISTINCT x) / count(DISTINCT x) AS a FROM input GROUP BY x % 3, g", True),
        ("SELECT approx_count_distinct(x) AS n, count(DISTINCT g, x) AS d FROM input WHERE x > 100", True),
        ("SELECT g, count(DISTINCT x) AS d, count(*) AS n FROM input GROUP BY g", False),
        ("SELECT g AS h, count(DISTINCT x) AS d, median(x) AS m FROM input GROUP BY h", False),
        ("SELECT g, count(DISTINCT x) AS d, median(x) AS m FROM input GROUP BY ROLLUP (g)", False),
        ("SELECT g, count(DISTINCT x) AS d, median(x) AS m FROM input GROUP BY g HAVING count(*) > 6", False),
        ("SELECT count(DISTINCT g) AS d, median(x) AS m FROM (SELECT g, x + 0 * rand() AS x FROM input)", False),
    ],
)
def test_sketches_beside_distinct_values(spark, sql, split):
    """No group of a distinct value holds a sketch; rows, names and types are those of the query as it stands."""
    df = spark.createDataFrame([("a" if i % 4 else None, i % 11) for i in range(40)] + [("b", None)], "g string, x long")
    got = run_sql(df, sql)
    whole = spark.sql(sql.replace("input", "{df}"), df=df)
    assert ("JOIN" in got._jdf.queryExecution().analyzed().toString().upper()) is split
    assert got.dtypes == whole.dtypes and sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def test_sql_gate_reaches_no_further_than_its_relations(spark):
    df = spark.range(4)
    spark.range(9).createOrReplaceTempView("input")
    try:
        assert run_sql(df, "SELECT count(*) AS n FROM input").first()["n"] == 4
        assert spark.table("input").count() == 9  # the user's own view is as it was
        for bad in ("SELECT java_method('java.lang.Math', 'random')", "SELECT * FROM elsewhere", "SELECT id FROM input WHERE id IN (SELECT id FROM elsewhere)", "SELECT * FROM csv.`/etc/hosts`", "WITH a AS (SELECT * FROM elsewhere) SELECT * FROM a"):
            with pytest.raises(SqlRefused):
                run_sql(df, bad)
    finally:
        spark.catalog.dropTempView("input")


def test_dialect_is_rewritten(spark):
    df = spark.createDataFrame([(g, x) for g in "ab" for x in (1, 1, 2, 3)], "g string, x long")
    got = run_sql(df, "SELECT g, x, sum(x) OVER (PARTITION BY g ORDER BY x GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM input WHERE g = 'a'")
    assert sorted(map(tuple, got.collect())) == [("a", 1, 2), ("a", 1, 2), ("a", 2, 4), ("a", 3, 5)]
    got = run_sql(df, "SELECT g, x AS top FROM input QUALIFY row_number() OVER (PARTITION BY g ORDER BY x DESC) = 1 ORDER BY g DESC LIMIT 1")
    assert list(map(tuple, got.collect())) == [("b", 3)]
    assert run_sql(df, "SELECT count(*) AS n FROM (SELECT g FROM input QUALIFY rank() OVER (PARTITION BY g ORDER BY x) = 1)").first()["n"] == 4


def test_filter_checks_at_plan_time(spark):
    df = spark.createDataFrame([("on", 1), (None, 2), ("off", 3), ("on", 4)], "state string, n long")
    assert filter_eq(df, "state", "on").count() == 2
    for field in ("n", "nowhere"):
        with pytest.raises(ValueError):
            filter_eq(df, field, "on")


def test_rename():
    to = lambda name, pattern, replacement: rename(TableId(None, name), pattern, replacement).name
    assert to("a1b22", r"\d+", "#") == "a#b#"  # every match
    assert to("log_2024_05", r"^log_(\d+)_(\d+)$", "y${1}m${2}") == "y2024m05"
    assert to("größe", "ö", "oe") == "groesse".replace("sse", "ße")
    assert to("plain", "missing", "never") == "plain"
    assert to("cost", "cost", "$$") == "$"
    assert rename(TableId("src", "t"), r"^src\.", r"dst.") == TableId("dst", "t")
    with pytest.raises(ValueError):
        to("ab", "(a)|(x)", "$2")  # takes no part


def test_identity_text_round_trip():
    for t in (TableId("a.b", "c\\d"), TableId(None, "x.y"), TableId("s", "t")):
        assert TableId.parse(t.text()) == t
    with pytest.raises(ValueError):
        import re

        expand("$2", re.match("(a)", "a"))


def test_selection():
    cat = [TableId("sales", "y2023"), TableId("sales", "y2024"), TableId("ops", "y2024"), TableId("ops", "notes*")]
    assert select_tables(cat, [Card("sales.y202?", exclude="*.y2023")]) == [cat[1]]
    assert select_tables(cat, [Card(r"ops\.y\d+", regex=True)]) == [cat[2]]
    assert select_tables(cat, [Card("ops.notes\\*")]) == [cat[3]]
    for bad in ([Card("absent")], [Card("sales.*"), Card("*.y2024")], [Card("sales.y2023"), Card("ops.*", exclude="sales.*")]):
        with pytest.raises(ValueError):
            select_tables(cat, bad)
    with pytest.raises(ValueError):
        select_tables([*cat, cat[0]], [Card("ops.y*")])


def test_union_by_rename_needs_equal_schemas(spark):
    a, b = spark.range(2), spark.range(2).select(F.col("id").cast("int"))
    assert union_renamed([a, a]).count() == 4
    for frames, key in (([a, b], False), ([a, a], True)):
        with pytest.raises(ValueError):
            union_renamed(frames, key)


def model(events):
    """The state machine, one event at a time."""
    state = None
    for op, pos, a, b, mask in events:
        if op in "cr":
            state = [op, a, b]
        elif op == "u":
            state = state or ["u", None, None]
            state[1], state[2] = (a if mask & 1 else state[1]), (b if mask & 2 else state[2])
        else:
            state = ["d", None, None]
        last = pos
    return (*state, last)


def test_collapse_is_the_state_machine(spark):
    rng, rows, want = random.Random(3), [], {}
    for key in range(300):
        own, dead = [], False
        for pos in range(rng.randint(1, 6)):
            op = rng.choice("crd" if dead else "cruud")
            own.append((op, pos, rng.choice([None, 1, 2]), rng.choice([None, 3, 4]), rng.randrange(4)))
            dead = op == "d"
        rows += [(key, *e) for e in own]
        want[key] = model(own)
    df = spark.createDataFrame(rows, "k long, op string, pos long, a long, b long, mask int").withColumn("version", F.col("pos"))
    bit = lambda i: (F.col("mask").bitwiseAND(i)) != 0
    got = changelog.collapse(df, ["k"], ["a", "b"], masks={"a": bit(1), "b": bit(2)})
    assert {r["k"]: (r["op"], r["a"], r["b"], r["pos"]) for r in got.collect()} == want
    assert changelog.errors(df, ["k"]).count() == 0


def test_changelog_errors_and_key_moves(spark):
    df = spark.createDataFrame([(1, "d", 0, 1), (1, "u", 1, 2), (2, "x", 0, 1), (3, "c", 0, -1)], "k long, op string, pos long, version long")
    assert sorted(r["reason"] for r in changelog.errors(df, ["k"]).collect()) == ["bad version", "unknown operation", "update after delete"]
    moves = spark.createDataFrame([(2, 1, "u", 1, 42), (3, 2, "u", 2, 42)], "id long, old long, op string, pos long, version long")
    out = changelog.collapse(changelog.split_key_moves(moves, "id", "old"), ["id"], [])
    assert sorted((r["id"], r["op"]) for r in out.collect()) == [(1, "d"), (2, "d"), (3, "c")]


def test_splits_cover_once(spark):
    base = 2**53
    rows = [(None,)] + [(base + i,) for i in range(100)]
    df = spark.createDataFrame(rows, "k long")
    for preds in (splits.equal_ranges("k", base, base + 99, 7), splits.hash_predicates("hash(k)", 5), splits.range_predicates("k", [])):
        assert sum(df.where(p).count() for p in preds) == len(rows)


def test_json_kinds_and_dead_letters(spark):
    lines = ['{"id":1,"s":"a"}', '{"id":"1","s":"a"}', '{"id":1.5,"s":"a"}', '{"id":1,"id":2}', '{"s":"a"}', '{"id":2,"s":5}', '{"id":3}', "nonsense"]
    df = spark.createDataFrame([(x.encode(),) for x in lines], "value binary")
    good, bad = parsers.parse_json(df, {"id": ("$.id", "bigint", False), "s": ("$.s", "string", True)})
    assert sorted(map(tuple, good.collect()), key=str) == [(1, "a"), (3, None)]
    assert bad.count() == 6
    many = spark.createDataFrame([(b"a\n\nb",)], "value binary")
    assert [r["_line"] for r in framed(many, "json_lines").collect()] == ["a", "b"]


def test_guarantees():
    assert guarantee("kafka", "discard") == "none"
    assert guarantee("postgres", "iceberg", changelog=True) == "exactly_once"
    assert guarantee("kafka", "s3") == "at_least_once"
    assert guarantee("logbroker", "s3") == "exactly_once"


def test_stream_delivers_each_batch_once(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for part in range(2):
        spark.range(part * 10, part * 10 + 10).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long").parquet(source)
        deliver(stream, out, check, lambda df: df.withColumn("twice", F.col("id") * 2)).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(r["id"] for r in got.collect()) == list(range(20))


def test_raw_to_table_query_runs_over_all_messages(spark):
    """Malformed ones too, with the offsets that the other parsers see."""
    events = queries.table(spark, "/root/testdata/sf0.001", "events")
    got = {(r["partition"], r["offset"]): r for r in queries.QUERIES["raw_to_table_all"](spark, "/root/testdata/sf0.001").collect()}
    sent = generator.messages(events).collect()
    assert len(got) == len(sent) == events.count()
    for r in sent:
        own = got[r["partition"], r["offset"]]
        if r["event_id"] % 17 == 0:
            assert own["kind"] is None and base64.b64decode(own["raw_base64"]) == bytes(r["value"])
        else:
            assert own["kind"] is not None and own["raw_base64"] is None
