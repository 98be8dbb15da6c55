import random
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tokenscope.functions import text
from tokenscope.operators import caches, layers, services, state
from tokenscope.sources import fanout, sinks
from tokenscope.streaming import stateful


def test_a_get_refreshes_recency_but_not_age():
    c = caches.AgedCache(2, 100)
    assert [c.step(0, "set", "a"), c.step(1, "set", "b"), c.step(50, "get", "a"), c.step(60, "set", "c")] == ["insert", "insert", "hit", "insert_evict"]
    assert [c.step(61, "get", "b"), c.step(100, "get", "a"), c.step(101, "get", "a"), c.step(102, "get", "a")] == ["miss", "hit", "expired", "miss"]
    assert [c.step(103, "set", "c"), c.step(203, "get", "c"), c.step(204, "delete", "c"), c.step(205, "delete", "c")] == ["update", "hit", "deleted", "absent"]


def brute_cache(most, seconds, calls):
    """Entries as a plain list of (key, created), least recent first."""
    held, out = [], []
    for ts, kind, k in calls:
        at = next((i for i, x in enumerate(held) if x[0] == k), None)
        if kind == "get":
            if at is None:
                out.append("miss")
            elif ts - held[at][1] > seconds:
                held.pop(at)
                out.append("expired")
            else:
                held.append(held.pop(at))
                out.append("hit")
        elif kind == "delete":
            out.append("absent" if at is None else "deleted")
            held = [x for x in held if x[0] != k]
        else:
            full = at is None and len(held) >= most
            out.append("update" if at is not None else "insert_evict" if full else "insert")
            held = [x for x in (held[1:] if full else held) if x[0] != k] + [(k, ts)]
    return out


def test_cache_equals_list():
    r = random.Random(2)
    for most, seconds in ((1, 10), (3, 40), (8, 200)):
        calls, ts = [], 0
        for _ in range(800):
            ts += r.choice([0, 1, 1, 5])
            calls.append((ts, r.choice(["get", "get", "set", "delete"]), r.randrange(10)))
        c = caches.AgedCache(most, seconds)
        assert [c.step(*x) for x in calls] == brute_cache(most, seconds, calls)


def test_sessions_are_reused_and_evicted():
    c = caches.SessionReuse(2, 10)
    got = [c.step(t, s) for t, s in ((0, "a"), (1, "b"), (9, "a"), (19, "a"), (19, "c"), (19, "d"), (19, "a"))]
    # at 19 a is no longer valid; b, the oldest, goes for c; of a and c, used at the same time, a goes for d
    assert got == ["create", "create", "reuse", "create", "create_evict", "create_evict", "create_evict"]


def test_sessions_in_batch_and_stream_agree(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, r.choice("pq"), float(i // 2), r.randrange(8)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, key string, t double, server int")
    make = lambda k: caches.SessionReuse(4, 9.0)
    want = sorted(map(tuple, state.replay(df, "key", ["t", "id"], make, ["t", "server"], ["id"], "id long").collect()))
    assert {x[1] for x in want} == {"reuse", "create", "create_evict"}
    for part in range(2):
        spark.createDataFrame(rows[part * 300 : part * 300 + 300], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        stateful.to_table(stateful.decide(stream, "key", ["t", "id"], make, ["t", "server"], ["id"], "id long"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((x.id, x.decision) for x in spark.read.parquet(str(tmp_path / "out")).collect()) == want


LAYERS = "k string, n int, name string, servers array<string>, limits struct<most:int,seconds:int,meta:struct<source:string,v:int>>, meta struct<source:string,v:int>"


def test_layers_override_field_by_field(spark):
    rows = [
        ("a", 1, "base", ["x", "y"], (10, 20, ("file", 1)), ("m", 1)),
        ("a", 2, "", [], (0, 30, ("", 2)), ("", 2)),
        ("a", 3, None, ["z"], (5, None, None), None),
        ("b", 1, "only", None, None, None),
        ("c", 1, "", [], (None, 0, None), ("", 7)),
    ]
    got = {x.k: x for x in layers.override(spark.createDataFrame(rows, LAYERS).repartition(3), "k", "n").collect()}
    assert (got["a"].name, got["a"].servers, got["a"].limits.most, got["a"].limits.seconds) == ("base", ["z"], 5, 30)
    assert tuple(got["a"].limits.meta) == ("file", 1) and tuple(got["a"].meta) == ("m", 1)
    assert (got["b"].name, got["b"].servers, got["b"].limits, got["b"].meta) == ("only", None, None, None)
    assert got["c"].name is None and got["c"].limits is not None and got["c"].limits.most is None and got["c"].meta is None


def test_a_slow_and_a_broken_server_leave_the_others(spark):
    def connect(address):
        if address == "slow":
            time.sleep(60)
        if address == "broken":
            raise ConnectionError
        return [{"name": f"{address}-{i}", "description": "d", "inputSchema": {"a": [1, "é"]}} for i in range(int(address))]

    servers = [("one", "1"), ("none", "0"), ("s", "slow"), ("b", "broken"), ("three", "3"), ("odd", "x")]
    began = time.time()
    got = sorted(map(tuple, fanout.tool_lists(spark, servers, connect, 2.0).collect()), key=str)
    assert time.time() - began < 40
    assert [x for x in got if x[4]] == [("b", None, None, None, "ConnectionError"), ("odd", None, None, None, "ValueError"), ("s", None, None, None, "no answer in 2 seconds")]
    assert [x[:2] for x in got if not x[4]] == [("one", "1-0"), ("three", "3-0"), ("three", "3-1"), ("three", "3-2")] and got[-1][3] == '{"a":[1,"é"]}'
    assert fanout.tool_lists(spark, [], connect).count() == 0


def test_settings_of_a_real_form(spark):
    rows = [("cursor", '{"mcp_servers": {"a": {"command": "/bin/x", "args": ["1"]}}}'), ("cursor", '{"mcpServers": {"a": {"command": "y"}}}'), ("claude", '{"mcpServers": {"b": {"command": "z"}}}')]
    got = services.discovered_servers(spark.createDataFrame(rows, "source string, text string")).select("source", "name", "command").collect()
    assert sorted(map(tuple, got)) == [("claude", "b", "z"), ("cursor", "a", "/bin/x")]


def test_patterns_the_engine_refuses():
    for p in (r"(?=a)b", r"(?<!x)ab", r"(?>a+)b", r"\bfoo\Z", r"(?P<n>a)(?P=n)", "a{2000}", r"(a)\1", "(", "(a+)+"):
        assert text.refused_pattern(p), p
    for p in (r"AKIA[0-9A-Z]{16}", r"(?i)token\s*=\s*\S+ # a comment", r"\bfoo\z", r"(?P<n>a)b"):
        assert text.refused_pattern(p) is None, p


def test_dashboard_has_day_and_week(spark):
    rows = [("t", "s", 1, "2024-01-14 23:59:59"), ("t", "s", 2, "2024-01-15 00:00:00"), ("u", "s", 4, "2024-01-18 00:00:00"), ("u", "r", 8, "2024-01-18 12:00:00"), ("u", "r", 16, "2024-01-18 12:00:01")]
    log = spark.createDataFrame(rows, "tool string, server string, tokens long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    body = services.dashboard_json(log, F.lit("2024-01-18 12:00:00").cast("timestamp_ntz")).first().body
    assert '"today_spend":12' in body and '"wtd_spend":14' in body and '"total_spend":31' in body


def test_a_move_that_fails_keeps_the_old_snapshot(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "stats")
    sinks.replace_snapshot(spark.range(3), path)
    files, where = sinks._files(spark, path)

    class Stuck:
        """Moves nothing that is new."""

        def __getattr__(self, name):
            return getattr(files, name)

        def rename(self, a, b):
            return files.rename(a, b) if ".new-" not in a.toString() else False

    monkeypatch.setattr(sinks, "_files", lambda *_: (Stuck(), where))
    with pytest.raises(OSError):
        sinks.replace_snapshot(spark.range(5), path)
    assert spark.read.json(path).count() == 3


def test_servers_of_a_table_are_asked_and_written_by_tasks(spark, tmp_path):
    texts = spark.createDataFrame([(i, '{"tools": [{"name": "t%d ü"}]}' % i if i % 3 else '{"tools": [') for i in range(40)], "server long, text string")
    folder = f"file:{tmp_path}/m"
    fanout.write_manifests(texts, folder)
    fanout.write_manifests(texts, folder)  # as when tasks run twice
    assert sorted(p.name for p in (tmp_path / "m" / "server=7").iterdir()) == ["manifest.txt"]
    servers = spark.range(45).selectExpr("id as server", f"concat('{folder}/server=', id) as address")
    got = sorted((int(r.server), r.tool, r.error) for r in fanout.ask_servers(servers).collect())
    want = [(i, f"t{i} ü", None) if i % 3 and i < 40 else (i, None, "FileNotFoundError" if i >= 40 else "JSONDecodeError") for i in range(45)]
    assert got == want
    assert fanout.ask_servers(servers.limit(0)).count() == 0


def test_tasks_get_no_servers_but_their_own():
    reader = fanout.ToolListReader([(f"s{i}", f"/folder/{i}") for i in range(10_000)], fanout.manifest_folder, 1.0)
    # 300 kB with all servers
    assert len(cloudpickle.dumps(reader)) < 10_000 and len(reader.partitions()) == fanout.MAX_PARTITIONS
