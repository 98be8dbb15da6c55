import json
import os
import zlib

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tokenscope.operators import budgets, embed, services, tools, vectors
from tokenscope.sources import alerts, refresh, sinks
from tokenscope.streaming import stateful, status


def put(folder, lines, name="a.json"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines))


def test_an_unchanged_feed_makes_no_batch_and_restarts_go_on(spark, tmp_path):
    feed, batches = tmp_path / "feed", []

    def poll():
        stream = refresh.refreshes(spark, str(feed), str(tmp_path / "kept"), "name string, n int")
        q = stream.writeStream.foreachBatch(lambda b, i: batches.append(sorted(map(tuple, b.collect())))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    poll()
    # a stream's first batch is made whatever there is
    assert batches == [[]]
    batches.clear()
    put(feed, ['{"name": "x", "n": 1}', "", "no json", '{"name": "y", "n": 2}', '{"n": 3}'])
    poll()
    assert batches == [[(1, "x", 1), (1, "y", 2)]]
    put(feed, ['{"n": 3}', '{"name": "y", "n": 2}', "no json", '{"name": "x", "n": 1}'])
    poll()
    assert len(batches) == 1
    put(feed, ['{"name": "z", "n": 1}'])
    poll()
    put(feed, ['{"name": "x", "n": 1}'], "b.json")
    poll()
    assert batches[1:] == [[(2, "z", 1)], [(3, "x", 1), (3, "z", 1)]]


def test_a_batch_that_runs_again_reads_what_it_read(tmp_path):
    feed = tmp_path / "feed"
    put(feed, ['{"name": "x"}'])
    r = refresh.FeedRefreshReader(str(feed), str(tmp_path / "kept"))
    start, end = r.initialOffset(), r.latestOffset()
    put(feed, ['{"name": "other"}'])
    again = refresh.FeedRefreshReader(str(feed), str(tmp_path / "kept"))
    rows = [x for p in again.partitions(start, end) for x in again.read(p)]
    assert rows == [(1, '{"name": "x"}')]
    newer = again.latestOffset()
    again.commit(end)
    assert newer["version"] == 2 and len(again.partitions(start, end)) == 1
    again.commit(newer)
    assert [x[:9] for x in os.listdir(tmp_path / "kept")] == ["000000002"]


def test_alerts_at_each_threshold_once(spark):
    rows = [("a", 1, "2024-01-01 00:00:00", 70), ("a", 2, "2024-01-01 01:00:00", 10), ("a", 3, "2024-01-02 00:00:00", 5), ("a", 4, "2024-01-02 00:00:00", 500), ("b", 5, "2024-01-01 00:00:00", 200), (None, 6, "2024-01-03 00:00:00", 80), ("c", 7, "2024-01-01 00:00:00", None)]
    use = spark.createDataFrame(rows, "team string, id long, ts string, tokens long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = budgets.budget_alerts(use, ["team"], ["ts", "id"], F.lit(100)).select("team", "id", "usage", "threshold").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 2, 80, 80), ("a", 4, 585, 100), ("b", 5, 200, 80), ("b", 5, 200, 100), (None, 6, 80, 80)], key=str)
    one = budgets.BudgetAlerts(100)
    assert [one.step(n) for n in (70, 10, 5, 500, 1)] == ["", "80", "", "100", ""]
    assert budgets.budget_alerts(use, ["team"], ["ts", "id"], F.lit(None)).count() == 0


def test_a_retried_batch_of_alerts_is_written_once(tmp_path):
    from pyspark.sql import Row

    told = []
    w = alerts.AlertWriter(str(tmp_path), told.append)
    rows = [Row(team="a", threshold=80), Row(team="é", threshold=100)]
    w.commit([w.write(iter(rows)), w.write(iter([]))], 0)
    w.commit([w.write(iter(rows)), w.write(iter([]))], 0)
    w.commit([w.write(iter([]))], 1)
    lost = w.write(iter(rows))
    w.abort([lost, None], 2)
    found = [json.loads(x) for f in tmp_path.glob("batch-*/part-*") for x in f.read_text().splitlines()]
    assert found == [{"team": "a", "threshold": 80}, {"team": "é", "threshold": 100}]
    assert told == [f"{tmp_path}/batch-000000000"] and not list((tmp_path / "_new").iterdir())
    fails = alerts.AlertWriter(str(tmp_path), lambda f: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        fails.commit([fails.write(iter(rows))], 3)
    w.commit([w.write(iter(rows))], 3)
    assert told[1:] == [f"{tmp_path}/batch-000000003"] and len(list(tmp_path.glob("batch-000000003/part-*"))) == 1


def test_alerts_of_a_stream(spark, tmp_path):
    rows = [(i, f"t{i % 3}", 30) for i in range(24)]
    for part in range(2):
        df = spark.createDataFrame(rows[part * 12 : part * 12 + 12], "id long, team string, tokens long")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        decided = stateful.decide(stream, "team", ["id"], lambda k: budgets.BudgetAlerts(200), ["tokens"], ["id", "team"], "id long, team string")
        alerts.alert_sink(decided.where("decision <> ''"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.json(str(tmp_path / "out" / "batch-*"))
    # 160 is reached by the sixth row of a team, 200 by the seventh
    assert sorted((x.id, x.team, x.decision) for x in got.collect()) == sorted([(15 + i, f"t{i}", "80") for i in range(3)] + [(18 + i, f"t{i}", "100") for i in range(3)])


def test_tools_of_ones_own(spark):
    tools.register(spark, {"twice": tools.Tool("x int", lambda a: [(a["n"],), (a["n"] * 2,)])}, "my_tool")
    spark.createDataFrame([(1, '{"n": 4}'), (2, "[1]"), (3, None), (4, '{"n": 5}')], "id int, args string").createOrReplaceTempView("ts_calls")
    got = spark.sql("select id, x, error from ts_calls, lateral my_tool('twice', args)").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 4, None), (1, 8, None), (2, None, "ValueError"), (3, None, "KeyError"), (4, 10, None), (4, 5, None)]
    with pytest.raises(AnalysisException):
        spark.sql("select * from my_tool('other', '{}')")


def test_a_status_batch_that_runs_again_keeps_its_changes(spark, tmp_path):
    def run(rows, cp):
        spark.createDataFrame(rows, "server string, ts string, failed boolean").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("server string, ts timestamp, failed boolean").parquet(str(tmp_path / "in"))
        status.status_sink(stream, str(tmp_path / "s"), str(tmp_path / cp)).awaitTermination()
        return sorted(map(tuple, status.status_changes(spark, str(tmp_path / "s")).select("batch", "server", "event", "status").collect()))

    first = run([("a", "2024-01-01 00:00:00", False), ("b", "2024-01-01 00:00:00", True), ("b", "2024-01-01 00:00:00", False)], "cp")
    assert first == [(0, "a", "added", "running"), (0, "b", "added", "error")]
    # the commit of the first batch is lost: it runs again after its snapshot was written
    (tmp_path / "cp" / "commits" / "0").unlink()
    (tmp_path / "cp" / "commits" / ".0.crc").unlink(missing_ok=True)
    second = run([("b", "2024-01-02 00:00:00", False), ("c", "2024-01-02 00:00:00", None)], "cp")
    assert second == [*first, (1, "b", "changed", "running"), (1, "c", "added", "running")]
    now = sinks.load_snapshot(spark, str(tmp_path / "s"), status.STATUS).orderBy("server").collect()
    assert [(x.server, x.status, x.requests, x.errors) for x in now] == [("a", "running", 1, 0), ("b", "running", 3, 1), ("c", "running", 1, 0)]


def test_durations_and_rates(spark):
    rows = [("1h2m3.5s", 3723.5), ("250ms", 0.25), ("90s", 90.0), ("-1m0s", -60.0), ("0s", 0.0), ("soon", 0.0), (None, 0.0), ("", 0.0), ("15µs", 1.5e-5)]
    got = spark.createDataFrame(rows, "d string, want double").select("want", services.seconds_of(F.col("d")).alias("got")).collect()
    assert all(abs(x.got - x.want) < 1e-9 for x in got)
    files = spark.createDataFrame([("generic", '{"mcp_servers": {"g": {"command": "/a/b"}}}')], "source string, text string")
    assert [tuple(x) for x in services.discovered_servers(files).select("name", "cwd").collect()] == [("g", "/a")]


class Picky:
    """Fails on every batch that holds a bad text."""

    def embed(self, texts):
        if "bad" in texts:
            raise ValueError
        return np.array([[len(t), 1.0] for t in texts])


def test_a_bad_text_leaves_the_others_their_vectors(spark):
    rows = [(1, "ab"), (2, "bad"), (3, None), (4, ""), (5, "é" * 60)]
    df = spark.createDataFrame(rows, "id int, `a text` string").coalesce(1)
    got = {x.id: (x.vector, x.error) for x in embed.embedded(df, "a text", Picky, "picky", 100).collect()}
    assert got == {1: ([2.0, 1.0], None), 2: (None, "ValueError"), 3: (None, None), 4: ([0.0, 1.0], None), 5: (None, "payload too large")}
    assert embed.embedded(df.limit(0), "a text", Picky, "picky").count() == 0


def test_near_prompts_are_hits_of_the_cache(spark):
    texts = [(1, "How many orders were shipped to Peru in May?"), (2, "Summarise the last incident report."), (3, "")]
    asked = [(10, "How many orders were shipped to Peru in May ?"), (11, "Write a poem about rain."), (12, "summarise the last incident report."), (13, "")]
    stored = embed.embedded(spark.createDataFrame(texts, "id long, text string"), "text")
    requests = embed.embedded(spark.createDataFrame(asked, "qid long, text string"), "text")
    same = lambda df: df.withColumns({"tool": F.lit("t"), "day": F.lit(1)})
    entries = same(stored.select("id", F.concat(F.lit("k"), "id").alias("key")))
    out = vectors.semantic_hits(same(requests.select("qid", F.col("text").alias("key"), "vector")), entries, stored.select("id", "vector"), 0.9)
    assert {x.qid: (x.kind, x.id) for x in out.collect()} == {10: ("semantic", 1), 11: ("miss", None), 12: ("semantic", 2), 13: ("miss", None)}
    # plain counts give the same vector
    text, want = "Abcab", [0.0] * 256
    for g in ("abc", "bca", "cab"):
        h = zlib.crc32(g.encode())
        want[(h >> 1) % 256] += 1 - 2 * (h & 1)
    size = sum(x * x for x in want) ** 0.5
    assert np.allclose(embed.HashedGrams().embed([text])[0], np.array(want) / size)


def test_session_reports_as_json(spark):
    use = spark.createDataFrame([("a", "x", 0, 0), ("a", "y|", 200, 50), (None, "x", 3, 1)], "session string, server string, original long, saved long")
    events = spark.createDataFrame([("a", "secret"), ("a", "odd"), ("b", "pii"), (None, "pii")], "session string, kind string")
    got = {x.session: json.loads(x.body) for x in services.session_json(use, events).collect()}
    assert set(got) == {"a", None} and got[None]["session_id"] == "" and got[None]["risk_summary"]["pii"] == 1
    assert got["a"]["summary"] == {"total_requests": 2, "total_tokens_saved": 50, "savings_percentage": 25.0, "security_risks_intercepted": 2}
    assert [(x["server"], x["savings_percentage"]) for x in got["a"]["token_savings"]] == [("x", 0.0), ("y|", 25.0)]
    assert got["a"]["risk_summary"] == {"api_key": 0, "secret": 1, "pii": 0, "custom_pattern": 0}
    assert services.session_json(use.limit(0), events).count() == 0


def test_session_report_rounds_as_printf(spark):
    pairs = [(272, 512), (1, 1600), (203, 20000), (201, 20000), (3, 32), (12345, 100), (0, 0)]
    rows = spark.createDataFrame([(str(i), 1, o, s, 0) for i, (s, o) in enumerate(pairs)], "session string, requests long, original long, saved long, risks long")
    got = {r.session: r.report for r in services.session_report(rows).collect()}
    for i, (s, o) in enumerate(pairs):
        assert f"| **Total Tokens Saved** | **{s} ({s * 100.0 / o if o else 0:.2f}%)** |" in got[str(i)]
