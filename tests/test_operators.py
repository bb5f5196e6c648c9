from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemolith.operators import graph, ingest, search, sessions, state, stats, usage, versioning
from mnemolith.operators.components import components
from mnemolith.operators.dedup import winners

T0 = datetime(2026, 1, 1)
RAW = "seq long, content string, source string, session_id string, project string, ingested_at timestamp"


def test_gate(spark):
    rows = [("", "inbox", None, None), ("  ", "inbox", None, None), ("x" * (100 * 1024 + 1), "inbox", None, None), ("ok", "bogus", None, None), (" 用户偏好深色模式 ", "inbox", "not-a-cat", [" ui ", "", "ui"]), (None, None, None, None)]
    got = ingest.gated(spark.createDataFrame(rows, "content string, phase string, category string, tags array<string>")).collect()
    assert [r.verdict for r in got] == ["empty", "empty", "too_long", "bad_phase", "ok", "empty"]
    assert got[4].content == "用户偏好深色模式" and got[4].tags == ["ui"] and got[4].category == "inbox"


def test_log_and_provenance(spark):
    rows = [(2, " same ", "b", "", "p1", T0), (1, "same", "a", "", "", T0), (3, "same", "c", "s3", "p3", T0), (4, "", "d", "s", "p", T0), (5, None, "d", "s", "p", T0)]
    raw = spark.createDataFrame(rows, RAW)
    log = ingest.event_log(raw).collect()
    assert [(r.seq, r.source, r.deliveries) for r in log] == [(1, "a", 3)]
    p = ingest.provenance(raw, ("session_id", "project")).collect()
    assert [(r.session_id, r.project) for r in p] == [("s3", "p1")]
    assert ingest.event_log(raw.limit(0)).count() == 0


def test_replay_skips_noise(spark):
    rows = [(1, "a real event here", "x", "s", "p", T0), (2, "[thinking] hm", "x", "", "", T0), (3, "Q: <task-notification> y", "x", "", "", T0)]
    cols = RAW + ", tmux_session string, message_uuid string, parent_uuid string, role string, git_branch string, model string, prompt_id string"
    got = ingest.replay(spark.createDataFrame([(*r, *[""] * 7) for r in rows], cols)).collect()
    assert len(got) == 1 and got[0].phase == "inbox" and got[0].project == "p" and got[0].consumed_mask == 0


def test_marks(spark):
    r = spark.createDataFrame([("a", 0), ("b", None)], "id string, consumed_mask long")
    m = spark.createDataFrame([("a", "consolidate-llm"), ("a", "enrich-tags"), ("a", "nobody"), ("b", "nobody")], "id string, consumer string")
    assert {x.id: x.consumed_mask for x in ingest.apply_marks(r, m).collect()} == {"a": 6, "b": 0}


def test_upsert_keeps_phase_and_fills(spark):
    s = "hash string, id string, phase string, project string, tags array<string>"
    out = ingest.upsert(spark.createDataFrame([("h", "1", "organized", "", ["a"])], s), spark.createDataFrame([("h", "2", "inbox", "p", ["b"]), ("g", "3", "inbox", "q", None)], s))
    got = {r.hash: (r.id, r.phase, r.project, r.tags) for r in out.collect()}
    assert got == {"h": ("1", "organized", "p", ["a", "b"]), "g": ("3", "inbox", "q", [])}


def test_numbered(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", "seq")
    assert [r.n for r in ingest.numbered(df, "seq").orderBy("seq").collect()] == list(range(1, 144))


def records(spark, texts):
    return spark.createDataFrame([(f"r{i}", t, T0 + timedelta(minutes=i), ["x"], "global", "src", 0, "organized") for i, t in enumerate(texts)], "id string, content string, created_at timestamp, tags array<string>, scope string, source string, access_count int, phase string")


def test_search(spark):
    r = records(spark, ["橘粒科技和瑞福莱暖通签订网站开发合同，报价5万4", "项目技术架构采用 React + Next.js", "unrelated note about weather", "dark mode preference", None, ""])
    assert "橘粒" in search.idf_search(r, "橘粒科技 合同 报价").head().content
    assert search.idf_search(r, "瑞福莱暖通设备有限公司").head().id == "r0"
    assert [x.id for x in search.any_keyword(r, "dark").collect()] == ["r3"]
    assert search.idf_search(r, "").count() == 0 and search.idf_search(r, "100%_").count() == 0
    assert search.hybrid_search(r, "dark").count() == 1 and search.bm25_search(r, "dark mode").head().id == "r3"
    assert search.smart_search(r, "dark mode", T0).head().id == "r3"
    assert [x.id for x in search.expansion_search(r, "dark").collect()] == ["r3"]
    assert search.idf_search(r.limit(0), "dark").count() == 0


def test_query_parsing():
    assert search.split_query("A or B|c,d，e\tf") == list("abcdef")
    assert search.trigram_match("hello") == '"hello"' and search.trigram_match("橘粒科技 网站开发") == '"橘粒科技" OR "网站开发"'
    assert search.trigram_match("a OR b") == "" and search.trigram_match("合同 报价") == "" and search.trigram_match(" ") == ""
    assert search.trigram_match('say "hello"') == '"say" OR """hello"""'
    assert search.question_keywords("瑞福莱 合同 金额 的") == ["瑞福莱", "合同", "金额"]


def test_gap_sessions_tie(spark):
    at = [T0, T0 + timedelta(minutes=30), T0 + timedelta(minutes=60, seconds=1)]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(at)] + [(9, 1, None)], "id int, u int, ts timestamp")
    assert [r.session_no for r in sessions.gap_sessions(df, "u", "ts", "id").orderBy("id").collect()] == [1, 1, 2]


def test_chunks(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([10, 10, 50, 10, 10])], "s string, i int, n int")
    got = [r.chunk_no for r in sessions.chunks(df, "s", "i", "n", max_items=2, max_bytes=40).orderBy("i").collect()]
    assert got == [0, 0, 1, 2, 2]


def test_prompts_down_the_chain(spark):
    rows = [("a", "", "p1"), ("b", "a", ""), ("c", "b", None), ("d", "c", "p2"), ("e", "d", ""), ("x", "y", ""), ("y", "x", ""), ("z", "gone", "")]
    got = {r.message_uuid: r.prompt for r in sessions.inherited_prompts(spark.createDataFrame(rows, "message_uuid string, parent_uuid string, prompt_id string")).collect()}
    assert got == {"a": "p1", "b": "p1", "c": "p1", "d": "p2", "e": "p2", "x": None, "y": None, "z": None}


def test_repeats_and_rates(spark):
    rows = [(i, "s", "f", T0 + timedelta(seconds=20 * i), 1.0, False) for i in range(40)]
    df = usage.with_repeats(spark.createDataFrame(rows, "id int, session string, fn string, ts timestamp, tokens double, error boolean"), ("session", "fn"))
    assert df.where("repeat").count() == 39
    assert usage.over_frequency(df, short=3, long=100).head()["in_1_min"] == 4
    assert usage.rollup(df, ["fn"]).head().calls == 40


def test_superseded(spark):
    rows = [("old", "瑞福莱暖通设备合同金额42000元，甲方上海橘粒科技", T0, "organized", "knowledge", "p"), ("new", "瑞福莱暖通设备合同金额54000元，甲方上海橘粒科技", T0 + timedelta(days=1), "organized", "knowledge", "p"), ("inbox", "瑞福莱暖通设备合同金额54000元，甲方上海橘粒科技", T0 + timedelta(days=2), "inbox", "knowledge", "p"), ("null", None, T0, "organized", "knowledge", "p")]
    got = versioning.superseded(spark.createDataFrame(rows, "id string, content string, created_at timestamp, phase string, category string, project string"), shared=1).collect()
    assert [(r.id, r.superseded_by) for r in got] == [("old", "new")]


@pytest.mark.parametrize("shared", [1, 2, 3])
def test_superseded_brute_force(spark, shared):
    import random

    rnd = random.Random(shared)
    words = [f"w{i}" for i in range(12)]
    rows = [(f"r{i}", " ".join(rnd.choices(words, k=5)), T0 + timedelta(minutes=rnd.randrange(40)), "organized", "c", "p") for i in range(60)]
    got = {r.id: r.superseded_by for r in versioning.superseded(spark.createDataFrame(rows, "id string, content string, created_at timestamp, phase string, category string, project string"), shared=shared).collect()}
    exp = {}
    for a in rows:
        later = [(b[2], b[0]) for b in rows if b[2] > a[2] and len(set(a[1].split()) & set(b[1].split())) >= shared and len(set(b[1].split())) >= shared]
        if later and len(set(a[1].split())) >= shared:
            exp[a[0]] = min(later)[1]
    assert got == exp


@pytest.mark.parametrize("block", [600, 3_000, 1 << 20])
def test_superseded_in_parts(spark, block):
    """Keys larger than a block, equal times across parts, records without a successor near by."""
    import random

    rnd = random.Random(block)
    rows = [(f"r{i:03}", " ".join(rnd.sample([f"w{x}" for x in range(30 if i % 3 else 400)], k=4)), T0 + timedelta(minutes=rnd.randrange(60)), "organized", "c", rnd.choice("ppppq")) for i in range(400)]
    got = {r.id: r.superseded_by for r in versioning.superseded(spark.createDataFrame(rows, "id string, content string, created_at timestamp, phase string, category string, project string"), shared=2, block=block).collect()}
    exp = {}
    for a in rows:
        later = [(b[2], b[0]) for b in rows if b[5] == a[5] and b[2] > a[2] and len(set(a[1].split()) & set(b[1].split())) >= 2]
        if later:
            exp[a[0]] = min(later)[1]
    assert got == exp and 100 < len(exp) < 400


def test_superseded_moves_no_pairs(spark, tmp_path):
    """1,500 records of one key that all share terms: what is shuffled is a few bytes per record, not a row per pair."""
    rows = [(f"r{i:04}", f"alpha beta gamma w{i % 40} v{i % 30}", T0 + timedelta(minutes=i), "organized", "c", "p") for i in range(1_500)]
    spark.createDataFrame(rows, "id string, content string, created_at timestamp, phase string, category string, project string").write.parquet(f"{tmp_path}/m")
    before = _shuffled(spark)
    got = {r.id: r.superseded_by for r in versioning.superseded(spark.read.parquet(f"{tmp_path}/m")).collect()}
    assert got == {f"r{i:04}": f"r{i + 1:04}" for i in range(1_499)}
    assert _shuffled(spark) - before < 500 * len(rows)


def _shuffled(spark):
    """Bytes written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(10_000)
    return sum(sc.statusStore().executorList(False).apply(i).totalShuffleWrite() for i in range(sc.statusStore().executorList(False).size()))


def test_graph_and_merge(spark):
    e = spark.createDataFrame([("1", "fingersaver", "concept", ["fs"]), ("2", "makro", "concept", None), ("3", "go", "concept", [])], "id string, name string, kind string, aliases array<string>")
    m = spark.createDataFrame([("1", "m1", "FS "), ("2", "m1", "x"), ("2", "m2", None), (None, "m2", "y")], "entity_id string, memory_id string, mention_text string")
    assert {r.mention_text: r.entity_id for r in graph.resolve_mentions(e, m).collect()} == {"FS ": "1", "x": None, "y": None}
    assert {r.id: r.n for r in graph.mention_counts(e, m).collect()} == {"1": 1, "2": 2, "3": 0}
    kept, moved = graph.merge_entities(e, m, spark.createDataFrame([("1", "2"), ("3", "1")], "source string, target string"))
    assert [(r.id, r.aliases) for r in kept.collect()] == [("2", ["fingersaver", "fs", "go"])]
    assert moved.where("entity_id = '2'").count() == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (200, 200), (None, 3)] + [(500, x) for x in range(501, 560)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[200] == 200 and all(got[x] == 500 for x in range(500, 560))
    assert components(spark.createDataFrame([], "u int, v int")).count() == 0


def test_links(spark):
    r = spark.createDataFrame([("1", "Alpha\nsee [[beta]]", T0), ("2", "Beta\nsee [[alpha]] [[gone]]", T0), ("3", "beta\nx", T0 + timedelta(days=1))], "id string, content string, created_at timestamp")
    e = graph.resolved_links(r)
    assert {(x.source, x.target) for x in e.collect()} == {("1", "2"), ("2", "1")}
    assert [(x.a, x.b) for x in graph.undirected(e, r).collect()] == [("1", "2")]


def test_state(spark):
    h = spark.createDataFrame([(" p ", 1, "v26"), ("p", 2, "v27"), ("", 3, "no")], "project string, seq int, v string")
    assert [(r.project, r.v) for r in state.latest(h, "project", "seq").collect()] == [("p", "v27")]
    s = spark.createDataFrame([("Reflex site", "deploy", T0), ("other", "x", T0), ("juli", "y", T0)], "entity string, task string, last_seen timestamp")
    a = spark.createDataFrame([("r", "reflex"), ("j", "JULI")], "project string, alias string")
    st = spark.createDataFrame([("r", T0 - timedelta(hours=5))], "project string, updated_at timestamp")
    assert {(g.project, g.delta_hours) for g in state.coverage_gaps(s, st, a, T0).collect()} == {("r", 5.0), ("j", None)}
    q = spark.createDataFrame([(1, "a", None), (2, " ", None), (3, "b", T0)], "id int, fact string, archived_at timestamp")
    assert [r.id for r in state.graduation_queue(q).collect()] == [1, 3]


def test_stats(spark):
    r = spark.createDataFrame([("p", T0), ("p", T0 + timedelta(days=1)), ("p", T0 + timedelta(days=5)), ("p", None)], "project string, ts timestamp")
    assert stats.streaks(r, "project", "ts").collect()[0][1:] == (3, 2)
    assert stats.heatmap(r, "ts").count() == 3
    m = spark.createDataFrame([('{"status":"accepted","domain":" Debugging "}',), ('{"status":"rejected","domain":"debugging"}',), ('{"status":"pending"}',), ("{}",), (None,)], "metadata string")
    got = {x.domain: (x.accepted, x.rejected, x.accept_rate) for x in stats.verdict_evidence(m).collect()}
    assert got == {"debugging": (1, 1, 0.5), "general": (0, 0, None)}


def test_winners(spark):
    rows = [("A ", T0, 5), ("a", T0, 3), ("a", None, 1), ("", T0, 9), (None, T0, 8), ("b", None, 4), ("b", None, 2)]
    got = {r.key: r.seq for r in winners(spark.createDataFrame(rows, "message_uuid string, ingested_at timestamp, seq long")).collect()}
    assert got == {"a": 3, "b": 2}


def test_budget_and_quota(spark):
    df = spark.createDataFrame([(i, "x" * 40, "inbox") for i in range(5)], "id int, content string, phase string")
    assert search.within_budget(df, 25, F.col("id")).count() == 2
    assert search.phase_quota(df, {"inbox": 3}, F.col("id")).count() == 3
    assert search.round_robin(df, "phase", 2, F.col("id")).count() == 2


def test_links_by_hand(spark):
    r = spark.createDataFrame([("1",), ("2",)], "id string")
    none = spark.createDataFrame([], "source string, target string")
    p = spark.createDataFrame([("1", "2"), ("1", "9"), ("2", "2")], "a string, b string")
    e = graph.link(none, p, r)
    assert {tuple(x) for x in e.collect()} == {("1", "2"), ("2", "1")}
    assert graph.unlink(e, p).count() == 0


def test_lookups(spark):
    r = spark.createDataFrame([("ab1", 2, T0), ("ab2", None, T0), ("ab", 0, T0)], "id string, access_count int, updated_at timestamp")
    assert ingest.by_prefix(r, "ab").head().id == "ab" and ingest.by_prefix(r, "ab1").count() == 1 and ingest.by_prefix(r, "x").count() == 0
    with pytest.raises(ValueError):
        ingest.by_prefix(r, "a")
    seen = ingest.with_reads(r, spark.createDataFrame([("ab1", T0 + timedelta(days=1))] * 2, "id string, at timestamp"))
    assert {x.id: x.access_count for x in seen.collect()} == {"ab1": 4, "ab2": 0, "ab": 0}


def test_chunk_project(spark):
    rows = [("s", 0, "p", T0, "1"), ("s", 0, "p", T0, "2"), ("s", 1, "q", T0, "3"), ("s", 1, "", T0, "4"), ("t", 0, None, T0, "5")]
    df = spark.createDataFrame(rows, "session_id string, chunk_no int, project string, created_at timestamp, id string")
    assert {(r.session_id, r.chunk_no): r.project for r in sessions.chunk_project(df).collect()} == {("s", 0): "p", ("s", 1): "p", ("t", 0): ""}


def test_graduation(spark):
    q = spark.createDataFrame([(1, "fact", None, None)], "id int, fact string, archived_at timestamp, pointer string")
    done = state.complete_graduation(q, 1, "docs/x", T0)
    assert done.head().archived_at == T0
    for rows, pointer in ((q, " "), (done, "again")):
        with pytest.raises(ValueError):
            state.complete_graduation(rows, 1, pointer, T0)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id string, content string, created_at timestamp, tags array<string>, scope string, source string, access_count int, phase string, category string, project string, metadata string, consumed_mask long, session_id string")
    assert search.bm25_search(empty, "a").count() == 0 and search.smart_search(empty, "a", T0).count() == 0 and search.expansion_search(empty, "abc").count() == 0
    assert versioning.superseded(empty).count() == 0 and versioning.unique_by_fingerprint(empty).count() == 0
    assert stats.consumer_matrix(empty).count() == 0 and stats.heatmap(empty, "created_at").count() == 0 and stats.verdict_evidence(empty).count() == 0
    assert sessions.pending(empty, 4).count() == 0 and graph.link_edges(empty).count() == 0 and ingest.numbered(empty.select("id"), "id").count() == 0
