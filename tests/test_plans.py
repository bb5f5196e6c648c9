import os
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mnemolith.plans import ask, registry

D = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return round(v, 5)
    return v.replace(tzinfo=None) if isinstance(v, datetime) else v


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(entry.core.SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"create view {f.split('.')[0]} as select * from '{D}/{f}'")
    df = entry.queries()[name](spark, D)
    cur = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(n) for n in df.columns]
    assert sorted((tuple(map(norm, r)) for r in df.collect()), key=repr) == sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def test_prompts_by_key(spark):
    rows = [("A-1", None, "p1", 1), (" a-1\u00a0", "x", "p9", 5), ("b-2", " A-1 ", None, 2), ("C-3", "B-2", "", 3), ("d-4", "gone", None, 4), ("e-5", "f-6", None, 6), ("f-6", "E-5", None, 7), ("g-7", None, "p2", 8), ("h-8", "g-7 ", "p3", 9), (" ", None, "p4", 10), (None, None, "p5", 11)]
    raw = spark.createDataFrame(rows, "message_uuid string, parent_uuid string, prompt_id string, seq long")
    got = {r.message_uuid: r.prompt for r in entry.core.sessions.inherited_prompts(entry.core.sessions.one_per_message(raw)).collect()}
    assert got == {"a-1": "p1", "b-2": "p1", "c-3": "p1", "d-4": None, "e-5": None, "f-6": None, "g-7": "p2", "h-8": "p3"}


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")
def test_all_records_are_nodes(spark):
    links = {(min(r), max(r)) for r in entry.queries()["j6_backlinks"](spark, D).collect()}
    got = [tuple(r) for r in entry.queries()["g1_all_records"](spark, D).collect()]
    assert len(got) == len(set(got)) and set(got) == links and any(a % 3 == 0 or b % 3 == 0 for a, b in links)


def test_entry(spark):
    if os.path.isdir(D):
        assert entry.entry(spark).columns == ["id", "score"]


def test_ask(spark):
    now = datetime(2026, 6, 17)
    assert ask.plan("昨天做了什么", now).kind == "time" and ask.plan("橘粒和瑞福莱什么关系", now).pair == ("橘粒", "瑞福莱")
    assert ask.plan("有多少合同", now).kind == "aggregate" and ask.plan("RSA 加密算法", now).kind == "entity"
    r = spark.createDataFrame([("1", "the kernel rollback plan", "organized", datetime(2026, 6, 16, 3)), ("2", "garlic", "inbox", datetime(2026, 1, 1))], "id string, content string, phase string, created_at timestamp")
    assert [x.id for x in ask.retrieve(r, "yesterday", now).collect()] == ["1"]
    assert [x.id for x in ask.retrieve(r, "kernel rollback", now).collect()] == ["1"]
    assert {(x.phase, x.n) for x in ask.retrieve(r, "how many", now).collect()} == {("organized", 1), ("inbox", 1)}
    assert ask.search_loop(r, "kernel garlic") == ["2", "1"] or set(ask.search_loop(r, "kernel garlic")) == {"1", "2"}


def test_registry(spark):
    class Up:
        name, consumer = "up", "enrich-tags"

        def process(self, df):
            return registry.model_stage(df)

    reg = registry.Registry()
    reg.add_processor(Up())
    with pytest.raises(ValueError):
        reg.add_processor(Up())
    r = spark.createDataFrame([("1", "kernel rollback regression", 0), ("2", "seen already", 4)], "id string, content string, consumed_mask long")
    got = reg.run("up", r).collect()
    assert [(x.id, x.labels) for x in got] == [("1", ["kernel", "rollback", "regression"])]
    assert r.where(F.col("id") == "1").count() == 1
