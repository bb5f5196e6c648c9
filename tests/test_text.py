from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mnemolith.functions import jsonx
from mnemolith.functions import text as T
from mnemolith.functions.timeparse import duration, reminder_time, time_intent, time_param

NOW = datetime(2026, 6, 17, 10, 0)


def values(spark, texts, make):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(make(F.col("t"))).collect()]


def test_keywords(spark):
    got = values(spark, ["react react React the the the 123 456 v2.0", "需要做状态管理", "前端 message 需要做状态管理，参考 react 的 useReducer", None, ""], T.keywords)
    assert got[0] == ["v2.0", "react"] and got[1] == [] and "message" in got[2] and got[3] == [] and got[4] == []


def test_categories(spark):
    texts = ["I prefer dark mode", "We decided to ship", "lesson: check first", "remind me", "how to build", "plain words here", "，", "我喜欢。"]
    assert values(spark, texts, T.category_by_rules) == ["preferences", "decisions", "lessons", "reminders", "skills", "knowledge", "inbox", "inbox"]
    assert values(spark, ["我喜欢。"], lambda c: T.category_by_rules(c, cjk_cues=True)) == ["preferences"]


def test_category_names(spark):
    assert values(spark, ["car-agent]]-[[x", "a" * 41, "preference", "Preferences", "car-agent", "[[Skill]]", "carAgent", "", None], T.normal_category) == ["inbox", "inbox", "preferences", "preferences", "car-agent", "skills", "car-agent", "inbox", "inbox"]


def test_links_terms_fingerprint(spark):
    assert values(spark, ["[[ Go ]] [[Go]] [[a\nb]] [[]]", None], T.wiki_links) == [["Go", "a\nb"], []]
    assert values(spark, ["The v2.0 合同金额 a"], T.terms) == [["v2.0", "合同", "合同金", "合同金额"]]
    assert values(spark, ["A  b\r\nc ", None], T.fingerprint) == ["a b c", None]
    assert values(spark, ["/x/My-Proj/", "", "C:\\a\\B"], T.project_from_path) == ["my-proj", "", "b"]


def test_noise(spark):
    assert values(spark, ["short", "/clear the whole thing", "$ ls -la /tmp/x", "<bash-input>rm", "?!?!?!?!?!?!", "a real sentence here"], T.is_noise) == [True, True, True, True, True, False]
    assert values(spark, [" [thinking] x", "Q: <task-notification>", "fine"], T.is_noise_event) == [True, True, False]


def test_blocks(spark):
    got = values(spark, ['[{"type":"text","text":"a"},{"type":"thinking","text":"b"},{"type":"text","text":"c"}]', "plain", "[]"], T.block_text)
    assert got == ["a\nc", "plain", ""]


def test_kinds(spark):
    assert values(spark, ["Foo GmbH", "WS-2026-1", "foo.com", "json lib", "idea"], T.entity_kind) == ["company", "identifier", "domain", "technology", "concept"]


def test_tags(spark):
    df = spark.createDataFrame([([" ui ", "", "ui", None, "Go"],), (None,)], "tags array<string>")
    assert [r[0] for r in df.select(T.normal_tags(F.col("tags"))).collect()] == [["ui", "Go"], []]
    assert [r[0] for r in df.select(T.has_all_tags(T.normal_tags(F.col("tags")), ["go"])).collect()] == [True, False]


def test_json():
    assert jsonx.first_json('x ```json\n{"a": [1, 2,]}\n``` y') == {"a": [1, 2]}
    assert jsonx.string_array('say ["a", " ", "b"]') == ["a", "b"] and jsonx.string_array(None) == []


def test_merge_patch(spark):
    df = spark.createDataFrame([('{"a":"1","b":"2"}', '{"b":"3"}'), (None, '{"b":"3"}'), ("broken", None)], "m string, p string")
    got = [r[0] for r in df.select(jsonx.merge_patch(F.col("m"), F.col("p"))).collect()]
    assert got[0] == '{"a":"1","b":"3"}' and got[1] == '{"b":"3"}' and got[2] == "{}"


def test_times():
    assert time_param("-7d", NOW) == datetime(2026, 6, 10, 10) and time_param("", NOW) is None
    with pytest.raises(ValueError):
        duration("soon")
    day = lambda m, d, y=2026: datetime(y, m, d)
    for q, a, b in [("近3天做了什么", day(6, 14), NOW), ("上周", day(6, 8), day(6, 15)), ("今天", day(6, 17), day(6, 18)), ("6月3日到6月5日", day(6, 3), day(6, 6)), ("2025年8月初", day(8, 1, 2025), day(8, 11, 2025)), ("7月", day(7, 1, 2025), day(8, 1, 2025)), ("2026-01-02", day(1, 2), day(1, 3))]:
        r = time_intent(q, NOW)
        assert (r.start, r.end) == (a, b), q
    assert time_intent("what is a kernel", NOW) is None
    assert reminder_time("2小时后开会", NOW) == datetime(2026, 6, 17, 12) and reminder_time("2026-06-20 15:30", NOW) == datetime(2026, 6, 20, 15, 30)
    assert reminder_time("大后天", NOW).day == 20 and reminder_time("hello", NOW) == datetime(2026, 6, 17, 11)
