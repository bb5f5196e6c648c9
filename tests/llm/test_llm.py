import base64
import itertools
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemolith.llm import conversations, cooccur, copies, entities, neardup, packing, pii, subjects, tokens

T0 = datetime(2026, 1, 1)


# --- 1 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("large", [2, 4, 1000])
def test_co_occurrence_brute_force(spark, large):
    rnd = random.Random(large)
    rows = [(f"e{rnd.randrange(14)}", f"m{rnd.randrange(60)}", "x") for _ in range(500)] + [(None, "m1", "x"), ("e1", None, "x")] * 3
    rows += [(f"e{a}", f"big{b}", "x") for a in range(20) for b in range(7)]
    df = spark.createDataFrame(rows, "entity_id string, memory_id string, c string").withColumn("k", F.lit(1))
    got = {(r.item_a, r.item_b): (r.c, r.a, r.b) for r in cooccur.co_occurrence(df, min_lift=0.5, large=large).collect()}
    baskets = defaultdict(set)
    for e, m, _ in rows:
        if e and m:
            baskets[m].add(e)
    a = Counter(e for b in baskets.values() for e in b)
    c = Counter(p for b in baskets.values() for p in itertools.combinations(sorted(b), 2))
    exp = {p: (n, a[p[0]], a[p[1]]) for p, n in c.items() if n >= 5 and n * len(baskets) >= 0.5 * a[p[0]] * a[p[1]]}
    assert got == exp and exp


def test_co_occurrence_empty(spark):
    assert cooccur.co_occurrence(spark.createDataFrame([], "entity_id string, memory_id string")).count() == 0


# --- 2, 5 -----------------------------------------------------------------------------------------------------------

MEM = "id string, content string, key string, h string"


def brute_copies(rows):
    plain = lambda t: re.sub(r"[\W_]+", "", t.lower())
    return {(a[0], b[0]) for a, b in itertools.combinations(sorted(rows), 2) if a[1] is not None and b[1] is not None and plain(a[1]) == plain(b[1])}


def test_copies(spark):
    rows = [("a", "Hello, World 1"), ("b", "hello world-1!"), ("c", "helloworld 2"), ("d", None), ("e", "owner=ann lee; task=fix it"), ("f", "- **TASK**: Fix it\n- **OWNER**: Ann Lee"), ("g", '{"task": "fix it", "owner": "Ann  Lee"}'), ("h", "owner: ann lee | task: fix it"), ("i", "owner=ann lee; task=fix them"), ("j", "  "), ("k", "…"), ("l", "x" * 200_000), ("m", "X" * 200_000)]
    df = spark.createDataFrame([(*r, "k", "h") for r in rows], MEM)
    got = {tuple(r) for r in copies.copy_pairs(df).collect()}
    assert got == {("a", "b"), ("j", "k"), ("l", "m"), *itertools.combinations("efgh", 2)}
    assert {r.id: r.copies for r in copies.collapse(df).where("copies > 1").collect()} == {"a": 2, "e": 2, "f": 2, "j": 2, "l": 2}
    assert copies.collapse(df).where("NOT clean").count() == 0
    assert copies.copy_pairs(df.limit(0)).count() == 0


def test_copies_in_any_field_order(spark):
    rnd = random.Random(5)
    rows, label = [], {}
    for i in range(300):
        n = rnd.randrange(40)
        fields = [("owner", f"ann {n}"), ("task", f"fix {n % 7}"), ("due", f"day {n % 3}")]
        rnd.shuffle(fields)
        t = rnd.choice([lambda f: "; ".join(f"{k}={v}" for k, v in f), lambda f: "\n".join(f"- **{k.upper()}**: {v}" for k, v in f), lambda f: "{" + ", ".join(f'"{k}": "{v}"' for k, v in f) + "}"])(fields)
        rows.append((f"r{i:03}", t))
        label[f"r{i:03}"] = n
    rows += [("z1", "prose, as it is"), ("z2", "Prose as it is."), ("z3", None), ("z4", " "), ("z5", "…")]
    label |= {"z1": "prose", "z2": "prose", "z4": "", "z5": ""}
    exp = defaultdict(list)
    for i, n in label.items():
        exp[n].append(i)
    got = {r.id: r.copies for r in copies.collapse_dress(spark.createDataFrame([(*r, "k", "h") for r in rows], MEM)).collect()}
    assert got == {min(ids): len(ids) for ids in exp.values()}
    assert copies.collapse_dress(spark.createDataFrame([], MEM)).count() == 0


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        i = rnd.randrange(len(out))
        out[i : i + 1] = rnd.choice([[], [rnd.choice("abcdefgh") * 3], [out[i], "extra"]])
    return " ".join(out)


@pytest.mark.parametrize("hot", [3, 20_000])
def test_near_duplicates_brute_force(spark, hot):
    rnd = random.Random(hot)
    rows = []
    for g in range(25):
        base = [f"w{rnd.randrange(120)}" for _ in range(rnd.choice([4, 12, 40, 150]))]
        rows += [(f"{g:02}-{k}", edited(rnd, base, rnd.randrange(0, max(2, len(base) // 3)))) for k in range(5)]
    rows += [("x1", None), ("x2", ""), ("x3", "word"), ("x4", "same same same same"), ("x5", "same same"), ("x6", "b a b a"), ("x7", "a b a b a"), ("x8", "A. b, a b a!")]
    df = spark.createDataFrame([(*r, "k", "h") for r in rows], MEM)
    got = {tuple(r) for r in neardup.near_duplicates(df, hot=hot).collect()}
    sets = {i: set(zip(w, w[1:])) for i, t in rows if t for w in [re.findall(r"[^\W_]+", t.lower())]}
    skip = brute_copies(rows)
    exp = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] | sets[b] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]) and (a, b) not in skip}
    assert got == exp and len(exp) > 20


def test_near_duplicates_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], MEM)).count() == 0


def test_bk_tree():
    rnd = random.Random(1)
    sigs = [rnd.getrandbits(64) for _ in range(300)] + [5] * 60
    t = neardup.BKTree()
    for i, s in enumerate(sigs):
        t.add(s, i)
    for q in sigs[:40]:
        assert sorted(i for _, i in t.search(q, 26)) == [i for i, s in enumerate(sigs) if (s ^ q).bit_count() <= 26]


# --- 3 --------------------------------------------------------------------------------------------------------------

TEXTS = {
    "mail ann_r (at) ops.invalid or ring 020 7946 0517.": {("email", "ann_r (at) ops.invalid"), ("phone", "020 7946 0517")},
    "Write to <mailto:bob.x+notes@mail.example>; icon saved as lamp@4x.png": {("email", "bob.x+notes@mail.example")},
    "iautavelmi at mail dot example": {("email", "iautavelmi at mail dot example")},
    "Robert Brolihapeku's flat is 21B Quarryside Hill, Marlow Fen, the bell says nothing.": {("person", "Robert Brolihapeku"), ("address", "21B Quarryside Hill, Marlow Fen")},
    "My social security number is 969-38-8002, version 10.36.8297 of x": {("id_number", "969-38-8002")},
    "Steuer-ID = 00 745 782 915 and 415-555-0146 in": {("id_number", "00 745 782 915"), ("phone", "415-555-0146")},
    "order 1837-4268-44 is open, range 2024-01-02 to 2024-02-03": set(),
    "Waiting for Gafosebrule, Yevgenia. Meadow Street Protocol v4.": {("person", "Gafosebrule, Yevgenia")},
    "Neue Anschrift: Kranichallee 182a, 00703 Nordhalm.": {("address", "Kranichallee 182a, 00703 Nordhalm")},
    "新地址是青澜路80号9单元299室。": {("address", "青澜路80号9单元299室")},
    "请联系陆雪棠，电话+86 100 0857 0053。": {("person", "陆雪棠"), ("phone", "+86 100 0857 0053")},
    "Charlotte Meadow Logistics Ltd and nulatopoke-planner": set(),
    "national insurance: QQ774500C": {("id_number", "QQ774500C")},
}


def test_pii(spark):
    rows = [("memories", str(i), t) for i, t in enumerate(TEXTS)] + [("memories", "n", None), ("memories", "e", ""), ("memories", "l", "x " * 100_000 + "a.b@c.example")]
    df = spark.createDataFrame(rows, "table_name string, record_key string, content string")
    m = pii.learn(df.select("content"), spark.createDataFrame([("x y", "person"), (None, "person")], "name string, kind string"))
    got = defaultdict(set)
    for r in pii.found(df, m).collect():
        got[r.record_key].add((r.pii_kind, r.found_text))
    for i, (t, exp) in enumerate(TEXTS.items()):
        assert got[str(i)] == exp, t
    assert got["l"] == {("email", "a.b@c.example")} and not got["n"] and not got["e"]
    red = {r.record_key: r.content for r in pii.redacted(df, m).collect()}
    assert red["0"] == "mail [EMAIL] or ring [PHONE]." and red["n"] is None and red["e"] == ""
    assert pii.found(df.limit(0), m).count() == 0


def test_pii_bootstraps_unknown_names(spark):
    known = ["Robert", "Margaret", "William", "Charlotte", "Lawrence", "Penelope", "Theodore", "Harold"]
    rows = [(f"{n} {f} asked to be called back soon. Signed by {n} {f}.",) for n in known for f in ("Okonvale", "Wexcombe", "Brolihapeku")]
    rows += [(f"Zorblina {f} asked to be called back soon. Signed by Zorblina {f}.",) for f in ("Okonvale", "Vantreska", "Quispelaya")]
    m = pii.learn(spark.createDataFrame(rows, "content string"))
    assert [t[s:e] for t in ["Zorblina Merrowick came"] for s, e, k in pii.find(m, t)] == ["Zorblina Merrowick"]


def test_pii_bootstraps_leads_of_addresses_and_id_numbers(spark):
    streets = ["Quarryside Hill", "Bramble Lane", "Foxglove Road", "Tanner Street", "Millbrook Court", "Heron Close", "Alder Way", "Copper Row"]
    rows = [(f"The van goes over to {i + 3} {s}. Nobody waits.",) for i, s in enumerate(streets)] + [(f"Her Zollkennung lautet QQ77450{i}C today.",) for i in range(8)]
    rows += [(f"We went back in row {i} of the table, entry no {7_654_321 + i} was read.",) for i in range(20)]
    m = pii.learn(spark.createDataFrame(rows, "content string"))
    found = lambda t: [(t[s:e], k) for s, e, k in pii.find(m, t)]
    assert found("The van goes over to 91 larkspur lane. Nobody waits.") == [("91 larkspur lane", "address")]
    assert found("Her Zollkennung lautet 99 8812 7731 today.") == [("99 8812 7731", "id_number")]
    assert found("We went back in row 31 of the table, entry no 7654399 was read.") == []


def test_pii_keeps_all_it_learns(spark):
    """More contexts of numbers than 5,000 and of Chinese names than 500, more given names of entities than 5,000: none is left out."""
    word = lambda i, n: "".join(chr(97 + i // 26**k % 26) for k in range(n))
    rows = [("\n".join(f"{word(3 * i + k, 5)} qu{word(i, 3)} 020 7946 09{k + 30}." for k in range(3)),) for i in range(5_100)]
    names = [f"张{x}" for x in "伟敏静丽强磊洋艳"]
    contexts = [a + b for a in "热冷大小红绿轻重早晚新旧长短深浅快慢远近低宽窄厚" for b in "桌椅灯窗墙门床柜杯碗盘刀叉勺锅瓶盆筐箱包伞鞋"]
    rows += [("。".join(f"联系{n}" for n in names),)] + [("。".join(c + n for n in names),) for c in contexts]
    m = pii.learn(spark.createDataFrame(rows, "content string"))
    assert len(contexts) > 500 and m.han_left >= set(contexts)
    assert m.number_left >= {f"~qu{word(i, 3)}" for i in range(5_100)}
    people = spark.createDataFrame([(f"zu{word(i, 4)} {f}", "person") for i in range(5_100) for f in ("ash", "birch", "cedar", "dogwood")], "name string, kind string")
    assert pii.learn(spark.createDataFrame([], "content string"), people).given.keys() >= {f"zu{word(i, 4)}" for i in range(5_100)}


def test_pii_slow_patterns_run_only_where_they_can_match(monkeypatch):
    """Texts without a label or a mailbox's sign are passed by; those with one, in any letter case, are not."""
    m = pii.Model()
    for t, exp in {"Paſſport no. 12 345 678": "12 345 678", "TAX ıD 1234567": "1234567", "PERSONALAUSWEİS: L1234567": "L1234567", "her Ni is 12 34 56 78": "12 34 56 78", "身份证号：110101199003070000": "110101199003070000"}.items():
        assert [t[s:e] for s, e, k in pii.find(m, t) if k == "id_number"] == [exp], t
    for t in ("a [ät] b.example", "a at b dot example", "a (at) b (dot) example", "a @ b.example"):
        assert [(t[s:e], k) for s, e, k in pii.find(m, t)] == [(t, "email")]
    assert [t[s:e] for t in ["HE LIVES AT 12 oak lane."] for s, e, k in pii.find(m, t)] == ["12 oak lane"]

    class Run:
        def finditer(self, text):
            raise AssertionError(text)

    for name in ("ID_LABEL", "EMAIL", "ADDRESS_LEAD"):
        monkeypatch.setattr(pii, name, Run())
    for t in ("we met at noon in unit 12 345 678 and at the pier", "opening nine tins, 1 234 567", "xni 1234567 was seen at 10"):
        assert pii.find(m, t) == [] and pii._ids(t) == []


# --- 4 --------------------------------------------------------------------------------------------------------------


def test_conversations(spark):
    U = "message_uuid string, parent_uuid string, role string, session_id string, content string, ingested_at timestamp, seq long"
    rows, seq = [], itertools.count(1)

    def add(u, p, role, text="hi", ses="s", at=T0):
        rows.append((u, p, role, ses, text, at, next(seq)))

    for i, r in enumerate(["system", "user", "assistant", "human", "AI"]):
        add(f"A{i} ", f" a{i - 1}" if i else "", r)
    add("a1", "a0", "user", "late copy", at=T0 + timedelta(days=1))
    add("b0", None, "user"), add("b1", "b0", "assistant"), add("b2", "b0", "assistant")  # branches
    add("c0", "", "user")  # no reply
    add("d0", "", "user"), add("d1", "d0", "assistant", "  \n")  # blank reply
    add("e0", "gone", "user"), add("e1", "e0", "assistant")  # orphan
    add("f0", "f1", "user"), add("f1", "f0", "assistant")  # cycle
    add("g0", "", "user"), add("g1", "g0", "assistant", ses="t")  # two sessions
    add("h0", "", "user"), add("h1", "h0", "bot")  # unknown role
    add("i0", "", "assistant")  # nothing asked
    add("", "", "user"), add(None, None, "user")
    add("k0", "k0", "user")
    for i in range(70):  # long
        add(f"z{i}", f"z{i - 1}" if i else "", "user" if i % 2 == 0 else "model", ses=None if i % 3 else "")
    df = spark.createDataFrame(rows, U).withColumn("key", F.lit("x"))
    got = {(r.root_uuid, r.turn_no, r.message_uuid) for r in conversations.conversations(df).collect()}
    assert got == {("a0", i, f"a{i}") for i in range(5)} | {("z0", i, f"z{i}") for i in range(70)}
    assert conversations.conversations(df.limit(0)).count() == 0


# --- 7 --------------------------------------------------------------------------------------------------------------


def test_one_edit_trie():
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abc", k=rnd.randint(1, 6))) for _ in range(200)]
    t = entities.Trie(words)
    for q in words[:60]:
        assert t.near(q) == sorted({w for w in words if entities.one_edit(q, w)})


def test_entities(spark):
    rows = [("1", "margaret gazibebubro", "person", ["Maggie Gazibebubro"]), ("2", "gazibebubro, maggie", "concept", None), ("3", "margaretgazibebubro", "concept", []), ("4", "robert gazibebubro", "person", None), ("5", "wuhigahiwu-planner", "project", None), ("6", "the planner of wuhigahiwu", "concept", None), ("7", "wuhigahieu planner", "concept", None), ("8", "wuhigahiwu-viewer", "concept", None), ("9", "mudewekiste textile systems s.a.", "company", ["MTS"]), ("a", "mudewekste textile systems", "company", ["MTS"]), ("b", "mudewekiste grain partners", "company", ["MTS"]), ("c", "geremafopa", "concept", None), ("d", None, "concept", None), ("e", "", "concept", [None, ""])]
    e = spark.createDataFrame(rows, "id string, name string, kind string, aliases array<string>").withColumn("node", F.lit("x"))
    m = spark.createDataFrame([("c", " Wuhigahiwu planner "), ("gone", "x"), (None, "y"), ("4", None)], "entity_id string, mention_text string")
    got = {tuple(r) for r in entities.same_entities(e, m).collect()}
    assert got == {*itertools.combinations("123", 2), *itertools.combinations("567c", 2), ("9", "a")}
    assert {tuple(r) for r in entities.same_entities(e, m, hot=2).collect()} == got
    assert entities.same_entities(e.limit(0), m).count() == 0


def test_entities_with_short_and_foreign_names(spark):
    names = {"1": "john kim", "2": "Kim, John", "3": "robert chen", "4": "Chen, Bob", "5": "王小明", "6": "王 小明", "7": "acme works", "8": "Acme Wks.", "9": "priya raghunathan", "a": "Raghunathan, Priya", "b": "P. Raghunathan", "c": "robert chan", "d": "王小朋", "e": "acme", "f": "ACME", "g": "priya raghunatan"}
    e = spark.createDataFrame([(i, n, [n]) for i, n in names.items()], "id string, name string, aliases array<string>")
    m = spark.createDataFrame([], "entity_id string, mention_text string")
    same = ["12", "34", "56", "78", "9abg"]
    assert {tuple(r) for r in entities.same_entities(e, m).collect()} == {p for s in same for p in itertools.combinations(s, 2)}
    got = {r.entity: r.class_id for r in entities.entity_classes(e, m).collect()}
    assert got == {i: next((s[0] for s in same if i in s), i) for i in names}


@pytest.mark.parametrize("hot", [60, 20_000])
def test_entities_recall_grows_with_no_table(spark, hot):
    """10,000 names of persons, families of very different frequency: variants are found again, strangers stay apart."""
    rnd = random.Random(hot)
    coin = lambda n: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(n))
    given = [g for g in entities.NICKNAMES if len(g) >= 4] + list({coin(3) for _ in range(150)} - {"maria"})
    family = ["smith", "kim", "roth", "lee"] + list({coin(rnd.choice([2, 4, 5])) for _ in range(1500)})
    near = entities.Trie(family)
    family = family[:4] + [f for f in family[4:] if near.near(f) == [f]]
    people = list({(rnd.choice(given), rnd.choice(family[:4] if rnd.random() < 0.2 else family)) for _ in range(6_200 if hot > 60 else 1_500)})
    rows, truth = [], set()
    for k, (g, f) in enumerate(people):
        nick = rnd.choice((entities.NICKNAMES.get(g) or g).split())
        at = rnd.randrange(1, len(f) - 1)
        typo = f[:at] + f[at + 1] + f[at] + f[at + 2 :] if len(f) >= 8 and f[at] != f[at + 1] else f
        variants = [f"{g} {f}", rnd.choice([f"{f}, {g}", f"{nick} {f}", f"{g} {typo}", f"{f.title()} {g.title()}"])][: rnd.choice([1, 2, 2])]
        rows += [(f"{k:05}-{v}", x) for v, x in enumerate(variants)]
        if len(variants) == 2:
            truth.add((f"{k:05}-0", f"{k:05}-1"))
    e = spark.createDataFrame(rows, "id string, name string").withColumn("aliases", F.lit(None).cast("array<string>"))
    got = {tuple(r) for r in entities.same_entities(e, spark.createDataFrame([], "entity_id string, mention_text string"), hot=hot).collect()}
    assert len(rows) > (10_000 if hot > 60 else 2_000) and len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.97 * len(got), (len(rows), len(truth), len(got), len(got & truth))


# --- 8, 9 -----------------------------------------------------------------------------------------------------------

public = pytest.importorskip("public_tokenizers")


def reference_encoder():
    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens(spark):
    rnd = random.Random(3)
    alphabet = "abcdetTh é中文，🙂\n\t 0123 '<|endoftext|>"
    texts = [None, "", " ", "<|endoftext|>", "a" * 30_000, "1" * 5_000, "中" * 3_000] + ["".join(rnd.choices(alphabet, k=rnd.randint(1, 60))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    ref = reference_encoder()
    got = {r.doc_id: list(r.ids) for r in tokens.encode_texts(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (ref.encode_ordinary(t) if t else []), repr(t)[:80]
    assert ref.decode(got[1000]) == texts[1000]
    assert {r.doc_id: r.tokens for r in tokens.count_tokens(df).collect()} == {i: len(x) for i, x in got.items()}
    assert tokens.encode_texts(df.limit(0)).count() == 0


def test_packing(spark):
    rnd = random.Random(4)
    sizes = [(i, rnd.choice([1, 30, 100, 200, 511, 512, 513, 2000])) for i in range(800)] + [(9000, 0), (9001, None), (None, 7), (5, 100)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens int").withColumn("block", F.lit(1))
    out = packing.pack_documents(df, {"short": 512, "long": 8192, "none": None}, windows=20).collect()
    per = defaultdict(int)
    for kind, cap in (("short", 512), ("long", 8192)):
        rows = [r for r in out if r.pack_kind == kind]
        used = Counter()
        for r in rows:
            used[r.container] += r.tokens
            per[kind, r.doc_id] += r.tokens
            assert r.tokens > 0 and (r.piece == 0) == (r.start == 0)
        assert max(used.values()) <= cap and sum(used.values()) / (len(used) * cap) > 0.9
        cut = Counter(r.doc_id for r in rows)
        want = defaultdict(int)
        for i, n in sizes:
            if n:
                want[i] += n
        assert {i: per[kind, i] for i in want} == dict(want)
        assert all(cut[i] == 1 for i, n in sizes if n and n <= cap and i != 5)
    assert packing.pack_documents(df.limit(0), {"short": 512}).count() == 0


def test_differencing_is_balanced():
    rnd = random.Random(5)
    sizes = [rnd.randint(1, 100) for _ in range(400)]
    sets = packing.differencing(sizes, 10)
    assert sorted(i for s in sets for i in s) == list(range(400))
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert max(sums) - min(sums) <= 5
    assert packing.pack([7, 7, 7], 10) and len(packing.pack([7, 7, 7], 10)) == 3 and packing.pack([], 5) == []


# --- 10 -------------------------------------------------------------------------------------------------------------


def test_subjects(spark):
    law, food, plain = "The court heard the tribunal about a lease. ", "The garlic went into the skillet with butter. ", "Nobody wrote a note about the morning page. "
    docs = [(i, law * 4 + plain * (i % 3)) for i in range(20)] + [(100 + i, food * 4 + plain * (i % 3)) for i in range(20)] + [(200 + i, plain * 5) for i in range(20)]
    docs += [(300, law * 9), (301, law * 5 + food * 5), (302, food + plain * 9), (303, None), (304, ""), (305, " \n"), (306, food * 3000), (300, law * 9)]
    labels = [(i, "Law ", T0) for i in range(20)] + [(100 + i, "cooking", T0) for i in range(20)] + [(200 + i, None, T0) for i in range(20)] + [(None, "law", T0), (999, "law", T0)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("subject", F.lit("x"))
    lab = spark.createDataFrame(labels, "doc_id long, subject string, labelled_at timestamp")
    areas = spark.createDataFrame([("law", ""), ("cooking", "")], "subject string, title string")
    got = sorted(map(tuple, subjects.subject_areas(d, lab, areas).collect()))
    assert got == [(300, "law"), (301, "cooking"), (301, "law"), (306, "cooking")]
    assert subjects.subject_areas(d, lab.limit(0), areas).count() >= 0
    assert subjects.subject_areas(d.limit(0), lab, areas).count() == 0
