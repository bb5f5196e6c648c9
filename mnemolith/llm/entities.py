"""Problem 7: rows that stand for the same person, company or thing, by a trie join over their names.

Every written form of an entity (name, alias, mention) is split into a rare part, the family name or the coined word,
and its other parts: given name, line of business, component. Words are common if they go with a share of all names; a
form of common words only keeps the rarest of them as its rare part. Unknown words of a form that shows no person are
tried as rare parts one by one. The rare parts are sharded by their first and by their last letters, one of which any
single edit leaves intact; each shard's trie is walked with a Levenshtein automaton, and neighbours are the same if
their other parts agree in any order, abbreviated, as initial, or as nickname. Rare parts of fewer than five letters,
and Han ones, must be equal, as one edit makes another name of them. Forms that fit several full names link nothing.
Links close to components.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolith.operators.components import components
from mnemolith.util import materialise, trim_blanks

#: Words without meaning for identity.
STOP = set("the of company co and".split())
LEGAL = re.compile(r"\b(?:ltd|gmbh|ag|inc|llc|plc|corp|kg|se|s\.\s?a|b\.\s?v|s\.\s?r\.\s?l|sa|bv)\b\.?", re.I)
#: Kinds of companies, with customary short forms; lines of business are learned.
BUSINESS = set("works industries logistics consulting instruments holdings systems laboratories partners cooperative services trading group enterprises solutions associates brothers foundation international technologies bank insurance".split())
SHORT = {"wks": "works", "labs": "laboratories", "ptnrs": "partners", "coop": "cooperative", "intl": "international", "bros": "brothers", "assoc": "associates", "tech": "technologies", "svcs": "services", "inds": "industries"}
#: Given names with customary nicknames.
NICKNAMES = {
    "alexander": "alex alec sasha sandy", "charlotte": "lottie charlie", "chloe": "clo", "dominique": "domi didi nick", "edith": "edie", "elizabeth": "liz lizzie beth betty eliza", "francisco": "pancho paco fran", "frederick": "fred freddy freddie fritz",
    "guadalupe": "lupe lupita", "harold": "harry hal", "inigo": "", "isabella": "bella isa izzy", "johannes": "hannes hans jo", "josephine": "josie jo", "jurgen": "jogi", "katharina": "kathi kati kat", "lawrence": "larry laurie", "leopold": "leo poldi",
    "margaret": "maggie meg peggy greta", "matthias": "matt hias matze", "nathaniel": "nate nat", "octavia": "tavi tavia", "penelope": "penny pen", "quentin": "quent", "robert": "bob bobby rob robbie", "rosalind": "roz ros rosie", "soren": "", "theodore": "theo ted teddy",
    "ulrike": "ulli uli rike", "william": "bill billy will willy liam", "xiomara": "xio mara", "yevgenia": "zhenya genia jenya", "zachary": "zack zach zak", "tina": "", "sebastian": "basti seb bastian", "valentina": "vale tina", "wilhelmina": "mina wilma minnie billie",
    "anna": "annie", "daniel": "dan danny", "david": "dave", "emily": "em", "hannah": "", "james": "jim jimmy jamie", "john": "jack johnny", "laura": "", "maria": "", "martin": "", "michael": "mike mick", "peter": "pete", "richard": "rick dick", "sarah": "sally", "sophie": "", "thomas": "tom tommy",
}
GIVEN = {n: full for full, nicks in NICKNAMES.items() for n in [full, *nicks.split()]}


def plain(s: str) -> str:
    """Lower case without diacritics."""
    s = s.replace("ø", "o").replace("Ø", "O").replace("ß", "ss").replace("æ", "ae").replace("ł", "l")
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours at most turns a into b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


class Trie:
    """Words by letters; ``near`` walks it with the automaton of all words within one edit (swaps included)."""

    def __init__(self, words) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, word: str) -> list[str]:
        # A state is (position in the word, edits left, letter owed by a swap).
        out: set[str] = set()
        n = len(word)
        todo = [(self.root, ((0, 1, ""),))]
        while todo:
            node, states = todo.pop()
            if "" in node and any(not owed and n - i <= left for i, left, owed in states):
                out.add(node[""])
            for c, child in node.items():
                if c == "":
                    continue
                new = set()
                for i, left, owed in states:
                    if owed:
                        if c == owed:
                            new.add((i + 2, left, ""))
                        continue
                    if i < n and word[i] == c:
                        new.add((i + 1, left, ""))
                    if left:
                        new.add((i, 0, ""))  # inserted letter
                        if i < n:
                            new.add((i + 1, 0, ""))  # substituted letter
                        if i + 1 < n and word[i + 1] == c:
                            new.add((i + 2, 0, ""))  # dropped letter before c
                            new.add((i, 0, word[i]))  # swap: c first, then word[i]
                if new:
                    todo.append((child, tuple(new)))
        return sorted(out)


CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])")
TOKEN = re.compile(r"[^\W\d_]+\.?")
HAN = re.compile(r"[㐀-鿿]")
HAN_BLANK = re.compile(r"(?<=[㐀-鿿])[\s·・]+(?=[㐀-鿿])")


def elastic(word: str) -> bool:
    """Whether one edit may turn the word into a misspelling of itself rather than into another name."""
    return len(word) >= 5 and not HAN.match(word)


class Parser:
    """Splits written forms into kind, rare part and other parts; ``common`` are words by their number of partners."""

    def __init__(self, common: dict[str, int] | None = None) -> None:
        self.learned = {w: n for w, n in (common or {}).items() if w not in BUSINESS and w not in GIVEN and w not in SHORT}
        self.common = BUSINESS | set(GIVEN) | set(SHORT) | set(self.learned)
        self.givens = Trie([g for g in GIVEN if len(g) >= 5])
        self.long = sorted((w for w in self.common if len(w) >= 4), key=lambda w: (-len(w), w))

    def parse(self, form: str | None) -> list[tuple[str, str, str]]:
        """``(kind, rare part, other parts joined by blanks)`` for each word that may be the rare part.

        Kinds: person, company, part (an abbreviated common part), other (none of these), code (a word alone). Null and
        blank forms give none, nor do lone Latin words of fewer than five letters: these are acronyms as often as names.
        """
        if not form:
            return []
        legal = LEGAL.search(form) is not None
        text = plain(CAMEL.sub(" ", LEGAL.sub(" ", HAN_BLANK.sub("", form.strip()))))
        toks = [t for t in TOKEN.findall(text.replace("_", " ").replace("’", "")) if t.rstrip(".") not in STOP]
        inner = text.rstrip()
        # A dot between two long words joins them: name.part
        toks = [t.rstrip(".") if t.endswith(".") and len(t) > 6 or t == toks[-1] and not inner.endswith(".") else t for t in toks]
        common, rare = [], []
        for t in toks:
            w = t.rstrip(".")
            if w in self.common:
                common.append(SHORT.get(w, w))
            elif len(w) == 1 and not HAN.match(w):
                common.append(w + ".")
            elif t.endswith(".") and len(w) <= 5:
                common.append(w + ".")
            else:
                rare.append(w)
        company = legal or any(c in BUSINESS for c in common)
        if len(rare) == 1 and (not common or company):
            cut = self._cut(rare[0], bool(common))
            if cut:
                rare, common = [cut[0]], common + [cut[1]]
                company = company or cut[1] in BUSINESS
        if len(rare) > 1 and not company and not any(c in GIVEN for c in common):
            for i, w in enumerate(rare):  # a misspelt given name
                if len(w) >= 4 and (near := self.givens.near(w)):
                    common.append(near[0])
                    del rare[i]
                    break
        if not rare:  # common words only: the rarest of the learned ones stands for the form
            known = [c for c in common if c in self.learned]
            if not known:
                return []
            key = min(known, key=lambda w: (self.learned[w], -len(w), w))
            common.remove(key)
            rare = [key]
        common = [GIVEN.get(c, c) for c in common]
        given = next((c for c in common if c in GIVEN), None)
        if given and not company:  # of several unknown words the longest is the family name
            return [("person", max(rare, key=lambda w: (len(w), w)), given)]
        if not common and len(rare) == 1:
            return [("code", rare[0], "")] if len(rare[0]) >= 5 or HAN.match(rare[0]) and len(rare[0]) > 1 else []
        out = []
        for key in dict.fromkeys(rare):
            rest = sorted({*common, *rare} - {key})
            if not rest:
                continue
            if company:
                kind = "company"
            elif all(len(c) == 2 and c.endswith(".") for c in rest):
                kind, rest = "person", [c for c in common if c in rest][:1]
            elif all(c.endswith(".") for c in rest):
                kind = "part"
            else:
                kind = "other"
            out.append((kind, key, " ".join(rest)))
        return out

    def _cut(self, word: str, company: bool) -> tuple[str, str] | None:
        for c in self.long:
            if len(word) - len(c) < 5:
                continue
            if not company and c in GIVEN and word.startswith(c) and len(c) >= 5:
                return word[len(c) :], c
            if word.endswith(c) and (c in BUSINESS or c in self.learned or not company and c in GIVEN and len(c) >= 5):
                return word[: -len(c)], c
        return None


def _same_word(a: str, b: str) -> bool:
    if a == b:
        return True
    if a.endswith(".") or b.endswith("."):
        x, y = a.rstrip("."), b.rstrip(".")
        return x.startswith(y) or y.startswith(x)
    return min(len(a), len(b)) >= 5 and one_edit(a, b)


def agree(kind_a: str, a: str, kind_b: str, b: str) -> bool:
    """Whether the common parts of two forms with nearly the same rare part can belong to one thing."""
    if kind_a != kind_b:
        if {kind_a, kind_b} == {"person", "part"} or "code" in (kind_a, kind_b):
            return False
        if "other" not in (kind_a, kind_b) and not (a.endswith(".") or b.endswith(".")):
            return False
    x, y = a.split(), b.split()
    if len(x) > len(y):
        x, y = y, x
    rest = list(y)
    for w in x:
        hit = next((v for v in rest if w == v), None) or next((v for v in rest if _same_word(w, v)), None)
        if hit is None:
            return False
        rest.remove(hit)
    return not rest or kind_a == kind_b == "company"


def vague(kind: str, common: str) -> bool:
    """Forms that may fit several full names: initials, abbreviations, a company without its line or kind."""
    words = common.split()
    return any(w.endswith(".") for w in words) or kind == "company" and len(words) < 2


def _parsed(common: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(common)
        for b in batches:
            rows = [(e, *p) for e, f in zip(b.column("entity").to_pylist(), b.column("form").to_pylist()) for p in parser.parse(f)]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate(("entity", "kind", "rare", "common"))})

    return run


def _shard_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the shards of a task; rows come sorted by shard."""

    def links(shard: list[tuple[str, str, str, bool]]):
        indexed, asking = defaultdict(list), defaultdict(list)
        for kind, rare, common, index in shard:
            if index:
                indexed[rare].append((kind, common))
            asking[rare].append((kind, common))
        trie = Trie(indexed)
        for rare, mine in asking.items():
            for other in trie.near(rare) if elastic(rare) else [rare] if rare in indexed else []:
                if other != rare and not elastic(other):
                    continue
                for kind, common in mine:
                    for kind2, common2 in indexed[other]:
                        if (rare, kind, common) != (other, kind2, common2) and agree(kind, common, kind2, common2):
                            yield kind, rare, common, kind2, other, common2

    names = ("kind", "rare", "common", "kind2", "rare2", "common2")

    def out(rows):
        return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate(names)})

    now, shard = None, []
    for b in batches:
        for s, k, r, c, i in zip(*(b.column(n).to_pylist() for n in ("shard", "kind", "rare", "common", "index"))):
            if s != now:
                if len(shard) > 1:
                    yield out(list(links(shard)))
                now, shard = s, []
            shard.append((k, r, c, i))
    if len(shard) > 1:
        yield out(list(links(shard)))


def common_words(names: DataFrame, share: float = 0.01, least: int = 4) -> dict[str, int]:
    """Words that go with other words in at least a ``share`` of all names, and their numbers of different partners:
    given names, lines of business, components.

    A name has few words, so at most a few hundred words can reach the share, however many names there are.
    """
    n = names.count()
    w = names.select(F.array_distinct(F.split(F.lower("form"), r"[^\p{L}]+")).alias("w")).select("w", F.explode("w").alias("word")).where(F.length("word") >= 3)
    pairs = w.select("word", F.explode("w").alias("other")).where((F.length("other") >= 3) & (F.col("other") != F.col("word"))).distinct()
    rows = pairs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= max(least, share * n)).collect()
    out: dict[str, int] = {}
    for r in rows:
        out[plain(r.word)] = max(out.get(plain(r.word), 0), r.n)
    return out


def forms(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Distinct ``entity, form``: every name, alias and mention of a known entity. Nulls and blanks are left out."""
    e = entities.where("id IS NOT NULL")
    own = e.select(F.col("id").alias("entity"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
    said = mentions.where("entity_id IS NOT NULL").select(F.col("entity_id").alias("entity"), F.col("mention_text").alias("form")).distinct()
    said = said.join(e.select(F.col("id").alias("entity")).distinct(), "entity", "left_semi")
    return own.unionByName(said).select("entity", trim_blanks(F.col("form")).alias("form")).where("form <> ''").distinct()


def _sharded(sigs: DataFrame) -> DataFrame:
    """Signatures with the shards in which every other one that may be the same is met.

    Between two words one edit (swaps included) apart, the first or the last two letters are the same from five letters
    on, the first or the last three from seven on; words of seven and eight letters are in shards of both kinds, as
    their neighbours may be. Words of fewer than five letters meet by their beginning only, being compared whole.
    Other parts that agree share the first letter of a word.
    """
    n = F.length("rare")
    ends = lambda k: [F.concat(F.lit(f"{k}a"), F.substring("rare", 1, k)), F.concat(F.lit(f"{k}z"), F.expr(f"right(rare, {k})"))]
    none = F.array().cast("array<string>")
    places = F.concat(F.when(n <= 8, F.array(*ends(2))).otherwise(none), F.when(n >= 7, F.array(*ends(3))).otherwise(none))
    places = F.when(n < 5, F.slice(places, 1, 1)).otherwise(places)
    lines = F.array_distinct(F.transform(F.split("common", " "), lambda w: F.substring(w, 1, 1)))
    place = F.when(F.col("kind") == "code", "code").otherwise("name")
    out = sigs.select("kind", "rare", "common", place.alias("_p"), F.explode(lines).alias("_l"), places.alias("_e"))
    return out.select("kind", "rare", "common", F.explode("_e").alias("_e"), "_p", "_l").select("kind", "rare", "common", F.concat_ws("|", "_p", "_l", "_e").alias("shard"))


def _salted(shards: DataFrame, hot: int) -> DataFrame:
    """Rows with ``index``. A shard of more than ``hot`` rows is divided by one more letter at either end of the words,
    one of which an edit leaves intact again; what is still as large has words in common, and each of its names is
    indexed in one part and asks in all."""

    def sizes(s: DataFrame) -> DataFrame:
        return s.groupBy("shard").agg(F.count("*").alias("_n")).where(F.col("_n") > hot)

    first = sizes(shards)
    marked = shards.join(first, "shard", "left")
    k = F.regexp_extract("shard", r"\|([23])[az][^|]*$", 1).cast("int")
    inner = F.when(F.regexp_extract("shard", r"\|[23]([az])[^|]*$", 1) == "a", F.expr("substring(rare, {0} + 1)".replace("{0}", "_k"))).otherwise(F.expr("left(rare, length(rare) - _k)"))
    finer = F.array(F.concat(F.lit("a"), F.substring("_in", 1, 1)), F.concat(F.lit("z"), F.expr("right(_in, 1)")))
    split = marked.where("_n IS NOT NULL").withColumn("_k", k).withColumn("_in", inner).withColumn("_f", F.explode(F.array_distinct(finer)))
    cool = marked.where("_n IS NULL").select("shard", "kind", "rare", "common")
    s = cool.unionByName(split.select(F.concat_ws("|", "shard", "_f").alias("shard"), "kind", "rare", "common"))
    s = s.join(sizes(s).select("shard", F.ceil(F.col("_n") / hot).cast("int").alias("parts")), "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("kind", "rare", "common"), F.col("parts"))
    s = s.withColumn("own", own).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return s.select(F.concat_ws("|", "shard", "part").alias("shard"), "kind", "rare", "common", (F.col("part") == F.col("own")).alias("index"))


def link_entities(entities: DataFrame, mentions: DataFrame, hot: int = 20_000) -> DataFrame:
    """``entity, root``: the component of every entity that has at least one readable form."""
    f = materialise(forms(entities, mentions), "forms")
    names = entities.select(F.col("name").alias("form")).where("id IS NOT NULL AND form IS NOT NULL")
    common = common_words(names)
    read = materialise(f.mapInArrow(_parsed(common), "entity string, kind string, rare string, common string").distinct(), "parsed")
    shards = _sharded(read.select("kind", "rare", "common").distinct())
    n = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = _salted(shards, hot).repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_shard_join, "kind string, rare string, common string, kind2 string, rare2 string, common2 string").distinct()
    found = materialise(found, "links")
    # A vague form is a link only if all full forms it fits have the same common parts.
    is_vague = lambda k, c: F.col(c).contains(".") | ((F.col(k) == "company") & ~F.col(c).contains(" "))
    tagged = found.withColumns({"v1": is_vague("kind", "common"), "v2": is_vague("kind2", "common2")})
    fits = tagged.where("v1 AND NOT v2").groupBy("kind", "rare", "common").agg(F.count_distinct("common2").alias("n"))
    good = tagged.join(fits, ["kind", "rare", "common"], "left").where("(NOT v1 AND NOT v2) OR (v1 AND NOT v2 AND n = 1) OR (v1 AND v2 AND common = common2)")
    sig = lambda k, r, c: F.concat_ws("\x01", F.lit("~"), k, r, c)
    edges = good.select(sig("kind", "rare", "common").alias("u"), sig("kind2", "rare2", "common2").alias("v"))
    edges = edges.unionByName(read.select(F.col("entity").alias("u"), sig("kind", "rare", "common").alias("v")))
    return components(edges).where(~F.col("node").startswith("~\x01")).select(F.col("node").alias("entity"), "root")


def entity_classes(entities: DataFrame, mentions: DataFrame, **how) -> DataFrame:
    """Every ``entity`` with its ``class_id``, the smallest of those that stand for the same; one without a readable
    name is a class of its own. Null ids are left out, repeated rows give one."""
    c = materialise(link_entities(entities, mentions, **how), "components")
    least = c.groupBy("root").agg(F.min("entity").alias("class_id"))
    ids = entities.select(F.col("id").alias("entity")).where("entity IS NOT NULL").distinct()
    return ids.join(c.join(least, "root").select("entity", "class_id"), "entity", "left").select("entity", F.coalesce("class_id", "entity").alias("class_id"))


def same_entities(entities: DataFrame, mentions: DataFrame, **how) -> DataFrame:
    """All pairs ``entity_a < entity_b`` of rows of ``entities`` that stand for the same person, company or thing.

    Rows without a readable name and empty tables give nothing; acronyms and unknown forms link nothing. Mentions of
    unknown entities are ignored. The pairs of a component are the result, they are joined on its root.
    """
    c = materialise(link_entities(entities, mentions, **how), "components")
    many = c.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    c = c.join(many, "root", "left_semi")
    a, b = c.select("root", F.col("entity").alias("entity_a")), c.select("root", F.col("entity").alias("entity_b"))
    return a.join(b, "root").where("entity_a < entity_b").select("entity_a", "entity_b").distinct()
