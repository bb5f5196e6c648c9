"""Problem 10: subject areas of documents, by weighted subject terms in a multi-pattern automaton.

Terms come from documents that people have labelled: a term's weight for a subject is how purely it keeps to the
documents of that subject, less for rare terms. Passes over all documents then re-estimate the weights with corpus
counts, which adds terms the labelled sample lacks. The automaton finds the terms of a whole text;
each sentence goes to the subject with the largest weight, normalised by the sentence's length, and a document gets
every subject whose share of sentences exceeds a threshold calibrated on the labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolith.util import spread

#: Possible ends of sentences; ``_is_break`` decides. One leading character class lets the search skip quickly.
BREAK = re.compile(r"[\\\n\r.!?…。！？;][\n\r.!?…。！？;\"')\] \t]*")
FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
FRONT = re.compile(r"\A---\r?\n.*?\n---\r?\n", re.S)
WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
HAN = re.compile(r"[㐀-鿿]+")


#: Curated terms of the subjects in Chinese, German, French and Spanish, from general knowledge; English is left to
#: the labels. Other subjects start from labels alone.
CURATED = {
    "software": "编译器 数据库 单元测试 缓存 线程池 datenbank schnittstelle warteschlange testlauf compilateur serveur requête dépôt repositorio despliegue compilador interfaz",
    "science": "显微镜 望远镜 光谱 粒子 催化剂 mikroskop teilchen wellenlänge versuchsaufbau particule orbite microscope hypothèse telescopio partícula hipótesis espectro",
    "law": "法院 仲裁 上诉 证词 违约责任 gericht anwältin urteil vertrag tribunal avocate plaignant verdict cláusula arbitraje decreto arriendo",
    "sport": "守门员 裁判 教练 锦标赛 热身 schiedsrichter staffel spielfeld trainerin arbitre échauffement tournoi ligue entrenadora árbitro relevo torneo",
    "finance": "利率 债券 贷款 股息 发票 darlehen anleihe mahnung kontoauszug emprunt solde dividende créancier préstamo presupuesto divisa acreedor",
    "medicine": "血压 处方 疫苗 诊所 绷带 patientin diagnose blutdruck fieber patiente clinique vaccin fièvre herida vendaje fiebre vacuna",
    "cooking": "酵母 大蒜 洋葱 面团 黄油 teig zwiebel pfanne suppe beurre levure oignon potage cebolla levadura sartén caldo",
    "travel": "渡轮 护照 机场 行李 帐篷 flughafen gepäck fähre herberge passeport bagage billet traversier transbordador aeropuerto equipaje pasaporte",
    "music": "乐谱 鼓手 和弦 小提琴 合唱 tonart geige konzert chor violon orgue chorale refrain compás acorde batería concierto",
    "gardening": "蛞蝓 堆肥 修剪 温室 苗床 rasen kompost hecke beet compost haie pelouse puceron invernadero seto abono semillero",
}


def _is_break(m: re.Match) -> bool:
    """Line breaks (also escaped ones in exports), CJK stops, and full stops before a blank."""
    g = m.group()
    c = g[0]
    if c in "\n\r。！？" or "\n" in g or "\r" in g:
        return True
    if c == "\\":
        return m.string.startswith("n", m.start() + 1)
    return c != ";" and (g[-1] in " \t" or any(x in g for x in "。！？"))


def sentences(text: str) -> list[tuple[int, int, float]]:
    """Spans of the sentences of a text and their lengths in words; code fences and front matter are no sentences, nor
    are bits of fewer than three words. Two Han characters count as a word."""
    cuts = [m.span() if m.group()[0] != "\\" else (m.start(), m.start() + 2) for m in BREAK.finditer(text) if _is_break(m)]
    if "```" in text:
        cuts += [m.span() for m in FENCE.finditer(text)]
    if text.startswith("---"):
        cuts += [m.span() for m in FRONT.finditer(text)]
    cuts.sort()
    cuts.append((len(text), len(text)))
    out, at = [], 0
    han = not text.isascii() and HAN.search(text) is not None
    for s, e in cuts:
        if s > at:
            words = text.count(" ", at, s) + 1.0
            if han:
                words += sum(len(h) for h in HAN.findall(text, at, s)) / 2
            if words >= 3:
                out.append((at, s, words))
        if e > at:
            at = e
    return out


def terms(text: str) -> set[str]:
    """Candidate terms: words of three letters or more, and pairs of neighbouring Han characters."""
    low = text.lower()
    found = set(WORD.findall(low))
    for run in () if low.isascii() else HAN.findall(low):
        found.discard(run)
        found.update(map("".join, zip(run, run[1:])))
    return found


class SubjectModel:
    """Weights of terms by subject, the automaton over them, and the thresholds."""

    def __init__(self, subjects: list[str], weights: dict[str, dict[str, float]], share: float = 0.2, least: float = 0.15) -> None:
        self.subjects, self.weights, self.share, self.least = subjects, weights, share, least
        self._automaton = None

    def __getstate__(self):
        return {"subjects": self.subjects, "weights": self.weights, "share": self.share, "least": self.least, "_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for t, w in self.weights.items():
                (subject, x), = w.items()
                a.add_word(t, (t, subject, x, bool(HAN.match(t))))
            if self.weights:
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def by_sentence(self, text: str) -> list[tuple[str | None, float]]:
        """Heaviest subject of each sentence (None without any term) and its weight, normalised by length."""
        spans = sentences(text)
        if not spans or not self.weights:
            return [(None, 0.0)] * len(spans)
        low = text.lower()
        if len(low) != len(text):  # a few characters change their length in lower case
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        n, i, last = len(low), 0, len(spans)
        got: list[dict] = [{} for _ in spans]
        for end, (t, subject, w, han) in self.automaton.iter(low):
            begin = end - len(t) + 1
            if not han and (begin and low[begin - 1].isalpha() or end + 1 < n and low[end + 1].isalpha()):
                continue
            while i < last and spans[i][1] <= end:  # matches come by their ends
                i += 1
            if i == last:
                break
            if begin >= spans[i][0]:
                got[i][subject] = got[i].get(subject, 0.0) + w
        out = []
        for (_, _, length), c in zip(spans, got):
            if not c:
                out.append((None, 0.0))
                continue
            subject = max(c, key=c.__getitem__)
            w = c[subject]
            out.append((subject, (w - 0.5 * (sum(c.values()) - w)) / math.sqrt(max(length, 4.0))))
        return out

    def shares(self, text: str | None, least: float | None = None) -> dict[str, float]:
        """Share of the sentences of a text by subject; none for null, blank or unmatched texts."""
        if not text or not text.strip():
            return {}
        least = self.least if least is None else least
        found = self.by_sentence(text)
        n = Counter(s for s, w in found if s and w >= least)
        return {s: k / len(found) for s, k in n.items()}

    def assign(self, text: str | None) -> list[str]:
        return sorted(s for s, x in self.shares(text).items() if x >= self.share)


def _weights(counts: dict[str, Counter], total: Counter, min_count: float, purity: float) -> dict[str, dict[str, float]]:
    """Weights from numbers of documents by (term, subject); '' stands for documents about nothing.

    Subjects are weighed as if equally frequent, so that a common one doesn't claim the neutral words.
    """
    live = [s for s in total if s and total[s]]
    mean = sum(total[s] for s in live) / max(1, len(live))
    scale = {s: mean / max(total[s], mean / 20) for s in live} | {"": 1.0}
    prior = 1 / max(2, len(live))
    out: dict[str, dict[str, float]] = {}
    for t, c in counts.items():
        n = sum(c.values())
        if n < min_count:
            continue
        each = {s: k * scale.get(s, 1.0) for s, k in c.items()}
        s, k = max(each.items(), key=lambda x: (x[1] if x[0] else -1, x[0]))
        p = (k + prior) / (sum(each.values()) + 1)  # rarity: a term of few documents is trusted less
        if s and p >= purity:
            out[t] = {s: (p - prior) / (1 - prior)}
    return out


def labelled(documents: DataFrame, labels: DataFrame, subjects: list[str], most: int = 20_000) -> list[tuple[str, tuple[str, ...]]]:
    """(text, subjects) of at most ``most`` labelled documents, chosen by a hash of their ids.

    Labels are compared without letter case and blanks; a subject needs half of the document's annotators' rows at
    least, an unknown or null one stands for none.
    """
    lab = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_list(F.coalesce(F.lower(F.trim("subject")), F.lit(""))).alias("subjects"))
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").join(lab, "doc_id").where("text IS NOT NULL").orderBy("doc_id").collect()
    return [(r.text, tuple(sorted({s for s in r.subjects if s in subjects}))) for r in rows]


def fit(examples: list[tuple[str, tuple[str, ...]]], subjects: list[str], min_count: float = 3, purity: float = 0.6) -> SubjectModel:
    """Weights from the curated terms and the labelled documents: how purely a term keeps to the documents of one subject."""
    counts: dict[str, Counter] = defaultdict(Counter)
    total: Counter = Counter()
    for text, own in examples:
        seen = terms(text)
        for s in own or ("",):
            total[s] += 1 / max(1, len(own))
            for t in seen:
                counts[t][s] += 1 / max(1, len(own))
    weights = {t: {s: 1.0} for s in subjects for t in CURATED.get(s, "").split()}
    return SubjectModel(subjects, weights | _weights(counts, total, min_count, purity))


def widen(model: SubjectModel, documents: DataFrame, min_count: int = 4, purity: float = 0.5, clear: float = 0.2, rarest: int = 5_000) -> SubjectModel:
    """Re-estimate the weights over all documents: terms that keep to documents of one subject join it.

    A document counts for the subjects that at least ``clear`` of its sentences are about, by the weights so far; one
    without any counts for none. Counts are combined per task and per term; only terms that keep to one subject reach
    the driver, a vocabulary that doesn't grow with the number of documents.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        counts: dict[tuple[str, int], Counter] = defaultdict(Counter)  # by subject and sixtieths of a document

        def flush():
            rows = Counter()
            for (s, part), c in counts.items():
                for t, k in c.items():
                    if len(t) >= 3 or not t or HAN.match(t):
                        rows[t, s] += k * part
            counts.clear()
            keys = list(rows)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([rows[k] for k in keys], pa.int64())], ["term", "subject", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                own = [s for s, x in m.shares(text).items() if x >= clear]
                if own:
                    seen = terms(text)
                    seen.add("")
                    for s in own:
                        counts[s, 60 // len(own)].update(seen)
            if sum(map(len, counts.values())) > 400_000:
                yield flush()
        yield flush()

    # A term must be in one of rarest documents at least, so the vocabulary is bounded whatever the number of documents.
    min_count = max(min_count, documents.count() // rarest)
    n = spread(documents.select("text").where("text IS NOT NULL")).mapInArrow(run, "term string, subject string, n long").groupBy("term", "subject").agg(F.sum("n").alias("n"))
    best = n.groupBy("term").agg(F.sum("n").alias("all"), F.max("n").alias("top"), F.map_from_entries(F.collect_list(F.struct("subject", "n"))).alias("by"))
    rows = best.where((F.col("term") == "") | ((F.col("all") >= 60 * min_count) & (F.col("top") >= F.col("all") * 0.25))).select("term", "by").collect()
    by = {r.term: Counter({s: k / 60 for s, k in r.by.items()}) for r in rows}
    total = by.pop("", Counter())
    if not total:
        return model
    weights = _weights(by, total, min_count, purity)
    # What the labels taught about terms too rare here stays.
    for t, w in model.weights.items():
        if t not in weights and t not in by:
            weights[t] = w
    return SubjectModel(model.subjects, weights, model.share, model.least)


def calibrate(model: SubjectModel, examples: list[tuple[str, tuple[str, ...]]]) -> SubjectModel:
    """Set the thresholds of sentence weight and of share of sentences to the best F1 over labelled documents."""
    best = (-1.0, model.share, model.least)
    found = [(model.by_sentence(t), set(own)) for t, own in examples]
    for least in (0.3, 0.2, 0.4, 0.1):
        shares = [({s: k / len(f) for s, k in Counter(s for s, w in f if s and w >= least).items()}, own) for f, own in found]
        for share in (0.2, 0.225, 0.175, 0.25, 0.15, 0.3, 0.12):  # about a quarter, unless the labels clearly say otherwise
            hit = miss = wrong = 0
            for x, own in shares:
                got = {s for s, v in x.items() if v >= share}
                hit, miss, wrong = hit + len(got & own), miss + len(own - got), wrong + len(got - own)
            f1 = 2 * hit / max(1, 2 * hit + miss + wrong)
            if f1 > best[0] + 0.004:
                best = (f1, share, least)
    model.share, model.least = best[1:]
    return model


def train(documents: DataFrame, labels: DataFrame, areas: DataFrame, most: int = 20_000, calibrate_on: int = 2_000, rounds: int = 1) -> SubjectModel:
    subjects = sorted(r.subject for r in areas.select("subject").where("subject IS NOT NULL").collect())
    examples = labelled(documents, labels, subjects, most)
    some = examples[:: max(1, -(-len(examples) // calibrate_on))]
    model = calibrate(fit(examples, subjects), some)
    for _ in range(rounds):
        model = calibrate(widen(model, documents), some)
    return model


def subject_areas(documents: DataFrame, labels: DataFrame, areas: DataFrame, model: SubjectModel | None = None, only_unlabelled: bool = True, **how) -> DataFrame:
    """``doc_id, subject``: every subject at least about a quarter of the document's sentences are about.

    Documents about none, and null, empty or blank texts, have no row; repeated rows give one; a null id is left out.
    Without labelled documents nothing can be assigned. With ``only_unlabelled`` documents in ``labels`` are left out.
    """
    model = model or train(documents, labels, areas, **how)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            ids, subjects = [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for s in m.assign(text):
                    ids.append(i)
                    subjects.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("doc_id").type), pa.array(subjects, pa.string())], ["doc_id", "subject"])

    rows = spread(documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL"))
    if only_unlabelled:
        rows = rows.join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, subject string").distinct()
