"""Text functions as Column builders; all of them stay inside the JVM.

Null content gives null (or an empty array), unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cues of the rule categoriser, in order of precedence.
CATEGORY_CUES = {
    "preferences": ["prefer", "prefers", "preferred", "preference", "preferences", "i like", "i dislike", "i hate", "i love", "i'd rather", "i'd prefer", "favorite", "favourite", "don't like", "always use", "never use", "i want", "我喜欢", "我偏好", "我习惯", "我倾向", "我不喜欢", "我讨厌", "我习惯用", "更喜欢", "最好用", "建议用", "统一用", "不要用", "一直用"],
    "decisions": ["decided", "decision", "we should", "we must", "we will", "we agreed", "chose", "chosen", "going with", "going to use", "let's use", "let's go", "standardize", "standardise", "the rule is", "convention", "决定", "决定用", "决定采用", "我们决定", "最终决定", "应该用", "必须用", "约定", "规范是", "采用", "选用", "切换到", "升级到", "迁移到"],
    "lessons": ["learned", "learnt", "lesson", "mistake", "realized", "realised", "turns out", "gotcha", "pitfall", "takeaway", "note to self", "don't repeat", "beware", "root cause", "the problem was", "教训", "踩坑", "踩了坑", "坑爹", "原来是", "根因", "根本原因", "错误原因", "问题出在", "经验是", "总结一下"],
    "reminders": ["remind", "remember to", "don't forget", "need to", "todo", "to-do", "follow up", "check later", "pending", "记得", "别忘了", "待办", "稍后", "之后要", "需要检查"],
    "habits": ["habit", "my routine", "daily routine", "every day", "every morning", "every night", "my workflow", "daily i", "我的习惯", "每天", "日常流程", "工作流是"],
    "skills": ["how to", "how do i", "how do you", "tutorial", "step by step", "technique", "learn to", "learning to", "怎么用", "如何实现", "教程", "步骤", "方法是"],
    "feedback": ["feedback", "suggestion", "could improve", "issue with", "complaint", "critique", "bug report", "doesn't work", "broken", "建议", "反馈", "有问题", "不好用", "改进"],
}
# Words that are no keywords, no topical terms, no graph nodes.
KEYWORD_STOP = "the a an this that these those with for from your you are was were have has had not but and or can will just like then than into about what when how why which who use used using all any some new one two here there need want make made its it's they them their out our via per".split()
TERM_STOP = "the and for with from this that are was were has have not but all can will been into about using based which would should http https www com org true false null none".split()
GRAPH_STOP = "the and for with from this that are was were has have not but all can will http https www com org true false null".split()
# Fillers, noise prefixes, category aliases, kinds.
FILLERS = "hello|hi|hey|ok|okay|thanks|thank you|yes|no|yep|nope|sure|cool|nice|继续|好的|谢谢|对|嗯|可以|go ahead|please|continue|skip|next".split("|")
NOISE_EVENTS = ["[thinking]", "Q: <task-notification", "<task-notification", "* <task-notification"]
CATEGORY_ALIASES = {"preference": "preferences", "decision": "decisions", "lesson": "lessons", "habit": "habits", "skill": "skills", "reminder": "reminders"}
#: ASCII word boundary; Java's own follows Unicode.
EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
KEYWORD = "[A-Za-z][A-Za-z0-9]+(?:[-./+][A-Za-z0-9]+)*"
TERM = "[a-z0-9][a-z0-9._-]+"


def trim_space(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def content_hash(c: Column) -> Column:
    """SHA-256 of the trimmed content."""
    return F.sha2(trim_space(c), 256)


def is_noise(c: Column) -> Column:
    """Conversational noise: under 10 bytes, commands, tool output, no ASCII alphanumerics or Han, fillers."""
    low = F.lower(trim_space(c))
    return (F.octet_length(c) < 10) | low.startswith("/") | low.startswith("$ ") | low.startswith("> ") | low.startswith("<bash-input>") | low.startswith("<bash-output>") | ~low.rlike("[a-z0-9一-鿿]") | low.isin(FILLERS)


def is_noise_event(c: Column) -> Column:
    """Logged events that replay skips: model monologue and injected notifications."""
    t = trim_space(c)
    out = F.lit(False)
    for p in NOISE_EVENTS:
        out = out | t.startswith(p)
    return out


def category_by_rules(c: Column, cues: dict[str, list[str]] | None = None, cjk_cues: bool = False) -> Column:
    """First category with a cue in the text as a word; otherwise knowledge if there are keywords, else inbox.

    With ``cjk_cues`` Chinese cues match anywhere; by default they need ASCII word characters around them, like others.
    """
    ladder = None
    for cat, phrases in (cues or CATEGORY_CUES).items():
        quoted = [p.replace(".", r"\.") for p in phrases]
        strict = [q for q, p in zip(quoted, phrases) if not (cjk_cues and not p.isascii())]
        free = [q for q, p in zip(quoted, phrases) if cjk_cues and not p.isascii()]
        pattern = f"(?i){EDGE}(?:{'|'.join(strict)}){EDGE}" + (f"|{'|'.join(free)}" if free else "")
        ladder = F.when(c.rlike(pattern), cat) if ladder is None else ladder.when(c.rlike(pattern), cat)
    return ladder.when(F.size(_keyword_words(c)) > 0, "knowledge").otherwise("inbox")


def _keyword_words(c: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(KEYWORD), F.lit(0)), F.lower), lambda w: (F.length(w) >= 3) & ~w.isin(KEYWORD_STOP))


def keywords(c: Column, most: int = 6) -> Column:
    """Up to ``most`` lower-case keywords: multi-part first, then frequent, long, first seen."""

    def rank(low: Column) -> Column:
        one = lambda w: F.struct(F.when(w.rlike("[-./+]"), 0).otherwise(1).alias("multi"), F.size(F.array_remove(low, w)).alias("others"), (-F.length(w)).alias("long"), F.array_position(low, w).alias("at"), w.alias("w"))
        return F.transform(F.slice(F.array_sort(F.transform(F.array_distinct(low), one)), 1, most), lambda s: s["w"])

    # Bound as the variable of an outer lambda, the words are extracted once and not again for each of them.
    return F.coalesce(F.element_at(F.transform(F.array(_keyword_words(c)), rank), 1), F.array().cast("array<string>"))


def terms(c: Column) -> Column:
    """Distinct topical terms: ASCII words without stop words, and the first two to four characters of Han runs."""
    low = F.lower(c)
    ascii_terms = F.filter(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)), lambda w: ~w.isin(TERM_STOP))
    runs = F.filter(F.regexp_extract_all(c, F.lit("[\\x{4e00}-\\x{9fff}]+"), F.lit(0)), lambda r: F.length(r) >= 2)
    heads = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(2), F.least(F.lit(4), F.length(r))), lambda n: F.substring(r, F.lit(1), n))))
    return F.coalesce(F.array_distinct(F.concat(ascii_terms, heads)), F.array().cast("array<string>"))


def wiki_links(c: Column) -> Column:
    """Distinct trimmed targets of ``[[…]]``, empty ones dropped."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"(?s)\[\[(.*?)\]\]"), F.lit(1)), trim_space)
    return F.coalesce(F.array_distinct(F.filter(found, lambda x: x != "")), F.array().cast("array<string>"))


def fingerprint(c: Column) -> Column:
    """Lower case, white space collapsed, first 200 characters."""
    t = F.regexp_replace(F.translate(F.lower(c), "\n\r", " "), " {2,}", " ")
    return F.substring(F.trim(t), 1, 200)


def title(c: Column) -> Column:
    """First line, trimmed, at most 100 characters."""
    return F.substring(trim_space(F.substring_index(c, "\n", 1)), 1, 100)


def preview(c: Column, n: int = 72) -> Column:
    """The first ``n`` characters, with an ellipsis if cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def entity_kind(name: Column) -> Column:
    """Kind of an entity by its name: company, identifier, domain, technology or concept."""
    low = F.lower(name)
    has = lambda *xs: low.rlike("|".join(x.replace(".", r"\.") for x in xs))
    return F.when(has("公司", "有限", "inc", "ltd", "corp", "gmbh"), "company").when((F.octet_length(name) >= 4) & name.rlike("[0-9]"), "identifier").when(has(".com", ".cn", ".io", ".de"), "domain").when(has("api", "sdk", "css", "html", "json", "sql", "tls", "dns", "ssh"), "technology").otherwise("concept")


def is_graph_stop(w: Column) -> Column:
    return w.rlike("^[0-9]+$") | w.isin(GRAPH_STOP)


def normal_category(c: Column) -> Column:
    """Category without brackets, kebab case, singular aliases mapped; garbage and blanks become inbox."""
    s = F.regexp_replace(c, r"^[ \[\]]+|[ \[\]]+$", "")
    s = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(s, "(?<!^)(?<!-)([A-Z])", "-$1")), " ", "-"), "/", "-")
    out = F.when((s == "") | s.rlike(r"[\[\]]") | (F.octet_length(s) > 40), "inbox")
    for k, v in CATEGORY_ALIASES.items():
        out = out.when(s == k, v)
    return F.coalesce(out.otherwise(s), F.lit("inbox"))


def normal_tags(tags: Column) -> Column:
    """Tags trimmed, without empty and repeated ones; null gives none."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(tags, lambda t: trim_space(t)), lambda t: t.isNotNull() & (t != ""))), F.array().cast("array<string>"))


def edit_tags(tags: Column, add: list[str] = (), remove: list[str] = ()) -> Column:
    """Sorted tags with ``add`` and without ``remove``."""
    arr = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return F.array_sort(F.array_except(F.array_union(F.coalesce(tags, F.array().cast("array<string>")), arr(add)), arr(remove)))


def has_all_tags(tags: Column, wanted: list[str]) -> Column:
    """Whether all wanted tags are there, without letter case."""
    low = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    return F.forall(F.array(*[F.lit(w.lower()) for w in wanted]).cast("array<string>"), lambda w: F.array_contains(low, w))


def block_text(message_content: Column) -> Column:
    """Text of a message whose content is a string or a JSON array of blocks: text blocks joined by line breaks."""
    blocks = F.from_json(message_content, "array<struct<type:string,text:string>>")
    joined = trim_space(F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n"))
    return F.when(F.trim(message_content).startswith("["), F.coalesce(joined, F.lit(""))).otherwise(F.regexp_replace(message_content, '^"|"$', ""))


def project_from_path(path: Column) -> Column:
    """Lower-case last part of a path; blank for a blank path."""
    return F.lower(F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1))


def occurrences(c: Column, token: str) -> Column:
    """Non-overlapping occurrences of a token in lower-case text."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(token), F.lit("")))) / len(token)).cast("int")


def snippet(c: Column, keyword: str, before: int = 100, length: int = 300) -> Column:
    """Window of the text around the first occurrence of a keyword, with ``...`` where it is cut."""
    at = F.locate(keyword.lower(), F.lower(c))
    start = F.greatest(at - before, F.lit(1))
    body = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(c, start, F.lit(length)), F.when(F.length(c) >= start + length, "...").otherwise(""))
    return F.when(at > 0, body).otherwise(preview(c, length))
