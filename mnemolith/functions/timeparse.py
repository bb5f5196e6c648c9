"""Time phrases in parameters, questions and reminders. All functions take ``now`` and are deterministic."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
WORDS = {"秒": 1, "分钟": 60, "分": 60, "小时": 3600, "个小时": 3600, "天": 86400, "周": 604800, "个月": 2592000, "second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000}


def duration(text: str) -> timedelta:
    """'7d', '12h', '1h30m': raises ValueError for anything else."""
    if not re.fullmatch(r"(?:\d+[smhdw])+", text):
        raise ValueError(f"no duration: {text!r}")
    return timedelta(seconds=sum(int(n) * UNITS[u] for n, u in re.findall(r"(\d+)([smhdw])", text)))


def time_param(text: str | None, now: datetime) -> datetime | None:
    """'-7d', '-12h', a date, or an RFC 3339 time; None for blank."""
    if not text or not text.strip():
        return None
    text = text.strip()
    if text[0] == "-":
        return now - duration(text[1:])
    return datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)


@dataclass(frozen=True)
class DateRange:
    """Half-open range of days."""

    start: datetime
    end: datetime


def _day(d: date, days: int = 1) -> DateRange:
    s = datetime(d.year, d.month, d.day)
    return DateRange(s, s + timedelta(days=days))


def _month_days(m: re.Match, first: int, last: int | None, now: datetime) -> DateRange:
    year, month = int(m[1] or now.year), int(m[2])
    start = datetime(year, month, first)
    nxt = datetime(year + month // 12, month % 12 + 1, 1)
    end = nxt if last is None else datetime(year, month, last) + timedelta(days=1)
    if not m[1] and start > now:
        start, end = start.replace(year=year - 1), end.replace(year=end.year - 1)
    return DateRange(start, end)


def time_intent(question: str | None, now: datetime) -> DateRange | None:
    """The range of days a question asks about, or None. A year that is named is honoured."""
    q, today = question or "", now.date()
    low = q.lower()
    if m := re.search(r"(?:近|最近)\s*(\d+)\s*天|last (\d+) days", low):
        return DateRange(_day(today - timedelta(days=int(m[1] or m[2]))).start, now)
    monday = today - timedelta(days=today.weekday())
    if "上周" in q or "last week" in low:
        return _day(monday - timedelta(days=7), 7)
    if "这周" in q or "本周" in q or "this week" in low:
        return DateRange(_day(monday).start, now)
    for words, back in ((("今天", "today"), 0), (("昨天", "yesterday"), 1), (("前天",), 2)):
        if any(w in low for w in words):
            return _day(today - timedelta(days=back))
    if m := re.search(r"(\d{1,2})月(\d{1,2})[号日]\s*(?:到|至|~|-|—)\s*(\d{1,2})月(\d{1,2})[号日]", q):
        a, b = datetime(now.year, int(m[1]), int(m[2])), datetime(now.year, int(m[3]), int(m[4]))
        if a > now:
            a, b = a.replace(year=a.year - 1), b.replace(year=b.year - 1)
        return DateRange(a, b + timedelta(days=1))
    for mark, first, last in (("初", 1, 10), ("中", 8, 20), ("底", 18, None)):
        if m := re.search(rf"(?:(\d{{4}})年)?(\d{{1,2}})月{mark}", q):
            return _month_days(m, first, last, now)
    if m := re.search(r"(?:(\d{4})年)?(\d{1,2})月\s*份?$", q):
        return _month_days(m, 1, None, now)
    if m := re.search(r"(?:(\d{4})年)?(\d{1,2})月(\d{1,2})[号日]", q):
        d = date(int(m[1] or now.year), int(m[2]), int(m[3]))
        return _day(d if m[1] or d <= today + timedelta(days=1) else d.replace(year=d.year - 1))
    if m := re.search(r"\d{4}-\d{2}-\d{2}", q):
        try:
            return _day(date.fromisoformat(m[0]))
        except ValueError:
            return None
    return None


WEEKDAYS = {w: i for i, names in enumerate(("一 monday", "二 tuesday", "三 wednesday", "四 thursday", "五 friday", "六 saturday", "日 sunday")) for w in names.split()} | {"天": 6}


def reminder_time(text: str | None, now: datetime) -> datetime:
    """When a reminder is due: absolute time first, then durations, then days with a time of day; else in an hour."""
    low = (text or "").lower()
    if m := re.search(r"(\d{4}-\d{2}-\d{2})(?:[ t](\d{1,2}):(\d{2}))?", low):
        try:
            d = date.fromisoformat(m[1])
            return datetime(d.year, d.month, d.day, int(m[2] or 9), int(m[3] or 0))
        except ValueError:
            pass
    unit = "|".join(sorted(WORDS, key=len, reverse=True))
    if m := re.search(rf"(\d+)\s*({unit})s?\s*(?:后|之后|later|from now)|in (\d+)\s*({unit})s?|(\d+)([smhdw])\s*(?:后|later)", low):
        n, u = next((int(a), b) for a, b in ((m[1], m[2]), (m[3], m[4]), (m[5], m[6])) if a)
        return now + timedelta(seconds=n * (WORDS.get(u) or UNITS[u]))
    days = None
    for words, n in ((("大后天",), 3), (("后天", "day after tomorrow"), 2), (("明天", "tomorrow"), 1), (("今天", "today", "今晚", "tonight"), 0)):
        if days is None and any(w in low for w in words):
            days = n
    if days is None and (m := re.search(r"(下周|next )(?:周|星期)?([一二三四五六日天]|\w+day)", low)) and m[2] in WEEKDAYS:
        days = 7 - now.weekday() + WEEKDAYS[m[2]]
    hour = minute = None
    if m := re.search(r"(\d{1,2}):(\d{2})", low):
        hour, minute = int(m[1]), int(m[2])
    elif m := re.search(r"(\d{1,2})\s*(?:点|时)(半)?|(\d{1,2})\s*(am|pm)", low):
        hour, minute = int(m[1] or m[3]), 30 if m[2] else 0
    if hour is not None and hour < 12 and re.search(r"下午|晚上|今晚|pm|tonight", low):
        hour += 12
    if days is None and hour is None:
        return now + timedelta(hours=1)
    base = now + timedelta(days=days or 0)
    due = base.replace(hour=9 if hour is None else hour % 24, minute=minute or 0, second=0, microsecond=0)
    return due + timedelta(days=1) if days is None and due < now else due
