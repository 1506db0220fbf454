"""Text analysis that has no built-in form: protected tokens, Snowball English stems,
temporal expressions, a deterministic embedder. Arrow-batched where Python runs."""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PROTECTED = re.compile(r"https?://\S+|\b[A-Z][A-Z0-9]+-\d+\b|\b\w+(?:\.\w+)+\b")
WORDS = re.compile(r"[^\W_]+")


# --- Porter's second algorithm (Snowball English) --------------------------------
#: Words with stems of their own, words that stay after step 1a.
WHOLE = dict(p.split(":") for p in "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes".split())
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Suffix and replacement of steps 2 and 3; suffixes of step 4.
STEP2 = "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble ogi:og fulli:ful lessli:less li:"
STEP3 = "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:"
STEP4 = "al: ance: ence: er: ic: able: ible: ant: ement: ment: ent: ism: ate: iti: ous: ive: ize: ion:"


def _table(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(p.split(":")) for p in text.split()), key=lambda p: -len(p[0]))


_TABLES = [_table(t) for t in (STEP2, STEP3, STEP4)]


def _after(word: str, start: int) -> int:
    """Where the part after the first non-vowel behind a vowel begins."""
    m = re.compile("[aeiouy][^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def _regions(word: str) -> tuple[int, int]:
    head = re.match("gener|commun|arsen", word)
    r1 = head.end() if head else _after(word, 0)
    return r1, _after(word, r1)


def _short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", word))


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of other than ASCII letters stay."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub("(?<=[aeiouy])y|^y", "Y", word)
    r1, r2 = _regions(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in KEPT:
        return w
    found = next((x for x in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(x)), "")
    if found in ("eed", "eedly"):
        w = w[: -len(found)] + "ee" if len(w) - len(found) >= r1 else w
    elif found and re.search("[aeiouy]", w[: -len(found)]):
        w = w[: -len(found)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif _short(w) and r1 >= len(w):
            w += "e"
    w = re.sub("(?<=.[^aeiouy])[yY]$", "i", w)
    for number, table in enumerate(_TABLES):
        for suffix, into in table:
            if not w.endswith(suffix):
                continue
            left = w[: -len(suffix)]
            good = len(left) >= (r2 if number == 2 or suffix == "ative" else r1)
            before = {"ogi": "l", "li": "cdeghkmnrt", "ion": "st"}.get(suffix)
            if good and (before is None or left[-1:] and left[-1] in before):
                w = left + into
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def analyze_text(text: str | None) -> list[str]:
    """NFC; URLs, code ids and dotted ids whole and unstemmed; the rest lower-cased and stemmed."""
    text, out, at = unicodedata.normalize("NFC", text or ""), [], 0
    for m in PROTECTED.finditer(text):
        out += [stem(w.lower()) for w in WORDS.findall(text[at : m.start()])] + [m[0].lower()]
        at = m.end()
    return out + [stem(w.lower()) for w in WORDS.findall(text[at:])]


def analyzed(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(analyze_text)

    return run(text)


def embedded(text: Column, dim: int = 384) -> Column:
    """A stand-in for a model: component i mod dim gathers byte i / 255, then unit length."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            raw = np.frombuffer((t or "").encode(), np.uint8) / 255.0
            v = np.bincount(np.arange(len(raw)) % dim, weights=raw, minlength=dim)
            return (v / max(np.linalg.norm(v), 1e-12)).tolist()

        return s.map(one)

    return run(text)


# --- temporal expressions ----------------------------------------------------------
ISO = r"\b((?:19|20)\d{2}-\d{2}-\d{2})\b"
YEAR = r"(?:^|[^\d-])((?:19|20)\d{2})(?:$|[^\d-])"
DEICTIC = r"(?i)\b(yesterday|today|tomorrow)\b"
PERIOD = r"(?i)\b(last|this|next) (week|month|year)\b"
AGO = r"(?i)\b(\d{1,4}) (day|week|month|year)s? ago\b"
AHEAD = r"(?i)\bin (\d{1,4}) (day|week|month|year)s?\b"
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
WEEKDAY = rf"(?i)\b({'|'.join(WEEKDAYS)})\b"


def event_dates(text: Column, anchor: Column, most: int = 8) -> Column:
    """Distinct dates a text speaks of, at most ``most``, seen from ``anchor``: ISO
    dates, bare years, yesterday / today / tomorrow, last / this / next week, month
    or year, N units ago, in N units, a weekday (the nearest before the anchor).
    Months are clamped to their last day."""
    t, today = F.coalesce(text, F.lit("")), anchor.cast("date")
    every = lambda pattern, group=1: F.regexp_extract_all(t, F.lit(pattern), F.lit(group))

    def moved(n: Column, unit: Column) -> Column:
        unit = F.lower(unit)
        return F.when(unit == "day", F.date_add(today, n)).when(unit == "week", F.date_add(today, n * 7)).when(unit == "month", F.add_months(today, n)).otherwise(F.add_months(today, n * 12))

    def deictic(word: Column) -> Column:
        word = F.lower(word)
        return F.date_add(today, F.when(word == "yesterday", -1).when(word == "tomorrow", 1).otherwise(0))

    def period(direction: Column, unit: Column) -> Column:
        direction = F.lower(direction)
        return moved(F.when(direction == "last", -1).when(direction == "next", 1).otherwise(0), unit)

    def weekday(name: Column) -> Column:
        wanted = F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.lower(name)).cast("int") - 1
        return F.date_sub(today, F.pmod(F.weekday(today) - wanted - 1, F.lit(7)) + 1)

    found = F.concat(
        F.transform(every(ISO), lambda d: F.try_to_date(d, "yyyy-MM-dd")),
        F.transform(every(YEAR), lambda y: F.make_date(y.cast("int"), F.lit(1), F.lit(1))),
        F.transform(every(DEICTIC), deictic),
        F.zip_with(every(PERIOD), every(PERIOD, 2), period),
        F.zip_with(every(AGO), every(AGO, 2), lambda n, unit: moved(-n.cast("int"), unit)),
        F.zip_with(every(AHEAD), every(AHEAD, 2), lambda n, unit: moved(n.cast("int"), unit)),
        F.transform(every(WEEKDAY), weekday),
    )
    return F.slice(F.array_distinct(F.filter(found, lambda d: d.isNotNull())), 1, most)
