"""Text that looks usual but differs in its characters, and one consistent form of it.

Every letter of a token has a set of scripts in which it could be meant: its own and those in which the same shape exists.
Shapes come from the skeletons of the Unicode confusables, which Spark's own library of Unicode data gives for all letters, so a
set is the same whichever letter it is asked for.  The intersection over the token resolves it.  A token whose letters come from several scripts is mixed; one of a single
script of which every letter has a twin in the script of the text around it is a whole-script confusable.  Both are respelled
in the script that the intersection and the text leave.  Full-width forms, ligatures, letterlike signs, marks apart from
their letters, characters that cannot be seen and special spaces are brought to their usual forms, phonetic letters and the
digits 0 and 1 in the place of a letter too.  Small Greek letters other than omicron stand for themselves.

Cases: null fields are none; authors that aren't a JSON array are read as one name; null and non-text elements of the array
are passed over; text of any length is read whole; rows with the same id give one row for a field; empty tables give an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNSEEN = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e007f"
SPACES = "   -   　"
MARKS = "̀-ͯ᪰-᫿᷀-᷿⃐-⃰︠-︯"
WIDE = "０-９Ａ-Ｚａ-ｚ"
#: Letters and digits in other guise: ligatures, Kelvin and Angstrom, letterlike, circled and mathematical letters, long s.
GUISE = "ﬀ-ﬆℂℊ-ℓℕℙ-ℝℤℨK-ℭℯ-ℱℳℴℹⅠ-ⅿⒶ-ⓩ\U0001d400-\U0001d7ffſ"
_SIGN = re.compile(f"[{UNSEEN}{SPACES}{MARKS}{WIDE}{GUISE}]")
_UNSEEN, _SPACES, _GUISE = re.compile(f"[{UNSEEN}]"), re.compile(f"[{SPACES}]"), re.compile(f"[{WIDE}{GUISE}]+")
_ASCII_DIGIT = re.compile(r"[a-z][01][a-z]|(?<![0-9A-Za-z])[01][a-z]{4}")
#: The same for a filter of whole columns.
SUSPECT = r"[^\x00-\x7F]|[a-z][01][a-z]|(^|[^0-9A-Za-z])[01][a-z]{4}"
#: Letters that no usual Latin or Han spelling has; a text without one needs no look at its scripts.
_ODD = re.compile("[ıĸſ\u0250-\u1dff\u1f00-\u1fff\u2c00-\u2dff\ua4d0-\uabff\ufb00-\ufdff\ufe70-\ufefe\U00010000-\U0001ffff]")
_WORD = re.compile(r"[^\W\d_\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]+")  # Han, kana and Hangul end a word of letters
_LATIN, _GREEK, _CYRILLIC = "LATIN", "GREEK", "CYRILLIC"
#: Scripts with two letter cases, of which a whole word can be taken for Latin.
CASED = {_GREEK, _CYRILLIC, "ARMENIAN", "CHEROKEE", "COPTIC", "GEORGIAN", "DESERET", "OSAGE"}
#: Consonants that begin English words together, and Greek names that follow a number.
_ONSETS = set("bl br ch cl cr dr dw fl fr gh gl gr kl kn kr ph pl pr ps pt rh sc sh sk sl sm sn sp sq st sw th tr ts tw wh wr".split())
_GREEK_NAME = re.compile("alpha|beta|gamma|delta|epsilon|zeta|eta|theta|kappa|lambda|sigma|omega")


@lru_cache(1 << 16)
def script(ch: str) -> str:
    """The script of a letter as its Unicode name tells it; ``other`` for signs and marks that belong to none."""
    name = unicodedata.name(ch, "")
    first = name.split(" ")[0]
    if " LETTER " not in name and first not in ("CJK", _LATIN, _GREEK, _CYRILLIC):
        return "other"
    return "other" if first in ("MODIFIER", "FULLWIDTH", "MATHEMATICAL", "SUPERSCRIPT", "SUBSCRIPT", "HALFWIDTH", "DOUBLE") else first


_TWINS: dict[str, dict[str, str]] | None = None


def twins(spark: SparkSession | None = None) -> dict[str, dict[str, str]]:
    """letter -> script -> the letter of the same shape there; what workers get is passed to ``use``.

    Built once from the skeletons of all letters.  It is bounded by Unicode: some thousand letters.
    """
    global _TWINS
    if _TWINS is None:
        if TaskContext.get() is not None:
            raise RuntimeError("a worker has to be given the table")
        spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        blocks = ((0x41, 0x1100), (0x1200, 0x2E80), (0xA4D0, 0xAC00), (0xFB00, 0x20000))  # without Han, kana and Hangul, whose shapes are their own
        chars = [c for lo, hi in blocks for c in map(chr, range(lo, hi)) if unicodedata.category(c)[0] == "L" and script(c) != "other"]
        shapes: dict[str, list[str]] = {}
        for i in range(0, len(chars), 4000):
            part = chars[i : i + 4000]
            for c, shape in zip(part, checker.getSkeleton("\x01".join(part)).split("\x01")):
                shapes.setdefault(unicodedata.normalize("NFC", shape), []).append(c)
        out: dict[str, dict[str, str]] = {}
        for same in shapes.values():
            for c in same:
                if script(c) == _GREEK and c.islower() and c not in "οϲϳ":
                    continue
                for d in same:
                    usual = d < "\u0250" and d not in "ıĸſ" if script(d) == _LATIN else not (script(d) == _GREEK and d.islower() and d not in "οϲϳ")
                    if usual and c.isupper() == d.isupper() and script(d) not in out.setdefault(c, {}):
                        out[c][script(d)] = d
        _TWINS = {c: t for c, t in out.items() if len(t) > 1 or script(c) not in t}
        for c in chars:
            # phonetic small capitals have a shape of their own but stand for their letter
            m = re.fullmatch(r"LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(c))
            if m:
                _TWINS[c] = {_LATIN: m[1].lower()}
        scripts_of.cache_clear()
    return _TWINS


def use(table: dict[str, dict[str, str]]) -> None:
    """Gives a worker the table."""
    global _TWINS
    if _TWINS is None:
        _TWINS = table
        scripts_of.cache_clear()


@lru_cache(1 << 16)
def scripts_of(ch: str) -> frozenset[str]:
    """The scripts in which a letter of this shape exists."""
    return frozenset({script(ch), *twins().get(ch, ())})


def _phonetic(ch: str) -> bool:
    """A Latin letter that no usual spelling has, beside a usual one of the same shape."""
    return ch == "ı" or ch >= "\u0250" and script(ch) == _LATIN and _LATIN in twins().get(ch, ()) and not "\u1e00" <= ch < "\u1f00"


def _usual(word: str) -> str:
    """``word`` with phonetic letters as usual ones; the Turkish dotless i stays in words that have it by their vowels."""
    if not any(_phonetic(c) for c in word):
        return word
    low = word.lower()
    turkish = not any(c in "ie" for c in low) or any(c in "ğşçöü" for c in low)
    out = [("i" if not turkish else c) if c == "ı" else twins()[c][_LATIN] if _phonetic(c) else c for c in word]
    if out[0] != word[0] and len(word) > 1 and "SMALL CAPITAL" in unicodedata.name(word[0]) and word[1:2].isupper():
        out[0] = out[0].upper()
    return "".join(out)


def _digits(m: re.Match) -> str:
    """A run of letters and digits with 0 and 1 as the letters they stand for, if they do."""
    w = m.group()
    alpha = [c for c in w if c.isalpha()]
    if len(alpha) < 5 or not w[1:].replace("0", "").replace("1", "").islower():
        return w
    out = list(w)
    for k, c in enumerate(w):
        if not c.isdigit():
            continue
        rest = w[k + 1 :]
        if c not in "01" or not rest[:1].islower() or k and not (w[k - 1].islower() or k == 1 and w[0].isalpha()) or _GREEK_NAME.match(rest):
            return w
        if k == 0 and c == "1" and (rest[0] in "aeiouy" or rest[1:2] in tuple("aeiouy") or rest[:2] in _ONSETS):
            return w
        flat = lambda x: x not in "aeiouy01"
        out[k] = "o" if c == "0" else "i" if flat(rest[0]) and (k == 0 or flat(w[k - 1])) else "l"
    return "".join(out)


_RUN = re.compile(r"(?<![0-9A-Za-z./_-])[0-9A-Za-z]+(?![0-9A-Za-z./_-])")


def _respell(word: str, to: str) -> str:
    return "".join(twins().get(c, {}).get(to, c) if script(c) != to else c for c in word)


def spelled(text: str, name: bool = False) -> str:
    """``text`` with mixed and whole-script confusable words in the script they resolve to."""
    if _ASCII_DIGIT.search(text):
        text = _RUN.sub(_digits, text)
    if not _ODD.search(text):
        return text
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    usual = lambda own: own <= {_LATIN, "CJK", "HIRAGANA", "KATAKANA", "HANGUL"}
    # letters that exist in one script only tell the script of the text
    votes: dict[str, int] = {}
    for _, _, w in words:
        own = {script(c) for c in w if script(c) != "other"}
        if len(own) == 1 and any(len(scripts_of(c)) == 1 for c in w):
            (s,) = own
            votes[s] = votes.get(s, 0) + len(w)
    around = max(votes, key=lambda s: votes[s]) if votes else _LATIN
    out, last = [], 0
    for s, e, w in words:
        own = {script(c) for c in w if script(c) != "other"}
        new = w
        if usual(own):
            new = _usual(w) if _LATIN in own else w
            if own == {_LATIN} and around == _CYRILLIC and w.islower() and len(w) <= 2 and all(_CYRILLIC in scripts_of(c) for c in w):
                new = _respell(w, _CYRILLIC)
        elif len(own) > 1:
            firm = frozenset.intersection(*[scripts_of(c) for c in w if script(c) != "other"])
            to = around if around in firm else _LATIN if _LATIN in firm else min(firm, default=None)
            if to in (around, _LATIN) and to or to and 2 * sum(script(c) == to for c in w) > len(w):
                new = _respell(w, to)
            elif _LATIN in own:
                # no script has all letters: letters that stand for themselves (a Greek one, say) stay, twins follow the rest
                new = _respell(w, _LATIN) if 2 * sum(script(c) == _LATIN for c in w) > len(w) else w
            new = _usual(new)
        elif own and around == _LATIN and own <= CASED and all(_LATIN in scripts_of(c) for c in w):
            hyphen = (s > 0 and text[s - 1] in "-‐‑–") or (e < len(text) and text[e] in "-‐‑–")
            if not (own == {_GREEK} and len(w) == 1 and hyphen and not name):
                new = _respell(w, _LATIN)
        out.append(text[last:s]), out.append(new)
        last = e
    out.append(text[last:])
    return "".join(out)


def consistent(text: str, name: bool = False) -> str:
    """One form for all texts that look like ``text``."""
    if text.isascii():
        return _RUN.sub(_digits, text) if _ASCII_DIGIT.search(text) else text
    t = _UNSEEN.sub("", text)
    t = _SPACES.sub(" ", t)
    t = _GUISE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), t)
    return spelled(unicodedata.normalize("NFC", t), name)


def is_case(text: str, name: bool = False) -> bool:
    """Whether ``text`` holds stand-ins for usual characters."""
    if text.isascii():
        return bool(_ASCII_DIGIT.search(text)) and consistent(text, name) != text
    return bool(_SIGN.search(text)) or spelled(text, name) != text


def names_of(authors_json: str) -> list[str]:
    try:
        x = json.loads(authors_json)
    except ValueError:
        return [authors_json]
    return [n for n in x if isinstance(n, str)] if isinstance(x, list) else [x] if isinstance(x, str) else []


def _scan(table: dict[str, dict[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from citeloom.llm import lookalikes as here

        here.use(table)
        for b in batches:
            ids, fields, forms = [], [], []
            for i, title, authors in zip(*(b.column(k).to_pylist() for k in range(3))):
                if title and here.is_case(title):
                    ids.append(i), fields.append("title"), forms.append(here.consistent(title))
                if authors and (not authors.isascii() or "\\u" in authors or _ASCII_DIGIT.search(authors)):
                    names = names_of(authors)
                    if any(here.is_case(n, True) for n in names):
                        ids.append(i), fields.append("authors_json"), forms.append(json.dumps([here.consistent(n, True) for n in names], ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fields, pa.string()), pa.array(forms, pa.string())], names=["record_id", "field_name", "form"])

    return run


def forms(records: DataFrame, damaged: DataFrame | None = None) -> DataFrame:
    """(record_id, field_name, form): the affected fields and their consistent form, without the fields of ``damaged``."""
    x = records.select(F.col("id").cast("long").alias("id"), "title", "authors_json")
    x = x.filter(F.col("title").rlike(SUSPECT) | F.col("authors_json").rlike(SUSPECT + r"|\\u"))
    out = x.mapInArrow(_scan(twins(records.sparkSession)), "record_id long, field_name string, form string").dropDuplicates(["record_id", "field_name"])
    if damaged is not None:
        out = out.join(damaged.select("record_id", "field_name"), ["record_id", "field_name"], "left_anti")
    return out
