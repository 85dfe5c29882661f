"""Text measures and rewrites on columns, as expressions that stay in the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words beside which secrets stand; words that say a thing is gone, is of the past, or is done; in English, then in Vietnamese.
SECRET_WORDS = "key token secret password passwd credential cookie auth".split()
GONE_WORDS = ["removed", "deleted", "renamed", "deprecated", "obsolete", "legacy", "formerly", "no longer", "used to", "replaced", "retired", "dropped", "moved to", "was moved", "old", "do not use", "don't use", "never use", "avoid"]
GONE_WORDS_VI = ["xóa", "xoá", "gỡ", "đổi tên", "thay bằng", "đã bỏ", "bỏ hẳn", "đã gộp", "gộp vào", "dời sang", "đã dời", "không còn", "trước đây", "cũ", "không dùng", "đừng dùng", "cấm dùng"]
PAST_WORDS = ["previously", "originally", "historically", "in the past", "earlier version", "earlier versions", "back then", "at the time"]
PAST_WORDS_VI = ["hồi đó", "hồi trước", "lúc đó", "khi đó", "ngày trước", "lúc trước", "thời điểm đó"]
DONE_WORDS = ["DONE", "XONG"]
# Nouns behind which "từng" means "each" rather than "once".
EACH_NOUNS = (
    "câu video file dòng bước người cái phần mục lần cảnh bài trang chữ từ ô khung đoạn chương tập ngày tuần tháng cue clip lượt nhóm loại kênh job đơn phiên ảnh hình bản tool task vùng "
    "màn nút tab cột hàng thứ chút chỗ nơi con chiếc một module hàm lớp tầng frame giây phút stage series track model agent điểm việc"
).split()
FEWEST_SECRET_CHARS = 6
NUMBER = r"\d+(?:[.,/]\d+)*"


def says(text: Column, words: list[str]) -> Column:
    """Whether one of the words or phrases stands in a text by itself, letter case aside, in any script."""
    return text.rlike(r"(?iu)(?<![\p{L}\p{N}_'])(?:" + "|".join(re.escape(w) for w in words) + r")(?![\p{L}\p{N}_'])")


def without_secrets(text: str) -> str:
    """Reads assignments `name = value` from left to right: where the word before the sign holds a secret word, the value, up to a space or quote, becomes *** unless it is short."""
    out, done, at = [], 0, 0
    while (at := min((p for p in (text.find("=", at), text.find(":", at)) if p >= 0), default=-1)) >= 0:
        end = len(text[done:at].rstrip()) + done
        if end > done and text[end - 1] in "\"'":
            end -= 1
        start = end
        while start > done and (text[start - 1].isalnum() or text[start - 1] == "_"):
            start -= 1
        at += 1
        if not any(w in text[start:end].lower() for w in SECRET_WORDS):
            continue
        value = at
        while value < len(text) and text[value].isspace():
            value += 1
        value += text[value : value + 1] in ("'", '"')
        stop = value
        while stop < len(text) and not (text[stop].isspace() or text[stop] in "\"'"):
            stop += 1
        if stop - value >= FEWEST_SECRET_CHARS:
            out += [text[done:value], "***"]
            done = at = stop
    return "".join([*out, text[done:]])


@F.pandas_udf(T.StringType())
def redact(text: pd.Series) -> pd.Series:
    """Values of keys, tokens, passwords and the like become ***; null stays null."""
    return text.map(lambda t: None if t is None else without_secrets(t))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\s`*()\[\]\"',;!?]+"), lambda w: w != "")


def _some_place(array: Column, test) -> Column:
    """Whether `test` of (array, index) holds anywhere."""
    return F.exists(F.sequence(F.lit(0), F.size(array)), lambda i: F.coalesce(test(array, i), F.lit(False)))


def _is_version(word: Column) -> Column:
    """Two or more numbers between dots, perhaps behind a v."""
    parts = F.split(F.when(word.startswith("v"), F.substring(word, 2, 99)).otherwise(word), r"\.")
    return (F.size(parts) >= 2) & F.forall(parts, lambda d: (d != "") & (F.translate(d, "0123456789", "") == ""))


def version_range(text: Column) -> Column:
    """Whether a text names a span of versions: two versions with a dash between them."""
    flat = F.regexp_replace(F.translate(text, "–—", "--"), r"\s*-\s*", "-")
    spans = F.transform(_words(flat), lambda w: F.split(F.regexp_replace(w, r"[.:]+$", ""), "-"))
    return F.exists(spans, lambda parts: _some_place(parts, lambda a, i: _is_version(F.get(a, i)) & _is_version(F.get(a, i + 1))))


def dated_measure(text: Column) -> Column:
    """Whether a text gives the date of a figure: "measured 3 May", "measured on 2024-05-03", "đo 3/5", "tính đến ngày 3/5"."""
    number = lambda w: w.rlike("^[0-9]")
    date = lambda w: w.rlike("^[0-9]{1,2}/[0-9]{1,2}$")

    def at(a: Column, i: Column) -> Column:
        word, one, two, three = (F.get(a, i + k) for k in range(4))
        english = (word == "measured") & (number(one) | ((one == "on") & number(two)))
        return english | ((word == "đo") & (date(one) | ((one == "ngày") & date(two)))) | ((word == "tính") & (one == "đến") & (date(two) | ((two == "ngày") & date(three))))

    return _some_place(_words(F.regexp_replace(text, r"\.(?=\s|$)", "")), at)


def once_in_the_past(text: Column) -> Column:
    """Vietnamese "từng" as "once": not before a noun, where it means "each"."""
    return _some_place(_words(F.regexp_replace(text, r"[.:](?=\s|$)", "")), lambda a, i: (F.get(a, i) == "từng") & ~F.coalesce(F.get(a, i + 1), F.lit("")).isin(EACH_NOUNS))


def is_past(text: Column) -> Column:
    """A sentence about the past rather than about now."""
    return says(text, PAST_WORDS + PAST_WORDS_VI) | version_range(text) | dated_measure(text) | once_in_the_past(text)


def is_done(text: Column) -> Column:
    """A line that is ticked off: an item with a crossed box, a check mark, or a word for done in capitals."""
    body = F.ltrim(text)
    box = F.ltrim(F.substring(body, 2, 1 << 20))
    ticked = F.substring(body, 1, 1).isin("-", "*", "+") & (F.substring(body, 2, 1).isin(" ", "\t")) & F.lower(F.substring(box, 1, 3)).eqNullSafe("[x]")
    return ticked | F.contains(text, F.lit("✅")) | F.arrays_overlap(F.split(text, r"(?U)\W+"), F.array(*(F.lit(w) for w in DONE_WORDS)))


def token_estimate(text: Column) -> Column:
    """Four ASCII characters or one and a half others make a token; halves round to even."""
    ascii_chars = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.bround(ascii_chars / 4 + (F.length(text) - ascii_chars) / 1.5, 0).cast("long")


def fingerprint(rule: Column, path: Column, claim: Column, line: Column) -> Column:
    """Names a finding by rule, path, claim and its line with white space collapsed, so that it survives moves of the line."""
    flat = F.trim(F.regexp_replace(line, r"\s+", " "))
    return F.substring(F.sha1(F.concat_ws("\u0000", rule, path, claim, flat).cast("binary")), 1, 16)


def slug(text: Column) -> Column:
    """Heading id of the page renderer: tags out, lower case, word characters, spaces, hyphens and dots kept, spaces and underscores to hyphens."""
    plain = F.lower(F.trim(F.regexp_replace(text, r"<[^>]+>", "")))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    kept = F.regexp_replace(plain, r"(?U)[^\w\s\-.]", "")
    hyphens = F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_]+", "-"), r"^-+|-+$", "")
    return F.when(hyphens == "", F.lit("section")).otherwise(hyphens)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), 1)).cast("long")


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(words / 200)).cast("long")


def terms(text: Column) -> Column:
    """Search terms: runs of two or more letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([^\W_]{2,})"), 1)


def is_acknowledged(text: Column) -> Column:
    """Says itself that what it names is gone."""
    return says(text, GONE_WORDS + GONE_WORDS_VI)


def number_shape(text: Column) -> Column:
    """A line in lower case with every number as #."""
    flat = F.trim(F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"[`*_>#|]", " "))), r"\s+", " "))
    return F.regexp_replace(flat, NUMBER, "#")
