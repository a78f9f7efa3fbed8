"""Text functions as columns, with the same character classes wherever they run.

White space is the class ``WS`` (as Unicode-aware scripting languages take it), digits are ``\\p{Nd}``, and
word characters letters, numbers and the underscore, because the regular expression dialects that touch our data disagree on the
short forms. Every function maps null to null unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.thresholds import DEFAULTS, Thresholds

#: Fixed value: the 29 white-space characters. Those beyond Latin-1 stand behind one range, so that most characters take two tests.
WS = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x85\xA0[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]"
#: The same characters, one by one.
SPACES = "\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x85\xA0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202F\u205F\u3000"
#: Fixed value: where lines end; a carriage return with line feed counts once.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
#: Fixed value: ideographs and kana between which no blank is set.
CJK = "一-龥ぁ-ゔァ-ヴー々〆〤"
#: Fixed value: list markers at which a line begins.
MARKER = r"(?:[•・●◦▪■□◆◇▶▸▹▻]|(?:\([1-9]\p{Nd}?\)|(?<!\p{Nd})[1-9]\p{Nd}?[.)](?!\p{Nd})|[①-⑳]))"
#: Fixed value: lines of one of these alone are no text.
QUOTES = ['"', "'", "“", "”", "‘", "’", "「", "」", "『", "』"]
#: Stands for a paragraph break while lines are joined; a private-use character.
BREAK = "\uE000"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def normalize(c: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def is_noise(c: Column) -> Column:
    """Nothing, one character, or digits only; null counts as nothing."""
    s = strip(F.coalesce(c, F.lit("")))
    return (F.length(s) <= 1) | s.rlike(r"\A\p{Nd}+\z")


def is_short(c: Column, t: Thresholds = DEFAULTS) -> Column:
    return F.length(normalize(c)) <= t.short_text


def join_hyphens(c: Column) -> Column:
    """A hyphen at a line end goes if ASCII letters stand on both sides."""
    return F.regexp_replace(c, "([A-Za-z])-\n([A-Za-z])", "$1$2")


def for_translation(c: Column, keep_breaks: bool = True) -> Column:
    """Hyphens joined and lines flowed together; blank lines stay paragraph breaks if asked."""
    c = F.regexp_replace(join_hyphens(c), "\r\n", "\n")
    if not keep_breaks:
        return normalize(c)
    marked = F.regexp_replace(c, f"\n[{WS}]*\n+", BREAK)
    return F.regexp_replace(normalize(marked), BREAK, "\n\n")


def split_lines(c: Column) -> Column:
    """Lines without their ends; an end at the very end opens no further line."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, rf"(?:{LINE_END})\z", ""), LINE_END, -1))


def sentence_chunks(c: Column) -> Column:
    """Pieces after sentence ends that white space follows; the whole text if there are none."""
    s = strip(c)
    parts = F.filter(F.transform(F.split(s, rf"(?<=[。！？!?])[{WS}]+", -1), strip), lambda x: x != "")
    return let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(s)))


def _close_cjk(c: Column) -> Column:
    c = F.regexp_replace(c, rf"(?<=[{CJK}])[{WS}]+(?=[{CJK}])", "")
    c = F.regexp_replace(c, rf"(?<=[{CJK}])[{WS}]+(?=[0-9A-Za-z%])", "")
    c = F.regexp_replace(c, rf"(?<=[0-9A-Za-z%])[{WS}]+(?=[{CJK}])", "")
    return F.regexp_replace(c, rf"(?<=\p{{Nd}})[{WS}]+(?=%)", "")


def _flowed(c: Column) -> Column:
    c = strip(F.regexp_replace(c, rf"[{WS}]*\n+[{WS}]*", " "))
    return F.regexp_replace(c, f"[{WS}]{{2,}}", " ")


def list_render_text(c: Column) -> Column:
    """One line for each list item, its marker and a blank first."""
    flat = _flowed(c)
    spaced = F.regexp_replace(flat, rf"[{WS}]*({MARKER})[{WS}]*", " $1 ")
    parts = F.split(spaced, rf"[{WS}]+(?={MARKER}[{WS}]+)", -1)
    items = F.filter(F.transform(parts, strip), lambda x: x != "")
    items = F.transform(items, lambda x: F.regexp_replace(F.regexp_replace(x, rf"\A({MARKER})[{WS}]*", "$1 "), f"[{WS}]{{2,}}", " "))
    return let(items, lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n")).otherwise(spaced))


def paragraph_render_text(c: Column) -> Column:
    return _close_cjk(_flowed(c))


def render_text(c: Column, kind: Column) -> Column:
    """Text as it is set: clean lines, no blanks round ideographs, no closing quotes at the end; null as empty."""
    c = F.coalesce(c, F.lit(""))
    lines = F.filter(F.transform(split_lines(c), strip), lambda x: (x != "") & ~x.isin(QUOTES))
    joined = let(lines, lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n")).otherwise(strip(c)))
    clean = _close_cjk(F.regexp_replace(joined, f"[{WS}]{{2,}}", " "))
    kinded = let(clean, lambda x: F.when(kind == "list", list_render_text(x)).when(kind == "paragraph", paragraph_render_text(x)).otherwise(x))
    return F.regexp_replace(kinded, rf"[{WS}]*[“”‘’「」『』]+(?=\n?\z)", "")
