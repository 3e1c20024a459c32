"""Python-flavoured patterns in the JVM's regex dialect."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python counts as whitespace in text patterns, without the newline.
_BLANK = (
    r"\t\x0B\f\r\x1C-\x20\x85\xA0"
    r"\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# A word character. U+10000 is a letter anyway; naming it makes the JVM look behind by
# whole code points, where it would else see half of a surrogate pair.
WORD = r"[\p{L}\p{N}_" + "\U00010000]"
_EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
WHITESPACE = f"[\\n{_BLANK}]"


def jvm(pattern: str, by_line: bool = False) -> str:
    """Translate ``pattern`` so that Java matches what Python would.

    Java's own ``\\b`` and ``\\s`` follow other Unicode rules than Python's and
    change between JDK releases, so both are spelled out. With ``by_line`` the
    result finds, in one pass over a whole text, exactly the matches that lie
    within single lines: whitespace stops at a newline and ``^``/``$`` are line
    ends.
    """
    flags = "dm" if by_line else "d"
    if pattern.startswith("(?i)"):
        pattern, flags = pattern[4:], "iu" + flags
    blank = _BLANK if by_line else r"\n" + _BLANK
    in_class = False
    out = []
    for part in re.findall(r"\\.|.", pattern, flags=re.S):
        if part == r"\s":
            part = blank if in_class else f"[{blank}]"
        elif part == r"\b":
            part = _EDGE
        elif part == r"\n" and by_line:
            part = "(?!)"
        elif part in "[]":
            in_class = part == "["
        out.append(part)
    return f"(?{flags})" + "".join(out)


def folded(text: Column) -> Column:
    """Lower-case text in which every letter that matches s, i or k without case does.

    A literal that case-blind patterns need occurs in the folded text whenever
    the pattern matches; a plain substring test is far cheaper than a regex.
    """
    fold = F.lower(text)
    # three searches, where translating would look up each character
    for letter, plain in (("\u017f", "s"), ("\u0131", "i"), ("\u0307", "")):
        fold = F.replace(fold, F.lit(letter), F.lit(plain))
    return fold


def stripped(text: Column) -> Column:
    """Text without the whitespace at its ends.

    An expression for the end of a text is tried at each of its characters, so
    it only runs where the first or the last character is whitespace.
    """
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(F.regexp_like(ends, F.lit(WHITESPACE)), F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+\\z", "")).otherwise(text)
