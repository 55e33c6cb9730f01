"""Text columns: strip, clean, sanitise, title case, JSON strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that end a line and those that count as blank.
LINE_BREAKS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _char_class(chars: str) -> str:
    """Regex class of the characters, neighbours joined to ranges, which match faster."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\u{first:04x}-\\u{last:04x}" for first, last in ranges) + "]"


_BREAK = _char_class(LINE_BREAKS)
_BLANK = _char_class(BLANKS)
_INLINE = _char_class("".join(c for c in BLANKS if c not in LINE_BREAKS))
_TABLIKE = _char_class("".join(c for c in BLANKS if c not in LINE_BREAKS + " "))

# A run of blanks that holds a line break or two spaces in a row. Where the run starts with
# other blanks, the look-behind lets a match start only there, so long runs cost linear time.
_SEPARATOR = f"(?:{_BREAK}|  )"
_SEPARATOR_RUN = (
    f"(?:{_SEPARATOR}|{_INLINE}(?<!{_INLINE}{_INLINE})(?:{_TABLIKE}| (?! ))*+{_SEPARATOR}){_BLANK}*+"
)

_CASED = "[\\p{IsLowercase}\\p{IsUppercase}\\p{Lt}]"


def strip(text: Column) -> Column:
    """Trim every blank Unicode knows, not only spaces."""
    return F.btrim(text, F.lit(BLANKS))


def clean_text(text: Column) -> Column:
    """One trimmed phrase per line: lines and double spaces split, empty phrases go.

    Splitting, trimming and joining amounts to turning each blank run that holds a
    separator into one newline and trimming the ends, which needs no array.
    """
    return strip(F.regexp_replace(text, _SEPARATOR_RUN, "\n"))


def ascii_only(text: Column) -> Column:
    """Each code point outside ASCII becomes one question mark."""
    return F.regexp_replace(text, "[^\\x00-\\x7F]", "?")


def nonblank(text: Column) -> Column:
    return strip(text) != ""


def title_case(text: Column) -> Column:
    """Capitalise each run of cased letters: ``a.b it's`` becomes ``A.B It'S``."""
    runs = F.regexp_extract_all(text, F.lit(f"({_CASED}+|[^{_CASED[1:-1]}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def indent(level: Column) -> Column:
    return F.repeat(F.lit("  "), level)


def json_string(text: Column) -> Column:
    """JSON string literal in ASCII: other characters become UTF-16 escapes."""
    quoted = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    def escape(char: Column) -> Column:
        units = F.lower(F.hex(F.encode(char, "UTF-16BE")))
        return (
            F.when(char == "\n", "\\n")
            .when(char == "\r", "\\r")
            .when(char == "\t", "\\t")
            .when(char == "\f", "\\f")
            .when(char == "\b", "\\b")
            .otherwise(F.regexp_replace(units, "(.{4})", "\\\\u$1"))
        )

    pieces = F.regexp_extract_all(quoted, F.lit("([ -~]+|[^ -~])"), F.lit(1))
    escaped = F.transform(pieces, lambda p: F.when(p.rlike("^[ -~]"), p).otherwise(escape(p)))
    body = F.when(quoted.rlike("[^ -~]"), F.array_join(escaped, "")).otherwise(quoted)
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))
