"""Line-first cleaning: judge every line, remove the failures, reject texts that lose too much.

A line fails by the first of three kinds of rules that holds:

* punctuation: many symbols for its words, words that end in repeated marks, or a longer
  line whose cased letters are almost all capitals;
* navigation: items parted by bars or arrows, or a few words without any punctuation;
* boilerplate: rights, licences, cookies, sign-in and sharing phrases.

A text is rejected if its base rules fail, or if failed lines hold more than
``max_lost`` of its characters.

Defined results: a null or empty text has no words; it fails the base rules. Lines
without a word neither pass nor fail and stay. Texts are judged one by one and whole;
ties and repeated rows are judged alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import by_text, byte_words, slices

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
BARS = re.compile(r"(?:^|\s)(?:[|»›·•>]|->|::)(?=\s|$)")
REPEATED_MARK = re.compile(r"[!?]{2,}(?=\s|$)")
PUNCTUATION = re.compile(r"[.,;:!?…。！？]")
BOILERPLATE = re.compile(
    r"all rights reserved|copyright|©|licen[sc]ed under|released under|terms of (?:use|service)|privacy policy|"
    r"cookie|click here|sign (?:in|up)|log ?in|subscribe|share (?:this|on)|follow us|back to top|javascript",
    re.IGNORECASE,
)


@dataclass(frozen=True)
class QualitySettings:
    min_words: int = 50
    max_repeated: float = 0.5  # share of words in repeated windows
    max_symbols: float = 0.5  # symbols a word, of a line
    max_marks: float = 0.3  # share of words with repeated marks
    max_capitals: float = 0.7  # share of letters, of lines of 5 words or more
    min_bars: int = 3
    short_line: int = 4  # words of a navigation item at most
    boilerplate_words: int = 30  # longer lines only mention such phrases
    max_lost: float = 0.5


def line_failure(line: str, s: QualitySettings = QualitySettings()) -> str | None:
    """Kind of the rule that a line fails; None if it stays."""
    n = len(line.encode("utf-8", "surrogatepass").split())
    if not n:
        return None
    if sum(map(line.count, SYMBOLS)) > s.max_symbols * n and "|" not in line:
        return "punctuation"
    if len(REPEATED_MARK.findall(line)) > s.max_marks * n:
        return "punctuation"
    if n >= 5 and capitals(line) > s.max_capitals:
        return "punctuation"
    if len(BARS.findall(line)) >= s.min_bars:
        return "navigation"
    if n <= s.short_line and not PUNCTUATION.search(line):
        return "navigation"
    if sum(map(line.count, SYMBOLS)) > s.max_symbols * n:
        return "punctuation"
    if n <= s.boilerplate_words and BOILERPLATE.search(line):
        return "boilerplate"
    return None


def capitals(line: str) -> float:
    """Share of capitals among the letters that have a case; scripts without one have none."""
    upper, lower = sum(map(str.isupper, line)), sum(map(str.islower, line))
    return upper / (upper + lower) if upper else 0.0


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that occurs twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    pair = ids[:-2] * len(number) + ids[1:-1]
    if len(number) >= 1 << 20:  # three numbers would not fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, n = np.unique(pair * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = n[at] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= twice
    return int(covered.sum())


def judge(text: str | None, s: QualitySettings = QualitySettings()) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost, cleaned text."""
    text = text or ""
    words = byte_words(text)
    n = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    repeats = repeated_words(words)
    seen, dup, lost, stay = set(), 0, 0, []
    for line in text.split("\n"):
        if line.strip(BLANKS):
            dup += line in seen
            seen.add(line)
            if line_failure(line, s):
                lost += len(line)
                continue
        stay.append(line)
    failed = n < s.min_words or repeats > s.max_repeated * n
    share = lost / len(text) if text else 0.0
    return n, word_chars, symbols, dup, repeats, failed, not failed and share <= s.max_lost, share, "\n".join(stay)


FIELDS = (
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("lost", pa.float64()),
    ("clean_text", pa.string()),
)
SPARK = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.float64(): "double", pa.string(): "string"}


def judge_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", settings: QualitySettings = QualitySettings(), with_text: bool = True) -> DataFrame:
    """``keep``, then counts, verdict, share of lost characters and, if wanted, the cleaned text."""
    kept = docs.select(*keep, F.col(text).alias("text_"))
    fields = FIELDS if with_text else FIELDS[:-1]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes if n != "text_"), *(f"{n} {SPARK[t]}" for n, t in fields)])

    def run(batches):
        for batch in batches:
            own = pa.schema([batch.schema.field(n) for n in keep] + list(map(pa.field, *zip(*fields))))
            yield from by_text(iter([batch]), "text_", lambda t: judge(t, settings), own, keep)

    return kept.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, text: str = "text", settings: QualitySettings = QualitySettings()) -> DataFrame:
    """The documents that are kept, with their failed lines removed; all columns stay as they are
    otherwise, but for ``n_chars``, which follows the text."""

    def run(batches):
        for batch in slices(batches):
            rows = [judge(t.as_py(), settings) for t in batch.column(text)]
            new = pa.array([r[-1] for r in rows], pa.string())
            at = batch.schema.get_field_index(text)
            batch = batch.set_column(at, pa.field(text, pa.string()), new)
            yield batch.filter(pa.array([r[6] for r in rows], pa.bool_()))

    cleaned = docs.mapInArrow(run, docs.schema)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
