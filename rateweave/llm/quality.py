"""Line-first cleaning: rules judge each line, failing lines go, and documents that lose too much are rejected.

Lines are what newlines divide; lines without a word are neither judged nor counted. A line fails by the first rule
that holds:

* punctuation: many of its words carry symbols or double exclamation marks, or it is long and has no punctuation at all;
* navigation: it is a list of short items with bars, bullets or arrows between them;
* boilerplate: it is short and holds a stock phrase of web pages, or it repeats an earlier line of the document, or one
  word makes up most of it, or most of its words stand beside the same word again.

A document is rejected if the base rules fail (fewer than 50 words; more than half of its words in three-word
windows that occur twice or more), or if the words lost with failing lines are more than ``max_lost`` of its words.

Everything is computed on whole texts. Defined results: a null or empty text has no words and so fails the base rules.
Rows are judged one by one: ties, repeated rows and other columns don't matter, and a column that has the name of an
output is replaced. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rateweave.llm.common import with_python_columns

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Stock phrases of web pages, in lower case.
STOCK_PHRASES = (
    "all rights reserved", "accept cookies", "back to top", "click here", "cookie policy", "enable javascript",
    "follow us on", "forgot your password", "log in", "lorem ipsum", "powered by", "privacy policy", "read more",
    "sign in", "sign up", "skip to content", "subscribe to our", "terms of service", "terms of use", "we use cookies",
)
STOCK = re.compile(rf"\b(?:{'|'.join(STOCK_PHRASES)})\b", re.IGNORECASE | re.ASCII)  # whole words: no "log in" in "catalog in"
SYMBOL_RUN = re.compile("[#*$%&|<>]{2}|!!")
DIVIDERS = frozenset("|»›•·>/")
PUNCTUATION = re.compile("[.,;:!?…。！？]")


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules. Shares are of the words of a line."""

    symbol_share: float = 0.3
    unpunctuated_words: int = 60
    nav_items: int = 4
    nav_item_words: float = 3.0
    stock_line_words: int = 20
    one_word_share: float = 0.5
    one_word_least: int = 6
    beside_share: float = 0.5
    max_lost: float = 0.5
    #: base rules
    min_words: int = field(default=50)
    max_repeat_percent: int = field(default=50)


def line_fault(line: str, words: list[str], rules: Rules) -> str | None:
    """The rule by which a line fails, apart from repeating another line."""
    n = len(words)
    if SYMBOL_RUN.search(line) and sum(SYMBOL_RUN.search(w) is not None for w in words) > rules.symbol_share * n:
        return "punctuation"
    if n >= rules.unpunctuated_words and not PUNCTUATION.search(line):
        return "punctuation"
    dividers = sum(map(DIVIDERS.__contains__, words))
    if dividers >= rules.nav_items - 1 and n - dividers <= rules.nav_item_words * (dividers + 1):
        return "navigation"
    if n <= rules.stock_line_words and STOCK.search(line):
        return "boilerplate"
    if n >= rules.one_word_least:
        if Counter(words).most_common(1)[0][1] > rules.one_word_share * n:
            return "boilerplate"
        if sum(map(str.__eq__, words, words[1:])) > rules.beside_share * n:
            return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which occurs twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    # number the pairs first, so that no product leaves 64 bits
    _, pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)
    _, at, counts = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    if not twice.any():
        return 0
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : len(words) - 2 + k] |= twice
    return int(hit.sum())


def judge(text: str | None, rules: Rules) -> tuple:
    """Clean text, the counts, the words lost, and the verdicts."""
    text = text or ""
    words = text.encode("utf-8").split()  # bytes: only ASCII blanks divide
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    n_symbols = sum(map(text.count, SYMBOLS))
    n_repeat = repeated_words(words)
    n_dup = lost = 0
    seen: set[str] = set()
    clean = []
    for line in text.split("\n"):
        own = line.encode("utf-8").split()
        if not own:
            clean.append(line)
            continue
        repeats = line in seen
        seen.add(line)
        n_dup += repeats
        if repeats or line_fault(line, [w.decode("utf-8") for w in own], rules):
            lost += len(own)
        else:
            clean.append(line)
    base_failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words
    kept = not base_failed and lost <= rules.max_lost * n_words
    return "\n".join(clean), n_words, word_chars, n_symbols, n_dup, n_repeat, lost, base_failed, kept


FIELDS = [
    ("clean_text", T.StringType(), pa.string()), ("n_words", T.LongType(), pa.int64()),
    ("word_chars", T.LongType(), pa.int64()), ("n_symbols", T.LongType(), pa.int64()),
    ("n_dup_lines", T.LongType(), pa.int64()), ("n_repeat_words", T.LongType(), pa.int64()),
    ("n_lost_words", T.LongType(), pa.int64()), ("base_failed", T.BooleanType(), pa.bool_()),
    ("kept", T.BooleanType(), pa.bool_()),
]


def clean(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """``docs`` with the text that is left (clean_text), the counts and the verdict (kept)."""

    def make(part: pa.RecordBatch) -> list[list]:
        judged = [judge(body, rules) for body in part.column(text).to_pylist()]
        return [list(c) for c in zip(*judged)] if judged else [[] for _ in FIELDS]

    return with_python_columns(docs, FIELDS, make)
