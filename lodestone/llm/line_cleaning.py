"""Line-first cleaning: rules judge single lines, failed lines go, and documents that lose too much text are rejected."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_chunks

#: Phrases, as patterns, that mark a line as boilerplate wherever it stands.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "click here to",
    "enable javascript",
    "accept all cookies",
    "share on facebook",
    "follow us on",
    "lorem ipsum",
    "licensed under",
    "mit license",
    "apache license",
    "gnu general public license",
    "creative commons",
    "spdx-license-identifier",
    r"copyright \(c\)",
)
_BOILERPLATE = re.compile("|".join(BOILERPLATE).encode())
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(x for x in range(256) if x not in _SYMBOLS)
_NOT_LINE_SYMBOL = bytes(x for x in range(256) if x not in b"#*$%&<>{}[]=~^\\")


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the verdict on documents.

    * ``max_symbols``: code-like symbols for each word of a line.
    * ``max_bangs``: words that end in ``!`` or ``?``, for each word of a line.
    * ``max_bars``: navigation separators (`` | ``, `` > ``, `` » ``) for each word.
    * ``max_links``: web addresses, for each word.
    * ``max_upper``: share of upper-case words in lines of at least ``min_words``.
    * ``max_same``: share of a line's most frequent word, in lines of at least 8 words.
    * ``min_kept``: share of the words' bytes that must be left.
    """

    max_symbols: float = 0.3
    max_bangs: float = 0.3
    max_bars: float = 0.3
    max_links: float = 0.3
    max_upper: float = 0.6
    max_same: float = 0.5
    min_words: int = 4
    min_kept: float = 0.6
    min_doc_words: int = 50
    max_repeat_percent: int = 50


def line_fault(raw: bytes, rules: LineRules = LineRules()) -> str | None:
    """The first rule that a line (UTF-8) with at least one word breaks, or None.

    Case is judged by the letters A to Z alone.
    """
    words = raw.split()
    n = len(words)
    if len(raw.translate(None, _NOT_LINE_SYMBOL)) > rules.max_symbols * n:
        return "symbols"
    if n >= rules.min_words:
        if (b"!" in raw or b"?" in raw) and sum(w.endswith((b"!", b"?")) for w in words) > rules.max_bangs * n:
            return "punctuation"
        if sum(map(bytes.isupper, words)) > rules.max_upper * n:
            return "shouting"
    if (b"|" in raw or b">" in raw or b"\xc2\xbb" in raw) and sum(w in (b"|", b">", b"\xc2\xbb") for w in words) > rules.max_bars * n:
        return "navigation"
    if (b"://" in raw or b"www." in raw) and sum(w.startswith((b"http://", b"https://", b"www.")) for w in words) > rules.max_links * n:
        return "links"
    if n >= 8 and max(Counter(words).values()) > rules.max_same * n:
        return "repetition"
    return "boilerplate" if _BOILERPLATE.search(raw.lower()) else None


def clean_lines(raw: bytes, rules: LineRules = LineRules()) -> tuple[bytes, int, int]:
    """A text (UTF-8) without failed and repeated lines, the bytes in words before, and after.

    Lines without a word are layout: they stay and count nothing.  A line that
    equals an earlier line of the text is boilerplate.
    """
    kept, seen, before, after = [], set(), 0, 0
    for line in raw.split(b"\n"):
        size = sum(map(len, line.split()))
        before += size
        if size and (line in seen or line_fault(line, rules)):
            continue
        seen.add(line)
        after += size
        kept.append(line)
    return b"\n".join(kept), before, after


class _Ids(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more among ``words``."""
    n = len(words)
    if n < 4:
        return 0
    ids = _Ids()
    at = np.array([ids[w] for w in words], dtype=np.int64)
    size = len(ids)
    # two steps keep the codes small enough for any number of distinct words
    _, pairs = np.unique(at[:-1] * size + at[1:], return_inverse=True)
    codes = pairs[:-1].astype(np.int64) * size + at[2:]
    _, back, counts = np.unique(codes, return_inverse=True, return_counts=True)
    twice = counts[back] > 1
    hit = np.zeros(n, dtype=bool)
    for k in range(3):
        hit[k : k + n - 2] |= twice
    return int(hit.sum())


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text (UTF-8)."""
    words = raw.split()
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    chars = int(np.count_nonzero((flat & 0xC0) != 0x80))
    symbols = len(raw.translate(None, _NOT_SYMBOL))
    lines = [x for x in raw.split(b"\n") if x.split()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def _judge(batches: Iterator[pa.RecordBatch], rules: LineRules, with_text: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] + [pa.string()] * with_text
    labels = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_bytes"] + ["cleaned"] * with_text
    for batch in batches:
        for ids, texts in text_chunks(batch):
            rows = []
            for doc_id, raw in zip(ids, texts):
                n_words, chars, symbols, dup, repeat = base_counts(raw)
                failed = n_words < rules.min_doc_words or 100 * repeat > rules.max_repeat_percent * n_words
                cleaned, before, after = clean_lines(raw, rules)
                kept = not failed and after >= rules.min_kept * before
                rows.append((doc_id, n_words, chars, symbols, dup, repeat, failed, kept, before - after, *((cleaned.decode("utf-8", "replace"),) if with_text else ())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], labels)


def line_first_cleaning(documents: DataFrame, rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """Counts, verdict and, with ``with_text``, the cleaned text of every document.

    One pass without a shuffle.  ``kept`` is false where the base rules fail
    (under 50 words, or over half of the words in repeated 3-word windows) or
    where fewer than ``rules.min_kept`` of the words' bytes are left once
    failed lines are gone.  A null or empty text has no words and fails.
    Repeated rows are judged each for itself; other columns are not read.
    """
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, removed_bytes long"
    schema += ", cleaned string" * with_text
    return documents.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(lambda batches: _judge(batches, rules, with_text), schema)
