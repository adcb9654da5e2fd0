"""Line-first quality cleaning.

Every line is judged by itself; failing lines are removed; a document is rejected if
too much of its text went, or if it fails the document base rules. Arrow batches are
processed one by one and a document never leaves its task, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import without

SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A document that loses more than this share of its words (percent) is rejected.
MAX_LOST_PERCENT = 50

# Phrases of boilerplate lines, as one pattern over the lower-cased line.
BOILERPLATE = (
    r"(all rights reserved|licensed under|released under the|copyright|privacy policy|terms of (use|service)|"
    r"cookie policy|uses cookies|enable javascript|click here|subscribe to|sign up for)"
)
# What ends a sentence, and what separates entries of a navigation line.
TERMINAL = r"[.!?…。！？][\"'”’»)\]]*$"
SEPARATORS = r"[|»›•·→]"
#: A line of fewer words without terminal punctuation is a fragment.
FRAGMENT_WORDS = 8
#: A navigation line has so many separators at least, and one for so many words.
NAV_SEPARATORS, NAV_WORDS = 2, 4

_boilerplate, _terminal, _separators = re.compile(BOILERPLATE), re.compile(TERMINAL), re.compile(SEPARATORS)
_drop_symbols = str.maketrans("", "", SYMBOLS)

STATS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("n_bad_lines", pa.int64()), ("n_lost_words", pa.int64()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("cleaned", pa.string()),
]
SQL_TYPES = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.string(): "string"}


def line_fails(line: str, n_words: int) -> str:
    """The rule a line with words fails ('boilerplate', 'navigation', 'punctuation'), or ''.

    punctuation: no sentence end at the end of a line of few words, or none anywhere in
    a longer one.
    """
    if _boilerplate.search(line.lower()):
        return "boilerplate"
    seps = len(_separators.findall(line))
    if seps >= NAV_SEPARATORS and seps * NAV_WORDS >= n_words:
        return "navigation"
    if n_words < FRAGMENT_WORDS:
        if not _terminal.search(line.rstrip(SPACES)):
            return "punctuation"
    elif "." not in line and "!" not in line and "?" not in line and not re.search(r"[…。！？]", line):
        return "punctuation"
    return ""


def repeat_words(words: list[bytes]) -> int:
    """Words inside five-word windows found twice or more, the first one included."""
    if len(words) < WINDOW + 1:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            covered += i + WINDOW - max(end, i)
            end = i + WINDOW
    return covered


def judge(text: str | None) -> tuple:
    """One document's values in the order of STATS."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    seen: set[str] = set()
    dups = bad = lost = 0
    kept_lines = []
    for line in lines:
        k = len(line.encode("utf-8", "surrogatepass").split()) if len(lines) > 1 else n
        if not k:
            kept_lines.append(line)
            continue
        if line in seen:
            dups += 1
        else:
            seen.add(line)
        if line_fails(line, k):
            bad += 1
            lost += k
        else:
            kept_lines.append(line)
    repeats = repeat_words(words)
    base_failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    kept = not base_failed and 100 * lost <= MAX_LOST_PERCENT * n
    return n, word_chars, symbols, dups, repeats, bad, lost, base_failed, kept, "\n".join(kept_lines) if bad else text


def clean_documents(docs: DataFrame, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines, n_lost_words,
    base_failed, kept and (with_text) cleaned, the text without its failing lines.

    A null text counts as empty: no words, so base_failed. Rows are judged one by one,
    so repeated rows and ties come back as they are; an empty table gives an empty one.
    Input columns named like an output are replaced (a text column may not be).
    """
    stats = STATS if with_text else STATS[:-1]
    rows = without(docs, [c for c, _ in stats])
    names = rows.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{c} {SQL_TYPES[t]}" for c, t in stats])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text_col))
            for at in range(0, batch.num_rows, 500):  # bounds what a batch of long texts holds at once
                part = batch.slice(at, 500)
                judged = [judge(t.as_py()) for t in texts.slice(at, 500)]
                columns = list(zip(*judged))
                arrays = [pa.array(columns[i], t) for i, (_, t) in enumerate(stats)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*names, *[c for c, _ in stats]])

    return rows.mapInArrow(run, schema)
