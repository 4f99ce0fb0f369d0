"""Text of right-to-left scripts: visual order to logical order and back, presentation forms, word runs.

The column functions go to Python in Arrow batches and only for texts that have
a right-to-left character; all others stay in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Blocks of the Arabic and Hebrew scripts, and those of Arabic presentation forms.
ARABIC = "؀-ۿݐ-ݿࡰ-࢟ࢠ-ࣿﭐ-﷿ﹰ-﻿\U00010e60-\U00010e7f\U0001ee00-\U0001eeff"
HEBREW = "֐-׿יִ-ﭏ"
FORMS = "ﭐ-﷿ﹰ-﻿"
_RTL, _FORM = re.compile(f"[{ARABIC}{HEBREW}]"), re.compile(f"[{FORMS}]")
#: What belongs to a left-to-right word that it touches.
AFFIXES = ".-_#@%"
LTR, RTL = 0, 1


def is_rtl(text: str) -> bool:
    return _RTL.search(text) is not None


def _ltr_content(ch: str) -> bool:
    return ch.isalnum() and not is_rtl(ch)


def has_compact_mixed(text: str) -> bool:
    """Whether a token without white space has both directions."""
    return any(is_rtl(t) and any(map(_ltr_content, t)) for t in text.split())


def is_ltr_prefixed_mixed(text: str) -> bool:
    """One that begins left to right."""
    first = next((c for c in text if c.isalnum()), "")
    return has_compact_mixed(text) and bool(first) and _ltr_content(first)


def normalize_forms(text: str) -> str:
    """Arabic presentation forms, each by itself, as their letters."""
    return _FORM.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)


def normalize_whole(text: str) -> str:
    """The whole text's NFKC form if it has a presentation form."""
    return unicodedata.normalize("NFKC", text) if _FORM.search(text) else text


# The bidirectional algorithm (UAX #9) for one line without explicit marks, which count as neutral


def levels(classes: Sequence[str], base: int) -> list[int]:
    """Embedding levels by the rules for weak, neutral and implicit types."""
    kind = ["ON" if c in ("LRE", "RLE", "LRO", "RLO", "PDF", "LRI", "RLI", "FSI", "PDI", "BN", "") else c for c in classes]
    edge = "R" if base else "L"
    n = len(kind)
    last = edge
    for i in range(n):  # marks take what is before them
        if kind[i] == "NSM":
            kind[i] = last
        last = kind[i]
    strong = edge
    for i in range(n):
        if kind[i] in ("L", "R", "AL"):
            strong = kind[i]
        elif kind[i] == "EN" and strong == "AL":
            kind[i] = "AN"
    kind = ["R" if k == "AL" else k for k in kind]
    for i in range(1, n - 1):  # separators between numbers of one kind
        a, k, b = kind[i - 1 : i + 2]
        if a == b and ((k == "ES" and a == "EN") or (k == "CS" and a in ("EN", "AN"))):
            kind[i] = a
    for i in range(n):  # terminators beside numbers
        if kind[i] == "ET":
            j = i
            while j < n and kind[j] == "ET":
                j += 1
            near = (j < n and kind[j] == "EN") or (i > 0 and kind[i - 1] == "EN")
            kind[i:j] = ["EN" if near else "ON"] * (j - i)
    kind = ["ON" if k in ("ES", "CS", "ET") else k for k in kind]
    strong = edge
    for i in range(n):
        if kind[i] in ("L", "R"):
            strong = kind[i]
        elif kind[i] == "EN" and strong == "L":
            kind[i] = "L"
    i = 0
    while i < n:  # neutrals between two of one direction take it, others the line's
        if kind[i] in ("L", "R", "EN", "AN"):
            i += 1
            continue
        j = i
        while j < n and kind[j] not in ("L", "R", "EN", "AN"):
            j += 1
        side = lambda k: "L" if k == "L" else "R"
        before, after = side(kind[i - 1]) if i else edge, side(kind[j]) if j < n else edge
        kind[i:j] = [before if before == after else edge] * (j - i)
        i = j
    raise_by = {0: {"L": 0, "R": 1, "EN": 2, "AN": 2}, 1: {"L": 1, "R": 0, "EN": 1, "AN": 1}}[base]
    out = [base + raise_by[k] for k in kind]
    end = n
    while end and classes[end - 1] in ("WS", "S", "B", "BN"):  # white space at the end
        end -= 1
        out[end] = base
    return out


def visual_order(of: Sequence[int]) -> list[int]:
    """Places from left to right: from the highest level down, runs at it or above are reversed."""
    order = list(range(len(of)))
    for level in range(max(of, default=0), 0, -1):
        i = 0
        while i < len(order):
            if of[order[i]] < level:
                i += 1
                continue
            j = i
            while j < len(order) and of[order[j]] >= level:
                j += 1
            order[i:j] = reversed(order[i:j])
            i = j
    return order


def first_direction(text: str) -> int:
    return next((int(c != "L") for c in map(unicodedata.bidirectional, text) if c in ("L", "R", "AL")), LTR)


def reorder_line(line: str) -> str:
    """Logical to visual order, by the first strong character's direction."""
    return "".join(line[i] for i in visual_order(levels([unicodedata.bidirectional(c) for c in line], first_direction(line))))


def _per_line(text: str, work: Callable[[str], str]) -> str:
    return "\n".join(work(x) for x in text.split("\n"))


def reorder(text: str) -> str:
    return _per_line(text, reorder_line)


def reorder_for_output(text: str) -> str:
    return normalize_whole(reorder(text))


# Visual order back to logical order


def base_direction(text: str) -> tuple[int, str]:
    """The direction a line was set in, and how sure that is: exact, inferred or ambiguous."""
    tokens = text.split()
    rtl = sum(is_rtl(t) for t in tokens)
    ltr = sum(any(c.isalpha() and not is_rtl(c) or c.isnumeric() for c in t) for t in tokens)
    strong = [RTL if is_rtl(c) else LTR for c in text if is_rtl(c) or c.isalpha()]
    if not strong:
        return LTR, "exact"
    direction = RTL if strong[0] == RTL or (rtl and rtl > ltr) else LTR
    if not rtl:
        return direction, "exact"
    return direction, "ambiguous" if LTR in strong and rtl == ltr else "inferred"


def _protected(line: str, direction: int) -> list[str | None]:
    """L for characters of left-to-right words, EN for those of numbers, with the affixes that they touch."""
    out: list[str | None] = [None] * len(line)
    runs: list[tuple[int, int, str]] = []
    for m in re.finditer(rf"[^\s{ARABIC}{HEBREW}]+", line):
        inside = [i for i in range(m.start(), m.end()) if _ltr_content(line[i])]
        if not inside:
            continue
        a, b = inside[0], inside[-1] + 1
        while a > m.start() and line[a - 1] in AFFIXES:
            a -= 1
        while b < m.end() and line[b] in AFFIXES:
            b += 1
        kind = "L" if any(c.isalpha() for c in line[a:b]) else "EN"
        out[a:b] = [kind] * (b - a)
        runs.append((a, b, kind))
    if direction == RTL:
        for a, b, kind in runs:  # a colon set apart behind such a run, amid right-to-left text, stays with it
            before = next((c for c in reversed(line[:a]) if c.isalnum()), "")
            spot = next((i for i in range(b, len(line)) if not line[i].isspace()), None)
            if spot is None or spot == b or line[spot] != ":" or not (before and is_rtl(before)):
                continue
            after = next((c for c in line[spot + 1 :] if c.isalnum()), "")
            if after and is_rtl(after):
                out[b : spot + 1] = [kind] * (spot + 1 - b)
    return out


def logical_line(line: str, direction: int) -> str:
    """A visual line in logical order; the runs of left-to-right words and numbers keep theirs."""
    kept = _protected(line, direction)
    classes = [k or unicodedata.bidirectional(c) for k, c in zip(kept, line, strict=True)]
    return normalize_forms("".join(line[i] for i in visual_order(levels(classes, direction))))


def _reconstruct_line(line: str) -> str:
    if not is_rtl(line):
        return line
    direction, sure = base_direction(line)
    if sure == "ambiguous" and not has_compact_mixed(line):
        return reorder_for_output(line)
    if direction == RTL:
        return logical_line(line, direction)
    out = []
    for part in re.findall(r"\s+|\S+", line):  # left-to-right lines token by token
        first = _RTL.search(part)
        if first is None:
            out.append(part)
        elif any(map(_ltr_content, part[: first.start()])):
            out.append(normalize_forms(part[: first.start()]) + logical_line(part[first.start() :], RTL))
        else:
            out.append(logical_line(part, base_direction(part)[0]))
    return "".join(out)


def reconstruct(text: str) -> str:
    """Visual text in logical order with nominal letters, line by line."""
    return _per_line(text, _reconstruct_line)


def reconstruct_elements(texts: Sequence[str]) -> list[tuple[int, str]]:
    """Of a line's elements, in visual order: (element, text) in logical order."""
    line = "".join(texts)
    owner = [i for i, t in enumerate(texts) for _ in t]
    if not is_rtl(line):
        return list(enumerate(texts))
    direction = base_direction(line)[0]
    kept = _protected(line, direction)
    classes = [k or unicodedata.bidirectional(c) for k, c in zip(kept, line, strict=True)]
    order = visual_order(levels(classes, direction))
    return [(k, normalize_forms("".join(line[i] for i in run))) for k, run in ((k, list(g)) for k, g in groupby(order, key=lambda i: owner[i]))]


def word_class(text: str) -> str:
    return "rtl" if is_rtl(text) else "ltr" if any(c.isalpha() for c in text) else "neutral"


def reorder_words(words: Sequence[str]) -> list[int]:
    """Places of a line's words in reading order: runs of one class from the right, words of right-to-left runs too."""
    if not any(map(is_rtl, words)):
        return list(range(len(words)))
    runs = [(k, list(g)) for k, g in groupby(range(len(words)), key=lambda i: word_class(words[i]))]
    return [i for k, g in reversed(runs) for i in (reversed(g) if k == "rtl" else g)]


# As columns


def contains_rtl(text: Column) -> Column:
    return text.rlike(f"[{_java(ARABIC)}{_java(HEBREW)}]")


def _java(ranges: str) -> str:
    return "".join(c if c == "-" else f"\\x{{{ord(c):x}}}" for c in ranges)


def _column(work: Callable[[str], str]) -> Callable[[Column], Column]:
    def apply(text: Column) -> Column:
        @F.pandas_udf("string")
        def run(v: pd.Series) -> pd.Series:
            return v.map(lambda t: None if t is None else work(t))

        # others are not sent: a null goes in their place
        return F.when(contains_rtl(text), run(F.when(contains_rtl(text), text))).otherwise(text)

    return apply


reordered = _column(reorder)
reordered_for_output = _column(reorder_for_output)
reconstructed = _column(reconstruct)
without_forms = _column(normalize_forms)


def word_order(words: Column) -> Column:
    """``reorder_words`` of arrays of words."""

    @F.pandas_udf("array<int>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda w: None if w is None else reorder_words([x or "" for x in w]))

    return run(words)
