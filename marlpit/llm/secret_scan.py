"""Secret scans: fixed patterns, and windows of high Shannon entropy over candidate strings.

A candidate is a run of 20 or more characters of the widest alphabet in which keys are written. A window of 20
characters slides over it; counts of the characters in it change by one in and one out, so each step costs the same.
A candidate may hold more than a key, as in SIGNING_KEY=..., so its parts between separators are judged by themselves:
a part is a key as a whole if a window of it passes by the smallest character class that holds the window or the part.
Windows with separators are judged among what is left, and spans are widened to whole parts, or to the whole key where
it may hold separators. Parts, runs and candidates on the allow-list are left alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marlpit.llm.common import map_arrow, text_or_empty

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(?P<key>(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs of 20: shorter runs hold no longer one
HEX = re.compile(r"[0-9a-f]{24,}")
KEY_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Character classes from the smallest, and the entropy in bits per character from which a window of 20 passes.
#: Random strings of 20 reach about 3.4 (hex), 3.9 (letters and digits in one case), 4.1 (62 letters and digits) and
#: 4.1 (64 characters); words and numbers stay below. Letters of one case are words, digits are numbers: they never pass.
CLASSES = (
    ("digits", re.compile(r"[0-9]+"), math.inf),
    ("word", re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), math.inf),
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 3.0),
    ("letters", re.compile(r"[A-Za-z]+"), 3.95),
    ("lower_alnum", re.compile(r"[0-9a-z]+|[0-9A-Z]+"), 3.6),
    ("alnum", re.compile(r"[0-9A-Za-z]+"), 3.75),
    ("base64", re.compile(r"[0-9A-Za-z+/_=-]+"), 3.75),
)
LEAST = min(least for *_, least in CLASSES)
SEPARATORS, JOINTS = "+/_=-", "+/_-"  # what is joined by = is never one key
SEPARATOR, EQUALS = re.compile(r"[+/_=-]"), re.compile("=")
PART = re.compile(r"[0-9A-Za-z]{20,}")
RUN = re.compile(r"[0-9A-Za-z+/_-]+=*|=+")  # = at the end pads a key
#: Hex, base32 and keys of one case have no separators inside; keys of 64 characters may go on beyond one.
ONE_CASE = re.compile(r"[0-9a-z]+|[0-9A-Z]+")
#: Words and numbers beside a key, as in paths, aren't parts of it; + joins no words.
PLAIN = re.compile(r"[A-Z]?[a-z]{4,}|[A-Z]{4,}|[0-9]{4,}")
UUID = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])")
#: Candidates, and parts and runs of them, that are public by their form: UUIDs, numbers, long repeats, samples. So are
#: paths and hyphenated words without digits.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[0-9+/_=-]+"),
    re.compile(r"(.{1,4})\1{4,}.{0,3}"),
)
SAMPLE = re.compile(r"EXAMPLE|example|XXXX|xxxx|0123456789|abcdefghij|ABCDEFGHIJ")
DIGIT = re.compile(r"[0-9]")
#: c * log2(c) in units of 2**-40, so that sums are whole numbers and don't depend on their order.
UNIT = 2.0**40
WEIGHTS = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(WINDOW + 1)]
STEPS = [b - a for a, b in zip(WEIGHTS, WEIGHTS[1:], strict=False)]


def base_spans(text: str, candidates: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    folded = text.lower()
    if any(word in folded for word in KEY_WORDS):
        for found in ASSIGN.finditer(text):
            if found.end("value") - found.start("value") >= ASSIGN_LEAST:
                yield "assign", found.start(), found.end()
    if "AKIA" in text:
        for found in ACCESS.finditer(text):
            yield "access", found.start(), found.end()
    for start, end in candidates:  # a run of 24 hex digits lies within one candidate
        for found in HEX.finditer(text, start, end):
            yield "hex", found.start(), found.end()


def window_entropies(text: str) -> np.ndarray:
    """Shannon entropy in bits of each window of an ASCII string, by incremental counts: one in and one out a step."""
    codes, counts, weight = text.encode("ascii"), [0] * 128, 0
    for code in codes[: WINDOW - 1]:
        weight += STEPS[counts[code]]
        counts[code] += 1
    found = []
    for new, old in zip(codes[WINDOW - 1 :], codes, strict=False):
        count = counts[new]
        weight += STEPS[count]
        counts[new] = count + 1
        found.append(weight)
        count = counts[old] - 1
        weight -= STEPS[count]
        counts[old] = count
    return math.log2(WINDOW) - np.array(found, np.float64) / (UNIT * WINDOW)


def least_bits(string: str) -> float:
    return next(least for _, form, least in CLASSES if form.fullmatch(string))


def window_least(text: str) -> np.ndarray:
    """least_bits of each window of a string of letters and digits, from running counts of kinds of characters."""
    codes = np.frombuffer(text.encode("ascii"), np.uint8)

    def number(kind: np.ndarray, width: int = WINDOW) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind)])
        return total[width:] - total[:-width]

    digit, lower = codes < 58, codes >= 97
    upper, beyond = ~digit & ~lower, (codes & 31) > 6  # of the alphabet, beyond F
    digits, lowers, uppers = number(digit), number(lower), number(upper)
    one_case = (lowers == 0) | (uppers == 0)
    word = (digits == 0) & ((lowers == 0) | (number(upper, WINDOW - 1)[1:] == 0))
    tests = {
        "digits": digits == WINDOW,
        "word": word,
        "hex": one_case & (number(beyond & ~digit) == 0),
        "letters": digits == 0,
        "lower_alnum": one_case,
    }
    bits = {name: least for name, _, least in CLASSES}
    return np.select(list(tests.values()), [bits[name] for name in tests], bits["alnum"])


def allowed(string: str) -> bool:
    wordy = not DIGIT.search(string) and SEPARATOR.search(string)
    return bool(wordy or SAMPLE.search(string) or any(form.fullmatch(string) for form in ALLOWED))


def key_part(string: str) -> bool:
    """True if a window of a string without separators passes by the class of the window or of the string."""
    own = least_bits(string)
    if own == math.inf or allowed(string):
        return False
    bits = window_entropies(string)
    return bool((bits >= own).any() or (bits >= LEAST).any() and (bits >= window_least(string)).any())


def mixed_windows(text: str, start: int, end: int, separator: re.Pattern[str], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Joined windows from start to end that hold a separator, pass, and touch nothing taken. taken is in order."""
    if end - start < WINDOW or allowed(text[start:end]):
        return
    marks = [found.start() for found in separator.finditer(text, start, end)]
    if not marks:
        return
    least, mark, reach = least_bits(text[start:end]), 0, None
    other = bisect_right(taken, start, key=lambda x: x[1])
    bits = window_entropies(text[start:end])
    for at in (start + np.flatnonzero(bits >= least)).tolist():
        while mark < len(marks) and marks[mark] < at:
            mark += 1
        while other < len(taken) and taken[other][1] <= at:
            other += 1
        if mark == len(marks) or marks[mark] >= at + WINDOW or other < len(taken) and taken[other][0] < at + WINDOW:
            continue
        if reach and at <= reach[1]:
            reach = (reach[0], at + WINDOW)
        else:
            if reach:
                yield reach
            reach = (at, at + WINDOW)
    if reach:
        yield reach


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def widened(text: str, low: int, high: int, start: int, end: int, across: bool) -> tuple[int, int]:
    """A span within low and high with the whole parts at its ends; across: and the parts beyond a separator, up to a plain one."""
    while start > low and text[start - 1] not in SEPARATORS:
        start -= 1
    while end < high and text[end - 1] not in SEPARATORS and text[end] not in SEPARATORS:
        end += 1
    if not across:
        return start, end
    while start > low and text[start - 1] in JOINTS:
        at = start - 1
        while at > low and text[at - 1] not in SEPARATORS:
            at -= 1
        if text[start - 1] != "+" and PLAIN.fullmatch(text, at, start - 1):
            break
        start = at
    while end < high and text[end] in JOINTS:
        at = end + 1
        while at < high and text[at] not in SEPARATORS:
            at += 1
        if text[end] != "+" and PLAIN.fullmatch(text, end + 1, at):
            break
        end = at
    while end < high and text[end] == "=":
        end += 1
    return start, end


def entropy_spans(text: str, candidates: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """Spans of parts without separators first, then of runs without =, then of the rest of a candidate."""
    for low, high in candidates:
        public = [found.span() for found in UUID.finditer(text, low, high)]
        spans, taken = [], list(public)
        for found in PART.finditer(text, low, high):
            if key_part(found.group()):
                taken.append(found.span())
                spans.append((*found.span(), not ONE_CASE.fullmatch(found.group())))
        runs = [found.span() for found in RUN.finditer(text, low, high)]
        taken = merged(taken)
        spans += [(*x, True) for start, end in runs for x in mixed_windows(text, start, end, SEPARATOR, taken)]
        known: list[tuple[int, int]] = []
        wide = False
        for start, end, across in sorted(spans):
            if known and end <= known[-1][1] and (wide or not across):
                continue  # it lies in one that was widened as far
            first, last = runs[bisect(runs, start, key=lambda x: x[0]) - 1]
            known.append(widened(text, first, last, start, end, across))
            wide = across
        rest = mixed_windows(text, low, high, EQUALS, merged(known + public)) if len(runs) > 1 else ()
        known += [widened(text, low, high, *x, False) for x in rest]
        for span in merged(known):
            yield "entropy", *span


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start, then kind. An entropy span within one base span adds nothing and goes."""
    candidates = [found.span() for found in CANDIDATE.finditer(text)]
    order = lambda x: (x[1], KINDS.index(x[0]))
    spans = sorted(base_spans(text, candidates), key=order)
    starts, ends = [x[1] for x in spans], list(accumulate((x[2] for x in spans), max))  # how far spans reach so far
    covered = lambda start, end: (k := bisect_right(starts, start)) > 0 and ends[k - 1] >= end
    return sorted(spans + [x for x in entropy_spans(text, candidates) if not covered(x[1], x[2])], key=order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, or union of spans that overlap, replaced by a mark."""
    out, at = [], 0
    for _, start, end in secret_spans(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy): spans of secrets in every whole text.

    Positions are code points, ends exclusive. A null or empty text has no span: counts of 0, an empty string and its
    hash. Null ids stay null; repeated rows give repeated rows; other columns are ignored, whatever their names. An
    empty table gives an empty result. Each text is scanned by itself, so no row depends on another.
    """

    def scan(batch: pa.RecordBatch) -> dict:
        found = [secret_spans(text) for text in batch.column("text").to_pylist()]
        base = [joined([x for x in spans if x[0] != "entropy"]) for spans in found]
        number = {kind: pa.array([sum(x[0] == kind for x in spans) for spans in found], pa.int64()) for kind in KINDS}
        return {
            "id": batch.column("id"),
            "n_assign": number["assign"],
            "n_access": number["access"],
            "n_hex": number["hex"],
            "base_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()),
            "spans": pa.array([joined(spans) for spans in found], pa.string()),
            "n_entropy": number["entropy"],
        }

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
    return map_arrow(own, scan, schema).withColumnRenamed("id", id_col)


@F.arrow_udf(StringType())
def redact(texts: pa.Array) -> pa.Array:
    """Column function: texts with their secrets replaced by a mark; null stays null."""
    return pa.array((None if (text := x.as_py()) is None else redacted(text) for x in texts), pa.string())
