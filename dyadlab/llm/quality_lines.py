"""Quality rules, line first: failing lines are removed, then documents that lose too much text are rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
REPEAT_PERCENT = 50  # of the words, in three-word windows that occur twice or more
LOSS_PERCENT = 50  # of the word characters, in failing lines
SYMBOLS = "#*$%&|<>"
SENTENCE_MARKS = ".!?…:;"
CLOSERS = "\"'”’»)]"
SEPARATORS = "|»›•·"  # between the entries of a navigation line
MIN_SEPARATORS = 3
SHORT_LINE = 12  # words; a boilerplate phrase only counts in a line of at most so many
BOILERPLATE = [
    "all rights reserved", "alle rechte vorbehalten", "back to top", "click here", "cookie policy", "datenschutzerklärung",
    "enable javascript", "política de privacidad", "politique de confidentialité", "privacy policy", "sign up for our newsletter",
    "skip to content", "subscribe to our newsletter", "terms of service", "terms of use", "todos los derechos reservados",
    "tous droits réservés", "uses cookies",
]
RULES = ("boilerplate", "navigation", "punctuation", "repeated")  # in this order; a line is counted under the first that it fails

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = bytes.maketrans(_UPPER, _LOWER)
_BLANK = rb"[\x20\x09-\x0D]"


def _any(marks: str) -> bytes:
    return b"(?:" + b"|".join(re.escape(c.encode()) for c in marks) + b")"


_PHRASES = re.compile(b"|".join(re.escape(p.encode()) for p in BOILERPLATE))
_SEPARATOR = re.compile(_any(SEPARATORS))
_ENDS_SENTENCE = re.compile(_any(SENTENCE_MARKS) + _any(CLOSERS) + rb"*(?:" + _BLANK + rb"|\Z)")
_MARKED_WORD = re.compile(rb"[!?#$%&*]{2}(?:" + _BLANK + rb"|\Z)")


def failing_rule(line: bytes, n_words: int) -> str | None:
    """The first rule that a line with words fails, repetition aside.

    Boilerplate: a short line with one of BOILERPLATE (A-Z lower-cased). Navigation: MIN_SEPARATORS separators or more, and one
    for every four words at least. Punctuation: no word ends a sentence, or half of the words or more end in two marks.
    """
    if n_words <= SHORT_LINE and _PHRASES.search(line.translate(_TO_LOWER)):
        return "boilerplate"
    found = len(_SEPARATOR.findall(line))
    if found >= MIN_SEPARATORS and 4 * found >= n_words:
        return "navigation"
    if not _ENDS_SENTENCE.search(line) or 2 * len(_MARKED_WORD.findall(line)) >= n_words:
        return "punctuation"
    return None


def code_points(text: bytes) -> int:
    data = np.frombuffer(text, np.uint8)
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in three-word windows that occur at least twice, compared word by word (no hashes)."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, windows, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[windows] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= again
    return int(covered.sum())


def judge_text(text: bytes) -> dict:
    """All counts of one text, its verdict and what is left of it."""
    words = text.split()
    left, seen, failed, n_lines, lost = [], set(), dict.fromkeys(RULES, 0), 0, 0
    for line in text.split(b"\n"):
        mine = line.split()
        if not mine:
            left.append(line)
            continue
        n_lines += 1
        again = line in seen
        rule = failing_rule(line, len(mine)) or ("repeated" if again else None)
        seen.add(line)
        failed["repeated_at_all"] = failed.get("repeated_at_all", 0) + again
        if rule is None:
            left.append(line)
        else:
            failed[rule] += 1
            lost += code_points(b"".join(mine))
    chars, repeats = code_points(b"".join(words)), repeated_words(words)
    base_failed = len(words) < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * len(words)
    out = {
        "n_words": len(words), "word_chars": chars, "n_symbols": sum(text.count(c.encode()) for c in SYMBOLS), "n_dup_lines": failed.pop("repeated_at_all", 0),
        "n_repeat_words": repeats, "base_failed": base_failed, "kept": not base_failed and 100 * lost <= LOSS_PERCENT * chars, "n_lines": n_lines, "lost_chars": lost,
    }
    return out | {f"n_{rule}": n for rule, n in failed.items()} | {"cleaned": b"\n".join(left)}


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "lost_chars", *(f"n_{rule}" for rule in RULES)]


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One line per row of ``docs``: its id, counts, verdict (``base_failed``, ``kept``) and the text without its failing lines.

    Every row gets a line, repeated and null ids included (the id keeps its type). Null texts count as empty; an empty text has
    zero counts, fails (too few words) and is left empty. Lines are cut at \\n alone; lines without a word stay. A text of any
    length is judged as a whole, within one task, with memory in proportion to it. Other columns of ``docs`` are not read.
    An empty table gives no lines. One scan, no shuffle; ``with_text=False`` leaves the cleaned text out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [judge_text(t.as_py() or b"") for t in texts]
            arrays = [batch.column(0)]
            for name in COUNTS + MORE:
                arrays.append(pa.array([f[name] for f in found], pa.int64()))
            for name in ("base_failed", "kept"):
                arrays.append(pa.array([f[name] for f in found], pa.bool_()))
            if with_text:
                arrays.append(pa.array([f["cleaned"].decode() for f in found], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *COUNTS, *MORE, "base_failed", "kept", *(["cleaned"] if with_text else [])])

    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS + MORE) + ", base_failed boolean, kept boolean" + (", cleaned string" if with_text else "")
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def _quoted(items: list[str]) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l0 AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
l1 AS (SELECT r, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM l0),
l2 AS (
  SELECT r, line, len(ws) AS n, length(array_to_string(ws, '')) AS chars, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again,
    len(regexp_extract_all(line, '[{SEPARATORS}]')) AS seps,
    len(list_filter({_quoted(BOILERPLATE)}, lambda p: contains(low, p))) > 0 AS phrase,
    len(list_filter(ws, lambda x: regexp_matches(x, '[{SENTENCE_MARKS}][{CLOSERS.replace("'", "''").replace("]", chr(92) + "]")}]*$'))) > 0 AS ends,
    len(list_filter(ws, lambda x: regexp_matches(x, '[!?#$%&*][!?#$%&*]$'))) AS marked
  FROM l1 WHERE len(ws) > 0),
l3 AS (
  SELECT *, CASE WHEN n <= {SHORT_LINE} AND phrase THEN 'boilerplate' WHEN seps >= {MIN_SEPARATORS} AND 4 * seps >= n THEN 'navigation'
    WHEN NOT ends OR 2 * marked >= n THEN 'punctuation' WHEN again THEN 'repeated' END AS rule FROM l2),
ls AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines, sum(CASE WHEN rule IS NULL THEN 0 ELSE chars END) AS lost_chars,
    {", ".join(f"count(*) FILTER (rule = '{x}') AS n_{x}" for x in RULES)} FROM l3 GROUP BY r),
g AS (SELECT r, i, ws[i:i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
g2 AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS k FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g2) GROUP BY r),
s AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[{SYMBOLS}]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(k, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars, {", ".join(f"coalesce(n_{x}, 0) AS n_{x}" for x in RULES)}
  FROM w LEFT JOIN ls USING (r) LEFT JOIN rep USING (r)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND 100 * lost_chars <= {LOSS_PERCENT} * word_chars AS kept FROM v"""
