"""Quality rules on repetition, by suffix arrays.

Every text gets a suffix array of its words by prefix doubling, all texts of a step at once: the ranks of word pairs,
fours, eights ... order the suffixes, only suffixes with equal ranks are sorted again, and the stored ranks give the
longest common prefix of neighbours. The longest interval of common prefixes around a suffix is the longest repeated
substring that starts there; repeats of ``least_words`` and more are maximal repeated substrings, whose spans are
united. A text is rejected if they cover more than ``most_covered`` of its words or if one is longer than
``most_longest`` words, besides the base rules.

Defined cases: a null or empty text has no words and fails the base rules; very long texts are one step each; rows that
repeat a doc_id are judged one by one; a null doc_id stays null; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Words, cover, utf8

#: Gopher's rules bound repeats of eight words at a share of 0.12 (there of characters). A share of 0.5 or more would decide nothing: covered
#: words are in repeated 3-word windows, too, and the base rules leave at most half of those.
LEAST_WORDS, MOST_COVERED, MOST_LONGEST = 8, 0.12, 200
STEP_BYTES = 1 << 20
ROWS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("n_covered", pa.int64()), ("longest_repeat", pa.int64()), ("kept", pa.bool_())])
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_covered long, longest_repeat long, kept boolean"
_SPACE, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL[list(b"#*$%&|<>")] = True


def suffix_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a sequence and the common prefix lengths of neighbours (one fewer). Equal keys must lie in
    one text, and no text's suffix may run into the next: keys of different texts differ."""
    n = len(keys)
    by = np.argsort(keys, kind="stable")
    new = np.r_[True, keys[by][1:] != keys[by][:-1]] if n else np.zeros(0, bool)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[by] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank], 1
    active = by[~(new & np.r_[new[1:], True])] if n else by
    while len(active):
        after = rank[np.minimum(active + step, n)]
        by = np.lexsort((after, rank[active]))
        active, after = active[by], after[by]
        group = rank[active]
        place = np.arange(len(active))
        head = np.r_[True, group[1:] != group[:-1]]
        split = head | np.r_[True, after[1:] != after[:-1]]
        start = np.maximum.accumulate(np.where(head, place, 0))
        fresh = group + np.maximum.accumulate(np.where(split, place, 0)) - start
        rank = rank.copy()
        rank[active] = fresh
        levels.append(rank)
        active = active[~(split & np.r_[split[1:], True])]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank[:n]] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(0, n - 1), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (levels[k][a] == levels[k][b]) & (a < n) & (b < n)
        common[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
        np.minimum(a, n, out=a)
        np.minimum(b, n, out=b)
    return order, common


def longest_repeats(keys: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring that starts there and elsewhere."""
    order, common = suffix_order(keys)
    most = np.zeros(len(keys), np.int64)
    most[order] = np.maximum(np.r_[0, common], np.r_[common, 0])[: len(keys)]
    return most


def _per_doc(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags)][edges])


def _dup_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _measure(ids: list, texts: list, least_words: int, most_covered: float, most_longest: int) -> pa.RecordBatch:
    raw = [utf8(t) for t in texts]
    edges = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    chars = _per_doc(((data & 0xC0) != 0x80) & ~_SPACE[data], edges)
    symbols = _per_doc(_SYMBOL[data], edges)
    words = Words(texts)
    n, at, doc = words.n, words.at, words.doc
    repeated, most = np.zeros(len(doc), bool), np.zeros(len(doc), np.int64)
    if len(doc):
        most = longest_repeats(doc * len(words.distinct) + words.ids)
        repeated = words.repeats(3)
    long = np.flatnonzero(most >= least_words)
    covered = _per_doc(cover(len(doc), long, long + most[long]), at)
    longest = np.zeros(len(n), np.int64)
    np.maximum.at(longest, doc, most)
    failed = (n < 50) | (100 * _per_doc(repeated, at) > 50 * n)
    kept = ~failed & (covered <= most_covered * n) & (longest <= most_longest)
    columns = (n, chars, symbols, [_dup_lines(t) for t in texts], _per_doc(repeated, at), failed, covered, longest, kept)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, *columns), ROWS)], schema=ROWS)


def judge(docs: DataFrame, least_words: int = LEAST_WORDS, most_covered: float = MOST_COVERED, most_longest: int = MOST_LONGEST) -> DataFrame:
    """Per row: the base counts, base_failed, n_covered (words in maximal repeats), longest_repeat and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            begin = held = 0
            for k, t in enumerate(texts):
                held += len(t or "")
                if held > STEP_BYTES or k == len(texts) - 1:
                    yield _measure(ids[begin : k + 1], texts[begin : k + 1], least_words, most_covered, most_longest)
                    begin, held = k + 1, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DDL)
