"""Maximal runs of periodic words, found by minimisers at several scales.

A run is a stretch of words with smallest period q (words q apart are the same), at
least ``exponent`` periods and ``least`` words long, that no neighbouring word extends.

Periods up to ``SHORT`` are found by direct lag scans: where do words q apart agree?
Longer ones are found scale by scale, each for periods above ``low`` up to ``high`` =
1.5 * ``low``. Every place is named by the next ``high`` words, exactly: two ranks of
blocks whose lengths are powers of two (prefix doubling). In each window of places the
least name, in a mixed order, is kept. Windows inside a run look alike a period later,
so a place kept in the first window is kept a period later too; and as a name is at
least as long as the period, it cannot come back any sooner (Fine and Wilf, 1965). So
each run has two kept places of one name, next to each other and a period apart, and
these seed it: the ranks extend it to both sides by binary steps. Nothing is hashed,
so no verification is needed and nothing is missed.

Work is near-linear in the words of a text. Texts are treated some at a time, each
ended by a number of its own, the longest first, so that what only long texts need is
done for a part of the array. Nothing is shuffled.

Cases: a null, empty or blank text has no words and no runs; repeated rows, and rows
without ``doc_id``, are documents of their own; a text of any length is treated whole,
with memory of some 100 bytes a word; an empty table gives no row; other columns are
not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from velario.llm.shared import column_bytes, ready, small, texts
from velario.llm.superkmers import _sliding

SHORT = 16                   # longest period that is looked for directly
LEAST = 24                   # words of the shortest run
EXPONENT = 3                 # periods of the shortest run
TOGETHER = 200_000           # words of the texts treated at once; a longer text is treated alone
_ODD = np.uint64(0x9E3779B97F4A7C15)          # fixed value: 2**64 over the golden ratio


class _Numbers(dict):
    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def numbered(texts_words) -> np.ndarray:
    """Words as numbers, one text after the other, each ended by a number of its own."""
    numbers, parts = _Numbers(), []
    for words in texts_words:
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
    ends = iter(range(len(numbers), len(numbers) + len(parts)))
    return np.concatenate([p for part in parts for p in (part, np.array([next(ends)]))])


def rank_levels(x: np.ndarray, lengths: np.ndarray) -> list:
    """Ranks of the blocks of 1, 2, 4 ... words that start at each place.

    ``lengths`` are those of the texts, falling. A level stops behind the last text
    that is long enough for its blocks.
    """
    levels, size = [np.unique(x, return_inverse=True)[1].astype(np.int64)], 1
    while 2 * size <= lengths[0]:
        reach = int((lengths[lengths >= 2 * size] + 1).sum())
        last = levels[-1]
        pairs = last[:reach - 2 * size + 1] * (last.max() + 1) + last[size:reach - size + 1]
        levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        size *= 2
    return levels


def _agree(levels, a, b, forward):
    """How many words agree from places ``a`` and ``b`` on, or before them."""
    same = np.zeros(len(a), np.int64)
    for level in reversed(range(len(levels))):
        ranks, size = levels[level], 1 << level
        i, j = (a + same, b + same) if forward else (a - same - size, b - same - size)
        inside = (i >= 0) & (j < len(ranks))
        equal = np.zeros(len(a), bool)
        equal[inside] = ranks[i[inside]] == ranks[j[inside]]
        same += size * equal
    return same


def _by_lag(x, lengths, least, exponent):
    """(start, end, period) of stretches with short periods."""
    for q in range(1, SHORT + 1):
        needed = max(least, exponent * q)
        reach = int((lengths[lengths >= needed] + 1).sum())
        if reach <= q:
            break
        equal = np.zeros(reach - q + 2, np.int8)
        equal[1:-1] = x[q:reach] == x[:reach - q]
        edges = np.flatnonzero(np.diff(equal))
        start, end = edges[::2], edges[1::2] + q
        long_enough = end - start >= needed
        yield start[long_enough], end[long_enough], np.full(long_enough.sum(), q)


def kept_places(names: np.ndarray, window: int) -> np.ndarray:
    """The places whose name is the least, in a mixed order, of some window of places."""
    order = names.astype(np.uint64)
    order = (order ^ (order >> np.uint64(31))) * _ODD
    order = (order ^ (order >> np.uint64(29))) * _ODD
    if len(order) <= window:
        return np.flatnonzero(order == order.min()) if len(order) else np.empty(0, np.int64)
    edge = np.zeros(window - 1, np.uint64)
    low = _sliding(order, window, np.minimum)
    return np.flatnonzero(_sliding(np.concatenate((edge, low, edge)), window, np.maximum) == order)


def _by_minimisers(levels, lengths, least, exponent):
    """(start, end, period) of stretches with periods above ``SHORT``."""
    low = SHORT
    while True:
        reach = int((lengths[lengths >= exponent * (low + 1)] + 1).sum())
        if not reach:
            return
        high = low + low // 2
        level = high.bit_length() - 1
        ranks = levels[level]
        n = reach - high + 1
        names = ranks[:n] * (ranks.max() + 1) + ranks[high - (1 << level):high - (1 << level) + n]
        place = kept_places(names, 2 * (low + 1) - high + 1)
        place = place[np.argsort(names[place], kind="stable")]
        gap = np.diff(place)
        seeds = np.flatnonzero((np.diff(names[place]) == 0) & (gap > low) & (gap <= high))
        if len(seeds):
            a, q = place[seeds], gap[seeds]
            start = a - _agree(levels, a, a + q, False)
            end = a + q + _agree(levels, a, a + q, True)
            long_enough = end - start >= np.maximum(least, exponent * q)
            yield start[long_enough], end[long_enough], q[long_enough]
        low = high


def find(texts_words, least=LEAST, exponent=EXPONENT) -> list:
    """For each text (a list of words) its runs as (start, length, period) rows, by start, then period.

    ``exponent`` is 3 at least: seeds are sure to be found in runs of three periods.
    """
    if exponent < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    sizes = np.array([len(w) for w in texts_words], np.int64)
    out = [np.empty((0, 3), np.int64)] * len(sizes)
    turn = np.argsort(-sizes, kind="stable")
    turn = turn[sizes[turn] >= least]
    if not len(turn):
        return out
    lengths = sizes[turn]
    x = numbered([texts_words[i] for i in turn])
    found = [*_by_lag(x, lengths, least, exponent),
             *_by_minimisers(rank_levels(x, lengths), lengths, least, exponent)]
    start, end, period = (np.concatenate(part) for part in zip(*found))
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    # a stretch shows at multiples of its period too, with the same ends: the least is its own
    own = np.ones(len(start), bool)
    own[1:] = (np.diff(start) != 0) | (np.diff(end) != 0)
    start, end, period = start[own], end[own], period[own]
    by = np.lexsort((period, start))
    rows = np.stack([start, end - start, period], axis=1)[by]
    first = np.concatenate(([0], np.cumsum(lengths + 1)))
    cuts = np.searchsorted(rows[:, 0], first)
    for k, i in enumerate(turn):
        out[i] = rows[cuts[k]:cuts[k + 1]] - [first[k], 0, 0]
    return out


def collapsed(words: list, runs: np.ndarray) -> list:
    """The words that are left when every run keeps its first period alone."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(change[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def _together(texts_words):
    """(first, behind last) of texts that are treated at once."""
    first, size = 0, 0
    for i, words in enumerate(texts_words):
        if size and size + len(words) > TOGETHER:
            yield first, i
            first, size = i, 0
        size += len(words)
    if first < len(texts_words):
        yield first, len(texts_words)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _runs_array(runs) -> pa.Array:
    rows = np.concatenate(runs)
    fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)],
                                        fields=list(_RUNS.value_type))
    ends = np.cumsum([0, *map(len, runs)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields, type=_RUNS)


def periodic_runs(docs: DataFrame, least=LEAST, exponent=EXPONENT) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of each row.

    ``runs`` are structs of start, length and period in words, by start, then period;
    ``collapsed`` is the text, one space between words, in which each run keeps its
    first period alone.
    """
    ready(docs.sparkSession)

    def run(batches):
        for batch in small(batches):
            cut = [t.split() for t in column_bytes(batch, "text")]
            for a, b in _together(cut):
                runs = find(cut[a:b], least, exponent)
                left = [b" ".join(collapsed(w, r)) for w, r in zip(cut[a:b], runs)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array([len(w) for w in cut[a:b]], pa.int64()),
                     _runs_array(runs), pa.array(left, pa.binary())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    return texts(docs).mapInArrow(
        run, "doc_id bigint, n_words bigint, runs array<struct<start bigint, length bigint, period bigint>>, collapsed binary")
