"""Quality rules as a short-circuit cascade.

Every rule is timed on a sample, and its rejections counted there; the cascade
then asks the rules in the order of rejections per second and stops at the first
that rejects. The order decides what a document costs, never what becomes of it:
the verdict is that of all rules together, on every whole text.

Words are runs of anything but ASCII white space. Cases: a null or empty text has
no words and fails ``few_words``; each row is judged by itself, so repeated rows
get the same verdict; an empty table gives no row; other columns are not read.
"""

import time
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velario.llm.shared import column_bytes, ready, rows_of, small, texts

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
SAMPLE_ROWS = 1_000          # rows to time the rules on; it decides their order only


class Page:
    """One text; what several rules need is found once, and only when asked for."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self):
        return self.text.split()

    @cached_property
    def n_words(self):
        return len(self.words)

    @cached_property
    def word_chars(self):
        """Code points in words: bytes that do not continue a character."""
        return len(b"".join(self.words).decode())

    @cached_property
    def n_symbols(self):
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def n_lines(self):
        return sum(1 for line in self.text.split(b"\n") if line.strip())

    @cached_property
    def n_dup_lines(self):
        lines = [line for line in self.text.split(b"\n") if line.strip()]
        return len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self):
        """Words inside windows of eight that the text holds twice or more.

        Windows of 2, 4 and 8 words get a number each by the pair of numbers of
        their halves, so equal numbers mean equal words.
        """
        words = self.words
        n = len(words)
        if n <= WINDOW:
            return 0
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        if len(number) == n:
            return 0
        names = np.fromiter(map(number.__getitem__, words), np.int64, n)
        width = 1
        while width < WINDOW:
            pairs = names[:-width] * (n + 1) + names[width:]
            _, names = np.unique(pairs, return_inverse=True)
            width *= 2
        often = np.bincount(names)[names] > 1
        if not often.any():
            return 0
        edges = np.zeros(n + 1, np.int64)
        starts = np.flatnonzero(often)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + WINDOW, -1)
        return int((np.cumsum(edges[:-1]) > 0).sum())

    @cached_property
    def top_word_share(self):
        """Share of the most frequent word among words."""
        counts = {}
        for w in self.words:
            counts[w] = counts.get(w, 0) + 1
        return max(counts.values(), default=0) / max(self.n_words, 1)

    @cached_property
    def shouting(self):
        """Share of words of two letters or more that are upper case throughout."""
        return sum(1 for w in self.words if len(w) > 1 and w.isupper()) / max(self.n_words, 1)


@dataclass(frozen=True)
class Rule:
    """``rejects(page)``; ``base`` rules are fixed, the others a matter of taste."""

    name: str
    rejects: object
    base: bool = False


RULES = (
    Rule("few_words", lambda p: p.n_words < 20, base=True),
    Rule("repeats", lambda p: 100 * p.n_repeat_words > 30 * p.n_words, base=True),
    Rule("symbols", lambda p: 10 * p.n_symbols > 3 * p.n_words),
    Rule("word_length", lambda p: not 2 * p.n_words <= p.word_chars <= 15 * p.n_words),
    Rule("dup_lines", lambda p: 10 * p.n_dup_lines > 5 * p.n_lines),
    Rule("one_word", lambda p: p.n_words >= 20 and p.top_word_share > 0.3),
    Rule("shouting", lambda p: p.shouting > 0.5),
)


def measure(docs: DataFrame, rules=RULES, sample_rows=SAMPLE_ROWS) -> list:
    """``(name, seconds, examined, rejected)`` of each rule over a sample."""
    ready(docs.sparkSession)
    source = texts(docs)
    rows = source.count()
    names = [r.name for r in rules]
    some = source.where(F.rand(17) < sample_rows / max(rows, 1)) if rows > sample_rows else source

    def run(batches):
        spent, hits, seen = [0.0] * len(rules), [0] * len(rules), 0
        for batch in small(batches):
            for text in column_bytes(batch, "text"):
                seen += 1
                for i, rule in enumerate(rules):
                    page = Page(text)        # anew: each rule pays for all it needs
                    began = time.perf_counter()
                    hits[i] += bool(rule.rejects(page))
                    spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(spent), pa.array([seen] * len(rules)),
                                          pa.array(hits)], names=["name", "seconds", "examined", "rejected"])

    found = some.mapInArrow(run, "name string, seconds double, examined bigint, rejected bigint")
    total = found.groupBy("name").agg(F.sum("seconds"), F.sum("examined"), F.sum("rejected"))
    return [tuple(r) for r in total.collect()]          # one row per rule


def order(rules, measured) -> list:
    """Rules by rejection per cost, most first; cheap ones first among those that reject nothing."""
    known = {name: (seconds / max(examined, 1), rejected / max(examined, 1))
             for name, seconds, examined, rejected in measured}

    def worth(rule):
        cost, share = known.get(rule.name, (1.0, 0.0))
        return -share / max(cost, 1e-9), cost, rule.name

    return sorted(rules, key=worth)


def first_rejection(page: Page, ordered):
    """The name of the first rule that rejects, or None; later rules are not asked."""
    return next((r.name for r in ordered if r.rejects(page)), None)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, rules=RULES, counts=False, ordered=None) -> DataFrame:
    """``(doc_id, kept, rejected_by)`` of each row, in its order of columns; with
    ``counts`` also the base counts, which then are found for all documents."""
    return _judge(texts(docs), ["doc_id"], rules, counts, ordered or order(rules, measure(docs, rules)))


def _judge(source, carried, rules, counts, ordered):
    ready(source.sparkSession)
    extra = [*_COUNTS, "base_failed"] if counts else []

    def run(batches):
        base = [r for r in rules if r.base]
        for batch in small(batches):
            out = {n: [] for n in [*extra, "kept", "rejected_by"]}
            for text in column_bytes(batch, "text"):
                page = Page(text)
                by = first_rejection(page, ordered)
                out["kept"].append(by is None)
                out["rejected_by"].append(by)
                for name in extra:
                    out[name].append(any(r.rejects(page) for r in base) if name == "base_failed"
                                     else getattr(page, name))
            kinds = {"kept": pa.bool_(), "base_failed": pa.bool_(), "rejected_by": pa.string()}
            keep = [batch.column(batch.schema.get_field_index(c)) for c in carried]
            yield pa.RecordBatch.from_arrays(keep + [pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()],
                                             names=carried + list(out))

    types = {"kept": "boolean", "base_failed": "boolean", "rejected_by": "string"}
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in carried]
    return source.mapInArrow(run, ", ".join(fields + [f"{n} {types.get(n, 'bigint')}"
                                                      for n in [*extra, "kept", "rejected_by"]]))


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that no rule rejects, with their columns: the cascade sees each
    row once and carries it on, so no join is needed."""
    ordered = order(rules, measure(docs, rules))
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    place = columns.index("text")
    source = plain.withColumn("text", F.coalesce(F.col(f"c{place}").cast("string"), F.lit("")))
    judged = _judge(source, plain.columns, rules, False, ordered)
    return judged.where("kept").select(*[F.col(c).alias(n) for c, n in zip(plain.columns, columns)])
