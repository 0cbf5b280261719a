"""Language identification by error-correcting output codes.

Each language gets a codeword of bits. For each bit a linear classifier over
hashed byte n-grams tells the languages with a one from those with a zero; a text
is given to the language whose codeword is nearest to the bits it was predicted,
each bit weighing as much as it proved right, and each miss costing a logistic
loss of its margin. Where the two nearest codewords are about as near, the answer
is flagged as ambiguous.

Training is one pass over all labelled texts (sums of n-gram shares by language,
made in the tasks) and one over a bounded sample that places each bit's threshold.
What reaches the driver has one row per language and n-gram slot, of which there
are ``SLOTS``.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is all
when nothing is labelled. One language alone always wins with score 1. Repeated
rows are as many examples; an empty table gives no row; other columns than those
named in the call are not read; a text of any length is read whole.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velario.llm.shared import ready, small

SLOTS = 1 << 13
CALIBRATION_ROWS = 5_000      # bound of the sample that places thresholds and weighs bits
UNKNOWN = "und"
_AMBIGUOUS = 0.1              # share of the weights by which the second codeword must be farther

# ASCII letters and the bytes of other characters stay, all else is one gap
_KEEP = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def slots(text: str) -> np.ndarray:
    """Counts of the byte trigrams of a lower-cased text (a gap counts as one byte), by slot."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_KEEP) + b" ", np.uint8).astype(np.uint32)
    two = data[:-1] * np.uint32(257) + data[1:]
    three = two[:-1] * np.uint32(65_599) + data[2:]
    wordy = (data[:-2] != 32) | (data[1:-1] != 32)
    mixed = (three[wordy] * np.uint32(2_654_435_761)) >> np.uint32(19)
    return np.bincount(mixed, minlength=SLOTS)


def has_letter(text) -> bool:
    """Letters are Unicode's; digits, fractions and Roman numerals are numbers."""
    return text is not None and any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 per language. Up to six languages get all ways to split
    them in two; more get random codewords, of many tries the farthest apart."""
    if n < 2:
        return np.ones((n, 0), np.int64)
    if n <= 6:
        splits = np.arange(1, 1 << (n - 1))
        code = np.array([[(s >> i) & 1 for s in splits] for i in range(n - 1)] + [[0] * len(splits)])
        return 2 * code - 1
    rng, best, code = np.random.default_rng(n), -1, None
    length = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        tried = rng.choice([-1, 1], (n, length))
        if (np.abs(tried.sum(0)) == n).any():
            continue
        apart = min(int((tried[i] != tried[j]).sum()) for i in range(n) for j in range(i))
        if apart > best:
            best, code = apart, tried
    return code


@dataclass
class Model:
    """Languages, their codewords, and per bit a weight vector, threshold, scale and say."""

    languages: list
    code: np.ndarray
    weights: np.ndarray
    middle: np.ndarray
    scale: np.ndarray
    say: np.ndarray

    def margins(self, counts: np.ndarray) -> np.ndarray:
        share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        return (share @ self.weights - self.middle) * self.scale

    def distances(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each text's bits against each codeword."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        return (loss * self.say).sum(2)

    def predict(self, texts) -> list:
        """(language, score, ambiguous) of each text."""
        out = [(UNKNOWN, 0.0, False)] * len(texts)
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for at in range(0, len(known), 512):
            some = known[at:at + 512]
            far = self.distances(self.margins(np.stack([slots(texts[i]) for i in some])))
            near = np.exp(far.min(1, keepdims=True) - far)
            order = np.argsort(far, axis=1, kind="stable")
            for row, i in enumerate(some):
                first = order[row, 0]
                close = (len(self.languages) > 1
                         and far[row, order[row, 1]] - far[row, first] < _AMBIGUOUS * self.say.sum())
                out[i] = (self.languages[first], float(near[row, first] / near[row].sum()), bool(close))
        return out


def train(examples: DataFrame, calibration_rows=CALIBRATION_ROWS) -> Model:
    """A model from ``examples(text, lang)``; rows without either are left out."""
    ready(examples.sparkSession)
    known = examples.where("text is not null and lang is not null").select("text", "lang")

    def sums(batches):
        total, n = {}, {}
        for batch in small(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if has_letter(text):
                    counts = slots(text)
                    total.setdefault(lang, np.zeros(SLOTS))
                    total[lang] += counts / max(counts.sum(), 1)
                    n[lang] = n.get(lang, 0) + 1
        for lang, shares in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * SLOTS), pa.array(np.arange(SLOTS, dtype=np.int32)), pa.array(shares),
                 pa.array(np.where(np.arange(SLOTS) == 0, n[lang], 0))], names=["lang", "slot", "share", "n"])

    table = (known.mapInArrow(sums, "lang string, slot int, share double, n bigint")
             .groupBy("lang", "slot").agg(F.sum("share").alias("share"), F.sum("n").alias("n")).toPandas())
    languages = sorted(table["lang"].unique().tolist())
    shares = np.zeros((len(languages), SLOTS))
    rows = np.zeros(len(languages))
    place = table["lang"].map({c: i for i, c in enumerate(languages)}).to_numpy(np.int64)
    shares[place, table["slot"].to_numpy()] = table["share"]
    np.add.at(rows, place, table["n"].to_numpy())
    shares /= np.maximum(rows, 1)[:, None]

    code = codewords(len(languages))
    weights = np.zeros((SLOTS, code.shape[1]))
    for bit in range(code.shape[1]):
        yes, no = shares[code[:, bit] > 0].mean(0), shares[code[:, bit] < 0].mean(0)
        weights[:, bit] = np.log((yes + 1e-5) / (no + 1e-5))
    bits = code.shape[1]
    model = Model(languages, code, weights, np.zeros(bits), np.ones(bits), np.ones(bits))
    return _calibrated(model, known, int(rows.sum()), calibration_rows) if bits else model


def _calibrated(model, known, rows, calibration_rows) -> Model:
    """Place each bit's threshold between its two sides, and weigh the bit by how
    often it is right, on a sample of at most about ``calibration_rows`` whole texts."""
    some = known.where(F.rand(5) < calibration_rows / rows) if rows > calibration_rows else known
    place = {c: i for i, c in enumerate(model.languages)}
    bits = model.code.shape[1]

    def margins(batches):
        for batch in small(batches):
            pairs = [(t, place[c]) for t, c in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist())
                     if has_letter(t) and c in place]
            if pairs:
                found = model.margins(np.stack([slots(t) for t, _ in pairs]))
                yield pa.RecordBatch.from_arrays([pa.array([c for _, c in pairs], pa.int32()),
                                                  pa.array(found.tolist(), pa.list_(pa.float64()))], names=["c", "m"])

    found = some.mapInArrow(margins, "c int, m array<double>").toPandas()
    if not len(found):
        return model
    m, truth = np.stack(found["m"].to_numpy()), model.code[found["c"].to_numpy()]
    for bit in range(bits):
        yes, no = m[truth[:, bit] > 0, bit], m[truth[:, bit] < 0, bit]
        if not len(yes) or not len(no):
            continue
        model.middle[bit] = (yes.mean() + no.mean()) / 2
        spread = np.sqrt((yes.var() + no.var()) / 2) + 1e-6
        gap = max(yes.mean() - no.mean(), 1e-6)
        # the slope of the logistic curve between two bell curves so far apart
        model.scale[bit] = min(gap / spread ** 2, 8 / gap)
        right = ((yes > model.middle[bit]).mean() + (no <= model.middle[bit]).mean()) / 2
        model.say[bit] = max(2 * right - 1, 1e-3)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)``, from the text alone."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)        # languages x slots numbers

    def run(batches):
        for batch in small(batches):
            found = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found]), pa.array([f[1] for f in found]),
                 pa.array([f[2] for f in found])], names=["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, ambiguous boolean")
