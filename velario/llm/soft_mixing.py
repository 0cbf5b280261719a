"""Mixing documents to target weights of domains that are known only softly.

A classifier fitted on a labelled table gives each document posteriors over the
domains. A domain's expected tokens are the sum over all documents of tokens times
posterior times rate. Rates, none negative, are found whose expected totals meet the
targets: weighted least squares in the relative errors, and of all that solve it the
rates nearest to 1. Those are the projection onto the rates from 0 to ``most`` of one
gradient step from rate 1, with a step length for each domain: 1 - posteriors times
lengths, cut off at both ends. The lengths are found by Newton steps with line search on
the gradient at the rates they give; each is one distributed sum of a few numbers per
pair of domains, and the state that goes round is one number per domain. (The method's
wording, projected-gradient steps on the rates themselves, would carry a number for each
document from step to step and needs hundreds; the rates it ends in are these.)

Without ``most`` a target that only few documents can serve is met by taking those few a
thousand times and nothing else. With it, a target is lowered to half of what the domain
can give at most, for the same reason; the others share the rest.

Cases: a null or empty text has no token and no effect on totals, its posteriors
being the domains' shares of the labels; labels without a document, with nulls, or
several for one document, count as they are (nulls are left out); targets of
domains without labels are left out; without any label rates are 1; repeated rows
are documents of their own; an empty table gives no row.
"""

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velario.llm.shared import column_bytes, ready, saved, small
from velario.llm.word_encoder import encoder, with_ids

_LOG = logging.getLogger(__name__)

TRAINING_ROWS = 20_000        # bound of the labelled rows that the classifier is fitted on
STEPS = 200                   # bound of distributed sums; some ten are usual
TOLERANCE = 1e-3              # gradient at the returned rates, relative to a domain's target, at which steps end
_NEAR_ONE = 1e-6              # weight of the rates' squared distance from 1 beside the squared errors
MOST = 4.0                    # a document is taken at most this often
SIGNALS = 256                 # tokens the classifier looks at: half by their shares, half by their mere presence
_FITTING_STEPS = 300

# shares of all tokens to train on, by "q<quality>t<toxic>"
TARGETS = {"q1t0": 0.93, "q0t0": 0.03, "q1t1": 0.03, "q0t1": 0.01}


@dataclass
class Classifier:
    """Softmax regression on some telling tokens of a document: their shares, and
    whether they are there at all (one word makes a long text toxic).

    ``slot`` gives each token's place among them, or their number for all others.
    """

    domains: list
    shares: np.ndarray
    slot: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def features(self, ids: list) -> np.ndarray:
        """A row for each document, given their ids."""
        n, lengths = len(self.scale) // 2, [len(i) for i in ids]
        slots = np.repeat(np.arange(len(ids)) * (n + 1), lengths) + self.slot[np.concatenate(ids)]
        counts = np.bincount(slots, minlength=len(ids) * (n + 1)).reshape(-1, n + 1)[:, :n]
        shares = np.sqrt(counts / np.maximum(lengths, 1)[:, None])
        return np.concatenate((shares, counts > 0), axis=1) * self.scale

    def posteriors(self, ids: list) -> np.ndarray:
        if not ids or not self.domains:
            return np.zeros((len(ids), len(self.domains)))
        p = softmax(self.features(ids) @ self.weights + self.bias)
        p[[not len(i) for i in ids]] = self.shares
        return p


def softmax(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def label_domains(labels: DataFrame) -> DataFrame:
    """``(doc_id, domain)`` of a table with ``quality`` and ``toxic``."""
    return labels.where("quality is not null and toxic is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.concat(F.lit("q"), F.col("quality").cast("int"), F.lit("t"), F.col("toxic").cast("int")).alias("domain"))


def fit(docs: DataFrame, domains: DataFrame, tokenizer="word_bpe_49k.json", training_rows=TRAINING_ROWS) -> Classifier:
    """Fit on at most about ``training_rows`` labelled documents, whole texts.

    What is broadcast are those rows' ids. What returns to the driver are two
    numbers per domain and token of the vocabulary, and ``SIGNALS`` per labelled row.
    """
    ready(docs.sparkSession)
    rows = domains.count()
    some = domains.where("doc_id is not null and domain is not null")
    if rows > training_rows:
        some = some.where(F.rand(11) < training_rows / rows).limit(2 * training_rows)
    labelled = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                           F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")

    labelled = saved(_encoded(labelled, tokenizer), "labelled_ids")
    table = _token_shares(labelled, tokenizer).toPandas()          # domains x tokens of the vocabulary
    names = sorted(table["domain"].unique().tolist())
    size = encoder(tokenizer).size
    first, second, there = (np.zeros((len(names), size + 1)) for _ in range(3))
    place = table["domain"].map({d: i for i, d in enumerate(names)}).to_numpy(np.int64)
    token = table["token"].to_numpy(np.int64)                      # the last place: numbers of documents
    first[place, token], second[place, token], there[place, token] = table["share"], table["square"], table["there"]
    n = first[:, size]
    model = Classifier(names, n / max(n.sum(), 1), np.zeros(size, np.int32), np.ones(0), np.zeros((0, len(names))),
                       np.log((n + 1) / (n.sum() + len(names))))
    if len(names) < 2:
        return model
    by_share, by_presence = (np.argsort(-_contrast(a[:, :size], b[:, :size], n), kind="stable")
                             for a, b in ((first, second), (there, there)))
    telling = np.union1d(by_share[:SIGNALS // 2], by_presence[:SIGNALS // 2])
    model.slot = np.full(size, len(telling), np.int32)
    model.slot[telling] = np.arange(len(telling))
    model.scale = np.ones(2 * len(telling))
    return _regress(model, _feature_rows(labelled, model, tokenizer).toPandas())   # at most the bounded sample


def _encoded(labelled, tokenizer) -> DataFrame:
    """``(domain, ids)``: ids as bytes."""
    def run(batches):
        coder = encoder(tokenizer)
        for batch, ids in with_ids(batches, "text", coder):
            yield pa.RecordBatch.from_arrays([batch.column("domain"), pa.array(ids, pa.binary())], names=["domain", "ids"])

    return labelled.select("domain", "text").mapInArrow(run, "domain string, ids binary")


def _ids(batch, dtype) -> list:
    return [np.frombuffer(i, dtype) for i in column_bytes(batch, "ids")]


def _token_shares(labelled, tokenizer) -> DataFrame:
    """``(domain, token, share, square, there)``: sums of the square roots of tokens' shares,
    of the shares, and documents, by domain; in place of a token, its vocabulary's size
    counts all documents."""
    def run(batches):
        coder, sums = encoder(tokenizer), {}
        for batch in small(batches):
            for domain, ids in zip(batch.column("domain").to_pylist(), _ids(batch, coder.dtype)):
                one = sums.setdefault(domain, np.zeros((3, coder.size + 1)))
                token, n = np.unique(ids, return_counts=True)
                share = n / max(n.sum(), 1)
                one[0, token] += np.sqrt(share)
                one[1, token] += share
                one[2, token] += 1
                one[:, -1] += 1
        for domain, found in sums.items():
            some = np.flatnonzero(found[0])
            yield pa.RecordBatch.from_arrays([pa.array([domain] * len(some)), pa.array(some),
                                              *[pa.array(f[some]) for f in found]], names=["domain", "token", *numbers])

    numbers = ["share", "square", "there"]
    each = labelled.mapInArrow(run, "domain string, token bigint, " + ", ".join(f"{n} double" for n in numbers))
    return each.groupBy("domain", "token").agg(*[F.sum(n).alias(n) for n in numbers])


def _contrast(first, second, n) -> np.ndarray:
    """For each token, how many standard errors its mean in some domain is from the others'."""
    best = np.zeros(first.shape[1])
    everything = max(n.sum(), 1)
    # the spread of all documents: that of a domain with few would be zero for most tokens
    spread = np.maximum(second.sum(0) / everything - (first.sum(0) / everything) ** 2, 0) + 1e-9
    for i in range(len(n)):
        yes, no = max(n[i], 1), max(n.sum() - n[i], 1)
        apart = np.abs(first[i] / yes - (first.sum(0) - first[i]) / no)
        best = np.maximum(best, apart / np.sqrt(spread * (1 / yes + 1 / no)))
    return best


def _feature_rows(labelled, model, tokenizer) -> DataFrame:
    place = {d: i for i, d in enumerate(model.domains)}

    def run(batches):
        dtype = encoder(tokenizer).dtype
        for batch in small(batches):
            if batch.num_rows:
                rows = model.features(_ids(batch, dtype)).astype("<f4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place[d] for d in batch.column("domain").to_pylist()], pa.int32()),
                     pa.array([r.tobytes() for r in rows], pa.binary())], names=["d", "x"])

    return labelled.mapInArrow(run, "d int, x binary")


def _regress(model, rows) -> Classifier:
    """Softmax regression by accelerated gradient steps, with a little ridge."""
    x = np.frombuffer(b"".join(rows["x"]), "<f4").reshape(len(rows), -1).astype(np.float64)
    scale = 1 / (x.std(0) + 1e-3)
    x *= scale
    centre = x.mean(0)
    x -= centre
    truth = np.eye(len(model.domains))[rows["d"].to_numpy()]
    step = 2 / (np.linalg.norm(x.T @ x / len(x), 2) + 1)
    w = v = np.zeros((x.shape[1], truth.shape[1]))
    b = c = np.log(truth.mean(0) + 1e-6)
    for k in range(_FITTING_STEPS):
        error = softmax(x @ v + c) - truth
        w_next, b_next = v - step * (x.T @ error / len(x) + 1e-4 * v), c - step * error.mean(0)
        pace = k / (k + 3)
        v, c = w_next + pace * (w_next - w), b_next + pace * (b_next - b)
        w, b = w_next, b_next
    model.scale, model.weights, model.bias = scale, w, b - centre @ w
    return model


def memberships(docs: DataFrame, model: Classifier, tokenizer="word_bpe_49k.json") -> DataFrame:
    """``docs`` under the names c0, c1 ... with ``__tokens`` and ``__p0 ...``; see ``mix``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)       # vocabulary x domains numbers
    columns = [c for c in docs.columns if c != "__text"]

    def run(batches):
        coder, model = encoder(tokenizer), shared.value
        for batch, found in with_ids(batches, "__text", coder):
            ids = [np.frombuffer(i, coder.dtype) for i in found]
            p = model.posteriors(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in columns]
                + [pa.array([len(i) for i in ids], pa.int64())]
                + [pa.array(np.ascontiguousarray(p[:, d])) for d in range(p.shape[1])],
                names=columns + ["__tokens"] + [f"__p{d}" for d in range(p.shape[1])])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "__text"]
    more = ["`__tokens` bigint"] + [f"`__p{d}` double" for d in range(len(model.domains))]
    return docs.mapInArrow(run, ", ".join(fields + more))


def replay(p: np.ndarray, steps, most=np.inf) -> tuple:
    """Rates of documents with posteriors ``p`` after ``steps`` of (errors, momentum),
    and the point at which the next gradient is taken."""
    rate = ahead = np.ones(len(p))
    for error, momentum in steps:
        before, rate = rate, np.clip(ahead - p @ np.asarray(error), 0.0, most)
        ahead = rate + momentum * (rate - before)
    return rate, ahead


def _columns(batch, domains):
    return np.stack([batch.column(f"__p{d}").to_numpy() for d in range(domains)], axis=1)


def attainable(wanted: np.ndarray, present: np.ndarray, most: float) -> np.ndarray:
    """Targets, none above half of what taking all of a domain ``most`` times would give;
    what is cut off goes to the others in proportion."""
    limit, short = present * most / 2, np.zeros(len(wanted), bool)
    while True:
        rest = 1 - limit[short].sum()
        new = np.where(short, limit, wanted * rest / max(wanted[~short].sum(), 1e-12))
        above = (new > limit) & ~short
        if not above.any():
            return new
        short |= above
        if short.all():
            return wanted


def solve(table: DataFrame, domains, targets, steps=STEPS, tolerance=TOLERANCE, most=np.inf) -> list:
    """The ``steps`` for ``replay`` that lead to the wanted totals.

    ``table`` has ``__tokens`` and a ``__p`` column for each domain. The errors that
    remain at the returned rates are logged; ending without convergence is a warning.
    """
    n = len(domains)
    wanted = np.array([max(float(targets.get(d, 0.0)), 0.0) for d in domains])
    if not n or not wanted.sum():
        return []
    wanted /= wanted.sum()
    narrow = table.select("__tokens", *[f"__p{d}" for d in range(n)])
    names = ["tokens", "energy", *[f"t{d}" for d in range(n)], *[f"g{d}" for d in range(n * n)]]

    def sums(lengths):
        """All tokens; the integral over the rates up to the step; totals; their slopes."""
        def run(batches):
            total = np.zeros(len(names))
            for batch in batches:
                p, tokens = _columns(batch, n), batch.column("__tokens").to_numpy().astype(np.float64)
                point = 1 - p @ np.asarray(lengths)
                rate = np.clip(point, 0.0, most)
                slopes = p.T @ (p * (tokens * ((rate > 0) & (rate < most)))[:, None])
                energy = tokens @ (rate * np.maximum(point, 0.0) - rate ** 2 / 2)
                total += np.concatenate(([tokens.sum(), energy], (tokens * rate) @ p, slopes.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=names)

        found = narrow.mapInArrow(run, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c) for c in names]).first()
        return np.array([float(v or 0) for v in found])

    def measured(lengths):
        """The convex function whose lowest point gives the lengths, its gradient, slopes and totals."""
        found = sums(lengths.tolist())[1:] / everything
        total, slopes = found[1:n + 1], found[n + 1:].reshape(n, n)
        pull = _NEAR_ONE * present * lengths
        return found[0] + wanted @ lengths + pull @ lengths / 2, wanted - total + pull, slopes, total

    start = sums([0.0] * n)
    everything = start[0]
    if not everything:
        return []
    present = np.maximum(start[2:n + 2] / everything, 1e-9)
    wanted = attainable(wanted, present, most)
    lengths = np.zeros(n)
    value, gradient, slopes, total = measured(lengths)
    left, done = steps, False
    while left > 0:
        done = bool((np.abs(gradient) <= tolerance * np.maximum(wanted, 1e-3)).all())
        if done:
            break
        way = -np.linalg.solve(slopes + _NEAR_ONE * np.diag(present) + 1e-15 * np.eye(n), gradient)
        pace = 1.0
        while left > 0:
            found, left = measured(lengths + pace * way), left - 1
            if found[0] <= value + 1e-4 * pace * (gradient @ way) + 1e-14 * abs(value):
                break
            pace /= 2
        else:
            break
        lengths = lengths + pace * way
        value, gradient, slopes, total = found
    errors = ", ".join(f"{d} {t:.5f} for {w:.5f}" for d, t, w in zip(domains, total, wanted))
    _LOG.log(logging.INFO if done else logging.WARNING, "shares of tokens after %d sums%s: %s", steps - left,
             "" if done else ", not converged", errors)
    return [(lengths.tolist(), 0.0)]


def with_rates(table: DataFrame, domains, taken, most=np.inf) -> DataFrame:
    """``table`` with the column ``__rate``."""
    n = len(domains)

    def run(batches):
        for batch in batches:
            rate = replay(_columns(batch, n), taken, most)[0] if n else np.ones(batch.num_rows)
            yield batch.append_column("__rate", pa.array(rate))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields]
    return table.mapInArrow(run, ", ".join(fields + ["`__rate` double"]))


def mix(docs: DataFrame, domains: DataFrame, targets=None, tokenizer="word_bpe_49k.json",
        training_rows=TRAINING_ROWS, most=MOST) -> DataFrame:
    """``docs`` with ``n_tokens``, ``domain`` (the likeliest), ``posterior`` (of that
    domain) and ``rate``: how often to take each document. Those four names come
    last; columns of ``docs`` with such a name are left out."""
    ready(docs.sparkSession)
    model = fit(docs, domains, tokenizer, training_rows)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    source = plain.withColumn("__text", F.coalesce(F.col(f"c{names.index('text')}").cast("string"), F.lit("")))
    table = saved(memberships(source, model, tokenizer), "memberships")
    taken = solve(table, model.domains, TARGETS if targets is None else targets, most=most)
    table = with_rates(table, model.domains, taken, most)
    new = ["n_tokens", "domain", "posterior", "rate"]
    if not model.domains:
        best = F.struct(F.lit(None).cast("double").alias("p"), F.lit(None).cast("string").alias("d"))
    else:
        best = F.sort_array(F.array(*[F.struct((-F.col(f"__p{d}")).alias("p"), F.lit(name).alias("d"))
                                      for d, name in enumerate(model.domains)]))[0]
        best = F.struct((-best["p"]).alias("p"), best["d"].alias("d"))
    kept = [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n not in new]
    return table.select(*kept, F.col("__tokens").alias("n_tokens"), best["d"].alias("domain"),
                        best["p"].alias("posterior"), F.col("__rate").alias("rate"))


def draw(mixed: DataFrame, columns) -> DataFrame:
    """Each document as often as its rate says, in expectation: the whole part of the
    rate, and once more where a hash of ``doc_id`` and ``text`` falls below the rest."""
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "doc_id", "text"), 11) / F.lit(float(1 << 53))
    whole = F.floor("rate")
    times = (whole + F.when(chance < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    return mixed.withColumn("__times", times).where("__times > 0").withColumn(
        "__time", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*columns)
