"""Exact removal of repeated word windows, by super-k-mers.

A window is ``window`` consecutive words; its minimiser is the smallest hash among
its runs of ``seed`` words. Consecutive windows with the same minimiser travel
together as one packed string (a super-k-mer) to the bucket of that minimiser.
Equal windows have equal minimisers, so all copies of a window meet in one bucket,
where the windows of sorted strings are counted, by their words and not by a hash.

Only what can repeat travels. First the minimisers alone are counted: a window can
occur twice only if its minimiser does. Then packed strings are cut for those
alone, and equal strings are counted before the shuffle, so a passage copied a
million times reaches its bucket once, with its count. The windows of a bucket with
more than ``bucket_strings`` different strings are dealt by a 128-bit digest of their
words: equal windows are added up before they travel, and no task holds the bucket.

Cases: a null or empty text has no words; each row is a document, so a row and its
repetition are copies of each other; rows without ``doc_id`` are kept apart by
their text; texts shorter than a window keep all words; an empty table gives no
row; other columns are not read; a text of any length is read whole, its strings go
out in parts.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velario.llm.shared import column_bytes, ready, row_key, rows_of, saved, small, texts

WINDOW = 35
SEED_WORDS = 6
BUCKET_STRINGS = 5_000
LONGEST_RUN = 256              # windows in one packed string
_WORD_CACHE = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)          # fixed value: 2**64 over the golden ratio


class _WordHash(dict):
    def __missing__(self, word):
        if len(self) > _WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASH = _WordHash()


def _sliding(values, span, choose):
    """``choose`` (minimum or maximum) over each ``span`` neighbours, by doubling."""
    width = 1
    while 2 * width <= span:
        values = choose(values[:-width], values[width:])
        width *= 2
    rest = span - width
    return choose(values[:len(values) - rest], values[rest:]) if rest else values


def _run_hashes(words, seed):
    n = len(words)
    one = np.fromiter(map(_HASH.__getitem__, words), np.uint64, n)
    runs = one[:n - seed + 1].copy()
    for i in range(1, seed):
        runs *= _ODD
        runs ^= runs >> np.uint64(29)
        runs += one[i:n - seed + 1 + i]
    runs *= _ODD
    runs ^= runs >> np.uint64(32)
    return runs


def minimisers(words, window=WINDOW, seed=SEED_WORDS) -> np.ndarray:
    """The minimiser of each window of a list of words."""
    if len(words) < window:
        return np.empty(0, np.uint64)
    return _sliding(_run_hashes(words, seed), window - seed + 1, np.minimum)


def minimiser_places(words, window=WINDOW, seed=SEED_WORDS) -> np.ndarray:
    """Each minimiser of a text, twice if it stands at two places or more: a text
    that repeats itself may do so inside one super-k-mer."""
    if len(words) < window:
        return np.empty(0, np.int64)
    span = window - seed + 1
    runs = _run_hashes(words, seed)
    low = _sliding(runs, span, np.minimum)
    edge = np.zeros(span - 1, np.uint64)
    # a run is a minimiser where the largest minimum of the windows around it is its own
    value, n = np.unique(runs[_sliding(np.concatenate((edge, low, edge)), span, np.maximum) == runs],
                         return_counts=True)
    return np.repeat(value, np.minimum(n, 2)).view(np.int64)


def super_kmers(words, window=WINDOW, seed=SEED_WORDS):
    """(minimiser, first window, windows) arrays of the runs of equal minimisers."""
    low = minimisers(words, window, seed)
    if not len(low):
        return low.view(np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
    # one word said a million times is one long run: cut into strings of bounded size
    pieces = (np.diff(np.append(starts, len(low))) + LONGEST_RUN - 1) // LONGEST_RUN
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(starts, pieces) + LONGEST_RUN * nth
    return low[starts].view(np.int64), starts, np.diff(np.append(starts, len(low)))


def _met_twice(source, window, seed) -> DataFrame:
    """``(key_id, key_hash, met)``: minimisers of a document that occur twice or more."""
    def run(batches):
        for batch in small(batches):
            found = [minimiser_places(t.split(), window, seed) for t in column_bytes(batch, "text")]
            sizes = np.array([len(f) for f in found])
            some = np.flatnonzero(sizes)
            if not len(some):
                continue
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes[some]))), pa.int32()),
                                             pa.array(np.concatenate([found[i] for i in some])))
            yield pa.RecordBatch.from_arrays([batch.column(n).take(pa.array(some)) for n in ("key_id", "key_hash")]
                                             + [lists], names=["key_id", "key_hash", "found"])

    rows = saved(row_key(source).mapInArrow(run, "key_id bigint, key_hash bigint, found array<bigint>"), "minimisers")
    each = rows.select("key_id", "key_hash", F.explode("found").alias("m"))
    often = each.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("m")
    # once per document: a minimiser all documents share is one row of each
    own = rows.select("key_id", "key_hash", F.explode(F.array_distinct("found")).alias("m"))
    return own.join(often, "m").groupBy("key_id", "key_hash").agg(F.collect_list("m").alias("met"))


_PACKED = pa.schema([("key_id", pa.int64()), ("key_hash", pa.int64()), ("m", pa.int64()), ("first", pa.int32()),
                     ("windows", pa.int32()), ("digest", pa.binary()), ("packed", pa.binary())])


def _packed(source, met, window, seed) -> DataFrame:
    """The super-k-mers of shared minimisers as packed strings, with their places."""
    def run(batches):
        for batch in small(batches):
            out = {f.name: [] for f in _PACKED}
            size = 0
            mets = batch.column("met")
            for i, text in enumerate(column_bytes(batch, "text")):
                words = text.split()
                m, first, windows = super_kmers(words, window, seed)
                wanted = np.flatnonzero(np.isin(m, mets[i].values.to_numpy()))
                for j in wanted.tolist():
                    a, n = int(first[j]), int(windows[j])
                    packed = b" ".join(words[a:a + n + window - 1])
                    size += len(packed)
                    row = (batch.column("key_id")[i].as_py(), batch.column("key_hash")[i].as_py(), int(m[j]), a, n,
                           hashlib.blake2b(packed, digest_size=16).digest(), packed)
                    for name, value in zip(out, row):
                        out[name].append(value)
                if size > 1 << 24:               # a batch of many long copies goes out in parts
                    yield rows_of(out, _PACKED)
                    out, size = {f.name: [] for f in _PACKED}, 0
            yield rows_of(out, _PACKED)

    wide = row_key(source).join(met, ["key_id", "key_hash"]).select("key_id", "key_hash", "met", "text")
    return wide.mapInArrow(run, "key_id bigint, key_hash bigint, m bigint, first int, windows int, "
                                "digest binary, packed binary")


def _windows(packed: bytes, window):
    words = packed.split(b" ")
    return [b" ".join(words[i:i + window]) for i in range(len(words) - window + 1)]


def repeated_in_bucket(strings, counts, window):
    """For each packed string, the windows (by place) that occur twice or more in the bucket.

    Equal windows are brought together by sorting all windows of the strings.
    """
    found = [(w, i, at) for i, packed in enumerate(strings) for at, w in enumerate(_windows(packed, window))]
    found.sort()
    out = [[] for _ in strings]
    i = 0
    while i < len(found):
        j = i
        while j < len(found) and found[j][0] == found[i][0]:
            j += 1
        if j - i > 1 or counts[found[i][1]] > 1:
            for _, string, at in found[i:j]:
                out[string].append(at)
        i = j
    return [sorted(at) for at in out]


def ranges(starts, window) -> list:
    """Sorted window starts as word ranges from, to, from, to ... that do not touch."""
    out = []
    for start in starts:
        if out and start <= out[-1]:
            out[-1] = start + window
        else:
            out += [start, start + window]
    return out


_REPEATS = pa.schema([("digest", pa.binary()), ("at", pa.list_(pa.int32()))])


def _count_buckets(occurrences, window, bucket_strings) -> DataFrame:
    """``(digest, at)``: the words of each different packed string that repeated windows cover."""
    strings = occurrences.groupBy("m", "digest").agg(F.count(F.lit(1)).alias("n"), F.first("packed").alias("packed"))
    # Large buckets are few; written out, Spark knows how few, and the strings need
    # not travel to meet them.
    large = saved(occurrences.groupBy("m").agg(F.count_distinct("digest").alias("strings"))
                  .where(F.col("strings") > bucket_strings).select("m"), "large_buckets")

    def run(batches):
        out = {f.name: [] for f in _REPEATS}
        for rows in _buckets(batches):
            found = repeated_in_bucket([r[3] for r in rows], [r[2] for r in rows], window)
            for r, at in zip(rows, found):
                if at:
                    out["digest"].append(r[1])
                    out["at"].append(ranges(at, window))
            if len(out["at"]) > 2_000:
                yield rows_of(out, _REPEATS)
                out = {f.name: [] for f in _REPEATS}
        yield rows_of(out, _REPEATS)

    small_ones = (strings.join(large, "m", "left_anti").select("m", "digest", "n", "packed").repartition("m")
                  .sortWithinPartitions("m", "packed").mapInArrow(run, "digest binary, at array<int>"))
    if large.isEmpty():
        return small_ones
    return small_ones.unionByName(_deal_windows(strings.join(large, "m", "left_semi"), window))


def _buckets(batches):
    """The rows of each bucket of a partition sorted by ``m``."""
    current, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("m", "digest", "n", "packed"))):
            if row[0] != current and rows:
                yield rows
                rows = []
            current = row[0]
            rows.append(row)
    if rows:
        yield rows


def _deal_windows(strings, window) -> DataFrame:
    """The same for the strings of large buckets, each window counted by itself."""
    schema = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("place", pa.int32()), ("window", pa.binary())])

    def cut(batches):
        for batch in small(batches):
            out = {f.name: [] for f in schema}
            for digest, n, packed in zip(*(batch.column(c).to_pylist() for c in ("digest", "n", "packed"))):
                for at, w in enumerate(_windows(packed, window)):
                    for name, value in zip(out, (digest, n, at, hashlib.blake2b(w, digest_size=16).digest())):
                        out[name].append(value)
            yield rows_of(out, schema)

    dealt = saved(strings.select("digest", "n", "packed").mapInArrow(
        cut, "digest binary, n bigint, place int, window binary"), "dealt_windows")
    often = dealt.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window")
    hits = dealt.join(often, "window", "left_semi").groupBy("digest").agg(F.sort_array(F.collect_set("place")).alias("places"))

    def join(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array([ranges(p, window) for p in batch.column("places").to_pylist()],
                                                  pa.list_(pa.int32()))], names=["digest", "at"])

    return hits.mapInArrow(join, "digest binary, at array<int>")


def repeated_spans(docs: DataFrame, window=WINDOW, seed=SEED_WORDS, bucket_strings=BUCKET_STRINGS) -> DataFrame:
    """``(key_id, key_hash, spans)``: the words that repeated windows cover, as from, to, from, to ..."""
    ready(docs.sparkSession)
    source = texts(docs)
    occurrences = saved(_packed(source, _met_twice(source, window, seed), window, seed), "super_kmers")
    repeated = _count_buckets(occurrences, window, bucket_strings)
    hits = occurrences.select("key_id", "key_hash", "first", "digest").join(repeated, "digest")
    placed = hits.select("key_id", "key_hash", F.transform("at", lambda x: x + F.col("first")).alias("at"))
    return placed.groupBy("key_id", "key_hash").agg(F.flatten(F.collect_set("at")).alias("spans"))


def covered(n_words: int, spans) -> np.ndarray:
    """Which words the spans cover."""
    ends = np.asarray(spans, np.int64).reshape(-1, 2)
    edges = (np.bincount(ends[:, 0], minlength=n_words + 1)
             - np.bincount(ends[:, 1], minlength=n_words + 1))
    return np.cumsum(edges[:-1]) > 0


def _kept_text(text: bytes, words, gone) -> bytes:
    """The text without its covered words: what is kept stays as it was, and the
    pieces around a gap become lines of their own."""
    places, at = [], 0
    for w in words:
        at = text.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    keep = ~gone
    edges = np.flatnonzero(np.diff(np.concatenate(([0], keep.view(np.int8), [0])))).reshape(-1, 2)
    return b"\n".join(text[places[a][0]:places[b - 1][1]] for a, b in edges.tolist())


def remove_repeats(docs: DataFrame, window=WINDOW, seed=SEED_WORDS, bucket_strings=BUCKET_STRINGS,
                   with_text=False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256[, kept_text])`` of each row."""
    source = row_key(texts(docs))
    spans = repeated_spans(docs, window, seed, bucket_strings)
    wide = source.join(spans, ["key_id", "key_hash"], "left").select("doc_id", "text", "spans")
    return _cut(wide, ["doc_id"], with_text)


def _cut(wide, carried, with_text):
    names = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    kinds = {"kept_sha256": pa.string(), "kept_text": pa.binary()}

    def run(batches):
        for batch in small(batches):
            out = {n: [] for n in names}
            for text, spans in zip(column_bytes(batch, "text"), batch.column("spans").to_pylist()):
                words = text.split()
                kept = words
                if spans:
                    gone = covered(len(words), spans)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
                if with_text:
                    out["kept_text"].append(_kept_text(text, words, gone) if spans else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in carried]
                + [pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()], names=carried + names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema.fields if f.name in carried]
    types = {"kept_sha256": "string", "kept_text": "binary"}
    return wide.mapInArrow(run, ", ".join(fields + [f"{n} {types.get(n, 'bigint')}" for n in names]))


def without_repeats(docs: DataFrame, window=WINDOW, seed=SEED_WORDS, bucket_strings=BUCKET_STRINGS) -> DataFrame:
    """``docs`` with the texts that are left; ``n_chars``, where there is one, follows.
    Texts without a repeated window stay as they are, null ones too."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = plain.withColumns({"doc_id": F.col(f"c{names.index('doc_id')}").cast("bigint"),
                             "text": F.coalesce(F.col(f"c{names.index('text')}").cast("string"), F.lit(""))})
    spans = repeated_spans(docs, window, seed, bucket_strings)
    wide = row_key(own).join(spans, ["key_id", "key_hash"], "left")
    cut = _cut(wide.select(*plain.columns, "text", "spans"), plain.columns, True)
    kept = F.when(F.col("n_removed") > 0, F.col("kept_text").cast("string")).otherwise(F.col(f"c{names.index('text')}"))
    new = {"text": kept}
    if "n_chars" in names:
        place = names.index("n_chars")
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length(F.col("kept_text").cast("string"))).otherwise(
            F.col(f"c{place}")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new.get(n, F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])
