"""SimHash near-duplicates, linked through BK-trees.

A text's fingerprint has 64 bits. Two texts are linked where their fingerprints
differ in at most ``radius`` bits; a group is all that such links connect.

Search. Fingerprints are first made distinct, so copies cost nothing. They are
dealt to shards by the value of one of ``radius + 1`` bit bands: two fingerprints
within the radius agree on a band at least, so some shard holds both, and no pair
is lost. A task builds the BK-tree of a shard - children keyed by their Hamming
distance to the parent - and each fingerprint follows only the edges within the
radius of its own distance. Of the links it finds a task returns a spanning
forest (a fingerprint and the root of its group within the shard), never pairs.

The trees are not sent out as broadcasts: they hold every fingerprint, and a
broadcast passes through the driver. Each tree is built where its shard lies. A
shard above ``shard_limit`` is dealt again, by bands of the bits that its keys may
still differ in: two keys within the radius agree on one of these as well. So shards
shrink as the corpus grows, and the trees stay small. Only what is still too large
after ``DEPTH`` deals is searched by several tasks that each build the tree.

Cases: a null, empty or blank text has fingerprint zero and is linked like any
other; rows without ``doc_id`` are linked too, and a group without any id has no
component id; repeated rows give a row each; an empty table gives no row; a text of
any length is read whole, its shingles in parts.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velario.llm.components import components
from velario.llm.shared import column_bytes, ready, row_key, saved, small, texts

RADIUS = 4
SHINGLE = 4
SHARD_LIMIT = 20_000
DEPTH = 3                    # times that a shard is dealt by bands

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bit b is set where more than half of the shingles' XXH64 (seed 42) have it set."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(len(words) - size + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    stops = ends[-n:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), stops.tolist())], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):          # bounded memory for very long texts
        part = hashes[i:i + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, key_id, key_hash, fp)``, fp as the signed 64-bit integer of the same bits."""
    ready(docs.sparkSession)
    keys = ["doc_id", "key_id", "key_hash"]

    def run(batches):
        for batch in small(batches):
            fps = np.array([fingerprint(t) for t in column_bytes(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(fps)], names=[*keys, "fp"])

    return row_key(texts(docs)).select(*keys, "text").mapInArrow(
        run, "doc_id bigint, key_id bigint, key_hash bigint, fp bigint")


def masks(radius: int, depth: int) -> list:
    """For each depth, the bits on which the keys of a shard agree, by its number.

    The shard numbered k at one depth is dealt to those numbered k * (radius + 1)
    and following at the next. Each mask is a signed 64-bit integer.
    """
    n, found = radius + 1, [[0]]
    for _ in range(depth):
        level = []
        for mask in found[-1]:
            open_ = [b for b in range(64) if not mask >> b & 1]
            for i in range(n):
                part = open_[len(open_) * i // n:len(open_) * (i + 1) // n]
                level.append(mask | sum(1 << b for b in part))
        found.append(level)
    return [[m - (1 << 64) if m >> 63 else m for m in level] for level in found[1:]]


class BKTree:
    """A BK-tree over distinct 64-bit keys, kept level by level in arrays.

    ``children[node]`` maps a distance to the child whose subtree holds exactly
    the keys at that distance from the node.
    """

    def __init__(self, keys):
        self.keys = np.asarray(keys, np.uint64)
        self.children = [{} for _ in self.keys]
        groups = [(0, np.arange(1, len(self.keys)))] if len(self.keys) else []
        while groups:
            node, rest = groups.pop()
            if not len(rest):
                continue
            far = np.bitwise_count(self.keys[rest] ^ self.keys[node])
            by = np.argsort(far, kind="stable")
            cuts = np.flatnonzero(np.diff(far[by])) + 1
            for part in np.split(rest[by], cuts):
                child = int(part[0])
                self.children[node][int(np.bitwise_count(self.keys[child] ^ self.keys[node]))] = child
                groups.append((child, part[1:]))

    def near(self, queries, radius):
        """(query index, key index) arrays of all keys within the radius: all queries
        walk the tree together, each following the edges its distance allows."""
        queries = np.asarray(queries, np.uint64)
        found_q, found_k = [], []
        stack = [(0, np.arange(len(queries)))] if len(self.keys) and len(queries) else []
        while stack:
            node, who = stack.pop()
            far = np.bitwise_count(queries[who] ^ self.keys[node]).astype(np.int64)
            hit = who[far <= radius]
            if len(hit):
                found_q.append(hit)
                found_k.append(np.full(len(hit), node))
            for edge, child in self.children[node].items():
                down = who[np.abs(far - edge) <= radius]
                if len(down):
                    stack.append((child, down))
        if not found_q:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_q), np.concatenate(found_k)


def _forest(keys, a, b):
    """(key, root) of linked keys, the root being the smallest of its group."""
    parent = np.arange(len(keys))
    while True:                              # keys are sorted: smaller index, smaller key
        low = parent.copy()
        np.minimum.at(low, a, parent[b])
        np.minimum.at(low, b, parent[a])
        low = low[low]
        if (low == parent).all():
            break
        parent = low
    moved = np.flatnonzero(parent != np.arange(len(keys)))
    return keys[moved], keys[parent[moved]]


def shards(fps: DataFrame, radius=RADIUS, shard_limit=SHARD_LIMIT) -> DataFrame:
    """``(band, value, slice, fp)``: every two keys within the radius meet in a shard.

    ``fps(fp)`` are distinct. Shards of one key are left out.
    """
    n, out, open_ = radius + 1, [], fps.select(F.lit(0).alias("band"), "fp")
    for depth, level in enumerate(masks(radius, DEPTH), 1):
        table = F.array(*[F.lit(m) for m in level])
        dealt = open_.select(F.explode(F.sequence(F.col("band") * n, F.col("band") * n + n - 1)).alias("band"), "fp")
        dealt = dealt.select("band", F.col("fp").bitwiseAND(F.element_at(table, F.col("band") + 1)).alias("value"), "fp")
        # few rows next to the keys, and written out Spark knows how few
        sizes = saved(dealt.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shard_sizes")
        last = depth == DEPTH or sizes.where(F.col("n") > shard_limit).isEmpty()
        whole = sizes if last else sizes.where(F.col("n") <= shard_limit)
        parts = F.ceil(F.col("n") / shard_limit).cast("int")
        out.append(dealt.join(whole.select("band", "value", parts.alias("parts")), ["band", "value"]).select(
            (F.lit(depth * n ** DEPTH) + F.col("band")).alias("band"), "value",
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slice"), "fp"))
        if last:
            break
        hot = sizes.where(F.col("n") > shard_limit).select("band", "value")
        open_ = saved(dealt.join(hot, ["band", "value"]).select("band", "fp"), "large_shards")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def links(fps: DataFrame, radius=RADIUS, shard_limit=SHARD_LIMIT) -> DataFrame:
    """``(a, b)``: a forest that connects what links within the radius connect.

    ``fps(fp)`` are distinct.
    """
    def search(batches):
        for slice_, keys in _shards(batches):
            a, b = _search(keys, slice_, radius, shard_limit)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    shard = ["band", "value", "slice"]
    return (shards(fps, radius, shard_limit).repartition(*shard).sortWithinPartitions(*shard, "fp")
            .mapInArrow(search, "a bigint, b bigint"))


def _shards(batches):
    """(slice, sorted keys) of each shard of a partition sorted by shard."""
    current, parts = None, []
    for batch in batches:
        shard = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)
                          for n in ("band", "value", "slice")])
        keys = batch.column("fp").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((shard[:, 1:] != shard[:, :-1]).any(axis=0)) + 1
        for first, part in zip([0, *cuts.tolist()], np.split(keys, cuts)):
            if not len(part):
                continue
            name = tuple(shard[:, first].tolist())
            if name != current and parts:
                yield current[2], np.concatenate(parts)
                parts = []
            current = name
            parts.append(part)
    if parts:
        yield current[2], np.concatenate(parts)


def _search(keys, slice_, radius, shard_limit):
    """The forest that one task's slice of a shard's queries finds."""
    slices = (len(keys) - 1) // shard_limit + 1
    own = np.arange(slice_, len(keys), slices)
    bits = keys.view(np.uint64)
    # Any order of insertion finds the same; sorted keys would make a lopsided tree.
    turn = np.random.default_rng(len(keys)).permutation(len(keys))
    q, k = BKTree(bits[turn]).near(bits[own], radius)
    return _forest(keys, own[q], turn[k])


def _groups(docs: DataFrame, radius, shard_limit) -> tuple:
    """The rows ``(doc_id, key_id, key_hash, fp)``, and ``(fp, root, component_id)``."""
    marked = saved(fingerprints(docs), "fingerprints")
    distinct = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("low_id")), "fingerprint_ids")
    roots = components(links(distinct.select("fp"), radius, shard_limit), "fingerprint_groups")
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "low_id")
    ids = grouped.groupBy("root").agg(F.min("low_id").alias("component_id"))
    return marked, grouped.join(ids, "root").select("fp", "root", "component_id")


def near_groups(docs: DataFrame, radius=RADIUS, shard_limit=SHARD_LIMIT) -> DataFrame:
    """``(doc_id, fp, root, component_id)`` of each row: its group's smallest
    fingerprint, and the smallest id in the group."""
    marked, named = _groups(docs, radius, shard_limit)
    return marked.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def hex16(fp):
    """16 lower-case hex digits of a signed 64-bit integer."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, radius=RADIUS) -> DataFrame:
    """One row of each group: that of its smallest ``doc_id``, other columns kept.

    Rows of one ``doc_id`` and text count as one; rows with one ``doc_id`` and other
    texts are documents of their own. Rows without ``doc_id`` come last in a group.
    """
    marked, named = _groups(docs, radius, SHARD_LIMIT)
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key_id", "key_hash")
    kept = marked.join(named, "fp").groupBy("root").agg(F.min(row).alias("row")).select("row.key_id", "row.key_hash")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = row_key(plain.withColumns({"doc_id": F.col(f"c{names.index('doc_id')}").cast("bigint"),
                                     "text": F.coalesce(F.col(f"c{names.index('text')}").cast("string"), F.lit(""))}))
    return (own.join(kept, ["key_id", "key_hash"], "left_semi").dropDuplicates(["key_id", "key_hash"])
            .select(plain.columns).toDF(*names))
