import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.llm.fixtures import WORD, bag, docs, rows, words
from velario.llm import paragraph_sketch, simhash_trees, superkmers
from velario.llm.components import components


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lowered)
    shingles = [" ".join(w[k:k + 4]) for k in range(max(len(w) - 3, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(prints, radius):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def test_simhash_groups(spark):
    found = simhash_trees.near_groups(docs(spark)).select("doc_id", simhash_trees.hex16("fp").alias("f"), "component_id").collect()
    prints = [(i, plain_fingerprint(t)) for i, t in rows()]
    group = groups_of({p for _, p in prints}, 4)
    low = {}
    for i, p in prints:
        if i is not None:
            low[group[p]] = min(i, low.get(group[p], i))
    assert bag(found) == bag([(i, f"{p:016x}", low.get(group[p])) for i, p in prints])


@pytest.mark.parametrize("limit", [3, 20_000])
def test_links_find_all_near_fingerprints(spark, limit):
    """Clusters around few centres, and chains: the groups equal those of all pairs."""
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            p = centre
            for _ in range(rng.randint(0, 5)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash_trees.links(spark.createDataFrame(signed, "fp bigint"), shard_limit=limit)
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    expected = groups_of(prints, 4)
    by_root, ours = {}, {}
    for p, in signed:
        by_root.setdefault(expected[p % (1 << 64)], set()).add(p)
        ours.setdefault(found.get(p, p), set()).add(p)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, ours.values()))


def test_bk_tree_equals_brute_force():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    queries = rng.integers(0, 1 << 12, 50).astype(np.uint64)
    q, k = simhash_trees.BKTree(keys).near(queries, 2)
    near = {(i, j) for i in range(len(queries)) for j in range(len(keys)) if bin(int(queries[i] ^ keys[j])).count("1") <= 2}
    assert set(zip(q.tolist(), k.tolist())) == near and len(q) == len(near)
    assert simhash_trees.BKTree(keys[:0]).near(queries, 2)[0].size == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, j) for j in range(8, 60)] + [(5, 5)]
    found = dict((r["node"], r["root"]) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert found == {**{i: 100 for i in range(101, 161)}, **{j: 7 for j in range(8, 60)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_document_of_each_group_stays(spark):
    kept = simhash_trees.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns
    found = [r["doc_id"] for r in kept.collect()]
    groups = simhash_trees.near_groups(docs(spark)).collect()
    one_each = {r["root"]: r["component_id"] for r in groups}        # unlike texts with one id are two groups
    assert sorted(found, key=str) == sorted(one_each.values(), key=str) and found.count(14) == 2
    assert simhash_trees.keep_one(docs(spark, [])).count() == 0
    lonely = simhash_trees.keep_one(docs(spark, [(None, "a b c d e"), (None, "a b c d e"), (None, "quite other words here now")]))
    assert lonely.count() == 2


def test_large_shards_are_dealt_again(spark):
    """One band value holds ten times the limit: no shard may stay above it, and no link may go."""
    rng = random.Random(4)
    base = rng.getrandbits(64)
    prints = {(rng.getrandbits(64) & ~0xFFF) | (base & 0xFFF) for _ in range(600)}
    for p in list(prints)[:200]:
        for b in rng.sample(range(64), 3):
            p ^= 1 << b
        prints.add(p)
    signed = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    sizes = [r["count"] for r in simhash_trees.shards(signed, shard_limit=60).groupBy("band", "value", "slice").count().collect()]
    assert max(sizes) <= 60
    found = {r["node"] for r in components(simhash_trees.links(signed, shard_limit=60)).collect()}
    expected = groups_of(prints, 4)
    assert len(found) == len(prints) - len(set(expected.values()))


def test_windows_of_a_large_bucket_are_dealt(spark):
    """A six-word line in many surroundings: one minimiser, a bucket far above the limit."""
    line = "lorem ipsum dolor sit amet elit"
    pairs = [(i, " ".join(words(40, 500 + i % 90)) + f" {line} " + " ".join(words(40, 900 + i % 45))) for i in range(180)]
    assert bag(superkmers.remove_repeats(docs(spark, pairs), bucket_strings=9).collect()) == bag(plain_removal(pairs, 35))


def plain_removal(pairs, window):
    texts = [WORD.findall(t or "") for _, t in pairs]
    seen = Counter(tuple(w[k:k + window]) for w in texts for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(pairs, texts):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [2, 5_000])
def test_repeated_windows_are_removed(spark, limit):
    found = superkmers.remove_repeats(docs(spark), bucket_strings=limit).collect()
    assert bag(found) == bag(plain_removal(rows(), 35))


def test_small_windows_over_few_words(spark):
    """A tiny vocabulary makes every kind of overlap and repetition inside a text."""
    rng = random.Random(9)
    pairs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    found = superkmers.remove_repeats(docs(spark, pairs), window=8, seed=3).collect()
    assert bag(found) == bag(plain_removal(pairs, 8))
    assert superkmers.remove_repeats(docs(spark, [])).count() == 0


def test_texts_without_repeats_stay_as_they_are(spark):
    kept = superkmers.without_repeats(docs(spark))
    assert kept.schema.simpleString() == docs(spark).schema.simpleString()
    removed = {i: n for i, _, n, _ in plain_removal(rows(), 35)}
    before = {i: t for i, t in rows()}
    for r in kept.collect():
        if r["doc_id"] in (None, 14):
            continue
        left = " ".join(WORD.findall(r["text"] or ""))
        if not removed[r["doc_id"]]:
            assert r["text"] == before[r["doc_id"]]
        else:
            assert r["n_chars"] == len(r["text"]) and len(left) < len(before[r["doc_id"]])
    eight = [r["text"] for r in kept.collect() if r["doc_id"] == 8]
    assert eight == ["\n".join([" ".join(words(40, 3)), " ".join(words(40, 4))])]


def digests(text):
    return {line[k:k + 256] for line in (text or "").split("\n") for k in range(0, len(line), 256)}


def likeness(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def plain_edits(pairs):
    pairs = sorted(pairs)
    out = []
    for k, (i, t) in enumerate(pairs):
        following = pairs[(k + 1) % len(pairs)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(digests(t), digests(edited)), 9),
                    round(likeness(digests(t), digests(following)), 9)))
    return out


def sketched(spark, pairs):
    return [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9))
            for r in paragraph_sketch.compare(docs(spark, pairs)).collect()]


def test_sketches_recover_all_differences(spark):
    pairs = [(i, t or "") for i, t in rows() if i is not None and i != 14]
    pairs += [(50, "\n".join(words(700, 8))), (51, "\n".join(words(700, 8)[:690] + ["new"]))]
    assert bag(sketched(spark, pairs)) == bag(plain_edits(pairs))


def test_equal_texts_have_equal_fingerprints(spark):
    found = paragraph_sketch.compare(docs(spark)).collect()
    assert len(found) == len(rows())
    by_text, text = {}, dict((i, t) for i, t in rows() if i not in (14, None))
    for r in found:
        if r["doc_id"] in text:
            by_text.setdefault(text[r["doc_id"]] or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len(set.union(*by_text.values())) >= len(by_text) - 2
    assert paragraph_sketch.compare(docs(spark, [])).count() == 0
    alone = paragraph_sketch.compare(docs(spark, [(1, "only one")])).collect()
    assert [(r["near_next"], r["n_chars"]) for r in alone] == [(1.0, 8)]


def test_differences_name_the_digests(spark):
    pair = spark.createDataFrame([(1, [1, 2, 3], [3, 4]), (2, list(range(100, 400)), list(range(150, 420))), (3, [], [])],
                                 "pair int, a array<bigint>, b array<bigint>")
    ours, theirs = {}, {}
    for r in paragraph_sketch.differences(pair).collect():
        ours.setdefault(r["pair"], set()).update(r["ours"])
        theirs.setdefault(r["pair"], set()).update(r["theirs"])
    assert ours == {1: {1, 2}, 2: set(range(100, 150)), 3: set()}
    assert theirs == {1: {4}, 2: set(range(400, 420)), 3: set()}
