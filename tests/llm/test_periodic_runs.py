import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.fixtures import WORD, bag, docs, rows, words
from velario.llm import periodic_runs, queries


def smallest(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i - q] for i in range(q, len(w))))


def plain_runs(w, least=24, exponent=3):
    """Each lag by itself; of each stretch the smallest period by trying all."""
    out = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q) and smallest(w[i:j + q]) == q:
                out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    out = []
    while len(out) < rng.randint(0, 260):
        if rng.random() < 0.5:
            p = [rng.choice("abcde"[:rng.randint(1, 5)]) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 17, 20, 24, 25, 36, 50, 60]))]
            out += p * rng.randint(1, 6) + p[:rng.randint(0, len(p))]
        else:
            out += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_plain_search(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = [some_words(rng) for _ in range(rng.randint(1, 6))]
        assert [[tuple(r) for r in f.tolist()] for f in periodic_runs.find(texts)] == [plain_runs(w) for w in texts]


def test_long_periods_and_fibonacci_words():
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    texts = [list(b), words(1000, 4) * 3, words(700, 5) * 4 + words(50, 6), words(3000, 7)]
    found = [[tuple(r) for r in f.tolist()] for f in periodic_runs.find(texts)]
    assert found[0] == plain_runs(list(b)) and len(found[0]) > 50
    assert found[1:] == [[(0, 3000, 1000)], [(0, 2800, 700)], []]


def test_kept_places_are_those_of_all_windows():
    rng = np.random.default_rng(3)
    for n, window in ((5, 9), (40, 1), (200, 7), (300, 16)):
        names = rng.integers(0, 60, n)
        kept = periodic_runs.kept_places(names, window)
        for at in range(max(n - window + 1, 1)):
            assert ((kept >= at) & (kept < at + window)).any()


def plain_row(i, text):
    w = WORD.findall(text or "")
    if i is not None and w:
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = [hashlib.sha256(t.encode()).hexdigest() for t in (
        "".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(x for k, x in enumerate(w) if k not in gone))]
    return (i, len(w), len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digest)


def test_query_on_awkward_and_given_rows(spark, tmp_path):
    rng = random.Random(8)
    pairs = [*[r for r in rows() if r[0] != 11], *((100 + k, " ".join(some_words(rng))) for k in range(60))]
    docs(spark, pairs).write.parquet(f"{tmp_path}/documents.parquet")
    assert bag(queries.periodic_runs_query(spark, str(tmp_path)).collect()) == bag([plain_row(*p) for p in pairs])
    small = "/root/testdata/sf0.001"
    given = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    given = [p for p in given if len(p[1] or "") < 12_000]
    docs(spark, given).write.parquet(f"{tmp_path}/more/documents.parquet")
    found = queries.periodic_runs_query(spark, f"{tmp_path}/more").collect()
    assert bag(found) == bag([plain_row(*p) for p in given]) and sum(r["n_runs"] > 0 for r in found) > len(given) // 20
    assert periodic_runs.periodic_runs(docs(spark, [])).count() == 0


def test_a_text_of_megabytes(spark):
    loop = words(100_000, 12)
    text = " ".join(loop * 3 + ["end"] + ["x"] * 50_000)
    found = periodic_runs.periodic_runs(docs(spark, [(1, text), (1, text), (2, None)])).collect()
    own = [[(r["start"], r["length"], r["period"]) for r in f["runs"]] for f in found if f["doc_id"] == 1]
    assert own == [[(0, 300_000, 100_000), (300_001, 50_000, 1)]] * 2
    assert [bytes(f["collapsed"]).decode() for f in found if f["doc_id"] == 1][0] == " ".join([*loop, "end", "x"])
