"""A small table with every awkward case, and plain versions of what operators compute."""

import random
import re
import zlib
from functools import lru_cache

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars int, key_id string, c0 string, "
          "n_tokens string, rate string, band string, task int, at array<int>")


def words(n, seed, size=4000):
    rng = random.Random(seed)
    return ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) + str(
        rng.randrange(size)) for _ in range(n)]


PASSAGE = " ".join(words(60, 1))


def rows():
    """(doc_id, text) pairs: nulls, empty and blank, long, ties, repeats, shared passages, near copies."""
    base = words(300, 2)
    near = base[:]
    near[150] = "changed"
    out = [
        (0, None), (1, ""), (2, " \t\n "), (3, "word"), (4, "one two three"),
        (5, " ".join(base)), (6, " ".join(near)), (7, " ".join(base)),
        (8, "\n".join([" ".join(words(40, 3)), PASSAGE, " ".join(words(40, 4))])),
        (9, " ".join(words(50, 5)) + "\n" + PASSAGE),
        (10, "Grüße, ça va? É́té İx ß ﬁ 你好 <|endoftext|> don't it's\x85x"),
        (11, " ".join(words(9000, 6))),
        (12, " ".join(["again"] * 400)), (13, " ".join(words(30, 7) * 5)),
        (14, "x" * 40_000), (14, "a tie of ids"), (14, "a tie of ids"),
        (None, "no id at all"), (None, None), (20, "###  *** %%% && || <<>> $$ " * 10), (21, "a b c\na b c\n\nd\nd"),
        (22, "\n".join(["The same line of text here"] * 30)), (23, "ONE TWO THREE! " * 20),
    ]
    return out + [(30 + i, " ".join(words(40 + i, 100 + i))) for i in range(12)]


def docs(spark, pairs=None):
    return spark.createDataFrame(
        [(i, t, "xx", "s", len(t or ""), "k", "c", "t", "r", "b", 1, [1]) for i, t in (rows() if pairs is None else pairs)],
        SCHEMA)


def bag(found):
    return sorted([tuple(r) for r in found], key=str)


@lru_cache
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
