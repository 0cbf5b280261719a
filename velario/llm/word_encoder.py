"""Encoding whole texts with the tokenizers library, each distinct word once per worker.

A text is cut at ASCII white space. For a tokenizer whose normalizer and
pre-tokenizer are those of ``_WORDWISE`` this changes nothing: composition (NFC)
never reaches across a space, no alternative of the pattern matches one, and
special strings hold none. So the ids of a text are those of its words in order,
and a word's ids can be remembered. Any other tokenizer gets whole texts.
"""

import json
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from velario.llm.shared import BATCH_ROWS, ENCODED_ROWS, column_bytes, small

# Entries remembered by one Python worker (about 160 bytes each): forms as they
# stand in the texts (as many again of the generation before), and their lower-case
# letters, which cost more to find anew.
CACHE_WORDS = 250_000
CACHE_STEMS = 1_000_000
# Texts of at most so many bytes in all (or a single one) are encoded together: of
# each distinct word among them the ids are looked up once.
GROUP_BYTES = 8 << 20
# a run of these is one piece; the apostrophe starts pieces of its own
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

# fixed values: the steps of a tokenizer that never look across white space
_WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers by name; other paths stay as they are."""
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(name: str) -> "Encoder":
    """One encoder per file and Python worker, kept from task to task."""
    return Encoder(tokenizer_path(name))


def with_ids(batches, column: str, coder: "Encoder"):
    """Small slices of Arrow batches with the ids of their texts, encoded for many slices at once."""
    for batch in small(batches, ENCODED_ROWS):
        ids = coder.encode_many(column_bytes(batch, column))
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS), ids[at:at + BATCH_ROWS]


class _Forms(dict):
    """The ids of words, found when a word is met for the first time.

    Words in use outlive a full cache: it becomes the generation before, whose words
    come over when they are met again.
    """

    def __init__(self, find):
        self.find, self.before = find, {}

    def __missing__(self, word):
        ids = self.before.get(word)
        if ids is None:
            ids = self.find(word)
        self[word] = ids
        return ids

    def shrink(self, limit):
        if len(self) > limit:
            self.before = dict(self)
            self.clear()


def _byte_letters() -> dict:
    """The letter by which byte-level models know each byte: its own where it can be
    seen, the next free one from U+0100 for all others."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = (b for b in range(256) if b not in seen)
    return {b: b for b in seen} | {b: 0x100 + i for i, b in enumerate(other)}


class Encoder:
    """Ids of whole texts as little-endian bytes of ``dtype``, without added tokens."""

    def __init__(self, path: str, words: int = CACHE_WORDS, stems: int = CACHE_STEMS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        config = json.loads(self.library.to_str())
        self.wordwise = (all(config[k] == v for k, v in _WORDWISE.items())
                         and config["post_processor"] is None
                         and config["model"]["end_of_word_suffix"] == "</w>"
                         and not any(t["lstrip"] or t["rstrip"] or t["single_word"]
                                     for t in config["added_tokens"]))
        top = max(self.library.get_vocab(with_added_tokens=True).values())
        self.size = top + 1
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.limits = words, stems
        self.words, self.stems = _Forms(self._word), _Forms(self._piece)
        self._model, self._letters = self.library.model, _byte_letters()

    def encode_many(self, batch) -> list:
        """Ids of each text (``bytes`` of UTF-8) as bytes."""
        if not self.wordwise:
            found = self.library.encode_batch_fast([t.decode() for t in batch], add_special_tokens=False)
            return [self._pack(e.ids) for e in found]
        out, group, size = [], [], 0
        for text in batch:
            if group and size + len(text) > GROUP_BYTES:
                out += self._encode_group(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        return out + self._encode_group(group) if group else out

    def _encode_group(self, group) -> list:
        self.words.shrink(self.limits[0])
        if len(self.stems) > self.limits[1]:
            self.stems.clear()
        words = pc.ascii_split_whitespace(pa.array(group, pa.large_binary()).cast(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        found = pa.array(list(map(self.words.__getitem__, distinct)), pa.large_binary()).take(coded.indices)
        if not len(found):
            return [b""] * len(group)
        # the ids of all words stand one after another; a text has those between its first and last word
        ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, found.offset * 8)
        at = ends[words.offsets.to_numpy()].tolist()
        ids = memoryview(found.buffers()[2] or b"")
        return [bytes(ids[start:end]) for start, end in zip(at, at[1:])]

    def count_many(self, batch) -> list:
        return [len(ids) // self.dtype.itemsize for ids in self.encode_many(batch)]

    def _pack(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _word(self, word: bytes) -> bytes:
        form = word.decode()
        # Below U+0180 composition leaves a text as it is, and a run of letters is
        # one piece whatever precedes or follows it.
        if form.isascii() or max(form) < "\u0180":
            form = form.lower()
            stem = form.rstrip(_MARKS)
            if stem.isalpha():
                return self.stems[stem] + self.stems[form[len(stem):]] if len(stem) < len(form) else self.stems[stem]
        return self._pack(self.library.encode(form, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        """The ids of what the pre-tokenizer leaves in one piece."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self._letters)
        return array("H" if self.dtype.itemsize == 2 else "I", [t.id for t in self._model.tokenize(piece)]).tobytes()
