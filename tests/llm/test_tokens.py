import glob

import numpy as np
import pytest

from tests.llm.fixtures import bag, crc, docs, ids_of, rows
from velario.llm import curve_packing, token_files, token_splice
from velario.llm.shared import new_path
from velario.llm.word_encoder import Encoder, encoder, tokenizer_path


def test_words_give_the_ids_of_the_whole_text():
    coder = Encoder(tokenizer_path("word_bpe_49k.json"), words=50, stems=50)
    texts = [t or "" for _, t in rows()] + ["a,b. c.,., 's 'S <| x|> <|startoftext|>a", "Ångström ſ Σας ΣΑΣ ǅ", "\x01 a\x01b"]
    for _ in range(2):
        found = coder.encode_many([t.encode() for t in texts])
        assert [np.frombuffer(f, coder.dtype).tolist() for f in found] == [ids_of(t) for t in texts]


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer
    coder = encoder("byte_bpe_50k.json")
    assert not coder.wordwise
    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    text = "Hello  world,\n how are   you?"
    assert np.frombuffer(coder.encode_many([text.encode()])[0], coder.dtype).tolist() == plain.encode(text).ids


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [3, 3, 9, 1000, 10 ** 12], list(range(0, 5000, 7)), [1 << 62]])
def test_elias_fano(values):
    coded = token_files.EliasFano.build(values)
    assert coded.all().tolist() == values
    assert [coded.select(i) for i in range(len(values))] == values
    again, _ = token_files.EliasFano.from_buffer(coded.to_bytes(), 0)
    assert again.all().tolist() == values


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    assert len(token_files.EliasFano.build(ends).to_bytes()) < 10_000 * 2


@pytest.mark.parametrize("shard", [1, 200, 1 << 20])
def test_token_files(spark, shard):
    path = new_path(spark, "tokens")
    token_files.write_tokens(docs(spark), path, shard_ids=shard)
    found = sorted(token_files.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    expected = sorted([(i, len(ids_of(t)) + 1, crc(ids_of(t) + [1])) for i, t in rows()], key=str)
    assert sorted([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found], key=str) == expected
    assert [r["start"] for r in found] == np.cumsum([0] + [r["n_tokens"] for r in found])[:-1].tolist()
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in found]
    assert order == sorted(order)
    files = glob.glob(f"{path}/part-*")
    assert len(files) >= (30 if shard == 1 else 1)
    one = token_files.Shard(open(files[0], "rb").read())
    assert one.bounds(0)[0] == 0 and one.bounds(one.n_docs - 1)[1] == one.n_ids


def test_token_files_of_nothing(spark):
    path = new_path(spark, "tokens")
    token_files.write_tokens(docs(spark, []), path)
    assert token_files.read_tokens(spark, path).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 512), (64, 16), (40, 3)])
def test_spliced_counts(spark, chunk, overlap):
    found = token_splice.count_tokens(docs(spark), chunk_chars=chunk, overlap_chars=overlap)
    assert bag(found.collect()) == bag([(i, len((t or "").encode()), len(ids_of(t))) for i, t in rows()])


def test_spliced_counts_of_nothing(spark):
    assert token_splice.count_tokens(docs(spark, [])).count() == 0


def test_hilbert_neighbours_touch():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = curve_packing.hilbert(side, bits=3)
    assert sorted(keys.tolist()) == list(range(512))
    steps = np.abs(np.diff(side[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


@pytest.mark.parametrize("length", [16, 2048])
def test_packing(spark, length):
    found = curve_packing.pack(docs(spark), length=length, with_ids=True).collect()
    pieces = bag([(r["doc_id"], r["doc_tokens"], r["start"], r["length"], crc(np.frombuffer(r["ids"], "<u4"))) for r in found])
    assert all(crc(np.frombuffer(r["ids"], "<u4")) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in found)
    whole = {}
    for r in found:
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert sum(r["length"] for r in found) == sum(len(ids_of(t)) + 1 for _, t in rows())
    for i, t in rows():
        own = sorted(whole[(i, len(ids_of(t)) + 1)], key=lambda r: r["start"])
        ids = ids_of(t) + [1]
        assert all(crc(ids[r["start"]:r["start"] + r["length"]]) == r["ids_crc32"] for r in own) and pieces
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length and (at == length or at & (at - 1) == 0)


def test_packing_nothing(spark):
    assert curve_packing.pack(docs(spark, [])).count() == 0


def test_like_documents_share_sequences(spark):
    """Texts over two vocabularies: neighbours on the curve are mostly of one kind."""
    kinds = [["alpha beta gamma delta", "house river tree stone"][i % 2] for i in range(200)]
    found = curve_packing.pack(docs(spark, [(i, (k + " ") * 10) for i, k in enumerate(kinds)]), length=512).collect()
    mixed = {}
    for r in found:
        mixed.setdefault(r["sequence_id"], set()).add(r["doc_id"] % 2)
    assert sum(len(v) > 1 for v in mixed.values()) <= len(mixed) / 3
