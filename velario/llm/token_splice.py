"""Token counts of huge texts from overlapping chunks, joined where both chunks agree.

A text of more than ``chunk_chars`` is cut into chunks that overlap. Chunks are
rows of their own, so one huge text is shared by many tasks. Each chunk is
encoded with offsets; in an overlap a *stable boundary* is a place where a token
starts in both encodings and white space comes before it. For a tokenizer whose
pieces never span white space (see ``word_encoder``) that proves that neither
chunk's cut edge reaches across it. The texts are joined at the first such place;
where there is none, the overlap is widened and the text encoded again, in the
end as a whole. Tokenizers without that property always get whole texts.

Cases: null and empty texts have no token; each row is counted by itself, so
repeated rows and equal or missing ids are kept apart; an empty table gives no
row; other columns are not read.
"""

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velario.llm.shared import ENCODED_ROWS, column_bytes, ready, rows_of, saved, small, texts
from velario.llm.word_encoder import encoder

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 512
WIDEN = 16                   # times wider at each retry
_SPACES = " \t\n\v\f\r"

_CHUNK = "key bigint, doc_id bigint, chunk int, n_bytes bigint, n_tokens bigint, start bigint, text string"


def cut(text: str, chunk: int, overlap: int):
    """(start, text) of each chunk; a chunk reaches ``overlap`` into the next."""
    return [(at, text[at:at + chunk + overlap]) for at in range(0, max(len(text), 1), chunk)]


def _first_cut(docs, tokenizer, chunk, overlap):
    """Counts of ordinary texts, and the chunks of huge ones."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("n_bytes", pa.int64()),
                        ("n_tokens", pa.int64()), ("start", pa.int64()), ("text", pa.string())])

    def run(batches):
        coder = encoder(tokenizer)
        key = TaskContext.get().partitionId() << 40
        for batch in small(batches, ENCODED_ROWS):
            out = {f.name: [] for f in schema}
            data = column_bytes(batch, "text")
            # fewer bytes than the limit: surely not more characters
            whole = [not coder.wordwise or len(t) <= chunk or len(t.decode()) <= chunk for t in data]
            counts = iter(coder.count_many([t for t, w in zip(data, whole) if w]))
            for doc_id, text, is_whole in zip(batch.column("doc_id").to_pylist(), data, whole):
                parts = [(0, None)] if is_whole else cut(text.decode(), chunk, overlap)
                for i, (start, part) in enumerate(parts):
                    row = (key, doc_id, i, len(text), next(counts) if is_whole else None, start, part)
                    for name, value in zip(out, row):
                        out[name].append(value)
                key += 1
            yield rows_of(out, schema)

    return docs.mapInArrow(run, _CHUNK)


_EDGES = ("key bigint, doc_id bigint, chunk int, n_bytes bigint, start bigint, total bigint, "
          "head array<bigint>, head_before array<bigint>, tail array<bigint>, tail_after array<bigint>")


def _encode_chunks(chunks, tokenizer, chunk, overlap):
    """Tokens of each chunk, and its stable starts in the overlaps: at its head
    with the tokens before each, at its tail with the tokens from each on."""
    names = ["key", "doc_id", "chunk", "n_bytes", "start"]

    def run(batches):
        library = encoder(tokenizer).library
        for batch in small(batches):
            out = {n: [] for n in ("total", "head", "head_before", "tail", "tail_after")}
            for at, text in zip(batch.column("start").to_pylist(), batch.column("text").to_pylist()):
                found = library.encode(text, add_special_tokens=False)
                n = len(found.ids)
                stable = [(at + s, i) for i, (s, _) in enumerate(found.offsets) if s and text[s - 1] in _SPACES
                          and (s < overlap or s >= chunk)]
                head = [(x, i) for x, i in stable if x - at < overlap]
                tail = [(x, n - i) for x, i in stable if x - at >= chunk]
                for name, value in (("total", n), ("head", [x for x, _ in head]),
                                    ("head_before", [i for _, i in head]), ("tail", [x for x, _ in tail]),
                                    ("tail_after", [i for _, i in tail])):
                    out[name].append(value)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(out["total"], pa.int64())]
                + [pa.array(out[n], longs) for n in ("head", "head_before", "tail", "tail_after")],
                names=names + list(out))

    return chunks.mapInArrow(run, _EDGES)


def splice(edges: DataFrame) -> DataFrame:
    """``(key, doc_id, n_bytes, n_tokens)``; n_tokens is null where a pair of
    neighbouring chunks has no common stable boundary."""
    order = Window.partitionBy("key").orderBy("chunk")
    common = F.get(F.array_intersect("tail", F.col("next_head")), F.lit(0))
    pairs = edges.select("*", F.lead("head").over(order).alias("next_head"),
                         F.lead("head_before").over(order).alias("next_before")).withColumn("at", common)
    doubled = (F.element_at("tail_after", F.array_position("tail", F.col("at")).cast("int"))
               + F.element_at("next_before", F.array_position("next_head", F.col("at")).cast("int")))
    pairs = pairs.select("key", "doc_id", "n_bytes", "total",
                         F.when(F.col("next_head").isNull(), F.lit(0)).otherwise(doubled).alias("doubled"))
    return pairs.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"),
        F.when(F.count("doubled") == F.count(F.lit(1)), F.sum(F.col("total") - F.col("doubled"))).alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer="word_bpe_49k.json", chunk_chars=CHUNK_CHARS,
                 overlap_chars=OVERLAP_CHARS) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` of every whole text."""
    ready(docs.sparkSession)
    source = texts(docs)
    first = saved(_first_cut(source, tokenizer, chunk_chars, overlap_chars), "token_chunks")
    parts = [first.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens")]
    chunks = first.where("n_tokens is null")
    chunk, overlap = chunk_chars, min(overlap_chars, chunk_chars)
    while True:
        # chunks of one text meet again only as short lists of boundaries
        edges = _encode_chunks(chunks.repartition("key", "chunk"), tokenizer, chunk, overlap)
        spliced = saved(splice(edges), "token_splices")
        parts.append(spliced.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens"))
        left = spliced.where("n_tokens is null").select("key")
        if left.isEmpty():
            break
        overlap *= WIDEN
        chunk = max(chunk, 2 * overlap)
        chunks = _rechunk(first.where("n_tokens is null").join(left, "key", "left_semi"), chunk_chars, chunk, overlap)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _rechunk(chunks, old, chunk, overlap):
    """The same texts cut anew with a wider overlap. A text that still resists at
    the width of a whole text is one chunk then, which is always right."""
    whole = chunks.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))),
                                 lambda c: F.substring(c["text"], 1, old)), "").alias("text"))
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("n_bytes", pa.int64()),
                        ("n_tokens", pa.int64()), ("start", pa.int64()), ("text", pa.string())])

    def run(batches):
        for batch in small(batches):
            for key, doc_id, n_bytes, text in zip(*(batch.column(n).to_pylist()
                                                    for n in ("key", "doc_id", "n_bytes", "text"))):
                for i, (start, part) in enumerate(cut(text, chunk, overlap)):
                    yield rows_of(dict(zip(schema.names, ([key], [doc_id], [i], [n_bytes], [None], [start], [part]))),
                                  schema)

    return whole.mapInArrow(run, _CHUNK)
