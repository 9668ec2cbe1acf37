"""Byte-level BPE encoding and decoding with one global shuffle of distinct words.

``encode``:

1. Each block of rows is split into pre-tokens once; every distinct pre-token
   of the block gets a local code, and each row keeps its codes in order of
   position (packed by frequency into one to three bytes each). Codes and
   words are written once, compressed, to the shared folder, in buckets by block,
   so that the codes are not shuffled when the ids come back.
2. The words are shuffled by hash, packed by block and bucket, so equal words
   of all blocks meet and each distinct word is encoded once.
3. The ids go back to their blocks, packed in the same way, and the texts of
   each block are reassembled by position.

A block is named by a hash of its bytes; equal blocks share a name and the
same codes. A block missing its words fails the task instead of losing ids.

``decode`` joins ids with the token-byte table, whose size the vocabulary
bounds: the table is broadcast as arrays and each id looks its bytes up.

Null and empty texts have no ids and decode to no bytes. Repeated rows and
null or repeated ids are kept as they are; other columns are not read.
"""

from __future__ import annotations

import itertools
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmark.llm import exchange, ragged
from cairnmark.llm.merges import ByteMerges, byte_ranks
from cairnmark.llm.shared import in_buckets

#: Bytes of text in a block: its codes and words are in memory at once.
BLOCK = 6 << 20
#: The characters that \s stands for in the pattern.
WHITE = "\t\n\v\f\r \x85\xa0                　"
_LATIN, _MARK = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
#: Cutting before white space, and between Latin letters and ASCII marks but apostrophes, never changes the pattern's matches.
_SEGMENTS = re.compile(f"[{WHITE}]*+(?:[{_LATIN}]++(?=[{_MARK}{WHITE}]|$)|[{_MARK}]++(?=[{_LATIN}{WHITE}]|$)|[^{WHITE}]+)|[{WHITE}]+")


@lru_cache(maxsize=2)
def merges_of(ranks: str) -> ByteMerges:
    return ByteMerges(byte_ranks(ranks))


@lru_cache(maxsize=2)
def splitter(pattern: str):
    """``pattern`` with its \\s written out as the rank files' library reads it."""
    inside = regex.sub(r"\\s", "\\\\s", pattern)
    out, depth = [], False
    for part in regex.findall(r"\\.|.", inside, flags=regex.DOTALL):
        if part == r"\s":
            part = WHITE if depth else f"[{WHITE}]"
        elif part == r"\S":
            part = f"[^{WHITE}]"
        elif part in "[]":
            depth = part == "["
        out.append(part)
    return regex.compile("".join(out)).findall


class _Codes(dict):
    """Segment to the codes of its pre-tokens, in the order in which they are met."""

    def __init__(self, find):
        super().__init__()
        self.find, self.code = find, {}

    def __missing__(self, segment: str) -> tuple[int, ...]:
        code = self.code
        found = self[segment] = tuple([code.setdefault(x, len(code)) for x in self.find(segment)])
        return found


def packed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian groups of seven bits, the last of each number without the high bit; and the bytes of each number."""
    more = (codes >= 1 << 7).astype(np.int64) + (codes >= 1 << 14) + (codes >= 1 << 21)
    width = more + 1
    begin = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    for k in range(4):
        has = more >= k
        out[begin[has] + k] = ((codes[has] >> (7 * k)) & 0x7F) | ((more[has] > k) << 7)
    return out, width


def pack(codes: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Ragged rows of numbers, packed."""
    out, width = packed(codes)
    total = np.concatenate([[0], np.cumsum(width)])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return ragged.lists(out, total[bounds[1:]] - total[bounds[:-1]])


def unpack(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data < 0x80)
    begin = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = (data[begin] & 0x7F).astype(np.int64)
    for k in range(1, 4):
        has = begin + k <= ends
        out[has] |= (data[begin[has] + k] & 0x7F).astype(np.int64) << (7 * k)
    return out


def _coded(pattern: str, buckets: int):
    """One row (block, bucket -1, of, ids, n, codes) for each block and one (block, bucket, words) for each bucket of its words."""

    def work(rows, data, offs):
        raw = data.tobytes()
        block = xxhash.xxh3_64_intdigest(raw + np.ascontiguousarray(offs).tobytes()) - (1 << 63)
        table = _Codes(splitter(pattern))
        get, flat, counts = table.__getitem__, [], []
        for a, b in itertools.pairwise(offs.tolist()):
            at = list(itertools.chain.from_iterable(map(get, _SEGMENTS.findall(raw[a:b].decode()))))
            flat.append(np.array(at, np.int32))
            counts.append(len(at))
        flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        order = np.argsort(-np.bincount(flat, minlength=len(table.code)), kind="stable")
        code = np.empty(len(order), np.int32)
        code[order] = np.arange(len(order), dtype=np.int32)
        words = [x.encode() for x in table.code]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters, sizes = ragged.gather(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(sizes)]), order)
        of, dealt = exchange.deal(letters, np.concatenate([[0], np.cumsum(sizes)]), buckets)
        counts = np.array(counts, np.int64)
        n = 1 + len(dealt)
        once = lambda x, kind: pa.array([x] + [None] * len(dealt), kind)
        ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column("id")).take(pa.array([0] + [None] * len(dealt), pa.int32()))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block)), pa.array([-1, *(b for b, _ in dealt)], pa.int32()), pa.array([None, *(w for _, w in dealt)], pa.binary()), once(exchange.squeeze(of), pa.binary()), ids, once(exchange.squeeze(counts), pa.binary()), once(exchange.squeeze(packed(code[flat])[0]), pa.binary())],
            names=["block", "bucket", "words", "of", "id", "n", "codes"],
        )

    return ragged.mapper(work, target=BLOCK)


def _encode_words(ranks: str):
    """Ids of a bucket's words: each distinct word is encoded once."""

    def work(bucket: exchange.Bucket) -> pa.RecordBatch:
        ids, n = merges_of(ranks).encode(ragged.byte_list(bucket.words))
        offs, kind = np.concatenate([[0], np.cumsum(n)]), "<u2" if len(merges_of(ranks).token_offs) <= 1 << 16 else "<u4"
        out = []
        for a, b in itertools.pairwise(bucket.bounds.tolist()):
            flat, counts = ragged.gather(ids.astype(kind), offs, bucket.at[a:b])
            out.append(exchange.squeeze(np.array([b - a], "<u4"), counts.astype("<u4"), flat))
        return pa.RecordBatch.from_arrays([pa.array(bucket.blocks, pa.int64()), pa.array([bucket.number] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["block", "bucket", "ids"])

    return work


def ids_of(answers: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of several answers, back to back, and where each word's begin."""
    counts, ids = [np.zeros(0, np.uint32)], [np.zeros(0, kind)]
    for raw in map(exchange.swell, answers):
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        counts.append(np.frombuffer(raw, "<u4", n, 4))
        ids.append(np.frombuffer(raw, kind, offset=4 + 4 * n))
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts), dtype=np.int64)])


def token_table(spark: SparkSession, ranks: str):
    """The token-byte table (bytes of all ids back to back, and where each begins), broadcast."""
    table = merges_of(ranks)
    return spark.sparkContext.broadcast((table.token_bytes, table.token_offs))


def _bytes_of(table, ids: np.ndarray, offs: np.ndarray) -> pa.Array:
    """The bytes that each row's ids stand for, by the token-byte table."""
    flat, counts = ragged.gather(*table, ids.astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(counts)])[offs]
    return ragged.lists(flat, np.diff(ends))


def _reassemble(kind: str, table):
    """The ids of a block's texts from their words' ids; with ``table``, also the bytes that these ids stand for."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        out = {"id": [], "n_tokens": [], "ids": []} | ({"decoded": []} if table else {})
        for i in range(texts.num_rows):
            of, counts, codes = (exchange.swell(texts.column(c)[i].as_py()) for c in ("of", "n", "codes"))
            place, chosen = exchange.in_order(np.frombuffer(of, np.uint32), words.column("bucket").to_pylist())
            flat, row = ids_of([words.column("ids")[j].as_py() for j in chosen], kind)
            if len(row) != len(place) + 1:
                raise RuntimeError("a block came without all of its words")
            codes, counts = unpack(codes), np.frombuffer(counts, np.int64)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            ids, n = ragged.gather(flat, row, place[codes])
            total = ragged.row_sums(n, bounds)
            out["id"].append(texts.column("id").combine_chunks()[i].values)
            out["n_tokens"].append(pa.array(total))
            out["ids"].append(ragged.lists(ids.astype("<u4"), total))
            if table:
                out["decoded"].append(_bytes_of(table.value, ids, np.concatenate([[0], np.cumsum(total)])))
        return pa.table({c: pa.chunked_array(x) for c, x in out.items()}) if texts.num_rows else None

    return run


def encode(docs: DataFrame, ranks: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", decoded: bool = False) -> DataFrame:
    """(id, n_tokens, ids): the ids of every text as little-endian unsigned 32-bit integers; with ``decoded``, also as in ``decode``, in the same task."""
    spark = docs.sparkSession
    picked = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    coded = in_buckets(picked.mapInArrow(_coded(pattern, exchange.count(spark, docs)), f"block long, bucket int, words binary, of binary, id array<{kind}>, n binary, codes binary"), "words", min(exchange.count(spark) // 2, 100_000), "block")
    words = exchange.by_bucket(coded.where("bucket >= 0"), _encode_words(ranks), "block long, bucket int, ids binary")
    texts = coded.where("bucket < 0").select("block", "of", "id", "n", "codes")
    narrow = "<u2" if len(merges_of(ranks).token_offs) <= 1 << 16 else "<u4"
    whole = texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_reassemble(narrow, token_table(spark, ranks) if decoded else None), f"id {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded)
    return whole.withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, ranks: str, ids_column: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes its ids stand for, from the token-byte table."""
    others = [c for c in encoded.columns if c != "decoded"]
    table = token_table(encoded.sparkSession, ranks)
    picked = encoded.select(*others)
    schema = picked.withColumn("decoded", F.lit(None).cast("binary")).schema

    def run(batches):
        for batch in batches:
            data, offs = ragged.text_bytes(batch.column(ids_column))
            yield pa.RecordBatch.from_arrays([*batch.columns, _bytes_of(table.value, data.view(np.uint32), offs // 4)], names=[*others, "decoded"])

    return picked.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text."""
    both = encode(docs, ranks, pattern, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
