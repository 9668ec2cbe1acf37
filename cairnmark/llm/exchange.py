"""Distinct words of many blocks meet in one shuffle, packed.

A block of texts numbers its distinct words. ``deal`` splits them by hash into
buckets; the words of a block in a bucket are one compressed row. The rows of
a bucket meet in one task, which sees every distinct word once
(``by_bucket``) and sends the answers back as one row for each block, in the
order in which the words came. A word has at most one entry for each block,
so none is hot, and a bucket's size is the words' over the number of buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from cairnmark.llm import ragged


#: Bytes of words in a bucket, bytes of text for a byte of files, and sizes that are Spark's word for an unknown one.
BUCKET, UNPACKED, UNKNOWN = 256 << 20, 4, 1 << 60


def squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x).tobytes() for x in arrays))


def swell(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def count(spark: SparkSession, docs: DataFrame | None = None) -> int:
    """Buckets of a session: two for each shuffle partition, or as many as hold the words of ``docs`` at ``BUCKET`` bytes each, if that is more and Spark knows the size of its files."""
    least = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if docs is not None else 0
    return max(least, UNPACKED * size // BUCKET) if size < UNKNOWN else least


def deal(data: np.ndarray, offs: np.ndarray, buckets: int, *others: np.ndarray) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """The bucket of each word, and (bucket, packed words) of those that are not empty; ``others`` are packed beside them."""
    of = (ragged.span_hash(ragged.prefix(data), offs[:-1], offs[1:]) % np.uint64(buckets)).astype(np.uint32)
    order = np.argsort(of, kind="stable")
    flat, size = ragged.gather(data, offs, order)
    ends = np.concatenate([[0], np.cumsum(size)])
    bounds = np.append(np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]])), len(order)) if len(order) else np.zeros(1, np.int64)
    rows = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        head = np.array([b - a], "<u4")
        rows.append((int(of[order[a]]), squeeze(head, size[a:b].astype("<u4"), *(x[order[a:b]].astype("<u4") for x in others), flat[ends[a] : ends[b]])))
    return of, rows


@dataclass
class Bucket:
    """The words of a bucket: ``words`` are distinct, ``at`` names the one of each entry, ``bounds`` cut the entries by ``blocks``."""

    number: int
    blocks: list[int]
    bounds: np.ndarray
    at: np.ndarray
    words: pa.Array
    others: list[np.ndarray]


def _bucket(number: int, rows: list[tuple[int, bytes]], others: int) -> Bucket:
    parts: list[list[np.ndarray]] = [[] for _ in range(2 + others)]
    for _, raw in rows:
        raw = swell(raw)
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        head = np.frombuffer(raw, "<u4", n * (1 + others), 4).reshape(1 + others, n)
        for part, x in zip(parts, [*head, np.frombuffer(raw, np.uint8, offset=4 + 4 * n * (1 + others))], strict=True):
            part.append(x)
    size, *beside, flat = map(np.concatenate, parts)
    offs = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts[0]])])
    return Bucket(number, [b for b, _ in rows], bounds, np.asarray(coded.indices, np.int64), coded.dictionary, beside)


def by_bucket(rows: DataFrame, work, schema: str, others: int = 0) -> DataFrame:
    """Applies ``work(bucket)``, which gives a record batch, to the rows (block, bucket, words) of every bucket."""

    def run(batches):
        number, held = None, []
        for batch in batches:
            for block, bucket, words in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "words")), strict=True):
                if bucket != number and held:
                    yield work(_bucket(number, held, others))
                    held = []
                number = bucket
                held.append((block, words))
        if held:
            yield work(_bucket(number, held, others))
        ragged.release()

    partitions = count(rows.sparkSession) // 2
    return rows.select("block", "bucket", "words").repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def in_order(of: np.ndarray, buckets: list[int]) -> tuple[np.ndarray, list[int]]:
    """Place of each word's answer among a block's answers joined by ascending bucket, and which answers those are (equal blocks bring equal ones)."""
    place = np.empty(len(of), np.int64)
    place[np.argsort(of, kind="stable")] = np.arange(len(of))
    chosen = {b: i for i, b in enumerate(buckets)}
    if len(np.setdiff1d(of, np.fromiter(chosen, np.int64, len(chosen)))):
        raise RuntimeError("a block came without its words")
    return place, [chosen[b] for b in sorted(chosen)]
