"""Benchmark contamination by winnowed fingerprints.

Words are lower-cased (A-Z). A window is ``window`` consecutive words of an
item; an item of fewer words, but not none, is one window. Windows of L words
are found with k-grams of k = ceil(L / 2) words, of which the smallest hash of
every L - k + 1 successive ones is kept (the rightmost of equals), so documents
and items that share a window keep the same k-gram inside it.

1. Both sides are winnowed alike. Document fingerprints pass a Bloom filter of
   the benchmark's (at most ``FILTER_BITS`` bits, whatever the benchmark's
   size), so only likely hits are shuffled, each with the words around it.
2. The two sides are joined on the fingerprint. The benchmark side is one row
   per fingerprint and distinct context, so the join is split where a
   fingerprint is hot.
3. Each hit is extended word by word to both sides, on the words themselves; a
   run as long as a window marks its words as hit.

Null texts have no words and are never hit. Repeated rows are judged each on
its own, whatever their ids; null ids stay null. Repeated items count once,
null item ids are not listed or counted but their windows still hit. Other
columns are not read. A document is contaminated if it has a hit word and
``SHARE`` times its hit words are at least its words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnmark.llm import ragged
from cairnmark.llm.shared import cut

WINDOW, SHARE = 13, 20
FILTER_BITS = 1 << 27


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Positions of the rightmost smallest value of every ``width`` successive ones."""
    n = len(values) - width + 1
    best = values[:n].copy()
    at = np.arange(n)
    for j in range(1, width):
        less = values[j : j + n] <= best
        best[less] = values[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    return at


def winnow(hashes: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept k-grams of windows of ``length`` words: the index of their first word, and their hashes."""
    k = -(-length // 2)
    width = length - k + 1
    if len(hashes) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(hashes) - k + 1
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    grams = ragged.mix(grams + np.uint64(length))
    begins = np.arange(len(hashes) - length + 1)
    owner = np.searchsorted(bounds, begins, side="right")
    inside = bounds[np.minimum(owner, len(bounds) - 1)] >= begins + length
    kept = np.unique(_lowest(grams, width)[inside])
    return kept, grams[kept]


def _context(raw: bytes, starts: np.ndarray, ends: np.ndarray, lo: int, hi: int) -> str:
    return " ".join([raw[a:b].decode() for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)])


def _prints(lengths: list[int], window: int, bloom, whole: bool):
    """Rows (uid, id, n_words, length, fp, at, left, words): one without a fingerprint for each text, and one for each kept k-gram that ``bloom`` has."""

    def work(rows, data, offs):
        low = ragged.LOWER[data]
        starts, ends, first = ragged.words(low, offs, ragged.ALNUM)
        raw = low.tobytes()
        hashes = ragged.span_hash(ragged.prefix(low), starts, ends)
        n = np.diff(first)
        cols: dict[str, list] = {c: [] for c in ("row", "length", "fp", "at", "left", "words")}
        for length in lengths:
            kept, fps = winnow(hashes, first[1:], length)
            if bloom is not None and len(kept):
                hit = bloom(fps)
                kept, fps = kept[hit], fps[hit]
            owner = np.searchsorted(first, kept, side="right") - 1
            if whole:  # items: only their own window length counts
                own = np.minimum(n[owner], window) == length
                kept, fps, owner = kept[own], fps[own], owner[own]
            k = -(-length // 2)
            lo = np.maximum(kept - (length - k), first[owner])
            hi = np.minimum(kept + length, first[owner + 1])
            cols["row"] += owner.tolist()
            cols["length"] += [length] * len(kept)
            cols["fp"] += fps.view(np.int64).tolist()
            cols["at"] += (kept - first[owner]).tolist()
            cols["left"] += (kept - lo).tolist()
            cols["words"] += [_context(raw, starts, ends, a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        each = rows.num_rows
        take = pa.array(list(range(each)) + cols["row"], pa.int64())
        none = [None] * each
        return pa.RecordBatch.from_arrays(
            [rows.column("uid").take(take), rows.column("id").take(take), pa.array(n.tolist() + n[np.array(cols["row"], np.int64)].tolist(), pa.int64()), pa.array(none + cols["length"], pa.int32()), pa.array(none + cols["fp"], pa.int64()), pa.array(none + cols["at"], pa.int64()), pa.array(none + cols["left"], pa.int32()), pa.array(none + cols["words"], pa.string())],
            names=["uid", "id", "n_words", "length", "fp", "at", "left", "words"],
        )

    return ragged.mapper(work)


class Bloom:
    """Two probes into a bit set that the benchmark's fingerprints fill."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.mask = words, np.uint64(bits - 1)

    def __call__(self, fps: np.ndarray) -> np.ndarray:
        found = np.ones(len(fps), bool)
        for at in (fps & self.mask, (fps >> np.uint64(32)) & self.mask):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def _bloom(prints: DataFrame) -> Bloom:
    n = prints.count()
    bits = 1 << 20
    while bits < min(64 * n, FILTER_BITS):
        bits *= 2
    at = F.explode(F.array(F.col("fp").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(bits - 1))))
    set_bits = prints.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    rows = set_bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # FILTER_BITS / 64 rows at most
    words = np.zeros(bits // 64, np.uint64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return Bloom(words, bits)


def _extend(frames):
    """Joined hits to runs of at least a window's words: (uid, item_id, lo, hi)."""
    for pdf in frames:
        out = []
        for uid, item, length, at, left, words, other_left, other in zip(pdf["uid"], pdf["item_id"], pdf["length"], pdf["at"], pdf["left"], pdf["words"], pdf["item_left"], pdf["item_words"], strict=True):
            a, b = words.split(" "), other.split(" ")
            k = -(-length // 2)
            if a[left : left + k] != b[other_left : other_left + k]:
                continue
            back = 0
            while back < min(left, other_left) and a[left - back - 1] == b[other_left - back - 1]:
                back += 1
            on, most = k, min(len(a) - left, len(b) - other_left)
            while on < most and a[left + on] == b[other_left + on]:
                on += 1
            if back + on >= length:
                out.append((uid, item, at - back, at + on))
        if out:
            found = pd.DataFrame(out, columns=["uid", "item_id", "lo", "hi"])
            found["item_id"] = found["item_id"].astype("string")
            yield found.drop_duplicates()


def _covered(ranges) -> F.Column:
    """How many words lie in any of the (lo, hi) structs."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda acc, r: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), r["hi"] - F.greatest(acc["end"], r["lo"]))).alias("n"), F.greatest(acc["end"], r["hi"]).alias("end"))
    return F.aggregate(F.array_sort(ranges), start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, uid) of every row of ``docs`` (doc_id, text) against ``benchmark`` (item_id, text)."""
    schema = "uid long, id {}, n_words long, length int, fp long, at long, left int, words string"
    items = benchmark.select(F.lit(0).cast("long").alias("uid"), benchmark["item_id"].cast("string").alias("id"), benchmark["text"].alias("text"))
    items = cut(items.mapInArrow(_prints(list(range(1, window + 1)), window, None, True), schema.format("string")))
    lengths = [r.length for r in items.where("length is not null").select("length").distinct().collect()]  # ``window`` rows at most
    items = items.where("fp is not null")
    index = items.select("length", "fp", F.col("id").alias("item_id"), F.col("left").alias("item_left"), F.col("words").alias("item_words")).distinct()
    picked = docs.select(F.monotonically_increasing_id().alias("uid"), docs["doc_id"].alias("id"), docs["text"].alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    prints = cut(picked.mapInArrow(_prints(sorted(lengths), window, _bloom(items), False), schema.format(kind)))
    hits = prints.where("fp is not null").join(index, ["length", "fp"]).select("uid", "item_id", "length", "at", "left", "words", "item_left", "item_words")
    runs = hits.mapInPandas(_extend, "uid long, item_id string, lo long, hi long")
    marked = runs.groupBy("uid").agg(_covered(F.collect_set(F.struct("lo", "hi"))).alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    found = prints.where("fp is null").join(marked, "uid", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "uid",
    )
