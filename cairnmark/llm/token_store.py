"""Token ids in binary shards with a minimal perfect hash index.

``write_store`` deals texts by ranges of ids, encodes each range in order and
writes two tables:

* ``shards``: payloads of about ``SHARD`` raw little-endian ids (16 bits each
  where the vocabulary allows, else 32), with the keys and lengths of their
  documents, in buckets by range. A document is never split.
* ``index``: one row for each bucket of about ``BUCKET`` keys, with the
  displacements of a minimal perfect hash (hash and displace) and, slot by
  slot, a stored 32-bit fingerprint, the shard, the offset in it and the length.
  Keys whose hashes clash under one seed are hashed anew under the next.

``lookup`` finds a key by one bucket, one displacement and one slot, whatever
the size of the store; a fingerprint that differs means that the key is absent.
``read_documents`` returns the ids of located documents: only the locations
are shuffled, to where the shards lie.

Spark's own writers commit the files, so a lost executor leaves no half shard.
Texts are encoded by the tokenizer library, each distinct run of characters
without white space once per cache: the tokenizers supported drop white space
and never join across it. Null and empty texts have the end id alone. Ids are
integers or null; null sorts first. Rows that share an id are ordered and
numbered by the XXH64 of their texts, so an id with a third of all rows is
dealt in several ranges like any others, and are found by (id, copy). Other
columns are not read.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import string
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnmark.llm import ragged
from cairnmark.llm.shared import in_buckets, written

SHARD, BUCKET, CACHE, TOGETHER = 1 << 20, 4096, 100_000, 500
#: Words of letters alone in a text; texts that the library holds at a time, for what it keeps of a token is many times the size of its id.
SPACED, AT_ONCE = 100, 16
#: Bytes of text in a range of ids, where the shuffle partitions would make them larger.
RANGE = 64 << 20
_WHITE = np.zeros(256, bool)
_WHITE[list(b" \n\t\r")] = True
_LETTER, _MARK = 1, 2


class _Ids:
    """Runs to their ids in ``flat``; new ones are encoded together."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        split = (rules["pre_tokenizer"].get("pretokenizers") or [rules["pre_tokenizer"]])[0]
        pattern = split.get("pattern", {}).get("Regex", "")
        joins = r"\s" in pattern.replace(r"[^\s\p{L}\p{N}]", "") or "." in pattern or not split.get("invert")
        special = "".join(t["content"] for t in rules["added_tokens"])
        if split["type"] != "Split" or joins or special.split() != [special] * bool(special) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in rules["added_tokens"]):
            raise ValueError("only tokenizers that drop white space and never join across it are supported")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in rules["added_tokens"]]
        between = [t for t in rules["added_tokens"] if t["special"] and not t["normalized"]]
        self.between, self.mark = (between[0]["content"], between[0]["id"]) if between else ("", -1)
        self.size = self.tokenizer.get_vocab_size()
        self.ending = self._ending(rules)
        self.kind = np.zeros(256, np.int8)
        if "Lowercase" in json.dumps(rules["normalizer"]):  # between ASCII letters and marks a pre-token always ends, but for apostrophes
            self.kind[0x21:0x7F] = _MARK
            self.kind[0x30:0x3A] = 0
            self.kind[0x41:0x5B] = self.kind[0x61:0x7B] = _LETTER
            self.kind[[c for c in (special + "'<>").encode() if self.kind[c] == _MARK]] = 0
        self.place: dict[bytes, int] = {}
        self.flat, self.offs = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _ending(self, rules: dict) -> np.ndarray | None:
        """Of each id whether it ends a word, where the model marks that and has such a token for every ASCII letter."""
        suffix = rules["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        letters = string.ascii_lowercase if "Lowercase" in json.dumps(rules["normalizer"]) else string.ascii_letters
        if not suffix or any(c + suffix not in vocabulary for c in letters) or any(t.isalpha() for t in self.special):
            return None
        ending = np.zeros(max(vocabulary.values()) + 1, bool)
        ending[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return ending

    def runs(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs without white space; those of ASCII letters and marks alone are cut between these."""
        starts, ends, _ = ragged.words(data, offs, ~_WHITE)
        kind = self.kind[data]
        others = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
        np.cumsum((kind == 0) & ~_WHITE[data], out=others[1:])
        cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
        run = np.searchsorted(starts, cut, side="right") - 1
        cut = cut[(others[ends[run]] == others[starts[run]]) & (cut > starts[run])] if len(starts) else cut[:0]
        return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))

    def _held(self, texts: list[str]) -> list[np.ndarray]:
        coded = []
        for i in range(0, len(texts), AT_ONCE):
            coded += [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)]
        return coded

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of words of ASCII letters, parted where a token ends a word; None if the library does not end one for each."""
        coded = self._held([" ".join(words[i : i + SPACED]) for i in range(0, len(words), SPACED)])
        flat = np.concatenate([np.zeros(0, np.int64), *coded])
        last = self.ending[flat]
        n = np.diff(np.flatnonzero(last), prepend=-1)
        return (flat, n) if len(n) == len(words) and (not len(flat) or last[-1]) else None

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of words back to back, and how many each has; a special token between words parts their ids, or white space where a token ends every word."""
        odd = re.compile("|".join(map(re.escape, self.special)) if self.between else "").search
        kind = np.array([0 if w.isascii() and w.isalpha() else 1 if odd(w) is None else 2 for w in words], np.int8)
        of = lambda k: [words[i] for i in np.flatnonzero(kind == k)]
        spaced = self._spaced(of(0)) if self.ending is not None else None
        if spaced is None:
            kind[kind == 0] = [1 if odd(w) is None else 2 for w in of(0)]
            spaced = np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = of(1)
        coded = self._held([self.between.join(joined[i : i + TOGETHER]) for i in range(0, len(joined), TOGETHER)])
        flat = np.concatenate([np.zeros(0, np.int64), *(np.append(x, self.mark) for x in coded)])
        n = np.diff(np.flatnonzero(flat == self.mark), prepend=-1) - 1
        if len(n) != len(joined):
            raise RuntimeError("the library gave other words than it got")
        alone = self._held(of(2))
        ids = np.concatenate([spaced[0], flat[flat != self.mark], *alone])
        n = np.concatenate([spaced[1], n, np.array([len(x) for x in alone], np.int64)])
        order = np.argsort(kind, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return ragged.gather(ids, np.concatenate([[0], np.cumsum(n)]), back)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts back to back, and how many each has."""
        starts, ends = self.runs(data, offs)
        bounds = np.concatenate([[0], np.cumsum(ends - starts)])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[~_WHITE[data]])]).dictionary_encode()
        distinct = ragged.byte_list(coded.dictionary)
        if len(self.place) > CACHE:  # what is met again stays
            again = [x for x in distinct if x in self.place]
            self.flat, n = ragged.gather(self.flat, self.offs, np.array([self.place[x] for x in again], np.int64))
            self.offs = np.concatenate([[0], np.cumsum(n)])
            self.place = dict(zip(again, range(len(again)), strict=True))
        new = [x for x in distinct if x not in self.place]
        if new:
            ids, n = self._library([x.decode() for x in new])
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, ids])
            self.offs = np.concatenate([self.offs, self.offs[-1] + np.cumsum(n)])
        place = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        flat, counts = ragged.gather(self.flat, self.offs, place[np.asarray(coded.indices, np.int64)])
        return flat, ragged.row_sums(counts, np.searchsorted(starts, offs))


@lru_cache(maxsize=2)
def _ids(path: str) -> _Ids:
    return _Ids(path)


@dataclass
class Store:
    """The tables of a written store, and what their readers need to know."""

    shards: DataFrame
    index: DataFrame
    starts: DataFrame
    buckets: int
    dtype: str


def _shards(path: str, end_id: int, dtype: str, shard: int):
    """Rows of a range in order of id to shards; ``copies`` numbers the rows of one id in the range."""

    def run(batches):
        part, seq, base, size = TaskContext.get().partitionId(), 0, 0, 0
        keys: list = []
        copies: list[int] = []
        lengths: list[int] = []
        payload: list[bytes] = []
        last, copy = object(), 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([base], pa.int64()), pa.array([size], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([copies], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([b"".join(payload)], pa.binary())],
                names=["part", "seq", "base", "n_ids", "keys", "copies", "lengths", "payload"],
            )

        for batch in batches:
            for rows, data, offs in ragged.blocks(batch):
                ids, n = _ids(path).encode(data, offs)
                ends = np.cumsum(n + 1)
                out = np.full(int(ends[-1]), end_id, dtype)
                body = np.ones(len(out), bool)
                body[ends - 1] = False
                out[body] = ids
                for key, a, b in zip(rows.column("id").to_pylist(), (ends - n - 1).tolist(), ends.tolist(), strict=True):
                    if payload and size + b - a > shard:
                        yield row()
                        seq, base, size, keys, copies, lengths, payload = seq + 1, base + size, 0, [], [], [], []
                    copy = copy + 1 if key == last else 0
                    last = key
                    keys.append(key)
                    copies.append(copy)
                    lengths.append(b - a)
                    payload.append(out[a:b].tobytes())
                    size += b - a
        if payload:
            yield row()
        ragged.release()

    return run


def _starts(shards: DataFrame) -> DataFrame:
    """(part, before, lead, copies): ids and copies of the key ``lead``, its first, in the ranges before each."""
    first, last = F.element_at("keys", 1), F.element_at("keys", -1)
    ends = shards.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min_by(first, "seq").alias("lead"), F.max_by(last, "seq").alias("last"), F.max_by(F.element_at("copies", -1), "seq").alias("copy"))
    out, before, last, copies = [], 0, object(), 0
    for r in sorted(ends.collect(), key=lambda r: r.part):  # one row for each range
        lead_copies = copies if r.lead == last else 0
        out.append((r.part, before, r.lead, lead_copies))
        copies = r.copy + 1 + (lead_copies if r.last == r.lead else 0)
        before, last = before + r.n, r.last
    return shards.sparkSession.createDataFrame(out, "part int, before long, lead long, lead_copies long")


def _hashes(keys: list, copies: list) -> np.ndarray:
    """Two 64-bit hashes of each (key, copy)."""
    raw = b"".join([xxhash.xxh3_128_digest(f"{k}#{c}") for k, c in zip(keys, copies, strict=True)])
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


def _slots(h: np.ndarray, displaced: np.ndarray, n: int) -> np.ndarray:
    return (ragged.mix(h + displaced.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def perfect_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements by group and the slot of each of the distinct hashes ``h``: a bijection onto range(len(h))."""
    n = len(h)
    groups = n // 4 + 1
    group = (h % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=groups))
    sizes = np.diff(np.concatenate([[0], ends]))
    displaced, slot, free = np.zeros(groups, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for g in np.argsort(-sizes, kind="stable"):
        if not sizes[g]:
            break
        members = order[ends[g] - sizes[g] : ends[g]]
        begin, step = 0, 64
        while True:
            tries = np.arange(begin, begin + step)
            at = _slots(h[members][:, None], tries[None, :], n)
            good = free[at].all(axis=0)
            if sizes[g] > 1:
                in_order = np.sort(at, axis=0)
                good &= (in_order[1:] != in_order[:-1]).all(axis=0)
            found = np.flatnonzero(good)
            if len(found):
                displaced[g] = tries[found[0]]
                slot[members] = at[:, found[0]]
                free[slot[members]] = False
                break
            begin, step = begin + step, min(2 * step, 1 << 14)
            if begin > 1 << 24:
                raise RuntimeError("two keys have equal hashes")
    return displaced, slot


def _seeded(h: np.ndarray, check: np.ndarray, seed: int) -> np.ndarray:
    """One hash of both, another for each seed."""
    return ragged.mix(h ^ ragged.mix(check + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)))


def _located(shards: DataFrame, starts: DataFrame, buckets: int) -> DataFrame:
    """Where each (key, copy) lies, with its bucket."""

    def run(batches):
        for batch in batches:
            for part, seq, lead, before, keys, copies, lengths in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "lead", "lead_copies", "keys", "copies", "lengths")), strict=True):
                copies = [c + before if k == lead else c for k, c in zip(keys, copies, strict=True)]
                h = _hashes(keys, copies)
                n = np.array(lengths, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((h[:, 0] % np.uint64(buckets)).astype(np.int64)), pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64)), pa.array(np.full(len(n), part, np.int32)), pa.array(np.full(len(n), seq, np.int32)), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(keys, pa.int64()), pa.array(copies, pa.int64())],
                    names=["bucket", "h", "check", "part", "seq", "at", "n", "key", "copy"],
                )

    picked = shards.select("part", "seq", "keys", "copies", "lengths").join(starts, "part")
    return picked.mapInArrow(run, "bucket long, h long, check long, part int, seq int, at long, n long, key long, copy long")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    h, check = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("h", "check"))
    seed = next((s for s in range(64) if len(np.unique(_seeded(h, check, s))) == len(h)), None)
    if seed is None:
        raise RuntimeError("two keys have equal hashes of 128 bits")
    displaced, slot = perfect_hash(_seeded(h, check, seed))
    order = np.argsort(slot)
    column = lambda c, kind: [pdf[c].to_numpy()[order].astype(kind).tobytes()]
    prints = [(check[order] >> np.uint64(32)).astype("<u4").tobytes()]
    ragged.release()
    return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "n_keys": [len(h)], "seed": [seed], "displaced": [displaced.astype("<u4").tobytes()], "prints": prints, "parts": column("part", "<i4"), "seqs": column("seq", "<i4"), "ats": column("at", "<i8"), "ns": column("n", "<i4")})


def write_store(docs: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", shard: int = SHARD) -> Store:
    """Writes the store of ``docs`` to the shared folder."""
    spark = docs.sparkSession
    picked = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].alias("text"))
    dtype = "<u2" if max(_ids(tokenizer).size, end_id + 1) <= 1 << 16 else "<u4"
    size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))
    order = [F.asc_nulls_first("id"), F.asc("tie")]
    ranges = picked.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")
    rows = ranges.mapInArrow(_shards(tokenizer, end_id, dtype, shard), "part int, seq int, base long, n_ids long, keys array<long>, copies array<long>, lengths array<int>, payload binary")
    shards = in_buckets(rows, "shards", min(parts, 100_000), "part")
    starts = _starts(shards)
    n = shards.agg(F.sum(F.size("keys"))).first()[0] or 0
    buckets = max(1, -(-n // BUCKET))
    index = written(_located(shards, starts, buckets).groupBy("bucket").applyInPandas(_build, "bucket long, n_keys long, seed int, displaced binary, prints binary, parts binary, seqs binary, ats binary, ns binary"), "index")
    return Store(shards, index, starts, buckets, dtype)


def keys_of(store: Store) -> DataFrame:
    """(key, copy) of every document of the store."""
    return _located(store.shards, store.starts, store.buckets).select("key", "copy")


def lookup(store: Store, keys: DataFrame) -> DataFrame:
    """(key, copy, part, seq, at, n) of the rows of ``keys`` (key, copy) that the store has."""
    buckets = store.buckets

    def hashed(frames):
        for pdf in frames:
            h = _hashes([None if pd.isna(k) else int(k) for k in pdf["key"]], pdf["copy"].tolist())
            yield pdf.assign(bucket=(h[:, 0] % np.uint64(buckets)).astype(np.int64), h=h[:, 0].view(np.int64), check=h[:, 1].view(np.int64))[["bucket", "h", "check", "key", "copy"]]

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["key", "copy", "part", "seq", "at", "n"]
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in names})
        row = right.iloc[0]
        n, displaced = int(row["n_keys"]), np.frombuffer(row["displaced"], "<u4").astype(np.int64)
        h = _seeded(left["h"].to_numpy(np.int64).view(np.uint64), left["check"].to_numpy(np.int64).view(np.uint64), int(row["seed"]))
        slot = _slots(h, displaced[(h % np.uint64(len(displaced))).astype(np.int64)], n)
        here = np.frombuffer(row["prints"], "<u4")[slot] == (left["check"].to_numpy(np.int64).view(np.uint64) >> np.uint64(32))
        found = {"key": left["key"].array, "copy": left["copy"].array}
        for name, column, kind in (("part", "parts", "<i4"), ("seq", "seqs", "<i4"), ("at", "ats", "<i8"), ("n", "ns", "<i4")):
            found[name] = np.frombuffer(row[column], kind)[slot]
        ragged.release()
        return pd.DataFrame(found)[here]

    wanted = keys.select(F.col("key").cast("long"), F.col("copy").cast("long")).mapInPandas(hashed, "bucket long, h long, check long, key long, copy long")
    return wanted.groupBy("bucket").cogroup(store.index.groupBy("bucket")).applyInPandas(find, "key long, copy long, part int, seq int, at long, n long")


def read_documents(store: Store, located: DataFrame) -> DataFrame:
    """(key, copy, start, ids) of located documents: ``start`` counts the ids of all documents before, ``ids`` are little-endian unsigned 32-bit integers."""
    dtype = store.dtype

    def slices(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list] = {c: [] for c in ("key", "copy", "start", "ids")}
        for seq, base, payload in zip(right["seq"], right["base"], right["payload"], strict=True):
            ids, here = np.frombuffer(payload, dtype), left[left["seq"] == seq]
            found["key"] += here["key"].tolist()
            found["copy"] += here["copy"].tolist()
            found["start"] += (base + here["at"] + here["before"]).tolist()
            found["ids"] += [ids[a : a + n].astype("<u4").tobytes() for a, n in zip(here["at"], here["n"], strict=True)]
        ragged.release()
        return pd.DataFrame(found)

    located = located.join(store.starts.select("part", "before"), "part")
    shards = store.shards.select("part", "seq", "base", "payload")
    return located.groupBy("part").cogroup(shards.groupBy("part")).applyInPandas(slices, "key long, copy long, start long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, found through the index and read from the shards."""
    store = write_store(docs, tokenizer, end_id)
    read = read_documents(store, lookup(store, keys_of(store)))
    return read.select(F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
