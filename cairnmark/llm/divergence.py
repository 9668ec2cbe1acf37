"""How far the sources of each language are apart, and by which terms.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased. A language
keeps the terms of at least ``LEAST`` of its documents. A group is a source of
a language; each kept term has a share in it, smoothed and in whole parts of
``SCALE``: ``1 + floor(SCALE * (count + 2) / (N + 2 * V))``, where N counts the
group's kept terms and V the language's. The divergence of two shares p and q
is ``floor((p - q) ** 2 / (p + q))``, of two sources its sum over all kept
terms. All arithmetic is on whole numbers and exact up to 9e15 terms a group.

A kept term is the vector of its counts by source (sources without it left
out). Many terms share a vector: equal ones are counted in Spark first, every
pair of sources is evaluated once for each distinct vector, in numpy, and
multiplied by the number of its terms. A term's own divergence from its
language follows from its vector too, so of every vector only the ``TOP``
smallest terms can be among the first of a source; those are ranked.

Distinct vectors are dealt by their hash into pieces of about ``PIECE``, each
beside its language's sources, so that no language, source or vector meets in
one task. A vector has at most as many entries as its language has sources, and
the result has the square of that by its contract; a task holds the sums of
a few rows of that square at a time.

Null texts, languages and sources are empty ones. A source without terms, or of
a language that keeps none, has divergences too (0 in the latter). Repeated
rows count each time. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnmark.llm import ragged
from cairnmark.llm.shared import written

LEAST, SCALE, TOP, PIECE = 10, 10**9, 10, 1 << 13
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_BLOCK, _CELLS = 1 << 23, 1 << 20


def _codes(*columns: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """A number for each distinct combination of the columns' values, and a row that has it."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        found = c.dictionary_encode()
        code = code * max(1, len(found.dictionary)) + np.asarray(found.indices, np.int64)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of ``docs`` (lang, source, text) without nulls: occurrences and documents with them."""

    def count(rows, data, offs):
        starts, ends, first = ragged.words(data, offs, _LETTER)
        group, some = _codes(rows.column("lang"), rows.column("source"))
        spans = np.stack([starts, ends], 1).ravel()
        flat, size = ragged.gather(ragged.LOWER[data], np.append(spans, 0), 2 * np.arange(len(starts)))
        edges = np.concatenate([[0], np.cumsum(size)])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(flat)]).dictionary_encode()
        terms = max(1, len(coded.dictionary))
        owner = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        mine, n = np.unique(owner * terms + np.asarray(coded.indices, np.int64), return_counts=True)
        keys, back = np.unique(group[mine // terms] * terms + mine % terms, return_inverse=True)
        at = pa.array(some[keys // terms])
        columns = [rows.column("lang").take(at), rows.column("source").take(at), coded.dictionary.take(pa.array(keys % terms)).cast(pa.large_string()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.bincount(back, n, len(keys)).astype(np.int64)), pa.array(np.bincount(back, minlength=len(keys)))], names=["lang", "source", "term", "n", "docs"])

    counted = docs.mapInArrow(ragged.mapper(count, target=_BLOCK), "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 2) / total) by long division, three digits at a time."""
    rest, share = counts + 2, np.zeros(np.broadcast(counts, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        share = share * 1000 + rest // total
        rest = rest % total
    return share + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class _Piece:
    """Distinct vectors of a language beside its sources."""

    def __init__(self, table: pa.Table):
        params = table.filter(pc.is_null(table["m"])).sort_by("source")
        self.sources = params["source"].combine_chunks()
        self.terms_kept, self.lang_terms = (params[c][0].as_py() for c in ("kept", "lang_n"))
        self.totals = np.asarray(params["n"], np.int64) + 2 * self.terms_kept
        found = table.filter(pc.is_valid(table["m"])).combine_chunks()
        self.many = np.asarray(found["m"], np.int64)
        lists = found["vector"].combine_chunks()
        self.sizes = np.asarray(pc.list_value_length(lists), np.int64)
        entries = lists.flatten()
        self.of = np.repeat(np.arange(len(self.many)), self.sizes)
        self.at = np.asarray(pc.index_in(entries.field("source"), self.sources), np.int64)
        self.n = np.asarray(entries.field("n"), np.int64)
        self.terms = found["terms"].to_pylist()

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each source, the sums over all vectors of its divergence from the sources after it."""
        width = len(self.sources)
        high, tall = max(1, 4 * _CELLS // width), max(1, _CELLS // width)
        for lo in range(0, width, high):
            sums = np.zeros((min(high, width - lo), width), np.int64)
            for v in range(0, len(self.many), tall):
                a, b = np.searchsorted(self.of, [v, v + tall])
                counts = np.zeros((min(tall, len(self.many) - v), width), np.int64)
                counts[self.of[a:b] - v, self.at[a:b]] = self.n[a:b]
                p = _shares(counts, self.totals[None, :])
                for i in range(len(sums)):
                    k = lo + i
                    sums[i, k + 1 :] += self.many[v : v + tall] @ _apart(p[:, k, None], p[:, k + 1 :])
            for i, row in enumerate(sums):
                yield lo + i, row[lo + i + 1 :]

    def firsts(self, top: int) -> list[tuple[int, str, int]]:
        """(source, term, value) of each source's terms that can be among its ``top``."""
        total = np.bincount(self.of, self.n, len(self.many)).astype(np.int64) if not len(self.n) or self.n.max() < 2**40 else np.array([self.n[a:b].sum() for a, b in zip(np.cumsum(self.sizes) - self.sizes, np.cumsum(self.sizes), strict=True)])
        p = _shares(self.n, self.totals[self.at])
        q = _shares(total, np.int64(self.lang_terms + 2 * self.terms_kept))[self.of]
        value, out = _apart(p, q), []
        for k in range(len(self.sources)):
            mine = np.flatnonzero((self.at == k) & (p > q))
            mine = mine[np.argsort(-value[mine], kind="stable")]
            have = np.cumsum([len(self.terms[v]) for v in self.of[mine[:top]]])
            if len(have) and have[-1] >= top:
                least = value[mine[np.searchsorted(have, top)]]
                mine = mine[value[mine] >= least]
            rows = [(-int(value[e]), t.encode(), t) for e in mine for t in self.terms[self.of[e]]]
            out += [(k, t, -v) for v, _, t in sorted(rows)[:top]]
        return out


def _evaluate(top: int):
    names = ["lang", "source", "part", "item", "value"]

    def batch(lang, source, part, item, value):
        n = len(item)
        columns = [pa.array([lang] * n, pa.string()), source, pa.array([part] * n, pa.string()), item, pa.array(value, pa.int64())]
        return pa.RecordBatch.from_arrays([c.cast(pa.string()) if i in (1, 3) else c for i, c in enumerate(columns)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        lang = table["lang"][0].as_py()
        if table["piece"][0].as_py() and not pc.any(pc.is_valid(table["m"])).as_py():
            return
        piece = _Piece(table)
        for k, values in piece.pairs():
            one, others = pa.array([k] * len(values), pa.int64()), pa.array(np.arange(k + 1, len(piece.sources)))
            a, b = piece.sources.take(one), piece.sources.take(others)
            yield batch(lang, a, "pair", b, values)
            yield batch(lang, b, "pair", a, values)
        found = piece.firsts(top)
        yield batch(lang, piece.sources.take(pa.array([f[0] for f in found], pa.int64())), "term", pa.array([f[1] for f in found], pa.string()), [f[2] for f in found])
        ragged.release()

    return run


def divergences(docs: DataFrame, least: int = LEAST, top: int = TOP, piece: int = PIECE) -> DataFrame:
    """(lang, source, part, item, value, rank): of each source of a language all others (part ``pair``) and its ``top`` terms above the language's share (part ``term``)."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = term_counts(docs)
    vectors = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"))
    terms = written(vectors.where(F.col("docs") >= least).select("lang", "term", "vector"), "terms")

    smallest = terms.withColumn("place", F.row_number().over(Window.partitionBy("lang", "vector").orderBy("term"))).where(F.col("place") <= top)
    smallest = smallest.groupBy("lang", "vector").agg(F.collect_list("term").alias("terms"))
    distinct = written(terms.groupBy("lang", "vector").agg(F.count("*").alias("m")).join(smallest, ["lang", "vector"]), "vectors")

    sums = distinct.select("lang", "m", F.explode("vector").alias("e")).groupBy("lang", "e.source").agg(F.sum(F.col("m") * F.col("e.n")).alias("n"))
    kept = distinct.groupBy("lang").agg(F.sum("m").alias("kept"))
    whole = sums.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    sources = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(kept, "lang", "left").join(whole, "lang", "left").na.fill(0)

    pieces = max(1, -(-distinct.count() // piece))
    beside = sources.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    dealt = distinct.withColumn("piece", F.pmod(F.xxhash64("vector"), F.lit(pieces)).cast("int"))
    found = written(dealt.unionByName(beside, allowMissingColumns=True).groupBy("lang", "piece").applyInArrow(_evaluate(top), "lang string, source string, part string, item string, value long"), "evaluated")

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(by))
    firsts = found.where("part = 'term'").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return pairs.unionByName(firsts)
