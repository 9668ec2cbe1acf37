"""Quality of texts by a linear-chain conditional random field over their lines.

Every line is good or bad. A line's features are shares of kinds of characters,
lengths of line and words, words and lines that come again, each as steps
(``_STEPS``), of the line itself and of its neighbours on either side. The field has a
weight for each feature, for each pair of successive states and for each first
state. Forward and backward sums give each line's probability of being good,
and a text's score is their mean, weighted by the lines' characters.

Labels are of texts; in training every line of a text has its text's label,
and every text counts the same however many lines it has. The weights are
fitted in numpy on the driver by full-batch gradient steps (Adam, ``STEPS``)
on a bounded sample: of the ``SAMPLE`` labelled ids with the smallest hashes, up
to ``SAMPLE`` texts of at most ``LONG`` lines. Their features are found in
Spark; the driver gets a byte for each of a line's ``OWN`` features. Scoring reads every text whole, without a shuffle; the lines of
a block form one chain that starts anew at each text, scanned in blocks of
lines at once, so a text of a million lines takes a few thousand numpy steps.

Null texts are empty and have one line of no characters, like empty ones.
Repeated rows and ids are scored alike; a label of a repeated id holds for all
its rows, of an id with two labels the higher one counts, null labels and null ids
teach nothing. Without labels every line is good with probability 0.5. Scores depend on the text alone. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnmark.llm import ragged

SAMPLE, LONG, STEPS, RATE, SHRINK, THRESHOLD = 6000, 256, 150, 0.1, 1e-4, 0.7
_KINDS = 11
_KIND = np.full(256, 8, np.int64)  # symbols
for _k, _bytes in enumerate([range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), b" \t\x0b\x0c\r", b".,;:'\"()-?", b"!", b"|", range(0xC0, 0x100)]):
    _KIND[list(_bytes)] = _k
_KIND[0x80:0xC0], _KIND[0x0A] = 9, 10
#: Of each measure, where its steps are.
_STEPS = {
    "lower": (0.2, 0.5, 0.7), "upper": (0.01, 0.05, 0.15, 0.4), "digit": (0, 0.03, 0.15), "stop": (0, 0.01, 0.05, 0.15), "shout": (0, 0.03, 0.1), "bar": (0, 0.03, 0.1), "beyond": (0, 0.05, 0.3), "symbol": (0, 0.01, 0.03, 0.1, 0.25),
    "chars": (0, 15, 40, 120, 400, 2000), "words": (1, 4, 12, 40), "word": (3, 5, 7, 10, 20), "again": (0.05, 0.2, 0.5), "copy": (0,), "closed": (0,),
}
OWN = sum(map(len, _STEPS.values()))
WIDTH = 3 * OWN + 3


def line_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of a block, and each text's first line (rows + 1); every text has one line at least."""
    breaks = np.flatnonzero(data == 10)
    first = np.zeros(len(offs), np.int64)
    np.cumsum(1 + np.diff(np.searchsorted(breaks, offs)), out=first[1:])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    begins, stops = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    begins[first[:-1]], stops[first[1:] - 1] = True, True
    starts[begins], starts[~begins] = offs[:-1], breaks + 1
    ends[stops], ends[~stops] = offs[1:], breaks
    return starts, ends, first


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether an earlier key is the same."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order][1:] == keys[order][:-1]
    return again


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's features by line (lines x OWN, 0 or 1), the lines' characters, and each text's first line."""
    starts, ends, first = line_bounds(data, offs)
    n, owner = len(starts), np.repeat(np.arange(len(offs) - 1), np.diff(first))
    of = np.repeat(np.arange(n), np.diff(np.append(starts, len(data))))
    kinds = np.bincount(of * _KINDS + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS)
    chars = kinds[:, :9].sum(1)
    a, b, _ = ragged.words(data, offs, ~ragged.SPACES)
    line, sums = np.searchsorted(starts, a, side="right") - 1, ragged.prefix(data)
    with np.errstate(over="ignore"):
        again = _repeated(ragged.mix(ragged.span_hash(sums, a, b) + line.astype(np.uint64)))
        copy = _repeated(ragged.mix(ragged.span_hash(sums, starts, ends) + owner.astype(np.uint64))) & (chars > 0)
    words, share = np.bincount(line, minlength=n), 1 / np.maximum(chars, 1)
    last = np.zeros(n, np.uint8)
    last[chars > 0] = data[ends[chars > 0] - 1]
    found = dict(zip("lower upper digit - stop shout bar beyond symbol".split(), (kinds[:, :9] * share[:, None]).T, strict=True))
    found |= {"chars": chars, "words": words, "word": chars / np.maximum(words, 1), "again": np.bincount(line, again, n) / np.maximum(words, 1), "copy": copy, "closed": np.isin(last, list(b".!?:;"))}
    return np.stack([found[k] > s for k, steps in _STEPS.items() for s in steps], 1).astype(np.uint8), chars, first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of each line, of the one before and the one after it in its text; whether there are such; 1."""
    n = len(own)
    out = np.zeros((n, WIDTH), np.float32)
    begins, ends = np.zeros(n, bool), np.zeros(n, bool)
    begins[first[:-1]], ends[first[1:] - 1] = True, True
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN][~begins[1:]] = own[:-1][~begins[1:]]
    out[:-1, 2 * OWN : 3 * OWN][~ends[:-1]] = own[1:][~ends[:-1]]
    out[:, -3], out[:, -2], out[:, -1] = begins, ends, 1
    return out


@dataclass
class Field:
    """``weights`` of the good state's features; log weights ``move`` (from, to) and ``start`` of the states bad and good."""

    weights: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def marginals(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each line's probability of good, and of the states (before, here) of each line and the one before it (0 at the beginning of a text)."""
        n, fit = len(x), np.clip(x @ self.weights, -30, 30).astype(np.float64)
        begins = np.zeros(n, bool)
        begins[first[:-1]] = True
        here = np.stack([np.exp(-np.maximum(fit, 0)), np.exp(-np.maximum(-fit, 0))], 1)
        step = np.exp(self.move)[None] * here[:, None, :]
        step[begins] = (np.exp(self.start) * here[begins])[:, None, :]
        before = _scan(step)
        after = _scan(np.swapaxes(step, 1, 2)[::-1])[::-1]  # after[t]: what lines t and later make of a state before t
        rest = np.ones((n, 2))
        rest[:-1] = np.where(begins[1:, None], 1.0, after[1:])
        both = before * rest
        both /= both.sum(1, keepdims=True)
        pairs = np.zeros((n, 2, 2))
        at = np.flatnonzero(~begins)
        pairs[at] = before[at - 1][:, :, None] * step[at] * rest[at][:, None, :]
        pairs[at] /= pairs[at].sum((1, 2), keepdims=True)
        return both[:, 1], pairs


def _scan(step: np.ndarray) -> np.ndarray:
    """Row vectors 1 . step[0] ... step[t] for every t, each scaled to a sum of 1; blocks of the chain run side by side."""
    n = len(step)
    long = max(1, int(np.sqrt(n)))
    wide = -(-n // long)
    padded = np.broadcast_to(np.eye(2), (wide * long, 2, 2)).copy()
    padded[:n] = step
    padded = padded.reshape(wide, long, 2, 2)
    whole = padded[:, 0].copy()
    for i in range(1, long):
        whole = whole @ padded[:, i]
        whole /= whole.sum((1, 2), keepdims=True)
    state, begun = np.full(2, 0.5), np.empty((wide, 2))
    for i in range(wide):
        begun[i] = state
        state = state @ whole[i]
        state /= state.sum()
    out = np.empty((wide, long, 2))
    for i in range(long):
        begun = (begun[:, None, :] @ padded[:, i])[:, 0]
        begun /= begun.sum(1, keepdims=True)
        out[:, i] = begun
    return out.reshape(-1, 2)[:n]


def fit(own: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = STEPS, rate: float = RATE, shrink: float = SHRINK) -> Field:
    """The field of largest likelihood, less ``shrink`` times the squares; ``labels`` by text."""
    field = Field(np.zeros(WIDTH, np.float32), np.zeros((2, 2)), np.zeros(2))
    if not len(labels):
        return field
    x = with_neighbours(own, first)
    sizes = np.diff(first)
    y = np.repeat(labels, sizes)
    weight = np.repeat(1 / (sizes * len(sizes)), sizes)
    begins = np.zeros(len(x), bool)
    begins[first[:-1]] = True
    stay = np.zeros((len(x), 2, 2))
    stay[np.arange(len(x)), y, y] = ~begins
    size = WIDTH + 4 + 2
    values, slope, square = np.zeros(size), np.zeros(size), np.zeros(size)
    for i in range(1, steps + 1):
        good, pairs = field.marginals(x, first)
        of_start = np.zeros(2)
        of_start[1] = ((y - good) * weight)[begins].sum()
        of_start[0] = -of_start[1]
        up = np.concatenate([((y - good) * weight).astype(np.float32) @ x, ((stay - pairs) * weight[:, None, None]).sum(0).ravel(), of_start]) - shrink * values
        slope = 0.9 * slope + 0.1 * up
        square = 0.99 * square + 0.01 * up**2
        values = values + rate * (1 - i / (steps + 1)) * (slope / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
        field = Field(values[:WIDTH].astype(np.float32), values[WIDTH : WIDTH + 4].reshape(2, 2), values[WIDTH + 4 :])
    return field


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, long: int = LONG) -> Field:
    """The field fitted on a sample of ``docs`` (doc_id, text) that ``labels`` (doc_id, label) names."""

    def features(rows, data, offs):
        own, _, first = line_features(data, offs)
        counts = np.diff(first)
        packed = ragged.lists(own.ravel(), counts * OWN, 1)
        table = pa.RecordBatch.from_arrays([rows.column("place"), rows.column("copy"), rows.column("label"), pa.array(counts), packed], names=["place", "copy", "label", "lines", "own"])
        return table.filter(pa.array(counts <= long))

    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    place = F.xxhash64("doc_id").alias("place")
    chosen = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select(place, "doc_id", "label").orderBy("place", "doc_id").limit(sample)
    texts = docs.join(F.broadcast(chosen), "doc_id").select("place", F.xxhash64("text").alias("copy"), "label", "text")
    found = texts.mapInArrow(ragged.mapper(features), "place long, copy long, label int, lines long, own binary")
    table = found.orderBy("place", "copy").limit(sample).toArrow()
    own = np.frombuffer(b"".join(table["own"].to_pylist()), np.uint8).reshape(-1, OWN)
    first = np.concatenate([[0], np.cumsum(np.asarray(table["lines"], np.int64))])
    return fit(own, first, np.asarray(table["label"], np.int64))


def scores(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_lines, good_lines, score, predicted) of every row of ``docs`` (doc_id, text)."""

    def score(rows, data, offs):
        own, chars, first = line_features(data, offs)
        good, _ = field.marginals(with_neighbours(own, first), first)
        total = ragged.row_sums(chars, first)
        weight = np.where(np.repeat(total, np.diff(first)) > 0, chars, 1).astype(float)
        found = np.clip(ragged.row_sums(good * weight, first) / ragged.row_sums(weight, first), 0, 1)
        fine = ragged.row_sums((good >= 0.5).astype(np.int64), first)
        columns = [rows.column("doc_id"), pa.array(np.diff(first)), pa.array(fine), pa.array(found), pa.array((found >= threshold).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "good_lines", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(ragged.mapper(score), "doc_id long, n_lines long, good_lines long, score double, predicted int")


def line_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_lines, good_lines): learnt from the labels of rows whose id's CRC-32 modulo ``folds`` is not ``held``."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    field = train(docs.where(~out & F.col("doc_id").isNotNull()), labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")))
    return scores(docs, field).select("doc_id", out.alias("held_out"), "score", "predicted", "n_lines", "good_lines")
