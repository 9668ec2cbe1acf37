"""Quality rules of texts and their perplexity under an n-gram model of the corpus.

Rules: counts of words, symbols, repeated lines and words in repeated windows,
with two limits (``base_failed``). Lines and words are told apart by their
bytes, windows by the numbers of their words, never by hashes alone.

Model: trigrams of lower-cased UTF-8 bytes of all texts, counted in Spark by
language, smoothed with modified Kneser-Ney (three discounts for each order,
continuation counts below the highest) and kept as sorted key arrays with
their log probabilities. An n-gram's key is its bytes, so a language has at
most 2**24 of them, whatever the corpus. Every language has a model and bands
of its own, however few its bytes.

Verdict: a text's fit is the upper quartile, over its stretches of ``STRETCH`` bytes, of
the mean log probability of a byte, so a foreign passage does not decide it; a
text that fits its own language poorly (by ``POOR`` below the model's mean) is
given the best model for each stretch, relative to that model's mean, so texts
in several languages are judged as such. The mean over all bytes (raised in the
same way where it is poor) is a second fit, so that texts of mostly noise do not
pass by their best part. Fits are standardised by the median and quartiles
of the model, and texts more than ``BAND`` spreads below or above (perplexity
too high or too low; by the second fit, too high only) are rejected; the band widens for texts shorter than ``SHORT`` bytes by
the square root. Both bands come from exact quantiles on a fixed grid over all
texts.

Null texts are empty: no words, base_failed, not kept. A null language is the
empty one. Repeated rows and ids stay; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnmark.llm import ragged
from cairnmark.llm.shared import cut

BAND, SHORT, GRID, WINDOW, STRETCH, POOR = (3.5, 4.5), 2000, 500, 8, 128, 0.06
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_CHAR = np.array([not (b & 0xC0 == 0x80 or ragged.SPACES[b]) for b in range(256)], np.int64)
_HELD = 1 << 20


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span, equal where the bytes are."""
    flat, size = ragged.gather(data, np.append(np.stack([starts, ends], 1).ravel(), 0), 2 * np.arange(len(starts)))
    edges = np.concatenate([[0], np.cumsum(size)])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(flat)]).dictionary_encode()
    return np.asarray(coded.indices, np.int64)


def rule_counts(data: np.ndarray, offs: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row of a block."""
    starts, ends, first = ragged.words(data, offs, ~ragged.SPACES)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    out = {"n_words": np.diff(first), "word_chars": ragged.row_sums(_CHAR[data], offs), "n_symbols": ragged.row_sums(_SYMBOL[data], offs)}

    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, starts)
    new = np.ones(len(starts), bool)
    new[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    line, row = line[new], owner[new]
    edge = np.concatenate([[-1], breaks, [len(data)]])
    begin, stop = np.maximum(edge[line] + 1, offs[row]), np.minimum(edge[line + 1], offs[row + 1])
    same = _numbers(data, begin, stop) + (row << 32)
    order = np.argsort(same, kind="stable")
    out["n_dup_lines"] = np.bincount(row[order][1:][same[order][1:] == same[order][:-1]], minlength=len(offs) - 1)

    out["n_repeat_words"] = np.zeros(len(offs) - 1, np.int64)
    if len(starts) >= window:
        grams, size = _numbers(data, starts, ends), 1
        while size < window:
            step = min(size, window - size)
            _, grams = np.unique(grams[:-step] << 32 | grams[step:], return_inverse=True)
            size += step
        n = len(grams)
        at = np.flatnonzero(owner[:n] == owner[window - 1 :])
        keys = grams[at] << 32 | owner[at]
        order = np.argsort(keys)
        keys = keys[order]
        equal = keys[1:] == keys[:-1]
        twice = np.zeros(len(at), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        cover = np.zeros(len(starts) + 1, np.int64)
        hits = at[order[twice]]
        cover[hits] += 1
        np.subtract.at(cover, hits + window, 1)
        out["n_repeat_words"] = ragged.row_sums((np.cumsum(cover)[:-1] > 0).astype(np.int64), first)
    return {k: v.astype(np.int64) for k, v in out.items()}


def _grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For every byte the key of the trigram that it ends; two zero bytes stand before each text."""
    low = ragged.LOWER[data].astype(np.int64)
    n = len(low)
    one, two = np.zeros(n, np.int64), np.zeros(n, np.int64)
    one[1:], two[2:] = low[:-1], low[:-2]
    edges = offs[:-1][np.diff(offs) > 0]
    one[edges] = two[edges] = 0
    after = edges[np.diff(offs)[np.diff(offs) > 0] > 1] + 1
    two[after] = 0
    return two << 16 | one << 8 | low


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts of ``docs`` (lang, text)."""

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                grams, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int32)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            for rows, data, offs in ragged.blocks(batch):
                keys = _grams(data, offs)
                langs, which = np.unique(np.array(rows.column("lang").fill_null("").to_pylist(), object).astype(str), return_inverse=True)
                by_byte = np.repeat(which, np.diff(offs))
                for i, lang in enumerate(langs.tolist()):
                    grams, n = np.unique(keys[by_byte == i], return_counts=True)
                    held.setdefault(lang, []).append((grams, n))
                    size += len(grams)
                if size > _HELD:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    counts = docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "lang string, gram int, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and more."""
    n = [0, *(int((counts == k).sum()) for k in range(1, 5))]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    d = [0.0]
    for k in (1, 2, 3):
        raw = k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k / 2
        d.append(min(max(raw, 0.05), k - 0.05))
    return np.array(d)


@dataclass
class KneserNey:
    """Sorted trigram keys with log10 probabilities; bigram and unigram tables for what they lack."""

    keys: np.ndarray
    logs: np.ndarray
    back3: np.ndarray
    two: np.ndarray
    mean: float

    @classmethod
    def fit(cls, keys: np.ndarray, counts: np.ndarray) -> KneserNey:
        """From distinct trigram keys in ascending order and their counts."""
        pairs = np.bincount(keys & 0xFFFF, minlength=1 << 16)  # distinct first bytes of each bigram
        singles = np.bincount(np.flatnonzero(pairs) & 0xFF, minlength=256)
        d1 = _discounts(singles[singles > 0])
        total = max(singles.sum(), 1)
        one = np.maximum(singles - d1[np.minimum(singles, 3)], 0) / total
        one += (1 - one.sum()) / 256
        d2 = _discounts(pairs[pairs > 0])
        grid = pairs.reshape(256, 256)
        kept = np.maximum(grid - d2[np.minimum(grid, 3)], 0)
        sums = grid.sum(axis=1)
        share = np.divide(kept, sums[:, None], out=np.zeros((256, 256)), where=sums[:, None] > 0)
        two = share + np.where(sums > 0, 1 - share.sum(axis=1), 1)[:, None] * one[None, :]
        d3 = _discounts(counts)
        context = keys >> 8
        sums = np.bincount(context, counts, minlength=1 << 16)
        kept = np.maximum(counts - d3[np.minimum(counts, 3)], 0)
        mass = np.bincount(context, kept, minlength=1 << 16)
        back3 = np.where(sums > 0, 1 - mass / np.maximum(sums, 1), 1)
        logs = np.log10(kept / sums[context] + back3[context] * two.ravel()[keys & 0xFFFF])
        return cls(keys.astype(np.int32), logs.astype(np.float32), np.log10(back3).astype(np.float32), np.log10(two).ravel().astype(np.float32), float(np.average(logs, weights=counts)) if len(keys) else -np.log10(256))

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each trigram, given the first two."""
        if not len(self.keys):
            return np.full(len(keys), -np.log10(256))
        keys = keys.astype(np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out = self.logs[at].astype(np.float64)
        lacks = np.flatnonzero(self.keys[at] != keys)
        out[lacks] = self.back3[keys[lacks] >> 8] + self.two[keys[lacks] & 0xFFFF]
        return out


def fit_models(counts: DataFrame) -> dict[str | None, KneserNey]:
    """A model for each language, and under None an empty one for languages without a byte."""
    found = counts.toPandas()  # at most 2**24 rows a language
    models: dict[str | None, KneserNey] = {None: KneserNey.fit(np.zeros(0, np.int64), np.zeros(0, np.int64))}
    for lang, part in found.groupby("lang"):
        part = part.sort_values("gram")
        models[lang] = KneserNey.fit(part["gram"].to_numpy(np.int64), part["n"].to_numpy(np.int64))
    return models


def _stretches(logs: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log probability of every stretch, and the number of stretches of each row."""
    size = np.diff(offs)
    n = -(-size // STRETCH)
    row = np.repeat(np.arange(len(size)), n)
    begin = offs[row] + STRETCH * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    return (np.add.reduceat(logs, begin) / np.diff(np.append(begin, len(logs))) if len(row) else np.zeros(0)), n


def _upper_quartile(mean: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each row's stretches; NaN for empty rows."""
    out = np.full(len(n), np.nan)
    ranked = mean[np.lexsort([mean, np.repeat(np.arange(len(n)), n)])]
    full = n > 0
    out[full] = ranked[(np.cumsum(n) - n)[full] + (3 * (n[full] - 1) + 2) // 4]
    return out


def _scored(docs: DataFrame, models) -> DataFrame:
    """(doc_id, rule counts, model, n_bytes, fit, whole) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    picked = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def work(rows, data, offs):
        counts = rule_counts(data, offs)
        keys = _grams(data, offs)
        of_row = [x if x in shared.value else None for x in rows.column("lang").fill_null("").to_pylist()]
        langs = list(dict.fromkeys(of_row))
        by_byte = np.repeat(np.array([langs.index(x) for x in of_row]), np.diff(offs))
        logs = np.zeros(len(keys))
        for i, lang in enumerate(langs):
            mine = by_byte == i if len(langs) > 1 else slice(None)
            logs[mine] = shared.value[lang].score(keys[mine])
        fits = _upper_quartile(*_stretches(logs, offs))
        size = np.diff(offs)
        whole = np.where(size > 0, ragged.row_sums(logs, offs) / np.maximum(size, 1), np.nan)
        mean = np.array([shared.value[x].mean for x in of_row])
        fitted = [model for model in shared.value.values() if len(model.keys)]  # the empty model has no texts
        for i in np.flatnonzero((fits < mean - POOR) | (whole < mean - POOR)).tolist():
            part = keys[offs[i] : offs[i + 1]]
            lifts = [_stretches(model.score(part), np.array([0, len(part)]))[0] - model.mean for model in fitted]
            best = np.maximum.reduce(lifts)
            if fits[i] < mean[i] - POOR:
                fits[i] = mean[i] + _upper_quartile(best, np.array([len(best)]))[0]
            whole[i] = mean[i] + np.average(best, weights=np.minimum(STRETCH, len(part) - STRETCH * np.arange(len(best))))
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), *(pa.array(counts[c]) for c in names), pa.array(of_row, pa.string()), pa.array(size), pa.array(fits, mask=np.isnan(fits)), pa.array(whole, mask=np.isnan(whole))],
            names=["doc_id", *names, "model", "n_bytes", "fit", "whole"],
        )

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(ragged.mapper(work), f"doc_id {kind}, {', '.join(f'{c} long' for c in names)}, model string, n_bytes long, fit double, whole double")


def _bands(scored: DataFrame, fit: str) -> dict[str | None, tuple[float, float]]:
    """Median and spread of the column ``fit`` of each model's texts, from exact quantiles on a grid of 1 / ``GRID``."""
    cells = scored.where("n_words >= 20").groupBy("model", F.round(F.col(fit) * GRID).cast("long").alias("cell")).count()
    out = {}
    for model, part in cells.toPandas().groupby("model", dropna=False):  # a few thousand cells a model
        part = part.sort_values("cell")
        below = part["count"].cumsum().to_numpy() / part["count"].sum()
        low, mid, high = (part["cell"].to_numpy()[np.searchsorted(below, q)] / GRID for q in (0.25, 0.5, 0.75))
        out[model if isinstance(model, str) else None] = (float(mid), float(max((high - low) / 1.349, 5 / GRID)))
    return out


def quality(docs: DataFrame, band: tuple[float, float] = BAND, min_words: int = 20, repeat_share: int = 30) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_perplexity) of every row of ``docs`` (doc_id, lang, text)."""
    scored = cut(_scored(docs, fit_models(gram_counts(docs))))
    both = {fit: _bands(scored, fit) for fit in ("fit", "whole")}
    bands = docs.sparkSession.createDataFrame([(model, *band_, *both["whole"][model]) for model, band_ in both["fit"].items()], "of string, fit_mid double, fit_spread double, whole_mid double, whole_spread double")
    judged = scored.join(F.broadcast(bands), F.col("model").eqNullSafe(F.col("of")), "left")
    far = lambda fit: (F.col(fit) - F.col(f"{fit}_mid")) / F.col(f"{fit}_spread")
    wide = F.greatest(F.lit(1.0), F.sqrt(SHORT / F.greatest("n_bytes", F.lit(1))))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_share * F.col("n_words"))
    fits = F.coalesce((far("fit") / wide).between(-band[0], band[1]) & (far("whole") / wide >= -band[0]), F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & fits).alias("kept"), (-F.col("whole")).alias("log_perplexity"))
