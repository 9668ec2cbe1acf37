"""Token counts of texts under a byte-fallback piece model.

Rank-synchronous array merging: the pre-tokens of a block (spaces and the
characters up to the next space) that have not been met before are held as
one ragged array of symbols; in each round every sequence applies its
lowest-ranked pair, and the symbols that survive are counted. A text's count is
the sum over its pre-tokens. No piece of such a model has a space after another
character, so merges never cross spaces; where no piece joins a Latin
letter to an ASCII digit or mark either, pre-tokens end between these too.

Null texts count as empty (no tokens). Rows are neither merged nor dropped, so
repeated rows and ids give repeated results; null ids stay null. Other columns
are not read. The cache of counted pre-tokens holds ``CACHE`` entries and is
then begun anew, so a task's memory does not grow with the corpus.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairnmark.llm import ragged
from cairnmark.llm.merges import MergeTable, merge

CACHE = 400_000
SPACE = "▁"
_LATIN, _MARK = "A-Za-zÀ-ÖØ-öø-ɏ", r"\x00-\x1f!-@\[-`{-\x7f"
_MIXED = re.compile(f"[{_LATIN}][{_MARK}]|[{_MARK}][{_LATIN}]")
_FINE = re.compile(f" *+(?:[{_LATIN}]++(?=[{_MARK} ]|$)|[{_MARK}]++(?=[{_LATIN} ]|$)|[^ ]+)| +")
_COARSE = re.compile(r" *[^ ]+| +")


class PieceCounter:
    """Counts tokens as the piece model in ``path`` gives them."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
        rules, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or kinds - {1, 2, 3, 6}:
            raise ValueError("only BPE models with byte fallback and without user-defined pieces are supported")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models that leave texts as they are, but for spaces, are supported")
        self.dummy = " " if rules.add_dummy_prefix else ""
        pieces = [(p.piece, p.score) for p in model.pieces if p.type == 1]
        if any(SPACE in p.lstrip(SPACE) for p, _ in pieces):
            raise ValueError("pieces with a space after another character are not supported")
        self.split = _COARSE if any(_MIXED.search(p) for p, _ in pieces) else _FINE
        self.symbol = {p: i for i, (p, _) in enumerate(pieces)}
        self.known = len(self.symbol)
        for p, _ in pieces:
            for c in p:
                self.symbol.setdefault(c, len(self.symbol))
        rank = {s: i for i, s in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        pairs = {}
        for p, score in pieces:
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (rank[score], self.symbol[p])
        base = len(self.symbol) + 5  # the last four: characters of 1 to 4 bytes without a piece
        self.table = MergeTable.of(pairs, base)
        self.weight = np.ones(base, np.int64)
        for c, i in self.symbol.items():
            if i >= self.known:
                self.weight[i] = len(c.encode())
        self.weight[base - 4 :] = [1, 2, 3, 4]
        self.of_char = base - 5 + np.repeat(np.arange(1, 5), np.diff([0, 1 << 7, 1 << 11, 1 << 16, 0x110000]))
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        self.of_char[ord(" ")] = self.of_char[ord(SPACE)]
        self.cache: dict[str, int] = {}

    def _learn(self, new: list[str]) -> None:
        chars = np.frombuffer("".join(new).encode("utf-32-le"), np.uint32)
        counts = np.fromiter(map(len, new), np.int64, len(new))
        left, n = merge(self.of_char[chars], counts, self.table)
        totals = ragged.row_sums(self.weight[left], np.concatenate([[0], np.cumsum(n)]))
        self.cache.update(zip(new, totals.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        split = [self.split.findall(self.dummy + x.replace(SPACE, " ")) if x else [] for x in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = set().union(*split).difference(self.cache)
        if new:
            self._learn(list(new))
        get = self.cache.__getitem__
        return [sum(map(get, x)) for x in split]


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``; ``over_limit``: more than ``limit`` tokens."""
    picked = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))

    def work(rows, data, offs):
        raw = data.tobytes()
        counts = counter(model).count([raw[a:b].decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])
        n = np.array(counts, np.int64)
        return pa.RecordBatch.from_arrays([rows.column("id"), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], names=[id_column, "n_bytes", "n_tokens", "over_limit"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(ragged.mapper(work), f"{id_column} {kind}, n_bytes long, n_tokens long, over_limit boolean")
