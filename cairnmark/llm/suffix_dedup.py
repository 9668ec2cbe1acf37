"""Exact removal of repeated long strings by prefix-free parsing.

A byte goes if a string of ``length`` bytes that covers it also starts earlier:
in a text of a smaller id, or earlier in the same text. Strings never cross
texts and are judged on the input.

Parse. A rolling hash runs over each text; the smallest hash among the grams of
a string is its trigger. Strings that start one after the other and have the
same trigger form a phrase, which ends where the trigger changes. As the
trigger is decided by the string alone, equal strings fall into phrases of
equal triggers wherever they stand, and every string belongs to one phrase. (A
trigger that is a fixed residue leaves strings without any, so the minimum is
taken.)

Dictionary and parse. A phrase is extended by the bytes its last string needs,
which is as far as the order of the parse (what follows a phrase) matters to
strings of ``length`` bytes. Rows (trigger, phrase) of all texts, one for each
that differs within a block, are shuffled by trigger and sorted:

* A phrase that has come before makes all its strings repeats.
* Where a trigger has one phrase only, its first place stays.
* Where phrases that differ share a trigger, or its gram stands twice in a
  phrase (periodic text), the phrases' bytes are brought together by trigger
  and their suffix array, cut at ``length`` bytes, is built from ranked words;
  in each class of equal suffixes all but the first place are repeats. A
  trigger of over ``PIECE`` strings (the edges of a common passage) is
  dealt in as many pieces by the strings' hashes, and repeats within a block
  are dropped before.

Equal strings meet either within a phrase or in that order, so together they
are the corpus order of all suffixes to ``length`` bytes, without sorting the
bytes of text that occurs once. A passage in a third of all texts has one row
for each block, and its edges one row for each block and piece.

Phrases are equal by 128 bits (trigger and phrase hash), strings of phrases
that differ by their bytes. Null texts
are empty. Of rows with one id, the order of the texts decides, and a row that
repeats an earlier row in full counts as later; null ids come first. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnmark.llm import ragged
from cairnmark.llm.shared import cut

LENGTH = 100
#: Bytes of the grams whose hashes are triggers.
GRAM = 32
#: Bytes of text in which repeats are dropped before the shuffle.
BLOCK = 2 << 20
#: Strings of one trigger in a piece, of which one task orders one after the other.
PIECE = 1 << 13
#: Triggers of several pieces that are broadcast; more are joined.
SMALL = 100_000
_LATER, _CHECK, _MANY, _ONE = 0, 1, 2, 3
#: ``place`` packs the start in the text, the number of strings and the kind, in 34, 28 and 2 bits.
_ROWS = "key long, phrase long, uid long, place long"


def _sliding(pick, values: np.ndarray, width: int) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` successive values, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def phrases(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, start in the row, strings, trigger, phrase hash, periodic) of the phrases of a block; only in a periodic one may a string repeat."""
    sums = ragged.prefix(data)
    strings = np.maximum(np.diff(offs) - length + 1, 0)
    if not strings.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    grams, width = ragged.window_hash(sums, gram), length - gram + 1
    trigger = _sliding(np.minimum, grams, width)
    most = _sliding(np.maximum, np.concatenate([np.zeros(width - 1, np.uint64), trigger, np.zeros(width - 1, np.uint64)]), width)
    chosen = np.flatnonzero(most == grams)
    again = np.unique(grams[chosen[1:]][grams[chosen[1:]] == grams[chosen[:-1]]])
    valid = np.zeros(len(data) + 1, bool)
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, offs[:-1], (strings > 0).astype(np.int32))
    np.add.at(change, offs[:-1] + strings, -(strings > 0).astype(np.int32))
    valid = np.cumsum(change)[: len(trigger)] > 0
    new = valid.copy()
    new[1:] &= (trigger[1:] != trigger[:-1]) | ~valid[:-1]
    new[offs[:-1][strings > 0]] = True
    begin = np.flatnonzero(new)
    stop = np.empty_like(begin)
    row = np.searchsorted(offs, begin, side="right") - 1
    row_stop = offs[row] + strings[row]
    stop[:-1] = np.minimum(begin[1:], row_stop[:-1])
    stop[-1] = row_stop[-1]
    return row, begin - offs[row], stop - begin, trigger[begin], ragged.span_hash(sums, begin, stop + length - 1), np.isin(trigger[begin], again)


def _firsts(keys: list[np.ndarray]) -> np.ndarray:
    """Index of the first row of every distinct combination, for each row."""
    order = np.lexsort([np.arange(len(keys[0])), *keys[::-1]])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first = np.empty(len(order), np.int64)
    first[order] = order[new][np.cumsum(new) - 1]
    return first


def _batch(kind, key, phrase, uid, start, n) -> pa.RecordBatch:
    place = (start.astype(np.int64) << 30) | (n.astype(np.int64) << 2) | kind
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(phrase.view(np.int64)), pa.array(uid), pa.array(place)], names=["key", "phrase", "uid", "place"])


def _later(uid: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Repeated strings as rows of kind ``_LATER``, one for each run of successive starts."""
    order = np.lexsort([start, uid])
    uid, start = uid[order], start[order]
    new = np.ones(len(uid), bool)
    new[1:] = (uid[1:] != uid[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    return _batch(np.int64(_LATER), uid[at], uid[at], uid[at], start[at], np.diff(np.append(at, len(uid))))


def _unpacked(rows: DataFrame) -> DataFrame:
    place = F.col("place")
    return rows.select("phrase", "uid", F.shiftright(place, 30).alias("start"), F.shiftright(place, 2).bitwiseAND((1 << 28) - 1).alias("n"), place.bitwiseAND(3).alias("kind"))


def _parse(length: int, gram: int):
    """Rows of kind ``_ONE`` (the phrase of a trigger) or ``_MANY`` (a trigger of several), ``_LATER`` and ``_CHECK``."""

    def work(rows, data, offs):
        uids = rows.column("uid").to_numpy()
        row, start, n, trigger, phrase, periodic = phrases(data, offs, length, gram)
        if not len(row):
            return None
        place = np.lexsort([start, uids[row]])
        row, start, n, trigger, phrase, periodic = (x[place] for x in (row, start, n, trigger, phrase, periodic))
        same = _firsts([trigger, phrase])
        first = same == np.arange(len(same))
        kind = np.where(first, _ONE, _LATER)
        order = np.flatnonzero(first)
        order = order[np.argsort(trigger[order], kind="stable")]
        shared = periodic[order].copy()
        equal = trigger[order][1:] == trigger[order][:-1]
        shared[1:] |= equal
        shared[:-1] |= equal
        kind[order[shared]] = _CHECK
        head = order[shared][np.concatenate([[True], trigger[order[shared]][1:] != trigger[order[shared]][:-1]])] if shared.any() else order[:0]
        uid = uids[row]
        key = np.where(kind == _ONE, trigger, uid.view(np.uint64))
        phrase = np.where(kind == _CHECK, trigger, phrase)
        take = np.concatenate([np.arange(len(kind)), head])
        kind = np.concatenate([kind, np.full(len(head), _MANY)])
        key = np.concatenate([key, trigger[head]])
        return _batch(kind, key, phrase[take], uid[take], start[take], n[take])

    return ragged.mapper(work, target=BLOCK)


def _groups(batches):
    """(kind, key, phrase, uid, start, n) of whole groups of ``key`` from batches sorted by it."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, phrase, uid, place = (batch.column(c).to_numpy() for c in ("key", "phrase", "uid", "place"))
        cols = [place & 3, key, phrase, uid, place >> 30, place >> 2 & (1 << 28) - 1]
        cut_at = int(np.searchsorted(key, key[-1])) if key[0] != key[-1] else 0
        if cut_at or (held and held[-1][1][-1] != key[0]):
            whole = [np.concatenate([*(h[i] for h in held), c[:cut_at]]) for i, c in enumerate(cols)]
            held = []
            if len(whole[0]):
                yield whole
        held.append([c[cut_at:] for c in cols])
    if held:
        yield [np.concatenate([h[i] for h in held]) for i in range(6)]


def _judge(batches):
    """Phrases by trigger: what is a repeat, and whose strings must be looked at."""
    for kind, key, phrase, uid, start, n in _groups(batches):
        known = kind < _MANY
        if known.any():
            yield _batch(kind[known], key[known], phrase[known], uid[known], start[known], n[known])
        kind, key, phrase, uid, start, n = (x[~known] for x in (kind, key, phrase, uid, start, n))
        if not len(key):
            continue
        order = np.lexsort([start, uid, phrase, kind, key])
        kind, key, phrase, uid, start, n = (x[order] for x in (kind, key, phrase, uid, start, n))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        differs = kind == _MANY
        differs[1:] |= ~new[1:] & (phrase[1:] != phrase[:-1])
        several = np.bincount(group, differs) > 0
        earlier = np.zeros(len(key), bool)
        earlier[1:] = ~new[1:] & (phrase[1:] == phrase[:-1]) & (kind[1:] == kind[:-1])
        one = kind == _ONE
        verdict = np.where(earlier, _LATER, _CHECK)
        keep = one & (earlier | several[group])
        if keep.any():
            yield _batch(verdict[keep], uid[keep], key[keep], uid[keep], start[keep], n[keep])


def suffix_ranks(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """For each of the suffixes that begin ``at``, cut at ``length`` bytes, how many of these are smaller.

    Words of eight bytes are ranked once for all places; the suffixes are then
    refined word by word (the last overlaps to end at ``length``), only those
    that still equal others. Ranks are of the bytes themselves, so equal ranks
    mean equal bytes.
    """
    if not len(at):
        return np.zeros(0, np.int64)
    width, wide = min(8, length), np.zeros(len(data) + 8, np.uint8)
    wide[: len(data)] = data
    word = np.zeros(len(data), np.uint64)
    for k in range(width):
        word = word << np.uint64(8) | wide[k : k + len(data)]
    order = np.argsort(word)
    new = np.zeros(len(word), np.int64)
    new[1:] = word[order][1:] != word[order][:-1]
    word = np.empty(len(word), np.int64)
    word[order] = np.cumsum(new)
    rank, active, done = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while done < length and len(active):
        done = min(done + width, length)
        key = rank[active] << 32 | word[at[active] + done - width]
        order = np.argsort(key)
        key, active, index = key[order], active[order], np.arange(len(order))
        run, group = np.ones(len(key), bool), np.ones(len(key), bool)
        run[1:] = key[1:] != key[:-1]
        group[1:] = key[1:] >> 32 != key[:-1] >> 32
        first = np.maximum.accumulate(np.where(run, index, 0))
        rank[active] += first - np.maximum.accumulate(np.where(group, index, 0))
        alone = run & np.append(run[1:], True)
        active = active[~alone]
    return rank


def _at(offs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where in the block the strings of phrases begin, phrase after phrase."""
    return np.repeat(offs[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _pieces(length: int):
    """Phrases (phrase, pieces, uid, start, n, text) to rows (key, places, text), one for each piece that the block has.

    A trigger of one piece keeps its phrases whole; of several, every string
    goes to the piece that its hash names, and those that repeat within the
    block are decided here: rows without a text, whose places are repeats.
    """

    def work(rows, data, offs):
        trigger, pieces, uid, start, n = (rows.column(c).to_numpy() for c in ("phrase", "pieces", "uid", "start", "n"))
        split = pieces > 1
        key, begin, stop, places, later = [trigger[~split]], [offs[:-1][~split]], [offs[1:][~split]], [np.stack([uid, start, n], axis=1)[~split]], None
        if split.any():
            own = np.flatnonzero(split)
            some, size = ragged.gather(data, offs, own)
            edge = np.concatenate([[0], np.cumsum(size)])
            at, owner = _at(edge, n[own]), np.repeat(own, n[own])
            shift = np.repeat(offs[own] - edge[:-1], n[own])
            where = start[owner] + at + shift - offs[owner]
            order = np.lexsort([where, uid[owner]])
            at, owner, where, shift = at[order], owner[order], where[order], shift[order]
            first = _firsts([suffix_ranks(some, at, length)]) == np.arange(len(at))
            later = np.stack([uid[owner], where, np.ones(len(at), np.int64)], axis=1)[~first]
            h = ragged.window_hash(ragged.prefix(some), length)[at[first]]
            at, owner, where = (at + shift)[first], owner[first], where[first]
            salt = h % pieces[owner].astype(np.uint64)
            key.append(ragged.mix(trigger[owner].view(np.uint64) + salt).view(np.int64))
            begin.append(at)
            stop.append(at + length)
            places.append(np.stack([uid[owner], where, np.ones(len(at), np.int64)], axis=1))
        key, begin, stop, places = map(np.concatenate, (key, begin, stop, places))
        order = np.argsort(key, kind="stable")
        key, begin, stop, places = key[order], begin[order], stop[order], places[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        size = stop - begin
        flat = data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        bounds = np.append(first, len(key))
        out = [key[first], np.diff(bounds), ragged.row_sums(size, bounds)]
        if later is not None and len(later):
            places = np.concatenate([places, later])
            out = [np.append(out[0], later[0, 0]), np.append(out[1], len(later)), np.append(out[2], 0)]
        text = ragged.lists(flat, out[2])
        return pa.RecordBatch.from_arrays([pa.array(out[0]), ragged.lists(places.ravel(), 3 * out[1]), text], names=["key", "places", "text"])

    return ragged.mapper(work, target=BLOCK)


def _slices(length: int):
    """Texts (uid, text, slices) to their slices (phrase, pieces, uid, start, n, text), each text read once."""

    def run(batches):
        for batch in batches:
            for rows, data, offs in ragged.blocks(batch, target=BLOCK):
                lists = rows.column("slices")
                owner = np.repeat(np.arange(rows.num_rows), np.asarray(pc.list_value_length(lists), np.int64))
                found = lists.flatten()
                start, n = (np.asarray(found.field(c), np.int64) for c in ("start", "n"))
                begin, size = offs[owner] + start, n + length - 1
                ends = np.cumsum(size)
                lo = 0
                while lo < len(size):
                    hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + BLOCK, side="right")))
                    some = slice(lo, hi)
                    at = np.repeat(begin[some] - (ends[some] - size[some] - (ends[lo] - size[lo])), size[some]) + np.arange(int(size[some].sum()))
                    columns = [found.field("phrase")[some], found.field("pieces")[some], rows.column("uid").take(pa.array(owner[some])), pa.array(start[some]), pa.array(n[some]), ragged.lists(data[at], size[some])]
                    yield pa.RecordBatch.from_arrays(columns, names=["phrase", "pieces", "uid", "start", "n", "text"])
                    lo = hi
        ragged.release()

    return run


def _order(length: int):
    """Pieces sorted by key: in the suffix order of their phrases, all places of a string but the first are repeats."""

    def judge(held: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        uid, start, n = np.frombuffer(b"".join(rows.column("places").to_pylist()), np.int64).reshape(-1, 3).T
        data, _ = ragged.text_bytes(rows.column("text"))
        offs = np.concatenate([[0], np.cumsum(n + length - 1)])
        at = _at(offs, n)
        owner = np.repeat(np.arange(len(n)), n)
        uid, where = uid[owner], start[owner] + at - offs[owner]
        place = np.lexsort([where, uid])
        later = place[_firsts([suffix_ranks(data, at[place], length)]) != np.arange(len(place))]
        if len(later):
            yield _later(uid[later], where[later])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            known = np.asarray(pc.equal(pc.binary_length(batch.column("text")), 0))
            if known.any():
                uid, start, n = np.frombuffer(b"".join(batch.filter(pa.array(known)).column("places").to_pylist()), np.int64).reshape(-1, 3).T
                yield _later(uid, start)
            for rows, data, _ in ragged.blocks(batch.filter(pa.array(~known)), "text", BLOCK // 4):
                key = rows.column("key").to_numpy()
                cut_at = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
                done = bool(held) and held[-1].column("key")[0].as_py() != key[0]
                if (cut_at or done) and size + len(data) >= BLOCK // 4:
                    whole = [x for x in ([*held, rows.slice(0, cut_at)] if cut_at else held) if x.num_rows]
                    yield from judge(whole)
                    held, size = [rows.slice(cut_at)], 0
                else:
                    held += [x for x in (rows.slice(0, cut_at), rows.slice(cut_at)) if x.num_rows]
                    size += len(data)
        if held:
            yield from judge(held)
        ragged.release()

    return run


def _by_key(rows: DataFrame, work) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(work, _ROWS)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` (uid, text and others) with ``spans``: (start, n) of the strings that start earlier too. ``uid`` orders the texts."""
    texts = docs.select("uid", "text")
    judged = cut(_by_key(texts.mapInArrow(_parse(length, gram), _ROWS), _judge))
    found = _unpacked(judged)
    check = found.where(F.col("kind") == _CHECK).drop("kind")
    large = check.groupBy("phrase").agg(F.sum("n").alias("strings")).where(F.col("strings") > PIECE)
    large = cut(large.select("phrase", F.ceil(F.col("strings") / PIECE).alias("pieces")))
    few = large.limit(SMALL + 1).count() <= SMALL
    check = check.join(F.broadcast(large) if few else large, "phrase", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1).cast("long")))
    wanted = check.groupBy("uid").agg(F.collect_list(F.struct("phrase", "pieces", "start", "n")).alias("slices"))
    slices = texts.join(wanted.hint("shuffle_hash"), "uid").select("uid", "text", "slices").mapInArrow(_slices(length), "phrase long, pieces long, uid long, start long, n long, text binary")
    pieces = slices.mapInArrow(_pieces(length), "key long, places binary, text binary")
    ordered = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(_order(length), _ROWS)
    later = found.where(F.col("kind") == _LATER).select("uid", "start", "n").unionByName(_unpacked(ordered).select("uid", "start", "n"))
    spans = later.groupBy("uid").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return docs.join(spans.hint("shuffle_hash"), "uid", "left")


def covered(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings cover."""
    out: list[list[int]] = []
    for start, n in sorted((s["start"], s["n"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + n + length - 1)
        else:
            out.append([start, start + n + length - 1])
    return [tuple(x) for x in out]


def distinct_ids(docs: DataFrame, id_column: str = "doc_id") -> bool:
    """Whether the ids are integers, none null and none twice."""
    if docs.schema[id_column].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        return False
    return not docs.groupBy(F.col(id_column).alias("id")).count().where("count > 1 or id is null").limit(1).count()


def numbered(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with ``uid``, which orders rows as the operator's docstring says.

    Where ids are distinct and not null they are the order. Otherwise rows are
    ranked by id and text in a range-partitioned sort.
    """
    if distinct_ids(docs, id_column):
        return docs.withColumn("uid", F.col(id_column).cast("long"))
    return cut(docs.orderBy(F.col(id_column).asc_nulls_first(), F.col("text").asc_nulls_first()).withColumn("uid", F.monotonically_increasing_id()))


def _apply(length: int, whole_characters: bool, passed: list[str]):
    def run(batches):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")}
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text = text or b""
                runs = covered(spans, length)
                if whole_characters:
                    runs = [(_forward(text, a), _back(text, b)) for a, b in runs]
                    runs = [(a, b) for a, b in runs if a < b]
                at, kept = 0, []
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                out["n_bytes"].append(len(text))
                out["n_removed"].append(sum(b - a for a, b in runs))
                out["n_spans"].append(len(runs))
                out["kept"].append(kept)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            kinds = dict.fromkeys(out, pa.int64()) | {"kept": pa.binary(), "kept_sha256": pa.string()}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *(pa.array(v, kinds[c]) for c, v in out.items())], names=[*passed, *out])

    return run


def _forward(text: bytes, i: int) -> int:
    while i < len(text) and text[i] & 0xC0 == 0x80:
        i += 1
    return i


def _back(text: bytes, i: int) -> int:
    while i < len(text) and i > 0 and text[i] & 0xC0 == 0x80:
        i -= 1
    return i


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, whole_characters: bool = False) -> DataFrame:
    """``docs`` (uid, text and others) without text, with n_bytes, n_removed, n_spans, kept and kept_sha256.

    ``whole_characters`` leaves the bytes of characters that are removed in
    part, so that what is kept is text.
    """
    passed = [c for c in docs.columns if c != "text"]
    schema = docs.select(*passed, *(F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")), F.lit(b"").alias("kept"), F.lit("").alias("kept_sha256")).schema
    return repeats(docs, length, gram).mapInArrow(_apply(length, whole_characters, passed), schema)


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs`` (doc_id, text)."""
    return deduplicate(numbered(docs.select("doc_id", "text")), length, gram).drop("uid", "kept")
