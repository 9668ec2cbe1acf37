"""The contracts of the operators' digests in plain Python, one text at a time; for small inputs only."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import xxhash

UPPER = {c: c + 32 for c in range(0x41, 0x5B)}
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")


def alnum(text):
    return ALNUM.findall((text or "").translate(UPPER))


def words(text):
    return WORD.findall(text or "")


def contamination(docs, items, window=13):
    """doc rows (doc_id, text) and item rows (item_id, text) to (doc_id, n_words, n_hit, n_items, sha, contaminated)."""
    wanted = collections.defaultdict(set)
    for item, text in items:
        w = alnum(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            wanted[tuple(w[i : i + size])].add(item)
    sizes = {len(k) for k in wanted}
    out = []
    for doc, text in docs:
        w = alnum(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i : i + size])) in wanted:
                    hit.update(range(i, i + size))
                    found |= wanted[k]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def piece_counts(docs, name="piece_bpe_32k.model", limit=4096):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return [(d, len((t or "").encode()), n := len(model.encode(t or "")), n > limit) for d, t in docs]


def token_store(docs, name="word_bpe_49k.json", end=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    start, out = 0, []
    tie = lambda text: 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    coded = [(d, [*t.encode(text or "", add_special_tokens=False).ids, end], tie(text)) for d, text in docs]
    for d, ids, _ in sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0, r[2] - (r[2] >> 63 << 64))):
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def simhash(text, size=4):
    w = words((text or "").translate(UPPER))
    grams = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(docs, radius=4):
    prints = [(d, simhash(t)) for d, t in docs]
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    fps = np.array([p for _, p in prints], np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, f"{p:016x}", low.get(find(i))) for i, (d, p) in enumerate(prints)]


def byte_bpe(docs, name="byte_bpe_50k.tiktoken"):
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for d, text in docs:
        ids = enc.encode_ordinary(text or "")
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return out


def removed(docs, length=100):
    """Rows in the order (doc_id, text), nulls first."""
    seen, out = set(), []
    for d, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = hash(raw[i : i + length])
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def without_repeats(docs, length=100):
    """(doc_id, text) without the characters that ``removed`` covers in whole."""
    seen, out = set(), []
    for d, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if (s := raw[i : i + length]) in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        at, kept = 0, []
        for c in text or "":
            size = len(c.encode())
            kept.append("" if all(gone[at : at + size]) else c)
            at += size
        out.append((d, "".join(kept)))
    return out


def rules(docs, window=8):
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    out = []
    for d, text in docs:
        w = words(text)
        lines, dup = set(), 0
        for line in (text or "").split("\n"):
            if words(line):
                dup += line in lines
                lines.add(line)
        grams = collections.Counter(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
        cover = {i + j for i in range(len(w) - window + 1) if grams[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)))
    return out


def phrases(docs):
    """(doc_id, n_words, n_base, first_word, last_word, base_labels)."""
    wanted = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    out = []
    for d, text in docs:
        w = alnum(text)
        at = sorted((i, label) for p, label in wanted.items() for i in range(len(w) - len(p) + 1) if tuple(w[i : i + len(p)]) == p)
        out.append((d, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    return out


def unigram(docs):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    toks = [[*words((t or "").translate(UPPER)), None] for _, t in docs]
    c = collections.Counter(x for h, ts in zip(held, toks, strict=True) if not h for x in ts)
    total = sum(c.values())
    return [(d, h, len(ts), sum(c[x] > 0 for x in ts), total, sum(math.log10((c[x] + 1) / (total + len(c) + 1)) for x in ts)) for (d, _), h, ts in zip(docs, held, toks, strict=True)]


def manifest(rows, fanout=16):
    """Document rows (doc_id, text, lang, source, n_chars) to (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""

    def digest(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(doc, text, lang, source, n):
        return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc, source, lang, n, text)))

    def tree(nodes):
        """The end of the nodes, and of each one the (left, right) siblings level by level."""
        paths, of = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            up, held = [], []
            for a in range(0, len(nodes), fanout):
                run = nodes[a : a + fanout]
                for j, below in enumerate(of[a : a + fanout]):
                    for i in below:
                        paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
                up.append(digest(*run))
                held.append([i for below in of[a : a + fanout] for i in below])
            nodes, of = up, held
        return nodes[0], paths

    groups = collections.defaultdict(list)
    for r in rows:
        low = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(*r), leaf(r[0], r[1].translate(UPPER), *r[2:]) if low else None, r[0]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, over = tree([trees[s][0] for s in order]) if order else ("", [])
    out = []
    for s, up in zip(order, over, strict=True):
        for x, path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            path, node = path + up, x[3] or x[2]
            for left, right in path:
                node = digest(left, node, right)
            out.append((x[4], x[2], trees[s][0], root, digest(*(a + b for a, b in path)), node, node == root))
    return out


LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def divergences(rows, least=10, top=10):
    """Document rows (doc_id, text, lang, source) to (lang, source, part, item, value, rank)."""
    count, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    groups = collections.defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = LETTERS.findall((text or "").translate(UPPER))
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        total = {t: sum(count[lang, s][t] for s in sources) for t in kept}

        def shares(of, kept=kept):
            n = sum(of[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (of[t] + 2) // n for t in kept}

        apart = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(count[lang, s]) for s in sources}, shares(total)
        for s in sources:
            pairs = [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            firsts = [(t, apart(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", firsts)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[: None if part == "pair" else top])]
    return out
