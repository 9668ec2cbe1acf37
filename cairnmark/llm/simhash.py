"""Near-duplicate classes by SimHash with exact tiled comparison.

``fingerprints`` gives every text the bitwise majority of the 64-bit hashes of
its word shingles. ``near_components`` links distinct fingerprints at
``radius`` or fewer differing bits and returns the connected components:

1. Equal fingerprints are one node, so exact copies are never compared.
2. Nodes are dealt into tiles of one population count each (a hot count gets as
   many tiles as it needs). Fingerprints whose counts differ by more than the
   radius cannot link, so such tile pairs are never formed.
3. Each pair of tiles is compared in full with numpy exclusive-or and bit
   counts; inside a pair, runs whose upper halves' counts differ by more than
   the radius are skipped the same way. A task keeps a union-find of its two
   tiles and returns one link for each node it joined, never all pairs.
4. The links are contracted to components by alternating large-star and
   small-star rounds, whose joins are on single keys and can be split.

Null texts have no words. A text of fewer words than a shingle is one shingle
of all of them; no words give fingerprint zero, linked like any other. Repeated
rows stay and share a class; null ids take part but never name a class unless
all its ids are null (then the class id is null). Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnmark.llm import ragged
from cairnmark.llm.shared import cut

SEED = 42
#: Fingerprints in a tile, at least and at most; between, about ``TILES`` tiles.
TILE, TILES = (2048, 65536), 32
_BLOCK = 1 << 18


def _hashes(text: bytes, size: int) -> list[int]:
    toks = text.split()
    if not toks:
        return []
    joined = b" ".join(toks)
    ends = np.cumsum(np.fromiter(map(len, toks), np.int64, len(toks)) + 1) - 1
    if len(toks) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = np.concatenate([[0], ends[:-size] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def fingerprints(docs: DataFrame, shingle: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp): the SimHash of every text as a signed 64-bit integer."""
    picked = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))

    def work(rows, data, offs):
        raw = ragged.LOWER[data].tobytes()
        out = np.zeros((rows.num_rows, 64), bool)
        for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            h = np.array(_hashes(raw[a:b], shingle), np.uint64)
            if len(h):
                bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                out[i] = 2 * bits.sum(axis=0, dtype=np.uint32) > len(h)
        fp = np.packbits(out, axis=1, bitorder="little").view(np.int64).ravel()
        return pa.RecordBatch.from_arrays([rows.column("id"), pa.array(fp)], names=["id", "fp"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(ragged.mapper(work), f"id {kind}, fp long").withColumnRenamed("id", id_column)


class _Forest:
    """Union-find over indices, with all roots kept compressed in one array."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            low, high = np.minimum(ra[apart], rb[apart]), np.maximum(ra[apart], rb[apart])
            np.minimum.at(self.root, high, low)
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def link_tiles(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join every two fingerprints within ``radius``; ``right`` None: within one tile."""
    halves = [np.bitwise_count(x >> np.uint64(32)).astype(np.int16) for x in ((left,) if right is None else (left, right))]
    orders = [np.argsort(h, kind="stable") for h in halves]
    a, ha = left[orders[0]], halves[0][orders[0]]
    b, hb = (a, ha) if right is None else (right[orders[1]], halves[1][orders[1]])
    nodes = a if right is None else np.concatenate([a, b])
    shift = 0 if right is None else len(a)
    forest = _Forest(len(nodes))
    for half in np.unique(ha).tolist():
        lo, hi = np.searchsorted(ha, [half, half + 1])
        first, last = np.searchsorted(hb, [half - radius, half + radius + 1])
        first = max(first, lo) if right is None else first
        if first >= last:
            continue
        some = b[first:last]
        step = max(1, _BLOCK // len(some))
        for at in range(lo, hi, step):
            near = np.bitwise_count(a[at : min(at + step, hi), None] ^ some[None, :]) <= radius
            hits = np.flatnonzero(near)
            if len(hits):
                i, j = np.divmod(hits, len(some))
                i, j = i + at, j + first + shift
                if right is None:
                    i, j = i[i < j], j[i < j]
                forest.link(i, j)
    joined = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return nodes[joined].view(np.int64), nodes[forest.root[joined]].view(np.int64)


def tile_links(nodes: DataFrame, radius: int, tile: tuple[int, int] = TILE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` of ``nodes``: their components are those of all pairs within ``radius``."""
    counted = nodes.select("fp", F.bit_count("fp").alias("ones"))
    sizes = {r.ones: r.n for r in counted.groupBy("ones").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    size = min(max(sum(sizes.values()) // TILES, tile[0]), tile[1])
    parts = {ones: -(-n // size) for ones, n in sizes.items()}
    of_ones = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]) if parts else F.create_map(F.lit(0), F.lit(1))
    dealt = counted.withColumn("part", F.pmod(F.xxhash64("fp"), F.element_at(of_ones, F.col("ones"))).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        blob = np.sort(pdf["fp"].to_numpy(np.int64)).tobytes()
        return pd.DataFrame({"ones": pdf["ones"].iloc[:1], "part": pdf["part"].iloc[:1], "tile": [blob]})

    def pair(frames):
        for pdf in frames:
            for ones, part, blob in zip(pdf["ones"], pdf["part"], pdf["tile"], strict=True):
                for other in range(ones - radius, ones + radius + 1):
                    for k in range(parts.get(other, 0)):
                        one, two = sorted([(ones, part), (other, k)])
                        yield pd.DataFrame({"pair": [f"{one[0]}.{one[1]}-{two[0]}.{two[1]}"], "second": [(ones, part) != one], "tile": [blob]})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        tiles = [np.frombuffer(x, np.uint64) for x in pdf.sort_values("second")["tile"]]
        same = pdf["pair"].iloc[0].split("-")
        if len(tiles) == 1 and same[0] != same[1]:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        a, b = link_tiles(tiles[0], tiles[1] if len(tiles) > 1 else None, radius)
        return pd.DataFrame({"a": a, "b": b})

    tiles = dealt.groupBy("ones", "part").applyInPandas(pack, "ones int, part int, tile binary")
    return tiles.mapInPandas(pair, "pair string, second boolean, tile binary").groupBy("pair").applyInPandas(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); ``root`` is the smallest node reachable. Nulls and loops are ignored."""
    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e"))
        edges = cut(small.select("e.*").where("u != v").distinct())
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_components(prints: DataFrame, radius: int = 4, id_column: str = "doc_id") -> DataFrame:
    """``prints`` (id, fp) with ``component_id``: the smallest id reachable over links within ``radius``."""
    prints = cut(prints.select(F.col(id_column).alias("id"), "fp"))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("low"))
    roots = components(tile_links(nodes, radius))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = cut(linked.groupBy("root").agg(F.min("low").alias("component_id")))  # written, so that Spark can split the rows of a large component in the join
    of_print = cut(linked.join(named, "root").select("fp", "component_id"))
    return prints.join(of_print, "fp").select(F.col("id").alias(id_column), "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every text."""
    found = near_components(fingerprints(docs, shingle), radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
