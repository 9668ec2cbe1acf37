"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnmark.llm.byte_bpe import digests
from cairnmark.llm.decontaminate import contamination
from cairnmark.llm.divergence import divergences
from cairnmark.llm.html_text import main_text
from cairnmark.llm.language_model import score_texts
from cairnmark.llm.license_scan import licenses
from cairnmark.llm.line_crf import line_quality
from cairnmark.llm.merkle import every_fifth_lowered, manifest
from cairnmark.llm.quality import quality
from cairnmark.llm.simhash import near_duplicates
from cairnmark.llm.suffix_dedup import removed
from cairnmark.llm.token_counts import token_counts
from cairnmark.llm.token_store import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("uid")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(_table(spark, sf_dir, "documents"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(_table(spark, sf_dir, "documents"))


def op12_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_table(spark, sf_dir, "documents"), other_text=every_fifth_lowered())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_main_text, op2_decontamination, op3_token_counts, op4_token_store, op5_near_duplicates, op6_byte_bpe, op7_suffix_dedup, op8_quality_rules, op9_license_scan, op10_language_model, op11_source_divergence, op12_line_crf, op13_merkle_manifest)
    return {f.__name__: f for f in found}


#: Words of a text as the decontamination contract takes them.
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, list_slice(w, p, p + least(13, len(w)) - 1) AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT uid, size, p, list_slice(w, p, p + size - 1) AS win
       FROM (SELECT uid, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT uid, item_id, p, size FROM dw JOIN iw USING (size, win)),
marked AS (SELECT uid, count(DISTINCT pos) AS n_hit FROM (SELECT uid, unnest(range(p, p + size)) AS pos FROM (SELECT DISTINCT uid, p, size FROM hits)) GROUP BY uid),
items AS (SELECT uid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marked USING (uid) LEFT JOIN items USING (uid)
"""


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS uid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT uid, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT uid) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS MATERIALIZED (SELECT k.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.total + 2 * v.v) AS p
      FROM kept k JOIN v USING (lang) JOIN s USING (lang) LEFT JOIN c ON c.lang = k.lang AND c.source = s.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // ((SELECT sum(total) FROM s WHERE s.lang = p.lang) + 2 * (SELECT v.v FROM v WHERE v.lang = p.lang)) AS q FROM p GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""

#: CRC-32 of ``id`` in decimal, byte by byte over a table of 256 that the SQL makes itself.
_CRC_TABLE = "SELECT list(list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS steps FROM range(256) r(b)"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({id} AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


def _tree_sql(leaves: str, name: str, levels: int) -> str:
    """CTEs ``{name}0`` to ``{name}{levels}`` (grp, idx, digest, n) over ``leaves`` (grp, idx, digest, n)."""
    above = "SELECT grp, idx // 16 AS idx, CASE WHEN n = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY idx)) END AS digest, (n + 15) // 16 AS n FROM {below} GROUP BY grp, idx // 16, n"
    return f"{name}0 AS MATERIALIZED ({leaves}),\n" + ",\n".join(f"{name}{k} AS MATERIALIZED ({above.format(below=f'{name}{k - 1}')})" for k in range(1, levels + 1))


def _siblings_sql(name: str, k: int, grp: str, idx: str) -> str:
    """Digests beside node ``idx`` // 16 ** k of level k, those before and those after it, empty above a group's end."""
    side = "coalesce((SELECT string_agg(s.digest, '' ORDER BY s.idx) FROM {name}{k} s WHERE s.grp = {grp} AND s.idx // 16 = {idx} // {up} AND s.idx {than} {idx} // {at}), '')"
    return tuple(side.format(name=name, k=k, grp=grp, idx=idx, up=16 ** (k + 1), at=16**k, than=than) for than in "<>")


def _manifest_sql(levels: int = 5) -> str:
    """Trees of up to 16 ** ``levels`` leaves and sources."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    steps = [("l", k, "o.grp", "o.idx", "n") for k in range(levels)] + [("s", k, "0", "o.grp", "(SELECT count(*) FROM s0)") for k in range(levels)]
    folds = []
    for i, (name, k, grp, idx, n) in enumerate(steps):
        left, right = _siblings_sql(name, k, grp, idx)
        more = f"({n} + {16**k - 1}) // {16**k} > 1"
        folds.append(f"f{i} AS MATERIALIZED (SELECT * EXCLUDE (node, proof), CASE WHEN {more} THEN sha256({left} || node || {right}) ELSE node END AS node, proof || CASE WHEN {more} THEN {left} || {right} ELSE '' END AS proof FROM {f'f{i - 1}' if i else 'd'} o)")
    return f"""
WITH crc AS ({_CRC_TABLE}),
h AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp, {leaf("text")} AS leaf,
      CASE WHEN doc_id IS NOT NULL AND text IS NOT NULL AND {_CRC.format(id="doc_id")} % 5 = 0 THEN {leaf(lower)} END AS other FROM documents, crc),
d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n, coalesce(other, leaf) AS node, '' AS proof FROM h),
{_tree_sql("SELECT grp, idx, leaf AS digest, n FROM d", "l", levels)},
{_tree_sql(f"SELECT 0 AS grp, grp AS idx, digest, count(*) OVER () AS n FROM l{levels}", "s", levels)},
{(","+chr(10)).join(folds)}
SELECT doc_id, leaf, (SELECT digest FROM l{levels} t WHERE t.grp = f.grp) AS subroot, (SELECT digest FROM s{levels}) AS root, sha256(proof) AS proof_sha256, node AS folded_root,
       node = (SELECT digest FROM s{levels}) AS verified
FROM f{len(folds) - 1} f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op11_source_divergence": OP11_SQL, "op13_merkle_manifest": _manifest_sql()}
