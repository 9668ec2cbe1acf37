"""Small documents with every odd case: nulls, empty and long texts, ties, repeats, special strings, clashing columns."""

from __future__ import annotations

import random

PROSE = "the quiet river carried small boats past the old mill while children counted clouds and the baker closed his shop early because rain was coming from the western hills before evening"
PASSAGE = "every third lantern along the northern harbour wall burned with a green flame that winter and nobody in the village could explain who had climbed the icy stairs to fill them with oil again"


def sentences(seed: int, n: int) -> str:
    rng = random.Random(seed)
    vocabulary = [*PROSE.split(), *(f"word{i}" for i in range(80)), "straße", "Éclair", "naïve", "它们", "😀"]
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


def documents() -> list[tuple]:
    near = sentences(7, 120)
    texts = [
        None, "", " \n\t\x0b\x0c\r ", "one", "three short words", PROSE, PROSE, PROSE.upper(), PASSAGE, f"{sentences(1, 60)} {PASSAGE} {sentences(2, 60)}", f"{PASSAGE}\n{PASSAGE}",
        "a b c d e f g h " * 30, "x" * 5000, "ab" * 700, "same line here\n" * 20, near, near + " end", near.replace("river", "stream", 1), sentences(3, 9000),
        "<|endoftext|> <s> </s> <unk> <0x41> ▁ it's we'll I'd 12345 !!??", "MIT License and mit\nlicense; Apache-License, GNU General Public License mit", "# * $ % & | < >", "\x00 nul \x7f del ﻿ bom   nbsp   ls",
        "日本語のテキスト。" * 40, "é" * 99 + "é" * 99, "tail  ", "  head",
    ]
    rows = [(i * 3, t, "en" if i % 3 else None, "web" if i % 2 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(6, "a second text of one id", "en", "web", 0), (15, PROSE, "en", "web", 1), (None, "a text without an id", None, None, None), (None, PASSAGE, "fr", "web", 5), (None, None, None, None, None)]
    return [*rows, *[(1000 + i, sentences(100 + i, 150), "en", "web", 1) for i in range(30)]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None, clash: bool = True):
    """The documents as a DataFrame; ``clash`` adds columns named as the operators' own."""
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        for name in ("uid", "id", "fp", "block", "key", "kept", "spans", "host", "score", "n_words", "held", "path", "start"):
            df = df.withColumn(name, F.lit("clash"))
    return df


ITEMS = [(1, PASSAGE), (2, "three short words"), (3, None), (4, ""), (5, " ".join(PROSE.split()[3:16])), (5, " ".join(PROSE.split()[3:16])), (None, "quiet river"), (7, "ONE"), (10, PASSAGE + " and more")]


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")
