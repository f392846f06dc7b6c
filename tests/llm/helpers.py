"""Small fixtures with everything that a table may hold, and brute-force versions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, digest string, label int"
BASE = " ".join(f"word{k}" for k in range(60))

ROWS = [
    (1, BASE, "en", "a", 1),
    (2, BASE, "en", None, 1),
    (3, BASE.replace("word59", "other"), None, "a", 1),
    (4, BASE + " tail of four words", "en", "a", None),
    (5, "", "en", "a", 0),
    (6, None, "en", "a", 0),
    (7, "  \n\t ", "en", "a", 0),
    (8, "one two", "en", "a", 0),
    (9, "One TWO", "en", "a", 0),
    (10, "É é ñ 日本語 🎉 <|endoftext|> it's  we'll\r\n x\x1cy z", "fr", "a", 0),
    (11, "lorem ipsum " * 20_000, "la", "a", 0),
    (12, "same same same same same same same", "en", "a", 0),
    (12, "same same same same same same same", "en", "a", 0),
    (None, "no id here", "en", "a", 0),
    (14, " ".join(f"word{k}" for k in range(30, 90)), "en", "a", 0),
    (15, "x" * 50_000, "en", "a", 0),
]


def documents(spark: SparkSession, rows=ROWS) -> DataFrame:
    return spark.createDataFrame([(*r, 77, "clash", 1) for r in rows], SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def tokenizer_json() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def library_ids(texts):
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_json())
    return [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4") for x in texts]


def shingle_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def components(rows):
    """doc_id to the least doc_id that links of similarity 0.75 reach."""
    sets = {}
    for doc_id, text in rows:
        if doc_id is not None:
            sets[doc_id] = shingle_set(text)
    label = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label
