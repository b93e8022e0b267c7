"""Small document tables for the text operators."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import types as T

# Names that operators use inside, to see that they don't clash.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(n, T.StringType()) for n in ("id", "g", "digest", "words", "bucket", "length", "node", "part")],
])

PASSAGE = " ".join(f"passage{k}" for k in range(30))


def sentences(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(words))


def odd_rows() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, copies, near copies, shared passages, repeated rows, a long text."""
    base = sentences(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, None), (1, ""), (2, " \n\t "), (3, base), (4, base), (5, " ".join(near)), (6, "one two"), (7, "One  two"),
        (8, sentences(2, 50) + " " + PASSAGE), (9, PASSAGE + " " + sentences(3, 50)), (9, PASSAGE + " " + sentences(3, 50)),
        (10, "same " * 80), (11, "ünïcode " * 30 + "日本語 ▁ <s> <|endoftext|> \x00 end"), (None, base), (None, None),
        (12, sentences(4, 6000)), (13, "12345 67890 !!! ..."), (14, base.upper()), (15, "x" * 3000),
        (16, sentences(5, 30) + " " + sentences(5, 30)), (-5, sentences(2, 50)),
    ]
    return rows + [(k, sentences(k, 20 + k % 60)) for k in range(20, 60)]


def frame(spark, rows):
    extra = ("en", "src", None, "i", "g", "d", "w", "b", "l", "n", "p")
    return spark.createDataFrame([(k, t, *extra) for k, t in rows], SCHEMA)


def collected(df, *keys: str) -> pd.DataFrame:
    return df.toPandas().sort_values(list(keys), na_position="first").reset_index(drop=True)
