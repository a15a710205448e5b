"""Small tables with every awkward row: nulls, empty and long texts, repeated rows, clashing column names."""

from __future__ import annotations

import random

WORDS = ["lorem", "ipsum", "dolor", "sit", "amet", "élan", "straße", "vino", "the", "of", "and", "zeta", "kappa", "omega", "nu", "xi"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(400)) for _ in range(n))


LONG = prose(99, 30_000)


def awkward(spark):
    """doc_id, text, lang, source, n_chars and columns named like the operators' own."""
    rows = [
        (0, prose(1, 80), "en", "s0", 5), (1, prose(1, 80), None, "s0", 5), (2, None, "en", None, None), (3, "", "fr", "s1", 0),
        (4, " \t\n ", "fr", "s1", 4), (5, "one", "de", "s1", 3), (6, LONG, "de", "s2", 9), (7, LONG + " tail", None, "s2", 9),
        (8, prose(2, 60), "en", "s2", 1), (8, prose(2, 60), "en", "s2", 1), (None, prose(1, 80), "es", "s3", 2), (None, None, None, None, None),
        (9, "12 34 !!", "en", "s0", 8), (10, "x" * 200_000, "en", "s0", 2), (11, "a\x0bb\x0cc d", "en", "s0", 7),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, seed long, shard int, score double, row string, `hits` binary, `a.b` int, component_id long, kept boolean, h long, __sub int"
    return spark.createDataFrame([(*r, 1, 2, 3.0, "x", b"y", 4, 5, False, 6, 7) for r in rows], schema)


def plain(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def none(spark):
    return awkward(spark).where("false")
