"""Tables of awkward rows that every operator has to take."""

from __future__ import annotations

WORDS = "the of and to in alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n: int, seed: int = 1) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


LONG = prose(60_000, 9)

# doc_id, text, lang, source, n_chars
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "one", "en", "a", 3),
    (5, "tie tie\ntie tie", "en", "a", 15),
    (5, "tie tie\ntie tie", "en", "a", 15),
    (6, LONG, "en", "a", len(LONG)),
    (7, "é漢字🙂 \u00a0\u2003x\u0000y", "xx", "b", 12),
    (8, prose(80, 2), "en", "b", 500),
    (9, prose(80, 2).upper(), "en", "b", 500),
    (None, prose(80, 2), None, None, None),
    (10, "***" * 400, "en", "b", 1200),
]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside, as columns of the input.
CLASHES = "h long, line string, host string, key string, page long, items string, spans string, at int, gram string, fp binary, n long, sig binary, label int, score double, ref_lang string, path string, winners string, a int, b int, root int, node int, component string"


def awkward(spark, clashes: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, SCHEMA)
    if clashes:
        for c in CLASHES.split(", "):
            name, kind = c.split(" ")
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
