"""Small tables with the odd rows that every operator has to bear."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = "the of and to licence data token river stone key night é ñandú 中文 😀 a b c".split()


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def odd_documents(spark, n=120, seed=1):
    rng = random.Random(seed)
    rows = [(k, sentence(rng, rng.randrange(1, 80)) + rng.choice(["", ".\nend", "\t\n \x0b"]), "en", f"s{k % 3}", 0)
            for k in range(n)]
    rows += [(1000 + k, rows[k][1], "en", "s0", 0) for k in range(20)]                # copies
    rows += [(None, None, None, None, None), (2000, "", "", "", 0), (2001, " \n\t", None, "s1", 3)]
    rows += [(None, "no id", None, "s1", 5), (2002, None, "en", None, None)]
    rows += [rows[3], rows[3], rows[-1]]                                               # repeated rows
    rows += [(3000, sentence(rng, 30_000), "en", "s2", 0), (3001, "x" * 20_000, "en", "s2", 0)]
    return spark.createDataFrame(rows, DOCS)


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def with_clashes(df, *names):
    """`df` with columns of the given names, as an operator might use inside or return."""
    from pyspark.sql import functions as F
    return df.withColumns({name: F.lit("own") for name in names})
