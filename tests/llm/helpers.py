import random

SCHEMA = "doc_id long, text string, lang string, source string, k_id string, n_lines int, score string, base int"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, "en", "s", "x", 7, "y", 1) for i, t in rows], SCHEMA)


def words(seed, n=400, alphabet="abcdefghij"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(2, 8))) for _ in range(n)]


#: Null ids and texts, empty and wordless texts, repeated rows, ties.
ODD = [(None, None), (None, "one two three four five six"), (1, None), (2, ""), (3, " \n\t "), (4, "!!! ..."), (5, "word"), (5, "word"), (6, "word"), (7, "äöü ß"), (8, "\U0001f600 x")]


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
