"""Small tables with the cases that every operator has to bear."""
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}x{rng.randrange(size)}" for _ in range(n))


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    if extra:
        for c in ("_hit", "_did", "_refs", "_id", "_leaks", "kept", "id", "h", "copy", "row", "bucket", "word", "score"):
            df = df.withColumn(c, df["source"])
    return df


def odd_rows(seed=1):
    """Null, empty, blank, symbols, very long, repeated rows, a null id."""
    rng = random.Random(seed)
    long = words(rng, 30_000)
    return [(1, None), (2, ""), (3, "  \n "), (4, "!!! ???"), (5, long), (6, long), (7, "one two"), (7, "one two"), (None, "one two"),
            (None, None), (8, "퟿\U0001f600 é ́x\x00y"), (9, "z" * 100_000), (10, "Tie tie tie tie tie tie tie tie")]
