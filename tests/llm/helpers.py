def documents(spark, rows, extra=False):
    """rows: (doc_id, text, lang, source); extra adds columns whose names the operators use themselves."""
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("size", "rank", "score", "keys", "key", "h1", "u", "copies", "bucket", "n_words", "spans", "__copy", "value"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def words(seed, n, prefix="w"):
    import random

    rng = random.Random(seed)
    return " ".join(f"{prefix}{rng.randint(0, 10**6)}" for _ in range(n))


ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", None), (4, "x", None, "a"), (5, "x", None, "a"), (5, "x", None, "a"), (None, "y z", "en", "b"), (6, "é" * 5, "fr", "a"), (7, "a" * 60_000, "en", "b"),
]
