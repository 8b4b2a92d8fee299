"""Small documents with copies, near copies, shared passages, nulls and repeated rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(seed=1, n=60):
    rng = random.Random(seed)
    passage = " ".join(words(rng, 60))
    out = []
    for k in range(n):
        body = words(rng, rng.choice([3, 20, 80, 200]))
        if k % 5 == 0:
            body[len(body) // 2 : len(body) // 2] = [passage]
        out.append(" ".join(body))
    for k in range(8):  # exact copies
        out.append(out[k * 3])
    for k in range(10):  # near copies
        body = out[(k * 7) % n].split()
        if len(body) > 60:
            body[len(body) // 3] = "changed"
        out.append(" ".join(body))
    out += [None, "", "   ", "éé ß 漢字 😀 " * 30, "one", "x" * 30_000]
    return [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(out)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def with_extras(df, *names):
    """Extra columns whose names the operators use themselves."""
    for name in names:
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df
