"""Small awkward tables for the tests of this folder."""

import random

LONG = "lorem " * 30_000

TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "one two",
    "One two THREE",
    "alpha beta gamma delta " * 20,
    "alpha beta gamma delta " * 20,
    "Été à la plage, déjà vu ! 日本語 <|endoftext|> done",
    "tab\tand\x0bvertical\n\nlines\nlines\nlines",
    "x" * 300,
    "no-break\xa0space and\x1cseparator and\x85next",
    LONG,
    LONG,
]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fp long, n_words string, ids int, shard string, slot string"


def rows():
    """Documents with nulls in every column, ties, repeated rows and columns named like outputs."""
    out = [(i, t, "en", f"s{i % 3}", len(t or ""), None, 5, "x", 1, "y", "z") for i, t in enumerate(TEXTS)]
    out.append(out[5])
    out.append((None, "no id but words enough to have a few shingles", None, None, None, None, None, None, None, None, None))
    return out


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def save(spark, path, docs):
    """A folder of tables as queries take it."""
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


def prose(n=60, seed=3):
    """Texts with copies, near copies and shared passages."""
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("n", "ra", "ti", "é", "s", "mo", "x")]
    shared = " ".join(r.choice(words) for _ in range(40))
    texts = []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.randint(5, 160))]
        if i % 7 == 3:
            t = t[: len(t) // 2] + shared.split() + t[len(t) // 2 :]
        if i % 5 == 4:
            t = texts[r.randrange(len(texts))].split()
            if i % 2:
                t[len(t) // 2] = "edited"
        texts.append(" ".join(t) if i % 6 else "\n".join(" ".join(t[k : k + 9]) for k in range(0, len(t), 9)))
    return texts
