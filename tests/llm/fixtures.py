"""Small tables with the cases that every operator must stand."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
#: Extra columns whose names the operators use inside.
CLASH = "component_id long, family long, rep long, key string, size long, copies long, label int, n_bytes long, n_tokens long, lang_pred string, score double, spans string, start long"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ing"]) for _ in range(n))


def changed(text, every):
    """``text`` with each ``every``-th word replaced."""
    return " ".join(w if i % every else f"new{i}" for i, w in enumerate(text.split(" ")))


def documents():
    """(doc_id, text, lang, source) rows: nulls, empties, ties, repeated rows, copies, a very long text."""
    base = prose(1, 80)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),  # a repeated row
        (3, base.upper(), "en", None),
        (4, changed(base, 40), "en", "b"),
        (5, changed(base, 4), "en", "b"),
        (6, None, "en", "a"),
        (7, "", None, "c"),
        (8, " \t\n", "de", None),
        (9, "one", "de", ""),
        (10, "one", "de", "c"),
        (11, "one two", "fr", "c"),
        (None, base, "en", "a"),
        (None, None, None, None),
        (12, "  spaced   out \n\n words ", "en", "b"),
        (13, "naïve 日本語 Straße 🙂 ####", "de", "b"),
        (14, prose(2, 30_000), "en", "long"),
        (15, "x" * 200_000, "en", "long"),
        (16, "mail a@b.org or +1 (212) 555-0100, 4111 1111 1111 1111 at 10.0.0.1", "en", "b"),
        (17, "<|endoftext|> and </s> are text", "en", "b"),
    ]
    return rows + [(100 + i, prose(100 + i, 20 + i), ("en", "de")[i % 2], f"s{i % 3}") for i in range(20)]


def frame(spark, rows=None, extra=False):
    df = spark.createDataFrame(documents() if rows is None else rows, "doc_id long, text string, lang string, source string")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in CLASH.split(", ")})
    return df


def plain(df):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, str(type(v)), v if not isinstance(v, (list, dict)) else str(v)) for v in r))
