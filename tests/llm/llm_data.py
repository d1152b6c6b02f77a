"""Small tables with every awkward case, for the tests of the corpus operators."""

from __future__ import annotations

DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, row string, key string, "
              "token long, label int, fp long, kept boolean, copies int, bucket int")
#: Columns that operators use inside; they must not matter.
EXTRA = (7, "x", "y", 1, 1, 5, True, 9, 3)


def docs_table(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, lang, s, None, *EXTRA) for i, t, lang, s in rows], DOC_SCHEMA)


LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n\r\x0b\x0c ", "en", "a"), (4, "one", "en", "b"),
    (5, "One", None, "b"), (6, "two words", "en", None), (6, "two words", "en", None), (7, LONG, "de", "c"),
    (8, LONG.upper(), "de", "c"), (None, "no id here", "fr", "c"), (None, "no id here", "fr", "c"), (9, "Ünïcödé  ﬀ x y 😀", "fr", "é"),
    (10, "İstanbul K ſ <|endoftext|> end ", "tr", "😀"), (11, "a\nb\na\nb\n\n \na", "en", "a"), (12, "x" * 5000, "en", "a"),
]
