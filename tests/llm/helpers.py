"""Small tables with every odd case the operators must take."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i * i % 997}x{i % 89}" for i in range(30_000))


def documents(spark, rows, extra=True):
    """``rows`` are (doc_id, text) or (doc_id, text, lang); with columns whose names clash."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        df = df.selectExpr(
            "*", "'x' AS fingerprint", "1 AS component_id", "false AS kept", "'y' AS lang_pred", "0 AS __quality",
            "2 AS __language", "3 AS __fp", "4 AS __copies", "5 AS id", "6 AS fp", "7 AS rate", "array(1) AS ids",
        )
    return df


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (5, LONG), (6, "Ünïcödé 日本語 😀"), (7, "1 2 3 !?")]


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
