"""Small tables with the awkward rows, and plain Python words."""

import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def blank(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def docs_of(spark, rows, extra=""):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for name in extra.split():
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def prose(seed, n, vocabulary=400):
    """n invented words, the same for the same seed."""
    out, x = [], seed * 2654435761 % (1 << 32) + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(f"w{(x >> 8) % vocabulary}é"[: 2 + x % 5] + f"{(x >> 12) % vocabulary}")
    return " ".join(out)
