"""Rows that every operator must take."""

TEXTS = [None, "", " ", "the same text of some words", "the same text of some words", "Ünï çødé 漢字 🙂 text", "x", "%%% 12 %%%", "long " * 30_000, "a\nb\tc\x0bd\x85e"]


def documents(spark, texts=TEXTS, extra=True):
    """Documents with hard texts, a repeated row, and columns named like results."""
    rows = [(i, t, ("en", None, "")[i % 3], "s", len(t or ""), -1, "own") for i, t in enumerate(texts)]
    rows += rows[3:4]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, ids string")
    return frame if extra else frame.drop("score", "ids")


def save(frame, folder, name="documents"):
    frame.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
