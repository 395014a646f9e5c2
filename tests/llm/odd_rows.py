"""Small tables with the rows that break things."""

SENTENCE = "the quick brown fox jumps over the lazy dog and runs far away from all of them today"
LONG = " ".join(f"word{i % 977} und{i % 31}" for i in range(60_000))

#: Names that operators use inside or return: none of these columns may disturb one.
CLASHING = ["id", "n_tokens", "kept", "score", "bucket", "h1", "h2", "uid", "rep", "node", "component", "tag", "words", "key", "blob"]


def documents(spark, empty=False):
    rows = [
        (1, SENTENCE, "en", "a"),
        (2, SENTENCE, "en", "a"),
        (3, SENTENCE + " indeed", "en", None),
        (4, None, "en", "b"),
        (5, "", "de", "b"),
        (6, " \n\t ", None, "b"),
        (7, LONG, "en", "c"),
        (8, LONG, "en", "c"),
        (8, LONG, "en", "c"),
        (None, "no id here but some words", "en", "c"),
        (None, None, None, None),
        (9, "£¥ 日本語 🙂 ÉÀ İ Σ", "fr", "d"),
        (10, "12345 67890 !!!", "xx", "d"),
        (11, "<|endoftext|> x <|startoftext|>", "en", "d"),
        (12, "aaaa" * 400, "en", "d"),
    ]
    kinds = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in CLASHING)
    full = [(i, t, lang, s, len(t) if t is not None else None, *CLASHING) for i, t, lang, s in rows]
    return spark.createDataFrame([] if empty else full, kinds)


