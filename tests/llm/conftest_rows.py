"""Rows that an operator must take."""

#: Nulls, empty and blank texts, repeats, ties, and a clashing extra column.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, c long, item long"


def hard_rows():
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "a b c d", "a b c d", "a b c d e f g h i j", "A b C d e f g h i j", long, long + " end", "!!! ### $$$", "é日本 ²ⅷ <|endoftext|> x"]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s2"][i % 3], len(t or ""), 0.1, 7, 9) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[8], (None, "no id here", "en", "s1", 10, 0.1, 7, 9)]
