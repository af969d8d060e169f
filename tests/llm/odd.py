"""Tables with what real ones have: nulls, empty and very long texts, repeated rows, columns with clashing names."""

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, id long, key string, score string, ids string, host string, line string, length string, fill long"
TEXTS = [None, "", " \n\t ", "a", "Plain words stand here, ten of them or a few more than that.", LONG, "tab\tand\nline\n\nline", "日本語 ñandú ß İ ﬁ \U0001f642 \u0000 \x85", "<|endoftext|> it's 12,345", "a" * 5000]


def rows():
    found = [(i, text, None, None if i % 3 else f"src{i % 2}", None, 7, 7, "k", "s", "i", "h", "l", "x", 1) for i, text in enumerate(TEXTS)]
    return [*found, found[4], found[4], (None, "no id", *found[0][2:]), (None, None, *found[0][2:])]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
