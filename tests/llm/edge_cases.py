"""Texts and tables that every operator must take."""

LONG = "word and more of it, again. " * 40_000
TEXTS = [None, "", " \t\n ", "a", "naïve café — 日本語 ٣ 👩‍👩‍👧 ½", "<|endoftext|> b <|endoftext|>", "x" * 5000, "\n\n\n", "line one\r\nline two\n", "aaaa " * 300, LONG]
#: Runs of blanks that regular expressions with backtracking can't take.
BLANKS = [" " * 1_100_000, "\n" * 1_100_000 + "x", " \n\t" * 400_000, "a b" + "\r\n" * 600_000 + " end"]
CLASHING = "doc_id bigint, text string, lang string, row string, n int, key string, id bigint, lines string, score string, piece string, node string, md5 string"


def documents(spark, texts=None, start=0):
    rows = [(start + i, t) for i, t in enumerate(TEXTS if texts is None else texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def awkward(spark):
    """All texts, a null id, repeated rows, and extra columns whose names the operators might use."""
    rows = [(i, t, "en", "r", 1, "k", 7, "l", "s", "p", "n", "m") for i, t in enumerate(TEXTS)]
    rows += [(None, "some text of no id", None, None, None, None, None, None, None, None, None, None), *rows[3:5]]
    return spark.createDataFrame(rows, CLASHING)


def empty(spark):
    return spark.createDataFrame([], CLASHING)
