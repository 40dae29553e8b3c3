"""Small fixtures with the cases every operator must survive."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, copies, repeated rows and clashing extra columns."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa "
    rows = [
        (1, "", "en", "a", 0),
        (2, None, None, None, None),
        (3, word * 3, "en", "a", 1),
        (4, word * 3, "en", "b", 1),
        (5, word * 3 + " ", "en", "b", 1),
        (6, word * 3000, "de", None, 1),
        (7, "x", "fr", "c", 1),
        (7, "x", "fr", "c", 1),
        (None, "no id", "fr", "c", 1),
        (None, None, "fr", "é", 1),
        (8, "Ünïcode \U0001f600 　 text\x0bwith\tblanks", "fr", "é", 1),
    ]
    extra = "size int, t string, n int, node int, h int, c int, bucket int, range int, target int, row int, x_doc_id int"
    names = ", ".join(f"{i} AS {x.split()[0]}" for i, x in enumerate(extra.split(", ")))
    return spark.createDataFrame(rows, DOCS).selectExpr("*", *names.split(", "))


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
