import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make(spark):
    """Documents from (id, text) pairs, with columns whose names an operator may use itself."""

    def documents(rows, extra=False):
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        if not extra:
            return spark.createDataFrame(full, DOCUMENTS)
        names = "score double, kept boolean, rep long, key long, n long, label double, component long, row long, bin long, place long"
        return spark.createDataFrame([(*r, *[None] * 10) for r in full], f"{DOCUMENTS}, {names}")

    return documents


ODD_TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "Word " * 3000),
    (6, "don't stop <|endoftext|> café 中文 \x1c ’tis"),
    (7, "the same text with some words in it"),
    (8, "the same text with some words in it"),
    (9, "x" * 20000),
]
