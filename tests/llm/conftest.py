import pytest

SF = "/root/testdata/sf0.001"
# Names that operators use inside; an input may have them too.
CLASHING = {
    "size": "long", "rate": "double", "copies": "long", "key": "long", "n": "long", "prefix": "string",
    "grams": "string", "score": "string", "features": "string", "kept": "string", "component": "string",
    "holder": "string", "email": "string", "term": "string", "label": "string", "ids": "string", "row": "string",
}
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
WORDS = "the quick brown fox jumps over a lazy dog while nine old men watch from afar and say little".split()


def sentence(seed: int, n: int = 40) -> str:
    return " ".join(f"{WORDS[(seed * 7 + i * i) % len(WORDS)]}{(seed + i) % 13}" for i in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table of (doc_id, text, source) rows with clashing columns."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), *[None] * len(CLASHING)) for i, t, s in rows]
        extra = "".join(f", {c} {k}" for c, k in CLASHING.items())
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long{extra}")

    return make


@pytest.fixture(scope="session")
def messy_rows():
    return [
        (1, sentence(1), "a"), (1, sentence(1), "a"), (2, sentence(1), "b"), (3, None, "a"), (4, "", None),
        (5, " \t\n", "b"), (6, LONG, "a"), (None, sentence(2), None), (None, None, None), (7, "one", "a"),
        (8, "ONE", "a"), (9, "x@y.zz " * 300, "c"), (10, "\U0001f600 café 漢字 ß", "c"),
        (11, sentence(3) + " tail", "a"), (12, sentence(3), "a"),
    ]


@pytest.fixture(scope="session")
def messy(documents, messy_rows):
    return documents(messy_rows)


@pytest.fixture(scope="session")
def empty(documents):
    return documents([])
