import random

import pytest

VOCABULARY = None


@pytest.fixture(scope="session")
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json")


@pytest.fixture
def prose():
    """A generator of invented prose with a seed of its own."""
    rng = random.Random(7)

    def text(n, letters="aeinorst"):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))

    text.rng = rng
    return text


@pytest.fixture
def docs_df(spark):
    def make(rows):
        """(doc_id, text[, lang]) rows as documents with a column whose name clashes with operators' own."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", 1) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n long")

    return make
