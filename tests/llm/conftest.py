import pytest

WORDS = "amber brook cedar delta ember frost grove hazel inlet jasper kelp larch maple north olive pearl quartz ridge stone thyme".split()


@pytest.fixture(scope="session")
def prose():
    """``prose(seed, n)``: n words, the same for the same seed."""
    import random

    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text) rows, with a column no operator knows."""

    def make(rows):
        full = [(i, t, "xx", "s0", None if t is None else len(t), "extra") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, keep_id string").repartition(3)

    return make
