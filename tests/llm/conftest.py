import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, sources=None):
        ids = list(range(len(texts))) if ids is None else ids
        sources = sources or [f"src{i % 3}" for i in range(len(texts))]
        rows = [(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources, strict=True)]
        return spark.createDataFrame(rows, KIND).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, one word, repeats, a very long text, characters outside ASCII and the BMP."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    base = prose(rng, 120)
    return [
        None, "", " \t\n\x0b\x0c\r ", "word", "word", base, base, base + " more", base.replace(" ", "  \n"), long, "été \U0001f600 Über  x",
        "A B C D", "a b c d", prose(rng, 80), prose(rng, 200),
    ]


@pytest.fixture(scope="session")
def write_table(spark, tmp_path_factory):
    def write(df, name="documents"):
        folder = tmp_path_factory.mktemp("tables")
        df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write
