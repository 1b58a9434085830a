import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, repeated rows, a hot source."""
    rng = random.Random(5)
    base, passage = words(rng, 120), words(rng, 130)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), base.upper(), passage + " " + words(rng, 30), words(rng, 40) + "\n" + passage, "x y z", "X  y\tz", None, "", " \n", words(rng, 4000)]
    texts += ["Mail ann.lee42@mail1.example.com now, card 4785380592391139 " + words(rng, 20), "From 152.143.123.131 to ann.lee42@mail1.example.com " + words(rng, 20)]
    texts += ["a b c d e f g a b c d e f g", "same line\nsame line\n\n\nother ### $$$", "ünï cödé ß 中文 😀 " + words(rng, 15), "0123456789" * 90]
    texts += [words(rng, rng.randint(5, 60)) for _ in range(22)]
    made = [(i, t, "en", None if i % 11 == 7 else f"src{0 if i % 3 else i % 5}", len(t or "")) for i, t in enumerate(texts)]
    return [*made, made[12], (None, words(rng, 12), None, None, 0)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def sf_dir(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
