import random

import pytest

WORDS = ["alpha", "beta", "gamma", "the", "of", "and", "thing", "running", "walked", "Wonder", "zeta", "omega", "sun", "moon"]
FRENCH = ["le", "la", "rivière", "chêne", "où", "maison", "été", "garçon", "fenêtre", "avec", "déjà", "élève"]


def prose(seed: int, n: int, words=WORDS) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(words) + ("\n" if r.random() < 0.05 else "") for _ in range(n))


def rows() -> list[tuple]:
    long = prose(99, 9000)
    out = [(k, prose(k, 60 + 7 * k), "en", f"src{k % 3}") for k in range(20)]
    out += [(100 + k, prose(k, 80, FRENCH), "fr", "src0") for k in range(20)]
    out += [
        (200, None, "en", "src1"),
        (201, "", None, "src1"),
        (202, "   \n\t ", "fr", None),
        (203, "x", "en", "src2"),
        (204, long, "en", "src0"),
        (205, "1234 !!", None, None),
    ]
    out += [
        (300, out[5][1], "en", "src0"),
        (301, out[5][1] + " extra", "en", "src0"),
        (0, out[0][1], "en", "src0"),
        (None, prose(7, 70), "en", "src1"),
    ]
    return out + [out[3], out[3]]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and columns whose names clash with those of operators."""
    extra = [(*r, len(r[1] or ""), 1, "a", 2.0, [1]) for r in rows()]
    return spark.createDataFrame(
        extra,
        "doc_id long, text string, lang string, source string, n_chars long, row int, record string, size double, words array<int>",
    ).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
