import random
import re

import pytest

from pagemill.llm.common import prepare

WORD = re.compile("[^\x20\x09-\x0d]+")
SMALL = "/root/testdata/sf0.01"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that the operators use themselves.
CLASHING = "node string, key string, n string, score string, label string, band string, group string, state string, words string, component string"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    prepare(spark)


def invented(seed: int, n: int, vocabulary: int = 4000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Missing, blank, short, very long and repeated texts, near copies, and a missing id."""
    base = invented(1, 200)
    near = base.replace(base.split()[100], "changed", 1)
    far = invented(2, 150) + "\n" + " ".join(base.split()[20:120])
    texts = [
        (0, None), (1, ""), (2, " \n\t \x0b "), (3, "one"), (4, "a B c d"), (5, "A b C d"), (6, base), (7, base.upper()), (8, near),
        (9, far), (10, invented(3, 30_000)), (11, "ü日本 é\x00 " * 40), (12, "x" * 50_000), (13, base), (13, base), (None, base), (None, None),
        (14, "For " * 500), (15, "same line here\n" * 60), (16, "a b c d e f g h i"), (17, "a b c d e f g h j"),
    ]
    return [(i, t, None if k % 3 == 0 else "en", None, None) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    extra = tuple("z" for _ in CLASHING.split(","))
    return spark.createDataFrame([r + extra for r in edge_rows], f"{DOCUMENTS}, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(18)] + [(None, 1, 0), (3, None, None), (6, 0, 1), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
