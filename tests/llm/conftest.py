import random

import pytest

EXTRA = ("k", "id", "n", "label", "place", "_id", "item_id", "score")


def prose(rng, n, words=400):
    """Text of made-up words, with marks and line ends."""
    stock = [f"w{i:x}" if i % 7 == 0 else "".join(rng.choice("abcdefghilmnorstu") for _ in range(2 + i % 9)) for i in range(words)]
    return " ".join(rng.choice(stock) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


@pytest.fixture
def documents(spark):
    """A frame of documents from (doc_id, text[, lang]) with columns whose names clash with those used inside."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or ""), *("x" for _ in EXTRA)) for r in rows]
        kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
        return spark.createDataFrame(full, kinds)

    return make


@pytest.fixture
def odd_rows():
    """Null and empty texts, a null id, a repeated row, one id with two texts, a very long text, exact and near copies."""
    rng = random.Random(11)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join(["changed" if i == 60 else w for i, w in enumerate(words)])
    return [(1, None), (2, ""), (3, "  \n\t "), (4, base), (5, base), (6, near), (None, base), (None, None), (7, "one two three"),
            (8, "one two three"), (9, "ONE two three"), (10, prose(rng, 9000)), (11, "a" * 40_000), (12, prose(rng, 60)), (12, prose(rng, 60)),
            (13, "x y z"), (13, "x y z"), (14, " ".join(["same line again"] * 40)), (15, base + " " + prose(rng, 50)), (16, "é à ñ ü\x1c\x85 ok")]
