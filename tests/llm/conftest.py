import random

import pytest
from llm_edges import EDGES

@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash with those of results."""
    rows = [(i, t, "en", "src", 0, 1.5, "x", True, 7) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, score double, node string, kept boolean, n_tokens int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def made_docs(spark):
    """Four hundred texts of made-up words: plain ones, junk, exact and near copies."""
    rng = random.Random(5)
    parts = ["an", "er", "tion", "ou", "le", "st", "re", "mi", "ka", "po", "du", "ent"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    rows = []
    for i in range(400):
        text = "\n".join(line(rng.randint(5, 25)) for _ in range(rng.randint(2, 6)))
        quality = 1
        if i % 5 == 0:
            text, quality = " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in text.split()), 0
        elif i > 40 and i % 9 == 0:
            text = rows[i - 7][1]
            quality = rows[i - 7][2]
        elif i > 40 and i % 11 == 0:
            words = rows[i - 9][1].split(" ")
            words[rng.randrange(len(words))] = "changed"
            text, quality = " ".join(words), rows[i - 9][2]
        rows.append((i, text, quality))
    return rows


@pytest.fixture(scope="session")
def docs(spark, made_docs):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in made_docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


@pytest.fixture(scope="session")
def labels(spark, made_docs):
    return spark.createDataFrame([(i, q, 0) for i, _, q in made_docs] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
