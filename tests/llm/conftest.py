import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Small corpus with every awkward case: (doc_id, text, lang, source, n_chars)."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long = prose(60), prose(4000)
    texts = [prose(rng.randint(1, 120)) for _ in range(60)]
    texts += [prose(20) + " " + passage + "\n" + prose(20) for _ in range(6)]
    base = prose(150).split()
    for i in range(12):
        near = list(base)
        near[(i * 13) % 150] = f"edit{i}"
        texts.append(" ".join(near))
    chain = prose(100).split()
    for i in range(6):  # each near the next, the first far from the last
        for k in range(i, i + 2):
            chain[(k * 17) % 100] = f"drift{i}x{k}"
        texts.append(" ".join(chain))
    texts += [texts[3]] * 5 + [texts[3].upper(), long, long + " tail", "", None, " \n\t ", "one", "one two", "one two", "ONE TWO", "été à Âge ñ — “x”", "a\x85b\xa0c", "don't we'll 123 4567!? 😀😀", "x " * 90]
    return [(i, t, ("en", "fr", None)[i % 3], ("s1", "s2", None, "s1", "z")[i % 5], len(t) if t is not None else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
