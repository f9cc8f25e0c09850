import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, norm string, target double, length long, score double, file string, rank int, held boolean, y int"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and blank texts, repeats, equal texts but for white space, near copies, a very long text, many languages."""
    rng = random.Random(3)
    long = words(rng, 30_000, 3000)
    base = words(rng, 200)
    near = [base.replace("w1 ", "w2 ", k) for k in range(4)]
    own = [words(rng, rng.randint(1, 300)) for _ in range(40)]
    odd = [None, "", " ", "\n\t ", "one", "one two", "ONE  Two\nthree", "One two three", "é ü ß   x y", "a\x1cb c\x85d", "line\nline\nline\nother\n\n line", "<|im_end|> $ # & | < > *", "<|endoftext|> hi", "'s don't I'll 12 3,4.5!?", "x" * 5000, "ab " * 700]
    return [*odd, *own, *near, base, base, base + " ", long, *own[:5]]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with clashing extra columns, a null id, a repeated id and repeated rows."""
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), -1, "n", 0.5, 9, 0.1, "f", 1, True, 0) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, texts[30], "en", "s1", 1, -1, "n", 0.5, 9, 0.1, "f", 1, True, 0), (21, "another text with the id 21", "de", None, 1, -1, "n", 0.5, 9, 0.1, "f", 1, True, 0)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark, docs):
    rows = [(i, None if i % 11 == 0 else int(i % 3 > 0), int(i % 5 == 0), i) for i in range(60)] + [(None, 1, 1, 0), (3, 1, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score int")
