import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and in that thing edner oran leth über señor été naïve 12 straße zwölf ha".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Ids and texts with every odd case: nulls, empties, ties, repeated rows, copies, a long text, control strings."""
    rng = random.Random(3)
    rows = [(i, "\n".join(sentence(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    line = "  A very common line that is long enough to be counted \t"
    rows += [(100 + i, f"{sentence(rng, 5)}\n{line if i % 2 else line.strip().lower()}\n{sentence(rng, 4)}") for i in range(8)]
    base = sentence(rng, 120).split()
    for i in range(6):
        changed = list(base)
        for _ in range(i * 2):
            changed[rng.randrange(len(changed))] = f"odd{rng.randrange(99)}"
        rows.append((200 + i, " ".join(changed)))
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "x"), (304, "x"), (305, "!!! 123 ??"), (306, sentence(rng, 9000)), (None, "a row without an id"), (None, None), (307, "<|endoftext|> [INST] a  b\n\n c \\l \\b")]
    rows += [rows[0], rows[0]]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """``texts`` with further columns whose names clash with those that operators use."""
    rows = [(i, t, "en", "src", len(t or ""), 1, 2, 3, 4, "z") for i, t in texts]
    return spark.createDataFrame(rows, DOCS + ", a long, n long, row long, key long, `odd.name` string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
