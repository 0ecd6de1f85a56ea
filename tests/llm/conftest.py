import random

import pytest

EXTRA = "size long, shard string, record string, text_hash long, n int, id string, slot int, kept string, target double, node long, score string"


@pytest.fixture(scope="session")
def odd_rows():
    """Ids and texts with nulls, empty and very long texts, repeated rows, copies and near copies."""
    r = random.Random(7)
    words = ["alpha", "Beta", "gamma", "délta", "x", "yy", "Zeta"]
    say = lambda n: " ".join(r.choice(words) + str(r.randint(0, 30)) for _ in range(n))
    base = say(120)
    rows = [(i, say(r.randint(1, 80))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one two"), (104, "ONE two"), (105, "one"), (None, "lost"), (None, None), (None, base)]
    rows += [(110 + i, base) for i in range(5)] + [(110, base), (110, base)]
    near = base.split()
    for i in range(30):
        w = list(near)
        for _ in range(1 + i % 4):
            w[r.randrange(len(w))] = f"new{r.randint(0, 9999)}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, say(30_000)), (301, "w" * 200_000), (302, base.replace(" ", "\n")), (303, base.replace(" ", "  ") + " ")]
    return rows


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text), with sources and columns whose names clash with operators' own."""

    def made(rows, partitions=3):
        full = [(i, t, None if k % 11 == 0 else f"src{k % 4}", k, "s", "r", k, k % 3, "i", 0, "k", 0.5, k, "x") for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, f"doc_id long, text string, source string, {EXTRA}").repartition(partitions)

    return made
