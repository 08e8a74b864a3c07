import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("al", "be", "cor", "du", "él") for b in ("ma", "ni", "", "ro") for c in ("s", "t,", ".", "xen", "é", "q")]


def text(rng: random.Random, n: int, lines: int = 0) -> str:
    out = [rng.choice(WORDS) for _ in range(n)]
    for _ in range(lines):
        out[rng.randrange(n)] += "\n"
    return " ".join(out)


def corpus(seed: int = 1, docs: int = 60) -> list[tuple[int, str | None]]:
    """Random texts with copies, edited copies, shared passages, and the odd cases."""
    rng = random.Random(seed)
    base = [text(rng, rng.randint(40, 120), 3) for _ in range(docs // 2)]
    passage = text(rng, 50)
    out: list[str | None] = [*base]
    for _ in range(docs // 6):
        out.append(rng.choice(base))
        edited = rng.choice(base).split(" ")
        edited[rng.randrange(len(edited))] = "edited"
        out.append(" ".join(edited))
        out.append(f"{text(rng, 20)} {passage} {text(rng, 20)}")
    out += [None, "", " \t\n ", "one", "two words", "One", "x" * 5000, "a b " * 400, "same line here now\nsame line here now", "\x85 \xa0 tab\tend\r\n", "日本 語 " * 30]
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(3 * i - 5, out[k]) for i, k in enumerate(order)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus over several partitions, with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("n", "rank", "part", "seed", "spans", "rep", "component_id", "place", "chunk", "key", "_gone")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
