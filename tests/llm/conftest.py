import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, row string, shard int, key string, text_hash bigint, component string"


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("aeinorst", k=draw.randint(2, 7))) for _ in range(n))


def rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, exact and near copies, repeated rows, clashing columns."""
    long, base = prose(1, 30_000), prose(2, 400)
    texts = {1: base, 2: base, 3: base.replace(base.split()[200], "edited", 1), 4: prose(3, 300), 5: "", 6: None, 7: " \t\n ", 8: long, 9: prose(4, 7), 10: "one two", 11: prose(5, 50) + " " + prose(99, 14), 12: "Ünï códe \U0001f600 " + prose(6, 40)}
    out = [(i, t, None if i % 2 else "en", (None, "a", "b", "c", "\U0001f600")[i % 5], None if t is None else len(t), 7, "r", i, None, 0, "c") for i, t in texts.items()]
    out += [out[3], out[3], out[4]]
    out += [(None, prose(7, 60), None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
