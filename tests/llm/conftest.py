import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id string, salt int, rank string, kept string, score string, rate int, word string, _range int, n_tokens string, held_out int"


def sentence(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, repeated rows, ties, a long text, odd characters, clashing columns."""
    r = random.Random(3)
    long = "\n".join(sentence(r, 40) + "." for _ in range(900))
    body = sentence(r, 60) + "."
    texts = [
        (0, body), (1, body), (1, body), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, body.upper()), (7, "Wörter ñandú 日本語 \U0001f600 é\x00x  two  spaces\n\nnew line\r\n"), (8, "one"), (9, body + " tail"),
        (None, body), (None, None), (12, "a a a a a a a a a a a a a a a a"), (13, "Licensed under the Apache License, Version 2.0.\n" + body), (14, "mail bob.99@mail.example.com or +1 (576) 555-5202 or 10.0.0.255 or 4111 1111 1111 1111 now"), (15, sentence(r, 30)),
    ]
    rest = ("en", "src0", 5, 7, "x", 1, "r", "k", "s", 3, "w", 4, "t", 9)
    return [(d, t, *rest) for d, t in texts] + [(None,) * 16]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (6, 0, 1), (5, 1, 0), (12, 0, 0), (15, None, 0), (None, 1, 1), (0, 1, 0), (14, 1, 1)], "doc_id long, quality int, toxic int")
