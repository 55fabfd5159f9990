from __future__ import annotations

import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, "
    "node long, spans string, sketch string, key long, size int, h long, items string, score double"
)


def _rows() -> list[tuple]:
    """Documents with copies, near copies, shared passages, nulls, repeated rows and odd characters."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, common = prose(70), "All rights and no wrongs reserved here."
    long_base = prose(160).split()
    out = []
    for i in range(60):
        text = ".\n".join(prose(20) for _ in range(rng.randint(1, 6)))
        if i % 5 == 0:
            text = f"{text}\n{common}\n{text[:40]}"
        if i % 7 == 0:
            text = f"{prose(10)} {passage} {prose(30)}"
        out.append((i * 3, text))
    for i in range(40):  # a group of near copies that is crowded under small limits
        edited = list(long_base)
        for _ in range(rng.randint(0, 6)):
            edited[rng.randrange(len(edited))] = rng.choice(words)
        out.append((500 + i, " ".join(edited)))
    out += [(700 + i, out[3][1]) for i in range(12)]
    out += [
        (900, None),
        (901, ""),
        (902, " \t\n \n"),
        (903, "one"),
        (904, "one two three"),
        (905, "One  TWO three"),
        (906, "a" * 3000),
        (907, "ab " * 2000 + "x" * 30),
        (908, prose(6000)),
        (909, "\0\0" * 40 + "zero bytes" + "\0" * 60),
        (910, "\0\0" * 40 + "zero bytes" + "\0" * 60),
        (911, "mail me: a.b@c.de%x@y.zz, d@e or +49 (30) 1234-5678. 10.0.0.256 1.2.3.4.5 001.02.3.255 77.1.1.1.1.1.1.1"),
        (912, "card 4111 1111-1111 1111 4111111111111111111 4111111111111112 " + "7" * 5000 + " " + "1-" * 3000),
        (913, "IBAN DE89 3704 0044 0532 0130 00 bank GB82WEST12345698765433; ssn 123-45-6789; code 123-45-6789-1"),
        (914, "x@y." + "a" * 4000 + "@" + "b.c" * 2000),
        (915, out[10][1]),
        (None, out[10][1]),
        (None, None),
        (None, f"no id\n{common}"),
    ]
    out.append(out[10])
    out.append(out[60])
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def rows():
    return [
        (i, t, "de" if n % 3 else None, f"s{n % 9}" if n % 11 else None, len(t or ""), 1, True, 2, "s", "k", 3, 4, 5, "i", 0.5)
        for n, (i, t) in enumerate(_rows())
    ]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The hostile documents, with columns named like those that operators use inside."""
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def result():
    """result(df, columns): rows as sorted tuples."""

    def run(df, *columns) -> list[tuple]:
        got = [tuple(r[c] for c in columns) for r in df.collect()]
        return sorted(got, key=repr)

    return run
