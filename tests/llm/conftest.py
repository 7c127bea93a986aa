import random

import pytest

WORDS = "the of and to in is it on as at by for from with that this was are be or an have not but they she he we you which one all there their what out about who get when make can like time just him know take people into year your good some could them see other than then now look only come its over think also back after use two how our work first well way even new want because any these give day most".split()


def prose(rng: random.Random, n: int) -> str:
    """Clean text of n words in sentences."""
    out, left = [], n
    while left > 0:
        k = min(left, rng.randint(4, 12))
        words = [rng.choice(WORDS) if rng.random() < 0.5 else "".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(3, 8))) for _ in range(k)]
        out.append(" ".join(words).capitalize() + ".")
        left -= k
    return " ".join(out)


@pytest.fixture(scope="session")
def make_prose():
    return prose


#: Ids and texts that go wrong first: nulls, empty and white texts, repeated rows and ids, odd characters, a very long text.
ODD = [
    (1, "Plain text of a few words, with an end."),
    (1, "Plain text of a few words, with an end."),
    (1, "The same id with another text."),
    (None, None),
    (None, "A text without an id, which has several words in it."),
    (None, ""),
    (2, ""),
    (3, None),
    (4, " \n\t "),
    (5, "x"),
    (6, "é̀ ﬁ 日本語 \U0001f600 ​ <|endoftext|> İ ſK 1²½ \x1c\x85\xa0"),
    (7, "word " * 30_000),
    (8, "a" * 50_000),
    (9, "9" * 20_000 + "." + "+" * 300 + "@" * 300),
    (10, "password: hunter2hunter2 me@example.com 10.0.0.1 +1 (555) 123-4567 4111111111111111"),
]


@pytest.fixture()
def odd(spark):
    """The odd rows, with columns whose names the operators use themselves."""
    rows = [(i, t, "en", "src0", len(t or ""), 0.5, 1, "x", True, 7, "k", [1], "s", 3) for i, t in ODD]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, label string, keep boolean, start int, copy string, buckets array<int>, spans string, id int",
    )


@pytest.fixture()
def none(odd):
    return odd.limit(0)
