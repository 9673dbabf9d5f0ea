import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(WORDS) for _ in range(r.randint(1, 2))) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, blanks, very long texts, exact and near copies, shared passages, repeated rows, clashing extra columns."""
    passage = prose(99, 70)
    base = prose(1, 120).split()
    near = [*base]
    near[60] = "changed"
    rows = [
        (1, " ".join(base)),
        (2, " ".join(base)),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "two words"),
        (8, "TWO WORDS"),
        (9, prose(2, 40) + " " + passage + " " + prose(3, 40)),
        (10, prose(4, 30) + "\n" + passage + " " + prose(5, 25)),
        (11, prose(6, 20_000)),
        (12, prose(7, 200) + " mail a.b@c.example.org or +1 (555) 010-9999, 10.0.0.256 10.0.0.255, card 4111 1111 1111 1111 end"),
        (12, prose(7, 200) + " mail a.b@c.example.org or +1 (555) 010-9999, 10.0.0.256 10.0.0.255, card 4111 1111 1111 1111 end"),
        (13, "ünï çødé ​ <|endoftext|> 漢字 " * 30),
        (14, "same line\n" * 30),
        (15, "ab " * 700),
        (None, prose(8, 80)),
    ]
    rows = [(i, t, "en" if i else None, "src", len(t or ""), "x", 1) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, key int"
    return spark.createDataFrame(rows, schema).repartition(3)
