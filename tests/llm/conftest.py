import random

import pytest

#: Columns that operators use inside: a caller's own must not clash with them.
EXTRA = ["fp", "key", "tk", "digest", "words", "score", "label", "spans", "shard", "doc", "features", "dense", "lang"]


def edge_texts():
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    passage, base = prose(70), prose(300)
    one_off = base.split(" ")
    one_off[150] = "changed"
    return [
        None, "", " \t\n ", "\x1c\x85 ", "word", "two words", base, base, base.replace(" ", "\n\t"), " ".join(one_off), base.upper(),
        prose(30) + " " + passage + " " + prose(40), prose(10) + " " + passage, passage, passage + " " + passage, prose(60_000) + " " + passage,
        "x" * 20_000, "é ä ß 🙂 \U0001d4d0 " * 30, "<|endoftext|> <s> </s> ▁ a  b   c\r\n d", "12345678901 " * 50,
        "mail a.b+c@d-e.org.x_y@z.de, a@b@c.d @x.y q@w; 1.2.3.4.5.6.7.8 300.1.1.1 01.02.003.255 1.2.3",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111; +49 (30) 1234-5678. +1 2 +12345678901234567890 +491234567890 🙂 a@b.co",
        "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2", "- - -", "same same same same same " * 40,
    ]


@pytest.fixture(scope="session")
def edge_rows():
    return [(10 * (i + 1), t) for i, t in enumerate(edge_texts())]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    """Odd texts, with columns of the caller's under names that operators use, dealt over several partitions."""
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(i, t, *["mine"] * len(EXTRA)) for i, t in edge_rows], schema).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, fp string, key string")


@pytest.fixture(scope="session")
def nulls(spark):
    """Null ids, repeated rows and repeated ids."""
    return spark.createDataFrame([(None, "a b c@d.e"), (None, None), (7, "a b c@d.e"), (7, "a b c@d.e"), (7, "other text"), (8, "a  b\tc@d.e")], "doc_id long, text string")
