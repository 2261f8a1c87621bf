"""Documents with edge cases, shared by the tests of this folder."""
import random

import pytest

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, node double"


def make_rows(seed=3, n=60):
    """Documents with nulls, empty and long texts, ties, repeated rows, copies and near copies."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 6))) for _ in range(150)]

    def text(k):
        return "".join(r.choice(vocab) + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(k))
    rows = []
    for i in range(n):
        rows.append([i, text(r.randint(1, 120)), r.choice(["en", "fr", None]), r.choice(["a", "a", "b", None, "c"])])
    rows[5][1] = rows[6][1] = rows[7][1]                      # copies
    for k, i in enumerate(range(10, 20)):                     # near copies of one text
        w = (rows[10][1] if k else text(200)).split(" ")
        if k:
            w[r.randrange(len(w))] = "changed%d" % k
        rows[i][1] = " ".join(w)
    rows[20][1], rows[21][1], rows[22][1], rows[23][1] = None, "", "  \n ", "Word"
    rows[24][1] = text(5000)
    rows[25][1] = "same line here\nsame line here\n" + text(70)
    rows[26][1] = "x y z " * 40
    rows[27][0] = None                                        # null key
    rows.append(list(rows[3]))                                # repeated row
    rows.append([rows[4][0], text(30), "en", "b"])            # key twice, other text
    return [(i, t, lang, s, len(t or ""), 1, "clash", 0.5) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
