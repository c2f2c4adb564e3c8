import random

import pytest

WORDS = "road lamp water tree park report street city river bridge night light stone wheel market garden".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


ROWS = [
    (None, prose(1, 60)),
    (None, None),
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, prose(2, 6000)),
    (5, prose(1, 60)),
    (6, prose(3, 40) + "\n" + prose(4, 55)),
    (7, prose(4, 55) + " \t" + prose(5, 20)),
    (8, prose(6, 50)),
    (8, prose(6, 50)),
    (9, prose(6, 50).upper()),
    (10, prose(7, 12)),
    (11, prose(7, 12)),
    (12, "word " * 200),
    (13, "une forêt ÉTÉ 日本語 " * 9),
    (-5, prose(4, 55)),
    (14, "x"),
]


@pytest.fixture
def tricky(spark):
    """Nulls, blanks, a long text, repeats, shared passages; columns that clash with names the operators use."""
    rows = [(i, t, "en", "s1" if k % 3 else None, None if t is None else len(t), k, "r", k, "g", b"p") for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, rest string, part int, `group` string, load binary")


@pytest.fixture
def empty(tricky):
    return tricky.where("false")


@pytest.fixture
def odd_columns(tricky):
    """Names that need quoting, and fields of every kind that are not nullable."""
    from pyspark.sql import functions as F

    one = F.lit(1)
    extra = {
        "my col": F.lit("b"),
        "x.y": one,
        "a:b": F.lit(2.5),
        "tick`": F.lit(True),
        "pairs": F.create_map(F.lit("k"), one),
        "list": F.array(one, F.lit(2)),
        "box": F.struct(one.alias("in side"), F.array(F.struct(one.alias("z"))).alias("deep")),
        "when": F.to_timestamp(F.lit("2024-01-02 03:04:05")),
        "day": F.to_date(F.lit("2024-01-02")),
        "sum": F.lit(1).cast("decimal(12,2)"),
        "raw": F.lit("q").cast("binary"),
    }
    return tricky.withColumns(extra)


def thue_morse(n: int, a: str, b: str) -> str:
    """The sequence of n symbols over a and b in which patterns cancel most."""
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


def twins(n: int) -> tuple[str, str]:
    return thue_morse(n, "x", "y"), thue_morse(n, "y", "x")
