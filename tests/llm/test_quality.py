import re
from collections import Counter, defaultdict

import brute
import pytest
from conftest import ROWS, prose
from pyspark.sql import functions as F

from tallymill.llm import quality as Q
from tallymill.llm.queries import QUERIES


def counts(text):
    text = text or ""
    w = brute.words(text)
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(runs)
    hit = {i + k for i, r in enumerate(runs) if often[r] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if brute.words(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}


def signals(c):
    if not c["n_words"]:
        return {}
    return {
        "symbols_per_1000_words": 1000 * c["n_symbols"] // c["n_words"],
        "word_length_x100": 100 * c["word_chars"] // c["n_words"],
        "repeated_lines_per_1000": 1000 * c["n_dup_lines"] // c["n_lines"],
        "repeated_words_per_1000": 1000 * c["n_repeat_words"] // c["n_words"],
    }


def rounded(v):
    """The start of a value's bucket."""
    shift = max(0, v.bit_length() - 6)
    return v >> shift << shift


def verdicts(rows, rules=Q.RULES, least=Q.LEAST):
    """(id, lang, source, text) rows judged one by one."""
    own, lang, whole = defaultdict(list), defaultdict(list), defaultdict(list)
    each = [counts(t) for _, _, _, t in rows]
    for (_, ln, s, _), c in zip(rows, each, strict=True):
        for k, v in signals(c).items():
            own[ln, s, k].append(v), lang[ln, k].append(v), whole[k].append(v)

    def at(values, a):
        values = sorted(values)
        return rounded(values[-(-a * len(values) // 4) - 1])

    out = []
    for (i, ln, s, _), c in zip(rows, each, strict=True):
        failed = []
        for r in rules:
            v = signals(c).get(r.signal)
            if v is None:
                continue
            pool = next((p for p in (own[ln, s, r.signal], lang[ln, r.signal]) if len(p) >= least), whole[r.signal])
            q1, q2, q3 = (at(pool, a) for a in (1, 2, 3))
            if r.side == "upper" and v > q2 + max(r.reach * (q3 - q2), r.margin) or r.side == "lower" and v < q2 - max(r.reach * (q2 - q1), r.margin):
                failed.append(f"{r.signal} {r.side}")
        base = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        out.append((i, *c.values(), base, failed, not base and not failed))
    return sorted(out, key=str)


def got(df):
    names = ["id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "failed", "kept"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [1, 4, 200])
def test_odd_rows_against_plain_rules(tricky, least):
    rows = [(i, "en", "s1" if k % 3 else None, t) for k, (i, t) in enumerate(ROWS)]
    assert got(Q.judged(tricky, least=least)) == verdicts(rows, least=least)


@pytest.mark.parametrize("least", [5, 200])
def test_whole_table_against_plain_rules(spark, least):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.lang, r.source, r.text) for r in docs.collect()]
    assert got(Q.judged(docs, least=least)) == verdicts(rows, least=least)


def test_odd_columns_and_empty_tables(odd_columns, empty):
    assert Q.judged(odd_columns).count() == len(ROWS) and got(Q.judged(empty)) == []


def test_null_groups_and_lines(spark):
    rows = [(i, None if i % 2 else "fr", None if i % 3 else "a", prose(i % 5, 60) + "\n \n" + "same line\n" * (i % 4) + "\x0b\n") for i in range(40)]
    rows += [(None, None, None, None), (None, "fr", "b", "a b c " * 40), (7, "fr", "a", "#" * 500), (8, "fr", "a", "日本 | 語 <é> " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    for least in (1, 10, 1000):
        assert got(Q.judged(df, least=least)) == verdicts(rows, least=least)


def test_repeats_of_long_texts(spark):
    words = [f"w{i}" for i in range(30_000)]
    texts = [" ".join(words), " ".join(words + words[500:9000]), "a " * 30_000, "a b " * 20_000 + "c d e", "a b c d a b c", "a b", "", "a a a", "a a a a"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = df.select("i", Q.repeated_words(F.array_remove(F.split("text", Q.SPACE), "")).alias("n")).collect()
    assert {r.i: r.n for r in found} == {i: counts(t)["n_repeat_words"] for i, t in enumerate(texts)}


def test_buckets(spark):
    values = [*range(300), *(2**k + d for k in range(8, 62) for d in (-1, 0, 1))]
    df = spark.createDataFrame([(v,) for v in values], "value long").select("value", Q.bucket(F.col("value")).alias("b"))
    for r in df.select("*", Q.bucket_start(F.col("b")).alias("low")).collect():
        assert r.low == rounded(r.value) and r.low <= r.value and 32 * (r.value - r.low) <= r.value
    ranked = [r.b for r in df.orderBy("value").collect()]
    assert ranked == sorted(ranked)


def test_sketches_merge(spark):
    """Sketches of parts add up to the sketch of the whole, whatever the parts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = Q.measured(docs).select("lang", "source", *[c.alias(n) for n, c in Q.signals().items()]).cache()
    parts = Q.sketches(rows, ["lang", "source"])
    key = lambda df: sorted(map(tuple, df.select("lang", "signal", "bucket", "n").collect()), key=str)
    assert key(Q.merged(parts, ["lang"])) == key(Q.sketches(rows, ["lang"]))


def test_good_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    kept = QUERIES["op11_quality"](spark, sf).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r.quality: r.share for r in kept}
    assert share[1] > 0.97 and share[0] < 0.1


def test_no_python_on_the_path(spark, capsys):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    Q.judged(docs).explain("formatted")
    Q.measured(docs).explain("formatted")
    plan = capsys.readouterr().out
    assert "Scan parquet" in plan and "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
