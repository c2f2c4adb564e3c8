"""Quality rules with thresholds that each language and source sets for itself.

Signals of a text are whole numbers. Of each signal, every (language, source) group keeps a quantile sketch: counts of values
in buckets that are exact below 64 and 1/32 of their value wide above. Two sketches merge by adding counts, so a sketch comes
from partial sums in any order, gives the same quantiles on every run, and a group of fewer than `least` documents takes the
sketch of its language, a small language that of the whole table, by merging what is there. Fences follow from the quartiles:

    upper: median + max(reach * (third quartile - median), margin)
    lower: median - max(reach * (median - first quartile), margin)

A document fails a rule if its signal lies outside; one on the fence stays. Fences are joined to the documents by group; a key
of `SALTS` values keeps a hot group from one task.

Only DataFrame functions run here, all on the JVM. Texts are read once: the signals are written to the shared folder.

Results in special cases: a null text has no words, like an empty one, and fails the base rules; documents without words are in
no sketch; null languages and sources are groups of their own; rows that repeat an id are judged each for itself; a very long
text is one row like any other, in time n log n of its words; an empty table gives no rows. Columns other than id, text,
language and source are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.runtime import Scratch, quoted

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Documents a group must have to set its own fences.
LEAST = 200
#: A group's documents meet its fences in this many places.
SALTS = 64


@dataclass(frozen=True)
class Rule:
    signal: str
    side: str
    reach: int
    #: A fence is at least this far from the median.
    margin: int


RULES = (
    Rule("symbols_per_1000_words", "upper", 8, 100),
    Rule("word_length_x100", "upper", 8, 150),
    Rule("word_length_x100", "lower", 8, 150),
    Rule("repeated_lines_per_1000", "upper", 8, 500),
    Rule("repeated_words_per_1000", "upper", 8, 350),
)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, even where f uses it inside a loop over an array."""
    return F.get(F.transform(F.array(value), f), 0)


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words that runs of `width` words cover which occur twice or more in the array: by sorting the runs, so that time is n log n."""

    def covered(runs: Column) -> Column:
        def twice(ranked: Column) -> Column:
            """Where the runs stand that equal the one before or after them in order."""
            beside = F.filter(ranked, lambda x, i: (x["run"] == F.get(ranked, i - 1)["run"]) | (x["run"] == F.get(ranked, i + 1)["run"]))
            return F.sort_array(F.transform(beside, lambda x: x["at"]))

        at = let(F.sort_array(F.transform(runs, lambda r, i: F.struct(r.alias("run"), i.alias("at")))), twice)
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        add = lambda a, p: F.struct((a["n"] + p + width - F.greatest(p, a["end"])).alias("n"), (p + width).alias("end"))
        count = F.aggregate(at, start, add, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(runs)) == F.size(runs), 0).otherwise(count)

    runs = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - (width - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, width)]))
    return let(words, lambda w: let(runs(w), covered)).cast("long")


def measured(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """id, lang, source and the counts of each text."""
    text = F.coalesce(F.col(quoted(text_column)).cast("string"), F.lit(""))
    rows = docs.select(F.col(quoted(id_column)).cast("long").alias("id"), F.col(quoted(lang_column)).cast("string").alias("lang"), F.col(quoted(source_column)).cast("string").alias("source"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    # Words and lines are bound once each, not at every use.
    words = F.array_remove(F.split("text", SPACE), "")
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return rows.select(
        "id",
        "lang",
        "source",
        counts.alias("w"),
        line_counts.alias("l"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select("id", "lang", "source", "w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def signals() -> dict[str, Column]:
    """The signals of a measured row as whole numbers, null without words."""
    per = lambda n, a, b: F.when(F.col(b) > 0, F.expr(f"({n} * {a}) div {b}"))
    return {
        "symbols_per_1000_words": per(1000, "n_symbols", "n_words"),
        "word_length_x100": per(100, "word_chars", "n_words"),
        "repeated_lines_per_1000": per(1000, "n_dup_lines", "n_lines"),
        "repeated_words_per_1000": per(1000, "n_repeat_words", "n_words"),
    }


def bucket(value: Column) -> Column:
    """A whole number's bucket: itself below 64, then 32 buckets for each power of two."""
    shift = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(32 * shift + F.call_function("shiftright", value, shift)).cast("long")


def bucket_start(b: Column) -> Column:
    """The smallest value in a bucket."""
    shift = F.floor(b / 32).cast("int") - 1
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", b - 32 * shift, shift)).cast("long")


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, signal, bucket, n): the sketch of each group; a hot group costs its partial sums."""
    named = F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("value")) for n in signals()])
    long = rows.select(*keys, F.explode(named).alias("s")).select(*keys, "s.*").where("value is not null")
    return long.groupBy(*keys, "signal", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer groups added up to those of `keys`."""
    return sketch.groupBy(*keys, "signal", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], ranks: dict[str, tuple[int, int]]) -> DataFrame:
    """For each group and signal its count `total` and the named quantiles: the start of the bucket where the running count
    reaches the rank a / b of the total, rounded up. A group's buckets are bounded by the range of a signal."""
    w = Window.partitionBy(*keys, "signal")
    run = sketch.select("*", F.sum("n").over(w.orderBy("bucket")).alias("run"), F.sum("n").over(w).alias("total"))
    pick = [F.min(F.when(F.col("run") * b >= F.col("total") * a, bucket_start(F.col("bucket")))).alias(name) for name, (a, b) in ranks.items()]
    return run.groupBy(*keys, "signal").agg(F.first("total").alias("total"), *pick)


QUARTILES = {"q1": (1, 4), "q2": (1, 2), "q3": (3, 4)}


def fences(rows: DataFrame, scratch: Scratch, rules: tuple[Rule, ...] = RULES, least: int = LEAST) -> DataFrame:
    """(lang, source, one fence for each rule as f0, f1, ...) for every group that has words."""
    fine = scratch.save(sketches(rows.select("lang", "source", *[c.alias(n) for n, c in signals().items()]), ["lang", "source"]))
    own = quantiles(fine, ["lang", "source"], QUARTILES)
    by_lang = quantiles(merged(fine, ["lang"]), ["lang"], QUARTILES)
    whole = quantiles(merged(fine, []), [], QUARTILES)
    names = ["total", *QUARTILES]
    lang = by_lang.select(F.col("lang").alias("l_lang"), F.col("signal").alias("l_signal"), F.struct(*names).alias("of_lang"))
    # A row for each signal.
    every = whole.select(F.col("signal").alias("e_signal"), F.struct(*names).alias("of_all"))
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("signal") == F.col("l_signal"))).join(F.broadcast(every), F.col("signal") == F.col("e_signal"))
    level = F.when(F.col("total") >= least, F.struct(*names)).when(F.col("of_lang.total") >= least, F.col("of_lang")).otherwise(F.col("of_all"))
    picked = both.select("lang", "source", "signal", level.alias("q"))
    q = {n: F.col(f"q.{n}") for n in QUARTILES}

    def fence(r: Rule) -> Column:
        away = (q["q3"] - q["q2"]) if r.side == "upper" else (q["q2"] - q["q1"])
        far = F.greatest(r.reach * away, F.lit(r.margin).cast("long"))
        return q["q2"] + far if r.side == "upper" else q["q2"] - far

    return picked.groupBy("lang", "source").agg(*[F.max(F.when(F.col("signal") == r.signal, fence(r))).alias(f"f{i}") for i, r in enumerate(rules)])


def judged(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source", rules: tuple[Rule, ...] = RULES, least: int = LEAST) -> DataFrame:
    """id, lang, source, the counts, base_failed, failed (names of the rules whose fence a document crosses) and kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.save(measured(docs, id_column=id_column, text_column=text_column, lang_column=lang_column, source_column=source_column))
    names = [f"f{i}" for i in range(len(rules))]
    marks = fences(rows, scratch, rules, least).select(F.col("lang").alias("m_lang"), F.col("source").alias("m_source"), *names, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("m_salt"))
    salted = rows.select("*", F.pmod(F.col("_metadata.row_index"), F.lit(SALTS)).cast("int").alias("salt"))
    on = F.col("lang").eqNullSafe(F.col("m_lang")) & F.col("source").eqNullSafe(F.col("m_source")) & (F.col("salt") == F.col("m_salt"))
    out = salted.join(marks, on, "left")
    values = signals()
    crossed = [F.when(values[r.signal] > F.col(n) if r.side == "upper" else values[r.signal] < F.col(n), F.lit(f"{r.signal} {r.side}")) for r, n in zip(rules, names, strict=True)]
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged_rows = out.select("id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), F.array_compact(F.array(*crossed)).alias("failed"))
    return judged_rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
