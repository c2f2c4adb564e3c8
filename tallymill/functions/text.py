"""Column functions over text: normal forms, screening patterns, digests, parsers."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

# The nine agency classes in order, their slugs, and the phrases by which raw names are matched; the first match wins.
CLASSES = ["Dinas Bina Marga", "Satuan Polisi Pamong Praja", "Dinas Perhubungan", "Kelurahan", "Dinas Pertamanan dan Hutan", "Dinas Sumber Daya Air", "Dinas Cipta Karya, Tata Ruang, dan Pertanahan", "Badan Pembinaan Badan Usaha Milik Daerah", "Instansi lain"]
SLUGS = ["dinas_bina_marga", "satpol_pp", "dinas_perhubungan", "kelurahan", "dinas_pertamanan_hutan", "dinas_sda", "dinas_cipta_karya", "badan_bumd", "instansi_lain"]
CATCH_ALL = SLUGS[-1]
PHRASES = [
    ("Dinas Perhubungan", ["PERHUBUNGAN", "PERPARKIRAN", "PENGENDALIAN LALU LINTAS", "LALU LINTAS JALAN"], []),
    ("Dinas Bina Marga", ["BINA MARGA"], []),
    ("Satuan Polisi Pamong Praja", ["POLISI PAMONG PRAJA", "SATPOL"], []),
    ("Kelurahan", ["KELURAHAN"], []),
    ("Dinas Pertamanan dan Hutan", ["PERTAMANAN", "HUTAN"], []),
    ("Dinas Sumber Daya Air", ["SUMBER DAYA AIR"], []),
    ("Dinas Cipta Karya, Tata Ruang, dan Pertanahan", ["CIPTA KARYA", "TATA RUANG", "PERTANAHAN"], []),
    ("Badan Pembinaan Badan Usaha Milik Daerah", ["BUMD", "BADAN USAHA MILIK DAERAH"], ["PT ", "PERUMDA"]),
]
# Screening patterns for personal data.
PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}(?![\w.-])",
    "phone": r"(?<!\d)(?:\+?62|0)[\s.-]?(?:\d[\s.-]?){8,13}(?!\d)",
    "long_numeric_id": r"(?<!\d)\d{16}(?!\d)",
    "url": r"(?i)https?://\S+|www\.\S+",
    "indonesian_plate": r"(?i)(?<![A-Z0-9])(?:B|D|F|T|E|Z|A|G|H|K|R|AA|AB|AD)\s?\d{1,4}\s?[A-Z]{1,3}(?![A-Z0-9])",
}
#: The same for regular expressions whose classes and case folding are ASCII unless told otherwise.
SCREENS = {name: f"(?U){pattern}" for name, pattern in PATTERNS.items()}
# Answers that mean yes and no.
YES, NO = ["1", "y", "yes", "ya", "true"], ["0", "n", "no", "tidak", "false"]


def first_match(text: Column, rules: list[tuple[str, list[str], list[str]]], default: str) -> Column:
    """The name of the first rule with a phrase inside the upper-cased text, or a prefix at its start."""
    up, out = F.upper(text), None
    for name, phrases, prefixes in rules:
        test = F.lit(False)
        for p in phrases:
            test = test | up.contains(p)
        for p in prefixes:
            test = test | up.startswith(p)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def agency_class(raw: Column) -> Column:
    return first_match(raw, PHRASES, CLASSES[-1])


def mapped(key: Column, pairs: Iterable[tuple[str, object]], default=None) -> Column:
    """A value from a literal map; the default for unknown keys."""
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    value = F.try_element_at(table, key)
    return value if default is None else F.coalesce(value, F.lit(default))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(stripped(c), F.lit("")) for c in columns])


def squeezed(text: Column) -> Column:
    """Lower case with runs of Unicode white space as one space, trimmed; null as empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))


def _full(value: str | None, compose: bool) -> str:
    text = value or ""
    return " ".join((unicodedata.normalize("NFKC", text) if compose else text).casefold().split())


@F.pandas_udf(StringType())
def normalised(s: pd.Series) -> pd.Series:
    """NFKC, case folding and white space, none of which has a built-in."""
    return s.map(lambda x: _full(x, True))


@F.pandas_udf(StringType())
def folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _full(x, False))


def without_urls(text: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"https?://\S+|www\.\S+", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def char_shingles(text: Column, width: int = 4) -> Column:
    """Distinct character runs of the text between two spaces; a shorter text is one run; an empty one has none."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    # At every character, not inside one that takes two code units.
    runs = F.regexp_extract_all(padded, F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{width}}}))"), 1)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(padded) < width, F.array(padded)).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two sets; one where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


@F.pandas_udf(LongType())
def simhash64(shingles: pd.Series) -> pd.Series:
    """Sign of the sum of each bit over the shingles' eight-byte BLAKE2b digests, ties set; no shingles give 0."""
    import hashlib

    import numpy as np

    def one(items) -> int:
        if items is None or not len(items):
            return 0
        h = np.frombuffer(b"".join(hashlib.blake2b(x.encode(), digest_size=8).digest() for x in items), dtype=np.uint8)
        ones = np.unpackbits(h.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * ones >= len(items)).view(">i8")[0])

    return shingles.map(one).astype("int64")


@F.pandas_udf(LongType())
def text_simhash64(text: pd.Series) -> pd.Series:
    """simhash64 of the char_shingles of a text, each run of four characters hashed once for many texts."""
    import hashlib
    from functools import lru_cache

    import numpy as np

    @lru_cache(maxsize=1 << 18)
    def digest(run: str) -> bytes:
        return hashlib.blake2b(run.encode(), digest_size=8).digest()

    def one(t) -> int:
        if not t:
            return 0
        p = f" {t} "
        runs = {p[i : i + 4] for i in range(max(1, len(p) - 3))}
        h = np.frombuffer(b"".join(map(digest, runs)), dtype=np.uint8).reshape(-1, 8)
        ones = np.zeros(64, dtype=np.int64)
        for lo in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[lo : lo + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * ones >= len(h)).view(">i8")[0])

    return text.map(one).astype("int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def salted_id(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}:"), value.cast("string")), 256)


def group_name(ids: Column) -> Column:
    """g_ and the start of the digest of the sorted member ids."""
    return F.concat(F.lit("g_"), F.substring(F.sha2(F.array_join(F.array_sort(ids), "\u001f"), 256), 1, 16))


def yes_no(text: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.isin(YES), 1).when(t.isin(NO), 0)


def label_set(text: Column) -> Column:
    """Distinct non-blank parts between bars, sorted."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def four_decimals(text: Column) -> Column:
    """0.0000 to 1.0000 as 0 to 10000; null for other forms."""
    digits = F.regexp_replace(text, r"\.", "")
    value = F.when(text.rlike(r"^[01]\.\d{4}$"), digits.cast("int"))
    return F.when(value <= 10000, value)


def is_sha256(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def filled_list(*parts: Column) -> Column:
    """Non-blank parts, joined by a comma and a space."""
    return F.concat_ws(", ", *[blank_to_null(p) for p in parts])


def storage_ref(url: Column) -> Column:
    """struct(bucket, object_path) of a public, signed or raw reference; null where the path is missing."""
    public, signed = "/object/public/", "/object/sign/"
    rest = F.when(url.contains(public), F.split_part(url, F.lit(public), F.lit(2))).when(url.contains(signed), F.split_part(F.split_part(url, F.lit(signed), F.lit(2)), F.lit("?"), F.lit(1))).otherwise(url)
    bucket = F.split_part(rest, F.lit("/"), F.lit(1))
    path = F.substr(rest, F.length(bucket) + 2)
    return F.when(F.trim(url).isNotNull() & (F.trim(url) != "") & (path != ""), F.struct(bucket.alias("bucket"), path.alias("object_path")))


def client_ref(value: Column) -> Column:
    """As storage_ref, by the client's rule: a slash inside, and the last part after a marker."""
    public, signed = "/object/public/", "/object/sign/"
    rest = F.when(value.contains(public), F.substring_index(value, public, -1)).when(value.contains(signed), F.split_part(F.substring_index(value, signed, -1), F.lit("?"), F.lit(1))).otherwise(value)
    at = F.instr(rest, "/")
    return F.when((at > 1) & (at < F.length(rest)), F.struct(F.substr(rest, F.lit(1), at - 1).alias("bucket"), F.substr(rest, at + 1).alias("object_path")))


def problem_of(kind: str, value: Column) -> Column:
    """Null for an acceptable form value, else what is wrong with it: kinds required, email, password, phone."""
    v = F.trim(value)
    missing = value.isNull() | (v == "")
    digits = F.length(F.regexp_replace(value, "[^0-9+]", ""))
    wrong = {
        "required": F.lit(False),
        "email": ~v.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
        "password": (F.length(v) < 8) | ~v.rlike("[A-Z]") | ~v.rlike("[a-z]") | ~v.rlike("[0-9]"),
        "phone": (digits < 10) | (digits > 15),
    }[kind]
    return F.when(missing, "required").when(wrong, "invalid")


def canonical_json(**fields: Column) -> Column:
    """A JSON object with its keys in order and no white space; nulls stay."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def utc_problem(text: Column, now: Column) -> Column:
    """Null for an ISO 8601 time in UTC that is not in the future, else what is wrong with it."""
    parsed = F.try_to_timestamp(F.regexp_replace(text, r"Z$", "+00:00"))
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?$") & parsed.isNotNull()
    return (
        F.when(text.isNull(), "missing")
        .when(~iso, "not ISO 8601")
        .when(~text.rlike(r"(Z|[+-]\d{2}:\d{2})$"), "no zone")
        .when(~text.rlike(r"(Z|[+-]00:00)$"), "not UTC")
        .when(parsed > now, "future")
    )


def tested_candidates(selected: Column, fixed: Column, reference: Column, compared: Column) -> Column:
    """Candidates to test, each once, in the order of their first mention; nulls are no candidates."""
    return F.array_distinct(F.array_compact(F.concat(F.array(selected), fixed, F.array(reference), compared)))
