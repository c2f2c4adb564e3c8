import base64
import collections
import hashlib
import math
import zlib

import brute
import numpy as np
import pytest
from conftest import ROWS, prose

from tallymill.llm import kernels as K
from tallymill.llm import kneser_ney, toxicity, urlfilter, warc
from tallymill.llm.packing import pack_documents, pack_group
from tallymill.llm.sharding import jump, shard_rows
from tallymill.llm.sketch import Sketch, fingerprint_edits, sketches
from tallymill.llm.urlfilter import Bloom, Cascade, judge_urls
from tallymill.llm.warc import read_index, read_records, write_archive
from pyspark.sql import functions as F


# WARC.

PAGES = [(1, "http://a/x", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (3, None, None), (4, "http://c\r\nX: y", ""), (5, "http://d", "é" * 5000), (6, "http://d", "<p>one</p>"), (6, "http://d", "<p>one</p>"), (None, "http://e", "two")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, i, "k", b"p") for i, r in enumerate(rows)], "page_id long, url string, html string, id int, key string, payload binary")


@pytest.mark.parametrize("least", [0, 11, 100])
def test_warc(spark, least):
    archive = write_archive(pages(spark), least=least)
    got = sorted(tuple(r) for r in read_index(spark, archive).select(F.coalesce("id", F.lit(-1)), "payload_bytes", "payload_digest", "record_type", F.coalesce("refers_to", F.lit(0))).collect())
    largest = collections.defaultdict(lambda: -2)
    for p, _, h in PAGES:
        largest[h or ""] = max(largest[h or ""], -1 if p is None else p)
    want = []
    for p, _, h in PAGES:
        load = (h or "").encode()
        again = len(load) >= least and (-1 if p is None else p) < largest[h or ""]
        want.append((-1 if p is None else p, len(load), base64.b32encode(hashlib.sha1(load).digest()).decode(), "revisit" if again else "response", largest[h or ""] if again else 0))
    assert got == sorted(want)
    assert spark.read.parquet(archive.payloads).count() == 4


def test_warc_round_trip(spark):
    archive = write_archive(pages(spark))
    out = read_records(spark, archive).collect()
    assert sorted(bytes(r.payload) for r in out) == sorted((h or "").encode() for _, _, h in PAGES)
    ids, refers = collections.Counter(), set()
    for r in out:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        block = rest[:-4]
        assert int(fields[b"Content-Length"]) == len(block) and fields[b"Content-Type"] == b"application/http; msgtype=response"
        ids[fields[b"WARC-Record-ID"]] += 1
        if fields[b"WARC-Type"] == b"revisit":
            assert block == b""
            refers.add(fields[b"WARC-Refers-To"])
        else:
            http, _, payload = block.partition(b"\r\n\r\n")
            assert payload == bytes(r.payload) and http.endswith(f"Content-Length: {len(payload)}".encode()) and http.startswith(b"HTTP/1.1 200 OK")
    # Every record has an id; only rows that repeat id, url and payload share one. Revisits name records that are there.
    assert sum(ids.values()) == len(PAGES) and len(ids) == len(set(PAGES)) and refers <= set(ids)


def test_warc_fields_cannot_be_forged(spark):
    rows = [(1, "http://a\r\nWARC-Type: revisit", "\r\nWARC-Record-ID: <urn:page:9:0>\r\n"), (2, "WARC-Refers-To: <urn:page:7:0>", "x")]
    got = sorted((r.id, r.record_type, r.refers_to) for r in read_index(spark, write_archive(pages(spark, rows))).collect())
    assert got == [(1, "response", None), (2, "response", None)]


def test_warc_detects_damage(spark):
    archive = write_archive(pages(spark))
    bad = spark.read.parquet(archive.payloads).withColumn("sha256", F.when(F.col("size") == 3, F.unhex(F.sha2(F.lit("x"), 256))).otherwise(F.col("sha256")))
    rows = bad.collect()
    spark.createDataFrame(rows, bad.schema).write.mode("overwrite").parquet(archive.payloads)
    with pytest.raises(Exception, match="does not match"):
        read_index(spark, archive).collect()


def test_warc_records_are_checked(spark):
    archive = write_archive(pages(spark))
    rows = [r.asDict() for r in spark.read.parquet(archive.payloads).orderBy("size").collect()]
    rows[1]["data"], rows[2]["data"] = rows[2]["data"], rows[1]["data"]
    spark.createDataFrame([tuple(r.values()) for r in rows], spark.read.parquet(archive.payloads).schema).write.mode("overwrite").parquet(archive.payloads)
    for read in (read_records, read_index):
        with pytest.raises(Exception, match="does not match"):
            read(spark, archive).collect()


def test_warc_needs_no_python_workers(spark, capsys):
    """Arrow batches of whole payloads and the workers that hold them are no part of an executor's memory."""
    archive = write_archive(pages(spark))
    rows = pages(spark).select(F.col("page_id").alias("key"), F.lit(0).cast("long").alias("tag"), F.col("html").cast("binary").alias("payload"))
    for make in (lambda: read_index(spark, archive), lambda: read_records(spark, archive), lambda: warc._once(rows)):
        make().explain()
        plan = capsys.readouterr().out
        assert "Scan" in plan and not any(x in plan for x in ("MapInArrow", "MapInPandas", "EvalPython", "PythonUDF"))


def test_warc_digests_of_many_payloads(spark):
    """Groups of a digest that begin with zero bits keep their places; copies in all partitions are stored once."""
    loads = {i: prose(i % 1500, 3) for i in range(3000)}
    archive = write_archive(spark.createDataFrame([(i, None, t) for i, t in loads.items()], "page_id long, url string, html string").repartition(7))
    assert spark.read.parquet(archive.payloads).count() == len(set(loads.values()))
    owner = {t: i for i, t in sorted(loads.items())}
    for r in read_index(spark, archive).collect():
        load = loads[r.id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(load), base64.b32encode(hashlib.sha1(load).digest()).decode())
        assert r.refers_to == (None if owner[loads[r.id]] == r.id else owner[loads[r.id]])


def test_warc_one_digest_of_two_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "_sha256", lambda column: F.lit(b"same"))
    with pytest.raises(Exception, match="two payloads have one SHA-256"):
        write_archive(pages(spark))


def test_warc_empty(spark):
    assert read_index(spark, write_archive(pages(spark).where("false"))).collect() == []


# Packing.


def test_packing_rules(tricky):
    out = pack_documents(tricky, capacity=64, per_source=2).collect()
    n = collections.Counter()
    for r in out:
        n[r.id] += r.n_words
    want = collections.Counter()
    for d, t in ROWS:
        want[d] += len(brute.words(t))
    assert n == want
    bins = collections.defaultdict(list)
    for r in out:
        assert (r.bin is None) == (r.n_words == 0) == (r.offset is None)
        if r.bin is not None:
            bins[r.bin].append(r)
    texts, sources = dict(ROWS), collections.defaultdict(set)
    for k, (d, _) in enumerate(ROWS):
        sources[d].add("s1" if k % 3 else None)
    for rows in bins.values():
        assert sum(sources[r.id] == {"s1"} for r in rows) <= 2
        same = collections.Counter(texts[r.id] for r in rows if r.id is not None)
        assert max(same.values(), default=0) <= 1
        rows.sort(key=lambda r: r.offset)
        assert sum(r.n_words for r in rows) <= 64
        assert [r.offset for r in rows] == list(np.cumsum([0] + [r.n_words for r in rows[:-1]]))


@pytest.mark.parametrize("seed", range(5))
def test_packing_is_best_fit(seed):
    """Against a search through all bins for the tightest compatible one."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60, 400).tolist()
    source = [None if s == 9 else int(s) for s in rng.choice(10, 400, p=[0.4, *[0.6 / 9] * 9])]
    cluster = [int(c) for c in rng.choice(80, 400, p=[0.3, *[0.7 / 79] * 79])]
    where, start = pack_group(sizes, source, cluster, 100, 2)
    bins = []
    for i in sorted(range(400), key=lambda i: -sizes[i]):
        can = [(b["room"], b["n"]) for b in bins if b["room"] >= sizes[i] and cluster[i] not in b["c"] and (source[i] is None or b["s"].count(source[i]) < 2)]
        tight = min((r for r, _ in can), default=None)
        if tight is None:
            bins.append({"room": 100, "n": len(bins), "c": [], "s": []})
            assert where[i] == len(bins) - 1
        else:
            assert where[i] in [n for r, n in can if r == tight]
        b = bins[where[i]]
        assert start[i] == 100 - b["room"]
        b["room"] -= sizes[i]
        b["c"].append(cluster[i])
        b["s"].append(source[i])


def test_packing_query_is_best_fit(spark):
    """The query over its whole table: every piece is in the tightest bin that could take it, or opens one."""
    from tallymill.llm.queries import op4_packing

    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op4_packing(spark, "/root/testdata/sf0.001").collect()
    words = {d: len(brute.words(r.text)) for d, r in docs.items()}
    full = [r for r in got if r.n_words == 2048]
    assert len(full) == sum(n // 2048 for n in words.values()) and len({r.bin for r in full}) == len(full)
    last = {r.doc_id: r for r in got if r.bin is not None and r.n_words < 2048}
    assert {d: r.n_words for d, r in last.items()} == {d: n % 2048 for d, n in words.items() if n % 2048}
    bins = {}
    for d in sorted(last, key=lambda d: (-last[d].n_words, -words[d], d)):
        r, source, text = last[d], docs[d].source, docs[d].text
        can = [b["room"] for b in bins.values() if b["room"] >= r.n_words and text not in b["texts"] and (source is None or b["sources"].count(source) < 4)]
        if r.bin in bins:
            assert bins[r.bin]["room"] == min(can)
        else:
            assert not can
            bins[r.bin] = {"room": 2048, "texts": [], "sources": []}
        b = bins[r.bin]
        assert r.offset == 2048 - b["room"]
        b["room"] -= r.n_words
        b["texts"].append(text)
        b["sources"].append(source)


def test_packing_empty(empty):
    assert pack_documents(empty).collect() == []


# URL filter.

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
URLS = [None, "", "no scheme", "http://Example.ORG/es/1?x#y", "https://a.example.org/en/17", "https://xexample.org/es/", "http://b.com/fr/", "ftp://q.com/de/a#b", "http://com/de/", "http://org", "x://y://z.org/", "http://u@h.com:80/de/", "//a.org/"]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, RULES).collect()}
    assert got[3] == got[16] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[4][2:] == ("example.org/en/1", "block") and got[5][2:] == ("org/", "allow")
    assert got[7] == ("q.com", "/de/a", "com/de/", "block") and got[8][3] == "block"
    assert got[9] == ("org", "", None, "allow") and got[0] == ("", "", None, "allow") and got[2][0] == ""
    assert got[10] == ("y:", "//z.org/", None, "allow") and got[11][2] is None
    assert judge_urls(df.where("false"), RULES).collect() == []
    long = "http://" + "a." * 3000 + "example.org/es/" + "x/" * 20000
    wide = spark.createDataFrame([(1, long), (1, long), (None, long)], "page_id long, url string").withColumns({c: F.lit(1) for c in ("id", "path", "rule", "verdict")})
    assert [(r.rule, r.verdict, len(r.path)) for r in judge_urls(wide, RULES).collect()] == [("example.org/es/", "block", 40004)] * 3


def test_cascade_is_exact():
    listed, others = [f"k{i}" for i in range(500)], [f"o{i}" for i in range(5000)]
    c = Cascade(listed, others)
    assert all(k in c for k in listed) and not any(k in c for k in others) and len(c.levels) > 2
    assert all(k in Bloom(listed, 0.01, 3) for k in listed)


def test_false_positives_are_encoded(spark, monkeypatch):
    monkeypatch.setattr(urlfilter.math, "sqrt", lambda x: 1e-9)
    df = spark.createDataFrame([(i, f"http://h{i}.org/p{i}") for i in range(40)], "page_id long, url string")
    got = judge_urls(df, {"h3.org/p3": "block"}).collect()
    assert [r.id for r in got if r.rule] == [3]


# Sketches.


def test_edits_and_order(tricky):
    got = fingerprint_edits(tricky).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.id in (4, 6, 13):
            text = dict(ROWS)[r.id]
            after = {4: " \n\t ", 6: prose(1, 60), 13: "word " * 200}[r.id] if r.id != 4 else "   \n\t "
            half = len(text) // 2
            assert r.edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest() and r.n_chars == len(text)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    same = {}
    for r in got:
        if r.id is not None:
            same.setdefault(brute.fold(dict(ROWS)[r.id]), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in same.values())


def plain_fingerprint(text):
    """(distinct shingles, their hashes below a quarter of the range), each shingle hashed as a text of its own."""
    w = brute.words(brute.fold(text))
    shingles = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    hashes = {int(s.hashes[0]) for s in sketches([" ".join(x).encode() for x in shingles], scale=1)}
    assert len(hashes) == len(shingles)
    return tuple(w), len(shingles), {h for h in hashes if h < 1 << 62}


def check_edits(rows, got):
    """rows: (id, text) in the query's order; all of its columns."""
    left = collections.Counter()
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edit = t[: len(t) - half] + after[:half]
        mine, other, following = map(plain_fingerprint, (t, edit, after))

        def like(a, b):
            return 1.0 if a[0] == b[0] else len(a[2] & b[2]) / len(a[2] | b[2]) if a[2] | b[2] else 0.0

        left[d, len(t), hashlib.sha256(edit.encode()).hexdigest(), mine[1], tuple(sorted(mine[2])), other[1], tuple(sorted(other[2])), round(like(mine, other), 12), round(like(mine, following), 12)] += 1
    for r in got:
        a, b = Sketch.parse(r.fingerprint), Sketch.parse(r.edited_fingerprint)
        left[r[0], r.n_chars, r.edited_sha256, a.distinct, tuple(a.hashes.tolist()), b.distinct, tuple(b.hashes.tolist()), round(r.near_edited, 12), round(r.near_next, 12)] -= 1
    assert not +left and not -left


def test_edits_of_odd_rows_against_sets(tricky):
    key = F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = [(r.doc_id, r.text or "") for r in tricky.orderBy(key).collect()]
    check_edits(rows, fingerprint_edits(tricky).collect())


def test_edits_query_against_sets(spark):
    from tallymill.llm.queries import op8_fingerprints

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs), key=lambda r: -r[0])
    check_edits(rows, op8_fingerprints(spark, "/root/testdata/sf0.001").collect())


def test_wrap_and_empty(spark, empty):
    one = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    r = fingerprint_edits(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()
    assert r.near_next == 1.0 and fingerprint_edits(empty).collect() == []


def test_likeness_is_close_and_merges():
    a, b = prose(1, 4000), prose(1, 4000)[: len(prose(1, 4000)) // 2] + " " + prose(2, 2000)
    x, y = sketches([a.encode(), b.encode()])
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split())]
    assert abs(x.likeness(y) - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.05
    assert abs(y.containment(x) - len(sets[0] & sets[1]) / len(sets[1])) < 0.06
    back = Sketch.parse(x.text())
    assert (back.hashes == x.hashes).all() and set(x.merged(y)) == set(x.hashes) | set(y.hashes)


# Sharding.


def test_jump_moves_only_into_the_new_shard():
    keys = np.arange(20000)
    for n in (1, 2, 24, 100):
        a, b = jump(keys, n), jump(keys, n + 1)
        assert ((a == b) | (b == n)).all() and abs((b == n).mean() - 1 / (n + 1)) < 0.02


def test_shards(tricky, empty):
    got = shard_rows(tricky, shards=5).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 5)
    assert sum(map(len, by.values())) == len(ROWS) and all(sorted(v) == list(range(len(v))) for v in by.values())
    for d, t in ROWS:
        assert any(r.id == d and r.size == len((t or "").encode()) + 8 and r.text_crc32 == zlib.crc32((t or "").encode()) for r in got)
    assert shard_rows(empty).collect() == []


# Language model.


def held(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2


def plain_model(train, least):
    """Counts in dictionaries, and p(word after two words); least=2 takes the whole of single bigrams and trigrams for the lower order."""
    tri = brute.trigrams(train)
    count = collections.Counter(w for (_, _, w), n in tri.items() for _ in range(n))
    raw, follow = collections.Counter(), collections.Counter()
    for (_, b, w), n in tri.items():
        raw[b, w] += n
        follow[b, w] += 1
    for k in follow:
        if k[0] == "<s>":
            follow[k] = raw[k]
    types = collections.Counter(w for _, w in follow)
    of = lambda v: [collections.Counter(v)[i] for i in (1, 2, 3, 4)]
    d3, d2, d1 = (kneser_ney.discounts(of(x.values())) for x in (tri, follow, types))
    if least == 2:
        d3, d2 = (1.0, *d3[1:]), (1.0, *d2[1:])
    after2, after3 = collections.defaultdict(dict), collections.defaultdict(dict)
    for (b, w), n in follow.items():
        after2[b][w] = n
    for (a, b, w), n in tri.items():
        after3[a, b][w] = n
    kept = lambda n, d: n - d[min(n, 3) - 1] if n else 0.0
    freed = sum(n - kept(n, d1) for n in types.values())
    masses2 = {b: (sum(c.values()), sum(kept(n, d2) for n in c.values())) for b, c in after2.items()}
    masses3 = {k: sum(kept(n, d3) for n in c.values()) for k, c in after3.items()}

    def p(a, b, w):
        x = kept(types[w], d1) / len(follow) + freed / len(follow) / (len(count) + 1)
        if b in after2:
            total, mass = masses2[b]
            x = kept(after2[b].get(w, 0), d2) / total + (1 - mass / total) * x
        if raw[a, b]:
            x = kept(after3[a, b].get(w, 0), d3) / raw[a, b] + (1 - masses3[a, b] / raw[a, b]) * x
        return x

    return count, p


@pytest.mark.parametrize("least", [1, 2])
def test_scores_against_plain_counts(spark, tricky, least):
    """Every row, every text whole, against a model of dictionaries over all counts."""
    got = kneser_ney.score_documents(tricky, least=least).collect()
    count, p = plain_model([t for d, t in ROWS if not held(d)], least)
    total, vocab = sum(count.values()), len(count)

    def plain(d, t):
        x = [*brute.words(brute.fold(t)), "</s>"]
        y = ["<s>", "<s>", *x]
        base = sum(math.log10((count[w] + 1) / (total + vocab + 1)) for w in x)
        score = sum(math.log10(p(*y[i - 2 : i + 1])) for i in range(2, len(y)))
        return (d is None, d or 0, held(d), len(x), sum(count[w] > 0 for w in x), total, base, score)

    mine = sorted((r.id is None, r.id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    want = sorted(plain(d, t) for d, t in ROWS)
    assert len(mine) == len(want)
    for x, y in zip(mine, want, strict=True):
        assert x[:6] == y[:6] and x[6:] == pytest.approx(y[6:], rel=1e-9)


def test_query_scores_whole_table(spark):
    from tallymill.llm.queries import op9_kneser_ney

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    count, p = plain_model([t for d, t in rows if not held(d)], 1)
    got = {r.doc_id: r for r in op9_kneser_ney(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        y = ["<s>", "<s>", *brute.words(brute.fold(t)), "</s>"]
        assert got[d].score == pytest.approx(sum(math.log10(p(*y[i - 2 : i + 1])) for i in range(2, len(y))), rel=1e-9)
        assert (got[d].held_out, got[d].n_tokens, got[d].train_tokens) == (held(d), len(y) - 2, sum(count.values()))


def test_model_beats_unigrams_and_empty(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    unseen = [r for r in kneser_ney.score_documents(docs).collect() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert kneser_ney.score_documents(empty).collect() == []
    alone = next(d for d in range(99) if held(d))
    one = kneser_ney.score_documents(spark.createDataFrame([(alone, "only held")], "doc_id long, text string")).first()
    assert (one.held_out, one.train_tokens, one.n_tokens, one.n_known, one.base_score, one.score) == (True, 0, 3, 0, 0.0, 0.0)


# Toxicity.


def labelled(spark, n=600):
    rng = np.random.default_rng(3)
    rows, marks = [], []
    for i in range(n):
        bad, junk = bool(rng.random() < 0.3), bool(rng.random() < 0.3)
        rows.append((i, prose(1000 + i, 40) + (" vile wretch" if bad else "") + (" lorem filler" if junk else "")))
        marks.append((i, int(not junk), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    chain = toxicity.train(docs, labels.where("doc_id < 400"), categories={"junk": 1 - F.col("quality"), "toxic": F.col("toxic")})
    got = toxicity.score(docs, chain).join(labels.withColumnRenamed("doc_id", "id"), "id").where("id >= 400").collect()
    def auc(yes, no):
        return np.mean([(x > y) + (x == y) / 2 for x in yes for y in no])

    assert auc([r.p_toxic for r in got if r.toxic], [r.p_toxic for r in got if not r.toxic]) > 0.97
    assert auc([r.p_junk for r in got if not r.quality], [r.p_junk for r in got if r.quality]) > 0.9
    assert toxicity.LEAST_REJECT <= chain.reject <= toxicity.MOST_REJECT


def plain_chain(chain, text):
    """Each distinct word's weights added one by one, then the chain."""
    sums = [0.0] * len(chain.models)
    for word in set(brute.words(brute.fold(text))):
        w = K.Words([word.encode()])
        _, feature = toxicity.word_features(w, np.array([0]), w.hashes(fold=True))
        assert len(feature) == 1 + sum(len(word.encode()) >= n for n in toxicity.HEADS)
        sums = [s + float(m.weights[feature].sum()) for s, m in zip(sums, chain.models, strict=True)]
    out = []
    for m, s in zip(chain.models, sums, strict=True):
        odds = [math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6))) for p in out]
        x = m.bias + s + sum(min(max(o, -6), 6) * e for o, e in zip(odds, m.earlier, strict=True))
        out.append(1 / (1 + math.exp(-min(max(x, -35), 35))))
    return out


def test_scores_word_by_word(spark, tricky):
    from tallymill.llm.queries import op6_toxicity, toxicity_chain

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    chain = toxicity_chain(spark, docs, sf)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = op6_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert [r.p_low_quality, r.p_toxic] == pytest.approx(plain_chain(chain, texts[r.doc_id]), abs=1e-9) and r.toxic == (r.p_toxic >= chain.reject)
    odd = sorted((r.p_low_quality, r.p_toxic) for r in toxicity.score(tricky, chain).collect())
    assert np.allclose(odd, sorted(plain_chain(chain, t or "") for _, t in ROWS), atol=1e-9)


def test_threshold():
    y = np.array([0] * 1000 + [1] * 10 + [-1] * 5)
    p = np.concatenate((np.linspace(0, 0.3, 1000), np.full(15, 0.9)))
    assert ((p[:1000] >= toxicity.threshold(p, y)).sum()) == 2
    assert toxicity.threshold(p, np.zeros(1015)) == toxicity.MOST_REJECT


def test_odd_labels_and_texts(spark, tricky, empty):
    kinds = {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")}
    schema = "doc_id long, quality int, toxic int"
    one_class = toxicity.train(tricky, spark.createDataFrame([(5, 1, 0), (6, None, 0), (None, 1, 1), (8, 0, None), (8, 0, None)], schema), categories=kinds)
    got = toxicity.score(tricky, one_class, keep_columns=True)
    assert got.count() == len(ROWS) and got.where("p_toxic between 0 and 1").count() == len(ROWS) and got.select("rest.*").columns == tricky.columns
    none = toxicity.train(tricky, spark.createDataFrame([], schema), categories=kinds)
    assert {r.p_toxic for r in toxicity.score(tricky, none).collect()} == {0.5}
    assert toxicity.score(empty, none).collect() == []
