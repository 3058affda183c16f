"""Importance resampling, filter audit and URL filters: edge cases and brute-force versions."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pollmill.llm import filter_audit, resampling, url_filter

W = re.compile(r"[^\x20\x09-\x0D]+")
P = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [None, "", " \t\n", "a", "A a É é #", "w " * 60, " ".join(f"w{i}" for i in range(70)), " ".join(f"w{i}" for i in range(70)), "x" * 9 + " " + "x" * 17 + " " + "x" * 9,
         " ".join(f"Zażółć{i % 40}" for i in range(300)), "LOUD WORDS " * 30, " ".join(f"t{i}$" for i in range(55)), " ".join(f"L{i % 7000}ż" for i in range(40_000)), "y" * 70_000 + " y"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s0" if i % 3 else None, "en", 7, "x", 1) for i, t in enumerate(TEXTS)]
    rows += [(6, TEXTS[6], "s0", "en", 7, "x", 1), (None, TEXTS[6], "s1", "en", 7, "x", 1), (None, None, "", "en", 7, "x", 1), (40, TEXTS[9], "s1", "en", 7, "x", 1), (41, TEXTS[9], "s1", "en", 7, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, resampled int, Measured string, row int")


def lowered(t):
    return P.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))


def test_crc_matrices():
    rng = np.random.default_rng(1)
    features = [rng.bytes(int(n)) for n in rng.integers(0, 40, 500)] + [b"", b"x" * 5000]
    assert resampling.crc32_of(features).tolist() == [zlib.crc32(f) for f in features]
    assert resampling.crc32_of([]).tolist() == []


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_against_brute_force(spark, docs, longest):
    target = spark.createDataFrame([("w1 w2 w3 w3",), ("zażółć1",), (None,)], "body string")
    rows, out = resampling.resample(docs, target, target_text="body", buckets=97, longest=longest, percent=50)
    assert out == "resampled_" and rows.columns == [*docs.columns, out]

    def features(t):
        w = lowered(t)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % 97 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    data = [(r.doc_id, r.text) for r in docs.collect()]
    own, aim = np.zeros(97, int), np.zeros(97, int)
    for _, t in data:
        np.add.at(own, features(t), 1)
    for t in ("w1 w2 w3 w3", "zażółć1"):
        np.add.at(aim, features(t), 1)
    gain = [math.floor(1000 * math.log(float(t + 1) * float(own.sum() + 97) / (float(s + 1) * float(aim.sum() + 97)))) for s, t in zip(own, aim)]
    want = []
    for d, t in data:
        f = features(t)
        h = int(hashlib.sha256(f"2024:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        want.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(lowered(t))])
    able = sorted((w for w in want if w[5] >= 20), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    for i, w in enumerate(able[:len(able) * 50 // 100]):
        w[4] = i + 1
    key = lambda x: tuple((v is None, v or 0) for v in x)
    got = [[r.doc_id, r[out].n_features, r[out].weight, r[out].score, r[out].rank, r[out].n_words] for r in rows.collect()]
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_resampling_of_nothing(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs.limit(0), none)[0].count() == 0
    kept = resampling.sample(docs, none, percent=100)
    assert kept.columns == docs.columns and kept.count() == sum(len(lowered(r.text)) >= 20 for r in docs.collect())


def measures(t):
    t = t or ""
    w = W.findall(t)
    return len(w), len(set(w)), sum("A" <= c <= "Z" for c in t), len(t), sum(c in "#$%&*|" for c in t)


def test_transducer(docs):
    rows, out = filter_audit.measure(docs)
    assert out == "measured_" and rows.columns == [*docs.columns, out]
    for r in rows.collect():
        m = r[out]
        assert (m.n_words, m.n_distinct, m.n_capitals, m.n_points, m.n_symbols) == measures(r.text)
        assert bytes(m.digest) == hashlib.sha256((r.text or "").encode()).digest()


def test_hash_table_verifies_its_words():
    texts = [b"ab ab cd ab", b"ab " * 3 + b"longer-than-eight longer-than-eighT longer-than-eight", b""]
    data = b" ".join(texts) + b" " + bytes(8)
    found = [m.span() for m in re.finditer(rb"[^ \x00]+", data)]
    starts, ends = (np.array(x) for x in zip(*found))
    doc = np.searchsorted([0, len(texts[0]) + 1, len(data)], starts, "right") - 1
    spans = filter_audit.Spans(data, starts, ends)
    for hashes in (None, np.zeros(len(doc), np.uint64)):  # with one hash for all only the comparison tells words apart
        assert np.bincount(doc[filter_audit.distinct_mask(spans, doc, hashes)]).tolist() == [2, 3]


def test_audit_against_brute_force(spark, docs):
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 1), (6, 1, None), (7, 1, 1), (10, None, None), (None, 1, 1), (40, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    data = [(r.doc_id, r.text or "", r.source or "") for r in docs.collect()]
    lab = {r.doc_id: [False, False] for r in labels.collect()}
    for r in labels.collect():
        lab[r.doc_id][0] |= r.quality == 1
        lab[r.doc_id][1] |= r.toxic == 1
    lab.pop(None)
    rows = []
    for d, t, part in data:
        w, u, c, p, s = measures(t)
        again = d is not None and any(e is not None and e < d and x == t for e, x, _ in data)
        rows.append((part, {k for k, v in dict(A=w < 50, B=100 * u < 65 * w, C=100 * c > 5 * p, D=s > 0, E=again).items() if v}, *lab.get(d, (False, False))))
    want = set()
    orders = ["".join(o) for o in itertools.permutations("ABCDE")]
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        first = {f: sum(f in r[1] and not r[1] & set(o[:o.index(f)]) for o in orders for r in mine) for f in "ABCDE"}
        for o in orders:
            for i, f in enumerate(o):
                gone = [r for r in mine if f in r[1] and not r[1] & set(o[:i])]
                want.add((part, o, i + 1, sum(not r[1] & set(o[:i + 1]) for r in mine), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine),
                          sum(r[2] for r in gone), sum(r[3] for r in gone), first[f]))
    got = filter_audit.audit(filter_audit.failures(docs, labels))
    assert {(r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()} == want
    assert got.count() == len(want)
    assert filter_audit.audit(filter_audit.failures(docs.limit(0), labels)).count() == 0
    assert filter_audit.audit(filter_audit.failures(docs, labels.limit(0))).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


URLS = {"https://A.Net": ("a.net", "", None), "http://x.net/": ("x.net", "/", "net/"), "http://m.example.net/en/1?a=/b": ("m.example.net", "/en/1", "example.net/en/"),
        "http://badexample.com/de/1": ("badexample.com", "/de/1", None), "http://example.com/de/1": ("example.com", "/de/1", "example.com/de/"), "http://é.org/fr/#x": ("é.org", "/fr/", "org/fr/"),
        "//no/scheme": ("", "", None), "a://b?c://d/e": ("b", "", None), "x://u@h.co.uk:80/p": ("u@h.co.uk:80", "/p", None), "http://[::1]:80/q": ("[::1]:80", "/q", None), "http://10.0.0.1": ("10.0.0.1", "", None),
        None: ("", "", None), "": ("", "", None), "http://a\n.net/\nx": ("a\n.net", "/\nx", "net/"), "http://" + "l" * 200_000 + "/" + "p" * 200_000: ("l" * 200_000, "/" + "p" * 200_000, None)}


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "z", 1) for i, u in enumerate(URLS)], "page_id long, url string, url_verdict string, known int")
    rows, out = url_filter.judge(pages, spark.createDataFrame([], "key long, bad boolean"))
    assert rows.columns == [*pages.columns, out]
    got = {r.url: r[out] for r in rows.collect()}
    assert {u: (g.host, g.path, g.rule) for u, g in got.items()} == URLS
    assert {g.verdict for g in got.values() if g.rule is None} == {"allow"} and got["http://x.net/"].verdict == "block"
    assert url_filter.judge(pages.limit(0), spark.createDataFrame([], "key long, bad boolean"))[0].count() == 0
    hosts = spark.createDataFrame([("u@h.co.uk:80",), ("a.b.example.com.",), ("10.0.0.1:8",), ("localhost",), ("",)], "h string")
    assert [tuple(r) for r in hosts.select(*url_filter.places(F.col("h"))).collect()] == [
        ("h.co.uk", "h.co.uk", "co.uk"), ("a.b.example.com", "example.com", "com"), ("10.0.0.1", "10.0.0.1", "ip"), ("localhost", "localhost", "localhost"), ("", "", "")]


def test_reputation_against_brute_force(spark):
    rng = np.random.default_rng(5)
    pages, outcomes, number = [], [], 0
    for suffix in ("com", "org"):
        for d in range(6):
            for h in range(4):
                rate = 0.9 if (d, h) == (1, 2) else 0.05 + 0.1 * d / 6
                for i in range(200 if (suffix, d, h) == ("com", 0, 0) else int(rng.integers(1, 40))):
                    pages.append((number, f"http://h{h}.d{d}.{suffix}/x", "p"))
                    if rng.random() < 0.7:
                        outcomes.append((number, bool(rng.random() < rate)))
                    number += 1
    pages += [(0, "http://h0.d0.com/x", "p"), (None, "http://lonely.net", "p")]  # a repeated row, a page without key
    outcomes += [outcomes[0], (None, True), (5, None), (10 ** 9, True)]
    frame = spark.createDataFrame(pages, "page_id long, url string, known string")
    rows, out = url_filter.judge(frame, spark.createDataFrame(outcomes, "key long, bad boolean"), rules=())
    bad = {}
    for k, b in outcomes:
        if k is not None and b is not None:
            bad[k] = bad.get(k, False) or b
    count = {}
    for k, u, _ in pages:
        c = count.setdefault(u.split("/")[2], [0, 0])
        c[0] += k in bad
        c[1] += bad.get(k, False)

    def up(groups, parent):
        sums = {}
        for g, (n, k) in groups.items():
            s = sums.setdefault(parent(g), [0, 0])
            s[0] += n
            s[1] += k
        return sums

    def post(groups, mean):
        used = {g: v for g, v in groups.items() if v[0]}
        extra = sum((k - n * mean(g)) ** 2 - n * mean(g) * (1 - mean(g)) for g, (n, k) in used.items())
        most = sum((n - 1) * n * mean(g) * (1 - mean(g)) for g, (n, k) in used.items())
        rho = min(0.5, max(1 / 10001, extra / most)) if most else 0.5
        return {g: (k + (1 / rho - 1) * mean(g), n - k + (1 / rho - 1) * (1 - mean(g))) for g, (n, k) in groups.items()}
    domains = up(count, lambda h: ".".join(h.split(".")[-2:]))
    suffixes = up(domains, lambda d: d.split(".")[-1])
    everything = up(suffixes, lambda s: "")[""]
    s = {g: a / (a + b) for g, (a, b) in post(suffixes, lambda g: everything[1] / everything[0]).items()}
    d = {g: a / (a + b) for g, (a, b) in post(domains, lambda g: s[g.split(".")[-1]]).items()}
    low = {g: max(0.0, a / (a + b) - 1.6448536269514722 * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))) for g, (a, b) in post(count, lambda g: d[".".join(g.split(".")[-2:])]).items()}
    got = rows.collect()
    assert len(got) == len(pages)
    for r in got:
        g = r[out]
        assert (g.n_outcomes, g.n_bad) == tuple(count[g.host]) and abs(g.low - low[g.host]) < 1e-9
        assert g.verdict == ("block" if low[g.host] > 0.5 else "allow")
    assert {r[out].host for r in got if r[out].verdict == "block"} == {h for h in low if low[h] > 0.5} and 0 < sum(v > 0.5 for v in low.values()) < 5
    assert url_filter.allowed(frame, spark.createDataFrame(outcomes, "key long, bad boolean"), rules=()).columns == frame.columns
