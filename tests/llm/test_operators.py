"""Edge cases and brute-force versions of the training-data operators, on small frames."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pollmill.llm import decontaminate, html_text, mixing, quality, secrets, simhash, substrings, token_store, toxicity, warc

W = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 5000}" for i in range(30_000))
BASE = " ".join(f"alpha{i}" for i in range(60))
TEXTS = [None, "", " \n\t", "one", "one two", BASE, BASE, BASE + " tail", "head " + BASE, LONG, "É é A a", "x " * 40, BASE.upper()]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s0" if i < 8 else None, 1, "own") for i, t in enumerate(TEXTS)]
    rows += [(5, BASE, "en", "s0", 1, "own"), (None, "one two", "en", "s1", 1, "own")]  # a repeated row, and one without an id
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, LEDGER int, simhash string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def fingerprint(t):
    w = W.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints_and_clashing_names(docs):
    rows, out = simhash.fingerprints(docs)
    assert out == "simhash_" and rows.columns[:-1] == docs.columns
    for r in rows.collect():
        assert r[out].fingerprint & (1 << 64) - 1 == fingerprint(r.text)


def test_simhash_links_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = {int(s) ^ sum(1 << int(b) for b in rng.integers(0, 64, k)) for s in seeds for k in (0, 1, 2, 2, 3, 4)} | {0, (1 << 64) - 1}
    codes = sorted(c - (1 << 64) if c >> 63 else c for c in codes)
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c
    for i, a in enumerate(codes):
        for b in codes[i + 1:]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame([(c, n) for n, c in enumerate(codes)], "code long, first long")
    want = {(c, find(c)) for c in codes}
    assert {(r.fingerprint, r.group_code) for r in simhash.groups(frame).collect()} == want
    split = simhash.components(simhash.links(frame.select("code"), most=1)).collect()  # every run is split
    assert {(r.node, r.root) for r in split} == {w for w in want if any(v[1] == w[1] and v != w for v in want)}


def test_one_of_each_group(docs, empty):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and 1 not in ids and 2 not in ids  # no words: one group
    assert ids.count(5) == 1 and 6 not in ids and len(ids) == len(set(ids))
    assert simhash.one_of_each(empty).count() == 0


def test_quality_ledger_and_ablation(docs, empty):
    book, out = quality.ledger(docs)
    assert out == "ledger_"
    for r in book.collect():
        t, m = r.text or "", r[out]
        w = W.findall(t)
        wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        hit = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(8)} if len(w) < 1000 else None
        assert (m.n_words, m.word_chars) == (len(w), sum(map(len, w)))
        assert hit is None or m.n_repeat_words == len(hit)
        assert bool(m.failed_bits & 1) == (len(w) < 20)
    plain = book.select(F.col(f"{out}.failed_bits").alias("failed_bits"))
    bits = [r.failed_bits for r in plain.collect()]
    for r in quality.ablation(plain).collect():
        mask, one = quality.mask(quality.POLICIES[r.policy]), quality.mask([r.rule])
        assert r.n_failed == sum(bool(b & one) for b in bits) and r.n_only_this == sum(b & mask == one for b in bits)
        assert r.n_kept_without == sum(b & mask & ~one == 0 for b in bits) and r.n_kept == sum(b & mask == 0 for b in bits)
    assert quality.ledger(empty)[0].count() == 0


def test_fm_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    text = np.r_[rng.integers(0, 4, 3000), np.tile([1, 2, 3, 1], 200), 0]
    index = decontaminate.FMIndex(text, 3, sample=5)
    for n in (1, 2, 3, 6):
        phrases = rng.integers(1, 4, (40, n))
        low, high = index.find(phrases, np.full(40, n))
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(len(text) - n + 1) if (text[i:i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination_in_one_and_many_blocks(spark, docs, empty):
    items = spark.createDataFrame([(1, " ".join(f"alpha{i}" for i in range(20, 40))), (2, "one two"), (3, None), (4, ""), (5, "nothing here of it"), (2, "w7 w8 w9")], "item_id long, text string")
    for size in (8 << 20, 64):
        rows, out = decontaminate.find_phrases(docs, items, block_bytes=size, keep=["doc_id", "text"])
        got = {(r.doc_id, r.text): r[out] for r in rows.collect()}
        assert got[(5, BASE)].n_hit == 20 and got[(5, BASE)].items == ["1"] and (got[(5, BASE)].span_start, got[(5, BASE)].span_end) == ([20], [40])
        assert got[(0, None)].n_words == 0 and got[(3, "one")].n_hit == 0 and got[(4, "one two")].items == ["2"]
        assert got[(9, LONG)].n_hit == 18 and got[(12, BASE.upper())].items == ["1"]
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns and {5, 4} & {r.doc_id for r in kept.collect()} == set()
    assert decontaminate.find_phrases(empty, items)[0].count() == 0
    assert decontaminate.without_contaminated(docs, items.limit(0)).count() == docs.count()


def test_decontamination_of_repeated_rows_is_the_same_in_many_blocks(spark):
    items = spark.createDataFrame([(1, "alpha10 alpha11 alpha12 alpha13 alpha14 alpha15 alpha16"), (2, "one two")], "item_id long, text string").coalesce(1)
    rows = [(1, BASE), (1, BASE), (1, "one two and " + "x " * 50), (None, "one two"), (None, "one two"), (None, "x y"), (None, None), (2, "x"), (2, "x")]
    repeated = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = []
    for size in (8 << 20, 40):
        found, out = decontaminate.find_phrases(repeated, items, block_bytes=size, keep=["doc_id"])
        assert found.columns == ["doc_id", out]
        got.append(sorted(map(repr, found.collect())))
    assert got[0] == got[1] and len(got[0]) == len(rows)
    kept = [sorted(map(repr, decontaminate.without_contaminated(repeated, items, block_bytes=size).collect())) for size in (8 << 20, 40)]
    assert kept[0] == kept[1] and len(kept[0]) == 5


def expected_shares(got, margin):
    by = {}
    for m in got:
        by[m[margin]] = by.get(m[margin], 0) + m.probability * m.n_tokens
    return {k: v / sum(by.values()) for k, v in by.items()}


def rake(tokens, levels, goals, whole):
    """Bounded raking in numpy: u per cell, p = min(1, u), levels taken whole apart."""
    u = np.full(len(tokens), 0.5)
    for _ in range(5000):
        for lv, goal in zip(levels, goals):
            e = np.where(whole, 1.0, np.minimum(1, u)) * tokens
            fixed, now = np.bincount(lv, e * whole, len(goal)), np.bincount(lv, e * ~whole, len(goal))
            u = u * np.where(now > 0, np.maximum(goal - fixed, 0) / np.where(now > 0, now, 1), 1.0)[lv]
    return np.where(whole, 1.0, np.minimum(1, u))


def test_mixing_meets_marginals(spark, docs, empty):
    rows = spark.createDataFrame([(i, "w " * (1 + i % 7) + ("a@b.c" if i % 3 else ""), ("en", "de", None)[i % 5 % 3], f"s{i % 4}") for i in range(400)], "doc_id long, text string, lang string, source string")
    goals = spark.createDataFrame([("s0", 0.4), ("s1", 0.3), ("s2", 0.2), ("s3", 0.1), ("absent", 5.0)], "level string, share double").where("level <> 'absent'")
    mixed, out = mixing.mix(rows, 0.3, targets={"source": goals})
    got = [r[out] for r in mixed.collect()]
    assert expected_shares(got, "source") == pytest.approx({"s0": 0.4, "s1": 0.3, "s2": 0.2, "s3": 0.1}, abs=1e-5)
    tokens = sum(m.n_tokens for m in got)
    assert abs(sum(m.n_tokens * m.probability for m in got) - 0.3 * tokens) < 1e-5 * tokens
    assert all(m.sampled == (m.draw < m.probability) and m.met and max(abs(m.off_source), abs(m.off_lang), abs(m.off_topic)) <= 1e-6 for m in got)
    assert mixing.sample(docs).columns == docs.columns and mixing.sample(empty).count() == 0
    assert mixing.mix(docs)[0].count() == docs.count()


def test_mixing_with_levels_taken_whole_equals_numpy(spark):
    rng = np.random.default_rng(2)
    data = [(i, "w " * int(rng.integers(1, 30)) + ("https://x" if rng.random() < 0.05 else ""), rng.choice(["en", "de", "fr"], p=[0.7, 0.2, 0.1]), f"s{rng.choice(5, p=[0.5, 0.2, 0.1, 0.1, 0.1])}") for i in range(1500)]
    rows = spark.createDataFrame([(i, t, str(la), so) for i, t, la, so in data], "doc_id long, text string, lang string, source string")
    targets = {"topic": spark.createDataFrame([("general", 0.7), ("web", 0.3)], "level string, share double")}  # more web pages than there are
    mixed, out = mixing.mix(rows, 0.5, targets=targets)
    got = [r[out] for r in mixed.collect()]
    cells = {}
    for m in got:
        cells.setdefault((m.source, m.lang, m.topic), [0, m.probability])[0] += m.n_tokens
    keys = sorted(cells)
    tokens = np.array([cells[k][0] for k in keys], float)
    budget = tokens.sum() / 2
    levels = [np.unique([k[i] for k in keys], return_inverse=True)[1] for i in range(3)]
    have = [np.bincount(lv, tokens) for lv in levels]
    web = have[2][1]
    goals = [h ** 0.7 / (h ** 0.7).sum() * budget for h in have[:2]] + [np.array([budget - web, web])]
    want = rake(tokens, levels, goals, levels[2] == 1)
    assert all(m.met for m in got)
    assert [cells[k][1] for k in keys] == pytest.approx(want.tolist(), abs=1e-4)


def test_mixing_says_when_goals_can_not_be_met(spark):
    # all of s1 is German, so a German goal below the goal of s1 can't be met
    rows = spark.createDataFrame([(i, "w w w", "en" if i % 2 else "de", "s0" if i % 2 else "s1") for i in range(100)], "doc_id long, text string, lang string, source string")
    ask = lambda *x: spark.createDataFrame(x, "level string, share double")
    mixed, out = mixing.mix(rows, 0.4, targets={"source": ask(("s0", 0.5), ("s1", 0.5)), "lang": ask(("en", 0.7), ("de", 0.3))})
    got = [r[out] for r in mixed.collect()]
    assert not any(m.met for m in got) and max(abs(m.off_source) for m in got) > 0.1


def test_substring_dedup_equals_counting_windows(docs, empty):
    for window, start in ((35, 18), (35, 9), (4, 2)):
        rows, out = substrings.dedup(docs, window=window, start=start)
        rows = rows.collect()
        seen = {}
        for r in rows:
            w = W.findall(r.text or "")
            for i in range(len(w) - window + 1):
                seen[tuple(w[i:i + window])] = seen.get(tuple(w[i:i + window]), 0) + 1
        for r in rows:
            w = W.findall(r.text or "")
            gone = set()
            for i in range(len(w) - window + 1):
                if seen[tuple(w[i:i + window])] > 1:
                    gone.update(range(i, i + window))
            assert (r[out].n_words, r[out].n_removed, r[out].kept) == (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    assert substrings.dedup(empty)[0].count() == 0


def test_substring_dedup_of_thousands_of_equal_rows(spark):
    text, n = " ".join(f"r{i}" for i in range(120)), 3000
    key, at = np.repeat(np.int64(7), n), len(text.split()) - 34
    h, k, place, kind = (np.asarray(c) for c in substrings.level_rows([text.encode()] * n, key, None, 1, [18, 35][1:] * 2))
    assert (kind == substrings.KNOWN).sum() == at and (kind == substrings.MANY).sum() == at and len(kind) == 2 * at
    pieces = spark.createDataFrame([(5, 7, p, substrings.KNOWN) for p in (3, 4)] * n + [(6, 7, 9, substrings.ONE)] * 2, "h long, key long, place int, kind byte")
    assert [sorted(r.places) for r in substrings._survivors(pieces).collect()] == [[3, 4, 9]]
    rows = spark.createDataFrame([(1, text)] * n + [(None, text)] * n + [(2, "of its own " * 2)], "doc_id long, text string").coalesce(2)
    found, out = substrings.dedup(rows, keep=["doc_id"])
    got = {(r.doc_id, r.n, r.gone, r.kept): r["count"] for r in found.groupBy("doc_id", F.col(f"{out}.n_words").alias("n"), F.col(f"{out}.n_removed").alias("gone"), F.col(f"{out}.kept").alias("kept")).count().collect()}
    assert got == {(1, 120, 120, ""): n, (None, 120, 120, ""): n, (2, 6, 0, "of its own of its own"): 1}


def test_secret_spans_and_owners(spark):
    access, opaque = "AKIA" + "Z9" * 9, "Zq9" * 10
    rows = spark.createDataFrame([(1, f"é password = 'hunter22' {access} {opaque}", "o1"), (2, f"{access} token:abc secret=token:abcdefgh", "o2"), (3, None, None), (4, "ab" * 12, None), (5, "", "o1")],
                                 "doc_id long, text string, source string")
    scanned, out = secrets.scan(rows)
    got = {r.doc_id: r[out] for r in scanned.collect()}
    assert [(s.kind, s.start, s.end, s.live) for s in got[1]] == [("assign", 2, 22, True), ("access", 24, 46, False), ("opaque", 47, 77, True)]
    assert [s.kind for s in got[2]] == ["access"] and got[2][0].n_owners == 2
    assert got[3] == [] and [s.kind for s in got[4]] == ["hex"] and got[5] == []
    assert secrets.scan(rows.limit(0))[0].count() == 0


def test_token_store_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer
    import public_tokenizers
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["ΣΑΣ İstanbul ſet", "don't it's 12,345 a—b <|endoftext|> x", "é ﬁ ² Ⅳ \xa0y\x85z", "‘quoted’ naïve Œuvre."]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    whole = Tokenizer.from_file(path)
    got = token_store.with_crc(token_store.store(rows, path, 2), True).collect()
    assert len(got) == rows.count()
    at = 0
    texts = {}
    for r in rows.collect():
        texts.setdefault(r.doc_id, []).append(whole.encode(r.text or "", add_special_tokens=False).ids + [2])
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids in texts[r.key]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    keys = [r.key for r in sorted(got, key=lambda r: r.start)]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    assert token_store.store(empty, path, 2).count() == 0


def test_main_text():
    page = ("<html><head><title>T</title><script>var t='</p>'</script></head><body><header>Site</header><nav><a href='/'>Home</a></nav><div class='cookie-notice'>We use cookies</div>"
            "<article><h1>Head &amp; shoulders</h1><p>The first of the long paragraphs that is in the article<br>and goes\n on.<p>Of.</p><div class=ad>Buy</div><p>The last one of them is as long as the first was.</p>"
            "<section class='comments'><article><p>The reader says that this is a very long comment to the article</p></article></section></article>"
            "<aside>More</aside><form>Mail</form><footer>&copy; us</footer>")
    assert html_text.main_text(page)[0] == ("Head & shoulders The first of the long paragraphs that is in the article and goes on. Of. The last one of them is as long as the first was.")
    assert html_text.main_text("") == ("", 0, 0)
    assert html_text.main_text("<p>It is the text of a page that has no article in it, but it is one.</p><p><a href=x>a link to some other page of the site</a></p>")[0].startswith("It is the text")


def test_main_text_goes_on_after_elements_that_nothing_ends():
    for tag in ("<svg class='i'/>", "<button>", "<video src=x />", "<iframe src='x'/>", "<select>", "<title>", "<canvas>", "<object data=x>"):
        assert html_text.main_text(f"<article><p>One {tag} two</p><p>three</p></article>")[0] == "One two three"
        assert html_text.main_text(f"<article><p>One {tag} two</p></article><p>{tag}</p><div>It is of the page that it is in</div>")[0].startswith("One two")
    for name in ("title-card", "video-player", "button-group", "style-x"):
        assert html_text.main_text(f"<article><p>One <{name}>two</p><p>three</p></article>")[0] == "One two three"
    page = ("<article><title>Use of <script> tags</title><button>Go <b>on</b></button><svg><title>Icon</title><svg></svg>inner</svg><textarea><!-- </textarea>"
            "<iframe src=http://x/>no frames</iframe><p>One</p><script/>var x</script><style>p</style ><select><option>pick</select></article>")
    assert html_text.main_text(page)[0] == "One"


def test_main_text_in_holders_with_boilerplate_words():
    one, two, side = (f"It is the {x} of the long paragraphs that stand in this page and it goes on." for x in ("first", "second", "other"))
    inner = f"<p>{one}</p><p>{two}</p><div class='sidebar'><p>{side}</p></div>"
    for start in ("<div class='layout has-sidebar'>", "<div id=menu><div class='page no-comments'>", "<section role=search>", "<body class='post comments-open'>"):
        assert html_text.main_text(start + inner)[0] == f"{one} {two}"
    assert html_text.main_text(f"<body class=comments-open><article><h1>Head</h1><p>{one}</p></article><div id=comments>" + f"<p>{side}</p>" * 5 + "</div></body>")[0] == f"Head {one}"
    assert html_text.main_text(f"<div class=post><p>{one}</p></div><div id=comments>" + f"<p>{side}</p>" * 5 + "</div>")[0] == one
    assert side not in html_text.main_text("<article>" + "<p>Roses are red</p>" * 9 + f"</article><div class=cookie><p>{side}</p></div>")[0]


def test_main_text_of_rows(spark):
    rows, out = html_text.extract(spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>Just one line</p>" * 2)], "page_id long, url string, html string"))
    assert [r[out].text for r in rows.orderBy("page_id").collect()] == ["", "", "Just one line Just one line"]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a", "x"), (2, "http://b c\r\n", "x"), (3, None, None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n" + "y" * 100_000), (5, "u", "z"), (5, "u", "z"), (None, "u", "q")],
                                  "page_id long, url string, html string")
    index = warc.archive(pages, records_per_file=3)
    got = sorted((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload)) for r in warc.read_records(index).collect() if r.page)
    import base64
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    body = ("é\r\n\r\nWARC/1.1\r\n" + "y" * 100_000).encode()
    assert got == sorted([("1", 1, digest(b"x"), "revisit", "2", None), ("2", 1, digest(b"x"), "response", None, b"x"), ("3", 0, digest(b""), "revisit", "4", None), ("4", 0, digest(b""), "response", None, b""),
                          ("5", len(body), digest(body), "response", None, body), ("5", 1, digest(b"z"), "response", None, b"z"), ("5", 1, digest(b"z"), "response", None, b"z")])
    alone = index.where("record_id = '<urn:page:2>'")
    assert alone.count() == 1 and warc.read_records(alone).first().page == "2"
    assert warc.archive(pages.limit(0)).count() == 0


def test_windows_are_told_apart_by_both_halves():
    rng = np.random.default_rng(4)
    words = [f"w{i}".encode() for i in rng.integers(0, 30, 900)]
    step = substrings.Step([b" ".join(words), b"", b" ".join(words[100:400])])
    for length in (1, 2, 18, 35):
        pairs = list(zip(step.runs(length, 0).tolist(), step.runs(length, 1).tolist()))
        runs = [tuple((words + words[100:400])[i:i + length]) for i in range(len(pairs))]
        assert len(set(pairs)) == len(set(runs)) == len(set(zip(pairs, runs)))
    # equal first halves alone make no class
    first, which, count = substrings._classes(np.array([5, 5, 5, 2], np.uint64), np.array([9, 1, 9, 9], np.uint64))
    assert which[0] == which[2] != which[1] and sorted(count.tolist()) == [1, 1, 2] and set(first.tolist()) == {0, 1, 3}
    assert [len(x) for x in substrings._classes(np.zeros(0, np.uint64), np.zeros(0, np.uint64))] == [0, 0, 0]


def test_gzip_streams_of_any_cut_and_size(spark, tmp_path):
    import gzip
    import io
    record = lambda i, body: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body) + 4}\r\n\r\n\r\n\r\n".encode() + body + b"\r\n\r\n"
    records = [record(i, b) for i, b in enumerate([b"", b"x" * 70_000, b"WARC/1.1\r\n\r\n", bytes(range(256)) * 20])]
    whole = b"".join(records)
    for content in (gzip.compress(whole), b"".join(map(gzip.compress, records)), gzip.compress(whole) + b"\0" * 40, gzip.compress(whole[:500]) + b"\0" * 9 + gzip.compress(whole[500:])):
        for piece in (1, 7, 1000, 1 << 20):
            assert [r for _, r in warc.split_records(warc.inflated(io.BytesIO(content), piece))] == records
    with pytest.raises(ValueError):
        list(warc.inflated(io.BytesIO(gzip.compress(whole)[:-9]), 50))
    assert list(warc.inflated(io.BytesIO(b""))) == []
    # a small file that inflates to 64 MB is never whole in memory
    assert max(map(len, warc.inflated(io.BytesIO(gzip.compress(b"a" * (64 << 20))), 1 << 16))) <= 1 << 16
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "a b.gz").write_bytes(gzip.compress(whole))
    warc.normalise(spark, f"file://{tmp_path}/whole", f"file://{tmp_path}")
    index = spark.read.parquet(f"file://{tmp_path}/index")
    got = {r.page: bytes(r.payload) for r in warc.read_records(index).collect()}
    assert got == {"0": b"", "1": b"x" * 70_000, "2": b"WARC/1.1\r\n\r\n", "3": bytes(range(256)) * 20}


def test_toxicity_edges(spark):
    import random
    draw = random.Random(5)
    text = lambda bad: " ".join(draw.choice(["zorgle", "blarfy"] if bad and draw.random() < 0.2 else ["red", "green", "blue", "tree", "you"]) for _ in range(40))
    rows = [(i, text(i % 3 == 0)) for i in range(900)]
    docs = spark.createDataFrame(rows + [(None, None), (2000, ""), (3, rows[3][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(900)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    scored, out = toxicity.score(docs, labels, trees=5, depth=2)
    got = scored.collect()
    assert len(got) == 903 and all(0 <= r[out].score <= 1 and r[out].held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r[out].score, r.doc_id % 3 == 0) for r in got if r[out].held_out and r.doc_id is not None and r.doc_id < 900]
    assert min(s for s, bad in held if bad) > max(s for s, bad in held if not bad)
    none, out = toxicity.score(docs, labels.where("toxic = 0"), trees=2)
    assert {r[out].score for r in none.collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels)[0].count() == 0


def test_pages_of_undecided_blocks_and_other_languages_keep_their_text():
    line = "Це довгий абзац українською мовою, у якому немає жодного слова з чотирьох інших мов сторінок."
    for page, text in (("<div><p>Just one line</p></div>", "Just one line"), ("<p>Opening times: 9 to 5.</p>", "Opening times: 9 to 5."), (f"<body><p>{line}</p></body>", line),
                       (f"<nav>Меню</nav><h1>Назва</h1><p>{line}</p><ul><li><a href=x>посилання на іншу сторінку цього сайту</a></li></ul><p>{line}</p>", f"Назва {line} {line}")):
        assert html_text.main_text(page)[0] == text


def test_tags_that_never_end_cost_time_in_proportion():
    import time
    for part, tail in (("<a x ", ""), ("<a x ", '"'), ('<a " ', ""), ("<a x='>' ", "'"), ('<a x=">" ', '"'), ("<title>", ""), ("<!-- x ", ""), ("<svg><p>", ""), ("<a '\"", ">")):
        for n in (4_000, 200_000):
            start = time.perf_counter()
            html_text.main_text("<p>It is the text</p>" + part * n + tail)
            took = time.perf_counter() - start
            assert took < 15, (part, tail, n, took)
    assert html_text.main_text('<p>One <a title="x>two</a> three</p>')[0].startswith("One")
    assert html_text.main_text("<p>1 <2 and a <b</p>")[0].startswith("1 <2 and a")


def test_tokens_equal_a_plain_pattern_on_whole_pages(spark):
    attributes = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
    plain = re.compile(r"<!--.*?-->|<[!?][^>]*>" rf"|<(script|style)(?=[\s/>]){attributes}>.*?</\1>|<(title|textarea|iframe)(?=[\s/>]){attributes}>.*?</\2>" rf"|</?[a-zA-Z][a-zA-Z0-9:-]*{attributes}>", re.S | re.I)
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        assert [(t.start, t.end) for t in html_text._tokens(r.html)] == [m.span() for m in plain.finditer(r.html)]


CLASHES = "places alive_key row_key row_key_again repeated_id packed_text secrets secrets_found owner_key repo_key row row_id owner repo value_hash simhash simhash_code simhash_known simhash_row fingerprint code key first_id mix cell_key key_source probability".split()


def test_columns_named_like_helpers_stay(spark):
    texts = [BASE, BASE, None, "", "token = 'AbCdEf123456'", "one two", LONG]
    rows = spark.createDataFrame([(i, t, f"s{i % 2}", "en", *range(len(CLASHES))) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, " + ", ".join(f"{c} int" for c in CLASHES))
    for made in (substrings.dedup(rows)[0], secrets.scan(rows)[0], simhash.near_duplicates(rows)[0], mixing.mix(rows)[0]):
        assert made.columns[:-1] == rows.columns and made.count() == 7
        assert {tuple(r)[:-1] for r in made.collect()} == {tuple(r) for r in rows.collect()}
    kept = simhash.one_of_each(rows)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 5, 6]


def test_a_third_of_all_rows_alike(spark):
    n = 3000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("password = hunter2hunter2 " + BASE)).otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"))).alias("text"),
                                 F.lit("s").alias("source"))
    rows, out = simhash.near_duplicates(rows), None
    got = rows[0].select("doc_id", f"{rows[1]}.first_id").collect()
    assert len(got) == n and all(r.first_id == 0 for r in got if r.doc_id % 3 == 0)
    scanned, out = secrets.scan(rows[0])
    assert scanned.where(F.size(F.col(out)) == 1).count() == n // 3
