import hashlib
import html
import itertools
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import common, iblt, licenses, lines, mixing, ordinal, pages, pivots, setjoin
from corpusloom.llm.components import components

DOCS = "doc_id long, text string, source string, n_chars long, row string, size int, s int, _gone string"


def frame(spark, rows):
    """rows: (doc_id, text[, source]); the other columns have names that the operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, len(r[1] or ""), "x", 1, 2, "y") for r in rows], DOCS)


def test_stored_tables_can_be_discarded(spark, monkeypatch):
    kept, gone = common.stored(spark.range(5), "a"), common.stored(spark.range(5).repartition(3), "b")
    folder = gone.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    common.discard(gone)
    assert not os.path.exists(folder) and kept.count() == 5


# 3: shingle join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if rows[i][0] is not None and rows[j][0] is not None and a and b and (rows[i][0] == rows[j][0] or 100 * len(a & b) >= 80 * len(a | b)):
            parent[find(j)] = find(i)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), None if r[0] is None else low[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def near_copies():
    rng, rows = random.Random(5), [(None, "a b c d e f"), (1, ""), (2, None), (3, "one two"), (4, "ONE two"), (5, "one two three"), (6, "a b c d e f"), (6, "a b c d e f"), (7, "É a b c d")]
    passage = " ".join(f"p{i}" for i in range(40))
    for g in range(6):
        base = [f"g{g}_{rng.randrange(500)}" for _ in range(rng.choice([8, 60, 300]))]
        rows += [(100 + len(rows), edited(rng, base, rng.randrange(0, max(2, len(base) // 40)))) for _ in range(12)]
        rows += [(100 + len(rows), passage + " " + edited(rng, base, len(base)))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4096, 4])
def test_join_finds_all_components(spark, monkeypatch, block):
    monkeypatch.setattr(setjoin, "LIST_BLOCK", block)
    monkeypatch.setattr(setjoin, "FREQUENT", 3)
    monkeypatch.setattr(setjoin, "MEMBERS", 3)
    monkeypatch.setattr(setjoin, "LIST_PART", block // 2)
    rows = near_copies()
    got = setjoin.join(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


def test_join_of_nothing(spark):
    assert setjoin.join(frame(spark, [])).count() == 0
    assert setjoin.join(frame(spark, [(1, None)])).collect()[0].component_id == 1


def test_shingle_sets_are_those_of_the_words():
    texts = [t for _, t in near_copies()] + ["a\tb\x0bc\nd e  f ", "x" * 1000]
    seen = {}
    for text, got in zip(texts, setjoin.shingle_sets(texts)):
        want = shingles(text)
        assert len(got) == len(want)
        seen.setdefault(want, got.tobytes())
        assert seen[want] == got.tobytes()


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (5, 9), (9, 7), (4, 4), (30, 1), *((i, i + 1) for i in range(100, 140))], "u long, v long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 30: 1, 5: 5, 7: 5, 9: 5} | {i: 100 for i in range(100, 141)}


# 2: mixing


def filled(sizes, weights):
    """Targets by repeated sharing, as the rule is worded."""
    total, cap, got = 1.5 * sum(sizes), [2.0 * s for s in sizes], [0.0] * len(sizes)
    while total > 1e-9 and any(g < c for g, c in zip(got, cap)):
        open_ = [i for i in range(len(sizes)) if got[i] < cap[i]]
        unit = total / sum(weights[i] for i in open_)
        total = 0.0
        for i in open_:
            got[i] += unit * weights[i]
            if got[i] > cap[i]:
                total, got[i] = total + got[i] - cap[i], cap[i]
    return got


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randrange(1, 200)), rng.choice(["a", "b", "c", "Z", None])) for i in range(400)] + [(400, None, "a"), (401, "", "only empty"), (None, "x y", "b"), (7, "x y z", "a"), (7, "x y z", "a")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    size, taken, target = {}, {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    names = sorted(size, key=lambda s: (s is None, s))
    want = filled([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, w in zip(names, want):
        assert abs(target[s] - w) < 1e-6 and abs(taken[s] - w) <= 8
    key = lambda r: (r.doc_id, r.text_hash, r.source, r.nth)
    again = {key(r): r.taken for r in mixing.mix(frame(spark, rows)).collect()}
    assert len(again) == len(rows) and again == {key(r): r.taken for r in got}
    copies = mixing.copied(frame(spark, rows))
    assert copies.columns == frame(spark, []).columns and copies.count() == sum(r.copies for r in got)
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mix(frame(spark, [(1, None, "a")])).first().taken == 0


def tilted(sizes, target):
    """Rates of least relative entropy up to 2 that meet the target, by bisection."""
    if target >= 2 * sum(sizes):
        return [2.0] * len(sizes)
    low, high = -50.0, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(s * min(2, math.exp(min(1, mid * s))) for s in sizes) < target else (low, mid)
    return [min(2, math.exp(min(1, low * s))) for s in sizes]


@pytest.mark.parametrize("names, shrinks", [("aaaaabbccddddddddddde", 0), ("aaaabbccccccddde", 1)])
def test_rates_are_those_of_least_entropy(spark, monkeypatch, names, shrinks):
    monkeypatch.setattr(mixing, "PART_ROWS", 5)
    rng = random.Random(8)
    # one size is very common
    rows = [(i, " ".join("w" * (9 if i % 2 else rng.randrange(1, 300))), rng.choice(names)) for i in range(900)]
    got = mixing.mix(frame(spark, rows)).collect()
    by_source = {}
    for r in got:
        by_source.setdefault(r.source, []).append(r)
    shrunk = 0
    for own in by_source.values():
        want = tilted([r.size for r in own], own[0].target)
        assert all(abs(r.rate - w) < 1e-5 for r, w in zip(own, want))
        assert abs(sum(r.size * r.rate for r in own) / own[0].target - 1) < 1e-6
        if own[0].target < 2 * own[0].source_size:
            assert len({round(r.rate, 6) for r in own}) > 20
        shrunk += own[0].target < own[0].source_size
        # along the sizes, copies follow the rates
        have = expect = 0
        for r in sorted(own, key=lambda r: r.size):
            have, expect = have + r.copies, expect + r.rate
            assert abs(have - expect) < 22
        assert abs(sum(r.taken for r in own) - own[0].target) <= 9
    assert shrunk == shrinks


# 7: fingerprints


def test_fingerprints(spark):
    rng = random.Random(3)
    rows = [(i * 3, "\n".join(f"line {rng.randrange(60)} of text" for _ in range(rng.choice([1, 4, 30, 300])))) for i in range(60)] + [(1000, None), (1001, ""), (1002, "same\ntext"), (1003, "same\ntext"), (1004, "é" * 1500)]
    got = {r.doc_id: r for r in iblt.fingerprints(frame(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    units = lambda t: set(re.findall(r"[^\n]{200,600}?[.!?](?=\s)|[^\n]{1,600}", t))
    near = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        other = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert abs(r.near_edited - near(units(text), units(other))) < 1e-12 and abs(r.near_next - near(units(text), units(after))) < 1e-12
    assert got[1002].fingerprint == got[1003].fingerprint and got[1000].fingerprint == got[1001].fingerprint
    assert got[1003].near_next == 1.0


def test_fingerprints_of_few_rows(spark):
    assert iblt.fingerprints(frame(spark, [])).count() == 0
    assert iblt.fingerprints(frame(spark, [(5, "a b")])).first().near_next == 1.0
    two = iblt.fingerprints(frame(spark, [(None, "a"), (None, "b"), (4, "c"), (4, "c")])).collect()
    assert len(two) == 4


def test_peeling_says_when_a_sketch_is_too_small(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.xxhash64(i)).alias("k"))
    none = F.array().cast("array<bigint>")
    small = iblt.peel(iblt.subtract(iblt.sketch(F.col("k")), iblt.sketch(none)))
    r = df.select(small.alias("small"), F.size(iblt.differing(F.col("k"), none)).alias("all")).first()
    assert r.small is None and r["all"] == 200


def test_the_digests_that_differ_are_recovered(spark):
    rng = random.Random(7)
    texts = [["\n".join(f"line {rng.randrange(40)} of {n}" for _ in range(n)) for n in (k, k + 1)] for k in (0, 1, 3, 20, 90, 900)]
    # two pairs of digests that share the places in all but the last sketch
    near = [(5, 5 | 1 << 40), (9 << 27, 9 << 27 | 1 << 50)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "i int, a string, b string")
    for r in df.select("a", "b", iblt.digests(F.col("a")).alias("x"), iblt.digests(F.col("b")).alias("y")).withColumn("d", iblt.recovered(F.col("x"), F.col("y"))).collect():
        want = {(1, k) for k in set(r.x) - set(r.y)} | {(-1, k) for k in set(r.y) - set(r.x)}
        assert {(d.n, d.x) for d in r.d} == want and len(r.d) == len(want)
    df = spark.createDataFrame([(list(p), []) for p in near], "x array<bigint>, y array<bigint>")
    for r in df.withColumn("d", iblt.recovered(F.col("x"), F.col("y"))).collect():
        assert sorted(d.x for d in r.d) == sorted(r.x)


@pytest.mark.parametrize("rows_of_one_id, nulls", [(0, 0), (700, 0), (300, 500)])
def test_ranges_are_small_and_keep_the_order(spark, monkeypatch, rows_of_one_id, nulls):
    monkeypatch.setattr(iblt, "RANGE_BYTES", 100)
    monkeypatch.setattr(iblt, "RANGES", 16)
    rng = random.Random(10)
    ids = [rng.randrange(10**12) if i % 5 else rng.randrange(50) for i in range(400)] + [777] * rows_of_one_id + [None] * nulls
    rows = [(i, f"text {k} of some length", "s") for k, i in enumerate(ids)]
    got = iblt.ranged(frame(spark, rows)).collect()
    order = sorted(got, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.order))
    assert [r.bucket for r in order] == sorted((r.bucket for r in got), reverse=True)
    held = {}
    for r in got:
        held[r.bucket] = held.get(r.bucket, 0) + 1
    assert max(held.values()) < 120
    after = {r.text: r.next_text for r in iblt.with_next(frame(spark, rows)).collect()}
    assert after == {r.text: x.text for r, x in zip(order, order[1:] + order[:1])}


# 8: top-k


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots.search, "__defaults__", (3,))
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(1).tolist(), "c") for i in range(150)] + [(20, [9.0] * 6, "c"), (200, None, "c"), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0], "c"), (202, [float("nan")] * 6, "c"), (203, [float("inf")] * 6, "c"), (None, [1.0] * 6, "c"), (204, [1.0, 2.0], "c"), (205, [], "c"), (60, [0.1] * 6, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = pivots.top_k(df, df.where("vec_id % 20 = 0"), 5).collect()
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float))) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in good:
        if i % 20 == 0:
            asked[i] = min(asked.get(i, tuple(v)), tuple(v))
    want = []
    for q, v in asked.items():
        best = sorted((-int(np.dot(v, c)), i) for i, c in good if i != q and len(c) == len(v))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert pivots.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_bounds_stop_the_search_where_vectors_lie_in_groups(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 5
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.05).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = pivots.search(*pivots.pivot_tables(df, df.where("vec_id % 100 = 0"), 40), 5).groupBy("query_id").agg(F.sum("scored").alias("n")).collect()
    assert len(found) == 12 and all(5 <= r.n < 1199 for r in found) and sum(r.n for r in found) < 12 * 1199 * 0.8


# 9 and 10: licenses and lines


def test_license_cases(spark):
    rows = [(1, None), (2, ""), (3, "x UNDER the MIT-License! cc by nc, cc by nc"), (3, "x UNDER the MIT-License! cc by nc, cc by nc"), (None, "apache license version 2"), (4, "licensed under gnu general public license version 3 only"), (5, "Permission is hereby granted free of charge to ANY person obtaining one copy of this software and associated documentation files"), (6, "under the mit"), (7, "é under the mit licenseé")]
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan(frame(spark, rows)).collect()), key=str)
    twice = (3, 11, 3, 1, 8, "cc-by-nc,mit", "cc-by-nc,mit")
    assert got == sorted([(1, 0, 0, None, None, "", ""), (2, 0, 0, None, None, "", ""), twice, twice, (None, 4, 1, 0, 0, "apache-2", "apache-2"), (4, 9, 0, None, None, "", "gpl-3"), (5, 20, 0, None, None, "", "mit"), (6, 3, 0, None, None, "", ""), (7, 5, 0, None, None, "", "")], key=str)
    assert licenses.scan(frame(spark, [])).count() == 0


def brute_lines(rows):
    first, gone = {}, {i: set() for i, _ in rows}
    for i, text in sorted(rows):
        l = text.split("\n")
        for p in range(len(l) - 2):
            key = tuple(l[p : p + 3])
            if key in first:
                q = first[key]
                gone[i] |= set(range(max(p, q[1] + 3) if q[0] == i else p, p + 3))
            else:
                first[key] = (i, p)
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in rows}


@pytest.mark.parametrize("rows_of_a_part, limit", [(1000, 200_000), (1, 200_000), (2, 0)])
def test_lines(spark, monkeypatch, rows_of_a_part, limit):
    monkeypatch.setattr(lines, "PART_ROWS", rows_of_a_part)
    monkeypatch.setattr(lines, "BROADCAST_ROWS", limit)
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))) for i in range(80)] + [(500, "q\n" * 9), (501, "q\n" * 4)]
    out = lines.dedup_lines(frame(spark, rows))
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == brute_lines(rows) and out.columns == [*frame(spark, []).columns, "lines_before", "lines_removed"]


def test_line_cases(spark):
    rows = [(None, "a\nb\nc"), (1, None), (2, ""), (3, "a\nb\nc\nd"), (3, "a\nb\nc\nd")]
    got = sorted(((r.doc_id, r.text, r.lines_removed) for r in lines.dedup_lines(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, "", 3), (1, None, 0), (2, "", 0), (3, "a\nb\nc\nd", 0), (3, "a\nb\nc\nd", 0)], key=str)
    assert lines.dedup_lines(frame(spark, [])).count() == 0


# 4: pages

PAGE = '<html><head><title>T</title><script>if (a < b) "<p>"</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>menu</a></nav><article><h1>Head &amp; &eacute;</h1><p><b>One<br>two   three<p>Four &lt;5 <script>x</script></p><div class="share-buttons">tweet</div><ul><li>a<li>b</ul><section class=comments><article>comment</article></section><form>f</form></article><aside>side</aside><div class="Cookie-Notice">n</div><footer>end</footer></body></html>'


def test_article():
    assert pages.extract(PAGE, set()) == "Head & é\nOne two three\nFour <5\na\nb"
    assert pages.extract("", set()) == "" and pages.extract("plain &amp; text", set()) == "plain & text"
    assert pages.extract("<p>open <p hidden>no</p><p>cut off <a href='", set()) == "open\ncut off"
    assert pages.extract("<div><p>" * 5000 + "deep", set()) == "deep"


def test_names_drop_containers_only():
    body = '<h2 id="social-impact">Impact</h2><section id="related-work"><p class="notice">work</p></section><div class="ad">buy</div><div class="share-buttons">tweet</div>'
    want = "Impact\nwork"
    assert pages.extract(f"<article>{body}</article>", set()) == want
    for outer in ("no-sidebar", "content no-sidebar", "with-comments", "left-sidebar"):
        assert pages.extract(f'<div class="{outer}"><article>{body}</article></div>', set()) == want
    assert pages.extract(f'<div class="content has-sidebar">{body}</div><div class="left-sidebar">x</div>', set()) == want
    assert pages.extract('<article>a</article><div class="sidebar"><article>b</article></div><div class="related-posts"><article>c</article></div>', set()) == "a"


def test_site_template_goes(spark):
    rows = [(i, f"http://h.org/{i}", f"<body><div><p>site line</p><div>menu of the site</div></div><div><p>story {i}</p><p>more {i}</p></div></body>") for i in range(12)]
    rows += [(100 + i, "http://few.org/", f"<body><p>site line</p><p>tale {i}</p></body>") for i in range(2)] + [(200, None, None), (201, None, "<p>x"), (201, None, "<p>x")]
    rows += [(300 + i, "http://copies.org/", "<body><p>same page</p></body>") for i in range(9)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    out = pages.main_text(df)
    got = {r.page_id: r.text for r in out.collect()}
    assert out.columns == ["page_id", "url", "text", "n_chars", "n_removed"] and out.count() == len(rows)
    assert all(got[i] == f"story {i}\nmore {i}" for i in range(12))
    assert got[100] == "site line\ntale 0" and got[200] == "" and got[201] == "x" and got[300] == "same page"
    assert pages.main_text(df.limit(0)).count() == 0


def test_site_template_goes_from_articles(spark):
    page = "<body><article><h1>Title {0}</h1><p>Read our newsletter</p><p>story {0} is <b>not</b> over</p><h2>Get in touch</h2><ul><li>own {0}</li><li>Subscribe here</li></ul><table><tr><td>yes</td><td>{0}</td></tr></table></article></body>"
    df = spark.createDataFrame([(i, f"http://h.org/{i}", page.format(i)) for i in range(12)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pages.main_text(df).collect()} == {i: f"Title {i}\nstory {i} is not over\nown {i}\nyes\n{i}" for i in range(12)}


def test_boxes_of_a_part_of_a_large_host_go(spark):
    box = lambda i: "<p>box of news</p>" if i % 10 == 0 else "<p>seldom</p>" if i < 6 else "<p>often</p>" if i % 8 == 1 else ""
    rows = [(i, f"http://h.org/{'news' if i % 10 == 0 else 'other'}/{i}", f"<article><p>story {i}</p>{box(i)}</article>") for i in range(500)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"story {i}" + ("\nseldom" if 0 < i < 6 else "") for i in got)


def brute_templates(rows):
    """Counts of subtrees by host and section, in plain Python."""
    on = {}
    for url, source in rows:
        m = re.match(r"[a-z]+://([^/]*)(?:/([^/?#]+)/)?", url)
        main, own = pages.candidates(source)
        for h in (0, *own):
            on.setdefault((m[1], h), {}).setdefault(main, set()).add("/" + (m[2] or ""))
    n = {}
    for (host, h), mains in on.items():
        for sections in mains.values():
            for s in ("", min(sections)):
                n[host, s, h] = n.get((host, s, h), 0) + 1
    out = set()
    for (host, s, h), k in n.items():
        share = k / n[host, s, 0]
        if h and k >= 5 and (share >= 0.3 or k >= 50 and share >= 0.01 if s == "" else k >= 10 and share >= 0.3):
            out.add((host, s, h))
    return out


def plain_article(source):
    """What stands in a page's article, by text rules alone."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", inner))
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in blocks]
    return "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_the_pages_of_the_table(spark, small, monkeypatch, limit):
    monkeypatch.setattr(pages, "BROADCAST_HASHES", limit)
    df = spark.read.parquet(f"{small.rsplit('/', 1)[0]}/sf0.01/pages.parquet")
    rows = df.collect()
    found = {(r.host, r.section, r.hash) for r in pages.templates(df).collect()}
    assert found == brute_templates([(r.url, r.html) for r in rows])
    got = {r.page_id: r for r in pages.main_text(df).collect()}
    assert {i: r.text for i, r in got.items()} == {r.page_id: plain_article(r.html) for r in rows}
    # menus, adverts and footers have other words on each page, but one shape on a host
    assert sum(r.n_removed > 0 for r in got.values()) > 50


def test_shapes_go_beside_articles_only():
    page = '<body><div class="box">{0}</div><div><a href="/{0}">{0}</a></div><article><div class="box">story {0}</div></article></body>'
    seen = [pages.candidates(page.format(i))[1] for i in range(3)]
    same = seen[0] & seen[1] & seen[2]
    assert len(same) == 3  # the box, the list of links, its link
    assert pages.extracted(page.format(7), same) == ("story 7", 2)
    bare = page.replace("article>", "section>")
    assert not pages.candidates(bare.format(1))[1] & pages.candidates(bare.format(2))[1]
    assert pages.extracted(bare.format(7), same) == ("7\n7\nstory 7", 0)


# 5: toxicity


def toxic_rows(n, seed):
    rng = random.Random(seed)
    words = [f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(100)]
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        text = [rng.choice(words) for _ in range(40)] + (rng.choices(["vile", "nasty", "awful"], k=rng.randrange(1, 6)) if bad else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), "s"))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows(600, 1)
    model = ordinal.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(model.weights) == {"vile", "nasty", "awful"} and model.thresholds == sorted(model.thresholds)
    others, truth = toxic_rows(300, 2)
    got = [model.above(t)[0] >= ordinal.REJECT for _, t, _ in others]
    assert sum(g == bool(y) for g, (_, y) in zip(got, truth)) >= 298
    mild, harsh = model.above("vile").sum(), model.above("vile nasty awful vile nasty").sum()
    assert mild < harsh


def test_beginnings_of_words_are_features(spark):
    rows, labels = toxic_rows(300, 5)
    rng = random.Random(9)
    for i in range(60):  # each toxic word is in one text, but they begin alike
        noise = [f"w{rng.choice('abcdefghij')}{rng.choice('abcdefghij')}" for _ in range(30)]
        rows.append((1000 + i, " ".join([*noise, "badly" + "".join(rng.choice("abcdefghij") for _ in range(5)), *noise[:9]]), "s"))
        labels.append((1000 + i, 1))
    model = ordinal.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "^badly" in model.weights and model.above("some badlyzzz here")[0] >= ordinal.REJECT > model.above("some bad here")[0]
    assert np.allclose(model.all_above(["vile badlyz", None, ""]), [model.above(t) for t in ("vile badlyz", None, "")])


def test_held_out_labels_of_the_table(spark, small):
    folder = f"{small.rsplit('/', 1)[0]}/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    # near copies mostly begin alike, and so are in the same half
    half = docs.select("doc_id", F.pmod(F.xxhash64(F.substring("text", 1, 60)), F.lit(2)).alias("half"))
    known = labels.select("doc_id", "toxic").join(half, "doc_id")
    model = ordinal.fit(docs, known.where("half = 0"))
    others = docs.join(known.where("half = 1"), "doc_id").select("text", "toxic").toPandas()
    rejected, toxic = model.all_above(others["text"])[:, 0] >= ordinal.REJECT, others["toxic"].to_numpy() == 1
    assert toxic.sum() > 150 and rejected[toxic].mean() > 0.88 and rejected[~toxic].mean() < 0.01


def test_gradient():
    rng = np.random.default_rng(0)
    x, y, n = rng.random((30, 3)), rng.integers(0, 4, 30), rng.random(30)
    theta = rng.normal(size=6)
    _, g = ordinal._negative(theta, x, y, n, 0.1)
    for i in range(6):
        e = np.zeros(6)
        e[i] = 1e-6
        assert abs((ordinal._negative(theta + e, x, y, n, 0.1)[0] - ordinal._negative(theta - e, x, y, n, 0.1)[0]) / 2e-6 - g[i]) < 1e-5


def test_toxicity_cases(spark):
    rows, labels = toxic_rows(300, 3)
    odd = rows + [(None, "vile vile vile"), (1000, None), (1001, ""), (1002, "vile nasty"), (1002, "vile nasty")]
    known = spark.createDataFrame([*labels, (5, None), (None, 1), (7, 0), (7, 0)], "doc_id long, toxic int")
    scored = ordinal.scored(frame(spark, odd), known).collect()
    assert len(scored) == len(odd) and all(r.rejected == (r.p_toxic >= 0.5) for r in scored)
    assert {r.doc_id: r.rejected for r in scored}[1000] is False and {r.doc_id: r.rejected for r in scored}[1002] is True
    kept = ordinal.accepted(frame(spark, odd), known)
    assert kept.columns == frame(spark, []).columns and kept.count() == sum(not r.rejected for r in scored)
    assert ordinal.scored(frame(spark, rows), known.limit(0)).where("rejected").count() == 0
    assert ordinal.scored(frame(spark, []), known).count() == 0


def test_seldom_toxic_words_count_and_near_copies_do_not(spark):
    rows, labels = toxic_rows(600, 4)
    rng = random.Random(6)
    for i in range(12):
        noise = [f"{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}x" for _ in range(30)]
        rows.append((1000 + i, " ".join(noise[:15] + ["vermin"] + noise[15:]), "s"))
        rows.append((2000 + i, " ".join(f"copied{'abcdefghijklmnopqrst'[k]}" for k in range(20)) + " end" + "abcdefghijkl"[i], "s"))
        labels += [(1000 + i, 1), (2000 + i, 1)]
    model = ordinal.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(model.weights) == {"vile", "nasty", "awful", "vermin"} and model.above("some vermin here")[0] >= ordinal.REJECT


# the pipeline


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small).cache()
        assert out.columns == docs.columns, name
        rows = out.collect()
        if name == "toxicity":
            bad = {r.doc_id for r in ordinal.scored(docs, spark.read.parquet(f"{small}/labels.parquet")).where("rejected").collect()}
            assert {r.doc_id for r in rows} == set(before) - bad and bad
        elif name == "line_dedup":
            assert {r.doc_id: r.text for r in rows} == brute_lines([(r.doc_id, r.text) for r in kept]) and all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_duplicates":
            want = brute_components([(r.doc_id, r.text) for r in kept])
            assert sorted(r.doc_id for r in rows) == sorted(i for i, _, c in want if i == c)
        else:
            copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
            counts = {}
            for r in rows:
                counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
            assert counts == {i: n for i, n in copies.items() if n}
        kept, docs = rows, out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in kept}
    assert sum(r.length for r in pieces if r.start == 0) > 0 and max(r.offset + r.length for r in pieces) <= 2048


def test_pipeline_keeps_rows_that_share_an_id(spark, small):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long, "a"), (1, "another text of the same id with words of its own", "a"), (1, long, "a"), (2, long, "b"), (3, None, "a"), (None, long, "a"), (None, long, "a"), (4, "", "b")]
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), small)
    assert got.columns == frame(spark, []).columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, long), (1, rows[1][1]), (3, None), (None, long), (None, long), (4, "")], key=str)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), small).count() == 0, name
        assert stage(spark, frame(spark, rows), small).count() > 0, name


def test_license_words_are_compared(spark, monkeypatch):
    # with one hash for all runs, only the words tell them apart
    monkeypatch.setattr(licenses, "BIT_WORDS", 1)
    monkeypatch.setattr(licenses.F, "xxhash64", lambda *c: F.length(F.concat(*c)).cast("long") * 0 if len(c) == 3 else F.hash(*c).cast("long"))
    rows = [(1, "x under the mit license cc by sa under that mit license"), (2, "one two three four five six"), (3, "cc by nc. cc by nc"), (4, " ".join("abcde") + " gnu lesser general public license")]
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.labels) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {1: (1, 1, 1, "mit"), 2: (0, None, None, ""), 3: (2, 0, 3, "cc-by-nc"), 4: (0, None, None, "lgpl")}


def test_a_whole_copy_in_a_chain_of_diagonals_stays(spark):
    phrase = "gnu general public license version 3"
    text = " ".join(f"gnu general public filler{i}" for i in range(3)) + " " + phrase + " " + " ".join(f"public license version filler{i}" for i in range(3))
    got = licenses.scan(frame(spark, [(1, text), (2, f"{phrase} {phrase}")])).collect()
    assert {r.doc_id: r.labels for r in got} == {1: "gpl-3", 2: "gpl-3"}
