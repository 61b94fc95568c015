"""The operators over corpora on small frames: brute force, planted cases, nulls, empty tables."""

import math
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from velotide.llm import (
    classifier,
    components,
    decontaminate,
    html,
    kneser_ney,
    licenses,
    mixing,
    near_copies,
    quality_rules,
    sharding,
    simhash,
    substring,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    draw = np.random.default_rng(seed)
    words = ["the", "of", "and", *(f"w{k}" for k in range(300))]
    return " ".join(words[int(i)] for i in draw.integers(0, len(words), n))


def frame(spark, texts, start=0):
    rows = [(start + i, t, "en", f"src{i % 3}" if i % 4 else None, len(t) if t else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, blanks, repeated rows, a very long text, and columns with names used inside."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (None, "x y z", None, None, None),
            (4, prose(60_000, 5), "en", "a", 1), (5, "same text here", "en", "b", 1), (5, "same text here", "en", "b", 1),
            (6, "same text here", "en", "b", 1)]
    df = spark.createDataFrame(rows, DOCS)
    extra = "copy copies pool name size id fp cell label node u v digest unit gone word n shard slot row mean _bad _kept".split()
    return df.selectExpr("*", *(f"1 AS {c}" for c in extra))


def test_components_of_chains_stars_and_repeats(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 20)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: 0 for k in range(31)} | {100 + k: 100 for k in range(20)} | {200: 200, 201: 200}
    assert got == want


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    size = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_links_equal_brute_force(spark):
    base = [prose(120, k) for k in range(20)]
    texts = base + [t + f" tail{i}" for i, t in enumerate(base)] + [base[0].replace(" ", f" x{k} ", 1) for k in range(40)] + [base[3].upper(), "", None, "a b"]
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    prints = [fingerprint(t or "") for t in texts]
    assert [got[i].fp & (1 << 64) - 1 for i in range(len(texts))] == prints
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert [got[i].component_id for i in range(len(texts))] == root
    kept = {r.doc_id for r in simhash.keep_one(frame(spark, texts)).collect()}
    assert kept == set(root)


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_equal_brute_force(spark):
    texts = [prose(120, k) for k in range(12)] + ["", None, " ", "a b", "A  b", "a b c"]
    for k in range(12):  # 0 to 4 changed words of 120: similarities on both sides of 0.8
        for changed in range(5):
            words = prose(120, k).split()
            for j in range(changed):
                words[13 + 25 * j + k] = f"new{k}x{changed}x{j}"
            texts.append(" ".join(words))
    texts += [" ".join([*prose(100, 3).split()[:60], *prose(60, 50 + k).split()]) for k in range(5)]
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    docs = frame(spark, texts)
    got = {r.doc_id: r.component_id for r in near_copies.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == root
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == set(root)


def test_the_pipeline_drops_edited_copies(spark):
    base = prose(120, 1).split()
    edited = base.copy()
    edited[30], edited[80] = "other", "another"  # 106 of 126 shingles: 0.84
    far = " ".join("far" if k % 12 == 5 else w for k, w in enumerate(base))
    docs = frame(spark, [" ".join(base), " ".join(edited), far])
    assert {r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, "").collect()} == {0, 2}


def test_near_copies_of_odd_rows(spark, odd, empty):
    assert near_copies.near_duplicates(odd).count() == 8 and near_copies.near_duplicates(empty).count() == 0
    assert near_copies.keep_one(odd).columns == odd.columns
    assert {r.doc_id for r in near_copies.keep_one(odd).collect()} == {None, 1, 4, 5}


def test_every_pair_within_four_bits_meets():
    draw = np.random.default_rng(1)
    low, high = dict(), dict()
    for within, table in ((simhash.LOW_VISIT, low), (simhash.HIGH_VISIT, high)):
        for s, m in simhash._flips(within):
            table.setdefault(s, set()).add(m)

    def syndrome(x):
        s = 0
        for p in range(1, 32):
            s ^= p * (x >> (p - 1) & 1)
        return s

    def home(x):
        s = syndrome(x)
        return x ^ (1 << (s - 1)) if s else x

    for _ in range(500):
        x = int(draw.integers(0, 1 << 63)) << 1 | int(draw.integers(0, 2))
        y = x
        for b in draw.choice(64, int(draw.integers(0, 5)), replace=False):
            y ^= 1 << int(b)
        met = False
        for shift, table in ((0, low), (32, high)):
            a, b = x >> shift & (1 << 32) - 1, y >> shift & (1 << 32) - 1
            met |= home(a) in {b ^ m for m in table[syndrome(b)]}
        assert met


def test_kneser_ney_equals_a_plain_model_and_sums_to_one(spark):
    texts = ["a b a b c", "b a c c", "a b d", "", None, "The the THE a b"]
    docs = frame(spark, texts)
    model = kneser_ney.fit(docs)
    tokens = [(t or "").lower().split() + [None] for t in texts]
    pairs = Counter(p for t in tokens for p in zip(["<s>"] + t[:-1], t))
    words = Counter(w for t in tokens for w in t)
    assert (model.tokens, model.words, model.pairs) == (sum(words.values()), len(words), len(pairs))
    before = Counter(w for _, w in pairs)
    of = lambda d, n: 0.0 if n == 0 else d[min(n, 3) - 1]
    kinds = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
    dp, dw = kneser_ney.discounts(*kinds(pairs)), kneser_ney.discounts(*kinds(before))
    mass = sum(of(dw, n) for n in before.values()) / len(pairs)

    def chance(v, w):
        low = (before[w] - of(dw, before[w])) / len(pairs) + mass / (len(words) + 1)
        follow = [n for (a, _), n in pairs.items() if a == v]
        if not follow:
            return low
        c = pairs[v, w]
        return (c - of(dp, c)) / sum(follow) + sum(of(dp, n) for n in follow) / sum(follow) * low

    for v in ["<s>", "a", "zzz"]:
        assert sum(chance(v, w) for w in words) + chance(v, "never") == pytest.approx(1)
    test = frame(spark, [*texts, "a never seen b"])
    for r in kneser_ney.score(test, model).collect():
        t = ((texts + ["a never seen b"])[r.doc_id] or "").lower().split() + [None]
        assert r.score == pytest.approx(sum(math.log10(chance(v, w)) for v, w in zip(["<s>"] + t[:-1], t)))
        base = sum(math.log10((words[w] + 0.1) / (model.tokens + 0.1 * (model.words + 1))) for w in t)
        assert (r.n_tokens, r.n_known) == (len(t), sum(w in words for w in t)) and r.base_score == pytest.approx(base)


def test_mixing_rates_and_order(spark):
    docs = frame(spark, [prose(5, k) for k in range(3000)])
    got = mixing.mix(docs, {"src1": 3.0}, 1.0).collect()
    size = Counter()
    for r in got:
        size[r.source == "src1"] += len(r.text) + 1
    assert 0.7 < size[True] / sum(size.values()) < 0.8
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)
    heavy = mixing.mix(docs.limit(4), {}, 1.0, scale=100.0).collect()  # means beyond one piece
    assert 250 < len(heavy) < 550
    again = mixing.mix(docs.repartition(7), {"src1": 3.0}, 1.0).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_line_dedup_keeps_the_first_and_the_offsets(spark):
    passage = prose(60, 1)
    texts = [f"unique one\n{passage}\nend", f"{passage.upper()}\nother", "x\nx", f"é{prose(12, 2)}\n{passage}"]
    got = {r.doc_id: r for r in substring.dedup_lines(frame(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[1].text == "other" and got[2].text == "x\nx"
    assert got[3].text == texts[3].split("\n")[0]
    span = got[3].removed[0]
    assert texts[3][span.start : span.end] == passage


def test_passages_inside_other_paragraphs_are_removed(spark):
    shared = "Red green blue one two three four five. Six. And seven eight nine ten eleven twelve!"
    texts = [f"Start here. {shared}\nTail.", f"Own words go on. {shared} Own end.\n\nMore.", f"A head.\n{shared}", "Six. Six. And no more.", "", None]
    got = {r.doc_id: r for r in substring.dedup_lines(frame(spark, texts)).collect()}
    assert [got[k].text for k in range(6)] == [texts[0], "Own words go on. Own end.\n\nMore.", "A head.", *texts[3:]]
    assert [texts[1][s.start : s.end] for s in got[1].removed] == [f" {shared}"]
    again = substring.dedup_lines(frame(spark, texts[1:2]).union(frame(spark, texts[1:2]))).collect()
    assert [(r.text, r.removed) for r in again] == [(texts[1], [])] * 2


def test_main_text(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><div class="cookie-notice">ok</div>'
        "<article><h1>Head  line</h1><p>One &amp; two,<b> three</b>.<p>Four &lt;five&gt;.<script>x('</p>')</script>"
        '<form>name</form></article><section id="comments"><p>Nice post, well said.</p></section><footer>f</footer></body>'
    )
    assert html.main_text(page) == "Head line\nOne & two, three.\nFour <five>."
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>a</nav>") == ""
    rows = spark.createDataFrame([(1, None, page), (None, "u", None), (1, None, page)], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in html.extract(rows).collect()) == [0, 40, 40]


LONG = "A long sentence of the article, with commas, words and a full stop at its end. " * 4


def test_main_text_path_ratios_choose_inside_articles():
    inner = (
        f'<h1>Head</h1><p>{LONG}</p><div class="x1">Buy now</div><h2>Part</h2><p>{LONG}</p><p>Short.</p>'
        f'<div class="x2"><a href="/a">Other story</a> <a href="/b">More stories here</a></div><ul><li>salt</li><li>oil</li></ul><p>{LONG}</p>'
    )
    long = LONG.strip()
    want = "\n".join(["Head", long, "Part", long, "Short.", "salt", "oil", long])
    assert html.main_text(f"<body><article>{inner}</article></body>") == want
    assert html.main_text(f'<body><div class="top">Site</div><div class="x0">{inner}</div><div class="end">Imprint</div></body>') == want


def test_main_text_loses_no_selected_text():
    long = LONG.strip()
    assert html.main_text(f"<body><div><div><p>{long}</p><p>{long}</p></div><div><p>{long}</p></div></div></body>") == "\n".join([long] * 3)
    for name in ("content no-sidebar", "layout has-sidebar"):
        assert html.main_text(f'<div class="{name}"><article><p>{long}</p></article></div>') == long
        assert html.main_text(f'<div class="{name}"><div><p>{long}</p></div></div><div class="ad">Buy</div>') == long
        assert html.main_text(f'<div class="{name}"><main><p>{long}</p></main><div class="sidebar">Side</div></div>') == long
    page = f'<article><h2 id="related-work">Related</h2><p>{long}</p><h2 id="discussion">Talk</h2><p>{long}</p><div class="comments"><p>{long}</p></div></article>'
    assert html.main_text(page) == f"Related\n{long}\nTalk\n{long}"
    assert html.main_text(f'<article><p>{long}</p></article><div class="related"><article>Teaser.</article></div>') == long


def test_licenses_are_found_and_prose_is_left_alone(spark):
    notice = licenses.TEMPLATES["mit-permission"]
    broken = notice.replace("free of charge", "free of any charge").replace("Software", "software")
    texts = [prose(200, 1), f"{prose(333, 2)} {notice} {prose(50, 3)}", f"{prose(7, 4)}\n{broken}", "Released under the MIT License.", None, ""]
    got = {(r.doc_id, r.license_id): r.containment for r in licenses.scan(frame(spark, texts)).collect()}
    assert set(got) == {(1, "mit-permission"), (2, "mit-permission"), (3, "mit-line")}
    assert got[1, "mit-permission"] == 1 and 0.8 <= got[2, "mit-permission"] < 1


def test_decontamination_finds_exact_and_near_passages(spark):
    items = [prose(40, 100), prose(15, 101), prose(60, 102), "one two three", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    near = items[2].split()
    near[30] = "changed"
    texts = [prose(500, 1), f"{prose(77, 2)} {items[0]} {prose(10, 3)}", items[1].upper(), f"{prose(9, 4)} {' '.join(near)}", "One two THREE", None, ""]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame(spark, texts), bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert got[1, 0].similarity == 1 and got[1, 0].word == 77 and 0.8 <= got[3, 2].similarity < 1
    left = {r.doc_id for r in decontaminate.remove_contaminated(frame(spark, texts), bench).collect()}
    assert left == {0, 5, 6}


def test_decontamination_of_texts_shorter_than_the_item(spark):
    item = prose(45, 100).split()
    bench = spark.createDataFrame([(0, " ".join(item)), (1, prose(300, 7)), (2, "a b c d e")], "item_id long, text string")
    texts = [" ".join(item[:-1]), " ".join(item[4:-4]), " ".join(item[:-9]), " ".join(item[8:]), "a b c d", None]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame(spark, texts), bench).collect()}
    assert {k: (r.word, r.n_words, round(r.similarity * 41)) for k, r in got.items()} == {(0, 0): (0, 44, 40), (1, 0): (0, 37, 33), (3, 0): (0, 37, 33)}


def multiset_similarity(a, b):
    a, b = ([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] for w in (a, b))
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / sum((a | b).values())


@pytest.mark.parametrize("similar", [0.8, 0.6])
def test_decontamination_equals_brute_force_at_the_limit(spark, similar):
    items = [prose(50, 1000 + k).split() for k in range(150)] + [(["again", "and"] * 30)[:45]]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    texts = []
    for k, item in enumerate(items):  # one word changed: 41 of 51 shingles, 0.804; two: 0.643 or less
        copy = item.copy()
        for at in (20, 30)[: 1 + (k % 3 == 0 and similar < 0.8)]:
            copy[at] = "changed"
        texts.append(copy if k % 2 else [f"own{k}x{i}" for i in range(3)] + copy + [f"end{k}"])
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(frame(spark, map(" ".join, texts)), bench, similar).collect()}
    want = {}
    for k, words in enumerate(texts):
        for m in (k, (k + 1) % len(items)):
            n = len(items[m])
            best = max(multiset_similarity(words[i : i + n], items[m]) for i in range(max(1, len(words) - n + 1)))
            if best >= similar:
                want[k, m] = best
    assert len(want) >= 150 and got == pytest.approx(want)


def test_differencing_is_tight_and_keeps_groups(spark):
    sizes = np.random.default_rng(3).integers(1, 10_000, 3000)
    parts = sharding.difference(sizes, 16)
    loads = np.bincount(parts, sizes, 16)
    assert loads.max() - loads.min() <= 20
    assert list(sharding.difference(np.array([5, 5, 5, 5]), 4)) in [list(p) for p in __import__("itertools").permutations(range(4))]
    texts = [prose(int(k) % 40 + 1, k) for k in range(400)] + ["copy of one"] * 30 + [None, ""]
    rows = sharding.shard(frame(spark, texts)).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(texts[r.doc_id] or "", set()).add(r.shard)
    assert len(rows) == len(texts) and all(len(s) == 1 for s in by_text.values())
    loads, slots = Counter(), {}
    for r in rows:
        loads[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(loads.values()) - min(loads.values()) <= 400 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_bundles_balance_a_giant(spark, monkeypatch):
    monkeypatch.setattr(sharding, "AT_ONCE", 100)
    monkeypatch.setattr(sharding, "PER_CELL", 50)
    rows = [(bytes([i // 256, i % 256]), 100 + i % 17) for i in range(900)] + [(b"giant", 30_000)]
    groups = spark.createDataFrame(rows, "id binary, size long")
    placed = {bytes(r.id): r.shard for r in sharding.assign(groups, 4).collect()}
    loads = Counter()
    for key, size in rows:
        loads[placed[key]] += size
    assert len(placed) == len(rows) and max(loads.values()) - min(loads.values()) <= 2000


def test_classifier_learns_from_its_folds_only(spark):
    texts = [prose(60, k) if k % 3 else " | ".join(prose(40, k).split()) for k in range(300)] + ["", None]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in classifier.score(docs, labels).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 300]
    assert held and np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    wrong = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert {r.doc_id: r.score for r in classifier.score(docs, wrong).collect()} == {k: r.score for k, r in got.items()}


def test_odd_rows_and_empty_tables(spark, odd, empty):
    bench = spark.createDataFrame([(None, "x"), (1, None)], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for docs, n in ((odd, 8), (empty, 0)):
        assert kneser_ney.score(docs, kneser_ney.fit(docs)).count() == n
        assert simhash.near_duplicates(docs).count() == n
        assert quality_rules.judge(docs).count() == n
        assert sharding.shard(docs).count() == n
        assert sharding.sharded_documents(docs).count() == n
        assert classifier.score(docs, labels).count() == n
        assert licenses.scan(docs).count() == decontaminate.contaminated(docs, bench).count() == 0
        mixed = mixing.mix(docs, {"a": 1.0}, 1.0)
        assert mixed.count() >= 0 and {"copy", "copies", "shuffle_key"} <= set(mixed.columns)
        assert substring.dedup_lines(docs).count() == n
    assert simhash.keep_one(odd).columns == odd.columns
    assert {r.doc_id for r in simhash.keep_one(odd).collect()} == {None, 1, 4, 5}
