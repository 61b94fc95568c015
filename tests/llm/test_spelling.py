"""Spelling variants: neighbours, forms and roots against a plain version."""

import zlib
from collections import Counter

import numpy as np
import regex

from velotide.llm import spelling

DOCS = "doc_id long, text string"
LETTERS = "abcdeéñ"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain(rows, damage=spelling.DAMAGE):
    counts = Counter()
    for doc_id, text in rows:
        for run in regex.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if damage and h % damage == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    found = {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v.encode()), default=None)
        form = best if best and words[best] >= 2 * n else None
        found[w] = (n, len(others), form, words.get(form))

    def root(w):
        while found[w][2]:
            w = found[w][2]
        return w

    return {w: (*v, root(w)) for w, v in found.items()}


def got(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def words(n, seed):
    draw = np.random.default_rng(seed)
    made = set()
    while len(made) < n:
        word = "".join(draw.choice(list(LETTERS), int(draw.integers(5, 9))))
        made.add(word)
        for _ in range(3):  # kin, runs of equal letters among them
            at = int(draw.integers(0, len(word)))
            letter = str(draw.choice([*LETTERS, word[at]]))
            made.add(draw.choice([word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :], word[:at] + word[at + 1 :]]))
    return sorted(w for w in made if len(w) >= 2)


def test_neighbours_of_all_pairs(spark):
    vocabulary = words(350, 3) + ["aa", "ab", "aab", "aaaa", "aaaaa", "zz", "a" * 40, "a" * 41]
    df = spark.createDataFrame([(w,) for w in sorted(set(vocabulary))], "word string")
    pairs = [(r.word, r.near) for r in spelling.neighbours(df).collect()]
    want = {(a, b) for a in set(vocabulary) for b in set(vocabulary) if near(a, b)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_groups_equal_plain_version(spark):
    draw = np.random.default_rng(11)
    vocabulary = words(150, 5)
    weights = draw.pareto(1.0, len(vocabulary)) + 0.1
    rows = []
    for i in range(120):
        chosen = draw.choice(vocabulary, 60, p=weights / weights.sum())
        text = "".join(draw.choice([w, w.title(), w.upper() if w.isascii() else w]) + str(draw.choice([" ", "-", "7", "\n", "Ā"])) for w in chosen)
        rows.append((i if i % 10 else None, text))
    rows += [(500, None), (501, ""), (501, "12 34 €"), (502, rows[3][1]), (502, rows[3][1])]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    assert got(spelling.group_variants(df)) == plain(rows)
    assert got(spelling.group_variants(df, damage=3)) == plain(rows, 3)  # much damage
    assert any(v[4] != w and v[2] != v[4] for w, v in plain(rows).items())  # ways of several forms are among them


def test_ties_take_the_first_in_code_points(spark):
    text = " ".join(["abcde"] * 3 + ["abcdz"] * 6 + ["abcdf"] * 6 + ["zbcde"] * 6 + ["ébcde"] * 6)
    found = got(spelling.group_variants(spark.createDataFrame([(1, text)], DOCS), damage=0))
    assert found["abcde"] == (3, 4, "abcdf", 6, "abcdf") and found["abcdz"][2] is None


def test_roots_of_long_ways(spark):
    links = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [("x", "w30")]
    found = {r.word: r.root for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert found == {f"w{k}": "w37" for k in range(37)} | {"x": "w37"}


def test_odd_rows(spark):
    """A very long text, clashing columns, no word at all, an empty table."""
    rows = [(1, "lettre " * 40_000 + "lettres lettres lettres"), (2, "x" * 30_000)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", *(f"1 AS {c}" for c in "word n x at node form root place id near".split()))
    found = got(spelling.group_variants(df, damage=0))
    assert found == {"lettre": (40_000, 1, None, None, "lettre"), "lettres": (3, 1, "lettre", 40_000, "lettre")}
    assert spelling.group_variants(df.filter("doc_id = 2")).collect() == []
    assert spelling.group_variants(df.limit(0)).collect() == []
