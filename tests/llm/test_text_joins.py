"""Spelling variants, collocations and the n-gram join against brute force, and their edges."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from ramify.llm import catalog, collocations, ngram_join, spelling
from ramify.llm.frequency_trie import FrequencyTrie, Words, letter_counts, one_edit_apart
from ramify.llm.rtree import RTree, least_overlap

SCHEMA = "doc_id bigint, text string, lang string, word string, n int, node int, `a.b` int"
LOWER = str.maketrans(catalog.UPPER, catalog.LOWER)


def documents(spark, rows):
    """Rows (doc_id, text, lang) with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "x", 7, 3, 9) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward():
    """Nulls, empty and long texts, repeated rows and near copies of many sizes."""
    random.seed(5)
    vocabulary = ["".join(random.choice("abcdeéß") for _ in range(random.randrange(1, 11))) for _ in range(60)]
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "One two", "en"), (5, "one TWO", "en"), (6, "one", "de")]
    rows += [(7, "one two three", "en"), (7, "one two three", "en"), (None, "one two three", None), (8, "x" * 6000, "en"), (9, "a\x00b , é ß.x y", "fr")]
    number = 20
    for size in (4, 9, 12, 15, 19, 21, 28, 40, 41, 75, 200, 900, 9000):
        base = [random.choice(vocabulary) + str(random.randrange(40)) for _ in range(size)]
        for copy in range(6):
            words = list(base)
            for _ in range(copy * size // 200):
                at = random.randrange(len(words))
                words[at : at + 1] = random.choice([[], ["new"], [words[at], "more"]])
            rows.append((number, random.choice([" ", "\n", "  "]).join(words) + random.choice(["", ".", "!"]), random.choice(["en", "de", None])))
            number += 1
    return rows


def brute_sets(rows, size=3):
    found = []
    for doc_id, text, _ in rows:
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        found.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    return found


@pytest.mark.parametrize("percent", [90, 75])
def test_jaccard_join_equals_brute_force(spark, awkward, percent):
    sets = brute_sets(awkward)
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    smallest = defaultdict(list)
    for i, (doc_id, _, _) in enumerate(awkward):
        if doc_id is not None:
            smallest[find(i)].append(doc_id)
    want = Counter((r[0], len(sets[i]), min(smallest[find(i)], default=None), links[i]) for i, r in enumerate(awkward))
    found = ngram_join.jaccard_join(documents(spark, awkward), percent=percent)
    assert Counter(tuple(r) for r in found.select("doc_id", "n_shingles", "component_id", "n_links").collect()) == want
    assert max(links) >= 4 and len(set(root)) < len(root) - 30


def test_jaccard_join_in_pages(spark, awkward, monkeypatch):
    """Large families are cut into pages; nothing changes."""
    rows = documents(spark, awkward).filter("text is not null")
    whole = {tuple(r) for r in ngram_join.jaccard_join(rows).drop("class_id").collect()}
    monkeypatch.setattr(ngram_join, "PAGE", 30)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in ngram_join.jaccard_join(rows).drop("class_id").collect()} == whole


def test_linked_sets_share_a_key():
    """For sets just above the similarity, of all sizes."""
    random = np.random.default_rng(4)
    for n in [*range(5, 60), 99, 400, 3000]:
        for percent in (90, 60):
            most = ngram_join.most_different(n, percent)
            shared = random.integers(1 << 63, size=n, dtype=np.uint64)
            for left in range(0, most + 1, max(1, most // 4)):
                a, b = np.unique(shared[: n - left]), np.unique(np.append(shared[: n - most], random.integers(1 << 63, size=most - left, dtype=np.uint64)))
                common = len(np.intersect1d(a, b))
                if (100 + percent) * common >= percent * (len(a) + len(b)) and not np.array_equal(a, b):
                    assert len(np.intersect1d(ngram_join.part_keys(a, percent), ngram_join.part_keys(b, percent)))


def test_rtree_loses_no_pair():
    random = np.random.default_rng(2)
    points = random.poisson(3, (300, 8)).astype(np.int64)
    points[100:200] = points[:100] + (random.random((100, 8)) < 0.1)
    sizes = points.sum(axis=1)
    found = {(q, i) for a, b in RTree(points, sizes).candidates(points, sizes, 80) for q, i in zip(a.tolist(), b.tolist())}
    for q in range(300):
        for i in range(300):
            if np.minimum(points[q], points[i]).sum() >= least_overlap(sizes[q] + sizes[i], 80):
                assert (q, i) in found
    assert len(found) < 300 * 30


def brute_counts(rows, spoiled, least_chars=7, least_count=2):
    found = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if spoiled and h % spoiled == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_chars:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= least_count}


def edit_distance_is_one(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def test_spelling_equals_brute_force(spark, monkeypatch):
    random.seed(8)
    stems = ["".join(random.choice("abcdeéÿ") for _ in range(random.randrange(6, 11))) for _ in range(60)] + ["a" * 70, "ab" * 40]
    rows = [(1, None, "en"), (None, "Letters LETTERS letterz", None), (2, "", "en")]
    for i in range(500):
        words = []
        for _ in range(40):
            word = random.choice(stems[: 5 if random.random() < 0.6 else None])
            for _ in range(random.choice([0, 0, 0, 1, 1, 2])):
                at = random.randrange(len(word))
                word = word[:at] + random.choice(["", "a", "bÀ"[0], word[at] + "c"]) + word[at + 1 :]
            words.append(random.choice([word, word.upper() if word.isascii() else word]))
        rows.append((i + 10, random.choice([" ", ", ", "1"]).join(words), "en"))
    rows += [rows[50]] * 3
    want = brute_counts(rows, 31)
    counts = spelling.word_counts(documents(spark, rows), spoiled=31)
    for usual, shard in ((spelling.USUAL_SHARD, spelling.SHARD_WORDS), (20, 10)):
        monkeypatch.setattr(spelling, "USUAL_SHARD", usual)
        monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
        found = {r.word: r for r in spelling.spelling_variants(counts).collect()}
        assert {w: r.n for w, r in found.items()} == want
        near = {w: [x for x in want if edit_distance_is_one(w, x)] for w in want}
        forms = {}
        for w in want:
            best = min(near[w], key=lambda x: (-want[x], x), default=None)
            forms[w] = best if best and want[best] >= 10 * want[w] else None
            assert found[w].n_near == len(near[w]) and found[w].form == forms[w] and found[w].form_n == want.get(forms[w])
        for w in want:
            root = w
            while forms[root]:
                root = forms[root]
            assert found[w].root == root
        assert sum(f is not None for f in forms.values()) > 50


def test_trie_and_comparison():
    random.seed(1)
    words = sorted({"".join(random.choice("abcé") for _ in range(random.randrange(1, 8))) for _ in range(400)} | {"a" * 60, "a" * 61, "a" * 59 + "b"})
    counts = letter_counts(words)
    trie, every = FrequencyTrie(counts), np.ones(len(words), bool)
    met = [(q, i) for a, b in trie.within(counts, every, every) for q, i in zip(a.tolist(), b.tolist())]
    assert len(met) == len(set(met))
    near = {(q, i) for q in range(len(words)) for i in range(len(words)) if edit_distance_is_one(words[q], words[i])}
    assert near <= set(met)
    a, b = (np.array(x) for x in zip(*met))
    assert {(q, i) for q, i, yes in zip(a.tolist(), b.tolist(), Words(words).one_edit_apart(a, b)) if yes} == near
    assert one_edit_apart("abc", "abd") and not one_edit_apart("abc", "abc") and one_edit_apart("abc", "bc") and not one_edit_apart("abc", "cb")


def brute_collocations(rows, support, longest=5, top=2000):
    phrases, totals = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                phrases.update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    scored = defaultdict(list)
    for (lang, *p), a in phrases.items():
        if len(p) < 2 or a < support:
            continue
        cuts = [(1000 * a * totals[lang] // (phrases[lang, *p[:k]] * phrases[lang, *p[k:]]), k, phrases[lang, *p[:k]], phrases[lang, *p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        if not any(o[0] == lang and len(o) - 1 > len(p) and phrases[o] >= a and any(list(o[i : i + len(p)]) == p for i in range(1, len(o))) for o in phrases if phrases[o] >= support):
            scored[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, x, y, totals[lang], -s) for lang, found in scored.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize("few, shard", [(collocations.FEW_WORDS, collocations.SHARD_WORDS), (0, 300)])
def test_collocations_equal_brute_force(spark, awkward, monkeypatch, few, shard):
    monkeypatch.setattr(collocations, "FEW_WORDS", few)
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    monkeypatch.setattr(collocations, "MOST_BITS", 1 << 16 if few else 1 << 7)  # many wrong positives
    monkeypatch.setattr(collocations, "LEAST_BITS", 1 << 7)
    if not few:
        monkeypatch.setattr(collocations, "FEW_LANGUAGES", 0)
    rows = [r for r in awkward if r[0] is None or r[0] < 90]
    rows += [(i, "the end of it. The End of it, a new york\tcity x " + "so so " * (i % 4), ["en", None, "fr"][i % 3]) for i in range(200, 230)]
    found = collocations.collocations(documents(spark, rows), support=6, top=25)
    assert {tuple(r) for r in found.collect()} == brute_collocations(rows, 6, top=25)


def test_score_is_exact_beyond_64_bits(spark):
    row = spark.range(1).select(F.lit(4_000_000_000_000).alias("a"), F.lit(9_000_000_000_000).alias("n"))
    row = row.withColumn("up", collocations._whole(F.col("a") * 1000) * collocations._whole(F.col("n"))).withColumn("down", collocations._whole(F.lit(7_000_000_001)) * collocations._whole(F.lit(3_000_000_000_001)))
    assert row.select(F.expr("up div down")).first()[0] == 1000 * 4_000_000_000_000 * 9_000_000_000_000 // (7_000_000_001 * 3_000_000_000_001)


def test_empty_tables(spark):
    none = documents(spark, [])
    assert ngram_join.jaccard_join(none).count() == 0
    assert spelling.spelling_variants(spelling.word_counts(none)).count() == 0
    assert collocations.collocations(none).count() == 0
    blank = documents(spark, [(1, None, None), (2, " ", "en")])
    assert {tuple(r) for r in ngram_join.jaccard_join(blank).collect()} == {(1, 0, 1, 0, None), (2, 0, 2, 0, None)}
