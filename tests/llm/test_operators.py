"""Operators against brute-force versions, and their edges."""

import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ramify.llm import (
    catalog,
    chat,
    components,
    decontaminate,
    licenses,
    line_dedup,
    orc_tokens,
    packing,
    quality,
    simhash,
    tokens,
    topk,
    toxicity,
)
from ramify.llm.bktree import Forest, join_labels

SCHEMA = "doc_id bigint, text string, lang string, _text string, start bigint, toxicity double, n_removed int, `a.b` int"
TINY = "/root/testdata/sf0.001"
LOWER = str.maketrans(catalog.UPPER, catalog.LOWER)


def documents(spark, rows):
    """Rows (doc_id, text) with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "x", 7, 0.5, 3, 9) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows."""
    random.seed(3)
    long = " ".join(random.choice(["alpha", "beta", "Gamma,", "délta", "42"]) + str(random.randrange(50)) for _ in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "one two three"), (5, "one two three"), (None, "no id here"), (None, None), (6, "x" * 5000), (7, "a\x00b é ß")]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def vocabulary():
    return catalog.tokenizer_path()


@pytest.fixture(scope="module")
def tokenizer(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def whole_ids(tokenizer, text, end):
    return struct.pack(f"<{len(ids := tokenizer.encode(text or '', add_special_tokens=False).ids) + 1}I", *ids, end)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("ab 'sté\ń  .<|endoftext|>", max_size=60))
def test_word_encoder_equals_whole_text(text):
    from tokenizers import Tokenizer

    path = catalog.tokenizer_path()
    whole = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert tokens.word_encoder(path).encode(text) == struct.pack(f"<{len(whole)}I", *whole)


def check_packing(rows, wanted, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length, bytes(r.ids), r.doc_tokens))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert {k: b"".join(i for _, _, i, _ in sorted(v)) for k, v in by_doc.items()} == wanted
    for k, pieces in by_doc.items():
        assert all(n == len(wanted[k]) // 4 for *_, n in pieces)
        assert [s for s, *_ in sorted(pieces)] == list(np.cumsum([0, *[n for _, n, *_ in sorted(pieces)]])[:-1])
    padding = 0
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == list(np.cumsum([0, *[n for _, n in places]])[:-1])
        used = sum(n for _, n in places)
        assert 0 < used <= capacity
        padding += 0 if used & (used - 1) == 0 else capacity - used
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return padding / sum(len(v) // 4 for v in wanted.values())


@pytest.mark.parametrize("capacity", [4096, 64, 1])
def test_packing(spark, vocabulary, tokenizer, capacity):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").limit(60 if capacity == 1 else 200)
    texts = {r.doc_id: r.text for r in docs.collect()}
    if capacity == 1:
        texts = {k: (v or "")[:40] for k, v in texts.items()}
        docs = documents(spark, list(texts.items()))
    wanted = {k: whole_ids(tokenizer, v, 2) for k, v in texts.items()}
    padding = check_packing(packing.pack(docs.repartition(5), vocabulary, capacity).collect(), wanted, capacity)
    assert padding < 0.02


@given(st.integers(0, 50_000), st.sampled_from([1, 8, 64, 512, 4096]))
def test_cuts_cover_a_document(n, capacity):
    at = 0
    for start, length in packing.cut(n, capacity):
        assert start == at and 0 < length <= capacity
        at += length
    assert at == n


def test_packing_edges(spark, awkward, nothing, vocabulary, tokenizer):
    rows = packing.pack(awkward, vocabulary).collect()
    assert sum(r.length for r in rows) == sum(len(whole_ids(tokenizer, r.text, 2)) // 4 for r in awkward.collect())
    assert packing.pack(nothing, vocabulary).count() == 0
    with pytest.raises(ValueError):
        packing.pack(nothing, vocabulary, 100)


def fingerprint_by_definition(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(deadline=None)
@given(st.text("aB é\n c\x1c.", max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == fingerprint_by_definition(text)


def components_by_definition(prints):
    """{doc_id: smallest doc_id reachable} from {doc_id: fingerprint}."""
    ids, out = sorted(prints), {}
    for i in ids:
        if i in out:
            continue
        todo = [i]
        while todo:
            a = todo.pop()
            out[a] = i
            todo += [b for b in ids if b not in out and (prints[a] ^ prints[b]).bit_count() <= 4]
    return out


@pytest.mark.parametrize("shard_rows,usual", [(2048, 64), (7, 64), (2048, 0.001)])
def test_simhash_components(spark, monkeypatch, shard_rows, usual):
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(simhash, "USUAL_SHARD", usual)
    random.seed(1)
    classes = [random.getrandbits(64) for _ in range(40)]
    for _ in range(6):  # chains and dense groups
        classes += [c ^ sum(1 << random.randrange(64) for _ in range(2)) % (1 << 64) for c in classes[-40:]]
    frame = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in set(classes)], "fp bigint")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(frame).collect()]
    assert all((a ^ b).bit_count() for a, b in links)
    found = {r.node % (1 << 64): r.root for r in components.connected_components(simhash.links(frame)).collect()}
    wanted = components_by_definition({c: c for c in classes})
    groups, mine = defaultdict(set), defaultdict(set)
    for c in set(classes):
        groups[wanted[c]].add(c)
        mine[found.get(c, c)].add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_bk_trees_find_all_pairs():
    random_ = np.random.default_rng(0)
    prints = np.unique(random_.integers(0, 1 << 12, 900).astype(np.uint64) * np.uint64(0x10001))
    tree = np.sort(random_.integers(0, 3, len(prints)))
    rows = np.arange(len(prints))
    found = {(int(a), int(b)) for x, y in Forest(prints, tree, rows).within(rows, tree, 4) for a, b in zip(x, y)}
    near = (np.bitwise_count(prints[:, None] ^ prints) <= 4) & (tree[:, None] == tree)
    assert found == set(zip(*map(list, (x.tolist() for x in np.nonzero(near)))))
    assert join_labels(np.arange(5), np.array([3, 4]), np.array([4, 1])).tolist() == [0, 1, 2, 1, 1]


def test_long_chain_is_one_component(spark):
    order = list(range(300))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a bigint, b bigint")
    assert {r.root for r in components.connected_components(edges).collect()} == {0}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_simhash_query_and_edges(spark, awkward, nothing, rows):
    found = catalog.op2_simhash(spark, TINY).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    prints = {k: fingerprint_by_definition(v) for k, v in texts.items()}
    assert {r.doc_id: r.fingerprint for r in found} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {r.doc_id: r.component_id for r in found} == components_by_definition(prints)
    edge = simhash.near_duplicates(awkward)
    assert edge.count() == awkward.count()
    assert {r.component_id for r in edge.filter("doc_id in (1, 2, 3)").collect()} == {1}
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert rows(kept, "doc_id") == sorted([(1,), (4,), (5,), (6,), (7,), (None,)], key=repr)


def test_chat_views(spark):
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo <|im_end|>"), (1, 3, "ann", None),
        (2, 0, "system", "alone"), (None, 0, None, "who"), (None, 0, None, "who"),
    ]
    frame = spark.createDataFrame([(*t, 1, 2) for t in turns], "conv_id bigint, turn bigint, role string, text string, at int, speaker int")
    found = {(r.conv_id, r.perspective, r.block): r for r in chat.rotate_perspectives(frame, block_turns=3).collect()}
    assert set(found) == {(1, "ann", 0), (1, "ann", 1), (1, "bob", 0), (1, "bob", 1), (None, "unknown", 0)}
    ann = found[1, "ann", 0]
    assert ann.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nyo < |im_end|><|im_end|>\n"
    assert [ann.text[s.start : s.end] for s in ann.mask] == ["hi<|im_end|>"]
    assert [found[1, "bob", 0].text[s.start : s.end] for s in found[1, "bob", 0].mask] == ["yo < |im_end|><|im_end|>"]
    assert found[1, "bob", 1].mask == [] and found[None, "unknown", 0].n_turns == 2
    assert chat.rotate_perspectives(frame.limit(0)).count() == 0


def near(a, b, edits=1):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1] <= edits


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_line_dedup(spark, edits):
    random.seed(5)
    base = ["the quick brown fox number", "jumps over a lazy dog today", "short", "Été à la plage, enfin là !!"]

    def edited(line):
        for _ in range(random.randrange(4)):
            k = random.randrange(len(line) + 1)
            line = random.choice([line[:k] + "q" + line[k:], line[:k] + line[k + 1 :], line[:k] + "z" + line[k + 1 :]])
        return line

    docs = [(i, "\n".join(edited(random.choice(base)).upper() if i % 3 == 0 else "  " + edited(random.choice(base)) for _ in range(3))) for i in range(40)]
    seen, wanted = [], {}
    for i, text in docs:
        kept = []
        for raw in text.split("\n"):
            line = re.sub(r"[ \t\r\f\x0B]+", " ", raw.translate(LOWER)).strip(" ")
            gone = len(line) >= 20 and any(near(line, s, edits) for s in seen)
            if not gone:
                kept.append(raw)
            if len(line) >= 20:
                seen.append(line)
        wanted[i] = "\n".join(kept)
    found = line_dedup.dedup_lines(documents(spark, docs), max_edits=edits)
    assert {r.doc_id: r.text for r in found.collect()} == wanted
    assert found.columns == [*documents(spark, []).columns]


def test_line_dedup_edges(spark, awkward, nothing):
    found = line_dedup.dedup_lines(awkward)
    assert sorted(map(repr, (r.text for r in found.collect()))) == sorted(map(repr, (r.text for r in awkward.collect())))
    assert line_dedup.dedup_lines(nothing).count() == 0
    line = "this line is long enough to count"
    twice = line_dedup.dedup_lines(documents(spark, [(3, line), (3, line), (2, f"{line}\n{line}!\nx"), (None, None)]))
    assert sorted((r.doc_id, r.text, r.n_removed) for r in twice.filter("doc_id is not null").collect()) == [(2, f"{line}\nx", 1), (3, "", 1), (3, "", 1)]


def test_licenses(spark, awkward, nothing):
    apache = licenses.TEMPLATES["Apache-2.0"]
    docs = documents(spark, [(1, f"a longer introduction\n{apache.upper()}\nmore of it"), (2, "Released under\nthe MIT License!"), (3, "Released under no license at all"), (None, None), (4, apache), (4, apache)])
    found = sorted((r.doc_id, r.unit, r.number, r.license, r.dice) for r in licenses.scan_licenses(docs).collect())
    assert found == [(1, "line", 1, "Apache-2.0", 1.0), (2, "paragraph", 0, "MIT", 1.0), (4, "line", 0, "Apache-2.0", 1.0), (4, "line", 0, "Apache-2.0", 1.0)]
    assert licenses.scan_licenses(awkward).count() == 0
    assert licenses.scan_licenses(nothing).count() == 0
    assert licenses.scan_licenses(docs, {"one": "word"}).count() == 0


GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


def test_license_versions_and_full_texts(spark):
    """Notices as programs carry them, and a full text with another holder and line breaks."""
    from ramify.llm import license_templates

    files = license_templates.texts()
    full = " ".join(files["GPL-3.0-text"].split()).replace("Free Software Foundation, Inc.", "Example")
    docs = documents(spark, [
        (1, "Foo " + GNU.format("", 3)), (2, "Foo " + GNU.format("Affero", 3)), (3, "This library " + GNU.format("Lesser", "2.1")), (4, full),
        (5, "Copyright (c) 2024, Example\n" + files["BSD-3-Clause-text"].replace("University", "Example")), (6, "Foo " + GNU.format("", 2)),
    ])
    found = {r.doc_id: r.license for r in licenses.scan_licenses(docs).filter("unit <> 'window'").orderBy("dice").collect()}
    assert found[1] == "GPL-3.0-or-later" and found[2] == "AGPL-3.0-or-later" and found[3] == "LGPL-2.1-or-later"
    assert found[4] == "GPL-3.0-text" and found[5] == "BSD-3-Clause-text" and found[6] == "GPL-2.0-or-later"


def test_licenses_inside_longer_passages(spark):
    from ramify.llm import license_templates

    filler = " ".join(f"filler{i}" for i in range(400))
    mit = license_templates.texts()["MIT-text"]
    docs = documents(spark, [
        (1, "Released under the MIT License. See LICENSE for details."), (2, "Copyright 2024 Example Authors. Released under the MIT License."),
        (3, f"{filler}\n{filler} Licensed under the Apache\nLicense, Version 2.0. {filler}"), (4, f"{filler}\n\n{mit}\n\n{filler}"), (5, filler),
    ])
    found = {(r.doc_id, r.unit, r.number, r.license, r.dice) for r in licenses.scan_licenses(docs).collect() if r.unit == "window"}
    assert {(1, "window", 0, "MIT", 1.0), (2, "window", 4, "MIT", 1.0), (3, "window", 800, "Apache-2.0", 1.0)} <= found
    assert (4, "window", 400, "MIT-text", 1.0) in found and {x[0] for x in found} == {1, 2, 3, 4}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("released under the mit license a b".split()), max_size=14))
def test_license_windows_are_the_best(words):
    words = [w.encode() for w in words]
    scanner = licenses.Scanner({"MIT": licenses.TEMPLATES["MIT"]}, 0.6)
    template, best = licenses.bigrams([b"released", b"under", b"the", b"mit", b"license"]), 0
    for i in range(len(words)):
        for j in range(i + 2, len(words) + 1):
            grams = licenses.bigrams(words[i:j])
            best = max(best, 2 * len(grams & template) / (len(grams) + len(template)))
    found = scanner.windows(words, scanner.possible(words))
    assert (found[0][0] if found else 0) == (best if best >= 0.6 else 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("released under the mit license version a b".split()), max_size=14))
def test_license_pruning_loses_nothing(words):
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.5)
    passage, grams = " ".join(words), licenses.bigrams(licenses.normalised_words(" ".join(words)))
    wanted = []
    for name, template in licenses.TEMPLATES.items():
        other = licenses.bigrams(licenses.normalised_words(template))
        dice = 2 * len(grams & other) / (len(grams) + len(other)) if grams else 0
        if dice >= 0.5:
            wanted.append((name, dice))
    assert scanner.matches(passage) == wanted


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    random.seed(4)
    vectors = [(i, [float(random.randrange(-2, 3)) for _ in range(4)]) for i in range(150)]
    odd = [(None, [1.0] * 4), (500, None), (550, [1.0, None, 0.0, 0.0]), (600, [float("nan")] * 4), (650, [float("inf")] * 4), (700, []), (750, [1.0, 2.0]), (50, [2.0] * 4)]
    frame = spark.createDataFrame(vectors + odd, "id bigint, v array<double>").repartition(5)
    found = topk.top_products(frame.filter("id % 50 = 0"), frame, 5).collect()
    good = vectors + [(700, []), (750, [1.0, 2.0]), (50, [2.0] * 4)]
    scored = defaultdict(list)
    for q, v in good:
        if q % 50 == 0:
            scored[q] += [(-int(sum(x * y for x, y in zip(v, w))), c) for c, w in good if c != q and len(w) == len(v)]
    wanted = sorted((q, n + 1, c, -s) for q, all_ in scored.items() for n, (s, c) in enumerate(sorted(all_)[:5]))
    assert sorted((r.query_id, r.rank, r.id, r.score) for r in found) == wanted
    assert topk.top_products(frame.limit(0), frame, 5).count() == 0
    assert topk.top_products(frame.filter("id = 1"), frame.limit(0), 5).count() == 0


def test_products_are_exact():
    big = np.array([[3e15, 1.0]])
    assert topk.products(big, np.array([[1000.0, 1.0]]))[0, 0] == 3 * 10**18 + 1
    with pytest.raises(OverflowError):
        topk.products(np.array([[1e200]]), np.array([[1e200]]))


def held_out(labels, folds, rest):
    return {k: v for k, v in labels.items() if zlib.crc32(str(k).encode()) % folds == rest}


def ranked_right(scores, labels):
    """Share of pairs of a 1 and a 0 in which the 1 scores higher."""
    ones, zeros = ([scores[k] for k, v in labels.items() if v == x and k in scores] for x in (1, 0))
    return np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    found = catalog.op7_quality(spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in found)
    held = held_out(labels, 3, 1)
    assert ranked_right({r.doc_id: r.score for r in found}, held) > 0.95
    assert np.mean([r.predicted == held[r.doc_id] for r in found if r.doc_id in held]) > 0.9


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    found = catalog.op8_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in found)
    held = held_out(labels, 5, 0)
    assert ranked_right({r.doc_id: r.score for r in found}, held) > 0.95
    assert np.mean([r.predicted == held[r.doc_id] for r in found if r.doc_id in held]) > 0.96


def test_pairs_of_terms_are_learned():
    """Neither term alone tells anything; both together do."""
    random_ = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(3000):
        a, b = random_.integers(0, 2, 2)
        rows.append(np.array([10] * a + [20] * b + [30 + int(random_.integers(0, 5))], np.int64))
        labels.append(int(a == b))
    machine = toxicity.fit(rows, np.array(labels), epochs=60)
    logits = machine.logits([np.array(x, np.int64) for x in ([10, 20, 31], [10, 31], [20, 31], [31])])
    assert min(logits[0], logits[3]) > 0 > max(logits[1], logits[2])


def test_pairs_of_rare_terms_are_learned():
    """Two terms in 8 % of the rows each, which alone tell nothing by z >= 4; both together are toxic."""
    random_ = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(20_000):
        pair, a = i < 400 and i % 10 == 0, random_.random() < 0.078
        b = not a and random_.random() < 0.078
        rows.append(np.array([10] * (a or pair) + [20] * (b or pair) + sorted(set((1000 + random_.zipf(1.3, 10) % 4000).tolist())), np.int64))
        labels.append(int(i % 10 == 0))
    labels = np.array(labels)
    assert not {10, 20} & set(toxicity._telling(rows, labels).tolist())
    assert all(sum(x in r for r in rows) < 2000 for x in (10, 20))
    logits = toxicity.fit(rows, labels).logits([np.array(x, np.int64) for x in ([10, 20], [10], [20], [])])
    assert logits[0] > max(logits[1:]) + 1.5


def test_quality_risk_without_negatives():
    random_ = np.random.default_rng(2)
    good, bad = random_.normal(1, 1, (1500, quality.FEATURES)), random_.normal(-1, 1, (500, quality.FEATURES))
    model = quality.fit(good[:750], np.concatenate([good[750:], bad]), 0.6)
    assert (model.logits(good) >= 0).mean() > 0.95 and (model.logits(bad) < 0).mean() > 0.95


def test_quality_from_positives_alone(spark):
    """Without one labelled negative: the prior is estimated, and bad held-out documents are told."""
    folder = "/root/testdata/sf0.01"
    docs, marks = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    labels = {r.doc_id: r.quality for r in marks.collect()}
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = quality.train(docs, marks.filter((fold != 1) & (F.col("quality") == 1)))
    known = [v for v in labels.values() if v is not None]
    assert abs(model.prior - np.mean(known)) < 0.05
    held = held_out(labels, 3, 1)
    found = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert ranked_right(found, held) > 0.95
    assert np.mean([(found[k] >= 0.5) == v for k, v in held.items() if k in found]) > 0.95
    assert np.mean([found[k] < 0.5 for k, v in held.items() if k in found and v == 0]) > 0.8


def test_quality_prior_and_sums(spark):
    """The prior of two overlapping heaps, and sums in tasks against numpy."""
    random_ = np.random.default_rng(3)
    good, bad = random_.normal(2, 1, 30_000), random_.normal(-2, 1, 20_000)
    steps, positives, both = np.linspace(-3, 4, 50), good[:5000], np.concatenate([good[5000:], bad])
    above_u, above_p = ((x[:, None] >= steps).sum(axis=0) for x in (both, positives))
    assert abs(quality.least_ratio(above_u, len(both), above_p, 5000) - 25 / 45) < 0.03
    x = random_.normal(0, 1, (300, quality.FEATURES))
    found = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "doc_id bigint, x array<double>").repartition(5)
    assert np.allclose(quality._summed(found, quality.FEATURES, lambda m: m.sum(axis=0)), x.sum(axis=0))


def test_least_risk_is_the_least():
    """No nearby weights have a lower non-negative risk."""
    random_ = np.random.default_rng(5)
    p, u = (np.concatenate([np.ones((n, 1)), random_.normal(m, 1, (n, 6))], axis=1) for n, m in ((40, 0.7), (90, 0.2)))
    sp, su = p.T @ p / len(p), u.T @ u / len(u)

    def risk(w, prior):
        negative = np.mean((1 + u @ w) ** 2) - prior * np.mean((1 + p @ w) ** 2)
        return prior * np.mean((1 - p @ w) ** 2) + max(0, negative) + quality.RIDGE * (w[1:] @ w[1:])

    for prior in (0.3, 0.6, 0.95):
        best = quality.least_risk(sp, su, prior)
        assert all(risk(best, prior) <= risk(best + random_.normal(0, s, 7), prior) + 1e-6 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(50))


def test_classifier_edges(spark, awkward, nothing):
    labels = spark.createDataFrame([(5, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    machine = toxicity.train(awkward, labels)
    scored = toxicity.score(awkward, machine)
    assert scored.count() == awkward.count() and scored.columns.count("toxicity") == 1
    assert toxicity.drop_toxic(awkward, machine, 2.0).columns == awkward.columns
    assert toxicity.score(nothing, machine).count() == 0
    assert {r.toxicity for r in toxicity.score(awkward, toxicity.train(awkward, labels.limit(0))).collect()} == {0.0}
    model = quality.train(awkward, labels)
    assert quality.score(awkward, model).filter("score between 0 and 1").count() == awkward.count()
    assert quality.score(nothing, model).count() == 0
    assert quality.train(nothing, labels) is None
    assert {r.score for r in quality.score(awkward, None).collect()} == {0.5}


def test_orc_round_trip(spark, tokenizer, rows, tmp_path, vocabulary):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    start, wanted = 0, []
    for k in sorted(texts):
        ids = whole_ids(tokenizer, texts[k], 1)
        wanted.append((k, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(map(tuple, catalog.op9_orc_tokens(spark, TINY).collect())) == wanted
    path = str(tmp_path / "tokens")
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    orc_tokens.write_tokens(docs, path, vocabulary)
    one = orc_tokens.read_tokens(spark, path, [17])
    assert [struct.pack(f"<{len(r.ids)}I", *r.ids) for r in one.collect()] == [whole_ids(tokenizer, texts[17], 1)]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in one._jdf.queryExecution().toString()
    # Files hold ascending, separate ranges, row by row.
    ordered = orc_tokens.read_tokens(spark, path).orderBy("slice", "pos").select("doc_id").collect()
    assert [r.doc_id for r in ordered] == sorted(texts)


def test_orc_edges(spark, awkward, nothing, tokenizer, vocabulary, tmp_path):
    path = str(tmp_path / "awkward")
    orc_tokens.write_tokens(awkward, path, vocabulary)
    found = orc_tokens.token_starts(orc_tokens.token_digests(orc_tokens.read_tokens(spark, path))).orderBy("start").collect()
    ids = [r.doc_id for r in found]
    assert ids[:2] == [None, None] and ids[2:] == [1, 2, 3, 4, 5, 5, 6, 7]
    assert [r.start for r in found] == list(np.cumsum([0, *[r.n_tokens for r in found]])[:-1])
    empty = str(tmp_path / "empty")
    orc_tokens.write_tokens(nothing, empty, vocabulary)
    assert orc_tokens.token_starts(orc_tokens.token_digests(orc_tokens.read_tokens(spark, empty))).count() == 0


def test_decontamination(spark, awkward, nothing, rows):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame(
        [(1, " ".join(words[:20])), (2, "Tiny, ITEM"), (10, " ".join(words[5:25])), (3, None), (4, "..."), (None, "tiny item")], "item_id bigint, text string"
    )
    docs = documents(spark, [
        (1, "x " + ", ".join(words[3:18]).upper() + " y"), (2, "a tiny-item b tiny item c"), (3, " ".join(words[:12])),
        (4, None), (5, ""), (6, "tiny item" + " filler" * 50), (6, "tiny item" + " filler" * 50), (None, "TINY item"), (7, " ".join(words[7:23])),
    ])
    found = decontaminate.find_contamination(docs, bench)
    assert rows(found, "doc_id", "n_words", "n_hit", "item_ids", "contaminated") == sorted([
        (1, 17, 15, [1, 10], True), (2, 7, 4, [2], True), (3, 12, 0, [], False), (4, 0, 0, [], False), (5, 0, 0, [], False),
        (6, 52, 2, [2], False), (6, 52, 2, [2], False), (None, 2, 2, [2], True), (7, 16, 16, [1, 10], True),
    ], key=repr)
    assert rows(decontaminate.decontaminate(docs, bench), "doc_id") == sorted([(3,), (4,), (5,), (6,), (6,)], key=repr)
    clean = decontaminate.decontaminate(docs, bench, "spans")
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[1] == "x y" and texts[2] == "a b c" and texts[4] is None and texts[3] == " ".join(words[:12])
    assert decontaminate.find_contamination(clean, bench).filter("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(nothing, bench).count() == 0
    assert decontaminate.decontaminate(awkward, bench).columns == awkward.columns
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, bench, "other")


def test_benchmark_in_blocks(spark, monkeypatch, rows):
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    once = rows(catalog.op10_decontaminate(spark, TINY), *columns)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 100)
    assert rows(catalog.op10_decontaminate(spark, TINY), *columns) == once


def test_decontamination_is_native(spark):
    plan = catalog.op10_decontaminate(spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_remainder(spark):
    from ramify.llm.labelled import remainder

    frame = spark.createDataFrame([(i,) for i in range(50)], "doc_id bigint").select("doc_id", remainder(F.col("doc_id"), 5).alias("r"))
    assert all(r.r == zlib.crc32(str(r.doc_id).encode()) % 5 for r in frame.collect())


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    """10,000 rows of one id on both sides do not multiply, and the bound holds."""
    many = documents(spark, [(7, f"same words {i % 5}") for i in range(10_000)] + [(i, "others here") for i in range(100, 160)])
    marks = spark.createDataFrame([(7, i % 2, 1) for i in range(10_000)] + [(i, 0, 0) for i in range(100, 160)], "doc_id bigint, toxic int, quality int")
    from ramify.llm.labelled import labelled_sample, one_each

    found = one_each(labelled_sample(many, marks, "toxic", 40)).collect()
    assert len(found) == 40 and len({r.doc_id for r in found}) == 40
    whole = {r.doc_id: r.label for r in one_each(labelled_sample(many, marks, "toxic", 1000)).collect()}
    assert len(whole) == 61 and whole[7] == 1


def test_long_texts_are_scored_in_parts(monkeypatch):
    random.seed(2)
    texts = [" ".join(f"w{random.randrange(5000)}" for _ in range(n)) for n in (0, 1, 3000, 50, 700)] + [None]
    buckets = np.unique(np.concatenate([toxicity.term_buckets(t) for t in texts]))
    draw = np.random.default_rng(1)
    model = toxicity.FactorizationMachine(-0.3, buckets, draw.normal(0, 0.1, len(buckets)), draw.normal(0, 0.01, (len(buckets), 16)))
    whole = toxicity.scores(model, texts)
    monkeypatch.setattr(toxicity, "TERMS_AT_ONCE", 10)
    assert np.allclose(toxicity.scores(model, texts), whole) and len(whole) == len(texts)


def test_licenses_many_notices():
    """20,000 notices in one text, in lines of their own and inside longer ones, in a few seconds."""
    import time

    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.LEAST_DICE)
    notice = licenses.TEMPLATES["MIT"]
    text = "\n".join([notice] * 10_000 + [f"This text is {notice.lower()} See the file for more of it."] * 10_000)
    began = time.monotonic()
    found = scanner.scan(text)
    assert time.monotonic() - began < 15
    assert sum(f[0] == "line" for f in found) == 10_000 and sum(f[0] == "window" for f in found) == 10_000
    assert all(f[2] == "MIT" for f in found)


def test_licenses_windows_keep_the_best_apart():
    """Kept windows equal those of comparing every window with every kept one."""
    random.seed(9)
    scanner = licenses.Scanner({"a": "red fox runs far away now", "b": "fox runs far away again"}, 0.5)
    for _ in range(100):
        words = [random.choice(b"red fox runs far away now again x y".split()) for _ in range(60)]
        possible = scanner.possible(words)
        kept = scanner.windows(words, possible)
        assert all(a is b or a[3] <= b[2] or b[3] <= a[2] for a in kept for b in kept)
        for i in possible:
            alone = licenses.Scanner({scanner.names[i]: {"a": "red fox runs far away now", "b": "fox runs far away again"}[scanner.names[i]]}, 0.5)
            for w in alone.windows(words, [0]):
                assert any(w[2] < k[3] and k[2] < w[3] and k[0] >= w[0] for k in kept)


def test_drop_near_duplicates_by_shuffle(spark, awkward, monkeypatch):
    few = sorted(map(str, simhash.drop_near_duplicates(awkward).collect()))
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    assert sorted(map(str, simhash.drop_near_duplicates(awkward).collect())) == few
    assert len(few) == len(set(few))
