"""Resampling, ranked search and mixing against brute force, on odd rows and on empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from sentryspark.llm import lexical_search, mixing, resampling
from sentryspark.llm.byte_words import Checksums, run_checksums, words_of
from sentryspark.llm.ordered import in_order

PROSE = "the cat sat on the mat and looked at the other cat that sat near the old door by the wall"
# Columns named like those the operators make.
DOCS = ("doc_id long, text string, lang string, source string, item long, row long, score long, "
        "size long, start long, copies long, place long")
ITEMS = "item_id long, text string, block long, rank int"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, PROSE), (1, PROSE), (1, PROSE + " end"), (2, None), (3, ""), (4, " \n\t "), (None, PROSE + " x"),
             (None, None), (5, "word " * 30_000), (6, "é" * 50_000), (7, "Straße, ÀB-c d_e 12x"), (8, "x\x00y z" * 30)]
    rows = [(i, t, "en", source, 7, 7, 7, 7, 7, 7, 7)
            for n, (i, t) in enumerate(texts) for source in [[None, "b", "a", "é"][n % 4]]]
    rows += [(100 + n, f"{PROSE} {n % 7}", "en", "b", 7, 7, 7, 7, 7, 7, 7) for n in range(60)]
    rows += [(300, PROSE, "en", "b", 7, 7, 7, 7, 7, 7, 7)] * 40
    return spark.createDataFrame(rows, DOCS).repartition(7).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, "The cat's 12x word", 0, 0), (1, "The cat's 12x word", 0, 0), (2, None, 0, 0), (3, "", 0, 0),
         (None, "door É " + " ".join(f"w{n}" for n in range(150)) + " old mat", 0, 0), (4, "absent", 0, 0)], ITEMS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def key(row):
    return [(value is None, value or 0) for value in row]


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=key)


@pytest.mark.parametrize("text", ["", None, "A b", "é_ÀZz[`{~\x7f\x80 9/:@", PROSE, "日本 x\ny", "﻿ a b"])
def test_byte_words_are_the_words(text):
    raw = None if text is None else text.encode()
    assert [word.decode() for word in words_of(raw)] == words(text)


def test_checksums_of_runs():
    held = [w.encode() for w in PROSE.split()]
    expected = [zlib.crc32(b" ".join(held[i:i + n])) for n in (1, 2, 3) for i in range(len(held) - n + 1)]
    assert run_checksums(held, 3, Checksums()) == expected
    assert run_checksums([], 3, Checksums()) == []


def weighed(docs, target, longest, buckets, least, percent, seed):
    runs = lambda t: [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for w in [words(t)]
                      for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    held, sought = Counter(), Counter()
    for row in docs:
        held.update(runs(row.text))
    for row in target:
        sought.update(runs(row.text))
    s_all, t_all = held.total(), sought.total()
    gain = [math.floor(1000 * math.log((sought[b] + 1) * (s_all + buckets) / ((held[b] + 1) * (t_all + buckets))))
            for b in range(buckets)]
    found = []
    for row in docs:
        own = runs(row.text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        name = "" if row.doc_id is None else row.doc_id
        h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append([row.doc_id, len(own), weight, score, None, len(words(row.text))])
    fit = sorted((f for f in found if f[5] >= least), key=lambda f: (-f[3], f[0] is None, f[0] or 0, f[1]))
    for rank, row in enumerate(fit[:len(fit) * percent // 100]):
        row[4] = rank + 1
    return sorted((tuple(f[:5]) for f in found), key=key)


@pytest.mark.parametrize("longest, percent", [(1, 10), (2, 50), (3, 0), (1, 100)])
def test_resampling_equals_brute_force(odd, items, longest, percent):
    settings = (longest, 97, 20, percent, 5)
    plan = resampling.resample(odd, items, *settings).select("doc_id", "n_features", "weight", "score", "rank")
    assert rows_of(plan) == weighed(odd.collect(), items.collect(), *settings)


def test_drawn_documents_keep_their_columns(odd, items):
    plan = resampling.resample(odd, items, percent=30).where("rank IS NOT NULL").collect()
    drawn = resampling.drawn(odd, items, percent=30)
    assert drawn.columns == odd.columns
    assert {row.doc_id for row in drawn.collect()} == {row.doc_id for row in plan}
    # Only repeated rows of the last drawn document may come on top.
    assert len(plan) <= drawn.count() <= len(plan) + 40


def searched(docs, items, top):
    docs = [(row.doc_id, words(row.text)) for row in docs]
    counts = [Counter(w) for _, w in docs]
    n_docs, n_terms = sum(bool(c) for c in counts), sum(c.total() for c in counts)
    holders = Counter(term for c in counts for term in c)
    found = []
    for item in items:
        scored = []
        for (doc_id, held), tf in zip(docs, counts):
            if not held:
                continue
            norm = 100 - 50 + (50 * len(held) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[t] + 1)))
                * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * norm))
                for t in set(words(item.text)) if tf[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        found += [(item.item_id, rank + 1, None if no_id else doc_id, -score)
                  for rank, (score, no_id, doc_id) in enumerate(sorted(scored)[:top])]
    return sorted(found, key=key)


@pytest.mark.parametrize("top, characters", [(50, 10_000), (3, 10), (1, 10_000), (1000, 40)])
def test_search_equals_brute_force(odd, items, top, characters, monkeypatch):
    monkeypatch.setattr(lexical_search, "FIRST_MASKS", 2)
    found = lexical_search.search(odd, items, top, characters)
    assert rows_of(found) == searched(odd.collect(), items.collect(), top)


def test_masks_end_the_search_early(spark):
    import numpy as np

    docs = spark.createDataFrame(
        [(n, "rare " * (n % 9 == 0) + "often " * (n % 2) + f"w{n}") for n in range(400)], "doc_id long, text string")
    vocabulary = {b"often": 0, b"rare": 1, b"w7": 2}
    batch = lexical_search.frequencies(docs, vocabulary).toArrow().combine_chunks().to_batches()[0]
    block = lexical_search.Block(batch, np.array([10, 900, 5]), 400, 1000)
    best = lexical_search.Best(20)
    ids = batch.column(0).to_numpy()
    done = lexical_search.evaluate(block, [0, 1, 2], ids, np.zeros(len(ids), bool), best)
    # Documents with the rare term fill the list; those with "often" or "w7" alone can't reach it.
    assert all(doc % 9 == 0 for doc in best.doc_id)
    masks = lexical_search.distinct_masks(block.masks([0, 1, 2])[1])[0]
    assert done <= len(masks)
    again = lexical_search.evaluate(block, [0, 2], ids, np.zeros(len(ids), bool), best)
    assert again == 0


def mixed(docs, weights, most):
    gap = "[^\x20\x09-\x0D]+"
    rows = [(r.source, hashlib.sha256(f"13:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:15],
             r.doc_id, len(re.findall(gap, r.text or ""))) for r in docs]
    sizes = Counter()
    for source, _, _, size in rows:
        sizes[source] += size
    named = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(named)}
    total, target, free = sum(sizes.values()), {}, set(named)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if share[s] >= most * sizes[s]}
        if not above or above == free:
            target.update(share if not above else {s: min(share[s], most * sizes[s]) for s in free})
            break
        target.update({s: float(most * sizes[s]) for s in above})
        free -= above
    found, so_far = [], Counter()
    for source, _, doc_id, size in sorted(rows, key=lambda r: (r[1], r[2] is None, r[2] or 0, r[3])):
        budget = math.floor(target[source])
        full, part = divmod(budget, sizes[source]) if sizes[source] else (0, 0)
        found.append((doc_id, source, size, sizes[source], target[source],
                      full * size + max(0, min(size, part - so_far[source]))))
        so_far[source] += size
    return sorted(found, key=key)


@pytest.mark.parametrize("weights, most, run", [((1, 2, 3), 3, 10_000), ((5, 1), 2, 7), ((1,), 1, 3)])
def test_mix_equals_brute_force(odd, weights, most, run, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", run)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    got, wanted = rows_of(mixing.mix(odd, weights, most)), mixed(odd.collect(), weights, most)
    assert [row[:4] + row[5:] for row in got] == [row[:4] + row[5:] for row in wanted]
    assert [row[4] for row in got] == pytest.approx([row[4] for row in wanted])


def test_mixed_texts_hold_the_words_taken(odd):
    taken = Counter()
    for row in mixing.mix(odd).collect():
        taken[row.source] += row.taken
    found = mixing.mixed_texts(odd.withColumnRenamed("lang", "taken"))
    assert found.columns == [*odd.withColumnRenamed("lang", "taken").columns, "epoch"]
    held = Counter()
    for row in found.collect():
        held[row.source] += len(re.findall("[^\x20\x09-\x0D]+", row.text))
    assert +held == +taken


def test_empty_tables(odd, items):
    none, no_items = odd.where("false"), items.where("false")
    assert resampling.resample(none, items).count() == resampling.drawn(none, items).count() == 0
    plan = resampling.resample(odd, no_items).select("doc_id", "n_features", "weight", "score", "rank")
    assert rows_of(plan) == weighed(odd.collect(), [], 1, 10_000, 20, 10, 2024)
    assert lexical_search.search(none, items).count() == lexical_search.search(odd, no_items).count() == 0
    assert mixing.mix(none).count() == mixing.mixed_texts(none).count() == 0
    blank = odd.where("doc_id IN (2, 3, 4)")
    assert {(r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0.0, 0)}


def test_places_and_running_sums(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(n % 5, n) for n in range(200)] + [(3, 7)] * 100, "item long, value long")
    got = in_order(frame, [F.col("item.item").desc(), F.col("item.value").asc()], F.col("item.value")).collect()
    got.sort(key=lambda row: row.place)
    before = 0
    expected = sorted(([n % 5, n] for n in range(200)), key=lambda p: (-p[0], p[1]))
    assert [row.place for row in got] == list(range(300))
    for row in got:
        assert row.before == before
        before += row.item.value
    held = [[row.item.item, row.item.value] for row in got]
    assert held == sorted(expected + [[3, 7]] * 100, key=lambda p: (-p[0], p[1]))
