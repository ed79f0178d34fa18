"""The operators for training data: brute force on small tables, and odd rows for every one."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from sentryspark.llm import (
    common, compression, decontamination, language_id, packing, personal_data, pitman_yor, quality,
    registry, simhash, token_files, tokens, url_filters,
)
from sentryspark.llm.components import connected_components

SMALL = "/root/testdata/sf0.001"
PROSE = "the cat sat on the mat and looked at the other cat that sat near the old door"
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, row long, fp long, "
        "word string, base string, kind string")


def docs_of(spark, *texts):
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), 1, 1, "w", "b", "k") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    rows = [(1, PROSE), (1, PROSE), (2, None), (3, ""), (4, " \n\t "), (None, PROSE + " x"), (None, None),
            (5, "word " * 30_000), (6, "é" * 50_000), (7, "a@b.co +1 (555) 123-4567"), (8, "x" * 70_000),
            (9, "un deux trois quatre cinq six sept huit neuf dix onze douze"), (10, "!!! ???")]
    return spark.createDataFrame(
        [(i, t, None if i is None else "fr" if i == 9 else "en", None, None, 1, 1, "w", "b", "k")
         for i, t in rows], DOCS)


def labels_of(spark, *rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_every_operator_takes_odd_rows(spark, odd):
    n = odd.count()
    labels = labels_of(spark, (1, 1, 0), (5, 0, 0), (5, None, 0), (99, 0, 0))
    items = spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (None, "two words")],
                                  "item_id long, text string")
    assert compression.judge_texts(odd).count() == n
    assert quality.classify(odd, labels).where("score BETWEEN 0 AND 1").count() == n
    found = {row.doc_id: row.lang_pred for row in language_id.identify(odd, odd).collect()}
    assert found[2] == found[3] == found[10] == "und" and found[9] == "fr"
    near = simhash.near_duplicates(odd).collect()
    assert len(near) == n and {row.component_id for row in near if row.doc_id in (2, 3, 4)} == {2}
    assert {row.doc_id for row in decontamination.find_leaks(odd, items).collect()} == {1, None}
    assert personal_data.find_personal_data(odd).count() == n
    path = tokens.tokenizer_path(packing.VOCABULARY)
    assert packing.pack_documents(odd, path).where("start = 0").count() == n
    words, model = pitman_yor.fit(odd)
    scored = pitman_yor.score(odd, words, model, common.remainder("doc_id", 10) == 0)
    assert scored.where("NOT isnan(score) AND score < 0 AND n_known = n_tokens").count() == n
    folder = common.shared_folder(spark, "odd")
    token_files.write_tokens(odd, folder, tokens.tokenizer_path(token_files.VOCABULARY))
    assert token_files.read_tokens(spark, folder).count() == n


def test_every_operator_takes_empty_tables(spark, odd):
    none = odd.where("false")
    labels = labels_of(spark, (1, 1, 0)).where("false")
    items = spark.createDataFrame([], "item_id long, text string")
    assert quality.classify(odd, labels).where("score = 0.5").count() == odd.count()
    assert decontamination.find_leaks(odd, items).count() == 0
    for frame in (compression.judge_texts(none), quality.classify(none, labels),
                  language_id.identify(none, none), simhash.near_duplicates(none),
                  decontamination.find_leaks(none, items), personal_data.find_personal_data(none)):
        assert frame.count() == 0
    words, model = pitman_yor.fit(none)
    held = common.remainder("doc_id", 10) == 0
    assert pitman_yor.score(none, words, model, held).count() == 0
    assert pitman_yor.score(odd, words, model, held).where("score = 0 AND n_known = 0").count() == odd.count()
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filters.filter_urls(pages).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, none, SMALL)
        assert kept.count() == 0 and (name == "packing" or kept.columns == none.columns)


def test_pipeline_stages_keep_columns_and_other_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, odd, SMALL)
        assert kept.columns == odd.columns, name
    assert simhash.keep_one(odd).where("doc_id = 1").count() == 1
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_compression_counts(spark):
    rows = compression.judge_texts(docs_of(
        spark, "a b c\na b c\n\n\n", "x # é", "p q r s t p q r s t u v w x y z", "spam " * 200, PROSE)).collect()
    assert [row.n_dup_lines for row in rows[:2]] == [1, 0]
    assert (rows[1].n_words, rows[1].word_chars, rows[1].n_symbols) == (3, 3, 1)
    assert rows[2].n_repeat_words == 10 and rows[2].base_failed
    assert [row.kept for row in rows[3:]] == [False, True]
    assert compression.repeated_words(b"a a a a a a a".split()) == 7


def test_packing_is_whole(spark):
    texts = [PROSE * k for k in (1, 3, 50, 200, 7, 9)] + ["", None]
    pieces = packing.pack_documents(docs_of(spark, *texts).coalesce(1),
                                    tokens.tokenizer_path(packing.VOCABULARY)).toPandas()
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(tokens.tokenizer_path(packing.VOCABULARY))
    for number, text in enumerate(texts):
        ids = np.array(own.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        mine = pieces[pieces.doc_id == number].sort_values("start")
        assert mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all()
        for piece in mine.itertuples():
            part = ids[piece.start:piece.start + piece.length]
            assert zlib.crc32(part.tobytes()) == piece.ids_crc32
    filled = pieces.groupby("sequence_id").length.sum()
    # Beyond full sequences there is one at most of each power of two: no padding.
    short = sorted(filled[filled < 1024])
    assert filled.max() <= 1024 and len(set(short)) == len(short)
    assert all(size & (size - 1) == 0 for size in short)
    lengths = [int(x) for x in np.random.default_rng(0).integers(1, 3000, 500)]
    pieces = packing.pack(lengths)
    held, room = Counter(), Counter()
    for document, start, length, sequence, offset in pieces:
        assert offset == room[sequence]
        held[document] += length
        room[sequence] += length
    assert [held[d] for d in range(500)] == lengths
    short = [size for size in room.values() if size < 1024]
    assert len(set(short)) == len(short) and all(size & (size - 1) == 0 for size in short)


@pytest.mark.parametrize("name, leads", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_cache_gives_the_tokenizers_ids(name, leads):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(tokens.tokenizer_path(name))
    texts = ["", " ", "a", "A b\nc d", "  two  blanks ", "tab\there", "it's o'clock 12 %%% é ñandú", "\n\nx\n",
             "x <|endoftext|> y", "a\x1cb", "é   z", PROSE]
    found = tokens.WordEncoder(tokens.tokenizer_path(name), leads).encode(texts)
    for text, ids in zip(texts, found):
        expected = np.array(own.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert ids == expected, repr(text)


def test_token_files_round_trip(spark):
    texts = [PROSE, "", None, "ñandú 42", PROSE * 40]
    folder = common.shared_folder(spark, "round-trip")
    path = tokens.tokenizer_path(token_files.VOCABULARY)
    token_files.write_tokens(docs_of(spark, *texts), folder, path)
    rows = token_files.read_tokens(spark, folder).orderBy("doc_id").collect()
    from tokenizers import Tokenizer
    own, start = Tokenizer.from_file(path), 0
    for row, text in zip(rows, texts):
        ids = own.encode(text or "", add_special_tokens=False).ids + [1]
        assert (row.ids, row.start, row.n_tokens) == (ids, start, len(ids))
        start += len(ids)


def test_number_of_token_files_follows_the_texts_size(spark, monkeypatch):
    monkeypatch.setattr(token_files, "INPUT_BYTES", 100)
    folder = common.shared_folder(spark, "many-files")
    documents = docs_of(spark, *["ñandú 42 " * 10] * 40, None)
    token_files.write_tokens(documents, folder, tokens.tokenizer_path(token_files.VOCABULARY))
    rows = token_files.read_tokens(spark, folder).orderBy("start").collect()
    # 40 texts of 110 bytes.
    assert len(rows) == 41 and 8 < len(
        spark.read.parquet(folder).select("block").distinct().collect()) <= 44
    assert [row.start for row in rows] == [
        sum(row.n_tokens for row in rows[:i]) for i in range(len(rows))]


def test_simhash_links_equal_brute_force(spark):
    generator = np.random.default_rng(5)
    values = [int(x) for x in generator.integers(-2 ** 62, 2 ** 62, 300)]
    # A crowd of near values, so that frequent parts are met.
    for _ in range(400):
        flips = generator.choice(64, 3)
        values.append(simhash.signed((values[0] ^ sum(1 << int(b) for b in set(flips))) & (2 ** 64 - 1)))
    values = sorted(set(values))
    pairs = connected_components(simhash.near_pairs(
        spark.createDataFrame([(v,) for v in values], "fp long"))).collect()
    roots = {row.node: row.root for row in pairs}
    expected = {v: v for v in values}

    def find(v):
        while expected[v] != v:
            v = expected[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 2:
                low, high = sorted((find(a), find(b)))
                expected[high] = low
    assert {v: roots.get(v, v) for v in values} == {v: find(v) for v in values}


def test_threshold_allocation_is_the_best():
    costs = [[9.0, 20.0, 40.0], [1.0, 2.0, 3.0], [5.0, 6.0, 70.0]]
    best = min((sum(c[t] if t >= 0 else 0 for c, t in zip(costs, chosen)), list(chosen))
               for chosen in np.ndindex(4, 4, 4) for chosen in [tuple(x - 1 for x in chosen)]
               if sum(chosen) == 0)
    assert simhash.allocate(costs, 0)[0] == best[0]


def test_leaks_equal_brute_force(spark):
    frame, items = common.table(spark, SMALL, "documents"), common.table(spark, SMALL, "benchmark")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontamination.find_leaks(frame, items).collect()}
    words = lambda t: [w for w in re.split("[\x20\x09-\x0D]+", t.lower()) if w]
    texts = [(r.doc_id, words(r.text)) for r in frame.collect()]
    expected = {}
    for item in items.collect():
        own = words(item.text)
        size = min(5, len(own))
        grams = Counter(tuple(own[i:i + size]) for i in range(len(own) - size + 1))
        for doc_id, text in texts:
            held = [tuple(text[i:i + size]) for i in range(len(text) - size + 1)]
            if not grams.keys() & set(held):
                continue
            width = min(sum(grams.values()), len(held))
            best = max(sum((c & grams).values()) / sum((c | grams).values()) for c in (
                Counter(held[i:i + width]) for i in range(len(held) - width + 1)))
            if best >= 0.8:
                expected[doc_id, item.item_id] = best
    assert found == pytest.approx(expected) and expected


STRICT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    found = []
    for place, (kind, pattern) in enumerate(STRICT.items()):
        for match in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", match.group())
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))
                        for i, c in enumerate(reversed(digits)))
            if (kind == "ip" and any(int(x) > 255 for x in match.group().split("."))
                    or kind == "card" and not (12 <= len(digits) <= 19 and total % 10 == 0)
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            found.append((match.start(), place, f"{kind}:{match.start()}:{match.end()}"))
    return ",".join(item[2] for item in sorted(found))


def test_base_spans_equal_the_patterns(spark):
    generator = np.random.default_rng(3)
    parts = ["a@b.c", "_d@e.f", "1.2.3.4", "256.1.1.1", "..", "+1 (555) 123-4567", "4111 1111 1111 1111",
             "4111-1111-1111-1111 2", "é", "😀", "-", " ", "@", ".", "+", "44", "00004.5.6.7",
             personal_data.DOT, "f@g", "(", "9" * 12]
    texts = ["".join(generator.choice(parts, generator.integers(0, 10))) for _ in range(400)]
    texts += [None, "", "1 2 " * 20_000, "a@" + "b." * 20_000 + "c", "1." * 30_000]
    rows = personal_data.find_personal_data(docs_of(spark, *texts)).selectExpr(
        "doc_id", f"{personal_data.joined('base')} AS base", f"{personal_data.joined('spans')} AS spans")
    for row in rows.collect():
        assert row.base == base_spans(texts[row.doc_id])
        assert set(filter(None, row.base.split(","))) <= set(row.spans.split(","))


def test_redaction(spark):
    kept = personal_data.redact(docs_of(spark, "mail a@b.com or +1 (555) 123-4567", None, "clean"))
    kept = kept.orderBy("doc_id").collect()  # rows have no order of their own
    assert [row.text for row in kept] == ["mail <email> or <phone>", None, "clean"]
    assert [row.n_chars for row in kept] == [len("mail <email> or <phone>"), 0, 5]


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r for r in common.table(spark, SMALL, "labels").collect()}
    langs = {r.doc_id: r.lang for r in common.table(spark, SMALL, "documents").collect()}
    rows = [r for r in quality.op2_quality_classifier(spark, SMALL).collect()
            if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id].quality for r in rows]) > 0.85
    rows = [r for r in language_id.op6_language_id(spark, SMALL).collect() if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) > 0.95


@pytest.mark.parametrize("context", ["", "a", "ab", "abr", "abra", "zq"])
def test_kneser_ney_is_a_distribution(context):
    counts = Counter({"abra": 3, "cad": 2, "abc": 1, "bra": 4})
    models = language_id.Models(["x"], [language_id.Language(counts)])
    place = len(context)
    chance = lambda word: np.exp(models.code_logs([word])[0][place, 0])
    letters = sorted(set("".join(counts)))
    # Any letter never seen, times all that the alphabet has beside the seen ones and the end mark.
    rest = chance(context + "Z") * (language_id.ALPHABET - len(letters) - 1)
    assert sum(chance(context + c) for c in letters) + chance(context) + rest == pytest.approx(1, abs=1e-4)


def test_scoring_holds_few_features_at_once():
    import tracemalloc

    import pyarrow as pa

    words = [f"{number * 2654435761 % 10**10:010d}" for number in range(150_000)]
    column = pa.array([" ".join(words[low:low + 300]) for low in range(0, len(words), 300)] + [None, ""])
    score = quality.scorer((np.ones(quality.BUCKETS, dtype=np.float32), 0.0))
    tracemalloc.start()
    scores = score(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(scores) == len(column) and scores[-1] == 0.5 and scores[0] == pytest.approx(1 / (1 + np.exp(-1)))
    assert peak < 140 << 20


def test_base_scores_and_probabilities(spark):
    texts = [PROSE, "a a a b", "zebra " * 3, "", "The CAT", "new words here"]
    frame = docs_of(spark, *texts)
    held = common.remainder("doc_id", 10) == 0
    words, model = pitman_yor.fit(frame.where(~held))
    rows = pitman_yor.score(frame, words, model, held).collect()
    split = {i: [*pitman_yor.tokens_of(t), b""] for i, t in enumerate(texts)}
    counts = Counter()
    for i, own in split.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(own)
    total, kinds = sum(counts.values()), len(counts)
    for row in rows:
        own = split[row.doc_id]
        base = sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own)
        assert row.base_score == pytest.approx(base) and row.n_known == sum(counts[w] > 0 for w in own)
        assert row.train_tokens == total and row.score < 0
    assert sum(row.p for row in words.collect()) + model["unknown"] == pytest.approx(1.0)


def test_spelling_seats_all_cells_at_any_size(spark, monkeypatch):
    """Which cells are broadcast and which are joined, and how many a task takes, decides nothing."""
    words = [f"{a}{b}{c}" for a in ("re", "th", "on") for b in ("in", "er", "o", "é") for c in ("ly", "s", "")]
    frame = docs_of(spark, " ".join(words))
    found = {row.word: row.p for row in pitman_yor.fit(frame)[0].collect()}
    assert len(found) == len(set(words)) + 1
    monkeypatch.setattr(pitman_yor, "SPELL_SHARE", 16)
    joined = {row.word: row.p for row in pitman_yor.fit(frame)[0].collect()}
    assert joined == pytest.approx(found, rel=1e-9)


def test_groups_of_restaurants_are_seated_whole(spark, monkeypatch):
    words = spark.createDataFrame([(b"abracadabra", 3), (b"cadabra", 2), (b"bracket", 1)],
                                  "word binary, t long")
    cells = pitman_yor.spelling_counts(words)
    monkeypatch.setattr(pitman_yor, "SEATED_CELLS", 1)
    monkeypatch.setattr(pitman_yor, "SPELL_SHARE", 1)
    (grams, logs), rare = pitman_yor.seat_spelling(cells.coalesce(1), 0)
    chances = {**dict(zip(grams.tolist(), np.exp(logs))), **{r.gram: np.exp(r.log) for r in rare.collect()}}
    counted = {row.gram: row.level for row in cells.collect()}
    assert set(chances) == {gram for gram, level in counted.items() if level > 1}
    totals = Counter()
    for gram, chance in chances.items():
        totals[counted[gram], gram >> 9] += chance
    assert all(0 < total < 1 for total in totals.values())


def test_unknown_words_are_spelled(spark):
    train = docs_of(spark, PROSE, "there they then the other", "hither thither", "")
    words, model = pitman_yor.fit(train)
    texts = ["the other", "thethere", "qx\u00e9zk", "the qx\u00e9zk other thethere qx\u00e9zk", "z" * 20_000, ""]
    rows = pitman_yor.score(docs_of(spark, *texts), words, model, common.remainder("doc_id", 10) == 0)
    found = {row.doc_id: row for row in rows.collect()}
    extra = {i: row.score - row.closed_score for i, row in found.items()}
    assert len(found) == len(texts) and extra[0] == pytest.approx(0) == extra[5]
    assert [row.n_known for _, row in sorted(found.items())] == [3, 1, 1, 3, 1, 1]
    assert extra[2] < extra[1] < 0 and found[1].closed_score == pytest.approx(found[2].closed_score)
    assert extra[3] == pytest.approx(extra[1] + 2 * extra[2])
    assert np.isfinite(extra[4]) and extra[4] < -5_000


def test_unseen_symbols_are_left_to_shorter_contexts(spark):
    """After contexts with and without restaurants all outcomes add up to 1, and cells stay as they are."""
    words = spark.createDataFrame([(b"abracadabra", 3), (b"cadabra", 2), (b"bracket", 1)],
                                  "word binary, t long")
    upper, seated, limit = pitman_yor.seat_orders(pitman_yor.spelling_counts(words), 0)
    (grams, logs), rare = pitman_yor.cell_logs(upper, seated, limit)
    cells = {**dict(zip(grams.tolist(), logs)), **{row.gram: row.log for row in rare.collect()}}
    start, end = pitman_yor.START_SYMBOL, pitman_yor.END_SYMBOL
    keys = {}
    for context in ([start], [start, *b"b"], [start, *b"zq"], b"dabr", b"zabr", b"xxbr", b"qqqq"):
        packed = 0
        for symbol in context:
            packed = packed << 9 | (symbol if symbol == start else symbol + 1)
        keys.update({packed << 9 | symbol: packed for symbol in range(1, end + 1)})
    frame = spark.createDataFrame([(key,) for key in keys], "key long")
    found = {row.key: row.log_0 for row in pitman_yor.gram_logs(frame, [(upper, seated, 1.0)]).collect()}
    totals = Counter()
    for key, packed in keys.items():
        totals[packed] += np.exp(found[key])
    assert len(totals) == 7 and all(total == pytest.approx(1.0) for total in totals.values())
    common_keys = set(cells) & set(found)
    assert common_keys and all(found[key] == pytest.approx(cells[key]) for key in common_keys)


def test_tables_follow_their_distribution():
    generator = np.random.default_rng(1)
    customers = np.full(4000, 40)
    tables = pitman_yor.sample_tables(customers, 0.5, np.full(4000, 2.0), generator)
    expected = []
    for _ in range(2000):
        held = 1
        for seated in range(1, 40):
            held += generator.random() < 2.0 / (seated - 0.5 * held + 2.0)
        expected.append(held)
    assert abs(tables.mean() - np.mean(expected)) < 0.25


def test_url_rules(spark):
    urls = ["http://Shop.Example.com/en/1?x=/fr/", "https://www.example.com/en/2", "http://a.net/es/#q",
            "ftp://example.org/fr/3", "no scheme", None, "http://xcom/", "http://b.net", "http://c.com"]
    rows = url_filters.filter_urls(spark.createDataFrame(
        list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [row.host for row in rows][:3] == ["shop.example.com", "www.example.com", "a.net"]
    assert [row.rule for row in rows] == [
        "example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None, None, None]
    assert [row.verdict for row in rows][:3] == ["block", "allow", "block"]
    assert rows[4].host == rows[4].path == rows[5].host == "" and rows[0].path == "/en/1"


def test_mined_rules_decide(spark):
    rows = [(i, f"http://h{i}.example.net/{'es' if i % 2 else 'en'}/{i}") for i in range(60)]
    rows += [(100 + i, f"http://h{i}.example.org/{'es' if i % 2 else 'de'}/{i}") for i in range(20)]
    rows += [(200 + i, f"http://h{i}.site.com/de/{i}") for i in range(60)]
    found = url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {row.verdict for row in found if row.host.endswith("org") and row.path.startswith("/es")} == {"block"}
    assert {row.verdict for row in found if row.host.endswith("org") and row.path.startswith("/de")} == {"allow"}


def test_queries_are_registered():
    assert {name.split("_")[0] for name in registry.QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}


def test_quality_training_features_are_not_held_in_memory():
    from sentryspark.llm.quality import stored_features, text_features

    rows = [("some words of a text, some more", 1), ("", 0), (None, 1), ("other words", 0)]
    for (text, label), (buckets, shares, stored_label) in zip(rows, stored_features(rows), strict=True):
        wanted = text_features((text or "").encode().split())
        assert buckets.tolist() == wanted[0].tolist() and stored_label == label
        assert shares.tolist() == wanted[1].astype(np.float32).tolist()
        assert not text or (isinstance(buckets, np.memmap) and isinstance(shares, np.memmap))
    assert stored_features([]) == []
    (empty, _, _), = stored_features([("", 1)])
    assert not len(empty)
