"""Base columns against plain Python, clashing names, growth of models, and what the methods add."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from sentryspark.llm import (
    common, compression, decontamination, language_id, personal_data, quality, simhash, token_files,
    tokens, url_filters,
)

SMALL = "/root/testdata/sf0.001"
WORD = "[^\x20\x09-\x0D]+"


def test_url_columns_equal_brute_force(spark):
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block",
             "net/fr/": "block"}
    pages = common.table(spark, SMALL, "pages")
    odd = spark.createDataFrame([(9001, None, ""), (9002, "x", ""), (9003, "HTTP://A.NET/ES/", ""), (9004, "s://net/es/?", ""),
                                 (9005, "://xnet/es/", ""), (9006, "a://b://com", "")], pages.schema)
    pages = pages.union(odd).union(odd)
    found = sorted(tuple(r[:4]) for r in url_filters.filter_urls(pages).collect())
    expected = []
    for page in pages.collect():
        host = path = ""
        if page.url and "://" in page.url:
            rest = page.url.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host):])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
                and path.startswith(r[r.index("/"):])]
        expected.append((page.page_id, host, path, max(fits, key=len, default=None)))
    assert [str(row) for row in found] == [str(row) for row in sorted(expected, key=lambda r: (r[0], r[1]))]


@pytest.mark.parametrize("segments", [8, 12])
def test_deep_paths_do_not_multiply_rules(spark, segments):
    deep = "/".join(f"s{i}" for i in range(segments))
    rows = [(n, f"https://a{n % 3}.com/{deep}/x{n}") for n in range(40)]
    rows += [(100 + n, f"https://b.net/es/{deep}/y{n}") for n in range(40)]
    marked = url_filters.with_rule(spark.createDataFrame(rows, "page_id long, url string"))
    rules = url_filters.mine_rules(marked.where("rule IS NOT NULL").withColumn("label", F.col("rule_verdict")))
    assert 0 < rules.count() < 200


def test_url_ties_and_mixed_tokens(spark):
    # "p" is undecided alone, "p" with "q" decides; a longer rule that adds nothing is dropped.
    rows = [("block", ["p", "q"])] * 20 + [("allow", ["p", "r"])] * 20 + [("allow", ["q", "r"])] * 20
    baskets = spark.createDataFrame([(f"u{n}", *row) for n, row in enumerate(rows)], "url string, label string, own array<string>")
    counted = url_filters.token_counts(baskets).collect()
    assert {(r.token, r.n, r.blocked) for r in counted} == {("p", 40, 20), ("q", 40, 20), ("r", 40, 0)}
    share = F.greatest(F.col("blocked") / F.col("n"), 1 - F.col("blocked") / F.col("n"))
    items = url_filters.token_counts(baskets).where("token <> 'r'").select(
        F.col("token").alias("item"), F.array("token").alias("members"), share.alias("confidence"))
    found = url_filters.combinations_of(baskets, items, 60).collect()
    assert ("block", ("p", "q")) in {(r.verdict, tuple(r.tokens)) for r in found}
    longer = spark.createDataFrame(
        [(["a"], "allow", 0.95, 0.5), (["a", "b"], "allow", 0.95, 0.4), (["a", "c"], "allow", 0.99, 0.2),
         (["a", "b"], "block", 0.95, 0.1)], url_filters.RULE_SHAPE)
    kept = {(tuple(r.tokens), r.verdict) for r in url_filters.without_longer(longer).collect()}
    assert kept == {(("a",), "allow"), (("a", "c"), "allow"), (("a", "b"), "block")}


def test_url_of_many_undecided_tokens_leaves_none_out(spark):
    # "a" and "b" decide together; nine other tokens of the same urls tell more alone.
    rows = [("block", ["a", "b"])] * 20 + [("allow", ["a"])] * 20 + [("allow", ["b"])] * 20
    rows = [(f"u{n}", label, own + [f"z{k}" for k in range(9) if n < 20 or n >= 20 + k])
            for n, (label, own) in enumerate(rows)]
    baskets = spark.createDataFrame(rows, "url string, label string, own array<string>")
    share = F.greatest(F.col("blocked") / F.col("n"), 1 - F.col("blocked") / F.col("n"))
    items = url_filters.token_counts(baskets).select(
        F.col("token").alias("item"), F.array("token").alias("members"), share.alias("confidence"))
    found = url_filters.combinations_of(baskets, items, 60).collect()
    assert ("block", ("a", "b"), 1.0, 20 / 60) in {
        (r.verdict, tuple(r.tokens), r.confidence, r.support) for r in found}


def test_quality_columns_equal_brute_force(spark):
    documents = common.table(spark, SMALL, "documents")
    found = {r.doc_id: r for r in compression.judge_texts(documents).collect()}
    for row in documents.collect():
        text = row.text or ""
        words = re.findall(WORD, text)
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        seen = Counter(windows)
        repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
        lines = [line for line in text.split("\n") if re.search(WORD, line)]
        base = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
                len(lines) - len(set(lines)), len(repeated))
        mine = found[row.doc_id]
        assert tuple(mine[1:6]) == base
        assert mine.base_failed == (len(words) < 10 or 100 * len(repeated) > 20 * len(words))
        assert not (mine.kept and mine.base_failed)


def fingerprint_of(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(WORD, lowered)
    if not words:
        return "0" * 16
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + size]).encode(), 42) for i in range(len(words) - size + 1)]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return f"{bits:016x}"


def test_fingerprints_equal_brute_force(spark):
    documents = common.table(spark, SMALL, "documents")
    texts = {r.doc_id: r.text for r in documents.collect()}
    found = simhash.near_duplicates(documents).collect()
    assert {r.doc_id: r.fingerprint for r in found} == {i: fingerprint_of(t) for i, t in texts.items()}


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with a column of every name that the stages use inside."""
    documents = common.table(spark, SMALL, "documents").limit(60)
    names = ["row", "item", "__row", "__x", "leak_id", "leak_hash", "text_hash", "fp", "base", "loose", "spans",
             "masked", "print", "order", "size", "label", "bound", "epoch", "a.b"]
    return documents.select("*", *[F.lit(7).alias(name) for name in names])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:4])
def test_stages_keep_clashing_columns(spark, clashing, name, stage):
    kept = stage(spark, clashing, SMALL)
    assert kept.columns == clashing.columns
    plain = stage(spark, clashing.select("doc_id", "text", "lang", "source", "n_chars"), SMALL)
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, plain.select("doc_id", "text").collect()))
    extra = kept.columns[5:]
    assert kept.where(" OR ".join(f"`{name}` <> 7" for name in extra)).count() == 0


def test_pipeline_rows_follow_their_stages(spark):
    documents, labels = common.table(spark, SMALL, "documents"), common.table(spark, SMALL, "labels")
    kept = {r.doc_id for r in quality.classify(documents, labels).where("predicted = 1").collect()}
    rest = documents.where(F.col("doc_id").isin(list(kept)))
    groups = simhash.near_duplicates(rest).collect()
    kinds = {r.component_id for r in groups}
    leaks = {r.doc_id for r in decontamination.find_leaks(rest, common.table(spark, SMALL, "benchmark")).collect()}
    pieces = corpus_pipeline.run(spark, SMALL).toPandas()
    found = set(pieces.doc_id)
    assert found <= kept and not found & leaks
    # One document of each group whose documents hold no item.
    of = {r.doc_id: r.component_id for r in groups}
    assert len({of[i] for i in found}) == len(found)
    assert {of[i] for i in found} >= {k for k in kinds if not any(of[i] == k for i in leaks)}
    whole = pieces.groupby("doc_id").length.sum()
    assert (whole == pieces.groupby("doc_id").doc_tokens.max()).all()


def test_index_recall_of_changed_windows(spark):
    generator = np.random.default_rng(5)
    items = [" ".join(f"w{generator.integers(3000)}" for _ in range(120)) for _ in range(60)]
    texts = []
    for item in items:
        for changes in (0, 1, 2):
            words = item.split()
            for at in generator.integers(len(words), size=changes):
                words[at] = f"x{generator.integers(9999)}"
            around = [f"v{generator.integers(9999)}" for _ in range(60)]
            texts.append((len(texts), " ".join([*around, *words, *around])))
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(documents, benchmark).collect()}
    expected = set()
    for doc_id, text in texts:
        words, own = text.split(), items[doc_id // 3].split()
        grams = Counter(tuple(own[i:i + 5]) for i in range(116))
        best = 0.0
        for start in range(len(words) - 119):
            held = Counter(tuple(words[start + i:start + i + 5]) for i in range(116))
            best = max(best, (grams & held).total() / (grams | held).total())
        if best >= 0.8:
            expected.add((doc_id, doc_id // 3))
    assert found <= expected and len(expected) >= 100
    assert len(found) >= 0.9 * len(expected)


def test_thresholds_cover_the_radius():
    for radius in range(0, 24):
        limits = decontamination.thresholds(radius)
        # Differences beyond every threshold add up to more than the radius.
        assert sum(limit + 1 for limit in limits) > radius


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    rows = [(n, f"wort{n} text", f"l{n % 3}" if n < 90 else f"rare{n}") for n in range(150)]
    sample = language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {name for _, name in sample} == {"l0", "l1", "l2"} and len(sample) == 90


def test_long_texts_train(spark, monkeypatch):
    long = "good " * 30_000
    documents = spark.createDataFrame([(1, long, "en"), (2, "bad text", "en"), (3, None, "en")],
                                      "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert {len(text) for text, _ in quality.training_sample(documents, labels, "quality")} == {len(long), 8}
    assert {len(text) for text, _ in language_id.training_sample(documents)} == {len(long), 8}
    monkeypatch.setattr(quality, "TRAIN_CHARACTERS", 10)
    assert len(quality.training_sample(documents, labels, "quality")) == 1


ODD = ["", "a b", " a", "a ", "a\n\nb", "\n", "a\nb\n", "x\tb c", "d\xa0e f", "it's 12 3.4, don't", "<|endoftext|> a b",
       "a <|endoftext|>", "É é  ç", "日本 語\n한국", "\r\nfoo", "a\rb \rc", "İstanbul ß STRASSE ŉ", "x, y. (z) we'll 's a,'s",
       "ﬁ ﬂ", "Ŀ l· x.· ·x", "x,́ y", "a,b a.b.c 1,000", "ÀÉ, Çà! ñandú? œuvre Ĳ", "　 x", "\x01 \x00 a\x01b", "¡hola! «x»"]


@pytest.mark.parametrize("name, leads", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_odd_words_have_the_tokenizers_ids(name, leads, monkeypatch):
    own = tokens.WordEncoder(tokens.tokenizer_path(name), leads)
    for _ in range(2):
        assert own.encode(ODD) == own._ids(ODD)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    for text in ODD:
        assert own.encode([text, "again and again"]) == own._ids([text, "again and again"])


def test_token_files_are_encoded_and_indexed(spark):
    import glob

    folder = common.shared_folder(spark, "encodings")
    token_files.write_tokens(common.table(spark, SMALL, "documents"), folder, tokens.tokenizer_path(token_files.VOCABULARY))
    seen = 0
    for path in glob.glob(f"{folder}/*.parquet"):
        data = pq.ParquetFile(path).metadata
        for group in range(data.num_row_groups):
            columns = {c.path_in_schema: c for c in (data.row_group(group).column(i) for i in range(data.num_columns))}
            assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
            assert all(c.has_offset_index and c.has_column_index for c in columns.values() if c.path_in_schema != "ids.list.element")
            seen += 1
    assert seen
    one = token_files.read_tokens(spark, folder).where("doc_id = 7").select("doc_id", "n_tokens")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan.split("PushedFilters")[1] and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_loose_spans_are_judged(spark):
    """Votes agree on which loose candidates are personal data; the classifier follows them."""
    good = [f"call me on the phone: (555) 234-{1000 + n}, phone 415-555-{2000 + n}" for n in range(40)]
    bad = [f"order no. 100-200-{3000 + n} version id 100-300-{4000 + n}" for n in range(40)]
    strict = [f"phone +1 (555) 123-{4000 + n}" for n in range(40)]
    rows = spark.createDataFrame(list(enumerate(good + bad + strict)), "doc_id long, text string")
    found = {r.doc_id: r for r in personal_data.find_personal_data(rows).collect()}
    added = lambda i: len(found[i].spans) - len(found[i].base)
    assert all(found[i].base == [] or found[i].base == "" for i in range(80))
    assert sum(added(i) > 0 for i in range(40)) >= 36
    assert sum(added(40 + i) > 0 for i in range(40)) <= 4


def test_operators_ignore_clashing_columns(spark, clashing):
    from sentryspark.llm import lexical_search, mixing, packing, pitman_yor, resampling

    items, labels = common.table(spark, SMALL, "benchmark"), common.table(spark, SMALL, "labels")
    plain = clashing.select("doc_id", "text", "lang", "source")
    path = tokens.tokenizer_path(packing.VOCABULARY)
    calls = [
        compression.judge_texts, lambda d: quality.classify(d, labels), lambda d: language_id.identify(d, d),
        simhash.near_duplicates, lambda d: decontamination.find_leaks(d, items), personal_data.find_personal_data,
        lambda d: packing.pack_documents(d.coalesce(1), path), lambda d: resampling.resample(d, items),
        lambda d: lexical_search.search(d, items, 5), mixing.mix,
    ]
    for call in calls:
        assert sorted(map(str, call(clashing).collect())) == sorted(map(str, call(plain).collect()))
    words, model = pitman_yor.fit(clashing)
    held = common.remainder("doc_id", 10) == 0
    assert pitman_yor.score(clashing, words, model, held).count() == clashing.count()
    pages = spark.createDataFrame([(1, "http://a.net/es/", 5, 5)] * 3 + [(2, None, 5, 5)],
                                  "page_id long, url string, host int, token int")
    assert sorted(r.verdict for r in url_filters.filter_urls(pages).collect()) == ["allow", "block", "block", "block"]


def test_upper_case_spellings_are_found(spark):
    rows = spark.createDataFrame([(n, "mail to john (AT) example.com now") for n in range(30)], "doc_id long, text string")
    loose = personal_data.with_spans(rows).select(F.size("loose").alias("n")).collect()
    assert {r.n for r in loose} == {1}
