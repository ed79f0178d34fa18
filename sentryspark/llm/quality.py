"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its features: words, character n-grams of the words,
and pairs of neighbouring words (a pair of equal words is a feature of its own), all hashed into
one table of vectors. A softmax layer gives the classes. Vectors and layer are trained together by
stochastic gradient descent on a bounded sample of labelled rows. As the layer is linear, each
vector folds into one number for scoring, and a word's numbers are summed once per worker.

A null or empty text has no features and gets the score of the bias alone. A null label, or rows
without one, take no part in training; without any labelled row all scores are 0.5. A repeated
doc_id in ``labels`` counts once, with its smallest label. Equal hashes of ids are ordered by id and
text. An empty table gives no row. A long text is one array of its words in one task. Other columns are
ignored by ``classify`` and kept by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentryspark.llm.common import map_texts, query, remainder, table
from sentryspark.llm.tokens import slices
from sentryspark.llm.word_rows import WordRows, mix, ngram_hashes, sums_by_text

# Parameters of the sample: labelled rows, and characters of all their texts together. Texts of any
# length take part, whole; the sample ends with the row before the one that passes either bound.
TRAIN_ROWS = 2500
TRAIN_CHARACTERS = 8_000_000
# Parameters of the model.
BUCKETS, WIDTH = 1 << 18, 8
NGRAMS = (3, 4, 5)
EPOCHS, RATE = 6, 0.6
# Parameters of a scoring worker's memory: texts taken out of a batch at once, characters scored at once,
# new words whose features are held at once, words kept.
SCORED_TEXTS, SCORED_CHARACTERS, NEW_WORDS, WORDS_KEPT = 500, 1_000_000, 20_000, 250_000
_BUCKET_BITS = np.uint64(64 - 18)
_EQUAL = np.uint64(7)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> _BUCKET_BITS).astype(np.int64)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, bucket) of the words and their n-grams, and a hash per word."""
    marked = b"".join([b"\x01" + word + b"\x02" for word in words])
    codes = np.frombuffer(marked, dtype=np.uint8)
    sizes = np.array([len(word) + 2 for word in words])
    ends = np.cumsum(sizes)
    number = np.repeat(np.arange(len(words)), sizes)
    inside = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    levels = ngram_hashes(codes, max(NGRAMS))
    # A word's own hash sums position-dependent hashes of all its bytes.
    placed = mix(codes.astype(np.uint64) + (inside.astype(np.uint64) << np.uint64(8)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(placed, dtype=np.uint64)])
    whole = mix(total[ends] - total[ends - sizes])
    owners, found = [np.arange(len(words))], [bucket(whole)]
    for n in NGRAMS:
        fits = inside >= n - 1
        owners.append(number[fits])
        found.append(bucket(levels[n - 1][fits]))
    return np.concatenate(owners), np.concatenate(found), whole


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, given the words' hashes in order."""
    first, second = hashes[:-1], hashes[1:]
    joined = mix(first * np.uint64(3) + second)
    joined[first == second] = _EQUAL
    return bucket(joined)


def text_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    _, found, hashes = word_features(words)
    buckets, counts = np.unique(
        np.concatenate([found, pair_buckets(hashes)]), return_counts=True)
    return buckets, counts / counts.sum()


def stored_features(rows: list[tuple[str, int]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(buckets, shares, label) of each text; the arrays are parts of a mapped temporary file.

    They are several times as large as the texts, and are read once per epoch.
    """
    sizes, labels = [], []
    with tempfile.TemporaryFile() as held:
        for text, label in rows:
            buckets, shares = text_features((text or "").encode().split())
            held.write(buckets.astype(np.int32).tobytes())
            held.write(shares.astype(np.float32).tobytes())
            sizes.append(len(buckets))
            labels.append(label)
        held.flush()
        values = np.memmap(held, np.int32, "r") if sum(sizes) else np.zeros(0, np.int32)
    ends = 2 * np.cumsum(sizes, dtype=np.int64)
    return [(values[end - 2 * size:end - size], values[end - size:end].view(np.float32), label)
            for end, size, label in zip(ends, sizes, labels)]


def train(rows: list[tuple[str, int]], seed: int = 1) -> tuple[np.ndarray, float]:
    """(number per bucket, bias): log-odds of label 1 are the mean of the numbers plus the bias."""
    generator = np.random.default_rng(seed)
    vectors = generator.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, 2)), np.zeros(2)
    samples = stored_features(rows)
    steps, step = EPOCHS * len(samples), 0
    for _ in range(EPOCHS):
        for number in generator.permutation(len(samples)):
            buckets, shares, label = samples[number]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = shares @ vectors[buckets] if len(buckets) else np.zeros(WIDTH)
            scores = hidden @ layer + bias
            odds = np.exp(scores - scores.max())
            error = odds / odds.sum()
            error[label] -= 1
            back = layer @ error
            layer -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            # A text's vectors move together with its mean, as they share the gradient.
            if len(buckets):
                vectors[buckets] -= (rate * np.outer(shares * len(shares), back)).astype(np.float32)
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def training_sample(documents: DataFrame, labels: DataFrame, label: str) -> list[tuple[str, int]]:
    """Labelled texts in the order of their id hashes, up to TRAIN_ROWS and TRAIN_CHARACTERS."""
    marked = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("label"))
    usable = documents.select(
        "doc_id", "text", F.xxhash64("doc_id").alias("order"), F.xxhash64("text").alias("print"),
        F.coalesce(F.length("text"), F.lit(0)).alias("size")).where("text IS NOT NULL")
    # The bound is found on hashes and lengths alone, so that only texts of the sample are moved.
    order = ["order", "doc_id", "print"]
    first = usable.select(*order, "size").join(marked, "doc_id").orderBy(*order).limit(TRAIN_ROWS)
    sizes = [row.size for row in first.select("size", *order).orderBy(*order).collect()]
    kept = max(int(np.searchsorted(np.cumsum(sizes), TRAIN_CHARACTERS, side="right")), 1)
    ends = first.orderBy(*order).limit(kept).agg(F.max("order")).head()[0]
    rows = (
        usable.where(F.col("order") <= F.lit(ends)).join(marked, "doc_id").orderBy(*order).limit(kept)
    )
    return [(row.text, row.label) for row in rows.select("text", "label").collect()]


def scorer(model: tuple[np.ndarray, float]):
    """A function that scores texts; it keeps what it worked out for their words."""
    numbers, bias = model

    def compute(words: list[bytes]) -> np.ndarray:
        rows = np.zeros(len(words), dtype=[("sum", "f8"), ("count", "f8"), ("hash", "u8")])
        for low in range(0, len(words), NEW_WORDS):
            part, own = words[low:low + NEW_WORDS], rows[low:low + NEW_WORDS]
            owners, found, own["hash"] = word_features(part)
            own["sum"] = np.bincount(owners, numbers[found], len(part))
            own["count"] = np.bincount(owners, minlength=len(part))
        return rows

    known = WordRows(compute, WORDS_KEPT)

    def score(column: pa.Array) -> np.ndarray:
        parts = [column.slice(low, SCORED_TEXTS) for low in range(0, len(column), SCORED_TEXTS)]
        return np.concatenate([score_part(part.to_pylist()) for part in parts])

    def score_part(texts: list[str | None]) -> np.ndarray:
        texts = [text or "" for text in texts]
        scores = [np.zeros(0)]
        for low, high in slices(texts, SCORED_CHARACTERS):
            split = [text.encode().split() for text in texts[low:high]]
            sizes = [len(words) for words in split]
            flat = [word for words in split for word in words]
            places = known.look(flat)
            rows = known.rows[places]
            sums, counts = rows["sum"].copy(), rows["count"].copy()
            if len(flat) > 1:
                pairs = numbers[pair_buckets(rows["hash"])].astype(np.float64)
                inner = np.ones(len(flat) - 1, dtype=bool)
                ends = np.cumsum(sizes)
                inner[ends[(ends > 0) & (ends < len(flat))] - 1] = False
                sums[1:] += np.where(inner, pairs, 0.0)
                counts[1:] += inner
            total = sums_by_text(np.stack([sums, counts], axis=1), sizes)
            mean = total[:, 0] / np.maximum(total[:, 1], 1)
            scores.append(1 / (1 + np.exp(-np.clip(mean + bias, -500, 500))))
        return np.concatenate(scores)

    return score


def score_texts(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score): the probability of label 1 of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        score = scorer(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(score(batch.column(1)))],
                ["doc_id", "score"])

        return step

    return map_texts(documents, ["doc_id", "text"], "doc_id long, score double", make)


def keep_good(documents: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The rows, with all their columns, whose text scores 0.5 or more."""
    model = train(training_sample(documents, labels, label))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value)
        for batch in batches:
            if batch.num_rows:
                rows = pa.RecordBatch.from_arrays(batch.columns, names)
                yield rows.filter(pa.array(score(batch.column(text)) >= 0.5))

    # Columns go by their places, as a name may hold a point.
    placed = documents.toDF(*[f"column_{place}" for place in range(len(names))])
    return placed.mapInArrow(run, documents.schema)


def classify(
    documents: DataFrame, labels: DataFrame, label: str = "quality", training: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, score, predicted) of every document; trained on the labelled rows of ``training``."""
    model = train(training_sample(documents if training is None else training, labels, label))
    return score_texts(documents, model).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 3) == 1
    found = classify(documents, table(spark, sf_dir, "labels"),
                     training=documents.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")
