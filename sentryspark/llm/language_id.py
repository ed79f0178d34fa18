"""Language identification by interpolated Kneser-Ney character models.

Each language has a character model of order 5 over its words (with a start and an end mark); the
n-gram counts below the highest order are continuation counts. All models lie in sorted arrays of
n-gram hashes with one column per language. A text gets the language of the lowest cross-entropy
per character. The score is a softmax of the entropies; its scale, and the entropy from which a text
counts as rejected, are set on the part of the sample that took no part in counting.

Null texts and texts without a letter are ``und`` with score 0. Ties go to the language that sorts
first. Without any labelled row all texts are ``und``. A null lang takes no part in training; texts
are lower-cased. Repeated rows are judged alike. An empty table gives no row. A long text is one list
of its words in one task. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentryspark.llm.common import map_texts, query, remainder, table
from sentryspark.llm.tokens import slices
from sentryspark.llm.word_rows import WordRows, ngram_hashes, sums_by_text

# Parameters of the sample: languages (those of the most rows), rows and characters per language, and
# the share (one in so many rows) kept for calibration. Texts of any length take part, whole; a
# language's sample ends with the row before the one that passes either bound.
LANGUAGES = 200
TRAIN_ROWS = 600
TRAIN_CHARACTERS = 6_000_000
CALIBRATION = 5
# Parameters of the model: order, discount per order is estimated, letters that share the rest.
ORDER = 5
ALPHABET = 65_536
# Texts of this share of calibration rows and more (per language) are accepted.
ACCEPTED = 0.995
UNDETERMINED = "und"
START, END = 0x110000, 0x110001


def laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words with their marks, place in the word, and word number."""
    sizes = np.array([len(word) + 2 for word in words])
    raw = "".join(words).encode("utf-32-le", "surrogatepass")
    codes = np.empty(int(sizes.sum()), dtype=np.uint64)
    ends = np.cumsum(sizes)
    marks = np.zeros(len(codes), dtype=bool)
    codes[ends - sizes], codes[ends - 1] = START, END
    marks[ends - sizes] = marks[ends - 1] = True
    codes[~marks] = np.frombuffer(raw, dtype="<u4")
    number = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    return codes, place, number


class Language:
    """Tables of one language: per order, sorted n-gram hashes with their log probability, and
    sorted context hashes with the log weight that goes to the shorter context."""

    def __init__(self, counts: Counter, order: int = ORDER):
        words = list(counts)
        codes, place, number = laid_out(words)
        weight = np.array([counts[word] for word in words], dtype=np.float64)[number]
        levels = ngram_hashes(codes, order)
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.rests: list[tuple[np.ndarray, np.ndarray]] = []
        found = []
        for n in range(1, order + 1):
            at = np.flatnonzero(place >= max(1, n - 1))
            unique, first, inverse = np.unique(
                levels[n - 1][at], return_index=True, return_inverse=True)
            found.append([unique, at[first], np.bincount(inverse, weight[at])])
        # Below the highest order, count the different codes that come before.
        for n in range(1, order):
            longer_at = found[n][1]
            keys, counted = np.unique(levels[n - 1][longer_at], return_counts=True)
            own = found[n - 1]
            where = np.searchsorted(keys, own[0])
            where[where == len(keys)] = 0
            # N-grams right after the start mark have nothing before them and keep their count.
            own[2] = np.where(keys[where] == own[0], counted[where], own[2])
        lower = None
        for n in range(1, order + 1):
            unique, at, count = found[n - 1]
            context = levels[n - 2][at - 1] if n > 1 else np.zeros(len(at), dtype=np.uint64)
            heads, inverse = np.unique(context, return_inverse=True)
            total = np.bincount(inverse, count)
            kinds = np.bincount(inverse)
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = once / (once + 2 * twice) if once else 0.5
            discount = min(max(discount, 0.1), 0.9)
            rest = discount * kinds / total
            if n == 1:
                below = np.full(len(at), 1.0 / ALPHABET)
            else:
                below = np.exp(lower[1][np.searchsorted(lower[0], levels[n - 2][at])])
            share = np.maximum(count - discount, 0) / total[inverse] + rest[inverse] * below
            lower = (unique, np.log(share))
            self.grams.append(lower)
            self.rests.append((heads, np.log(rest)))


class Models:
    """The languages' tables in one: a column per language, NaN where it lacks a hash."""

    def __init__(self, names: list[str], languages: list[Language]):
        if not languages:
            return
        self.names = names
        self.grams = [self._merge([x.grams[n] for x in languages]) for n in range(ORDER)]
        self.rests = [self._merge([x.rests[n] for x in languages]) for n in range(ORDER)]
        self.scale, self.limits = 1.0, np.full(len(names), np.inf)

    @staticmethod
    def _merge(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([hashes for hashes, _ in tables]))
        values = np.full((len(keys) + 1, len(tables)), np.nan, dtype=np.float32)
        for column, (hashes, logs) in enumerate(tables):
            values[np.searchsorted(keys, hashes), column] = logs
        return keys, values

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
        keys, values = table
        where = np.searchsorted(keys, hashes)
        where[where == len(keys)] = 0
        # The last row of values stands for hashes that no language has.
        return values[np.where(keys[where] == hashes, where, len(keys))]

    def word_logs(self, words: list[str]) -> np.ndarray:
        """A row per word: its log probability in each language, and the codes it predicts."""
        out = np.zeros((len(words), len(self.names) + 1))
        for start in range(0, len(words), 50_000):
            part = words[start:start + 50_000]
            logs, number = self.code_logs(part)
            for column in range(len(self.names)):
                out[start:start + len(part), column] = np.bincount(number, logs[:, column], len(part))
            out[start:start + len(part), -1] = np.bincount(number, minlength=len(part))
        return out

    def code_logs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of every code but the start marks in each language, and its word's number."""
        codes, place, number = laid_out(words)
        levels = ngram_hashes(codes, ORDER)
        at = np.flatnonzero(place >= 1)
        unseen = self.rests[0][1][0] - np.log(ALPHABET)
        found = self._find(self.grams[0], levels[0][at])
        logs = np.where(np.isnan(found), unseen, found)
        for n in range(2, ORDER + 1):
            rows = np.flatnonzero(place[at] >= n - 1)
            here = at[rows]
            rest = self._find(self.rests[n - 1], levels[n - 2][here - 1])
            seen = self._find(self.grams[n - 1], levels[n - 1][here])
            backed = logs[rows] + np.where(np.isnan(rest), 0.0, rest)
            logs[rows] = np.where(np.isnan(seen), backed, seen)
        return logs, number[at]

    @classmethod
    def of(cls, state: dict) -> "Models":
        """Models from the plain arrays of another's ``vars``."""
        models = cls([], [])
        vars(models).update(state)
        return models

    def entropies(self, totals: np.ndarray) -> np.ndarray:
        return -totals[:, :-1] / np.maximum(totals[:, -1:], 1)

    def judge(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score, and whether it is rejected, per text."""
        entropy = self.entropies(totals)
        best = entropy.argmin(axis=1)
        odds = np.exp(-self.scale * (entropy - entropy.min(axis=1, keepdims=True)))
        rejected = entropy[np.arange(len(best)), best] > self.limits[best]
        return best, 1 / odds.sum(axis=1), rejected

    def calibrate(self, totals: np.ndarray, truth: np.ndarray) -> None:
        entropy = self.entropies(totals)
        apart = entropy - entropy.min(axis=1, keepdims=True)
        own = apart[np.arange(len(truth)), truth]

        def loss(scale: float) -> float:
            return float(np.mean(scale * own + np.log(np.exp(-scale * apart).sum(axis=1))))

        self.scale = min((2.0 ** power for power in range(-1, 6)), key=loss)
        for language in range(len(self.names)):
            mine = entropy[truth == language, language]
            if len(mine):
                self.limits[language] = np.quantile(mine, ACCEPTED) + 0.25


def text_words(text: str) -> list[str]:
    return text.lower().split()


def train(rows: list[tuple[str, str]]) -> Models | None:
    """Models from (text, language) rows; every fifth row of a language calibrates."""
    counts: dict[str, Counter] = {}
    seen: Counter = Counter()
    kept = []
    for text, name in rows:
        seen[name] += 1
        words = text_words(text)
        if seen[name] % CALIBRATION == 0:
            kept.append((words, name))
        else:
            counts.setdefault(name, Counter()).update(words)
    names = sorted(name for name, words in counts.items() if words)
    if not names:
        return None
    models = Models(names, [Language(counts[name]) for name in names])
    kept = [(words, name) for words, name in kept if words and name in names]
    if kept:
        flat = [word for words, _ in kept for word in words]
        totals = sums_by_text(models.word_logs(flat), [len(words) for words, _ in kept])
        models.calibrate(totals, np.array([names.index(name) for _, name in kept]))
    return models


def training_sample(documents: DataFrame) -> list[tuple[str, str]]:
    """Texts of each of the LANGUAGES most frequent languages, in the order of their id hashes.

    Hashes are even, so about twice the sample lies below a bound set by the number of ids of a
    language; only these rows are grouped and ranked, whatever share of all rows a language
    holds. An id counts once per language, with its smallest text. There is one bound per
    language, so at most LANGUAGES are broadcast; of equally frequent ones the first by name count.
    """
    usable = documents.where("lang IS NOT NULL AND text IS NOT NULL").select(
        "lang", "text", F.xxhash64("doc_id").alias("order"))
    bounds = usable.groupBy("lang").agg(
        F.approx_count_distinct("order").alias("ids"), F.count("*").alias("rows"))
    bounds = bounds.orderBy(F.desc("rows"), "lang").limit(LANGUAGES).select(
        "lang", (F.lit(2.0 * TRAIN_ROWS) / F.col("ids") * 2.0 ** 64 - 2.0 ** 63).alias("bound"))
    rows = (
        usable.join(F.broadcast(bounds), "lang")
        .where(F.col("order").cast("double") <= F.col("bound"))
        .groupBy("lang", "order").agg(F.min("text").alias("text"))
        .selectExpr("lang", "text",
                    "row_number() OVER (PARTITION BY lang ORDER BY order) AS place",
                    "sum(length(text)) OVER (PARTITION BY lang ORDER BY order) AS so_far")
        .where(f"place <= {TRAIN_ROWS} AND (place = 1 OR so_far <= {TRAIN_CHARACTERS})").collect()
    )
    return [(row.text, row.lang) for row in sorted(rows, key=lambda row: (row.lang, row.place))]


def identify(documents: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every whole text."""
    models = train(training_sample(training))
    shared = documents.sparkSession.sparkContext.broadcast(vars(models) if models else None)

    def make():
        models = Models.of(shared.value) if shared.value else None
        words_seen = WordRows(models.word_logs) if models else None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            names, scores, rejected = [], [], []
            for low, high in slices(texts):
                split = [text_words(text) for text in texts[low:high]]
                lettered = [any(map(str.isalpha, text)) for text in texts[low:high]]
                if models is None:
                    lettered = [False] * len(split)
                    best, score, out = [0] * len(split), np.zeros(len(split)), lettered
                else:
                    places = words_seen.look([word for words in split for word in words])
                    totals = sums_by_text(words_seen.rows[places], [len(words) for words in split])
                    best, score, out = models.judge(totals)
                for language, value, bad, known in zip(best, score, out, lettered):
                    names.append(models.names[language] if known else UNDETERMINED)
                    scores.append(float(value) if known else 0.0)
                    rejected.append(bool(bad) or not known)
            return pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(names, pa.string()),
                 pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"])

        return step

    return map_texts(documents, ["doc_id", "text"],
                     "doc_id long, lang_pred string, score double, rejected boolean", make)


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    return identify(documents, documents.where(~held_out)).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
