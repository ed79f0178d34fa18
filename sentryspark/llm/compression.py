"""Quality rules: word and line counts, and zstandard compression bands.

A text that compresses too well repeats itself; one that hardly compresses is random. Both the
whole text and its fixed chunks are compressed. How far a text compresses depends on its length
(a compressor has nothing to refer back to in a short text), so limits are given per length.

Nulls and empty texts have no words, fail the base rules and are not kept. Ties and repeated rows
need no order: each row is judged on its own. An empty table gives no row; other columns are ignored,
whatever their names. A long text takes some 200 bytes per word while its windows are counted. The bands
were set by hand from the ratios of the sample tables' labelled prose and junk.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from sentryspark.llm.common import map_texts, query, table

SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEVEL = 3
CHUNK_BYTES = 4096

# Parameters: (bytes from, least ratio, largest ratio) of raw to compressed size, whole text.
BANDS = (
    (0, 0.0, 3.0),
    (256, 1.1, 3.2),
    (1024, 1.25, 3.4),
    (4096, 1.3, 3.8),
    (32768, 1.3, 4.5),
)
# A chunk is of a fixed size, so it has one band. A text is rejected for its chunks when more
# than this share of them lies outside.
CHUNK_BAND = (1.3, 4.2)
CHUNK_SHARE = 0.2

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, ratio double, bad_chunks double, kept boolean"
)
_SYMBOLS = SYMBOLS.encode()


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words which occurs twice or more, the first included."""
    if len(words) <= window:
        return 0
    windows = list(zip(*(words[i:] for i in range(window))))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, end = 0, 0
    for start, item in enumerate(windows):
        if counts[item] > 1:
            covered += start + window - max(start, end)
            end = start + window
    return covered


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


def band_of(size: int) -> tuple[float, float]:
    return next((low, high) for start, low, high in reversed(BANDS) if size >= start)


def compression(raw: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of its chunks outside their band, and the verdict.

    An empty text has ratio 0 and no chunks. Only full chunks are judged, as a shorter rest
    compresses less; a text below one chunk is judged as a whole alone.
    """
    if not raw:
        return 0.0, 0.0, False
    ratio = len(raw) / len(compressor.compress(raw))
    full = len(raw) // CHUNK_BYTES
    bad = 0
    for number in range(full):
        chunk = raw[number * CHUNK_BYTES:(number + 1) * CHUNK_BYTES]
        bad += not CHUNK_BAND[0] <= len(chunk) / len(compressor.compress(chunk)) <= CHUNK_BAND[1]
    share = bad / full if full else 0.0
    low, high = band_of(len(raw))
    return ratio, share, low <= ratio <= high and share <= CHUNK_SHARE


def _judge():
    compressor = zstandard.ZstdCompressor(level=LEVEL)

    def row(text: str | None) -> tuple:
        raw = (text or "").encode()
        words = raw.split()
        # Bytes that continue a code point are 10xxxxxx.
        chars = len(text or "") - (len(raw) - sum(map(len, words)))
        symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
        repeats = repeated_words(words)
        failed = len(words) < 10 or 100 * repeats > 20 * len(words)
        ratio, share, inside = compression(raw, compressor)
        return (len(words), chars, symbols, duplicate_lines(raw), repeats, failed, ratio, share,
                inside and not failed)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [row(text) for text in batch.column(1).to_pylist()]
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names)

    return step


def judge_texts(documents: DataFrame) -> DataFrame:
    """One row per document with its counts, compression figures and verdict."""
    return map_texts(documents, ["doc_id", "text"], SCHEMA, _judge)


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_texts(table(spark, sf_dir, "documents"))
