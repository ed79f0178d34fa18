"""Cost-balanced packing of token sequences.

A sequence's cost is estimated as linear plus quadratic in the lengths of its pieces, as each piece
attends within itself. Documents are taken in descending length and each goes to the sequence of
the lowest cost that has tokens left for it; full sequences are cut off documents longer than one.
Where no sequence has room for a whole piece, the piece is cut over the roomiest ones. What is
left of a block beyond full sequences goes to sequences whose sizes are powers of two, so that no
sequence has padding.

Open sequences are listed by their remaining room; a tree over the room's sizes gives the cheapest
one with room enough, over all of them, in a step per level.

Blocks are runs of documents within a task, bounded by tokens. So nothing is shuffled, memory
is bounded whatever a source's share, and a task that is run again gives the same pieces.

A null or empty text is its end token alone; a null doc_id is kept. Repeated rows are packed once
each. Of equal lengths the earlier row goes first, of equal costs the earlier sequence. An empty
table gives no row. A long text adds its tokens to one block. Other columns are ignored, whatever
their names. ``sequence_id`` is unique over all tasks, not gapless.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from sentryspark.llm.common import query, table
from sentryspark.llm.tokens import encoder, slices, tokenizer_path

CAPACITY = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
# Parameters: cost = LINEAR * n + QUADRATIC * n * n per piece (ratio of a 1024-wide model with
# 12 times its width squared per token to twice the width per pair), and tokens of a block.
LINEAR, QUADRATIC = 12 * 1024, 2
BLOCK_TOKENS = 4_000_000
# Parameter: texts taken out of an Arrow batch at once.
TEXTS = 500

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long"
)


def cost(length: int) -> int:
    return LINEAR * length + QUADRATIC * length * length


class OpenSequences:
    """Sequences with room left: the cheapest one with room for a length, and the roomiest."""

    NONE = (1 << 62, -1)

    def __init__(self, sizes: list[int], capacity: int):
        self.room, self.filled = list(sizes), [0] * len(sizes)
        self.width = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.least = [self.NONE] * (2 * self.width)
        for number, size in enumerate(sizes):
            self.heaps[size].append((0, number))
        for size in set(sizes):
            self._changed(size)

    def _changed(self, room: int) -> None:
        """The cheapest sequence of that room is another one; tell the nodes above."""
        least, node = self.least, self.width + room
        least[node] = self.heaps[room][0] if self.heaps[room] else self.NONE
        while node > 1:
            node >>= 1
            a, b = least[2 * node], least[2 * node + 1]
            best = a if a <= b else b
            if least[node] == best:
                break
            least[node] = best

    def cheapest(self, length: int) -> int | None:
        """The sequence of the lowest cost with room for ``length``, the first of equal ones."""
        least, node = self.least, self.width + length
        best = least[node]
        while node > 1:
            if not node & 1 and least[node + 1] < best:
                best = least[node + 1]
            node >>= 1
        return None if best[1] < 0 else best[1]

    def roomiest(self) -> int:
        """The cheapest of those with the most room."""
        least, node = self.least, 1
        while node < self.width:
            node = 2 * node + (least[2 * node + 1][1] >= 0)
        return least[node][1]

    def put(self, number: int, length: int) -> int:
        """Fill ``length`` tokens of a sequence that leads its list; its offset before."""
        room, offset = self.room[number], self.filled[number]
        paid, _ = heapq.heappop(self.heaps[room])
        self._changed(room)
        self.room[number], self.filled[number] = room - length, offset + length
        if room > length:
            heapq.heappush(self.heaps[room - length], (paid + cost(length), number))
            self._changed(room - length)
        return offset


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents given by their lengths."""
    pieces, rest, full = [], [], 0
    for document, length in enumerate(lengths):
        whole = length // capacity * capacity
        for start in range(0, whole, capacity):
            pieces.append((document, start, capacity, full, 0))
            full += 1
        if length > whole:
            rest.append((length - whole, document, whole))
    rest.sort(key=lambda item: (-item[0], item[1]))
    total = sum(item[0] for item in rest)
    beyond = total % capacity
    powers = [1 << bit for bit in reversed(range(beyond.bit_length())) if beyond >> bit & 1]
    sequences = OpenSequences([capacity] * (total // capacity) + powers, capacity)
    for length, document, start in rest:
        number = sequences.cheapest(length)
        if number is not None:
            pieces.append((document, start, length, full + number, sequences.put(number, length)))
            continue
        while length:
            number = sequences.roomiest()
            part = min(length, sequences.room[number])
            pieces.append((document, start, part, full + number, sequences.put(number, part)))
            start, length = start + part, length - part
    return pieces


def pack_documents(
    documents: DataFrame, path: str, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``capacity`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path, True)
        end = END_ID.to_bytes(4, "little")
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, tokens, sequence
            found = pack([len(ids) // 4 for _, ids in held], capacity)
            rows = [
                (held[document][0], start, length,
                 zlib.crc32(held[document][1][4 * start:4 * (start + length)]),
                 len(held[document][1]) // 4, sequence + number, offset)
                for document, start, length, number, offset in found
            ]
            sequence += max(item[3] for item in found) + 1
            held, tokens = [], 0
            names = [part.split()[0] for part in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays(
                [pa.array(values, pa.int64()) for values in zip(*rows)], names)

        for batch in batches:
            for place in range(0, batch.num_rows, TEXTS):
                part = batch.slice(place, TEXTS)
                ids = part.column(0).to_pylist()
                texts = [text or "" for text in part.column(1).to_pylist()]
                for low, high in slices(texts):
                    for doc_id, encoded in zip(ids[low:high], words.encode(texts[low:high])):
                        held.append((doc_id, encoded + end))
                        tokens += len(encoded) // 4 + 1
                        if tokens >= block_tokens:
                            yield flush()
        if held:
            yield flush()
        # The worker may go on to other work, which can use the room.
        words.forget()

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
