"""SimHash near-duplicates by generalised pigeonhole.

Fingerprints within distance T of each other must, for any split of the 64 bits into m parts with
thresholds that sum to T - m + 1, lie within its threshold in some part. Correlated bits are put into
the same part; dynamic programming gives each part the threshold (-1: not looked at) of the least
estimated work, from the candidates counted between the fingerprints of a bounded sample. Parts are
then probed with all values within their threshold and candidates verified on the whole fingerprint.

A part value shared by so many fingerprints that pairing them costs more than listing neighbours
is not paired: its fingerprints are grouped by the 65 values within one bit of each, where any
two at distance two or less meet, and linked to the smallest of each group (at most 65 rows). So no
group of copies is expanded into pairs and none is cut off.

Texts without words have fingerprint zero and link like others. Null ids are kept as rows; a component
of null ids alone has a null id. Repeated rows and ties share a fingerprint. An empty table gives no
row. A long text is one array of hashes in one task. ``near_duplicates`` ignores other columns,
``keep_one`` keeps them whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentryspark.llm.common import map_texts, query, table, written
from sentryspark.llm.components import connected_components

BITS = 64
SHINGLE = 3
DISTANCE = 2
SEED = 42
# Parameters: fingerprints in the sample that estimates correlations and candidate counts, part
# counts tried, and the cost of a probe row against a candidate pair.
SAMPLE = 4096
PARTS = (2, 3, 4)
PROBE_COST = 2.0


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint as a signed integer: majority of the bits of shingle hashes."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        joined = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        hashes = [digest(item, SEED) for item in joined]
    counts = np.zeros(BITS, dtype=np.int64)
    values = np.array(hashes, dtype="<u8")
    for start in range(0, len(values), 16384):
        part = values[start:start + 16384].view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    majority = np.packbits(counts * 2 > len(values), bitorder="little")
    return int(majority.view("<i8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per document."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [fingerprint_of(text, shingle) for text in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(found, pa.int64())], ["doc_id", "fp"])

        return step

    return map_texts(documents, ["doc_id", "text"], "doc_id long, fp long", make)


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Split the bit positions into ``parts`` groups of equal size, correlated bits together."""
    centred = bits - bits.mean(axis=0)
    norm = np.sqrt((centred ** 2).sum(axis=0))
    norm[norm == 0] = 1.0
    together = np.abs((centred.T @ centred) / np.outer(norm, norm))
    np.fill_diagonal(together, 0.0)
    rest, groups = list(range(BITS)), []
    for number in range(parts):
        width = (BITS - sum(map(len, groups))) // (parts - number)
        group = [max(rest, key=lambda b: (together[b, rest].sum(), -b))]
        rest.remove(group[0])
        while len(group) < width:
            nearest = max(rest, key=lambda b: (together[b, group].sum(), -b))
            group.append(nearest)
            rest.remove(nearest)
        groups.append(sorted(group))
    return groups


def near_share(bits: np.ndarray, group: list[int], distance: int) -> list[float]:
    """Share of pairs within 0..distance on a group of bits: counted in the sample, and at least
    what independent bits give, as a sample shows no rare meetings."""
    own = bits[:, group]
    ones = own.mean(axis=0)
    differ = 2 * ones * (1 - ones)
    exact = np.zeros(distance + 2)
    exact[0] = 1.0
    for share in differ:
        exact[1:] = exact[1:] * (1 - share) + exact[:-1] * share
        exact[0] *= 1 - share
    independent = np.cumsum(exact[:distance + 1])
    pairs, found = max(1, len(own) * (len(own) - 1)), np.zeros(distance + 1)
    for start in range(0, len(own), 512):
        block = own[start:start + 512]
        apart = block @ (1 - own.T) + (1 - block) @ own.T
        found += [(apart <= d + 0.5).sum() - len(block) for d in range(distance + 1)]
    return [float(max(a, b)) for a, b in zip(found / pairs, independent)]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (from -1, which costs nothing) of the least summed cost that sum to ``total``.

    ``costs[i][t]`` is the cost of part i at threshold t.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for reached, (paid, chosen) in best.items():
            for threshold in range(-1, len(part)):
                cost = paid + (part[threshold] if threshold >= 0 else 0.0)
                key = reached + threshold
                if key not in step or cost < step[key][0]:
                    step[key] = (cost, [*chosen, threshold])
        best = step
    return best[total]


def ball(group: list[int], threshold: int) -> list[int]:
    """Masks that flip at most ``threshold`` of a group's bits."""
    return [sum(1 << bit for bit in flips)
            for size in range(threshold + 1) for flips in combinations(group, size)]


def plan_parts(sample: list[int], count: int, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to probe, for ``count`` fingerprints like the sample's."""
    values = np.array([value & (2 ** BITS - 1) for value in sample], dtype="<u8")
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    bits = bits.astype(np.float32)
    plans = []
    for parts in (m for m in PARTS if m <= distance + 2):
        groups = group_bits(bits, parts)
        costs = []
        for group in groups:
            share = near_share(bits, group, distance)
            probes = [len(ball(group, t)) for t in range(distance + 1)]
            costs.append([count * count / 2 * share[t] + PROBE_COST * count * probes[t]
                          for t in range(distance + 1)])
        cost, thresholds = allocate(costs, distance - parts + 1)
        plans.append((cost, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(plans, key=lambda plan: plan[0])[1]


def near_pairs(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` within ``distance`` of each other.

    Links of frequent part values are given by stars, so the links connect what the pairs would;
    the stars need ``distance`` to be 2 at most.
    """
    if distance > 2:
        raise ValueError("distance must be 2 at most")
    order = F.xxhash64("fp")
    sample = [row.fp for row in prints.orderBy(order, "fp").limit(SAMPLE).select("fp").collect()]
    if len(sample) < 2:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    plan = plan_parts(sample, prints.count(), distance)

    entries = []
    for number, (group, threshold) in enumerate(plan):
        own = f"fp & {signed(sum(1 << bit for bit in group))}L"
        for mask in ball(group, threshold):
            entries.append(f"struct({number} AS part, ({own}) ^ {signed(mask)}L AS key, "
                           f"{'true' if mask == 0 else 'false'} AS own)")
    signatures = prints.selectExpr("fp", f"inline(array({', '.join(entries)}))")
    met = signatures.groupBy("part", "key").agg(
        F.count("*").alias("probes"), F.count(F.when(F.col("own"), 1)).alias("members"))
    # Pairing costs probes x members, listing neighbours 65 rows for each fingerprint.
    frequent = written(
        met.where("members > 1 AND probes * members > 65 * (probes + members)")
        .select("part", "key"), "frequent-parts")
    rare = signatures.join(frequent, ["part", "key"], "left_anti")
    members = rare.where("own").select("part", "key", F.col("fp").alias("a"))
    pairs = (
        members.join(rare.select("part", "key", F.col("fp").alias("b")), ["part", "key"])
        .where(F.expr(f"a < b AND bit_count(a ^ b) <= {distance}")).select("a", "b")
    )
    crowded = signatures.join(frequent, ["part", "key"], "left_semi").select("fp").distinct()
    return pairs.union(neighbour_stars(crowded, distance))


def neighbour_stars(prints: DataFrame, distance: int) -> DataFrame:
    """Links that connect all fingerprints within ``distance`` (1 or 2; 0: none) of each other."""
    flips = [0, *(1 << bit for bit in range(BITS))]
    values = ", ".join(f"fp ^ {signed(mask)}L" for mask in flips)
    listed = prints.selectExpr("fp", f"explode(array({values})) AS near")
    if distance == 2:
        # At most 65 fingerprints lie within one bit of a value.
        linked = listed.selectExpr("fp AS a", "min(fp) OVER (PARTITION BY near) AS b")
    else:
        linked = listed.where("fp <> near").join(
            prints.select(F.col("fp").alias("near")), "near").selectExpr("fp AS a", "near AS b")
    return linked.where("a <> b" if distance else "false").distinct()


def near_duplicates(
    documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable."""
    rows = written(fingerprints(documents, shingle), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    links = connected_components(near_pairs(prints, distance))
    roots = prints.join(links, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(
    documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE,
) -> DataFrame:
    """One row, with all its columns, of each group of near-duplicates (the first as stored).

    Rows are told apart by a number of their own, so repeated and null ids need no care.
    """
    numbered = written(
        documents.select(F.struct("*").alias("item"), F.monotonically_increasing_id().alias("row")),
        "numbered")
    found = near_duplicates(
        numbered.select(F.col("row").alias("doc_id"), F.col("item.text").alias("text")), shingle,
        distance)
    gone = written(
        found.where("doc_id <> component_id").select(F.col("doc_id").alias("row")), "duplicates")
    return numbered.join(gone, "row", "left_anti").select("item.*")


@query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
