"""Personal data by weak supervision.

Base patterns give spans that always stay. Loose patterns give further candidates (numbers without
a leading plus, spelled-out addresses, long internet addresses). Labelers vote yes, no or abstain on
every span of either sort: the strict pattern, a gazetteer (top-level domains, calling codes, card
issuers), words before the span, and signs of other numbers. Expectation-maximisation on the
counts of vote patterns per kind estimates how reliable each labeler is; its posteriors train
a logistic classifier, which decides on the candidates that are not base spans.

Votes are counted over all spans; only the counts of distinct vote patterns reach the driver, at most
4 * 3 ** 4 rows. Null texts are empty and have no spans. Rows are judged apart; repeated
rows give repeated results. Positions count code points, the end is exclusive. An empty table gives no
row. A long text is searched whole, its spans are one array. Other columns are ignored by
``find_personal_data`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

from math import exp

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentryspark.llm.common import query, table, written

KINDS = ("email", "ip", "card", "phone")
VOTERS = ("strict", "gazetteer", "context", "other")

# The base patterns, written so that no repetition is retried from inside a run of
# its own characters. A dot between domain characters is written DOT beforehand.
DOT = "\ue001"
STRICT = {
    "email": f"(?:\\G|(?<![A-Za-z0-9._%+{DOT}-]))[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}"
             f"[A-Za-z0-9{DOT}-]++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": "(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[\\[(] ?at ?[\\])] ?[a-z0-9-]{1,63}+"
             " ?(?:\\.|[\\[(] ?dot ?[\\])]) ?[a-z]{2,24}+",
    "ip": "(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])",
    "card": "(?<![0-9])(?<![0-9][ .])[0-9]{4}([ .])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}(?![ .]?[0-9])",
    "phone": "(?<![0-9+.(-])(?<![0-9] )(?:\\([0-9]{3}\\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}"
             "(?![ .-]?[0-9])",
}
# Characters of which a pattern needs one to match, to spare texts the search; none: any text.
NEEDS = {
    "email": (("@",), ("at", "At", "aT", "AT")), "ip": ((".",), (":",)), "card": ((), ()),
    "phone": (("+",), ()),
}
OCTETS = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
# Parameters: the labelers' word lists and the reach of the context.
GAZETTEER = {
    "email": "(?i)[.](com|org|net|edu|gov|int|info|io|de|fr|es|uk|eu|it|nl|ch|at)$",
    "ip": "^(?!0+[.]|127[.]|255[.])",
    "card": "^[3456]",
    "phone": "^(\\+?1?[ .(-]*[2-9][0-9]{2}|\\+[2-9])",
}
CONTEXT = {
    "email": "(?i)(mail|contact|write|correo|courriel)",
    "ip": "(?i)(\\bip\\b|address|host|server|from)",
    "card": "(?i)(card|visa|master|amex|payment|karte|carte|tarjeta)",
    "phone": "(?i)(phone|tel|call|fax|mobil|whatsapp)",
}
OTHER = "(?i)(version|isbn|issn|doi|invoice|order|section|chapter)[ :#.]*$"
REACH = 40
ROUNDS = 30


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def located(text: str, pattern: str, kind: str, strict: bool) -> str:
    """SQL for the matches in ``text`` as (kind, start, end, strict): what lies between matches
    and the matches themselves, added up."""
    return (
        f"transform(array(named_struct('gap', split({text}, {quoted(pattern)}, -1), 'hit', "
        f"regexp_extract_all({text}, {quoted(pattern)}, 0))), x -> aggregate("
        f"slice(sequence(0, size(x.hit)), 2, size(x.hit)), "
        f"named_struct('at', 0, 'out', {EMPTY}), (s, i) -> named_struct("
        f"'at', s.at + length(x.gap[i - 1]) + length(x.hit[i - 1]), "
        f"'out', concat(s.out, array(named_struct('kind', '{kind}', "
        f"'start', s.at + length(x.gap[i - 1]), "
        f"'end', s.at + length(x.gap[i - 1]) + length(x.hit[i - 1]), 'strict', {str(strict).lower()}"
        f")))), s -> s.out))[0]"
    )


EMPTY = "CAST(array() AS array<struct<kind:string,start:int,end:int,strict:boolean>>)"


def covered(span: str, text: str = "text") -> str:
    return f"substring({text}, {span}.start + 1, {span}.end - {span}.start)"


def luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the check sum."""
    digit = "CAST(substring(d, length(d) - i + 1, 1) AS INT)"
    doubled = f"({digit} * 2 - IF({digit} > 4, 9, 0))"
    return (
        f"transform(array({digits}), d -> aggregate(sequence(1, greatest(length(d), 1)), 0, (n, i) -> "
        f"n + IF(d = '', 0, IF(i % 2 = 0, {doubled}, {digit}))) % 10 = 0)[0]"
    )


def valid(kind: str) -> str:
    """SQL for what a base match ``m`` has to pass beside its pattern."""
    digits = "regexp_replace(m, '[^0-9]', '')"
    if kind == "ip":
        return f"m RLIKE {quoted(f'^{OCTETS}([.]{OCTETS}){{3}}$')}"
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return f"length({digits}) BETWEEN 9 AND 15"
    return "true"


def vote(condition: str, otherwise: str) -> str:
    return f"IF({condition}, 1, {otherwise})"


def with_spans(documents: DataFrame) -> DataFrame:
    """Add ``base`` spans and ``loose`` candidates that overlap none, sorted, with their votes."""
    found = documents
    plain = f"translate(coalesce(text, ''), '{DOT}', '?')"
    found = found.withColumn("__plain", F.expr(plain))
    for kind in KINDS:
        source = "__plain"
        if kind == "email":
            source = (f"regexp_replace(__plain, {quoted('[.](?<=[A-Za-z0-9-][.])(?=[A-Za-z0-9-])')}"
                      f", '{DOT}')")
        for strict, pattern in ((True, STRICT[kind]), (False, LOOSE[kind])):
            needed = NEEDS[kind][0 if strict else 1]
            where = source if strict else "__plain"
            # The text is bound once, as it may be an expression.
            spans = f"transform(array({where}), t -> {located('t', pattern, kind, strict)})[0]"
            if needed:
                some = " OR ".join(f"contains(__plain, '{part}')" for part in needed)
                spans = f"CASE WHEN {some} THEN {spans} ELSE {EMPTY} END"
            if strict and kind != "email":
                spans = (f"filter({spans}, s -> transform(array({covered('s', '__plain')}), "
                         f"m -> {valid(kind)})[0])")
            found = found.withColumn(f"__{kind}_{'strict' if strict else 'loose'}", F.expr(spans))
    order = " ".join(f"WHEN '{kind}' THEN {place}" for place, kind in enumerate(KINDS))
    by_start = ("(a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start "
                f"ELSE (CASE a.kind {order} END) - (CASE b.kind {order} END) END")
    all_of = lambda sort: ", ".join(f"__{kind}_{sort}" for kind in KINDS)
    found = found.withColumn(
        "__base", F.expr(f"array_sort(concat({all_of('strict')}), {by_start})"))
    found = found.withColumn("__more", F.expr(
        f"array_sort(filter(concat({all_of('loose')}), s -> NOT exists(__base, "
        f"b -> b.start < s.end AND s.start < b.end)), {by_start})"))
    match = lambda lists, on: "CASE s.kind " + " ".join(
        f"WHEN '{kind}' THEN {on} RLIKE {quoted(pattern)}" for kind, pattern in lists.items()) + " END"
    before = f"substring(__plain, greatest(s.start - {REACH}, 0) + 1, least(s.start, {REACH}))"
    votes = (
        "named_struct('kind', s.kind, 'start', s.start, 'end', s.end, "
        "'strict', IF(s.strict, 1, 0), "
        f"'gazetteer', {vote(match(GAZETTEER, covered('s', '__plain')), '0')}, "
        f"'context', {vote(match(CONTEXT, before), 'CAST(NULL AS INT)')}, "
        f"'other', IF({before} RLIKE {quoted(OTHER)}, 0, CAST(NULL AS INT)))"
    )
    for name, source in (("base", "__base"), ("loose", "__more")):
        found = found.withColumn(name, F.expr(f"transform({source}, s -> {votes})"))
    return found.drop(*(name for name in found.columns if name.startswith("__")))


def reliabilities(patterns: list[tuple[tuple[int | None, ...], int]]) -> tuple[float, list[tuple]]:
    """Share of true spans, and each labeler's chance to say yes on true and on false ones.

    Expectation-maximisation over vote patterns with their counts, from the share of yes votes.
    """
    belief = [
        (sum(v for v in votes if v is not None) + 0.5) / (sum(v is not None for v in votes) + 1)
        for votes, _ in patterns
    ]
    share, chances = 0.5, []
    for _ in range(ROUNDS):
        total = sum(count for _, count in patterns)
        true = sum(b * count for b, (_, count) in zip(belief, patterns))
        share = (true + 1) / (total + 2)
        chances = []
        for voter in range(len(VOTERS)):
            sums = [1.0, 2.0, 1.0, 2.0]
            for b, (votes, count) in zip(belief, patterns):
                if votes[voter] is not None:
                    sums[0] += b * count * votes[voter]
                    sums[1] += b * count
                    sums[2] += (1 - b) * count * votes[voter]
                    sums[3] += (1 - b) * count
            chances.append((sums[0] / sums[1], sums[2] / sums[3]))
        belief = [posterior(share, chances, votes) for votes, _ in patterns]
    return share, chances


def posterior(share: float, chances: list[tuple], votes: tuple[int | None, ...]) -> float:
    yes, no = share, 1 - share
    for (on_true, on_false), v in zip(chances, votes):
        if v is not None:
            yes *= on_true if v else 1 - on_true
            no *= on_false if v else 1 - on_false
    return yes / (yes + no)


def features(vote_of) -> dict[str, str]:
    """Name and SQL of the classifier's inputs: a yes and a no per labeler, and the kind."""
    named = {}
    for voter in VOTERS:
        for value in (0, 1):
            named[f"{voter}_{value}"] = f"IF({vote_of(voter)} <=> {value}, 1.0, 0.0)"
    for kind in KINDS:
        named[f"is_{kind}"] = f"IF({vote_of('kind')} = '{kind}', 1.0, 0.0)"
    return named


def train(spans: DataFrame) -> tuple[list[float], float]:
    """Weights and bias of the span classifier, from the votes on all spans."""
    counts = written(
        spans.selectExpr("inline(concat(base, loose))").groupBy("kind", *VOTERS)
        .agg(F.count("*").alias("n")).coalesce(1), "votes")
    rows = counts.collect()
    models = {}
    for kind in KINDS:
        own = [(tuple(row[v] for v in VOTERS), row.n) for row in rows if row.kind == kind]
        if own:
            models[kind] = reliabilities(own)
    if not models:
        return [0.0] * len(features(str)), -1.0
    cases = " ".join(
        "WHEN kind = '{}' {} THEN {!r}D".format(
            row.kind, " ".join(f"AND {v} <=> {'NULL' if row[v] is None else row[v]}" for v in VOTERS),
            posterior(*models[row.kind], tuple(row[v] for v in VOTERS)))
        for row in rows)
    inputs = features(str)
    labelled = counts.selectExpr(
        "n", f"CASE {cases} END AS belief", *(f"{sql} AS {name}" for name, sql in inputs.items()))
    labelled = labelled.selectExpr(
        *inputs, "inline(array(named_struct('label', 1.0D, 'weight', n * belief), "
        "named_struct('label', 0.0D, 'weight', n * (1 - belief))))")
    vectors = VectorAssembler(inputCols=list(inputs), outputCol="features").transform(labelled)
    fitted = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50).fit(
        vectors.select("features", "label", "weight"))
    return list(map(float, fitted.coefficients)), float(fitted.intercept)


def accepted(model: tuple[list[float], float]) -> str:
    """SQL for all spans of a row: the base ones and the loose ones the classifier takes."""
    weights, bias = model
    parts = [f"{weight!r}D * {sql}" for weight, sql in zip(weights, features("s.{}".format).values())]
    kept = f"filter(loose, s -> {bias!r}D + {' + '.join(parts)} >= 0.0D)"
    order = " ".join(f"WHEN '{kind}' THEN {place}" for place, kind in enumerate(KINDS))
    return (f"array_sort(concat(base, {kept}), (a, b) -> CASE WHEN a.start <> b.start "
            f"THEN a.start - b.start ELSE (CASE a.kind {order} END) - (CASE b.kind {order} END) END)")


def joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def find_personal_data(documents: DataFrame) -> DataFrame:
    """(doc_id, base, spans): base spans and all spans, by start, of every document."""
    spans = written(with_spans(documents.select("doc_id", "text")).drop("text"), "spans")
    return spans.selectExpr("doc_id", "base", f"{accepted(train(spans))} AS spans")


def redact(documents: DataFrame) -> DataFrame:
    """Replace all spans in ``text`` by their kind in angle brackets; other columns stay.

    ``n_chars``, where there is one, is counted anew. A span inside another gives way to it. Texts
    are searched once: rows and spans are written together, the classifier learns from the spans
    and the texts are masked by them. Columns may have any names.
    """
    rows = documents.select(F.struct("*").alias("item"), "text")
    found = written(with_spans(rows).drop("text"), "spans")
    masked = (
        "transform(array(spans), l -> aggregate(l, named_struct('at', 0, 'out', ''), (a, s) -> "
        "IF(s.start < a.at, a, named_struct('at', s.end, 'out', concat(a.out, "
        "substring(item.text, a.at + 1, s.start - a.at), '<', s.kind, '>'))), "
        "a -> concat(a.out, substring(item.text, a.at + 1, length(item.text)))))[0]"
    )
    marked = found.selectExpr("item", f"{accepted(train(found.select('base', 'loose')))} AS spans")
    changed = marked.selectExpr("item", f"IF(size(spans) = 0, item.text, {masked}) AS masked",
                                "size(spans) > 0 AS is_masked")
    values = {"text": F.col("masked")}
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        values["n_chars"] = F.when(F.col("is_masked"), F.length("masked").cast(kind)).otherwise(
            F.col("item.n_chars"))
    return changed.select(*[
        values.get(name, F.col(f"item.`{name}`")).alias(name) for name in documents.columns])


@query("op9_personal_data")
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [f"CAST(size(filter(base, s -> s.kind = '{kind}')) AS LONG) AS n_{kind}"
              for kind in KINDS]
    return found.selectExpr(
        "doc_id", *counts, f"sha2({joined('base')}, 256) AS base_sha256",
        f"{joined('spans')} AS spans")
