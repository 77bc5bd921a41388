"""Personal data: proposed spans, boosted trees over their format and context, calibrated redaction.

Spans with a checked format (email, ip, card, phone) are always taken. High-recall generators propose further,
overlapping spans: addresses with a spelled-out at sign or without a dot, numbers with any separators. Gradient-boosted
trees of depth two tell which of them are personal, from format and context features.

What is right does not depend on the surface that the checks know. Right examples are the checked spans themselves and
the same spans rewritten where they stand, with the words around them: "[at]" and "(dot)" for the signs, numbers without
plus or country, other separators. Wrong examples are the digits of the same spans as order numbers and dates, addresses
cut before their dot, card numbers with another last digit, and the proposals of the corpus that are dates or follow a word such
as "order" or "invoice". Other proposals teach nothing, so data that no check finds does not count against itself.
Features take few values each, so all examples are counted by feature combination. On other documents the lowest score is
found, per generator, above which 95 of 100 examples are right; proposals above it that touch no checked span are added.
The trees become one SQL expression, so everything runs inside the JVM.

Places are code points, ends exclusive. Defined cases: NULL and empty texts have no spans; texts of any length are
scanned in time that grows with their length and their number of spans; repeated rows are treated alike; with no examples nothing
is added; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.llm.common import query, stored, table, texts_of
from tallmat.llm.quality_rules import let

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "A-Za-z0-9._%+-"
# \G and the look-behind start a match only where a run of its first characters starts, or where the last match ended:
# the same leftmost matches as without them, in linear time. Possessive groups keep the stack flat.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = [
    rf"(?<![{_LOCAL}])[{_LOCAL}]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]+)*+",
    r"(?<![A-Za-z0-9])[+(]{0,2}[0-9](?:[().-]{0,2}[0-9])++",
    r"(?<![A-Za-z0-9])[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9])++",
]
# shorter numbers are proposed only where they look like an address
MIN_DIGITS = 7
FOUR_PARTS = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"
# fixed values: words before a number or address that tell what it is
CONTEXT = [
    "call|phone|tel|telefon|telephone|mobile|fax|mail|email|e-mail|contact|kontakt|correo|courriel",
    "card|visa|mastercard|account|konto|iban|carte|tarjeta",
    "ip|host|server|address|adresse",
]
# fixed values: words before a number that is none of a person
OTHER_CONTEXT = (
    "order|invoice|reference|ref|isbn|issn|no|nr|item|id|article|version|page|year|since|"
    "artikel|auftrag|bestellung|rechnung|seite|jahr|commande|facture|annee|pedido|factura|pagina|num|numero"
)
DATE = r"^(?:(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)?[0-9]{2})$"
ROUNDS, RATE, MIN_PRECISION, MIN_PROPOSALS = 60, 0.3, 0.95, 20
FEATURES = ["at", "digits", "dots", "plus", "bracket", "separators", "context", "octets", "edge", "date", "luhn"]
# Characters of context on each side of a span.
BEFORE, AFTER = 15, 8
# Elements that one step of a running fold copies at most, and spans up to which a text is cut by places.
CHUNK, FEW = 128, 32
_SPAN = "ARRAY<STRUCT<start: INT, rank: INT, end: INT>>"


def running(items: Column, state: Column, step, emit, out_type: str) -> Column:
    """What `emit(state before, item)` gives for every item, the state folded by `step(state, item)`.

    Items are taken in chunks: one fold passes states from chunk to chunk, others grow the results of one chunk each, so no
    step copies more than a chunk and the number of chunks.
    """
    none = F.expr(f"CAST(array() AS ARRAY<{out_type}>)")

    def of(chunks: Column) -> Column:
        def over_chunk(before: Column, chunk: Column) -> Column:
            return F.aggregate(chunk, before, step)

        states = F.aggregate(
            chunks,
            F.struct(state.alias("now"), F.slice(F.array(state), 1, 0).alias("all")),
            lambda a, chunk: F.struct(over_chunk(a["now"], chunk).alias("now"), F.concat(a["all"], F.array(a["now"])).alias("all")),
            lambda a: a["all"],
        )

        def emitted(chunk: Column, begin: Column) -> Column:
            return F.aggregate(
                chunk,
                F.struct(begin.alias("now"), none.alias("out")),
                lambda a, x: F.struct(step(a["now"], x).alias("now"), F.concat(a["out"], F.array(emit(a["now"], x))).alias("out")),
                lambda a: a["out"],
            )

        return F.flatten(F.zip_with(chunks, states, emitted))

    def cut(x: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int"))
        return let(F.transform(at, lambda k: F.slice(x, k * CHUNK + 1, F.lit(CHUNK))), of)

    return let(items, lambda x: F.when(F.size(x) == 0, none).otherwise(cut(x)))


_HIT = "STRUCT<start: INT, end: INT, hit: STRING, before: STRING, after: STRING>"


def _found(text: Column, pattern: str) -> Column:
    """Matches as structs (start, end, hit, before, after): the stretches between matches give places and context."""

    def placed(h: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            rows = F.zip_with(
                h, gaps, lambda x, g: F.struct(x.alias("hit"), F.length(g).alias("gap"), F.substring(g, -BEFORE, BEFORE).alias("before"))
            )
            follows = F.transform(F.slice(gaps, F.lit(2), F.size(gaps)), lambda g: F.substring(g, 1, AFTER))
            both = F.zip_with(rows, follows, lambda x, f: F.struct(x["hit"].alias("hit"), x["gap"].alias("gap"), x["before"].alias("before"), f.alias("after")))
            return running(
                F.filter(both, lambda x: x["hit"].isNotNull()),
                F.lit(0),
                lambda at, x: at + x["gap"] + F.length(x["hit"]),
                lambda at, x: F.struct(
                    (at + x["gap"]).alias("start"), (at + x["gap"] + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"),
                    x["before"].alias("before"), x["after"].alias("after"),
                ),
                _HIT,
            )

        return let(F.split(text, pattern, -1), with_gaps)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr(f"CAST(array() AS ARRAY<{_HIT}>)")
    return let(hits, lambda h: F.when(F.size(h) == 0, none).otherwise(placed(h)))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.when(c != "", c).cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    if kind == "ip":
        parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(hit))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


_HINT = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+"}


def base_spans(text: Column) -> Column:
    """Checked spans as structs (start, rank of the kind, end, hit, before, after), in order."""

    def of(rank: int, kind: str) -> Column:
        valid = F.filter(_found(text, PATTERNS[kind]), lambda x: _valid(kind, x["hit"]))
        spans = F.transform(
            valid, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), *[x[n].alias(n) for n in ("end", "hit", "before", "after")])
        )
        full = "ARRAY<STRUCT<start: INT, rank: INT, end: INT, hit: STRING, before: STRING, after: STRING>>"
        return F.when(F.regexp_like(text, F.lit(_HINT[kind])), spans).otherwise(F.expr(f"CAST(array() AS {full})"))

    return F.array_sort(F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS)]))


def _band(value: Column, *limits: int) -> Column:
    out = F.lit(0)
    for i, limit in enumerate(limits, 1):
        out = F.when(value >= limit, F.lit(i)).otherwise(out)
    return out


# The value of the feature `context` after a word of OTHER_CONTEXT: below that of no word, so one split tells it from all others.
OTHER = 0


def proposals(text: Column) -> Column:
    """Proposed spans as structs (start, end, features), those of all generators together."""

    def described(x: Column) -> Column:
        hit = x["hit"]
        count = lambda c: F.length(hit) - F.length(F.translate(hit, c, ""))
        before = F.lower(x["before"])
        context = F.when(F.regexp_like(before, F.lit(rf"(?:^|[^a-z])(?:{OTHER_CONTEXT})[^a-z0-9]{{1,3}}$")), F.lit(OTHER)).otherwise(F.lit(OTHER + 1))
        for i, words in enumerate(CONTEXT, 1):
            context = F.when(F.regexp_like(before, F.lit(rf"(?:^|[^a-z])(?:{words})[^a-z0-9]{{1,3}}$")), F.lit(OTHER + 1 + i)).otherwise(context)
        n_digits = F.length(_digits(hit))
        # of an address what follows the sign
        behind = F.regexp_replace(hit, r"^.*(?:@|[\[(]at[\])])", "")
        features = [
            F.when(count("@") > 0, 1).when(F.regexp_like(hit, F.lit(r"[\[(]at[\])]")), 2).otherwise(0),
            _band(F.length(_digits(hit)), 7, 9, 12, 15, 17, 20),
            F.least(F.size(F.split(behind, r"\.|[\[(]dot[\])]")) - 1, F.lit(4)),
            F.when(hit.startswith("+"), 1).otherwise(0),
            F.when(count("()") > 0, 1).otherwise(0),
            _band(count(" -"), 1, 3),
            context,
            F.when(F.regexp_like(hit, F.lit(r"^[0-9]{1,3}(\.[0-9]{1,3})+$")), 1).otherwise(0),
            F.when(F.regexp_like(x["after"], F.lit("^[A-Za-z@]")), 1).otherwise(0),
            F.when(F.regexp_like(hit, F.lit(DATE)), 1).otherwise(0),
            F.when(n_digits.between(12, 19) & (count("@") == 0), F.when(_luhn(_digits(hit)), 1).otherwise(0)).otherwise(0),
        ]
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), *[f.cast("int").alias(n) for f, n in zip(features, FEATURES)]
        )

    fields = "".join(f", {n}: INT" for n in FEATURES)
    none = F.expr(f"CAST(array() AS ARRAY<STRUCT<start: INT, end: INT{fields}>>)")
    hints = [r"@|at[\])]", "[0-9]", "[0-9]"]
    parts = []
    for i, (pattern, hint) in enumerate(zip(GENERATORS, hints)):
        found = _found(text, pattern)
        if i:
            # the last generator differs from the one before where it crosses a space
            found = F.filter(
                found,
                lambda x: ((F.length(_digits(x["hit"])) >= MIN_DIGITS) | F.regexp_like(x["hit"], F.lit(FOUR_PARTS)))
                & (F.lit(i == 1) | F.contains(x["hit"], F.lit(" "))),
            )
        parts.append(F.when(F.regexp_like(text, F.lit(hint)), F.transform(found, described)).otherwise(none))
    return F.concat(*parts)


@dataclass
class Trees:
    """Boosted trees: each splits twice and has a value per leaf; `start` is the score of no tree.

    `thresholds` are those of numbers and of addresses.
    """

    start: float
    splits: list[tuple[int, int, int, int, int, int, tuple[float, float, float, float]]]
    thresholds: tuple[float, float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for f, t, fl, tl, fr, tr, leaves in self.splits:
            right = x[:, f] > t
            low = np.where(right, x[:, fr] > tr, x[:, fl] > tl)
            out += np.array(leaves)[2 * right + low]
        return out

    def column(self, x: Column) -> Column:
        """The same score of a proposal, as an expression."""
        out = F.lit(self.start)
        for f, t, fl, tl, fr, tr, (a, b, c, d) in self.splits:
            left = F.when(x[FEATURES[fl]] > tl, F.lit(b)).otherwise(F.lit(a))
            right = F.when(x[FEATURES[fr]] > tr, F.lit(d)).otherwise(F.lit(c))
            out = out + F.when(x[FEATURES[f]] > t, right).otherwise(left)
        return out


def _best_split(x: np.ndarray, rows: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[int, int]:
    best, choice = -1.0, (0, int(1e6))
    for f in range(x.shape[1]):
        for t in np.unique(x[rows, f])[:-1]:
            gain = 0.0
            for side in (rows & (x[:, f] <= t), rows & (x[:, f] > t)):
                gain += gradient[side].sum() ** 2 / (weight[side].sum() + 1.0)
            if gain > best + 1e-12:
                best, choice = gain, (f, int(t))
    return choice


def boost(x: np.ndarray, right: np.ndarray, wrong: np.ndarray, rounds: int = ROUNDS) -> Trees:
    """Gradient boosting of the logistic loss on counted feature combinations."""
    total = right + wrong
    rate = (right.sum() + 1) / (total.sum() + 2)
    model = Trees(float(np.log(rate / (1 - rate))), [], (np.inf, np.inf))
    score = np.full(len(x), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        gradient, weight = right - total * p, total * p * (1 - p)
        everything = np.ones(len(x), bool)
        f, t = _best_split(x, everything, gradient, weight)
        fl, tl = _best_split(x, x[:, f] <= t, gradient, weight)
        fr, tr = _best_split(x, x[:, f] > t, gradient, weight)
        leaf = 2 * (x[:, f] > t) + np.where(x[:, f] > t, x[:, fr] > tr, x[:, fl] > tl)
        values = [RATE * gradient[leaf == k].sum() / (weight[leaf == k].sum() + 1.0) for k in range(4)]
        score = score + np.array(values)[leaf]
        model.splits.append((f, t, fl, tl, fr, tr, tuple(float(v) for v in values)))
    return model


def calibrate(score: np.ndarray, right: np.ndarray, wrong: np.ndarray) -> float:
    """The lowest score such that, from it upward, proposals are right often enough; infinite where there is none."""
    best = np.inf
    hits = misses = 0
    for s in np.unique(score)[::-1]:
        hits += right[score == s].sum()
        misses += wrong[score == s].sum()
        if hits + misses >= MIN_PROPOSALS and hits >= MIN_PRECISION * (hits + misses):
            best = float(s)
    return best


def spans_table(docs: DataFrame) -> DataFrame:
    """(doc_id, base, proposed) of every row, stored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = texts_of(docs).select("doc_id", base_spans(text).alias("base"), proposals(text).alias("proposed"))
    return stored(rows, "spans")


def rewritten(span: Column) -> Column:
    """Other forms of a checked span as structs (before, hit, after, right)."""
    hit, digits = span["hit"], _digits(span["hit"])

    def form(text: Column, right: bool, before: Column | None = None) -> Column:
        context = span["before"] if before is None else before
        return F.struct(context.alias("before"), text.alias("hit"), span["after"].alias("after"), F.lit(right).alias("right"))

    local, domain = F.split_part(hit, F.lit("@"), F.lit(1)), F.split_part(hit, F.lit("@"), F.lit(2))
    dots = lambda mark: F.replace(domain, F.lit("."), F.lit(mark))
    emails = [
        form(F.concat(local, F.lit(" [at] "), dots(" [dot] ")), True),
        form(F.concat(local, F.lit(" (at) "), dots(" (dot) ")), True),
        form(F.concat(local, F.lit("(at)"), domain), True),
        form(F.concat(local, F.lit(" [at] "), domain), True),
        form(F.concat(local, F.lit(" [at] "), F.split_part(domain, F.lit("."), F.lit(1))), False),
        form(F.concat(local, F.lit("@"), F.split_part(domain, F.lit("."), F.lit(1))), False),
    ]
    plain = F.lit("so ")
    day = F.concat(F.lit("1"), F.substring(digits, -1, 1))
    month = F.concat(F.lit("0"), (F.substring(digits, -2, 1).cast("int") % 9 + 1).cast("string"))
    year = F.concat(F.lit("20"), F.substring(digits, -4, 2))
    numbers = [
        form(digits, False, plain),
        form(F.substring(digits, 1, 8), False, plain),
        form(F.substring(digits, 1, 10), False, F.lit("order no. ")),
        form(F.concat_ws("-", year, month, day), False, plain),
        form(F.concat_ws(".", day, month, year), False, plain),
        form(F.concat_ws("/", year, month, day), False),
    ]
    bare = F.regexp_replace(hit, r"^\+[0-9]{1,3}[\x20.-]?(?=[(0-9])", "")
    parted = F.regexp_like(bare, F.lit(r"[0-9][\x20().-]+[0-9]"))
    phones = [
        form(F.when(parted, bare), True),
        form(F.when(parted, F.translate(bare, " -", "..")), True),
        form(F.when(parted, F.translate(bare, " .", "--")), True),
        form(F.when(parted, F.substring(hit, 2, 40)), True),
    ]
    last = ((F.substring(digits, -1, 1).cast("int") + 1) % 10).cast("string")
    cards = [
        form(F.regexp_replace(digits, "(.{4})(?=.)", "$1."), True),
        form(F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), last), False),
        form(F.regexp_replace(F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), last), "(.{4})(?=.)", "$1 "), False),
    ]
    return (
        F.when(span["rank"] == 0, F.array(*emails))
        .when(span["rank"] == 2, F.array(*cards, *numbers))
        .when(span["rank"] == 3, F.array(*phones, *numbers))
        .otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<before: STRING, hit: STRING, after: STRING, right: BOOLEAN>>)"))
    )


def beside(base: Column, proposed: Column) -> Column:
    """Proposals as structs (p, exact, touching): whether a checked span is the same one, or overlaps it."""
    fields = "".join(f", {n}: INT" for n in FEATURES)
    proposal = f"STRUCT<start: INT, end: INT{fields}>"
    row = f"STRUCT<start: INT, added: INT, minus: INT, p: {proposal}>"

    def entry(x: Column, added: int, p: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(added).alias("added"), (-x["end"]).alias("minus"), p.alias("p"))

    nothing = F.expr(f"CAST(NULL AS {proposal})")
    rows = F.array_sort(F.concat(F.transform(base, lambda b: entry(b, 0, nothing)), F.transform(proposed, lambda p: entry(p, 1, p))))
    # from the end: where the next checked span starts; from the front: the last one, and how far they reach
    ahead = F.reverse(
        running(
            F.reverse(rows), F.lit(2147483647), lambda at, x: F.when(x["added"] == 0, x["start"]).otherwise(at),
            lambda at, x: F.struct(x.alias("x"), at.alias("next")), f"STRUCT<x: {row}, next: INT>",
        )
    )
    none = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(-1).alias("reach"))

    def passed(a: Column, y: Column) -> Column:
        end = -y["x"]["minus"]
        now = F.struct(y["x"]["start"].alias("start"), end.alias("end"), F.greatest(a["reach"], end).alias("reach"))
        return F.when(y["x"]["added"] == 0, now).otherwise(a)

    def judged(a: Column, y: Column) -> Column:
        start, end = y["x"]["start"], -y["x"]["minus"]
        exact = (a["start"] == start) & (a["end"] == end)
        return F.struct(y["x"]["p"].alias("p"), exact.alias("exact"), ((a["reach"] > start) | (y["next"] < end)).alias("touching"))

    found = running(ahead, none, passed, judged, f"STRUCT<p: {proposal}, exact: BOOLEAN, touching: BOOLEAN>")
    return F.filter(found, lambda y: y["p"].isNotNull())


def examples(spans: DataFrame) -> DataFrame:
    """(calibration, right, p): features of right and wrong examples, as the module says."""
    fold = (F.crc32(F.col("doc_id").cast("string")) % 3 == 0).alias("calibration")
    each = spans.select(fold, F.explode(beside(F.col("base"), F.col("proposed"))).alias("e"))
    other = ~F.col("e.touching") & (F.col("e.p.at") == 0) & ((F.col("e.p.date") == 1) | (F.col("e.p.context") == OTHER))
    given = each.where(F.col("e.exact") | other).select("calibration", F.col("e.exact").alias("right"), F.col("e.p").alias("p"))
    forms = spans.select(fold, F.explode("base").alias("b")).select("calibration", F.explode(rewritten(F.col("b"))).alias("f")).where("f.hit IS NOT NULL")
    text = F.concat("f.before", "f.hit", "f.after")
    found = forms.select("calibration", F.col("f.right").alias("right"), "f", F.explode(proposals(text)).alias("p"))
    begin = F.length("f.before")
    made = found.where((F.col("p.start") == begin) & (F.col("p.end") == begin + F.length("f.hit"))).select("calibration", "right", "p")
    return given.unionByName(made)


def learn(spans: DataFrame) -> Trees:
    """Trees and thresholds from the counts of all feature combinations (bounded by the features' values)."""
    counted = (
        examples(spans)
        .groupBy("calibration", *[F.col(f"p.{n}").alias(n) for n in FEATURES])
        .agg(F.sum(F.col("right").cast("int")).alias("hit"), F.count("*").alias("n"))
        .collect()
    )
    counted.sort(key=lambda r: (r.calibration, *[r[n] for n in FEATURES]))
    x = np.array([[r[n] for n in FEATURES] for r in counted]).reshape(len(counted), len(FEATURES))
    hit = np.array([r.hit for r in counted], float)
    miss = np.array([r.n - r.hit for r in counted], float)
    held = np.array([r.calibration for r in counted], bool)
    if not hit[~held].sum():
        return Trees(0.0, [], (np.inf, np.inf))
    model = boost(x[~held], hit[~held], miss[~held])
    address = x[:, FEATURES.index("at")] > 0
    kinds = [held & ~address, held & address]
    model.thresholds = tuple(calibrate(model.raw(x[k]), hit[k], miss[k]) for k in kinds)
    return model


def plain_spans(spans: Column) -> Column:
    """(start, rank, end) alone."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))


def all_spans(base: Column, proposed: Column, model: Trees) -> Column:
    """Checked spans and the added ones as (start, rank, end), in order; an added span touches no other span."""
    numbers, addresses = model.thresholds
    if not np.isfinite(numbers) and not np.isfinite(addresses):
        return plain_spans(base)

    def kind(p: Column) -> Column:
        return F.when(p["at"] > 0, 0).when(p["octets"] == 1, 1).when((p["plus"] == 0) & p["digits"].between(3, 5), 2).otherwise(3)

    def likely(p: Column) -> Column:
        def above(score: Column) -> Column:
            limits = [F.lit(t) if np.isfinite(t) else F.lit(None).cast("double") for t in (addresses, numbers)]
            return F.coalesce(score >= F.when(p["at"] > 0, limits[0]).otherwise(limits[1]), F.lit(False))

        return let(model.column(p), above)

    def merged(b: Column) -> Column:
        # in order of start, the longer first, checked spans before proposed ones
        def row(s: Column, added: int, rank: Column) -> Column:
            return F.struct(s["start"].alias("start"), F.lit(added).alias("added"), (-s["end"]).alias("minus"), rank.alias("rank"))

        new = F.transform(F.filter(proposed, likely), lambda p: row(p, 1, kind(p)))
        rows = F.array_sort(F.concat(F.transform(b, lambda s: row(s, 0, s["rank"])), new))
        far = F.lit(2147483647)
        # from the end: where the next checked span starts
        ahead = F.reverse(
            running(
                F.reverse(rows), far, lambda at, x: F.when(x["added"] == 0, x["start"]).otherwise(at),
                lambda at, x: F.struct(x.alias("x"), at.alias("next")),
                "STRUCT<x: STRUCT<start: INT, added: INT, minus: INT, rank: INT>, next: INT>",
            )
        )

        def fits(at: Column, y: Column) -> Column:
            return (y["x"]["added"] == 0) | ((y["x"]["start"] >= at) & (-y["x"]["minus"] <= y["next"]))

        kept = running(
            ahead, F.lit(0), lambda at, y: F.when(fits(at, y), F.greatest(at, -y["x"]["minus"])).otherwise(at),
            lambda at, y: F.struct(y["x"].alias("x"), fits(at, y).alias("fits")),
            "STRUCT<x: STRUCT<start: INT, added: INT, minus: INT, rank: INT>, fits: BOOLEAN>",
        )
        spans = F.filter(kept, lambda y: y["fits"])
        return F.array_sort(
            F.transform(spans, lambda y: F.struct(y["x"]["start"].alias("start"), y["x"]["rank"].alias("rank"), (-y["x"]["minus"]).alias("end")))
        )

    return let(base, merged)


def _names(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; `n_chars` follows, other columns stay."""
    model = learn(spans_table(docs))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def pieces(spans: Column, between) -> Column:
        """The stretches before the spans, each with its mark behind; spans inside an earlier one give none."""
        done = running(
            spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]),
            lambda at, s: F.when(s["start"] < at, F.lit("")).otherwise(F.concat(between(at, s["start"] - at), F.get(marks, s["rank"]))),
            "STRING",
        )
        end = F.aggregate(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]))
        return F.concat(F.array_join(done, ""), let(end, lambda e: between(e, F.length(text) - e)))

    def from_blocks(blocks: Column, size: Column):
        def between(at: Column, n: Column) -> Column:
            first = F.floor(at / size).cast("int")
            several = F.slice(blocks, first + 1, F.floor((at + n) / size).cast("int") - first + 1)
            return F.substring(F.array_join(several, ""), at - first * size + 1, n)

        return between

    def cut(spans: Column) -> Column:
        # a substring is found from the text's start, so a text with many spans is first taken apart into blocks
        by_place = pieces(spans, lambda at, n: F.substring(text, at + 1, n))

        def by_blocks(size: Column) -> Column:
            at = F.sequence(F.lit(0), F.floor(F.length(text) / size).cast("int"))
            blocks = F.transform(at, lambda k: F.substring(text, k * size + 1, size))
            return let(blocks, lambda b: pieces(spans, from_blocks(b, size)))

        size = F.greatest(F.lit(1024), F.ceil(F.length(text) / 256).cast("int"))
        return F.when(F.size(spans) <= FEW, by_place).otherwise(let(size, by_blocks))

    found = let(all_spans(base_spans(text), proposals(text), model), lambda s: F.when(F.size(s) > 0, cut(s)).otherwise(F.col("text")))
    # a column of its own first: next to a new column named text, the lambdas above would take their text from that one
    fresh = "redacted"
    while fresh in docs.columns:
        fresh += "_"
    out = docs.withColumn(fresh, found)
    changed = ~F.col("text").eqNullSafe(F.col(fresh))
    length = F.when(changed, F.length(fresh).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    new = {"text": F.col(fresh), "n_chars": length}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


@query("op5_personal_data")
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans_table(table(spark, sf_dir, "documents"))
    model = learn(found)

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    counts = [count(i) for i in range(len(KINDS))]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_names(F.col("base")), 256).alias("base_sha256"),
        _names(all_spans(F.col("base"), F.col("proposed"), model)).alias("spans"),
    )
