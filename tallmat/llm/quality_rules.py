"""Quality rules: distance of a document's character and word histograms from those of known languages.

Rules on words, lines and repeated windows reject a document outright. The others are compared with one reference per
language: the share of each character class and of each common word among all characters and words of the documents
marked with that language. A document goes when its Jensen-Shannon distance from the nearest reference exceeds a limit,
and only when it is long enough for its histogram to mean something.

Documents of the languages of `LANGUAGES` are compared with these. Any other language found in `lang` gets a reference
of its own, with the most frequent words of all its documents in place of the fixed list; its documents are compared
with that one as well. The SQL counterpart describes tables that hold the languages of `LANGUAGES` alone.

Everything is a DataFrame expression. One pass computes the counts of every document and stores them; the references
are sums over that table, one row per language. Those of other languages stay a table and are joined.

Defined cases: a NULL or empty text has no words and fails the rules; for a document without a language, or whose other
language has no reference, and with no reference at all (empty table), the rules alone decide; repeated rows are judged
alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallmat.llm.common import query, stored, table

WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5

# fixed values: frequent function words of each language
LANGUAGES = {
    "en": "the of and to in a is that for was",
    "de": "der die und in den von zu das mit ist",
    "fr": "de la le et les des en un du que",
    "es": "de la que el en y los del se las",
}
COMMON = sorted({w for words in LANGUAGES.values() for w in words.split()})
# character classes, as regular expression classes; white space makes one more, and what is left over another
CLASSES = ["A-Z", "0-9", r".,;:!?'\"()-", r"#*$%&|<>\[\]{}=_+/@^~`\\", r"\x{80}-\x{10FFFF}"]

# Limits of the distances (square root of the base-2 divergence, 0 to 1), and the lengths they need.
MAX_CHAR_DISTANCE = 0.25
MIN_CHARS = 200
MAX_WORD_DISTANCE = 0.31
MIN_COMMON_WORDS = 80
# Common words of a language outside LANGUAGES: so many, each at least one in so many of all its words.
OWN_WORDS = 10
OWN_ONE_IN = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(places: Column) -> Column:
    """Words covered by windows that start at these places."""
    return let(
        F.array_sort(places),
        lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get(p, k - 1)))),
            F.lit(0),
            lambda total, x: total + x,
        ),
    )


def _repeated(grams: Column) -> Column:
    """Words in windows found twice or more: equal windows (by 64-bit hash) are neighbours once sorted."""
    ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def places(s: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            before = F.when(k > 0, F.get(s, k - 1)["g"] == x["g"])
            return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False))

        return F.transform(F.filter(s, twice), lambda x: x["i"])

    return _covered(let(ordered, places))


def _repeat_words(words: Column) -> Column:
    def count(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        found = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_repeated(g)))
        return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(found)

    return let(words, count)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SEPARATORS, "") != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _other(lang: Column) -> Column:
    return ~lang.isin(list(LANGUAGES))


def _own_words(base: DataFrame) -> DataFrame:
    """(lang, own_words): the most frequent words of every language outside `LANGUAGES`."""
    words = base.where(_other(F.col("lang"))).select("lang", F.explode("words").alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    # at most OWN_ONE_IN words of a language are left for the window
    frequent = counted.join(total, "lang").where(OWN_ONE_IN * F.col("n") >= F.col("total"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    first = frequent.withColumn("rank", rank).where(F.col("rank") <= OWN_WORDS)
    return first.groupBy("lang").agg(F.sort_array(F.collect_list("word")).alias("own_words"))


def _whole(docs: DataFrame, wanted: bool) -> list[Column]:
    return [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")] * wanted


def measured(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Per row: doc_id, lang, a hash of the text, the counts of the rules, `chars` by class and `common` by word; the row itself if `whole`.

    Where the table holds languages outside `LANGUAGES`, also `own`: counts of the common words of that language.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"), *_whole(docs, whole))
    base = base.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))

    others = not docs.where(_other(F.col("lang").cast("string"))).isEmpty()
    if others:
        base = base.join(_own_words(base), "lang", "left")

    def histogram(found: Column) -> Column:
        return F.array(*[F.size(found) - F.size(F.array_remove(found, w)) for w in COMMON])

    inside = [F.length(F.regexp_replace("text", f"[^{c}]+", "")) for c in CLASSES]
    spaces = F.length("text") - F.length(F.translate("text", SEPARATORS, ""))
    counts = base.select(
        "doc_id",
        "lang",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _dup_lines(F.col("text")).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.length("text").cast("long").alias("n_chars"),
        F.array(spaces, *inside).alias("chars"),
        let(F.filter("words", lambda w: w.isin(COMMON)), histogram).alias("common"),
        *[F.transform("own_words", lambda o: F.size("words") - F.size(F.array_remove("words", o))).alias("own")] * others,
        *["whole"] * whole,
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return counts.withColumn("base_failed", failed)


def references(counts: DataFrame) -> list[tuple[list[float], list[float]]]:
    """(character shares, word shares) of every known language: one row per language comes to the driver."""
    n_classes, n_common = len(CLASSES) + 1, len(COMMON)
    sums = (
        counts.where(F.col("lang").isin(list(LANGUAGES)) & ~F.col("base_failed"))
        .groupBy("lang")
        .agg(
            F.sum("n_chars").alias("n_chars"),
            F.sum("n_words").alias("n_words"),
            *[F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(n_classes)],
            *[F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(n_common)],
        )
        .orderBy("lang")
        .collect()
    )
    found = []
    for r in sums:
        chars = [r[f"c{i}"] for i in range(n_classes)]
        words = [r[f"w{i}"] for i in range(n_common)]
        chars.append(r["n_chars"] - sum(chars))
        words.append(r["n_words"] - sum(words))
        found.append(([c / r["n_chars"] for c in chars], [w / r["n_words"] for w in words]))
    return found


def _own_references(counts: DataFrame) -> DataFrame:
    """(lang, own_chars, own_common): shares of every language outside `LANGUAGES`."""

    def shares(column: str, size: int, total: str) -> Column:
        sums = F.filter(F.array(*[F.sum(F.get(column, F.lit(i))) for i in range(size)]), lambda x: x.isNotNull())
        every = F.sum(total)
        rest = let(sums, lambda x: F.concat(x, F.array(every - F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v))))
        return F.transform(rest, lambda x: x / every)

    accepted = counts.where(_other(F.col("lang")) & ~F.col("base_failed"))
    return accepted.groupBy("lang").agg(
        shares("chars", len(CLASSES) + 1, "n_chars").alias("own_chars"), shares("own", OWN_WORDS, "n_words").alias("own_common")
    )


def js_distance(counts: Column, total: Column, rest: bool, reference: list[float] | Column) -> Column:
    """Jensen-Shannon distance of a histogram from a reference; `rest` adds the class of what is not counted."""

    def part(p: Column, q: Column) -> Column:
        middle = (p + q) / 2
        term = lambda x: F.when(x > 0, x * F.log2(x / middle)).otherwise(F.lit(0.0))
        return (term(p) + term(q)) / 2

    shares = F.transform(counts, lambda c: c / total)
    if rest:
        shares = let(shares, lambda s: F.concat(s, F.array(1.0 - F.aggregate(s, F.lit(0.0), lambda a, x: a + x))))
    shares = F.transform(shares, lambda s: F.greatest(s, F.lit(0.0)))
    if not isinstance(reference, Column):
        reference = F.array(*[F.lit(float(q)) for q in reference])
    parts = F.zip_with(shares, reference, part)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


def judged(counts: DataFrame) -> DataFrame:
    """Adds char_distance, word_distance (NULL where the document is too short) and kept."""
    found = references(counts)

    others = "own" in counts.columns
    out = counts.join(_own_references(counts), "lang", "left") if others else counts

    def nearest(which: int, column: str, total: str, long_enough: Column, own: str) -> Column:
        distances = [js_distance(F.col(column), F.col(total), True, r[which]) for r in found]
        least = F.array_min(F.array(*distances)) if distances else F.lit(None).cast("double")
        if others:
            mine = js_distance(F.col(own), F.col(total), True, F.col(f"own_{column}"))
            least = F.when(_other(F.col("lang")), F.when(mine.isNotNull(), F.least(mine, least))).otherwise(least)
        return F.when(long_enough & F.col("lang").isNotNull(), least)

    out = out.withColumn("char_distance", nearest(0, "chars", "n_chars", F.col("n_chars") >= MIN_CHARS, "chars"))
    out = out.withColumn("word_distance", nearest(1, "common", "n_words", F.col("n_words") >= MIN_COMMON_WORDS, "own"))
    out = out.drop("own_chars", "own_common")
    close = (F.coalesce(F.col("char_distance"), F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (
        F.coalesce(F.col("word_distance"), F.lit(0.0)) <= MAX_WORD_DISTANCE
    )
    return out.withColumn("kept", ~F.col("base_failed") & close)


def quality(docs: DataFrame) -> DataFrame:
    return judged(stored(measured(docs), "quality"))


def _sql() -> str:
    """The same rows in SQL, from the same lists and limits."""
    classes = "length(regexp_replace(t, '[^\\x20\\x09-\\x0D]+', '', 'g')), " + ", ".join(
        f"length(regexp_replace(t, '[^{c.replace(chr(39), chr(39) * 2)}]+', '', 'g'))" for c in CLASSES
    )
    common = ", ".join(f"len(list_filter(w, lambda x: x = '{c}'))" for c in COMMON)
    languages = ", ".join(f"'{c}'" for c in LANGUAGES)

    def distance(column: str) -> str:
        return f"""
            SELECT rid, min(d) AS d FROM (
              SELECT p.rid, r.lang, sqrt(greatest(0.0, sum(
                (CASE WHEN p.v > 0 THEN p.v * log2(2 * p.v / (p.v + r.v)) ELSE 0 END
                 + CASE WHEN r.v > 0 THEN r.v * log2(2 * r.v / (p.v + r.v)) ELSE 0 END) / 2))) AS d
              FROM {column}_shares p JOIN {column}_reference r USING (k) GROUP BY ALL) GROUP BY rid"""

    def shares(column: str, total: str) -> str:
        return f"""
        {column}_counts AS (
          SELECT rid, lang, base_failed, {total} AS n, unnest({column}) AS c, generate_subscripts({column}, 1) AS k FROM f
          UNION ALL SELECT rid, lang, base_failed, {total}, {total} - list_sum({column}), 0 FROM f),
        {column}_shares AS (SELECT rid, k, c / n AS v FROM {column}_counts WHERE n > 0),
        {column}_reference AS (
          SELECT lang, k, sum(c) / sum(n) AS v FROM {column}_counts
          WHERE lang IN ({languages}) AND NOT base_failed GROUP BY lang, k),
        {column}_distance AS ({distance(column)})"""

    return f"""
      WITH d AS (
        SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
          regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
      g AS (
        SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS gram
        FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
      covered AS (
        SELECT rid, count(DISTINCT i + o) AS n
        FROM (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
          range({WINDOW}) AS r(o) GROUP BY rid),
      m AS (
        SELECT rid, doc_id, lang, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS word_chars,
          length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
          list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
          coalesce(covered.n, 0)::BIGINT AS n_repeat_words, length(t) AS n_chars, [{classes}] AS chars, [{common}] AS common
        FROM d LEFT JOIN covered USING (rid)),
      f AS (
        SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m),
      {shares("chars", "n_chars")},
      {shares("common", "n_words")}
      SELECT doc_id, n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed
          AND (n_chars < {MIN_CHARS} OR coalesce(chars_distance.d, 0) <= {MAX_CHAR_DISTANCE})
          AND (n_words < {MIN_COMMON_WORDS} OR coalesce(common_distance.d, 0) <= {MAX_WORD_DISTANCE}) AS kept
      FROM f LEFT JOIN chars_distance USING (rid) LEFT JOIN common_distance USING (rid)"""


def accepted(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    # rows are stored beside their counts, so the verdict needs no join
    return judged(stored(measured(docs, whole=True), "quality")).where("kept").select("whole.*")


@query("op6_quality_rules", _sql())
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
