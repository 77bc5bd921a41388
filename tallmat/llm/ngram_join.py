"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct `WIDTH`-word shingles; documents with equal sets form a class, and the join is between
classes. In any order of shingles, two sets that share at least t of them share l or more within their prefixes of
n - t + l shingles. So a set whose prefix has fewer than l shingles in common with other sets has no partner.

1. In the order of the hashes, with l a tenth of the set, sets that fail this test go. What remains is copies, edited
   copies and texts built from common passages.
2. Among these the order is by document frequency, rarest first. Shingles of a single set count but are never joined.
   Each set chooses its own l: a longer prefix reads more postings but demands more shared shingles of a candidate, so l is
   where the postings read plus the expected candidates, each at the cost of comparing two sets, are fewest.
   A pair is a candidate if it shares at least the smaller l of the two.
3. Sets are linked to the most central set of their postings first (the one with the fewest shingles of its own), each to
   the one that it shares most prefix shingles with, and these links are confirmed on full sets. Repeated while it gains,
   this joins groups of copies in rows that grow with the postings. Candidates are then looked for between different
   components only, so no group is ever expanded into all its pairs, yet no link between components is missed.
   Two sets with many shingles of their own can't be similar: u_r + n_r of their union is private to r or in s, which
   gives 100 (n_r - u_r) >= 85 (n_r + u_s), and pairs that fail this are no candidates; nor are those whose parity signatures differ in too many bits. A set of a group of texts that share a
   template but not enough of it so finds no partner, without its pairs being looked at one by one.

Hot postings are salted: one side is dealt over blocks, the other copied to each; confirmation salts frequent partners.

Defined cases: fewer words than `WIDTH` make one shingle of the whole sequence; NULL, empty and blank texts have none and are
linked with nothing; rows with equal doc_id are versions of one document, and links of any of them count; empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallmat.llm.common import cut_lineage, query, stored, table, texts_of
from tallmat.llm.graph import components
from tallmat.llm.words import Words, as_long, lists, mix, slices, windows

WIDTH = 4
PERCENT = 85
# Rows of one posting (or partners of one set) that meet in a task.
BLOCK = 2048
# Reading a posting costs about as much as this many steps of comparing two sets.
READ = 3
# 64-bit words of a parity signature: each shingle flips one bit, so as many bits as two signatures differ in, as many
# shingles at least are in one set only.
PARITY = 8
# The first test asks for one shared shingle in so many. A smaller share reads shorter prefixes, but the more texts there
# are, the more sets share so few by chance and go on with all their shingles.
FIRST_SHARE = 10
# Another round of stars follows one in which more than one pair in GAIN was a link.
GAIN = 5


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and their number per text."""
    words = Words(texts, lower=True)
    x = words.hashes()
    grams = windows(x, width)
    counts = words.counts
    found = []
    for a, n in zip(words.first[:-1].tolist(), counts.tolist()):
        if n >= width:
            found.append(np.unique(grams[a : a + n - width + 1]))
        elif n:
            # a short sequence as one shingle, apart from all full ones
            found.append(mix(windows(x[a : a + n], n) ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            found.append(np.zeros(0, np.uint64))
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), sizes


def class_ids(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number per set, equal for equal sets; 0 for empty ones."""
    full = np.flatnonzero(sizes)
    out = np.zeros(len(sizes), np.uint64)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        first, second = np.add.reduceat(mix(values), starts), np.add.reduceat(mix(values ^ np.uint64(0xABCDEF)), starts)
        out[full] = mix(first ^ mix(second))
    return as_long(out)


def parities(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """PARITY words per set, one set after the other: the exclusive or of one bit per shingle."""
    out = np.zeros(len(sizes) * PARITY, np.uint64)
    place = mix(values ^ np.uint64(0x1234567)) % np.uint64(64 * PARITY)
    at = np.repeat(np.arange(len(sizes)) * PARITY, sizes) + (place >> np.uint64(6)).astype(np.int64)
    np.bitwise_xor.at(out, at, np.uint64(1) << (place & np.uint64(63)))
    return out


def required(n, percent: int):
    """The least intersection of a set of size n with any similar set."""
    return -(-(n * percent) // 100)


def _first_matches(n, percent: int):
    """l of the first test, at most the least intersection."""
    return np.minimum(1 + n // FIRST_SHARE, required(n, percent))


def _class_batches(batches: Iterator, width: int, percent: int) -> Iterator:
    for batch in batches:
        for part in slices(batch):
            values, sizes = shingle_sets(part.column("text"), width)
            starts = np.cumsum(sizes) - sizes
            # the least hashes of each set: its prefix in the order of the hashes
            length = np.where(sizes > 0, sizes - required(sizes, percent) + _first_matches(sizes, percent), 0)
            prefix = np.concatenate([values[a : a + p] for a, p in zip(starts.tolist(), length.tolist())] or [values])
            columns = [
                part.column("doc_id"), pa.array(sizes), pa.array(class_ids(values, sizes)), lists(as_long(prefix), length, pa.int64())
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "id", "prefix"])


def _shingle_batches(batches: Iterator, width: int) -> Iterator:
    for batch in batches:
        for part in slices(batch):
            values, sizes = shingle_sets(part.column("text"), width)
            ids = np.repeat(part.column("id").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(as_long(values))], names=["id", "h"])


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    values, sizes = shingle_sets(texts, width)
    return np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(x) + len(y)
    shared = both - len(np.unique(np.concatenate([x, y])))
    return shared > 0 and 100 * shared >= percent * (both - shared)


def _confirm_batches(batches: Iterator, width: int, percent: int) -> Iterator:
    for batch in batches:
        for part in slices(batch, "ta", 1 << 20):
            x, y = _sets(part.column("ta"), width), _sets(part.column("tb"), width)
            keep = pa.array([similar(p, q, percent) for p, q in zip(x, y)], pa.bool_())
            yield part.select(["a", "b"]).filter(keep)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. Texts of frequent partners are copied to several salts."""
    fan = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("fan"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("tb")).join(fan, "b")
    b = b.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("fan") - 1))).select("b", "salt", "tb")
    salted = pairs.join(fan, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("fan")).cast("int"))
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    rows = salted.select("a", "b", "salt").join(a, "a").join(b, ["b", "salt"]).select("a", "b", "ta", "tb")
    return cut_lineage(rows.mapInArrow(lambda batches: _confirm_batches(batches, width, percent), "a LONG, b LONG"))


def choose_matches(frequency: np.ndarray, n: int, u: int, percent: int) -> int:
    """The l of least cost for a set of n shingles, u of them its own, the others with these ascending frequencies.

    Reading the prefix costs its postings; a candidate needs l of them, so there are at most postings / l, each compared in
    about n steps.
    """
    most = required(n, percent)
    base = n - most - u
    reads = np.concatenate([[0], np.cumsum(frequency - 1)])
    matches = np.arange(1, most + 1)
    postings = reads[np.clip(base + matches, 0, len(frequency))]
    return int(matches[np.argmin(READ * postings + n * (postings / matches))])


def _posting_batches(batches: Iterator, percent: int) -> Iterator:
    for batch in batches:
        out = []
        for r in range(batch.num_rows):
            shared = batch.column("shared")[r].values
            f, h = shared.field("f").to_numpy(), shared.field("h").to_numpy()
            n, u = batch.column("n")[r].as_py(), batch.column("u")[r].as_py()
            matches = choose_matches(f, n, u, percent)
            take = n - required(n, percent) - u + matches
            if take > 0:
                out.append((np.full(take, batch.column("id")[r].as_py()), h[:take], np.full(take, n), np.full(take, u), np.full(take, matches)))
        if out:
            columns = [pa.array(np.concatenate(c)) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "n", "u", "l"])


def survivors(classes: DataFrame, percent: int) -> DataFrame:
    """Sets that pass the first test: enough shingles of their hash-order prefix occur in other sets.

    The least partner of a set of n shingles has t(n); what the two share in any case follows from that one's l.
    """
    tokens = classes.select("id", F.explode("prefix").alias("h"))
    own = tokens.groupBy("h").agg(F.count("*").alias("f"), F.min("id").alias("id")).where("f = 1").groupBy("id").agg(F.count("*").alias("own"))

    def t(n: Column) -> Column:
        return F.ceil(n * percent / F.lit(100))

    partner = t(F.col("n"))
    matches = F.least(1 + F.floor(partner / FIRST_SHARE), t(partner))
    shared = F.size("prefix") - F.coalesce("own", F.lit(0))
    return classes.join(own, "id", "left").where(shared >= matches).select("id", "doc_id", "n")


def postings(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(h, id, n, u, l): the adaptive prefixes of the sets of texts(id, n, text) without the shingles of single sets."""
    tokens = texts.select("id", "text").mapInArrow(lambda batches: _shingle_batches(batches, width), "id LONG, h LONG")
    # dealt by shingle once, for the counts and for the join; a set has a shingle once, so two sets have a frequent one
    tokens = stored(tokens, "shingles").repartition("h")
    counts = tokens.groupBy("h").agg(F.count("*").alias("f"), F.min("id").alias("x"), F.max("id").alias("y"))
    frequent = counts.where("x < y").select("h", "f")
    shared = tokens.join(frequent, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("shared"))
    sets = texts.select("id", "n").join(shared, "id").withColumn("u", F.col("n") - F.size("shared"))
    # the rarest n - t + l shingles hold all own ones; with none left there is no partner
    some = sets.where(F.col("u") * 100 <= F.col("n") * (100 - percent))
    rows = some.mapInArrow(lambda batches: _posting_batches(batches, percent), "id LONG, h LONG, n LONG, u LONG, l LONG")
    return stored(rows, "postings")


def _fits(r: str, s: str, percent: int) -> Column:
    """Sizes and own shingles allow the similarity."""
    n, u, m, v = (F.col(f"{side}.{c}") for side in (r, s) for c in ("n", "u"))
    near = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (100 * (n - u) >= percent * (n + v))
    return near & (100 * (m - v) >= percent * (m + u))


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("root", F.col("id"))
    return rows.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Postings of more than one component, with their number of rows."""
    same = Window.partitionBy("h")
    found = rows.withColumns({"size": F.count("*").over(same), "x": F.min("root").over(same), "y": F.max("root").over(same)})
    return found.where("x < y").drop("x", "y")


def star_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """At most one pair per set: with the central set, of another component, that it shares most postings with.

    Centres of a posting are its set with the least share of own shingles, and the best one of another component.
    """
    rank = F.struct((F.col("u") / F.col("n")).alias("share"), "id", "root", "n", "u")
    centres = rows.groupBy("h", "root").agg(F.min(rank).alias("c"))
    # ranks of two components are enough: every set is outside one of them
    best = centres.groupBy("h").agg(F.min("c").alias("first"))
    second = centres.join(best, "h").where(F.col("root") != F.col("first.root")).groupBy("h").agg(F.min("c").alias("second"))
    both = best.join(second, "h")
    found = rows.join(both, "h").withColumn("c", F.when(F.col("root") == F.col("first.root"), F.col("second")).otherwise(F.col("first")))
    r = found.select("id", F.struct("n", "u").alias("r"), F.col("c").alias("s")).where(_fits("r", "s", percent))
    counted = r.groupBy("id", F.col("s.id").alias("other")).agg(F.count("*").alias("times"))
    top = counted.groupBy("id").agg(F.max(F.struct("times", (-F.col("other")).alias("minus"))).alias("t"))
    return top.select(F.col("id").alias("a"), (-F.col("t.minus")).alias("b"))


def _parity_fits(percent: int) -> Column:
    """At most as many shingles lie in one of the two sets only as the similarity allows."""
    bits = sum((F.bit_count(F.col("r.parity")[k].bitwiseXOR(F.col("s.parity")[k])) for k in range(PARITY)), F.lit(0))
    return (100 + percent) * bits <= (100 - percent) * (F.col("r.n") + F.col("s.n"))


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share at least the smaller l of their prefixes; rows have parities, too."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    here = F.struct("id", "n", "u", "l", "root", "parity")
    left = rows.select("h", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), here.alias("r"))
    right = rows.select("h", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), here.alias("s"))
    met = left.join(right, ["h", "block"]).where((F.col("r.id") < F.col("s.id")) & (F.col("r.root") != F.col("s.root")) & _fits("r", "s", percent) & _parity_fits(percent))
    counted = met.groupBy(F.col("r.id").alias("a"), F.col("s.id").alias("b")).agg(
        F.count("*").alias("times"), F.min(F.least("r.l", "s.l")).alias("least")
    )
    return counted.where("times >= least").select("a", "b")


def linked(texts: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, root) of the sets of texts(id, n, text, parity) that have a link."""
    rows = postings(texts, width, percent)
    labels, links, gain = None, None, True
    while gain:
        mixed = _mixed(_labelled(rows, labels))
        pairs = cut_lineage(star_pairs(mixed, percent))
        more = confirmed(pairs, texts, width, percent)
        n_more = more.count()
        gain = GAIN * n_more > pairs.count()
        if n_more:
            links = more if links is None else links.unionByName(more)
            labels = cut_lineage(components(links))
    mixed = cut_lineage(_mixed(_labelled(rows, labels)).join(texts.select("id", "parity"), "id"))
    rest = cut_lineage(candidates(mixed, percent))
    more = confirmed(rest, texts, width, percent)
    return components(more if links is None else links.unionByName(more))


def _own_batches(batches: Iterator, width: int) -> Iterator:
    """Rows whose text is the one of the class they were joined with."""
    for batch in batches:
        for part in slices(batch):
            values, sizes = shingle_sets(part.column("text"), width)
            own = pa.array(class_ids(values, sizes) == part.column("id").to_numpy())
            parity = lists(as_long(parities(values, sizes)), np.full(len(sizes), PARITY), pa.int64())
            columns = [part.column("id"), part.column("n"), part.column("text"), parity]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "text", "parity"]).filter(own)


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document row."""
    texts = texts_of(docs)
    sketched = stored(
        texts.mapInArrow(
            lambda batches: _class_batches(batches, width, percent), "doc_id LONG, n LONG, id LONG, prefix ARRAY<LONG>"
        ),
        "classes",
    )
    full = sketched.where("n > 0")
    classes = full.groupBy("id").agg(F.min(F.struct("doc_id", "n", "prefix")).alias("one")).select("id", "one.*")
    alive = stored(survivors(classes, percent), "survivors")
    # versions of one document differ in their number of shingles or in their class; the class is found again by its set
    chosen = texts.join(alive, "doc_id")
    chosen = stored(chosen.mapInArrow(lambda batches: _own_batches(batches, width), "id LONG, n LONG, text STRING, parity ARRAY<LONG>").dropDuplicates(["id"]), "texts")
    found = linked(chosen, width, percent)
    # versions of a document join its classes
    several = full.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("y")).where("b < y").select("doc_id", "b")
    versions = full.join(several, "doc_id").where("id > b").select(F.col("id").alias("a"), "b").distinct()
    if not versions.isEmpty():
        found = components(found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(versions))
    root = F.coalesce("root", "id")
    rooted = sketched.select("doc_id", "n", "id").join(found, "id", "left").select("doc_id", "n", F.when(F.col("n") > 0, root).alias("root"))
    # a version without words lies where the others do
    rooted = stored(rooted.withColumn("root", F.max("root").over(Window.partitionBy("doc_id"))), "rooted")
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def _oracle(width: int = WIDTH, percent: int = PERCENT) -> str:
    upper = "".join(map(chr, range(65, 91)))
    grams = f"list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' '))"
    return f"""WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE {grams} END)) AS g
  FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {percent} * (nx.n + ny.n - c)),
f AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT f.y, r.root FROM r JOIN f ON f.x = r.doc_id WHERE r.root < f.y)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = w.doc_id"""


@query("op11_ngram_jaccard_join", _oracle())
def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
