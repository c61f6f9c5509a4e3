"""What filters remove together and apart: each document's failures as a mask, counted by part, for every order of the filters."""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import save, shuffle_partitions

LETTERS = "ABCDE"
CAPITALS = bytes(range(65, 91))
MARKS = b"#$%&*|"
#: Bytes of UTF-8 that go on with a code point.
INSIDE_POINTS = bytes(range(0x80, 0xC0))
#: Bit of the filter for repeated texts.
COPY = 1 << LETTERS.index("E")
#: Bytes of different texts that a task holds before it passes them on.
CHAIN_BYTES = 32 << 20
#: Bytes that a link has besides its text, about.
LINK_BYTES = 500
#: Bytes of text for which there is a partition of fingerprints.
ROUTED_BYTES = 16 << 20
#: What a vector counts for each mask: documents, those labelled good, those labelled toxic.
COUNTS = 3


def failures(text: bytes) -> int:
    """Mask of the filters A to D that a text fails: under 200 words; fewer than half of the words differ; over 2% capitals; a mark from MARKS.

    Words end at ASCII blanks and the controls from tab to carriage return, which
    are what bytes.split() splits at. An empty text fails A alone.
    """
    words = text.split()
    points = len(text.translate(None, INSIDE_POINTS))
    few = len(words) < 200
    alike = 100 * len(set(words)) < 50 * len(words)
    loud = 100 * (len(text) - len(text.translate(None, CAPITALS))) > 2 * points
    marked = len(text) != len(text.translate(None, MARKS))
    return few | alike << 1 | loud << 2 | marked << 3


@dataclass
class Link:
    """A text, the smallest id that has it, how many rows of each part have that id, and what A to D say."""

    text: bytes
    doc_id: int
    rows: dict[str, int]
    mask: int


class Chains:
    """Different texts by fingerprint: a chain of links for each, as texts may share one."""

    def __init__(self):
        self.by_print: dict[int, list[Link]] = {}
        self.bytes = 0

    def add(self, fingerprint: int, text: bytes, doc_id: int, rows: dict[str, int], mask: int | None = None) -> Iterator[tuple[int, str, int, int]]:
        """Take rows of one id and text in; yield (doc_id, part, mask, rows) of those that turn out not to have the smallest id."""
        chain = self.by_print.setdefault(fingerprint, [])
        link = next((x for x in chain if x.text == text), None)
        if link is None:
            chain.append(Link(text, doc_id, dict(rows), failures(text) if mask is None else mask))
            self.bytes += len(text) + LINK_BYTES
            return
        if doc_id == link.doc_id:
            for part, n in rows.items():
                link.rows[part] = link.rows.get(part, 0) + n
            return
        if doc_id < link.doc_id:
            link.doc_id, link.rows, doc_id, rows = doc_id, dict(rows), link.doc_id, link.rows
        for part, n in rows.items():
            yield doc_id, part, link.mask | COPY, n

    def links(self) -> Iterator[tuple[int, Link]]:
        return ((fingerprint, link) for fingerprint, chain in self.by_print.items() for link in chain)


def routed_masks(docs: DataFrame, parts: str = "source") -> RDD:
    """RDD of (doc_id, part, mask, rows): which filters each document fails, one of them being identical to the text of a smaller doc_id.

    A task first chains its own texts, so of many copies it passes on one, with
    the smallest id; those that aren't are done with and pass through. The rest
    are partitioned by xxhash of the text, where chains hold the whole texts, so
    that texts which share a fingerprint stay apart. A task passes its chains on
    when they hold CHAIN_BYTES, and there is a partition for each ROUTED_BYTES of
    text.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(parts).cast("string"), F.lit("")), F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    routes = max(shuffle_partitions(docs.sparkSession), size // ROUTED_BYTES + 1)

    def local(each):
        chains = Chains()
        for doc_id, part, text in each:
            text = bytes(text)
            fingerprint = xxhash.xxh3_64_intdigest(text)
            if doc_id is None:  # no id is smaller than none, and none is smaller than an id
                yield fingerprint, (None, part, failures(text), 1)
                continue
            yield from ((xxhash.xxh3_64_intdigest(str(done[0])), done) for done in chains.add(fingerprint, text, doc_id, {part: 1}))
            if chains.bytes >= CHAIN_BYTES:
                yield from chains.links()
                chains = Chains()
        yield from chains.links()

    def routed(each):
        chains = Chains()
        for fingerprint, found in each:
            if isinstance(found, Link):
                yield from chains.add(fingerprint, found.text, found.doc_id, found.rows, found.mask)
            else:
                yield found
        for _, link in chains.links():
            yield from ((link.doc_id, part, link.mask, n) for part, n in link.rows.items())

    return rows.rdd.mapPartitions(local).partitionBy(routes, lambda fingerprint: fingerprint % routes).mapPartitions(routed)


def mask_counts(docs: DataFrame, labels: DataFrame, parts: str = "source") -> RDD:
    """RDD of (part, vector): for each mask the documents that fail exactly its filters, those labelled quality = 1 and those labelled toxic = 1.

    Vectors of tasks are merged by combineByKey, one of 96 numbers for each part.
    A document with several labels counts as good, or toxic, if one of them says
    so. Documents without id have no label.
    """
    # a doc_id that many rows share, or none, is a few rows here before it meets its labels
    masks = document_masks(docs, parts).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    joined = masks.join(known, F.col("doc_id") == F.col("_doc"), "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def add(vector, row):
        mask, n, good, toxic = row
        at = mask * COUNTS
        vector[at], vector[at + 1], vector[at + 2] = vector[at] + n, vector[at + 1] + n * good, vector[at + 2] + n * toxic
        return vector

    merge = lambda a, b: [x + y for x, y in zip(a, b)]
    pairs = joined.rdd.map(lambda r: (r[0], tuple(r[1:])))
    return pairs.combineByKey(lambda row: add([0] * (COUNTS << len(LETTERS)), row), add, merge)


def document_masks(docs: DataFrame, parts: str = "source") -> DataFrame:
    """(doc_id, part, mask, n): how many rows of a doc_id and part fail exactly the filters of the mask; written to the shared folder."""
    return save(docs.sparkSession.createDataFrame(routed_masks(docs, parts), "doc_id long, part string, mask int, n long", verifySchema=False), "masks")


STEP = "filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interaction(counts: RDD) -> DataFrame:
    """A row for each part, order of the filters and step, zeros included: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    All follow from the counts of a part's 32 masks. A filter's shapley is what
    it removes, added up over all orders: of the documents with a mask, each of
    the mask's filters removes as many in all orders together.
    """
    orders = list(permutations(range(len(LETTERS))))

    def steps(part_vector):
        part, vector = part_vector
        of = [vector[COUNTS * m : COUNTS * m + COUNTS] for m in range(1 << len(LETTERS))]
        total = lambda k, wanted: sum(of[m][k] for m in range(len(of)) if wanted(m))
        shapley = [sum(of[m][0] * len(orders) // m.bit_count() for m in range(1, len(of)) if m >> f & 1) for f in range(len(LETTERS))]
        for order in orders:
            name, before = "".join(LETTERS[f] for f in order), 0
            for step, f in enumerate(order, 1):
                bit = 1 << f
                here = lambda m, before=before, bit=bit: m & bit and not m & before
                yield part, name, step, total(0, lambda m: not m & (before | bit)), total(0, here), total(0, lambda m: m & bit and m & before), of[bit][0], total(1, here), total(2, here), shapley[f]
                before |= bit

    return counts.flatMap(steps).toDF("part string, " + STEP)


def filter_audit(docs: DataFrame, labels: DataFrame, parts: str = "source") -> DataFrame:
    """The interaction of the five filters on docs (doc_id, text and the column of parts), with labels (doc_id, quality, toxic).

    A null text is empty, a null part is the empty string. Rows that repeat an id
    and text count each, and none is a copy of the other; a row without id is no
    copy and has none. An empty table gives no row.
    """
    return save(interaction(mask_counts(docs, labels, parts)), "audit")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS first FROM docs GROUP BY t
), masks AS (
  SELECT d.doc_id, d.part,
    (len(w) < 200)::INTEGER + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INTEGER + 4 * (100 * len(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 2 * length(d.t))::INTEGER
    + 8 * regexp_matches(d.t, '[#$%&*|]')::INTEGER + 16 * coalesce(d.doc_id > f.first, false)::INTEGER AS mask
  FROM docs d JOIN firsts f ON d.t = f.t
), known AS (
  SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM masks m LEFT JOIN known k ON m.doc_id = k.doc_id GROUP BY 1, 2
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, s::INTEGER AS step, bits[s]::INTEGER AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INTEGER AS before FROM orders, range(1, 6) r(s)
), shapley AS (
  SELECT part, bit, sum(CASE WHEN mask & bit > 0 THEN n * 120 // bit_count(mask) ELSE 0 END)::BIGINT AS shapley FROM counts, letters GROUP BY 1, 2
)
SELECT c.part, s.filter_order, s.step,
  sum(CASE WHEN mask & (before | s.bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & s.bit > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & s.bit > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = s.bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & s.bit > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & s.bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  max(p.shapley) AS shapley
FROM counts c, steps s JOIN shapley p ON p.bit = s.bit AND p.part = c.part GROUP BY 1, 2, 3
"""
