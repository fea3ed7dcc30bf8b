"""Long exact spans that stand verbatim in more than one record.

Method: a log-structured index of window fingerprints. Of every ``span`` consecutive characters at least one *anchor* of
``span // 2`` characters is chosen by content alone (the smallest hash among those that the span holds, ties included), so
two records that share a span share its anchors. Each batch of records adds one immutable run of its anchors, sorted and
bucketed by hash; it is merge-joined with the runs of earlier batches, whose buckets are not shuffled again. Anchors seen
in two records are *candidates*. Runs of one level are compacted into one of the next when there are ``fanout`` of them.
Verification looks at the candidates' surroundings only and compares fingerprints of 126 bits, in two steps: a polynomial modulo 2^64 and two modulo a
prime, which texts of a structure that defeats the first (such as Thue-Morse words) don't defeat. A *block*, from a candidate on,
holds all spans that begin before the next anchor at the latest; blocks found in two records confirm the inside of long passages by
one fingerprint an anchor. Then every whole span around the candidates gets a fingerprint, but of a confirmed block only those of one record,
which stand for all others and are marked as found more than once. The confirmed pieces are united to covered positions. No
pairs of records are formed, and the inside of a passage that stands in a third of all records is looked at once. Common blocks are
counted with map-side combination and stored, then joined to the blocks as one plain shuffle to another, so that adaptive execution
can split a block that a third of all records have. The fingerprints of spans are far more, so they are shuffled once and judged where they
meet: a task settles what two of its own records share, sends it as ranges of places, and of each such fingerprint one row for all, so
a fingerprint that a third of all records have gathers few of their rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provq.runtime import Workspace, stored_bytes

#: Odd multipliers of the polynomial hashes modulo 2^64 and of their mixing.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
#: A prime and two bases below it.
PRIME, PRIME_BASES = (1 << 31) - 1, (1_103_515_245, 1_597_334_677)
#: Characters of which a bucket of the index holds the anchors, and buckets at most.
BUCKET_CHARS, MOST_BUCKETS = 150_000_000, 50_000
#: Characters that are hashed at once; longer texts are cut into slices that overlap by a span less one.
SLICE = 400_000
#: Candidate lists up to this stored size are broadcast to the scan of the texts, larger ones are joined by a shuffle.
BROADCAST_BYTES = 8 << 20

_tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if (which, size) not in _tables:
        b = BASES[which]
        _tables[which, size] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (b, pow(b, -1, 1 << 64)))
    p, q = _tables[which, size]
    return p[:n], q[:n]


def window_hashes(points: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of every ``length`` consecutive code points; never 0."""
    n = len(points)
    if n < length:
        return np.empty(0, np.uint64)
    v = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX[which])
    v ^= v >> np.uint64(31)
    p, q = _powers(which, n)
    c = np.empty(n + 1, np.uint64)
    c[0] = 0
    np.cumsum(v * p, out=c[1:])
    h = (c[length:] - c[:-length]) * q[: n - length + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(MIX[1 - which])
    h ^= h >> np.uint64(29)
    return h | np.uint64(1)


_prime_tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}


def _prime_powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the bases and of their inverses modulo the prime."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _prime_tables:
        tables = []
        for base in PRIME_BASES:
            pair = []
            for b in (base, pow(base, -1, PRIME)):
                p = np.ones(1, np.uint64)
                while len(p) < size:
                    p = np.concatenate([p, p * np.uint64(pow(b, len(p), PRIME)) % np.uint64(PRIME)])
                pair.append(p)
            tables.append(tuple(pair))
        _prime_tables[size] = tables
    return _prime_tables[size]


def prime_hashes(points: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the ``length`` code points from each place on: two polynomials modulo a prime, side by side."""
    v, prime, out = points.astype(np.uint64) + np.uint64(1), np.uint64(PRIME), np.zeros(len(at), np.uint64)
    for powers, inverses in _prime_powers(len(points)):
        c = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(v * powers[: len(v)] % prime, out=c[1:])
        h = (c[at + length] - c[at]) % prime * inverses[at] % prime
        out = out << np.uint64(31) | h
    return out


def _sliding(a: np.ndarray, width: int, f) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        a = f(a[:-size], a[size:])
        size *= 2
    return f(a[: len(a) - (width - size)], a[width - size :]) if width > size else a


def anchors(points: np.ndarray, ends: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of several texts, laid end to end, whose ends (exclusive) are given."""
    h = window_hashes(points, gram)
    width = span - gram + 1
    if len(h) < width:
        return np.empty(0, np.int64), h[:0]
    least = _sliding(h, width, np.minimum)  # by the start of a span
    bad = np.zeros(len(least) + 1, np.int32)  # spans that run over the end of their text
    np.add.at(bad, np.clip(ends - span + 1, np.concatenate([[0], ends[:-1]]), len(least)), 1)
    np.add.at(bad, np.minimum(ends, len(least)), -1)
    least[np.cumsum(bad[:-1]) > 0] = 0
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == h)
    return at, h[at]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _slices(text: str, span: int) -> Iterator[tuple[int, np.ndarray]]:
    whole = _points(text)
    for s in range(0, max(1, len(whole) - span + 1), SLICE):
        yield s, whole[s : s + SLICE + span - 1]


def _anchor_rows(span: int, gram: int):
    def flush(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        lens = np.array([len(p) for _, _, p in held])
        ends = np.cumsum(lens)
        at, h = anchors(np.concatenate([p for _, _, p in held]), ends, span, gram)
        i = np.searchsorted(ends, at, side="right")
        ids, offsets = np.array([d for d, _, _ in held], np.int64), np.array([o for _, o, _ in held], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[i]), pa.array(at - (ends - lens)[i] + offsets[i])], ["h", "doc", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for offset, points in _slices(text, span):
                    held.append((doc, offset, points))
                    size += len(points)
                    if size >= SLICE:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    return run


def _marks(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of the places 0 to n - 1, those within any range first to last (inclusive)."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, np.clip(first, 0, n), 1)
    np.add.at(mark, np.clip(last + 1, 0, n), -1)
    return np.cumsum(mark[:-1]) > 0


def _gathered(rows: Iterator[tuple[int, np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    """(record, columns) -> the record and the columns, of a bounded number of rows at once."""

    def flush() -> list[np.ndarray]:
        return [np.repeat([doc for doc, *_ in held], [len(x) for _, x, *_ in held]), *(np.concatenate([h[i] for h in held]) for i in range(1, len(held[0])))]

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size > 100_000:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _settled(doc: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray, known: np.ndarray, span: int) -> pa.RecordBatch:
    """What must leave a task of the fingerprints of spans; known are those whose places a block covers already.

    A row without ``last`` is open: whether another record has it is found where all rows of its fingerprint meet. Of what is
    known or two records of this batch share, one row with a ``last`` of 0 stands for all, and the places, as far as no block covers them,
    leave as pieces first to last (exclusive) without ``b``, spread by record. Rows keep their order, by record
    and place, in which a shuffle compresses them best.
    """
    order = np.lexsort((doc, b, a))
    sa, sb, sdoc = a[order], b[order], doc[order]
    new = np.ones(len(a), bool)
    new[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
    start = np.flatnonzero(new)
    sizes = np.diff(np.append(start, len(a)))
    one, shared = np.empty(len(a), bool), np.empty(len(a), bool)
    one[order] = new
    shared[order] = np.repeat((sdoc[start] != sdoc[start + sizes - 1]) | np.logical_or.reduceat(known[order], start), sizes)
    keep, found = ~shared | one, shared & ~known
    order = np.lexsort((at[found], doc[found]))
    docs, places = doc[found][order], at[found][order]
    begins = np.ones(len(docs), bool)
    begins[1:] = (docs[1:] != docs[:-1]) | (places[1:] - places[:-1] > span)
    ends = np.append(begins[1:], True)[: len(docs)]
    docs, firsts, lasts = docs[begins], places[begins], places[ends] + span
    ours, n = at[keep], len(docs)
    columns = [
        pa.array(np.concatenate([a[keep].view(np.int64), docs])),
        pa.array(np.concatenate([b[keep].view(np.int64), np.zeros(n, np.int64)]), mask=np.arange(len(ours) + n) >= len(ours)),
        pa.array(np.concatenate([doc[keep], docs])),
        pa.array(np.concatenate([ours, firsts])),
        pa.array(np.concatenate([np.zeros(len(ours), np.int64), lasts]), mask=np.concatenate([~shared[keep], np.zeros(n, bool)])),
    ]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "doc", "first", "last"])


def _fingerprints(points: np.ndarray, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return window_hashes(points, length)[at], prime_hashes(points, length, at)


def _block_rows(span: int, gram: int):
    """Fingerprints of the blocks that begin at the candidate anchors of each text."""
    block = 2 * span - gram

    def each(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for doc, text, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for offset, points in _slices(text, block):
                    here = np.asarray(at.values) - offset
                    here = here[(here >= 0) & (here <= min(len(points) - block, SLICE - 1))]
                    if len(here):
                        yield doc, *_fingerprints(points, block, here), here + offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, a, b, at in _gathered(each(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(doc), pa.array(at)], ["a", "b", "doc", "at"])

    return run


def _span_rows(span: int, gram: int):
    """Fingerprints of the whole spans around the candidate anchors of each text, but for those of blocks that another record stands for."""

    def each(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for doc, text, *lists in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4)):
                at, here, there = (np.asarray(x.values if x.is_valid else [], dtype=np.int64) for x in lists)
                for offset, points in _slices(text, span):
                    n, reach = len(points) - span + 1, span - gram
                    own = _marks(n, here - offset, here - offset + reach)
                    todo = _marks(n, at - offset - reach, at - offset) & (own | ~_marks(n, there - offset, there - offset + reach)) | own
                    starts = np.flatnonzero(todo)
                    if len(starts):
                        yield doc, *_fingerprints(points, span, starts), starts + offset, own[starts]

    return lambda batches: (_settled(*columns, span) for columns in _gathered(each(batches)))


class SpanIndex:
    """Incremental index of the anchors of all records added so far.

    ``add`` takes a batch of (doc, text) whose docs no earlier batch held and records the candidates it forms with itself and
    with the history; ``verified`` turns all candidates into covered positions, given the texts.
    """

    def __init__(self, ws: Workspace, span: int, buckets: int, fanout: int = 3):
        self.ws, self.span, self.gram, self.buckets, self.fanout = ws, span, max(1, span // 2), buckets, fanout
        self.runs: list[tuple[int, str]] = []  # level and table
        self.candidates: list[DataFrame] = []

    def _write(self, rows: DataFrame, level: int) -> str:
        name = f"provq_run_{uuid.uuid4().hex}"
        path = self.ws.path(f"run{level}")
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        self.runs.append((level, name))
        return name

    def add(self, batch: DataFrame) -> None:
        spark = self.ws.spark
        history = [spark.table(t) for _, t in self.runs]
        rows = batch.mapInArrow(_anchor_rows(self.span, self.gram), "h bigint, doc bigint, pos bigint")
        fresh = spark.table(self._write(rows.repartition(self.buckets, "h"), 0))
        within = fresh.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("h")
        seen = [fresh.select("h").join(run.select("h").hint("merge"), "h", "left_semi") for run in history]
        matched = within
        for s in seen:
            matched = matched.union(s)
        matched = self.ws.save(matched.distinct(), "matched")
        before = list(self.candidates)
        for side in [fresh, *history]:
            self.candidates.append(side.join(matched, "h", "left_semi").select("doc", "pos"))
        self.candidates = [self.ws.save(self._all_candidates(), "candidates")]
        self.ws.drop(matched, *before)
        self.compact()

    def _all_candidates(self) -> DataFrame:
        out = self.candidates[0]
        for c in self.candidates[1:]:
            out = out.union(c)
        return out

    def compact(self) -> None:
        """Unite the runs of each level that has ``fanout`` of them into one run of the next level."""
        for level in sorted({k for k, _ in self.runs}):
            old = [t for k, t in self.runs if k == level]
            if len(old) >= self.fanout:
                rows = self.ws.spark.table(old[0])
                for t in old[1:]:
                    rows = rows.union(self.ws.spark.table(t))
                # the union keeps the buckets of its parts, so each task merges one bucket and nothing is shuffled
                conf, auto = self.ws.spark.conf, "spark.sql.sources.bucketing.autoBucketedScan.enabled"
                before = conf.get(auto)
                conf.set(auto, "false")
                try:
                    self._write(rows, level + 1)
                finally:
                    conf.set(auto, before)
                self.runs = [(k, t) for k, t in self.runs if t not in old]
                for t in old:
                    self._drop(t)

    def _drop(self, name: str) -> None:
        where = self.ws.spark.table(name).inputFiles()
        self.ws.spark.sql(f"DROP TABLE {name}")
        if where:
            self.ws.remove(where[0].rpartition("/")[0])

    def close(self) -> None:
        for _, t in self.runs:
            self._drop(t)
        self.runs = []

    def _common(self, prints: DataFrame) -> DataFrame:
        """(doc, at, low) of the fingerprints that two records have, low the smallest of them."""
        twice = prints.groupBy("a", "b").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("a", "b", "low")
        twice = self.ws.save(twice, "twice")  # an aggregate's own shuffle couldn't be split by adaptive execution
        return prints.select("a", "b", "doc", "at").join(twice, ["a", "b"]).select("doc", "at", "low")

    def _pieces(self, prints: DataFrame) -> DataFrame:
        """(doc, first, last) of the settled pieces and of the open spans whose fingerprint another record has or a row with ``last`` stands for; one shuffle."""
        meet = Window.partitionBy("a", "b")
        shared = (F.min("doc").over(meet) < F.max("doc").over(meet)) | F.max("last").over(meet).isNotNull()
        met = prints.withColumn("shared", shared).filter("b IS NULL OR (last IS NULL AND shared)")
        return met.select("doc", "first", F.coalesce("last", F.col("first") + self.span).alias("last"))

    def _listed(self, places: DataFrame, name: str) -> DataFrame:
        """The places of each record as a sorted list, which is no longer than its text."""
        return places.groupBy("doc").agg(F.sort_array(F.collect_set("at")).alias(name))

    def _with_texts(self, texts: DataFrame, lists: DataFrame) -> DataFrame:
        return texts.join(F.broadcast(lists) if stored_bytes(lists) <= BROADCAST_BYTES else lists, "doc")

    def verified(self, texts: DataFrame) -> DataFrame:
        """(doc, first, last): pieces of the texts, last exclusive, that stand in more than one record, whole spans all of them."""
        span, gram = self.span, self.gram
        wanted = self.ws.save(self._listed(self._all_candidates().withColumnRenamed("pos", "at"), "places"), "wanted")
        blocks = self.ws.save(self._with_texts(texts, wanted).select("doc", "text", "places").mapInArrow(_block_rows(span, gram), "a bigint, b bigint, doc bigint, at bigint"), "blocks")
        inside = self.ws.save(self._common(blocks), "inside")
        self.ws.drop(blocks)
        here, there = (self._listed(inside.filter(c), n) for c, n in (("doc = low", "here"), ("doc <> low", "there")))
        wanted = self.ws.save(wanted.join(here, "doc", "left").join(there, "doc", "left"), "wanted")
        prints = self._with_texts(texts, wanted).select("doc", "text", "places", "here", "there").mapInArrow(_span_rows(span, gram), "a bigint, b bigint, doc bigint, first bigint, last bigint")
        return inside.select("doc", F.col("at").alias("first"), (F.col("at") + 2 * span - gram).alias("last")).unionByName(self._pieces(prints))


def shared_spans(texts: DataFrame, *, key: str = "doc_id", text: str = "text", span: int = 150, batches: int = 3) -> DataFrame:
    """(doc BIGINT, shared_chars BIGINT): for each record with a shared span, how many of its positions lie in one.

    A span is a run of at least ``span`` code points that stands verbatim in the text of a record with another key; a repetition
    within one record doesn't count. The table is fed to the index in ``batches`` parts by a hash of the key, as later
    deliveries would be.

    Defined cases: rows with a null key or text, and texts shorter than ``span``, share nothing and have no row; of several rows with one
    key the longest text counts (of equal length the last by code point); texts of any length are looked at whole; other columns are
    ignored; an empty table gives no rows.
    """
    if span < 2:
        raise ValueError("span must be 2 or more")
    spark = texts.sparkSession
    ws = Workspace(spark, "spans")
    rows = texts.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).dropna()
    sizes = rows.groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).agg(F.max("n").alias("n"), F.sum("chars").alias("chars")).first()
    if (sizes["n"] or 0) > 1:
        rows = rows.groupBy("doc").agg(F.max(F.struct(F.length("text").alias("n"), "text")).alias("best")).select("doc", "best.text")
    rows = rows.filter(F.length("text") >= span)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, -(-(sizes["chars"] or 0) // BUCKET_CHARS)))
    index = SpanIndex(ws, span, buckets=buckets)
    part = F.pmod(F.xxhash64("doc"), F.lit(batches))
    for k in range(batches):
        index.add(rows.filter(part == k))
    pieces = index.verified(rows)
    index.close()
    before = F.max("last").over(Window.partitionBy("doc").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.coalesce(before, F.lit(0))))
    return pieces.withColumn("fresh", fresh).groupBy("doc").agg(F.sum("fresh").cast("bigint").alias("shared_chars"))
