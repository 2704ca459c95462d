"""Near-duplicates by HyperMinHash over word shingles, confirmed on full sets.

A document's set holds the hashes of its distinct word shingles (ASCII case
ignored). Its sketch has ``BUCKETS`` registers: a hash's top bits choose the
bucket, and the least remaining value of a bucket is kept as its count of
leading zeros and ``MANTISSA`` bits after the first one; an empty bucket
borrows from the first filled one of an order fixed for it.

1. Texts of equal sets are one class, represented by the least doc_id.
2. Bands of registers put representatives into crowds. A representative's
   popularity is the number of its band-mates over all bands; the most popular
   member of a crowd, the one nearest to the middle of a group of copies, is
   its hub, and every member is paired with it.
3. Registers compressed to four bits (0: the bucket is empty) decide which
   pairs are confirmed. Each bucket with unequal entries holds a shingle that
   one set lacks, so a pair with more of them than the threshold lets shingles
   differ is no link. Where both sets have ``ESTIMATED`` shingles or more, the
   Jaccard index is also estimated from the filled buckets, corrected for
   unequal registers whose four bits collide; it must reach ``ESTIMATE``, 6
   standard deviations below the threshold. Borrowed registers count in
   neither. Confirmation recomputes both sets from the whole texts.
4. Links make components. While a round of hubs links a quarter or more of the
   pairs it tries and leaves more open rows than it tried, crowds that still hold several components are paired with
   a member of their largest one, by an order that changes each round.
5. What is left open is settled exactly. The shingles that only one member of
   all open crowds has are counted (work in proportion to their texts); lone
   members that have too many of them for the threshold are linked with
   nothing. The others are compared with all members of other components in
   their crowds, by these counts and by the bound and estimate of step 3 inside
   the join, so that only pairs that may be links leave it, each from the first
   band that both share (told by 32 bits of its key: 1e-8 of the pairs are lost).

A group of n linked copies costs a few n pairs. Banding is probabilistic: a
pair at the threshold of 0.8 is missed with probability (1 - 0.8**6)**42 =
3e-6, one at 0.9 with 2e-14; tests measure the recall. Nothing else is.
Shingles are compared by 64-bit hashes that have no structural collisions.

Fewer words than a shingle make one shingle of the whole. Null, empty and
wordless texts have an empty set and no links; a null doc_id has no links, no
component and counts as kept. Rows that repeat a doc_id are one document whose
links are those of all its texts, and each such row is returned. An empty
table gives no rows; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import discard, materialize, read_table
from . import bitmap as bitmaps
from . import textvec as tv

SHINGLE, PERCENT = 5, 80
BUCKET_BITS, MANTISSA = 8, 10
BUCKETS = 1 << BUCKET_BITS
BANDS, ROWS = 42, 6
ESTIMATE, ESTIMATED = 0.6, 256
WORDS = BUCKETS // 16  # longs that hold the registers at four bits each
_ORDER = np.argsort(tv.mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(1)).reshape(BUCKETS, BUCKETS), axis=1)


class Sets:
    """Sorted distinct shingle hashes of each text of a slice."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, size: int):
        w = tv.words(buf, offsets, tv.SPACED, tv.FOLD)
        n = len(offsets) - 1
        grams = tv.ngrams(w.hash, size)
        at = np.flatnonzero(w.room()[: len(grams)] >= size)
        row = w.rows()
        short = np.flatnonzero((w.counts > 0) & (w.counts < size))
        few = [tv.mix(tv.ngrams(w.hash[w.first[r] : w.first[r + 1]], int(w.counts[r])) + np.uint64(w.counts[r])) for r in short]
        values = np.concatenate([grams[at], *few]) if len(at) or few else np.zeros(0, np.uint64)
        rows = np.concatenate([row[at], short])
        order = np.lexsort((values, rows))
        values, rows = values[order], rows[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        self.values, self.rows = values[fresh], rows[fresh]
        self.first = np.searchsorted(self.rows, np.arange(n + 1))

    def of(self, row: int) -> np.ndarray:
        return self.values[self.first[row] : self.first[row + 1]]


def registers(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Leading zeros plus 1 and mantissa of each bucket's least value, as 16 bits; and which buckets have one of their own."""
    n = len(sets.first) - 1
    out = np.zeros((n, BUCKETS), np.uint16)
    place = sets.rows * BUCKETS + (sets.values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]  # values are sorted, so the first of a bucket is its least
    low = (sets.values[first] << np.uint64(BUCKET_BITS)) >> np.uint64(11)  # 53 bits
    length = np.frexp(low.astype(np.float64))[1]
    shift = length - 1 - MANTISSA
    mantissa = np.where(shift >= 0, low >> np.maximum(shift, 0).astype(np.uint64), low << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    out.ravel()[place[first]] = (np.minimum(53 - length + 1, 63).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    full = out > 0
    some = np.flatnonzero(full.any(1) & ~full.all(1))
    if len(some):
        have, own = full[some], out[some]
        filled = own.copy()
        for b in range(BUCKETS):
            lack = np.flatnonzero(~have[:, b])
            donor = _ORDER[b][have[lack][:, _ORDER[b]].argmax(1)]
            filled[lack, b] = own[lack, donor]
        out[some] = filled
    return out, full


def compressed(reg: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Registers at four bits each, 1 to 15, and 0 for buckets without a value of their own; WORDS longs a row."""
    nibble = np.where(own, tv.mix(reg.astype(np.uint64)) % np.uint64(15) + np.uint64(1), np.uint64(0)).astype(np.uint8)
    return np.ascontiguousarray(nibble[:, ::2] | nibble[:, 1::2] << 4).view(np.int64)


def band_keys(reg: np.ndarray) -> np.ndarray:
    """A hash of each band's registers and number."""
    lanes = np.zeros((len(reg), BANDS, 8), np.uint16)
    lanes[:, :, :ROWS] = reg[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    halves = lanes.view(np.uint64).reshape(-1, BANDS, 2)
    return tv.mix(tv.mix(halves[:, :, 0]) * np.uint64(tv.BASE) + halves[:, :, 1] + (np.arange(BANDS, dtype=np.uint64) << np.uint64(32))).view(np.int64)


LANES = [f"c{k}" for k in range(WORDS)]
SIGNATURE = ", ".join(["doc_id long", "n_shingles long", "k1 long", "k2 long", "keys array<long>", *(f"{c} long" for c in LANES)])


def signatures(documents: DataFrame, shingle: int) -> DataFrame:
    """Set size, two hashes of the set, the band keys and the compressed registers of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tv.slices(batches):
            sets = Sets(*tv.utf8(part.column("text")), shingle)
            reg, own = registers(sets)
            acc = np.concatenate((np.zeros(1, np.uint64), np.cumsum(sets.values)))
            acc2 = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tv.mix(sets.values ^ np.uint64(tv.BASE2)))))
            total = lambda x: (x[sets.first[1:]] - x[sets.first[:-1]]).view(np.int64)  # noqa: E731, B023
            small = compressed(reg, own)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(reg) + 1) * BANDS, pa.int32()), pa.array(band_keys(reg).ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(sets.first)), pa.array(total(acc)), pa.array(total(acc2)), keys, *(pa.array(np.ascontiguousarray(small[:, k])) for k in range(WORDS))],
                names=[x.split()[0] for x in SIGNATURE.split(", ")],
            )

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(scan, SIGNATURE)


def _near(a: str, b: str, percent: int) -> Column:
    """Whether set sizes, the buckets that certainly differ and the estimate allow the threshold."""

    def entries(x: Column) -> Column:
        """How many of a long's 16 entries are not 0."""
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    pairs = [(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")) for c in LANES]
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    unlike = reduce(lambda x, y: x + y, [entries(x.bitwiseXOR(y)) for x, y in pairs])
    either = reduce(lambda x, y: x + y, [entries(x.bitwiseOR(y)) for x, y in pairs])
    sizes = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    possible = (100 + percent) * unlike <= (100 - percent) * (na + nb)
    # of buckets whose registers differ, a fifteenth has equal entries
    likely = (F.least(na, nb) < ESTIMATED) | (unlike * (15 / 14) <= (1 - min(ESTIMATE, percent / 100 - 0.2)) * either)
    return sizes & possible & likely


def texts_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of these ids (all rows of a repeated one), written down.

    A bitmap of the ids, bounded in size, thins the scan, so that about the
    texts asked for are shuffled to the exact join and not all of them.
    """
    hashed = ids.select(F.xxhash64("doc_id").alias("h"))
    known = documents.sparkSession.sparkContext.broadcast(bitmaps.build(hashed, ids.count()))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = known.value.has(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.select(["doc_id", "text"]).filter(pa.array(found))

    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    some = text.where("doc_id is not null").mapInArrow(thin, "doc_id long, text string")
    texts = materialize(some.join(ids, "doc_id", "left_semi"), "neardup-texts")
    known.destroy()
    return texts


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; texts must hold both ends."""
    ta, tb = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for half in tv.slices(batches, "ta", 1 << 20):
            for part in tv.slices([half], "tb", 1 << 20):
                x, y = Sets(*tv.utf8(part.column("ta")), shingle), Sets(*tv.utf8(part.column("tb")), shingle)
                keep = []
                for r in range(part.num_rows):
                    p, q = x.of(r), y.of(r)
                    same = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(len(p) > 0 and 100 * same >= percent * (len(p) + len(q) - same))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long"), "neardup-links")


def _exclusive(open_: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(rep, u): how many shingles of a member no other member of any open crowd has; not for doc_ids with several texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tv.slices(batches):
            sets = Sets(*tv.utf8(part.column("text")), shingle)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(sets.values.view(np.int64)), pa.array(ids[sets.rows])], names=["h", "rep"])

    held = texts.join(open_.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(scan, "h long, rep long")
    alone = held.groupBy("h").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")).where("rep = other")
    repeated = texts.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("rep"))
    return materialize(alone.groupBy("rep").agg(F.count(F.lit(1)).alias("u")).join(repeated, "rep", "left_anti"), "neardup-own")


def _lonely(open_: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Members without any link so far (rep, ``lone``) whose own shingles rule out any link.

    Of a set of n shingles, u of them its own, and one of m shingles or more,
    the index is at most (n - u) / (max(m, n - u) + u).
    """
    least = open_.groupBy("key").agg(F.min("n_shingles").alias("m"))
    asked = open_.where("lone").join(least, "key").groupBy("rep").agg(F.first("n_shingles").alias("n"), F.min("m").alias("m"))
    most = 100 * (F.col("n") - F.col("u"))
    return asked.join(own, "rep").where(most < percent * (F.greatest(F.col("m"), F.col("n") - F.col("u")) + F.col("u"))).select("rep")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id (least doc_id of its equal set) and component_id, a row per row of documents."""
    sig = materialize(signatures(documents, shingle), "neardup-sketch")
    filled = sig.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    member = materialize(filled.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2", "n_shingles"]).select("doc_id", "n_shingles", "rep"), "neardup-class")
    reps = filled.join(member.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")
    rows = reps.select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y").select("key", "n")
    crowd = materialize(rows.join(sizes, "key").select("key", "rep", "n"), "neardup-crowd")
    fame = crowd.groupBy("rep").agg((F.sum("n") + F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) / F.lit(float(1 << 20))).alias("fame"))
    # members with their compressed registers, and how popular they are
    facts = materialize(reps.select(F.col("doc_id").alias("rep"), "n_shingles", F.transform("keys", lambda k: F.shiftright(k, 32).cast("int")).alias("bands"), *LANES).join(fame, "rep"), "neardup-facts")
    texts = texts_of(documents, facts.select(F.col("rep").alias("doc_id")).distinct())

    def plausible(pairs: DataFrame) -> DataFrame:
        x, y = facts.alias("x"), facts.alias("y")
        near = pairs.join(x, F.col("b") == F.col("x.rep")).join(y, (F.col("a") == F.col("y.rep")) & _near("x", "y", percent))
        return materialize(near.select("a", "b").distinct(), "neardup-pairs")

    def paired(inside: DataFrame, hubs: DataFrame) -> DataFrame:
        """Each member with its crowd's hub, unless already joined."""
        return inside.join(hubs, "key").where("comp <> hub_comp").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()

    # a doc_id with several texts holds its classes together
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id")
    links = materialize(member.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "neardup-links")

    inside, turn = materialize(crowd.join(facts.select("rep", "fame").distinct(), "rep").select("key", "rep", F.col("rep").alias("comp"), "fame"), "neardup-open"), 0
    while True:
        rank = F.col("fame") if turn == 0 else F.xxhash64("rep", F.lit(turn))
        hubs = inside.groupBy("key", "comp").agg(F.max_by("rep", rank).alias("hub"), F.max(rank).alias("rank"), F.count(F.lit(1)).alias("n"))
        hubs = hubs.groupBy("key").agg(F.max_by(F.struct("hub", "comp"), F.struct("n", "rank")).alias("h")).select("key", "h.hub", F.col("h.comp").alias("hub_comp"))
        tried = plausible(paired(inside, hubs))
        more = confirm(tried, texts, shingle, percent)
        asked, found = tried.count(), more.count()
        links = materialize(links.union(more), "neardup-links")
        part = connected_components(links, "a", "b")
        discard(inside, tried, more)
        inside, open_ = _still_open(crowd, facts, part)
        if open_ <= asked or 4 * found <= asked:
            break
        turn += 1
    if open_:
        own = _exclusive(inside, texts, shingle)
        rest = inside.join(_lonely(inside, own, percent), "rep", "left_anti").join(own, "rep", "left")
        detail = materialize(rest.join(facts.select("rep", "bands", *LANES), "rep").withColumn("u", F.coalesce("u", F.lit(0))), "neardup-open")
        largest = detail.groupBy("key", "comp").count().groupBy("key").agg(F.max_by("comp", "count").alias("major"))
        x, y = detail.join(largest, "key").where("comp <> major").alias("x"), detail.alias("y")
        nx, ux, ny, uy = (F.col(c) for c in ("x.n_shingles", "x.u", "y.n_shingles", "y.u"))
        shared = 100 * F.least(nx - ux, ny - uy) >= percent * F.greatest(nx + uy, ny + ux)
        once = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.shiftright("x.key", 32).cast("int")
        cross = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & shared & _near("x", "y", percent) & once)
        tried = materialize(cross.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct(), "neardup-pairs")
        more = confirm(tried, texts, shingle, percent)
        if not more.isEmpty():
            part = connected_components(links.union(more), "a", "b")
        discard(own, detail, tried, more)
    discard(inside, crowd, facts, texts, links)

    parts = part.select(F.col("id").alias("rep"), "component")
    found = member.join(parts, "rep", "left").select("doc_id", "n_shingles", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    alone = sig.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return found.union(alone)


def _still_open(crowd: DataFrame, facts: DataFrame, part: DataFrame) -> tuple[DataFrame, int]:
    """Members of crowds that hold several components, and how many rows these are."""
    marked = crowd.select("key", "rep").join(part.select(F.col("id").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"), F.col("component").isNull().alias("lone"))
    keys = marked.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    inside = materialize(marked.join(keys, "key", "left_semi").join(facts.select("rep", "fame", "n_shingles").distinct(), "rep"), "neardup-open")
    return inside, inside.count()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each component (shingles of five words); null ids stay."""
    gone = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
