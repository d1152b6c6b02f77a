"""Operator 5: exact n-gram Jaccard join with set-relation skipping."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, materialize, python_ready, small_side, trimmed
from .components import connected_components
from .shingles import shingle_sets

SHINGLE_WORDS = 3
#: Two sets link from this intersection on, in percent of the union.
PERCENT = 90
#: Counters of the frequency sketch (2 ** bits); it only orders the shingles,
#: so its size bears on the length of the lists, never on the links.
SKETCH_BITS = 24
SKETCH_BLOCK = 1 << 16
#: Documents that a worker holds as sets at a time.
PART_ROWS = 512


def _set_id(own: np.ndarray) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _set_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row per document (kind 0: id, set id, size); then the partition's part of the
    sketch in blocks (kind 1: block number, compressed counters)."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint16)  # of one partition, up to 65,535
    kind_of_id = None

    def count(sets: list[np.ndarray]) -> None:
        at, n = np.unique(np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS), return_counts=True)
        counts[at] = np.minimum(counts[at] + n, 65535)

    for batch in batches:
        kind_of_id = batch.column("doc_id").type
        ids, sizes, gathered, pending = [], [], [], 0
        for own in shingle_sets(batch.column("text"), k):
            ids.append(_set_id(own) if len(own) else None)
            sizes.append(len(own))
            gathered.append(own)
            pending += len(own)
            if pending > 1 << 19:
                count(gathered)
                gathered, pending = [], 0
        if gathered:
            count(gathered)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int32()),
             pa.nulls(n, pa.binary())], names=["doc_id", "sid", "n", "block", "counters"])
    blocks = [b for b in range(len(counts) // SKETCH_BLOCK) if counts[b * SKETCH_BLOCK:(b + 1) * SKETCH_BLOCK].any()]
    if blocks:
        n = len(blocks)
        packed = [zlib.compress(counts[b * SKETCH_BLOCK:(b + 1) * SKETCH_BLOCK].astype("<u2").tobytes(), 1)
                  for b in blocks]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, kind_of_id), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(blocks, pa.int32()),
             pa.array(packed, pa.binary())], names=["doc_id", "sid", "n", "block", "counters"])


def _add_blocks(pdf):
    total = np.zeros(SKETCH_BLOCK, np.int64)
    for raw in pdf["counters"]:
        total += np.frombuffer(zlib.decompress(raw), "<u2")
    return pdf.head(1)[["block"]].assign(counters=[_ranks(total).tobytes()])


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Counters on a logarithmic scale of 7 bits."""
    return np.minimum(np.floor(np.log2(counts + 1.0) * 4), 127).astype(np.uint8)


def prefix_length(n: int, percent: int) -> int:
    """A set of size n shares one of so many first elements, in any common
    order, with every set it links to."""
    return n - -(-percent * n // 100) + 1


def _parities(own: np.ndarray, bits: int) -> list[int]:
    """A bitmap whose bits are the parities of the elements hashed to them;
    two bitmaps differ in at most as many bits as the sets in elements."""
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8").tolist()


def _index_rows(batches: Iterator[pa.RecordBatch], k: int, percent: int, sketch: bytes) -> Iterator[pa.RecordBatch]:
    """(sid, n, tokens, bits, half) of each different set of the partition:
    its prefix in the order (sketched frequency, hash), rare shingles first,
    and parity bitmaps of a size by that of the set and of half that size.

    A token holds the frequency rank over 56 bits of the hash; sets that share
    a shingle share its token, and tokens order as numbers.
    """
    ranks = np.frombuffer(sketch, np.uint8)
    seen: set[int] = set()
    low = np.uint64((1 << 56) - 1)
    kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3]
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            rows = []
            for own in shingle_sets(batch.column("text").slice(at, PART_ROWS), k):
                if not len(own) or (sid := _set_id(own)) in seen:
                    continue
                seen.add(sid)
                n = len(own)
                tokens = (ranks[own >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(56)) | (own & low)
                p = prefix_length(n, percent)
                tokens = np.sort(np.partition(tokens, p - 1)[:p]).view(np.int64)
                bits = 128
                while bits < n * (100 - percent) / 20:
                    bits *= 2
                rows.append((sid, n, tokens, _parities(own, bits), _parities(own, bits // 2)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                 names=["sid", "n", "tokens", "bits", "half"])


def _full_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            sets = [s for s in shingle_sets(batch.column("text").slice(at, PART_ROWS), k) if len(s)]
            if sets:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_set_id(s) for s in sets], pa.int64()),
                     pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["sid", "members"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``x, y, distance, linked`` of pairs (x, y): exact Jaccard distances."""
    both = (pairs.join(sets.select(F.col("sid").alias("x"), F.col("members").alias("mx")), "x")
            .join(sets.select(F.col("sid").alias("y"), F.col("members").alias("my")), "y")
            .select("x", "y", F.size(F.array_intersect("mx", "my")).cast("long").alias("both"),
                    (F.size("mx") + F.size("my")).cast("long").alias("sizes")))
    union = F.col("sizes") - F.col("both")
    return both.select("x", "y", (1 - F.col("both") / union).alias("distance"),
                       (100 * F.col("both") >= percent * union).alias("linked"))


def _bitmap_near(a: str, b: str, percent: int):
    """Whether the bitmaps allow that the sets link: their differing bits are
    no more than the elements in which linked sets of these sizes can differ."""
    def bits(x: str, y: str):
        return F.when(F.size(f"{x}bits") > F.size(f"{y}bits"), F.col(f"{x}half")).otherwise(F.col(f"{x}bits"))

    differ = F.aggregate(F.zip_with(bits(a, b), bits(b, a), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0),
                         lambda total, n: total + n)
    return (100 + percent) * differ <= (100 - percent) * (F.col(f"{a}n") + F.col(f"{b}n"))


def _members(source: DataFrame, groups: DataFrame, sids: DataFrame, shingle_words: int) -> DataFrame:
    """The whole sets of ``sids``, from one document of each."""
    wanted = sids.join(groups, "sid").select(F.col("least_id").alias("doc_id")).distinct()
    return materialize(source.join(small_side(materialize(wanted, "jaccard-wanted")), "doc_id", "left_semi")
                       .mapInArrow(lambda it: trimmed(_full_sets(it, shingle_words)), "sid long, members array<long>")
                       .join(small_side(sids), "sid", "left_semi").dropDuplicates(["sid"]), "jaccard-members")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs``: the size of
    its set of distinct word shingles and the smallest id reachable by links.
    Sets link when 100 * intersection >= ``percent`` * union; equal sets do.

    1. Documents become set ids (a 64-bit hash of the sorted set); equal sets
       are one set from here on. A count sketch of all shingles orders them.
    2. Index: each set's prefix in that order, rare shingles first. Lists are
       sorted by position, and the set at the front of a list, the one with
       the fewest rare shingles, is its pivot.
    3. Every set of a list is compared with the pivot, by size and parity
       bitmap and then exactly. A set that links to it shares its answers: of
       two sets that are connected already no pair is made.
    4. Pairs left in a list are those of sets not connected yet. They are
       skipped by size, by position in the list (the elements behind the
       common one bound the intersection), by bitmap and by the known
       distances to the pivot: Jaccard distance is a metric, so
       |d(x,p) - d(y,p)| bounds d(x,y). The rest is compared exactly. Every
       skip is a bound, so no link between different components is lost.
    5. Components by distributed star steps.

    A null, empty or blank text has an empty set, links with nothing and is
    its own component. A null id takes no part: its component is null. Repeated
    rows are equal sets. An empty table gives no rows. Other columns are not
    read. Set ids of different sets agree with probability n^2 / 2^65.
    """
    spark = docs.sparkSession
    python_ready(spark)
    source = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    first = materialize(source.mapInArrow(lambda it: trimmed(_set_rows(it, shingle_words)),
                                          f"doc_id {kind}, sid long, n long, block int, counters binary"), "jaccard-sets")
    rows = first.where("block is null").select("doc_id", "sid", "n")
    groups = rows.where("sid is not null and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("least_id"))

    sketch = bytearray(1 << SKETCH_BITS)  # 16 MB, whatever the input
    for r in (first.where("block is not null").select("block", "counters").groupBy("block")
              .applyInPandas(_add_blocks, "block int, counters binary").collect()):
        at = r["block"] * SKETCH_BLOCK
        sketch[at:at + SKETCH_BLOCK] = r["counters"]
    shared = spark.sparkContext.broadcast(bytes(sketch))
    index = materialize(source.where("doc_id is not null").mapInArrow(
        lambda it: trimmed(_index_rows(it, shingle_words, percent, shared.value)),
        "sid long, n int, tokens array<long>, bits array<long>, half array<long>"), "jaccard-index")
    shared.unpersist()
    one = W.partitionBy("token")
    lists = materialize(index.select("sid", "n", F.posexplode("tokens").alias("pos", "token"))
                        .withColumn("front", F.min("sid").over(one)).withColumn("last", F.max("sid").over(one))
                        .withColumn("p", F.min(F.struct("pos", "sid", "n")).over(one))
                        .withColumn("long", F.count(F.lit(1)).over(one) > 2)
                        .where("front <> last").dropDuplicates(["token", "sid"])
                        .select("token", "sid", "n", "pos", "long", F.col("p.sid").alias("p_sid"), F.col("p.n").alias("p_n")),
                        "jaccard-lists")
    bitmaps = materialize(index.select("sid", "bits", "half").join(lists.select("sid").distinct(), "sid", "left_semi")
                          .dropDuplicates(["sid"]), "jaccard-bitmaps")

    def near_size(a: str, b: str):
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    def with_bitmap(df: DataFrame, prefix: str, key: str) -> DataFrame:
        return df.join(bitmaps.select(F.col("sid").alias(key), F.col("bits").alias(prefix + "bits"),
                                      F.col("half").alias(prefix + "half")), key)

    star = (lists.where((F.col("sid") != F.col("p_sid")) & near_size("n", "p_n"))
            .select(F.col("sid").alias("x"), F.col("n").alias("x_n"), F.col("p_sid").alias("y"), F.col("p_n").alias("y_n")).distinct())
    star = materialize(with_bitmap(with_bitmap(star, "x_", "x"), "y_", "y").where(_bitmap_near("x_", "y_", percent))
                       .select("x", "y"), "jaccard-pairs")
    sids = materialize(star.select("x").union(star.select("y")).distinct().toDF("sid"), "jaccard-sids")
    tested = materialize(_verified(star, _members(source, groups, sids, shingle_words), percent), "jaccard-star")
    links = tested.where("linked").select(F.col("x").alias("u"), F.col("y").alias("v"))
    roots = materialize(connected_components(links), "jaccard-roots")

    # Where the pivot's bitmap already excludes a link the distance is unknown.
    # A list of two has been dealt with: its one pair is that with the pivot.
    placed = (lists.join(
                tested.select(F.col("x").alias("sid"), F.col("y").alias("p_sid"), "distance"), ["sid", "p_sid"], "left")
              .join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left")
              .join(roots.select(F.col("node").alias("p_sid"), F.col("root").alias("p_root")), "p_sid", "left")
              .where("sid <> p_sid and long")
              .select("token", "sid", "n", "pos", "distance", F.coalesce("root", "sid").alias("root"),
                      (F.coalesce("root", "sid") != F.coalesce("p_root", "p_sid")).alias("open")))
    placed = with_bitmap(materialize(placed, "jaccard-placed"), "", "sid")
    names = ("sid", "n", "pos", "bits", "half", "distance", "root", "open")
    a = placed.where("open").select("token", *[F.col(c).alias("a_" + c) for c in names])
    b = placed.select(F.col("token").alias("b_token"), *[F.col(c).alias("b_" + c) for c in names])
    most = F.least("a_pos", "b_pos") + F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    limit = 1 - percent / 100 + 1e-9
    rest = materialize(a.join(b, (F.col("token") == F.col("b_token")) & (F.col("a_root") != F.col("b_root"))
                              & (~F.col("b_open") | (F.col("a_sid") < F.col("b_sid"))) & near_size("a_n", "b_n")
                              & (100 * most >= percent * (F.col("a_n") + F.col("b_n") - most))
                              & F.coalesce(F.abs(F.col("a_distance") - F.col("b_distance")) <= limit, F.lit(True))
                              & _bitmap_near("a_", "b_", percent))
                       .select(F.col("a_sid").alias("x"), F.col("b_sid").alias("y")).distinct(), "jaccard-rest")
    links = roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    if not rest.isEmpty():
        sids = materialize(rest.select("x").union(rest.select("y")).distinct().toDF("sid"), "jaccard-sids")
        more = _verified(rest, _members(source, groups, sids, shingle_words), percent).where("linked")
        links = materialize(links.union(more.select(F.col("x").alias("u"), F.col("y").alias("v"))), "jaccard-links")
    found = connected_components(links)

    joined = groups.join(found.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn(
        "root", F.coalesce("root", "sid"))
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    ids = joined.join(least, "root").select("sid", "component_id")
    return (rows.join(ids, "sid", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller id."""
    gone = (jaccard_components(docs, id_col, text_col, **options)
            .where("component_id is not null and component_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(small_side(materialize(gone, "jaccard-gone")), id_col, "left_anti").select(*docs.columns)
