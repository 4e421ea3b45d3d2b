"""Exact duplicates against immutable snapshots screened by binary-fuse filters.

Batches arrive one after the other. What a batch adds is a snapshot that never
changes: the distinct new texts with their digests (the exact buckets), and for
each bucket of digests a static binary-fuse filter of 8-bit fingerprints, about
10 bits a digest. A batch is handled so:

1. its own duplicates are grouped by digest (slim rows, summed in each task
   before the shuffle), so that a text copied any number of times is one digest;
2. those digests are screened by the filters of every earlier snapshot: a
   filter has no false negatives, so what it rejects is new without a look at
   the snapshot;
3. positives (the known texts, and about one in 256 of the others) join the
   exact buckets, where the texts are compared byte for byte;
4. the rest is written as the batch's own snapshot.

Texts are compared after every run of white space has become one space. A
digest is the text's SHA-256. Grouping the batch's texts, and step 3, compare
whole texts; a digest that two texts share (``clashing``) is set aside and its
rows are grouped by the texts themselves, so that the result doesn't rest on
the digest. Texts are shuffled once, by digest, into bucketed tables, which
meet each other without a shuffle.

Rows get their group by a join on the digest. Groups of more than 1 / ``HEAVY``
of all rows, at most ``HEAVY`` of them whatever the table's size, are joined by
broadcast; no other key is large enough to weigh on a task.

Edge cases: a null text counts as empty, and empty texts are one group; white
space alone is one space, another text; a null id is larger than all others,
and of rows with an equal smallest id one stays; long texts are whole; an empty
table gives no rows; other columns, clashing ones included, are left out.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rmalytics.llm._text import mix
from rmalytics.session import scratch_path

SPACES = r"[\x20\x09-\x0D]+"
BUCKET_DIGESTS = 4096
HEAVY = 1024
_SEED = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


# --- the filter -----------------------------------------------------------------


class BinaryFuse:
    """A static set of 64-bit keys: three slots in neighbouring segments, 8-bit fingerprints.

    ``slots[a] ^ slots[b] ^ slots[c]`` is a key's fingerprint at its three
    places, for every key of the set and for 1 in 256 others.
    """

    def __init__(self, seed: int, segment: int, segments: int, slots: np.ndarray):
        self.seed, self.segment, self.segments, self.slots = seed, segment, segments, slots

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Three places of each key, and its fingerprint."""
        h = mix(keys + np.uint64(seed) * _SEED)
        first = ((h >> np.uint64(32)) * np.uint64(segment * segments) >> np.uint64(32)).astype(np.int64)
        low = (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # xor with bits below the segment's size (a power of two) stays within an aligned segment's span
        places = np.stack([first, (first + segment) ^ (low & (segment - 1)), (first + 2 * segment) ^ ((low >> 13) & (segment - 1))])
        return places, (mix(h + _SEED) & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys)
        n = max(2, len(keys))
        segment = 1 << max(2, min(12, int(math.log(n) / math.log(3.33) + 2.25)))
        room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        segments = max(1, math.ceil(room / segment) - 2)
        for seed in range(1, 1 << 16):
            built = cls._attempt(keys, seed, segment, segments)
            if built is not None:
                return built
            segments += seed % 8 == 0  # more room, should many seeds fail
        raise RuntimeError("no seed gives a binary-fuse filter")

    @classmethod
    def _attempt(cls, keys: np.ndarray, seed: int, segment: int, segments: int) -> BinaryFuse | None:
        places, prints = cls._places(keys, seed, segment, segments)
        size, n = segment * (segments + 2), len(keys)
        count = np.bincount(places.ravel(), minlength=size)
        who = np.zeros(size, dtype=np.int64)  # xor of the keys' numbers at a place
        for row in places:
            np.bitwise_xor.at(who, row, np.arange(n))
        # peel: a place with one key is that key's own; taking keys away frees others
        turns, ready, peeled = [], np.flatnonzero(count == 1), 0
        while len(ready):
            own, at = np.unique(who[ready], return_index=True)
            turns.append((own, ready[at]))
            peeled += len(own)
            gone = places[:, own].ravel()
            np.subtract.at(count, gone, 1)
            np.bitwise_xor.at(who, gone, np.tile(own, 3))
            touched = np.unique(gone)
            ready = touched[count[touched] == 1]
        if peeled < n:
            return None
        slots = np.zeros(size, dtype=np.uint8)
        for own, place in reversed(turns):
            a, b, c = slots[places[:, own]]
            slots[place] = prints[own] ^ a ^ b ^ c  # its own place still holds 0
        return cls(seed, segment, segments, slots)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        places, prints = self._places(keys, self.seed, self.segment, self.segments)
        a, b, c = self.slots[places]
        return (a ^ b ^ c) == prints

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], dtype="<u4").tobytes() + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BinaryFuse:
        seed, segment, segments = np.frombuffer(raw[:12], dtype="<u4").tolist()
        return cls(seed, segment, segments, np.frombuffer(raw, dtype=np.uint8, offset=12))


def _keys(digests: pa.Array) -> np.ndarray:
    """The first eight bytes of each digest."""
    return np.array([int.from_bytes(d[:8].ljust(8, b"\0"), "little") for d in digests.to_pylist()], dtype=np.uint64)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, filter of rows (bucket, digest) sorted by bucket."""

    def given(bucket: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        raw = BinaryFuse.build(np.concatenate(parts)).to_bytes()
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([raw], pa.binary())], ["bucket", "filter"])

    now, parts = None, []
    for batch in batches:
        buckets, keys = batch.column(0).to_numpy(zero_copy_only=False), _keys(batch.column(1))
        for part in np.split(np.arange(len(buckets)), np.flatnonzero(np.diff(buckets)) + 1):
            if len(part):
                bucket = int(buckets[part[0]])
                if bucket != now and parts:
                    yield given(now, parts)
                    parts = []
                now = bucket
                parts.append(keys[part])
    if parts:
        yield given(now, parts)


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests that their bucket's filter holds, of rows (bucket, digest, filter)
    sorted by bucket, the filter first; a bucket without one holds nothing."""
    now, filter_ = None, None
    for batch in batches:
        buckets = batch.column(0).to_numpy(zero_copy_only=False)
        held = np.zeros(len(buckets), dtype=bool)
        is_filter = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        keys = np.zeros(len(buckets), dtype=np.uint64)
        keys[~is_filter] = _keys(batch.column(1).filter(pa.array(~is_filter)))
        for part in np.split(np.arange(len(buckets)), np.flatnonzero(np.diff(buckets)) + 1):
            if not len(part):
                continue
            if int(buckets[part[0]]) != now:
                now, filter_ = int(buckets[part[0]]), None
            if is_filter[part[0]]:
                filter_, part = BinaryFuse.from_bytes(batch.column(2)[int(part[0])].as_py()), part[1:]
            if filter_ is not None and len(part):
                held[part] = filter_.holds(keys[part])
        yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(held))], ["digest"])


# --- snapshots --------------------------------------------------------------------


class Snapshot:
    """What one batch added, written once: exact buckets (digest, text) and filters (bucket, filter).

    The texts are a table bucketed by digest into as many buckets as a shuffle
    has partitions: the shuffle that groups a batch's texts writes one file for
    each, and snapshots join each other without moving a text. ``late`` holds
    the few new texts that some filter held by chance.
    """

    def __init__(self, spark: SparkSession, folder: str, number: int):
        self.spark, self.folder, self.number = spark, folder, number
        self.table = "rmalytics_texts_" + uuid.uuid4().hex[:12]

    def write_texts(self, texts: DataFrame) -> None:
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        texts.write.partitionBy("asked").bucketBy(buckets, "digest").sortBy("digest").option("path", f"{self.folder}/texts").saveAsTable(self.table)

    def asked(self) -> DataFrame:
        return self.spark.table(self.table).where("asked").drop("asked")

    def exact(self) -> list[DataFrame]:
        """digest, text: the buckets, and the late ones."""
        late = self.spark.read.schema("digest binary, text string").parquet(f"{self.folder}/late")
        return [self.spark.table(self.table).where("not asked").select("digest", "text"), late]

    def digests(self) -> DataFrame:
        return united([x.select("digest") for x in self.exact()])

    def filters(self) -> DataFrame:
        return self.spark.read.schema("bucket long, filter binary").parquet(f"{self.folder}/filters")

    def write_filters(self, bucket_digests: int) -> None:
        digests = self.digests()
        self.buckets = max(1, -(-digests.count() // bucket_digests))
        dealt = digests.select(self._bucket().alias("bucket"), "digest")
        built = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_build, "bucket long, filter binary")
        built.write.parquet(f"{self.folder}/filters")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.buckets))

    def screened(self, digests: DataFrame) -> DataFrame:
        """The digests that the filters hold (all known ones, and a few others)."""
        asked = digests.select(self._bucket().alias("bucket"), "digest", F.lit(None).cast("binary").alias("filter"))
        filters = self.filters().select("bucket", F.lit(None).cast("binary").alias("digest"), "filter")
        both = filters.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", F.col("filter").isNull())
        return both.mapInArrow(_screen, "digest binary")

    def forget_table(self) -> None:
        """Takes the table from the session's catalog; its files stay in the folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def add_batch(spark: SparkSession, texts: DataFrame, digests: DataFrame, snapshots: list[Snapshot], folder: str, bucket_digests: int = BUCKET_DIGESTS) -> tuple[Snapshot, DataFrame, DataFrame]:
    """Screens a batch against the earlier snapshots and writes its own.

    ``texts``: digest, text of the batch's rows; ``digests``: the distinct ones.
    Returns the snapshot, ``places`` (digest, snapshot): where each digest's
    text lies, and ``clashing``: digests that two texts share.
    """

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    new = Snapshot(spark, folder, len(snapshots))
    empty = spark.createDataFrame([], "digest binary, snapshot int")
    positives = kept(united([empty, *(s.screened(digests).withColumn("snapshot", F.lit(s.number)) for s in snapshots)]), "positives")
    flagged = positives.select("digest").distinct().withColumn("asked", F.lit(True))
    # a digest's texts are equal if its least and its largest are: bytes are compared in each task first
    one = texts.groupBy("digest").agg(F.min("text").alias("text"), (F.min("text") != F.max("text")).alias("differ"))
    new.write_texts(one.join(flagged, "digest", "left").withColumn("asked", F.coalesce("asked", F.lit(False))))
    met = [empty.select("digest", "snapshot", F.lit(True).alias("same"))]
    for s in snapshots:
        mine = new.asked().join(positives.where(F.col("snapshot") == s.number).select("digest"), "digest").select("digest", "text")
        for stored in s.exact():
            both = mine.join(stored.withColumnRenamed("text", "stored"), "digest")
            met.append(both.select("digest", F.lit(s.number).alias("snapshot"), (F.col("text") == F.col("stored")).alias("same")))
    known = kept(united(met), "known")
    new.asked().join(known.select("digest"), "digest", "left_anti").select("digest", "text").write.parquet(f"{folder}/late")
    new.write_filters(bucket_digests)
    clashing = spark.table(new.table).where("differ").select("digest").unionByName(known.where("not same").select("digest")).distinct()
    places = known.select("digest", "snapshot").unionByName(new.digests().select("digest", F.lit(new.number).alias("snapshot")))
    return new, kept(places, "places"), kept(clashing, "clashing")


def exact_dedup(
    spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text: str = "text", batch: Column | None = None, batches: int = 3, bucket_digests: int = BUCKET_DIGESTS, digest_bits: int = 256
) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    ``batch``: the number (0 to ``batches`` - 1) of the batch that a row came
    with; by default rows are dealt by a hash of id and text. ``digest_bits``:
    less than 256 makes digests clash, for tests.
    """
    folder = scratch_path(spark, "exact")
    body = normalised(F.col(text))
    digest = F.unhex(F.sha2("text", 256))
    if digest_bits < 256:
        digest = F.substring(digest, 1, max(1, digest_bits // 8))
    number = F.pmod(F.xxhash64(id_col, text), F.lit(batches)) if batch is None else batch
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), number.cast("int").alias("batch"), body.alias("text"))
    source = source.select("doc_id", "batch", digest.alias("digest"), "text")

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    rows = kept(source.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "batch", "digest"), "rows")
    # null ids come last; of equal ids the first row
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("least")
    snapshots, members, clashing = [], [], []
    for b in range(batches):
        mine = kept(rows.where(F.col("batch") == b).groupBy("digest").agg(least, F.count("*").alias("n")), f"groups-{b}")
        texts = source.where(F.col("batch") == b).select("digest", "text")
        new, places, shared = add_batch(spark, texts, mine.select("digest"), snapshots, f"{folder}/snapshot-{b}", bucket_digests)
        snapshots.append(new)
        members.append(places.join(mine, "digest"))
        clashing.append(shared)

    for s in snapshots:
        s.forget_table()
    shared = kept(united(clashing).distinct(), "clashing")
    any_shared = not shared.isEmpty()
    classes = united(members).groupBy("snapshot", "digest").agg(F.min("least").alias("least"), F.sum("n").alias("group_size"))
    if any_shared:
        classes = classes.join(shared, "digest", "left_anti")
    classes = kept(classes.select("digest", F.col("least.doc_id").alias("keep_id"), F.col("least.rid").alias("keep_rid"), "group_size"), "classes")
    total = rows.count()
    heavy = F.broadcast(classes.where(F.col("group_size") * HEAVY > total))  # fewer than HEAVY rows
    light = classes.where(F.col("group_size") * HEAVY <= total)
    out = rows.join(heavy, "digest").unionByName(rows.join(heavy.select("digest"), "digest", "left_anti").join(light, "digest"))
    out = out.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    if any_shared:
        out = out.unionByName(_by_text(source.join(shared, "digest", "left_semi").select("doc_id", "text"), kept))
    return out


def _by_text(rows: DataFrame, kept) -> DataFrame:
    """The result for rows whose digests don't tell their texts apart: grouped by the texts."""
    rows = kept(rows.withColumn("rid", F.monotonically_increasing_id()), "clashing-rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("least")
    groups = rows.groupBy("text").agg(least, F.count("*").alias("group_size"))
    out = rows.join(groups, "text")
    return out.select("doc_id", F.col("least.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("least.rid")).alias("kept"), F.sha2("text", 256).alias("text_sha256"))
