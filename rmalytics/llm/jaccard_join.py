"""N-gram Jaccard join under several global token orders.

A document is the set of its distinct ``k``-word shingles (64-bit hashes by a
random key of the run). Take any order of all shingles, c = ceil(t * n) and l = 1 + n // 16 for a set of n:
if two sets reach the similarity t, then their first ``n - c + l`` shingles have
at least the smaller l in common (of the m >= c shared ones, the l-th has m - l
others behind it). Candidates must pass this under three orders:

1. a hash order with shingles that very many documents hold put last. Its
   prefixes are shuffled by shingle; a document stays if enough of its prefix
   is shared with documents of a near size, a pair if the prefixes share so much
   that all the shingles behind them could make up for the rest.
2. and 3.: other hash orders. Where candidates are counted by blocks (below), a
   pair must pass under all three before it is given; for the others they are
   taken on the two sets when they meet, before all shingles are compared.

Equal sets are one document from the start. Links are found in two steps, so
that groups of near copies don't make all their pairs: every document is
compared with the two leaders that it shares most prefix shingles with (of each
shingle's documents the one whose whole prefix is most widely shared: what
copies were made from, rather than an edited copy), and the links found give
components; then all pairs that share
enough of their prefixes *across* components are compared. A pair within a
component can add nothing to it, so the components are exact. Shingles held by
one component only take no part. Documents with a shingle of more than
``light`` documents are dealt to blocks, and pairs of blocks with such a shingle
in common to tasks, with whole prefixes: a task counts all of a pair's shared
shingles and gives only pairs that pass. Rarer shingles give their few pairs.

Only one table of bounded size reaches the driver: the ``heavy`` most frequent
shingles, which steer the first order (any order gives the same result).

Edge cases: null texts, and those without words, have 0 shingles and are linked
with nothing; texts of fewer than ``k`` words are one shingle; null ids take
part, and a component's id is its smallest id that isn't null; repeated rows
are equal sets; other columns are left out.
"""

from __future__ import annotations

import contextlib
import hashlib
import math
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rmalytics.llm._components import components
from rmalytics.llm._text import LOWER, hash_spans, mix, pieces, words
from rmalytics.session import scratch_path

WORDS = 5
HEAVY = 65_536
#: in so many sets of one run of rows a shingle is reported as frequent
OFTEN = 4
#: shingles of a run's distinct sets, at most about so many
RUN = 1 << 20
#: text made into shingles at once: arrays over its words take some 15 times as much
PART_BYTES = 1 << 20
#: rows given to a worker at once, and pairs of sets taken out of them at once
BATCH_ROWS, BATCH_PAIRS = 1000, 250
#: prefixes are longer by 1 + n // MORE than to share one shingle, and share so many
MORE = 16
BLOCK = 512
#: shingles of at most so many documents give their pairs directly
LIGHT = 32
_SALT1, _SALT2, _SALT3, _STEP = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC13FA9A902A6328F, 0xD6E8FEB86659FD93))
_TOP = np.uint64(1 << 63)


def shingle_sets(column: pa.Array, k: int = WORDS, key: int = 0) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes (by ``key``) of each row, by runs of rows."""
    for _, _, buf, off in pieces(column, PART_BYTES):
        buf = LOWER[buf]
        s, e, rows = words(buf, off)
        h = hash_spans(buf, s, e, key)
        n = len(h)
        whole = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            take = max(0, n - j)
            part = whole[:take] * _STEP
            part += h[j:] if j else h
            whole[:take] = mix(part)
        out = []
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(whole[a : b - k + 1]))
            elif b > a:
                x = np.zeros(1, dtype=np.uint64) + np.uint64(b - a)
                for j in range(a, b):
                    x = mix(x * _STEP + h[j])
                out.append(x)
            else:
                out.append(h[:0])
        yield out


def least_shared(n: int, num: int, den: int) -> int:
    """Shingles that a set of n shares at least with any set it is linked to."""
    return -(-num * n // den)


def in_common(n: int) -> int:
    """Shingles that prefixes of linked sets have in common, for the smaller set's n."""
    return 1 + n // MORE


def pair_needs(n: int, m: int, num: int, den: int) -> int:
    """Shingles that the prefixes of linked sets of n and m have in common: shared
    ones that aren't in both lie behind the prefix that ends first in the order."""
    shared = -(-num * (n + m) // (num + den))
    behind = max(n - prefix_size(n, num, den), m - prefix_size(m, num, den))
    return max(in_common(min(n, m)), shared - behind)


def prefix_size(n: int, num: int, den: int) -> int:
    return min(n, n - least_shared(n, num, den) + in_common(n))


def size_class(n: int, num: int, den: int) -> int:
    """Sizes of linked sets are at most one class apart (a class is a little wider than 1 / t)."""
    return int(math.log(n) / (math.log(den / num) * (1 + 1e-6)))


class Order:
    """Hashed, frequent shingles last and the rarer of them first."""

    def __init__(self, heavy: np.ndarray, salt: np.uint64):
        self.heavy, self.salt = np.sort(heavy), salt
        place = np.argsort(heavy, kind="stable")
        self.rank = np.uint64(len(heavy)) - place.astype(np.uint64)  # the most frequent comes last

    def first(self, x: np.ndarray, p: int) -> np.ndarray:
        key = mix(x ^ self.salt) >> np.uint64(1)
        if len(self.heavy):
            at = np.searchsorted(self.heavy, x)
            at[at == len(self.heavy)] = 0
            hot = self.heavy[at] == x
            key[hot] = _TOP + self.rank[at[hot]]
        return x[np.argpartition(key, p - 1)[:p]] if p < len(x) else x


def heavy_shingles(docs: DataFrame, k: int = WORDS, most: int = HEAVY, key: int = 0) -> np.ndarray:
    """The most frequent shingles over all documents, most frequent first; equal sets in a run of rows count once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct: set[bytes] = set()  # sets of the run

        def often() -> pa.RecordBatch:
            tokens, n = np.unique(np.frombuffer(b"".join(distinct), dtype=np.uint64), return_counts=True)
            distinct.clear()
            return pa.RecordBatch.from_arrays([pa.array(tokens[n >= OFTEN].view(np.int64)), pa.array(n[n >= OFTEN])], ["token", "n"])

        total = 0
        for batch in batches:
            for sets in shingle_sets(batch.column(0), k, key):
                for x in sets:
                    if len(x) and (own := x.tobytes()) not in distinct:
                        distinct.add(own)
                        total += len(x)
                if total > RUN:
                    yield often()
                    total = 0
        yield often()

    counts = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(most).collect()  # at most ``most`` rows
    return np.array([r.token for r in top], dtype=np.int64).view(np.uint64)


def _signatures(docs: DataFrame, heavy: np.ndarray, k: int, num: int, den: int, key: int) -> DataFrame:
    """rid, doc_id, th, n, fp and the first order's prefix; a set's prefix is given once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen, at = Order(heavy, _SALT1), set(), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            row = 0
            for sets in shingle_sets(batch.column(2), k, key):
                n = np.array([len(x) for x in sets], dtype=np.int64)
                rid = np.empty(len(sets), dtype=np.int64)
                fps, sizes, parts = [], [], []
                for j, x in enumerate(sets):
                    cls = size_class(len(x), num, den) if len(x) else 0
                    rid[j] = cls << 56 | part << 32 | at
                    at += 1
                    fp = hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None
                    fps.append(fp)
                    if fp is None or fp in seen:
                        sizes.append(0)
                        continue
                    seen.add(fp)
                    parts.append(order.first(x, prefix_size(len(x), num, den)))
                    sizes.append(len(parts[-1]))
                flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                own = slice(row, row + len(sets))
                ids, th = batch.column(0)[own], batch.column(1)[own]
                row += len(sets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid), ids, th, pa.array(n), pa.array(fps, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))],
                    ["rid", "doc_id", "th", "n", "fp", "prefix"],
                )

    return docs.select("doc_id", "th", "text").mapInArrow(run, "rid long, doc_id long, th long, n long, fp binary, prefix array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, rid), those next to a row of the same token and a near size class."""
    token, rid, kept = np.empty(0, np.int64), np.empty(0, np.int64), False
    for batch in batches:
        # the last row waits for what follows it
        token = np.concatenate([token, batch.column(0).to_numpy(zero_copy_only=False)])
        rid = np.concatenate([rid, batch.column(1).to_numpy(zero_copy_only=False)])
        near = (token[1:] == token[:-1]) & ((rid[1:] >> 56) - (rid[:-1] >> 56) <= 1)
        keep = np.concatenate([[kept], near]) | np.concatenate([near, [False]])
        if len(keep):
            body = np.flatnonzero(keep[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(token[body]), pa.array(rid[body])], ["token", "rid"])
            token, rid, kept = token[-1:], rid[-1:], bool(keep[-1])
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(rid)], ["token", "rid"])


def _sets(rows: DataFrame, k: int, key: int) -> DataFrame:
    """rid and the whole set (as bytes) of rows with rid and text; rows of one rid are in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            row = 0
            for sets in shingle_sets(batch.column(1), k, key):
                rids, blobs = [], []
                for rid, x in zip(batch.column(0)[row : row + len(sets)].to_pylist(), sets, strict=True):
                    if rid not in seen:
                        seen.add(rid)
                        rids.append(rid)
                        blobs.append(x.tobytes())
                row += len(sets)
                yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(blobs, pa.binary())], ["rid", "tokens"])

    return rows.select("rid", "text").mapInArrow(run, "rid long, tokens binary")


def _verified(pairs: DataFrame, sets: DataFrame, heavy: np.ndarray, num: int, den: int) -> DataFrame:
    """x, y, linked of the pairs (x, y): the further orders' prefixes first, then all shingles."""
    a = sets.select(F.col("rid").alias("x"), F.col("tokens").alias("tx"))
    b = sets.select(F.col("rid").alias("y"), F.col("tokens").alias("ty"))
    both = pairs.select("x", "y").join(a, "x").join(b, "y").select("x", "y", "tx", "ty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = [Order(heavy, _SALT2), Order(heavy, _SALT3)]
        for batch in (whole.slice(a, BATCH_PAIRS) for whole in batches for a in range(0, whole.num_rows, BATCH_PAIRS)):
            linked = []
            for tx, ty in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(tx, dtype=np.uint64), np.frombuffer(ty, dtype=np.uint64)
                small, large = sorted((len(u), len(v)))
                ok = den * small >= num * large
                for order in orders:
                    ok = ok and _shared_by(order.first(u, prefix_size(len(u), num, den)), order.first(v, prefix_size(len(v), num, den))) >= in_common(small)
                if ok:
                    same = _shared_by(u, v)
                    ok = den * same >= num * (len(u) + len(v) - same)
                linked.append(bool(ok))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], ["x", "y", "linked"])

    return both.mapInArrow(run, "x long, y long, linked boolean")


def _shared_by(u: np.ndarray, v: np.ndarray) -> int:
    return len(np.intersect1d(u, v, assume_unique=True))


def _across(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs across components (x, y, shared, need) of rows (token, lo, hi, side,
    rid, comp, n) sorted by the first three.

    A group is a pair of blocks of one shingle, at most about two blocks long.
    """
    shared: dict[tuple[int, int], int] = {}
    size: dict[int, int] = {}

    def count(g: np.ndarray) -> None:
        side, rid, comp = g[3], g[4], g[5]
        if (comp == comp[0]).all():
            return
        one, other = np.flatnonzero(side == g[1, 0]), np.flatnonzero(side == g[2, 0])
        far = (comp[one][:, None] != comp[other][None, :]) & (np.abs((rid[one] >> 56)[:, None] - (rid[other] >> 56)[None, :]) <= 1)
        if g[1, 0] == g[2, 0]:
            far &= rid[one][:, None] < rid[other][None, :]
        i, j = np.nonzero(far)
        x, y = rid[one[i]], rid[other[j]]
        for p in zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True):
            shared[p] = shared.get(p, 0) + 1
        met = np.unique(np.concatenate([one[i], other[j]]))
        size.update(zip(rid[met].tolist(), g[6][met].tolist(), strict=True))

    def given() -> pa.RecordBatch:
        rows = [(x, y, c, pair_needs(size[x], size[y], num, den)) for (x, y), c in shared.items()]
        shared.clear()
        size.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], ["x", "y", "shared", "need"])

    rest = np.empty((7, 0), np.int64)
    for batch in batches:
        rest = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
        cut = np.flatnonzero((rest[:3, 1:] != rest[:3, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cut[:-1]], cut, strict=False):
            if b - a > 1:
                count(rest[:, a:b])
                if len(shared) > 500_000:
                    yield given()
        rest = rest[:, cut[-1] :] if len(cut) else rest
    if rest.shape[1] > 1:
        count(rest)
    yield given()


def _prefixes(sets: DataFrame, heavy: np.ndarray, num: int, den: int) -> DataFrame:
    """rid and the prefixes of whole sets under the second and the third order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = [Order(heavy, _SALT2), Order(heavy, _SALT3)]
        for batch in batches:
            got = [[], []]
            for tokens in batch.column(1).to_pylist():
                x = np.frombuffer(tokens, dtype=np.uint64)
                for out, order in zip(got, orders, strict=True):
                    out.append(order.first(x, prefix_size(len(x), num, den)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in got)], ["rid", "second", "third"])

    return sets.mapInArrow(run, "rid long, second binary, third binary")


def shared_counts(one: list[np.ndarray], other: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many tokens each of the sets ``one`` shares with each of ``other``."""
    out = np.zeros((len(one), len(other)), dtype=np.float32)  # whole numbers far below 2^24
    flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (one, other)]
    common = np.intersect1d(*flat)
    at = []
    for sets, tokens in zip((one, other), flat, strict=True):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        code = np.searchsorted(common, tokens)
        code[code == len(common)] = 0
        held = common[code] == tokens if len(common) else np.zeros(len(tokens), dtype=bool)
        order = np.argsort(code[held], kind="stable")
        at.append((row[held][order], code[held][order]))
    for a in range(0, len(common), width):
        parts = []
        for sets, (row, code) in zip((one, other), at, strict=True):
            lo, hi = np.searchsorted(code, [a, a + width])
            x = np.zeros((len(sets), width), dtype=np.float32)
            x[row[lo:hi], code[lo:hi] - a] = 1
            parts.append(x)
        out += parts[0] @ parts[1].T
    return out


def _needs(n: np.ndarray, m: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """``pair_needs`` and ``in_common`` of all pairs of sizes."""
    sizes = np.unique(np.concatenate([n, m]))
    behind_of = dict(zip(sizes.tolist(), [x - prefix_size(x, num, den) for x in sizes.tolist()], strict=True))
    behind = [np.array([behind_of[x] for x in y.tolist()], dtype=np.int64) for y in (n, m)]
    shared = -(-num * (n[:, None] + m[None, :]) // (num + den))
    least = 1 + np.minimum(n[:, None], m[None, :]) // MORE
    return np.maximum(least, shared - np.maximum(behind[0][:, None], behind[1][None, :])), least


def _met(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs (x, y) across components that share enough under each of the orders, of rows
    (lo, hi, block, rid, comp, n, first, second, third) sorted by (lo, hi).

    A group is a pair of blocks: it has whole prefixes of all their documents, so
    that a pair is counted once, and given only if it passes.
    """

    def pairs(rows: list[dict]) -> pa.RecordBatch:
        sides = [[r for r in rows if r["block"] == b] for b in (rows[0]["lo"], rows[0]["hi"])]
        rid, comp, n = ([np.array([r[c] for r in side], dtype=np.int64) for side in sides] for c in ("rid", "comp", "n"))
        ok = (comp[0][:, None] != comp[1][None, :]) & (np.abs((rid[0] >> 56)[:, None] - (rid[1] >> 56)[None, :]) <= 1)
        if rows[0]["lo"] == rows[0]["hi"]:
            ok &= rid[0][:, None] < rid[1][None, :]
        if ok.any():
            need, least = _needs(*n, num, den)
            for name, enough in (("first", need), ("second", least), ("third", least)):
                one, other = ([np.array(r[name], dtype=np.int64) if name == "first" else np.frombuffer(r[name], dtype=np.int64) for r in side] for side in sides)
                ok &= shared_counts(one, other) >= enough
                if not ok.any():
                    break
        i, j = np.nonzero(ok)
        x, y = rid[0][i], rid[1][j]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["x", "y"])

    group: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if group and (row["lo"], row["hi"]) != (group[0]["lo"], group[0]["hi"]):
                yield pairs(group)
                group = []
            group.append(row)
    if group:
        yield pairs(group)


def _by_blocks(posts: DataFrame, prefixes: DataFrame, kept: Callable[[DataFrame, str], DataFrame], num: int, den: int, light: int, block: int) -> DataFrame:
    """x, y: pairs across components that have a shingle of more than ``light`` documents in common.

    A document's block is made of documents whose most frequent shingle is the
    same, of one size class and, where a component is large, of that component
    alone; pairs of blocks of one component are left out.
    """
    common = posts.where(F.col("t") > light)
    top = F.max(F.struct("t", "token")).alias("top")
    held = common.groupBy("rid", "comp").agg(top).select("rid", "comp", F.col("top.token").alias("g"), F.shiftright("rid", 56).alias("cls"))
    own = held.groupBy("g", "cls", "comp").agg(F.count("*").alias("own"))
    rest = own.groupBy("g", "cls").agg(F.sum(F.when(F.col("own") < block, F.col("own")).otherwise(0)).alias("rest"))
    split = lambda column, size: F.pmod(F.xxhash64(column), F.greatest(F.lit(1), F.ceil(size / block)).cast("long"))
    large = F.col("own") >= block
    part = F.when(large, split("rid", F.col("own"))).otherwise(split("comp", F.col("rest")))
    pure = F.when(large, F.col("comp"))  # the block's only component
    held = held.join(own, ["g", "cls", "comp"]).join(rest, ["g", "cls"])
    held = kept(held.select("rid", "cls", pure.alias("pure"), F.xxhash64("g", "cls", F.coalesce(pure, F.lit(-1)), part).alias("block")), "blocks")

    of_token = common.join(held, "rid").select("token", "block", "cls", "pure").distinct()
    a = of_token.select("token", F.col("block").alias("lo"), F.col("cls").alias("c"), F.col("pure").alias("p"))
    b = of_token.select("token", F.col("block").alias("hi"), F.col("cls").alias("d"), F.col("pure").alias("q"))
    met = a.join(b, "token").where((F.col("lo") <= F.col("hi")) & (F.abs(F.col("c") - F.col("d")) <= 1)).where(~F.coalesce(F.col("p") == F.col("q"), F.lit(False)))
    met = kept(met.select("lo", "hi").distinct(), "block-pairs")

    docs = posts.groupBy("rid", "n", "comp").agg(F.collect_list("token").alias("first")).join(held.select("rid", "block"), "rid").join(prefixes, "rid")
    sides = met.select("lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
    dealt = sides.join(docs, "block").select("lo", "hi", "block", "rid", "comp", "n", "first", "second", "third")
    dealt = dealt.repartition("lo", "hi").sortWithinPartitions("lo", "hi")
    return dealt.mapInArrow(lambda it: _met(it, num, den), "x long, y long")


@contextlib.contextmanager
def _step_settings(spark: SparkSession) -> Iterator[None]:
    """Each step writes a table; its shuffle files go when the step is over, and
    workers get its rows, which hold texts and sets, few at a time."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}
    old = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def _labels(spark: SparkSession, docs: DataFrame, kept: Callable[[DataFrame, str], DataFrame], k: int, num: int, den: int, most_heavy: int, block: int, light: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with their sets' fingerprints, one row for each set, and the
    sets' components (node, label)."""
    secret = secrets.randbits(64)  # of this run: no text can be made so that its shingles clash
    heavy = heavy_shingles(docs, k, most_heavy, secret)
    rows = kept(_signatures(docs, heavy, k, num, den, secret), "rows")
    # one row for each set: the document with the smallest id, and the row that gave the prefix
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid", "th")).alias("first")
    reps = rows.where("n > 0").groupBy("fp").agg(first, F.min(F.when(F.size("prefix") > 0, F.col("rid"))).alias("rid"), F.max("n").alias("n"))
    reps = kept(reps.select("fp", "rid", "n", F.col("first.doc_id").alias("doc_id"), F.col("first.rid").alias("first_rid"), F.col("first.th").alias("th")), "reps")

    # the first order: who shares enough of the prefix with anyone of a near size
    posts = rows.select(F.explode("prefix").alias("token"), "rid")
    posts = posts.repartition("token").sortWithinPartitions("token", "rid").mapInArrow(_shared, "token long, rid long")
    posts = kept(posts, "shared").join(reps.select("rid", "n"), "rid")
    least = F.floor((F.lit(num) * F.col("n") + F.lit(den - 1)) / F.lit(den))
    enough = F.col("c") >= 1 + F.floor(least / F.lit(MORE))
    for turn in (1, 2):
        twice = posts.groupBy("token").agg(F.count("*").alias("t")).where("t > 1")
        posts = posts.join(twice.select("token"), "token", "left_semi")
        left = posts.groupBy("rid", "n").agg(F.count("*").alias("c")).where(enough).select("rid")
        posts = kept(posts.join(left, "rid", "left_semi"), f"posts-{turn}")

    # the sets of those documents; a null id stands for any, as the text's hash is compared as well
    key = F.coalesce("doc_id", F.lit(-1)).alias("d")
    left = posts.select("rid").distinct()
    wanted = left.join(reps, "rid").select("rid", key, F.col("th").alias("t"))
    texts = docs.select(key, F.col("th").alias("t"), "text").repartition("d", "t").join(wanted, ["d", "t"])
    sets = kept(_sets(texts, k, secret), "sets")

    size = posts.groupBy("token").agg(F.count("*").alias("t")).where("t > 1")
    posts = kept(posts.join(size, "token"), "posts")
    spread = posts.groupBy("rid", "n").agg((F.sum("t") / F.col("n")).alias("spread")).select("rid", "spread")
    leaders = posts.join(spread, "rid").groupBy("token").agg(F.max(F.struct("spread", "rid")).alias("leader"))
    leaders = leaders.select("token", F.col("leader.rid").alias("leader"))
    near = F.abs(F.shiftright("rid", 56) - F.shiftright("leader", 56)) <= 1
    star = posts.join(leaders, "token").where(F.col("rid") != F.col("leader")).where(near).groupBy("rid", "leader").agg(F.count("*").alias("c"))
    best = W.partitionBy("rid").orderBy(F.desc("c"), "leader")
    star = star.withColumn("r", F.row_number().over(best)).where("r <= 2").select(F.col("leader").alias("x"), F.col("rid").alias("y"))
    tried = kept(_verified(star, sets, heavy, num, den), "tried")
    labels = kept(components(spark, tried.where("linked").select("x", "y")), "labels")

    # across components: only shingles that two of them hold, and documents with enough of those
    across = posts.join(labels.select(F.col("node").alias("rid"), "label"), "rid", "left").withColumn("comp", F.coalesce("label", "rid")).drop("label")
    for turn in (1, 2):
        several = across.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("t")).where("a < b")
        across = across.drop("t").join(several.select("token", "t"), "token")
        left = across.groupBy("rid", "n").agg(F.count("*").alias("c")).where(enough).select("rid")
        across = kept(across.join(left, "rid", "left_semi"), f"across-{turn}")
    # shingles of few documents: all their pairs, counted; of many: pairs of blocks, which give what passes
    few = across.where(F.col("t") <= light).select("token", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("side"), "rid", "comp", "n")
    few = few.repartition("token").sortWithinPartitions("token").mapInArrow(lambda it: _across(it, num, den), "x long, y long, shared long, need long")
    few = few.groupBy("x", "y").agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).where("shared >= need").select("x", "y")
    prefixes = _prefixes(sets.join(across.where(F.col("t") > light).select("rid").distinct(), "rid", "left_semi"), heavy, num, den)
    many = _by_blocks(across, prefixes, kept, num, den, light, block)
    across = few.unionByName(many).distinct()
    across = across.join(tried, ["x", "y"], "left_anti")
    more = kept(_verified(across, sets, heavy, num, den).where("linked"), "across")
    links = tried.where("linked").select("x", "y").unionByName(more.select("x", "y"))
    return rows, reps, kept(components(spark, links), "all-labels")


def jaccard_components(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = WORDS, num: int = 3, den: int = 4, most_heavy: int = HEAVY, block: int = BLOCK, light: int = LIGHT) -> DataFrame:
    """rid, doc_id, th, n_shingles, component_id, keeper of every row.

    ``th`` is xxhash64 of the text; ``keeper`` marks one row of each component,
    that with the smallest id.
    """
    folder = scratch_path(spark, "jaccard")

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    with _step_settings(spark):
        rows, reps, labels = _labels(spark, docs, kept, k, num, den, most_heavy, block, light)

    # from sets to components to rows
    reps = reps.join(labels.select(F.col("node").alias("rid"), "label"), "rid", "left").withColumn("comp", F.coalesce("label", "rid"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "first_rid")).alias("first")
    comps = reps.groupBy("comp").agg(first)
    reps = reps.join(comps, "comp").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.first_rid").alias("keeper_rid"))
    out = rows.select("rid", "doc_id", "th", "n", "fp").join(reps, "fp", "left")
    return out.select(
        "rid",
        "doc_id",
        "th",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("rid") == F.col("keeper_rid")).otherwise(F.lit(True)).alias("keeper"),
    )


def one_of_each(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """The rows of ``df`` without near duplicates: one row of each component, all columns."""
    keep = jaccard_components(spark, df, id_col, text, **params).where("keeper").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"))
    rows = df.withColumn("_th", F.xxhash64(F.col(text).cast("string")))
    same: Column = F.col(id_col).cast("long").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t"))
    # equal rows (same id, same text) match together
    return rows.join(keep.distinct(), same).drop("_d", "_t").dropDuplicates([id_col, "_th"]).drop("_th")
