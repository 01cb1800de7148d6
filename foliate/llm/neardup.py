"""Near-duplicate documents by banded MinHash, odd sketches and exact sets of word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, sole, text_of, written

ROWS = 5
SKETCH_BITS = 512
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, rows: int = ROWS, miss: float = 1e-6) -> int:
    """So many bands that a pair at the threshold shares none with a chance of `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


class Shingler:
    """64-bit hashes of a text's distinct k-word shingles, rising. Words are cut at spaces and the controls 9 to 13,
    with A-Z in lower case; a text of fewer words is one shingle of all of them, and one without words is empty.
    A worker keeps the hashes of up to `room` words."""

    def __init__(self, k: int, room: int = 600_000):
        self.k, self.room, self.known = k, room, {}

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        words = text.encode().lower().split()  # bytes: A-Z alone are lowered, and white space is those six alone
        known = self.known
        if len(known) > self.room:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word)
        hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(hashed):
            return hashed
        k = min(self.k, len(hashed))
        mixed = np.full(len(hashed) - k + 1, k, np.uint64)
        for i in range(k):
            mixed = (mixed ^ hashed[i : len(hashed) - k + 1 + i]) * MULTIPLIER
            mixed ^= mixed >> np.uint64(31)
        return np.unique(mixed)


_SHINGLERS: dict[int, Shingler] = {}


def shingler(k: int) -> Shingler:
    return sole(_SHINGLERS).setdefault(k, Shingler(k))


class Signer:
    """MinHash samples, their band values and their odd sketch."""

    def __init__(self, bands: int, rows: int = ROWS):
        rng = np.random.default_rng(20240229)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, bands * rows, np.uint64)
        self.salt = rng.integers(0, 2**63, bands * rows, np.uint64)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 1024):
            product = shingles[at : at + 1024, None] * self.a
            product += self.b
            np.minimum(out, product.min(axis=0), out=out)
        return out

    def band_values(self, samples: np.ndarray) -> np.ndarray:
        """A 64-bit value for each band, of its samples and its number."""
        grid = samples.reshape(self.bands, self.rows)
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for i in range(self.rows):
            out = (out ^ grid[:, i]) * MULTIPLIER
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        """A bit for each of the hash values, set where an odd number of samples falls, in 64-bit words."""
        at = ((samples ^ self.salt) * MULTIPLIER) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)
        return np.packbits(np.bincount(at.astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1).view(np.int64)


def similarity(differing: np.ndarray, samples: int) -> np.ndarray:
    """The similarity that two sketches of so many differing bits tell of: each sample that differs turns two bits."""
    share = np.minimum(2 * np.asarray(differing, float) / SKETCH_BITS, 0.999)
    return 1 + SKETCH_BITS / (4 * samples) * np.log(1 - share)


def sketch_tail(threshold: float, samples: int) -> np.ndarray:
    """For each number of bits, the chance that sketches of a pair at the threshold differ in more.

    Each sample differs with a chance of 1 - threshold, and one that does turns two bits at random, which can meet."""
    bits = np.arange(SKETCH_BITS + 1)
    odd, found = np.zeros(SKETCH_BITS + 1), np.zeros(SKETCH_BITS + 1)
    odd[0] = 1.0
    for n in range(samples + 1):
        ways = math.lgamma(samples + 1) - math.lgamma(n + 1) - math.lgamma(samples - n + 1)
        found += odd * math.exp(ways + n * math.log(1 - threshold) + (samples - n) * math.log(threshold))
        for _ in range(2):
            up, down = odd * (1 - bits / SKETCH_BITS), odd * bits / SKETCH_BITS
            odd = np.append(0.0, up[:-1]) + np.append(down[1:], 0.0)
    return np.append(np.cumsum(found[::-1])[::-1][1:], 0.0)


def most_differing(threshold: float, samples: int, miss: float = 1e-6) -> int:
    """So many bits that a pair at the threshold differs in more with a chance of `miss` at most."""
    return int(np.flatnonzero(sketch_tail(threshold, samples) <= miss)[0])


def signatures(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, set_id (a digest of the set; null if empty), bands, sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cut, signer = shingler(k), Signer(bands)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                sizes, ids, values, sketches = [], [], [], []
                for text in rows.column(1):
                    found = cut(text.as_py())
                    sizes.append(len(found))
                    if len(found):
                        samples = signer.samples(found)
                        ids.append(xxhash.xxh3_128_digest(found.tobytes()))
                        values.append(signer.band_values(samples))
                        sketches.append(signer.sketch(samples))
                    else:
                        ids.append(None)
                        values.append(None)
                        sketches.append(None)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(values, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_id", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(sign, "doc_id long, n_shingles long, set_id binary, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """node, shingles (rising 64-bit hashes, little-endian)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shingler(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([own(t.as_py()).tobytes() for t in rows.column(1)], pa.binary())], ["node", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("node"), text_of().alias("text")).mapInArrow(cut, "node long, shingles binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of rising arrays."""
    n, m = len(a), len(b)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    if n > m:
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int(np.count_nonzero(b[at] == a))
    return 100 * common >= percent * (n + m - common)


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """a, b of those rows of (a, b, set_a, set_b) whose full sets are linked."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(confirm, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node of the edges (a, b).

    Each round points every node to its least neighbour, follows pointers twice, and puts the pointed-to nodes in the
    edges' place, until none are left: edges that came together are dropped, so rounds shrink. Every round's tables
    are written to the shared folder; nothing comes to the driver but whether edges are left, and which nodes (fewer
    than 100) hold over a hundredth of the rows.
    """
    maps: list[DataFrame] = []
    left = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).withColumn("to", F.least("node", "to"))
        for _ in range(2):
            nearest = written(nearest, "pointers")
            onward = nearest.filter("to <> node").select(F.col("node").alias("to"), F.col("to").alias("onward"))
            nearest = join_hot(nearest, onward, "to", "left").select("node", F.coalesce("onward", "to").alias("to"))
        nearest = written(nearest, "pointers")
        maps.append(nearest)
        ends = join_hot(left, nearest.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        ends = ends.join(nearest.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = written(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0].withColumnRenamed("to", "component")
    for later in maps[1:]:
        out = out.join(later.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return out


def across(members: DataFrame, own: DataFrame, sets: DataFrame, percent: int, samples: int, block: int = 256) -> DataFrame:
    """a, b: components of linked members of one bucket that were apart, of (bucket, node, component), with each node's
    sketch and bands in `own` and its shingles in `sets`. Members are dealt into their groups before their sets join.

    Most of a large bucket is one component, and its members need not be held against each other. So the bucket's
    largest component is dealt into parts of about `block` members, and so are all its other members; each part of the
    one meets each part of the others, and the others' parts meet one another. A group is bounded whatever the bucket,
    and the work is linear in the largest component. A pair is tested only in the first bucket that it shares, only
    while its components are apart, most alike sketches first; a group gives back the links that joined components,
    which are fewer than its members, and never its pairs.
    """
    by_component = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = by_component.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("big"), F.sum("n").alias("n"))
    parts = lambda n: F.ceil(n / F.lit(block)).cast("int")
    sizes = sizes.select("bucket", F.col("big.component").alias("bulk"), parts(F.col("big.n")).alias("bulk_parts"), parts(F.col("n") - F.col("big.n")).alias("rest_parts"))
    dealt = join_hot(members, sizes, "bucket")
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    is_bulk = F.col("component") == F.col("bulk")
    part = F.pmod(F.xxhash64("node"), F.when(is_bulk, F.col("bulk_parts")).otherwise(F.col("rest_parts"))).cast("int")
    dealt = dealt.withColumn("part", part)
    with_rest = F.transform(up_to("rest_parts"), lambda j: place("bulk", F.col("part"), j))
    with_bulk = F.transform(up_to("bulk_parts"), lambda i: place("bulk", i, F.col("part")))
    among = F.transform(up_to("rest_parts"), lambda o: place("rest", F.least("part", o), F.greatest("part", o)))
    dealt = dealt.withColumn("at", F.explode(F.when(is_bulk, with_rest).otherwise(F.concat(with_bulk, among))))
    dealt = dealt.select("bucket", "at.kind", "at.i", "at.j", F.when(is_bulk, -1).otherwise(F.col("part")).alias("part"), "node", "component").join(own, "node").join(sets, "node")
    most = most_differing(percent / 100, samples)

    def meet(group: pa.Table) -> pa.Table:
        bucket, kind, i, j = (group.column(c)[0].as_py() for c in ("bucket", "kind", "i", "j"))
        node, part, component = (group.column(c).to_numpy() for c in ("node", "part", "component"))
        found: list[tuple[int, int]] = []
        if len(np.unique(component)) > 1:
            sketch = np.array(group.column("sketch").to_pylist(), np.int64).view(np.uint64)
            bands = np.array(group.column("bands").to_pylist(), np.int64)
            sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            parent = {int(c): int(c) for c in component}

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            x, y = np.triu_indices(len(node), 1)
            use = component[x] != component[y]
            if kind == "bulk":
                use &= (part[x] < 0) != (part[y] < 0)
            elif i != j:
                use &= part[x] != part[y]
            x, y = x[use], y[use]
            bits = np.zeros(len(x), np.int64)
            for w in range(sketch.shape[1]):
                bits += np.bitwise_count(sketch[x, w] ^ sketch[y, w])
            near = np.flatnonzero(bits <= most)
            x, y, bits = x[near], y[near], bits[near]
            if len(x):
                same = bands[x] == bands[y]
                first = bands[x, same.argmax(axis=1)] == bucket
                x, y, bits = x[first], y[first], bits[first]
            for k in np.argsort(bits, kind="stable"):
                p, q = root(int(component[x[k]])), root(int(component[y[k]]))
                if p != q and linked(sets[x[k]], sets[y[k]], percent):
                    parent[max(p, q)] = min(p, q)
                    found.append((int(component[x[k]]), int(component[y[k]])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    # dealt by all four: else the groups of a bucket would stay in the one task that its join put them in
    return dealt.repartition("bucket", "kind", "i", "j").groupBy("bucket", "kind", "i", "j").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Documents are linked where 100 * intersection >= percent * union of their k-word shingle sets; component_id is
    the least doc_id reachable. Equal sets are one node from the start, by a grouped minimum; so copies never meet.

    Nodes that share a band meet in its bucket. Each is first held against the bucket's least node: the odd sketches
    tell most unlike pairs, full sets decide the rest. Where a bucket still holds several components, its members
    meet block by block (see across()), so that no link between different texts that share a band is lost.

    A key (set, bucket, centre, node) that holds over a hundredth of a join's rows is joined by broadcast of its one
    row on the other side, so that its rows stay spread.

    Null and empty texts, and rows with a null id, are linked with nothing (a null id's component is null, kept
    true). Rows with one id are one document. A text of any length gives its whole set. A pair exactly at the
    threshold is linked; of equal texts the least doc_id stays. Extra columns are left out; an empty table gives no
    rows.
    """
    threshold = percent / 100
    bands = bands_for(threshold)
    signed = written(signatures(docs, k, bands), "signatures")
    real = signed.filter("doc_id IS NOT NULL AND set_id IS NOT NULL")
    nodes = real.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes, "nodes")
    own = real.join(nodes.select("set_id", F.col("node").alias("doc_id")), ["set_id", "doc_id"]).dropDuplicates(["set_id", "doc_id"])
    own = written(own.select(F.col("doc_id").alias("node"), "bands", "sketch"), "node-signatures")

    entries = own.select("node", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.min("node").alias("center"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).filter("center <> last")
    buckets = written(buckets.select("bucket", "center", "n"), "buckets")
    total = own.count() * bands
    hot = [r[0] for r in buckets.filter(F.col("n") > total // 1000 + 1000).select("bucket").collect()]  # fewer than 1000
    members = written(join_hot(entries, buckets.select("bucket", "center"), "bucket", hot=hot), "members")
    inside = members.select("node").distinct()
    sets = written(shingle_sets(docs.join(inside.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"), k).dropDuplicates(["node"]), "sets")

    most = most_differing(threshold, bands * ROWS)
    sketches = own.select("node", "sketch")
    pairs = written(members.filter("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    pairs = join_hot(pairs, _side(sketches, "a", "sketch"), "a").join(_side(sketches, "b", "sketch"), "b")
    pairs = written(pairs.filter(_differing(F.col("sketch_a"), F.col("sketch_b")) <= most).select("a", "b"), "pairs")
    pairs = join_hot(pairs, _side(sets, "a", "shingles", "set"), "a", size="set_a").join(_side(sets, "b", "shingles", "set"), "b")
    first = written(components(confirmed(pairs, percent)), "components")

    placed = members.select("bucket", "node").join(first, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("bucket")
    apart = written(join_hot(placed, mixed, "bucket", hot=hot), "apart")
    second = components(across(apart, own, sets, percent, bands * ROWS)).select(F.col("node").alias("component"), F.col("component").alias("joined"))

    labels = first.unionByName(second.select(F.col("component").alias("node"), "component")).distinct()
    labels = labels.join(second, "component", "left").select("node", F.coalesce("joined", "component").alias("component")).filter("component <> node")
    labels = written(labels, "labels")
    discard(docs.sparkSession, own, buckets, members, sets, first)
    of_set = nodes.join(labels, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    out = join_hot(signed.select("doc_id", "n_shingles", "set_id"), of_set, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _side(df: DataFrame, side: str, column: str, name: str | None = None) -> DataFrame:
    return df.select(F.col("node").alias(side), F.col(column).alias(f"{name or column}_{side}"))


def _differing(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Of each group the document of least doc_id, with all columns.

    Rows without an id, or without words, are in no group and all stay; so do all rows of one kept id. Columns named
    like this operator's own keep their values, and an empty table stays empty.
    """
    gone = near_duplicates(docs, k, percent).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
