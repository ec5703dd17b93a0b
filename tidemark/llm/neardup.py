"""Near duplicates by HyperMinHash.

A document's set of word shingles is hashed to 64 bits. The first bits choose one of 128 buckets, and a bucket
keeps of its smallest hash the number of leading zeros and the ten bits after the first one: a register of two
bytes. Registers are compared in bands; documents that share a band are candidates, their Jaccard similarity is
estimated from equal registers, corrected for registers that are equal by chance, and what may reach the
threshold is confirmed on the full sets.

Nothing enumerates the pairs of a group:

* documents with equal sets are one node, however many there are;
* in every band group each node is first compared with the group's smallest and largest node only, which
  connects large groups of near copies with two candidates per node;
* groups that still hold several components are joined to families by their commonest component, and the nodes
  outside it are compared with all members in blocks: estimates by registers, full sets in the same task, likeliest
  first, until their components have met. Rejected pairs stay in the task and are no rows.

With 25 bands of 5 registers, two sets at the threshold of 0.85 share no band with probability 4e-7, and less
above it. Nodes and shingles are 64-bit hashes.

Defined results: a null text, or one without words, has an empty set, is linked with nothing and stays; ids may
be null or repeat, the smallest non-null id names a component. Only the id and the text are read. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix64
from tidemark.llm.components import components
from tidemark.llm.shingles import shingle_sets
from tidemark.session import written

BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
BANDS, ROWS = 25, 5
THRESHOLD = 85  # percent
# An estimate is rejected if the threshold lies further off than this many standard deviations.
DEVIATIONS = 4.0
# Nodes and bytes of full sets of one block in the mean: a block pair is compared in one task.
BLOCK = 2048
BLOCK_BYTES = 16 << 20
# Size of the bitmap of ids whose full sets are needed, as a power of two of bits.
MARK_BITS = 26
# Limit of equal registers by chance per bucket, for large sets of equal size, times two to the mantissa bits.
CHANCE = 0.169919487159739093975315012348


def registers(shingles: np.ndarray) -> np.ndarray:
    """128 registers of a sorted set of hashes; 0 is an empty bucket."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(shingles):
        limits = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
        first = np.searchsorted(shingles, limits)
        filled = np.flatnonzero(np.diff(np.append(first, len(shingles))))
        # the hash is uniform within its bucket; sorted sets have each bucket's smallest hash first
        rest = (shingles[first[filled]] << np.uint64(BUCKET_BITS)) >> np.uint64(11)
        part, bits = np.frexp(rest.astype(np.float64))
        mantissa = np.where(rest > 0, (part * 2 - 1) * (1 << MANTISSA_BITS), 0).astype(np.uint16)
        zeros = np.where(rest > 0, 53 - bits, 53).astype(np.uint16)
        out[filled] = ((zeros + 1) << MANTISSA_BITS) | mantissa
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register rows, and the number of buckets each rests on."""
    filled_a, filled_b = a != 0, b != 0
    used = (filled_a | filled_b).sum(axis=1)
    equal = ((a == b) & filled_a).sum(axis=1)
    ratio = n_a / np.maximum(n_b, 1)
    chance = CHANCE / (1 << MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2 * (filled_a & filled_b).sum(axis=1)
    # what is equal by chance falls on the buckets that do not agree
    share = equal / np.maximum(used, 1)
    return np.clip((equal - chance * (1 - share)) / np.maximum(used, 1), 0.0, 1.0), used


def possible(a, b, n_a, n_b, threshold: int = THRESHOLD) -> np.ndarray:
    """Which pairs may reach the threshold, by set sizes and estimate."""
    sizes = 100 * np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b)
    guess, used = estimate(a, b, n_a, n_b)
    slack = DEVIATIONS * np.sqrt(np.maximum(guess * (1 - guess), 0.05) / np.maximum(used, 1))
    return sizes & (guess + slack >= threshold / 100)


def sketch(docs: DataFrame, id_col: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """(id, n, node, regs) per row, with ``full`` also the sorted shingles; node is null for an empty set."""
    id_type = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 512
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                sets = shingle_sets(part.column(1).to_pylist())
                raw = [s.tobytes() for s in sets]
                nodes = [int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "little", signed=True) if r else None for r in raw]
                columns = {
                    "id": part.column(0),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "node": pa.array(nodes, pa.int64()),
                    "regs": pa.array([registers(s).tobytes() for s in sets], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(columns | ({"shingles": pa.array(raw, pa.binary())} if full else {}))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n long, node long, regs binary" + (", shingles binary" if full else ""))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def bands(nodes: DataFrame) -> DataFrame:
    """(key, node) for every band of a node that is not empty."""
    factors = mix64(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    salts = mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(1000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = _matrix(batch.column(1))[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
            with np.errstate(over="ignore"):
                keys = mix64((regs.astype(np.uint64) * factors).sum(axis=2, dtype=np.uint64) ^ salts).view(np.int64)
            filled = regs.any(axis=2)
            node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), filled.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(keys[filled], pa.int64()), pa.array(node, pa.int64())], names=["key", "node"])

    return nodes.select("node", "regs").mapInArrow(run, "key long, node long")


def _candidates(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose registers leave the threshold possible."""

    @F.arrow_udf("boolean")
    def test(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
        return pa.array(possible(_matrix(a), _matrix(b), n_a.to_numpy(), n_b.to_numpy(), threshold))

    of = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    fits = 100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    sized = pairs.join(of("a").select("a", "n_a", "regs_a"), "a").join(of("b"), "b").filter(fits)
    return sized.filter(test("regs_a", "regs_b", "n_a", "n_b")).select("a", "b")


def _links(pairs: DataFrame, full: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    @F.arrow_udf("long")
    def common(a: pa.Array, b: pa.Array) -> pa.Array:
        out = [
            len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)
        ]
        return pa.array(out, pa.int64())

    both = pairs.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("s_a")), "a").join(
        full.select(F.col("node").alias("b"), F.col("shingles").alias("s_b")), "b"
    )
    size = F.octet_length("s_a") / 8 + F.octet_length("s_b") / 8
    counted = both.select("a", "b", size.alias("size"), common("s_a", "s_b").alias("inter"))
    return counted.filter(100 * F.col("inter") >= threshold * (F.col("size") - F.col("inter"))).select("a", "b")


def _sets(rows: DataFrame, nodes: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, shingles) of the needed nodes, once each, as a written table.

    Full sets are wider than the texts and most are needed by no pair, so they are not kept from the first scan:
    the texts of the needed nodes are sketched again, found by the smallest id of each node.
    """
    ids = needed.join(nodes, "node").select(F.col("rep").alias("id"))
    again = sketch(_marked(rows, ids, "id"), "id", "text", full=True).select("node", "shingles")
    full = again.join(needed, "node").groupBy("node").agg(F.first("shingles").alias("shingles"))
    return written(needed.sparkSession, full)


def _marked(rows: DataFrame, needed: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be needed, by a bitmap of hashed keys.

    The bitmap has 2 ** MARK_BITS bits, 8 MB, however many keys there are, and may be broadcast: no row is shuffled.
    """
    mark = F.pmod(F.xxhash64(key), F.lit(1 << MARK_BITS))
    bucket, place = F.shiftright(mark, 15), mark.bitwiseAND(F.lit((1 << 15) - 1))
    bitmap = needed.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits"))
    byte = F.substring(F.col("bits"), (F.col("place") / 8 + 1).cast("int"), F.lit(1))
    bit = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.expr("shiftleft(1, cast(place % 8 as int))"))
    marked = rows.withColumns({"bucket": bucket, "place": place}).join(F.broadcast(bitmap), "bucket")
    return marked.filter(bit != 0).select(*rows.columns)


def _within(group: dict, threshold: int) -> list[tuple[int, int]]:
    """Links that join the components of one block pair: best estimates first, confirmed on full sets.

    Every pair of different components that may reach the threshold is confirmed or rejected, unless its
    components have met before its turn.
    """
    node, n, label, out, regs, sets = (group[k] for k in ("node", "n", "label", "out", "regs", "sets"))
    label = label.copy()
    found: list[tuple[int, int]] = []
    for i in np.flatnonzero(out):
        apart = np.flatnonzero((label != label[i]) & (100 * np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i])))
        if not len(apart):
            continue
        mine = np.broadcast_to(regs[i], (len(apart), BUCKETS))
        size = np.full(len(apart), n[i])
        ok = possible(mine, regs[apart], size, n[apart], threshold)
        guess = estimate(mine[ok], regs[apart[ok]], size[ok], n[apart[ok]])[0]
        others = apart[ok][np.argsort(-guess, kind="stable")]
        own, step = np.frombuffer(sets[i], np.uint64), 1
        while len(others):
            taken, others = others[:step], others[step:]
            step = min(4 * step, 256)
            inter = _common(own, [sets[j] for j in taken])
            for j in taken[100 * inter >= threshold * (n[i] + n[taken] - inter)]:
                if label[j] != label[i]:
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
                    label[label == label[j]] = label[i]
            others = others[label[others] != label[i]]
    return found


def _common(own: np.ndarray, others: list[bytes]) -> np.ndarray:
    """Sizes of the intersections of one sorted set with others; no set is empty."""
    flat = np.frombuffer(b"".join(others), np.uint64)
    at = np.searchsorted(own, flat)
    hit = own[np.minimum(at, len(own) - 1)] == flat
    starts = np.cumsum([0] + [len(o) // 8 for o in others[:-1]])
    return np.add.reduceat(hit.astype(np.int64), starts)


def _across(members: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between components, from (family, lo, hi, out, node, n, label, regs, shingles).

    Rows arrive sorted by (family, lo, hi); such a group is one pair of blocks and is compared in one task.
    """
    numbers = ("family", "lo", "hi", "out", "node", "n", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict | None = None

        def links(data: dict, last: bool) -> tuple[pa.RecordBatch, dict | None]:
            edge = np.zeros(len(data["node"]) - 1, bool)
            for k in ("family", "lo", "hi"):
                edge |= np.diff(data[k]) != 0
            starts = [0, *(np.flatnonzero(edge) + 1).tolist(), len(data["node"])]
            ends = starts if last else starts[:-1]
            found = [pair for x, y in zip(ends, ends[1:], strict=False) for pair in _within({k: v[x:y] for k, v in data.items()}, threshold)]
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            batch = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            return batch, None if last else {k: v[starts[-2] :] for k, v in data.items()}

        for batch in batches:
            if not batch.num_rows:
                continue
            data = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in numbers}
            data |= {"regs": _matrix(batch.column("regs")), "sets": batch.column("shingles").to_pylist()}
            if rest is not None:
                data = {k: rest[k] + v if k == "sets" else np.concatenate([rest[k], v]) for k, v in data.items()}
            found, rest = links(data, False)
            yield found
        if rest is not None:
            yield links(rest, True)[0]

    return members.select(*numbers, "regs", "shingles").mapInArrow(run, "a long, b long").distinct()


def _families(placed: DataFrame) -> DataFrame:
    """(family, node, label) of the groups that hold several components.

    Groups are joined by their commonest component, the family. Two nodes of a group that lie in different
    components are members of one family, and one of them lies outside its component: only those are compared
    with all members. A large component that shows up in every band is one family with each member once.
    """
    counted = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    tops = counted.groupBy("key").agg(F.max(F.struct("c", "label")).getField("label").alias("family"), F.count(F.lit(1)).alias("parts"))
    tops = written(placed.sparkSession, tops.filter("parts > 1").select("key", "family"))
    return placed.join(tops, "key").select("family", "node", "label").distinct()


def _blocks(members: DataFrame) -> DataFrame:
    """Deals members into hashed blocks of bounded number and bytes: ``lo`` of nodes outside the component, ``hi`` of all."""
    out = F.col("label") != F.col("family")
    slices = lambda keep: F.greatest(
        F.ceil(F.count_if(keep) / F.lit(BLOCK)), F.ceil(F.sum(F.when(keep, F.col("n"))) * 8 / F.lit(BLOCK_BYTES))
    ).cast("int")
    counted = members.groupBy("family").agg(slices(out).alias("los"), slices(F.lit(True)).alias("his"))
    rows = members.join(counted, "family")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    slot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    names = ("family", "lo", "hi", "out", "node", "n", "label")
    compared = rows.filter(out).withColumns({"lo": slot("los"), "hi": F.explode(every("his")), "out": F.lit(True)})
    met = rows.withColumns({"hi": slot("his"), "lo": F.explode(every("los")), "out": F.lit(False)})
    # a compared node also meets its own block once more as a member; that row has the same label and is passed over
    return compared.select(*names).unionByName(met.select(*names))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(id, n_shingles, component_id, kept, label) per row; rows of one component share the label."""
    spark = docs.sparkSession
    sketched = written(spark, sketch(docs, id_col, text))
    named = sketched.filter("node is not null")
    nodes = written(
        spark, named.groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    keys = bands(nodes)
    groups = written(spark, keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("m")).filter("m > 1"))
    shared = written(spark, keys.join(groups, "key"))
    hubs = shared.select("node", F.explode(F.array("low", "high")).alias("hub")).filter("node <> hub")
    pairs = hubs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    pairs = written(spark, _candidates(pairs, nodes, threshold))
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    links = written(spark, _links(pairs, _sets(rows, nodes, ends), threshold))
    labels = components(links)

    # groups that still hold more than one component; groups of two have been compared already
    known = F.coalesce("label", "node").alias("label")
    placed = written(spark, shared.filter("m > 2").select("key", "node").join(labels, "node", "left").select("key", "node", known))
    members = written(spark, _families(placed).join(nodes.select("node", "n"), "node"))
    full = _sets(rows, nodes, members.select("node").distinct()).join(nodes.select("node", "regs"), "node")
    blocks = _blocks(members).join(full, "node").repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi")
    more = written(spark, _across(blocks, threshold))
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l_{x}"))
    joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = joined.select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
    merged = components(joined).select(F.col("node").alias("label"), F.col("label").alias("top"))

    first = labels.select("node", F.col("label").alias("near"))
    final = nodes.select("node", "rep").join(first, "node", "left").withColumn("label", F.coalesce("near", "node"))
    final = final.join(merged, "label", "left").select("node", "rep", F.coalesce("top", "label").alias("label"))
    smallest = final.groupBy("label").agg(F.min("rep").alias("component_id"))
    final = final.join(smallest, "label").select("node", "label", "component_id")
    out = sketched.select("id", "n", "node").join(final, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        "id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "label"
    )
