"""SimHash near-duplicates with BK-trees.

Fingerprints are made where the documents are read.  Equal fingerprints become one row.  Each
distinct fingerprint then goes to sixteen shards: three differing bits leave one of four 16-bit
blocks equal, and one of four 12-bit blocks of the remaining 48 bits as well, so any linked pair
meets in a shard.  Every shard builds a BK-tree (children keyed by their integer Hamming distance
to the parent) and searches it along the edges within the radius.  Trees travel with the shuffle
that fills their shard and are not broadcast: broadcasting them would take the fingerprints of
all documents through the driver.

A shard reports a spanning set of its links, one fewer than its members at most, never all its
pairs.  A shard that is still large (near copies of one text) is cut once more by nine of the
remaining bits, which again keeps every link.  Components over all shards follow from
:mod:`ledgersieve.llm.components`.

Defined results: null, empty and blank texts have the fingerprint zero and link like any other;
fewer than three words make one shingle; ties of a bit (exactly half) leave it zero; repeated rows
keep their own rows; documents without an id keep their row and never name a component; an empty
table gives no rows; other columns are ignored, or carried by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgersieve.llm.common import stored, unused
from ledgersieve.llm.components import connected

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Members above which a shard is cut once more.
SHARD_ROWS = 20_000
#: Queries that walk a tree at a time.
_WALKERS = 256


def fingerprint(text: bytes | None) -> int:
    """SimHash of the text's three-word shingles as a signed 64-bit number."""
    found = text.lower().split() if text else []
    if not found:
        return 0
    joined = b" ".join(found)
    digest = xxhash.xxh64_digest
    if len(found) <= SHINGLE:
        digests = digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digests = b"".join([
            digest(joined[a:b], SEED)
            for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1:].tolist(), strict=True)
        ])
    bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8)).reshape(-1, 64)
    ones = bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fp") -> DataFrame:
    """The documents with their fingerprint in ``out`` (a long)."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            prints = [fingerprint(t.as_py()) for t in batch.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.int64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


class BKTree:
    """A BK-tree over distinct 64-bit values, stored as arrays so that many searches walk it together."""

    def __init__(self, values: np.ndarray):
        self.values = values
        children: list[dict[int, int]] = [{} for _ in values]
        plain = values.tolist()
        self.parent = np.full(len(plain), -1)
        for node in range(1, len(plain)):
            at, value = 0, plain[node]
            while True:
                apart = (plain[at] ^ value).bit_count()
                below = children[at].get(apart)
                if below is None:
                    children[at][apart] = node
                    self.parent[node] = at
                    break
                at = below
        counts = np.fromiter(map(len, children), dtype=np.int64, count=len(children))
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.child = np.array([c for of in children for c in of.values()], dtype=np.int64)
        self.edge = np.array([e for of in children for e in of], dtype=np.int64)

    def single_component_below(self, label: np.ndarray) -> np.ndarray:
        """The label that a node's whole subtree carries, or -1.  Children always follow their parent."""
        whole = label.copy()
        for node in range(len(whole) - 1, 0, -1):
            up = self.parent[node]
            if whole[node] != whole[up]:
                whole[up] = -1
        return whole

    def links(self, radius: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs within the radius whose labels differ; subtrees that carry the searcher's label are skipped."""
        whole = self.single_component_below(label)
        for start in range(0, len(self.values), _WALKERS):
            who = np.arange(start, min(start + _WALKERS, len(self.values)))
            node = np.zeros(len(who), dtype=np.int64)
            while len(who):
                open_ = whole[node] != label[who]
                who, node = who[open_], node[open_]
                apart = np.bitwise_count(self.values[who] ^ self.values[node]).astype(np.int64)
                near = (apart <= radius) & (label[who] != label[node])
                if near.any():
                    yield who[near], node[near]
                fan = self.first[node + 1] - self.first[node]
                who, low, apart = np.repeat(who, fan), np.repeat(self.first[node], fan), np.repeat(apart, fan)
                slot = low + np.arange(len(low)) - np.repeat(np.cumsum(fan) - fan, fan)
                follow = np.abs(self.edge[slot] - apart) <= radius
                who, node = who[follow], self.child[slot[follow]]


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of ``a[i]`` and ``b[i]``; the smallest member is a set's root."""
    while True:
        parent = _roots(parent)
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        if not differ.any():
            return parent
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def spanning_links(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Member and root of every component of the values (distinct, signed) with two members or more."""
    bits = np.sort(values).view(np.uint64)
    if len(bits) == 2:
        near = int(bits[0] ^ bits[1]).bit_count() <= radius
        return (bits[1:].view(np.int64), bits[:1].view(np.int64)) if near else (values[:0], values[:0])
    tree = BKTree(bits)
    parent = np.arange(len(bits))
    nodes = np.arange(1, len(bits))
    close = nodes[np.bitwise_count(bits[nodes] ^ bits[tree.parent[nodes]]) <= radius]
    parent = _union(parent, close, tree.parent[close])
    pairs = list(tree.links(radius, parent))
    if pairs:
        parent = _union(parent, np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
    linked = np.flatnonzero(parent != np.arange(len(bits)))
    return bits[linked].view(np.int64), bits[parent[linked]].view(np.int64)


def _search(batches):
    """Streams rows sorted by shard; a shard cut by a batch border is carried on."""
    keys, prints = np.empty(0, np.int64), np.empty(0, np.int64)

    def found(keys, prints):
        borders = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], borders)), np.concatenate((borders, [len(keys)]))
        several = ends - starts > 1
        out = [spanning_links(prints[a:b]) for a, b in zip(starts[several].tolist(), ends[several].tolist(), strict=True)]
        a = np.concatenate([x for x, _ in out]) if out else prints[:0]
        b = np.concatenate([x for _, x in out]) if out else prints[:0]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate((keys, batch.column(0).to_numpy()))
        prints = np.concatenate((prints, batch.column(1).to_numpy()))
        if len(keys) and keys[0] != keys[-1]:
            cut = len(keys) - int(np.argmax(keys[::-1] != keys[-1]))
            yield found(keys[:cut], prints[:cut])
            keys, prints = keys[cut:], prints[cut:]
    if len(keys):
        yield found(keys, prints)


def _shards(fp: Column) -> Column:
    """Sixteen shard numbers: which blocks are compared, and their bits."""
    keys = []
    for i in range(4):
        turned = F.shiftleft(fp, 16 * i).bitwiseOR(F.shiftrightunsigned(fp, 64 - 16 * i)) if i else fp
        block, rest = F.shiftrightunsigned(turned, 48), turned.bitwiseAND(F.lit((1 << 48) - 1))
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF))
            keys.append(F.shiftleft(F.shiftleft(F.lit(4 * i + j).cast("long"), 16).bitwiseOR(block), 12).bitwiseOR(part))
    return F.array(*keys)


def _finer(fp: Column) -> Column:
    """Four numbers of nine bits from four places, three of which may differ: one for each of 36 bits a shard has left."""
    table = F.shiftrightunsigned(F.col("shard"), 28).cast("int")
    i, j = F.floor(table / 4).cast("int"), table % 4
    turned = F.when(i == 0, fp)
    for k in range(1, 4):
        turned = turned.when(i == k, F.shiftleft(fp, 16 * k).bitwiseOR(F.shiftrightunsigned(fp, 64 - 16 * k)))
    rest = turned.bitwiseAND(F.lit((1 << 48) - 1))
    low = {k: rest.bitwiseAND(F.lit((1 << (12 * k)) - 1)) for k in range(4)}
    left = F.lit(None).cast("long")
    for k in range(4):
        left = F.when(j == k, F.shiftleft(F.shiftrightunsigned(rest, 12 * (k + 1)), 12 * k).bitwiseOR(low[k])).otherwise(left)
    return F.array(*[
        F.shiftleft(F.col("shard"), 11).bitwiseOR(F.lit(k << 9)).bitwiseOR(F.shiftrightunsigned(left, 9 * k).bitwiseAND(F.lit(0x1FF)))
        for k in range(4)
    ])


def links(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges ``a, b`` that join all distinct fingerprints (column ``fp``) within the radius."""
    if radius > 3:
        raise ValueError("four blocks hold a radius of 3 at most")
    placed = prints.select("fp", F.explode(_shards(F.col("fp"))).alias("shard"))
    large = stored(
        placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_rows)
        .select("shard", F.lit(True).alias("large")),
        "simhash-large",
    )
    several = placed.join(large, "shard", "left")
    cut = several.select(
        "fp",
        F.explode(F.when(F.col("large"), _finer(F.col("fp"))).otherwise(F.array(F.shiftleft("shard", 11)))).alias("shard"),
    )
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        cut.select("shard", "fp").repartition(parts, "shard").sortWithinPartitions("shard", "fp")
        .mapInArrow(_search, "a bigint, b bigint").distinct()
    )


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every document."""
    made = with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    made = stored(made.select("doc_id", "fp"), "simhash-prints")
    return made.join(component_of(made), "fp", "left").select("doc_id", "fp", "component_id")


def component_of(made: DataFrame) -> DataFrame:
    """``fp, component_id, root`` of every distinct fingerprint among ``doc_id, fp``; ``root`` tells components apart."""
    prints = stored(made.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-distinct")
    roots = connected(stored(links(prints), "simhash-links"))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "doc_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return stored(rooted.join(smallest, "root").select("fp", "component_id", "root"), "simhash-components")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each component: that with the smallest id, once.

    Where the id stands on several rows, the fingerprint tells which of them is meant, and the text
    of the smallest hash stays.  Of components without any id one document stays each.
    """
    names = docs.columns
    made = with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    made = stored(made.select("doc_id", "fp"), "simhash-prints")
    kept_id, row, mark = unused(names, "kept_id", "kept_row", "kept_print")
    of = component_of(made)
    # One fingerprint per component among those that have its smallest id; or any, where there is no id.
    chosen = made.join(of, "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.first("doc_id").alias(kept_id), F.min("fp").alias(mark))
    times = made.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    chosen = stored(chosen.join(times, F.col(kept_id).eqNullSafe(F.col("doc_id"))).select(kept_id, mark, "n"), "simhash-kept")
    single, several = chosen.filter((F.col("n") == 1) & F.col(kept_id).isNotNull()), chosen.filter((F.col("n") > 1) | F.col(kept_id).isNull())
    alone = docs.join(single, docs[id_col] == single[kept_id], "left_semi")
    repeated = docs.join(several.select(kept_id).distinct(), docs[id_col].eqNullSafe(F.col(kept_id)), "left_semi")
    marked = with_fingerprint(repeated, text_col, mark)
    same = marked[id_col].eqNullSafe(several[kept_id]) & (marked[mark] == several[mark])
    order = Window.partitionBy(id_col, mark).orderBy(F.xxhash64(text_col))
    once = marked.join(several, same, "left_semi").withColumn(row, F.row_number().over(order)).filter(F.col(row) == 1)
    return alone.select(*names).unionByName(once.select(*names))
