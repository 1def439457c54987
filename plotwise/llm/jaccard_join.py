"""N-gram Jaccard join by prefix trees (operator 4).

Each document is its set of distinct word shingles.  All sets are ordered by one global order: shingles that are not known to be frequent
first, by hash, then the frequent ones from rare to common.  Two sets with similarity of 3/4 or more must share a shingle among the first
quarter of either, so only those prefixes are sent out; a bucket of the hash space keeps the shingles that several documents have there, and
sizes and places tell which pairs can't reach the overlap.  Candidates of one centre document meet in a task, a bounded number at a time.
Their ordered sets are stored in a trie, a node for each beginning where sets part.  The centre is matched from the root down: the overlap
with a node's label is counted once for all sets below it, and a whole subtree is left as soon as the overlap so far and what remains of the
centre, or of the longest set below, can't reach the bound of the shortest.

Which pairs: first each shingle's group is tied to its likely hub (a star, not all pairs); then of the documents that are not yet in one
component, and may link by places, sizes and bitmaps, a forest of the likeliest pairs is tried; last all such pairs that are still left.  (A bitmap has one bit toggled for each shingle; where two differ in
more bits than the sets may in shingles, there is no link.)  So a group of many near copies costs its size, and no link between different
components is lost.  Documents with equal sets are one class, and stand in the join as one, by the least id.

The links themselves (`link_documents`): a link never leaves a component, so every two representatives of a component are tried, whatever was
tried before.  A component is cut to parts of about PART representatives, and each two parts meet in a task, which counts common shingles by
products of incidence matrices.  The work of this step, like the number of links in a group of near copies, grows with the square of a component.

The order need not be exact to be right: any fixed order is.  So the frequencies may come from prefixes by hash alone, and the table of
frequent shingles may be bounded (MOST_FREQUENT), which bounds what is broadcast.

Cases.  Null or empty text, or no word: an empty set, linked with nothing.  Fewer words than a shingle: the whole sequence is the one shingle.
Repeated rows with one doc_id: equal to a class if their texts are equal; else each row has its own set, and they share the id's component.
Null doc_id: a row with its set's size and a null component.  Very long texts: their whole sets, in one task as their text is.  Ties (a
similarity of 3/4 exactly) link.  No rows: no rows.  doc_id must be of an integer type (TypeError else).  Shingles are compared by a 64-bit
hash, whole sets by two.  Columns other than doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.llm import blocks, text as tx
from plotwise.llm.components import components, contract
from plotwise.llm.shared import integer_ids, pieces, saved

WORDS = 5
FREQUENT = 32
MOST_FREQUENT = 1 << 18
MEMBERS = 128
#: Documents of one shingle that meet in one task: a larger group is cut to parts, and each two parts meet.
GROUP = 4096
#: Representatives of one component that meet in one task, when links are listed: a larger component is cut to parts, and each two parts meet.
PART = 256
#: Shingles in one product of incidence matrices.
COLUMNS = 4096
#: Stored bytes of documents for each bucket of the hash space.
BUCKET_BYTES = 12 << 20
#: Groups up to so many documents are paired by a plain join; a task's bitmaps pay for larger ones only.
SMALL_GROUP = 32


def shingles(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the n+1 offsets of the texts among them."""
    data, offsets = tx.flat(texts)
    data = tx.lowered(data)
    starts, ends, before = tx.words(data, offsets)
    h = tx.word_hashes(data, starts, ends)
    doc = tx.owner(before)
    grams = tx.ngrams(h, n)
    whole = np.flatnonzero(doc[: len(grams)] == doc[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
    value, whose = grams[whole], doc[whole]
    size = np.diff(before)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        alone = np.array([tx.ngrams(h[before[k] : before[k + 1]], int(size[k]))[0] for k in short], np.uint64)
        value, whose = np.concatenate((value, alone)), np.concatenate((whose, short))
    by = np.lexsort((value, whose))
    value, whose = value[by], whose[by]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (whose[1:] != whose[:-1])
    value, whose = value[new], whose[new]
    return value, np.searchsorted(whose, np.arange(len(before)))


def _places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item its place in its set, and the set's size."""
    size = np.diff(at)
    return np.arange(at[-1]) - np.repeat(at[:-1], size), np.repeat(size, size)


def _in_prefix(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    return place <= size - -(-3 * size // 4)


def _survey(buckets: int):
    """Rows of two kinds by bucket. kind 0: (set hash, size) and document; kind 1: prefix shingles by hash and how many documents of the piece have them."""

    def rows(kind: int, keys: np.ndarray, other: list[np.ndarray]):
        edges = blocks.bucket_edges(keys, buckets)
        spans = [(b, x, y) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([kind] * len(spans), pa.int32()),
                pa.array([b for b, _, _ in spans], pa.int32()),
                pa.array([blocks.pack(keys[x:y]) for _, x, y in spans], pa.binary()),
                pa.array([blocks.pack(other[0][x:y]) for _, x, y in spans], pa.binary()),
                pa.array([blocks.pack(other[1][x:y]) if len(other) > 1 else b"" for _, x, y in spans], pa.binary()),
            ],
            names=["kind", "bucket", "keys", "values", "more"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            value, at = shingles(part.column("text"))
            place, size = _places(at)
            keys, counts = np.unique(value[_in_prefix(place, size)], return_counts=True)
            yield rows(1, keys, [counts.astype(np.int64)])
            full = np.flatnonzero(np.diff(at) > 0)
            ids = part.column("doc_id")
            full = full[np.asarray(ids.is_valid())[full]]
            if len(full):
                one = np.concatenate(([np.uint64(0)], np.cumsum(tx.mix(value), dtype=np.uint64)))
                two = np.concatenate(([np.uint64(0)], np.cumsum(tx.mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)))
                a, b = tx.mix(one[at[full + 1]] - one[at[full]]), two[at[full + 1]] - two[at[full]]
                by = np.argsort(a, kind="stable")
                yield rows(0, a[by], [ids.to_numpy(zero_copy_only=False)[full].astype(np.int64)[by], b[by]])

    return run


def _survey_sums(table: pa.Table) -> pa.Table:
    """kind 0: (doc_id, least doc_id with the same set); kind 1: (shingle, documents) of the frequent ones."""
    kind = table.column("kind")[0].as_py()
    keys = np.concatenate([blocks.unpack(x, np.uint64) for x in table.column("keys").to_pylist()])
    values = np.concatenate([blocks.unpack(x, np.int64) for x in table.column("values").to_pylist()])
    if kind == 0:
        more = np.concatenate([blocks.unpack(x, np.uint64) for x in table.column("more").to_pylist()])
        by = np.lexsort((values, more, keys))
        keys, more, values = keys[by], more[by], values[by]
        first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])))
        least = np.repeat(values[first], np.diff(np.append(first, len(keys))))
        left, right = values, least
    else:
        by = np.argsort(keys, kind="stable")
        keys = keys[by]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(values[by], first)
        left, right = keys[first][total >= FREQUENT].astype(np.int64), total[total >= FREQUENT]
    return pa.table({"kind": pa.array([kind] * len(left), pa.int32()), "left": pa.array(left), "right": pa.array(right)})


class Order:
    """The global order: rank 0 and then the hash for most shingles, ranks from rare to common for the frequent ones."""

    def __init__(self, frequent: np.ndarray, documents: np.ndarray):
        by = np.argsort(frequent)
        self.keys = np.append(frequent[by], np.uint64(0xFFFFFFFFFFFFFFFF))
        rank = np.empty(len(frequent), np.int32)
        rank[np.lexsort((frequent, documents))] = np.arange(1, len(frequent) + 1)
        self.ranks = np.append(rank[by], 0).astype(np.int32)

    def rank(self, value: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, value), len(self.keys) - 1)
        return np.where(self.keys[at] == value, self.ranks[at], 0)


def _prefixes(buckets: int, shared):
    """The prefixes of all sets in the global order, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for part in pieces(batches, "text"):
            value, at = shingles(part.column("text"))
            doc = tx.owner(at)
            rank = order.rank(value)
            moved = np.lexsort((rank, doc))  # stable, so by hash within a rank
            value = value[moved]
            place, size = _places(at)
            use = np.flatnonzero(_in_prefix(place, size) & np.asarray(part.column("doc_id").is_valid())[doc])
            use = use[np.argsort(value[use], kind="stable")]
            keys = value[use]
            ids = part.column("doc_id").fill_null(0).to_numpy().astype(np.int64)[doc[use]]
            edges = blocks.bucket_edges(keys, buckets)
            spans = [(b, x, y) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _, _ in spans], pa.int32())]
                + [pa.array([blocks.pack(v[x:y]) for _, x, y in spans], pa.binary()) for v in (keys, ids, size[use].astype(np.int32), place[use].astype(np.int32))],
                names=["bucket", "keys", "ids", "sizes", "places"],
            )

    return run


def _shared_prefixes(table: pa.Table) -> pa.Table:
    """(token, doc_id, size, place) of the shingles that several documents of the bucket have in their prefixes."""
    keys, ids, sizes, places = (
        np.concatenate([blocks.unpack(x, t) for x in table.column(c).to_pylist()]) for c, t in (("keys", np.uint64), ("ids", np.int64), ("sizes", np.int32), ("places", np.int32))
    )
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    same = np.append(False, keys[1:] == keys[:-1])
    several = same | np.append(same[1:], False)
    by = by[several]
    return pa.table({"token": pa.array(keys[several].astype(np.int64)), "doc_id": pa.array(ids[by]), "size": pa.array(sizes[by]), "place": pa.array(places[by])})


def _can_link(a: str, b: str):
    """Whether the overlap can reach 3/7 of both sizes, if this shingle is the first that the two sets share."""
    left = F.least(F.col(f"{a}.size") - F.col(f"{a}.place"), F.col(f"{b}.size") - F.col(f"{b}.place"))
    return 7 * left >= 3 * (F.col(f"{a}.size") + F.col(f"{b}.size"))


class Trie:
    """Ascending arrays of numbers, stored by common beginnings: a node is a run of the sorted sets that share its items."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        self.sets = [sets[k] for k in self.order]
        self.size = np.array([len(m) for m in self.sets], np.int64)
        self.common = np.zeros(len(sets), np.int64)  # items that a set shares with the one before it
        for k in range(1, len(sets)):
            a, b = self.sets[k - 1], self.sets[k]
            top = min(len(a), len(b))
            differ = np.flatnonzero(a[:top] != b[:top])
            self.common[k] = differ[0] if len(differ) else top
        self.read = 0

    def linked(self, centre: np.ndarray) -> list[int]:
        """Numbers of the sets whose similarity to the centre is 3/4 or more: overlap of 3/7 of both sizes."""
        links: list[int] = []
        open_ = [(0, len(self.sets), 0, 0)] if self.sets else []  # a subtree: its sets, how many items they share, how many of these the centre has
        while open_:
            lo, hi, depth, found = open_.pop()
            least, most = int(self.size[lo:hi].min()), int(self.size[lo:hi].max())
            first = self.sets[lo]

            def reachable(at: int, have: int, first=first, least=least, most=most) -> bool:
                passed = int(np.searchsorted(centre, first[at - 1], "right")) if at else 0
                return 7 * (have + min(most - at, len(centre) - passed)) >= 3 * (len(centre) + least)

            end = int(self.common[lo + 1 : hi].min()) if hi - lo > 1 else int(self.size[lo])
            while depth < end and reachable(depth, found):  # a long label in steps
                label = first[depth : min(end, depth + 256)]
                at = np.searchsorted(centre, label)
                found += int((centre[np.minimum(at, len(centre) - 1)] == label).sum())
                depth += len(label)
                self.read += len(label)
            if depth < end or not reachable(depth, found):
                continue  # the whole subtree is left
            cuts = [lo, *(lo + 1 + np.flatnonzero(self.common[lo + 1 : hi] == end)).tolist(), hi]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a == 1 and self.size[a] == end:
                    if 7 * found >= 3 * (len(centre) + end):
                        links.append(self.order[a])
                else:
                    open_.append((a, b, end, found))
        return links


def _verify(shared):
    """Links between centres and members. Rows come sorted: each centre's row is followed by its members' rows."""

    def numbered(rows: list[tuple[int, np.ndarray]], order: Order) -> list[np.ndarray]:
        value = np.concatenate([v for _, v in rows])
        distinct, back = np.unique(value, return_inverse=True)
        number = np.empty(len(distinct), np.int64)
        number[np.lexsort((distinct, order.rank(distinct)))] = np.arange(len(distinct))
        cuts = np.cumsum([0, *(len(v) for _, v in rows)])
        return [np.sort(number[back[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        group, key = [], None

        def links():
            if len(group) < 2 or group[0][2]:
                return []
            sets = numbered([(i, v) for i, v, _ in group], order)
            return [(group[0][0], group[k + 1][0]) for k in Trie(sets[1:]).linked(sets[0])]

        for part in pieces(batches, "text"):
            value, at = shingles(part.column("text"))
            out = []
            for k, (centre, salt, member, doc_id) in enumerate(zip(*(part.column(c).to_pylist() for c in ("centre", "salt", "member", "doc_id")), strict=True)):
                if (centre, salt) != key:
                    out += links()
                    group, key = [], (centre, salt)
                group.append((doc_id, value[at[k] : at[k + 1]], member))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])
        out = links()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return run


def _links(own: DataFrame, pairs: DataFrame, shared) -> DataFrame:
    """The pairs (a, b) whose documents link. A centre's members are dealt to tasks in groups of about MEMBERS."""
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    salted = pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    wants = salted.select(F.col("b").alias("id"), F.col("a").alias("centre"), "salt", F.lit(True).alias("member"))
    centres = salted.select(F.col("a").alias("id"), F.col("a").alias("centre"), "salt", F.lit(False).alias("member")).distinct()
    wants = wants.unionByName(centres).groupBy("id").agg(F.collect_list(F.struct("centre", "salt", "member")).alias("to"))
    texts = own.join(wants, own["doc_id"] == wants["id"]).select("doc_id", "text", F.explode("to").alias("to")).select("to.*", "doc_id", "text")
    met = texts.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "member")
    return met.mapInArrow(_verify(shared), "a long, b long")


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(integer_ids(docs), F.col("text").cast("string").alias("text"))


def _grouped(own: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """facts (doc_id, n_shingles, bitmap), classes (doc_id, class_id) of documents with words, groups (node, component) of linked representatives."""
    spark = own.sparkSession
    buckets = blocks.block_count(own, BUCKET_BYTES)
    surveyed = own.mapInArrow(_survey(buckets), "kind int, bucket int, keys binary, values binary, more binary")
    surveyed = saved(surveyed.repartition(2 * buckets, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(_survey_sums, "kind int, left long, right long"), "jaccard-survey")
    classes = surveyed.where("kind = 0").groupBy(F.col("left").alias("doc_id")).agg(F.min("right").alias("class_id"))
    frequent = surveyed.where("kind = 1").orderBy(F.desc("right"), "left").limit(MOST_FREQUENT).toArrow()
    shared = spark.sparkContext.broadcast(Order(frequent.column("left").to_numpy().astype(np.uint64), frequent.column("right").to_numpy()))
    packed = own.mapInArrow(_prefixes(buckets, shared), "bucket int, keys binary, ids binary, sizes binary, places binary")
    found = packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_shared_prefixes, "token long, doc_id long, size int, place int")
    copies = classes.where(F.col("doc_id") != F.col("class_id")).select("doc_id")
    tokens = saved(found.join(copies, "doc_id", "left_anti"), "jaccard-prefixes")

    facts = saved(own.mapInArrow(_facts, "doc_id long, n_shingles long, bitmap binary"), "jaccard-facts")
    # the likely hub of a group has the fewest shingles of its own before the shared one
    hubs = tokens.groupBy("token").agg(F.min(F.struct("place", "doc_id", "size")).alias("c")).select("token", "c.*")
    pairs = hubs.alias("x").join(tokens.alias("y"), "token").where((F.col("x.doc_id") != F.col("y.doc_id")) & _can_link("x", "y"))
    tried = saved(pairs.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct(), "jaccard-pairs")
    links = saved(_links(own, tried, shared), "jaccard-links")
    groups = components(links)
    # of repeated ids there is no bitmap, and they are not pruned
    bitmaps = facts.groupBy("doc_id").agg(F.when(F.count("*") == 1, F.first("bitmap")).alias("bitmap"))
    for forest in (True, False):
        rest = _apart(tokens, groups, bitmaps, forest)
        rest = saved(rest.join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"), "jaccard-pairs")
        if not rest.isEmpty():
            tried = tried.unionByName(rest)
            links = saved(links.unionByName(_links(own, rest, shared)), "jaccard-links")
            groups = components(links)
    return facts, classes, groups


def _apart(tokens: DataFrame, groups: DataFrame, bitmaps: DataFrame, forest: bool) -> DataFrame:
    """Pairs (a, b) of documents that share a shingle and may link, but are in different components yet; or, of large groups, a forest of them."""
    mine = tokens.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = mine.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("token", "n")
    mine = mine.join(mixed, "token")
    small, large = mine.where(F.col("n") <= SMALL_GROUP), mine.where(F.col("n") > SMALL_GROUP)
    few = small.alias("x").join(small.alias("y"), "token").where((F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component")) & _can_link("x", "y"))
    few = few.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    large = large.withColumn("parts", F.ceil(F.col("n") / GROUP).cast("int")).join(bitmaps, "doc_id")
    large = large.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = large.select("token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "doc_id", "size", "place", "component", "bitmap")
    return few.unionByName(met.groupBy("token", "i", "j").applyInArrow(_near_pairs(forest), "a long, b long")).distinct()


def _labelled(facts: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    labels = classes.join(groups, classes["class_id"] == groups["node"], "left").select("doc_id", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    return facts.join(labels, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def join_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document."""
    return _labelled(*_grouped(_own(docs))).drop("class_id")


def link_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (doc_id, n_shingles, component_id, class_id, n_links) of all documents, and links (a, b), a < b, of all class representatives that link.

    n_links counts the links of a document's representative, so those to texts that differ from its own."""
    own = _own(docs)
    facts, classes, groups = _grouped(own)
    links = saved(_parts_met(own, groups).mapInArrow(_block_links(False), "a long, b long"), "jaccard-links")
    degrees = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return _with_degrees(_labelled(facts, classes, groups), degrees), links


def linked_documents(docs: DataFrame) -> DataFrame:
    """The members of link_documents. Links are counted where they are found, and never listed."""
    own = _own(docs)
    facts, classes, groups = _grouped(own)
    degrees = _parts_met(own, groups).mapInArrow(_block_links(True), "class_id long, n long").groupBy("class_id").agg(F.sum("n").alias("n_links"))
    return _with_degrees(_labelled(facts, classes, groups), degrees)


def _with_degrees(members: DataFrame, degrees: DataFrame) -> DataFrame:
    return members.join(degrees, "class_id", "left").select("doc_id", "n_shingles", "component_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _parts_met(own: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents of each component by parts, each two parts together and sorted."""
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = groups.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    texts = own.join(dealt, own["doc_id"] == dealt["node"]).select("component", "part", "doc_id", "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = texts.select("component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "doc_id", "text")
    return met.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many items each set on the left has in common with each on the right."""
    a, b = np.concatenate(left), np.concatenate(right)
    rows_a, rows_b = (np.repeat(np.arange(len(side)), [len(v) for v in side]) for side in (left, right))
    shared = np.intersect1d(a, b)
    found = np.zeros((len(left), len(right)), np.int64)
    for k in range(0, len(shared), COLUMNS):
        keys = shared[k : k + COLUMNS]
        sides = []
        for value, row, n in ((a, rows_a, len(left)), (b, rows_b, len(right))):
            at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            hit = keys[at] == value
            m = np.zeros((n, len(keys)), np.float32)
            m[row[hit], at[hit]] = 1
            sides.append(m)
        found += (sides[0] @ sides[1].T).astype(np.int64)
    return found


def _block_links(count: bool):
    """The links (a, b) of two parts of a component, or how many (class_id, n) each document has of them. Rows come sorted by component and parts."""

    def links(key: tuple, group: list) -> pa.RecordBatch:
        _, i, j = key
        left = [(d, v) for p, d, v in group if p == i]
        right = left if i == j else [(d, v) for p, d, v in group if p == j]
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left and right:
            common = common_counts([v for _, v in left], [v for _, v in right])
            total = np.array([len(v) for _, v in left])[:, None] + np.array([len(v) for _, v in right])[None, :]
            x, y = np.nonzero((7 * common >= 3 * total) & (common > 0))
            a, b = np.array([d for d, _ in left])[x], np.array([d for d, _ in right])[y]
            # both orders of a pair within one part, and repeated ids
            a, b = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)))[:, a != b], axis=1)
        if count:
            a, b = np.unique(np.concatenate((a, b)), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["class_id", "n"] if count else ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key = [], None
        for part in pieces(batches, "text"):
            value, at = shingles(part.column("text"))
            for k, (component, i, j, mine, doc_id) in enumerate(zip(*(part.column(c).to_pylist() for c in ("component", "i", "j", "part", "doc_id")), strict=True)):
                if (component, i, j) != key:
                    if key:
                        yield links(key, group)
                    group, key = [], (component, i, j)
                group.append((mine, doc_id, value[at[k] : at[k + 1]]))
        if key:
            yield links(key, group)

    return run


def _bits(size: np.ndarray) -> np.ndarray:
    """Bits of a set's bitmap: a power of two, four times its size or more, within bounds."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(4 * size, 1))).astype(np.int64), 64, 8192)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size of each set, and its bitmap: each shingle toggles one bit, so two bitmaps differ in no more bits than the sets in shingles."""
    for part in pieces(batches, "text"):
        value, at = shingles(part.column("text"))
        size = np.diff(at)
        bits = _bits(size)
        start = np.concatenate(([0], np.cumsum(bits // 64)))
        doc = tx.owner(at)
        bit = value & (bits[doc] - 1).astype(np.uint64)
        words = np.zeros(start[-1], np.uint64)
        np.bitwise_xor.at(words, start[doc] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(size.astype(np.int64)), pa.array([words[a:b].tobytes() for a, b in zip(start[:-1], start[1:], strict=True)], pa.binary())], names=["doc_id", "n_shingles", "bitmap"]
        )


def spanning(left: np.ndarray, right: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Numbers of the edges of a cheapest forest: each tree takes its cheapest edge to another, and the trees are joined, until no edge leads on."""
    nodes, ends = np.unique(np.concatenate((left, right)), return_inverse=True)
    label = np.arange(len(nodes))
    edges, chosen = np.argsort(cost, kind="stable"), [np.zeros(0, np.int64)]
    while True:
        x, y = label[ends[edges]], label[ends[len(left) + edges]]
        apart = x != y
        edges, x, y = edges[apart], x[apart], y[apart]
        if not len(edges):
            return np.unique(np.concatenate(chosen))
        place = np.full(len(nodes), len(edges))
        for side in (x, y):
            np.minimum.at(place, side, np.arange(len(edges)))
        best = np.unique(place[place < len(edges)])
        chosen.append(edges[best])
        moved, to = contract(x[best], y[best])
        joined = np.arange(len(nodes))
        joined[moved] = to
        label = joined[label]


def _near_pairs(forest: bool):
    """Pairs of one shingle's documents in different components that places, sizes and bitmaps leave possible; or a forest of the likeliest, so that
    the links among them join the components before all pairs that are left are tried."""

    def run(table: pa.Table) -> pa.Table:
        a, b, differ, component_a, component_b = _possible(table)
        if forest and len(a):
            keep = spanning(component_a, component_b, differ)
            a, b = a[keep], b[keep]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return run


def _possible(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Pairs, the share of their shingles in which they surely differ, and their components. Only pairs of parts (i, j) are tried here."""
    ids, size, place, component, part = (table.column(c).to_numpy() for c in ("doc_id", "size", "place", "component", "part"))
    maps = table.column("bitmap").to_pylist()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    width = np.array([len(m) // 8 if m else 0 for m in maps])
    out = []

    def rows(w: int, p: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero((width == w) & (part == p))
        return at, np.frombuffer(b"".join(maps[k] for k in at), np.uint64).reshape(len(at), w) if w and len(at) else np.zeros((len(at), 0), np.uint64)

    def folded(m: np.ndarray, w: int) -> np.ndarray:
        while m.shape[1] > w:
            half = m.shape[1] // 2
            m = m[:, :half] ^ m[:, half:]
        return m

    kinds = np.unique(width)
    for x in kinds:
        left, left_map = rows(x, i)
        for y in kinds:
            right, right_map = rows(y, j)
            if not len(left) or not len(right):
                continue
            w = min(x, y)
            lm, rm = folded(left_map, w), folded(right_map, w)
            step = max(1, (1 << 20) // max(1, len(right)))
            for k in range(0, len(left), step):
                p = left[k : k + step]
                ok = component[p][:, None] != component[right][None, :]
                ok &= (ids[p][:, None] < ids[right][None, :]) if i == j else True
                total = size[p][:, None] + size[right][None, :]
                ok &= 7 * np.minimum((size - place)[p][:, None], (size - place)[right][None, :]) >= 3 * total
                p_at, r_at = np.nonzero(ok)
                share = np.zeros(len(p_at))
                if w and len(p_at):
                    differ = np.zeros(len(p_at), np.int64)
                    for c in range(w):
                        differ += np.bitwise_count(lm[k + p_at, c] ^ rm[r_at, c])
                    both = total[p_at, r_at]
                    near = 7 * (both - differ) >= 6 * both
                    p_at, r_at, share = p_at[near], r_at[near], differ[near] / both[near]
                m, k_at = p[p_at], right[r_at]
                out.append((ids[m], ids[k_at], share, component[m], component[k_at]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))
