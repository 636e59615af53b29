"""N-gram Jaccard self-join of documents through a token-group matrix.

Documents with equal shingle sets are one node. Similar nodes are put into groups of bounded size, the
matrix holds the union of each group's shingles, and a query opens a group only if its overlap with that union
leaves room for the wanted similarity; the members are then compared exactly. Which groups a query may meet at all
follows from keys that similar sets are bound to share (``shingles.shared_keys``). Groups are first compared by parities
(``shingles.parities``), which take a thirtieth of the room of a set or less and bound from below in how many shingles two sets
differ; whole sets travel only for queries and members that may be similar.

Links matter up to components. First the smallest node of a key's nodes queries the groups
of the others, which is linear in the nodes, however alike they are. Then only nodes outside the
largest component of a key query the groups that hold that key's nodes, and compare with other components.
Any link between two components joins such a node to such a group, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.shingles import folded, parities, shared_keys, shingle_set
from parley.llm.wordtokens import text_groups
from parley.operators.bits import maybe_among
from parley.operators.components import connected_components
from parley.operators.skew import salted_join
from parley.plans.shipping import ship_package
from parley.plans.storage import dropped, set_to, shared_dir, shuffles_dropped, written, written_in_buckets

GROUP = 128  # members of a group of the matrix
QUERIES = 1024  # queries that a group takes at once
ROWS_AT_ONCE = 1000  # rows of a batch that a worker gets: its texts or sets are in memory together
BLOCK = 1 << 18  # words of parities that NumPy compares in one step
LONGS = pa.list_(pa.int64())


def _name(s: np.ndarray) -> int | None:
    """64 bits name a set: among n different ones two agree with a probability below n^2 / 2^65."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) if len(s) else None


def _sketches(size: int, threshold: Fraction, portions: int):
    """Per text its id, size, node and the keys of its set, in a column for each portion of the 64-bit numbers."""
    columns = ["id", "n_shingles", "node", *[f"keys{k}" for k in range(portions)]]
    ends = np.array([(k << 64) // portions for k in range(1, portions)], dtype=np.uint64)

    def portion(keys: list[np.ndarray], bounds: list[list[int]], k: int) -> pa.Array:
        parts = [x[b[k] : b[k + 1]] for x, b in zip(keys, bounds)]
        offsets = np.cumsum([0] + [len(x) for x in parts]).astype(np.int32)
        flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_groups(batch, "text"):
                sets = [shingle_set(text, size) for text in texts]
                keys = [shared_keys(s, threshold) for s in sets]
                # Keys ascend as unsigned numbers.
                bounds = [[0, *np.searchsorted(k.view(np.uint64), ends).tolist(), len(k)] for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_name(s) for s in sets], pa.int64()),
                        *[portion(keys, bounds, k) for k in range(portions)],
                    ],
                    columns,
                )

    return sketch


def _sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_groups(batch, "text"):
                found = [shingle_set(text, size) for text in texts]
                columns = [pa.array([_name(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "shingles"])

    return sets


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and parities of every set."""
    for batch in batches:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in batch.column("shingles").to_pylist()]
        columns = [batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([parities(s).tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["node", "size", "parities"])


def _by_length(group: pa.Table, wanted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places, sizes, components and parities of the wanted rows whose parities are equally long."""
    bits, sizes, homes = group.column("parities").to_pylist(), group.column("size").to_numpy(), group.column("component").to_numpy()
    lengths = np.array([len(x) for x in bits], dtype=np.int64)
    found = []
    for length in np.unique(lengths[wanted]).tolist():
        at = np.flatnonzero(wanted & (lengths == length))
        matrix = np.frombuffer(b"".join(bits[k] for k in at.tolist()), dtype=np.uint64).reshape(len(at), -1)
        found.append((at, sizes[at], homes[at], matrix))
    return found


def _close(group: pa.Table, threshold: Fraction) -> np.ndarray:
    """Places of the group's queries and members that may be similar to one of another component."""
    p, q = threshold.numerator, threshold.denominator
    query = group.column("query").to_numpy()
    members = _by_length(group, ~query)
    found = [np.zeros(0, dtype=np.int64)]
    for at, sizes, homes, asked in _by_length(group, query):
        for places, their_sizes, their_homes, held in members:
            # |A ^ B| is (q - p) / (q + p) of |A| + |B| at most, and no less than the parities or the sizes that differ.
            room = (q - p) * (sizes[:, None] + their_sizes)
            fits = ((p + q) * np.abs(sizes[:, None] - their_sizes) <= room) & (homes[:, None] != their_homes)
            some, others = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
            words = min(asked.shape[1], held.shape[1])
            theirs = folded(held[others], words)
            step = max(1, BLOCK // max(1, len(others) * words))
            for k in range(0, len(some), step):
                part = some[k : k + step]
                differing = np.bitwise_count(folded(asked[part], words)[:, None] ^ theirs).sum(axis=2, dtype=np.int64)
                near = fits[np.ix_(part, others)] & ((p + q) * differing <= room[np.ix_(part, others)])
                found += [at[part[near.any(axis=1)]], places[others[near.any(axis=0)]]]
    return np.unique(np.concatenate(found))


def _possible(threshold: Fraction):
    """Of rows sorted by group and share, the queries and members that may be similar, without their parities."""

    def kept(rows: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
        at = [a + _close(rows.slice(a, b - a), threshold) for a, b in zip(starts, starts[1:])]
        if at:
            yield from rows.drop_columns(["size", "parities"]).take(pa.array(np.concatenate(at))).to_batches()

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # the last group may go on in the next batch
        for batch in batches:
            rows = pa.concat_tables([*held, pa.Table.from_batches([batch])])
            group, share = rows.column("group").to_numpy(), rows.column("share").to_numpy()
            starts = [0, *(1 + np.flatnonzero((np.diff(group) != 0) | (np.diff(share) != 0))).tolist()]
            yield from kept(rows, starts)
            held = [rows.slice(starts[-1])]
        for rows in held:
            yield from kept(rows, [0, rows.num_rows])

    return possible


def _open_groups(threshold: Fraction):
    p, q = threshold.numerator, threshold.denominator

    def opened(rows: pa.Table) -> pa.Table:
        queries, members = rows.filter(rows.column("query")), rows.filter(pc.invert(rows.column("query")))
        arrays = lambda t: [np.frombuffer(x, dtype=np.uint64) for x in t.column("shingles").to_pylist()]
        homes, sets = members.column("component").to_pylist(), arrays(members)
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        # The group's matrix by token: the union, and the members that hold each token of it.
        tokens = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        order = np.argsort(tokens, kind="stable")
        holders = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[order]
        union, starts, held = np.unique(tokens[order], return_index=True, return_counts=True)
        found = []
        for home, s in zip(queries.column("component").to_pylist(), arrays(queries)) if len(union) else ():
            at = np.minimum(np.searchsorted(union, s), len(union) - 1)
            at = at[union[at] == s]
            # |Q & S| / |Q | S| is at most |Q & union| / |Q|.
            if q * len(at) < p * len(s):
                continue
            n = held[at]
            rows_of = np.arange(n.sum()) + np.repeat(starts[at] - (np.cumsum(n) - n), n)
            both = np.bincount(holders[rows_of], minlength=len(sets))
            linked = {home}  # what is linked already, one way or another, needs no second link
            for k in np.flatnonzero(q * both >= p * (len(s) + sizes - both)).tolist():
                if homes[k] not in linked:
                    found.append((home, homes[k]))
                    linked.add(homes[k])
        columns = [pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * 2
        return pa.table(columns, ["a", "b"])

    return opened


def _linked(requests: DataFrame, members: DataFrame, portions: int, *args) -> DataFrame:
    """``_links``, written, a portion of the groups at a time: the sets of one portion travel and go before the next."""
    of = lambda rows, k: rows.filter(F.pmod(F.xxhash64("group"), F.lit(portions)) == k) if portions > 1 else rows
    return _union([written(_links(of(requests, k), of(members, k), *args), "links") for k in range(portions)])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _links(
    requests: DataFrame, members: DataFrame, sets: DataFrame, outlines: DataFrame, threshold: Fraction, shares: bool
) -> DataFrame:
    """Links ``(a, b)`` between the components of the queries of ``requests`` and of the ``members``.

    ``outlines`` are the sizes and parities of ``sets``. Both requests and members are ``(group, node, component)``. With ``shares`` a group with many queries is opened in several tasks, each with
    a share of them; without, every group has few.
    """
    left, right = requests.withColumn("share", F.lit(0)), members.withColumn("share", F.lit(0))
    if shares:
        counts = written(requests.groupBy("group").agg(F.count("*").alias("n")), "group-queries")
        number = F.ceil(F.col("n") / QUERIES).cast("int")
        left = salted_join(requests, counts.select("group", number.alias("shares")), "group", counts)
        left = left.withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")).drop("shares")
        right = members.join(counts, "group").withColumn("share", F.explode(F.sequence(F.lit(0), number - 1))).drop("n")
    both = left.withColumn("query", F.lit(True)).unionByName(right.withColumn("query", F.lit(False)))
    # A query may ask many groups: its parities, and then its set, are looked up once for both sides.
    outlined = both.join(outlines, "node").select("group", "share", "node", "component", "query", "size", "parities")
    outlined = outlined.repartition("group", "share").sortWithinPartitions("group", "share")
    schema = "group bigint, share int, node bigint, component bigint, query boolean"
    both = outlined.mapInArrow(_possible(threshold), schema).join(sets, "node")
    return both.groupBy("group", "share").applyInArrow(_open_groups(threshold), "a bigint, b bigint")


def _grouped(nodes: DataFrame, by: str) -> DataFrame:
    """``nodes`` with the bounded group that each is dealt to among those with the same ``by``."""
    counts = nodes.groupBy(by).agg(F.count("*").alias("n"))
    parts = counts.select(by, "n", F.ceil(F.col("n") / GROUP).cast("bigint").alias("parts"))
    dealt = salted_join(nodes, parts.select(by, "parts"), by, counts)
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    return dealt.select(by, "node", F.xxhash64(F.col(by), part).alias("group"))


def key_components(spread: list[DataFrame], sets_of: Callable[[DataFrame], DataFrame], threshold: Fraction) -> DataFrame:
    """``(node, component)`` of the nodes that link with another; links are sought among nodes with a key in common.

    ``spread`` has a row ``(node, key)`` for every key, in tables without a key in common; they are worked on one after the
    other, and the links in as many portions, so that less is on disk at once. When ``sets_of`` is asked for ``(node, shingles)``
    of wanted nodes, ``spread`` is no longer read. It may give a table whose buckets are by node, which then need not move.
    """
    spark = spread[0].sparkSession
    with shuffles_dropped(spark), set_to(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE):
        return _key_components(spread, sets_of, threshold)


def _key_nodes(spread: DataFrame) -> DataFrame:
    """``(key, node, lead)`` of the keys that several nodes have; the lead is the smallest of them."""
    shared = spread.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("_last"), F.count("*").alias("n"))
    shared = written(shared.filter("lead < _last").select("key", "lead", "n"), "shared-keys")
    several = maybe_among(spread, "key", shared, shared.count())
    met = salted_join(several, shared.select("key", "lead"), "key", shared)
    return written(met.groupBy("key", "node").agg(F.any_value("lead").alias("lead")), "key-nodes")


def _key_components(spread: list[DataFrame], sets_of: Callable[[DataFrame], DataFrame], threshold: Fraction) -> DataFrame:
    portions = len(spread)
    met = _union([_key_nodes(part) for part in spread])
    sets = sets_of(met.select("node").distinct())
    outlines = written(sets.mapInArrow(_parities, "node bigint, size bigint, parities binary"), "set-outlines")

    followers = met.filter("node <> lead").select("lead", "node").distinct()
    groups = written(_grouped(followers, "lead"), "groups")
    own = F.col("node").alias("component")  # so far every node is a component of its own
    requests = groups.select("group", F.col("lead").alias("node")).distinct()
    links = _linked(requests.select("*", own), groups.select("group", "node", own), portions, sets, outlines, threshold, False)
    components = written(connected_components(links), "components")

    named = met.join(components, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    open_keys = named.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).filter("_a < _b")
    named = written(named.join(open_keys.select("key"), "key", "left_semi"), "open-keys")
    if named.isEmpty():
        return components
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
    outside = named.join(main, "key").filter("component <> main").select("key", "node", "component")
    # Nodes have a home, their smallest leader, whose groups hold them once, however many keys they share.
    homes = met.groupBy("node").agg(F.min("lead").alias("home"))
    homes = written(homes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node")), "homes")
    members = written(_grouped(homes.select("home", "node"), "home").join(homes.select("node", "component"), "node"), "groups")
    key_homes = named.join(homes.select("node", "home"), "node").select("key", "home").distinct()
    asked = outside.join(key_homes, "key").select("home", "node", "component").distinct()
    requests = asked.join(members.select("home", "group").distinct(), "home").select("group", "node", "component")
    requests = written(requests, "requests") if portions > 1 else requests
    more = _linked(requests, members.select("group", "node", "component"), portions, sets, outlines, threshold, True).distinct()
    more = written(more, "links")
    return components if more.isEmpty() else _merged(components, more)


def _merged(components: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` after ``links (a, b)`` between them; what is not among them is a component of its own."""
    roots = written(connected_components(links), "merged-components")
    alone = roots.select("node", F.col("node").alias("component"))
    named = components.unionByName(alone).distinct()
    merged = roots.select(F.col("node").alias("component"), F.col("component").alias("root"))
    found = salted_join(named, merged, "component", how="left")
    return written(found.select("node", F.coalesce("root", "component").alias("component")), "components")


def ngram_components(
    docs: DataFrame, shingle: int = 3, threshold: Fraction = Fraction(9, 10),
    id_column: str = "doc_id", text_column: str = "text", portions: int = 1,
) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Words are split at ASCII white space and A-Z are lower-cased. Two documents link when the Jaccard similarity of
    their shingle sets is at least ``threshold``. A text with fewer words than a shingle is one shingle; null and
    empty texts have none and link with nothing, so each is its own component. Repeated rows are equal
    documents; a null id is never the smallest unless a component has no other. Other columns are not read.
    Keys, sets and groups are dealt to so many ``portions`` that follow each other: more of them need less disk and more jobs.
    Bit tables of the shared keys and of the wanted texts' ids keep other keys and texts from being moved.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared_dir(spark)
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    keys = [f"keys{k}" for k in range(portions)]
    schema = ", ".join(["id bigint, n_shingles bigint, node bigint", *[f"{k} array<bigint>" for k in keys]])
    with set_to(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE):
        keyed = written(rows.mapInArrow(_sketches(shingle, threshold, portions), schema), "shingle-keys")
    sketches = written(keyed.drop(*keys), "shingle-sketches")
    nodes = sketches.filter("node is not null")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The texts of nodes that share a key are read again, each from the row with its smallest id."""
        dropped(spark, keyed)  # its shared keys are in tables of their own
        first = nodes.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("id").alias("_id"))
        first = written(first, "first-ids")
        of = lambda rows, column, k: rows.filter(F.pmod(F.xxhash64(column), F.lit(portions)) == k) if portions > 1 else rows
        parts = (found_sets(of(rows, "id", k), of(first, "_id", k)) for k in range(portions))
        sets.append(written_in_buckets(parts, "node", "shingle-sets"))
        return sets[-1]

    def found_sets(rows: DataFrame, first: DataFrame) -> DataFrame:
        """The wanted sets, and the few others whose ids pass for wanted ones: nothing asks for those."""
        texts = maybe_among(rows, "id", first.select(F.col("_id").alias("id")), first.count(), bits=64)
        found = texts.mapInArrow(_sets(shingle), "node bigint, shingles binary").filter("node is not null")
        return found.groupBy("node").agg(F.any_value("shingles").alias("shingles"))

    spread = [keyed.filter("node is not null").select("node", F.explode(k).alias("key")) for k in keys]
    sets: list[DataFrame] = []
    components = key_components(spread, sets_of, threshold)
    dropped(spark, *sets)
    ids = nodes.groupBy("node").agg(F.min("id").alias("_id"), F.count("*").alias("n"))
    ids = written(ids.join(components, "node", "left").select("node", "_id", "n", F.coalesce("component", "node").alias("c")), "node-ids")
    smallest = ids.groupBy("c").agg(F.min("_id").alias("component_id"), F.count("*").alias("n"))
    of_node = salted_join(ids.select("c", "node"), smallest.select("c", "component_id"), "c", smallest)
    linked = salted_join(nodes.select("id", "n_shingles", "node"), of_node.select("node", "component_id"), "node", ids)
    alone = sketches.filter("node is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return linked.select("id", "n_shingles", "component_id").unionByName(alone).withColumnRenamed("id", id_column)


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, null ids last.

    Rows are told apart by a number of their own, so repeated ids do no harm: of rows that share the smallest id one stays.
    Rows without words link with nothing and all stay. An empty table stays empty. Columns may have any name.
    """
    whole = F.struct(*[F.col(c) for c in docs.columns])
    rows = written(docs.select(F.monotonically_increasing_id().alias("number"), whole.alias("row")), "numbered-rows", "zstd")
    texts = rows.select("number", F.col("row")[text_column].alias("text"))
    found = ngram_components(texts, id_column="number", text_column="text", **options)
    shared = found.filter(F.col("n_shingles") > 0).select("number", "component_id")
    ids = rows.select("number", F.col("row")[id_column].alias("id"))
    best = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "number"))["number"]
    later = written(shared.join(ids, "number"), "components-of-rows")
    kept = later.groupBy("component_id").agg(best.alias("number"))
    later = later.join(kept.select("number"), "number", "left_anti").select("number")
    return rows.join(later, "number", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
