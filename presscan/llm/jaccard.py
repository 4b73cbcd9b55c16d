"""N-gram Jaccard join by partitioning the universe of shingles.

Two sets that link differ in at most (|a| + |b|) / 7 shingles. The universe is
hashed into segments, so by the pigeonhole principle a linked pair agrees exactly
on some segment if there are more segments than differences (or differs by one
shingle there, if there are more than half as many). Segments are laid out anew
for every size band; a set is indexed in its own band, where it may meet larger
ones, and in the band below, where it may be the larger one.

Allocation by cost. A band uses exact segments, or fewer and larger segments with
their one-deletion neighbourhoods, whichever costs less for its sizes. With exact
segments there are more of them than differences, and every set spends what is to
spare on not indexing its costliest segments: those it has no shingle in, which
say nothing, and then those with the fewest shingles that are not common to very
many texts. A set that has nothing to spare indexes all.

Copies of a group are never paired with each other. Inside a slice of a task, and
then for all slices, sets with the same key are linked to their smallest id only.
Where that leaves a key's members, heads among them, in several components, those
outside the largest are compared with all members of other components, unless sizes
and sketches rule a link out. Every candidate is verified exactly, on 64-bit shingle
hashes. Connected components and all joins are Spark jobs whose intermediate tables
are written to the shared folder.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presscan.llm.columns import FEW, KEY, broadcast_if_few, partitions, with_row_keys
from presscan.llm.components import component_ids
from presscan.llm.shingles import Sets, mix, shingle_sets
from presscan.llm.wordbatch import slices, tidy
from presscan.session import stored, stored_alone

#: A band's largest size is about this much above its smallest; a set then meets two bands at most.
BAND = 16 / 9
#: Exact segments per possible difference, and what an expected chance agreement costs in keys.
SPARE, CHANCE = 1.4, 4.0
#: Counters of shingles, and how many deviations above the mean make one common.
SLOTS, COMMON = 1 << 18, 8.0
_BLOCK = 1 << 12
#: Words of the sketch that shows cheaply that two sets differ too much.
SKETCH = 16
#: Bytes of text that a task looks at together.
TEXTS = 3 << 20
#: Members that are compared with one copy of their partner.
TOGETHER = 256
_U = np.uint64


@lru_cache(maxsize=1)
def _bands() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smallest size of each band; its segments; whether they are exact; and the largest size."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, int(np.ceil(low[-1] * BAND))))
    low = np.array(low)
    high = low[1:] - 1
    differ = (high + 4 * high // 3) // 7
    exact = np.where(differ == 0, 1, np.ceil(SPARE * (differ + 1)).astype(np.int64))
    fewer = differ // 2 + 1
    cost = exact + CHANCE * exact * 2.0 ** -(high / exact)
    cost_fewer = fewer + high + CHANCE * fewer * 2.0 ** -(high / fewer)
    return low[:-1], np.where(cost <= cost_fewer, exact, fewer), cost <= cost_fewer, high


def _keys(total: np.ndarray, count: np.ndarray, band: np.ndarray, segment: np.ndarray) -> np.ndarray:
    place = mix(band.astype(np.uint64) * _U(0x100000001B3) + segment.astype(np.uint64) + _U(1))
    return mix(total + count.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) ^ place


def _band_keys(sets: Sets, chosen: np.ndarray, band: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ``chosen`` sets in their given bands, and the set of each key."""
    _, all_segments, all_exact, all_high = _bands()
    inside = np.repeat(np.isin(np.arange(len(sets.sizes)), chosen), sets.sizes)
    sizes, segments = sets.sizes[chosen], all_segments[band]
    owner, h = np.repeat(np.arange(len(chosen)), sizes), sets.hashes[inside]
    base = np.cumsum(segments) - segments
    segment = ((h >> _U(32)) * segments[owner].astype(np.uint64) >> _U(32)).astype(np.int64)
    cell, cells = base[owner] + segment, int(segments.sum())
    value = mix(h + _U(0x9E3779B97F4A7C15))
    count = np.bincount(cell, minlength=cells)
    half = [np.bincount(cell, weights=(part & _U(0xFFFFFFFF)).astype(np.float64), minlength=cells) for part in (value, value >> _U(32))]
    total = half[0].astype(np.uint64) + (half[1].astype(np.uint64) << _U(32))
    cell_owner = np.repeat(np.arange(len(chosen)), segments)
    cell_segment = np.arange(cells) - base[cell_owner]
    # What an exact set may leave out: its empty segments and so many of those with the fewest rare shingles.
    empty = np.bincount(cell_owner, weights=count == 0, minlength=len(chosen))
    largest = np.maximum(sizes, np.minimum(4 * sizes // 3, 4 * all_high[band] // 3))
    half_left = (segments - 1 - empty) / 2
    exact = all_exact[band]
    left_out = np.where(exact & (half_left >= largest / 7) & (segments > 1), empty + np.floor(half_left - sizes / 7), 0)
    rare = np.bincount(cell, weights=~common[_slot(h)], minlength=cells).astype(np.int64)
    most = int(count.max(initial=0)) + 1
    order = np.argsort((cell_owner * most + rare) * most + count, kind="stable")
    rank = np.empty(cells, np.int64)
    rank[order] = np.arange(cells) - base[cell_owner[order]]
    kept = rank >= left_out[cell_owner]
    keys = [_keys(total, count, band[cell_owner], cell_segment)[kept]]
    owners = [cell_owner[kept]]
    deleted = ~exact[owner]
    if deleted.any():
        at = cell[deleted]
        keys.append(_keys(total[at] - value[deleted], count[at] - 1, band[owner[deleted]], segment[deleted]))
        owners.append(owner[deleted])
    return np.concatenate(keys), chosen[np.concatenate(owners)]


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ _U(0xD6E8FEB86659FD93)) % _U(SLOTS)).astype(np.int64)


def index_keys(sets: Sets, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys under which the sets are indexed, and the set of each; empty sets have none.

    ``common`` marks slots of shingles that very many texts have. It decides which
    segments are left out, never whether linked sets share a key.
    """
    low, _, _, high = _bands()
    some = np.flatnonzero(sets.sizes > 0)
    band = np.searchsorted(low, sets.sizes[some], side="right") - 1
    below = (band > 0) & (-(-3 * sets.sizes[some] // 4) <= high[np.maximum(band - 1, 0)])
    found = [_band_keys(sets, some, band, common), _band_keys(sets, some[below], band[below] - 1, common)]
    return np.concatenate([k for k, _ in found]), np.concatenate([o for _, o in found])


def _sketches(sets: Sets) -> np.ndarray:
    """Parities of hashed shingle counts: sets differ in at least as many shingles as bits."""
    bits = SKETCH * 64
    owner = np.repeat(np.arange(len(sets.sizes)), sets.sizes)
    at = owner * bits + (mix(sets.hashes) % _U(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(sets.sizes) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, bits), axis=1).view(np.int64)


def _digests(sets: Sets) -> np.ndarray:
    """A number of each set as a whole, 0 for an empty one."""
    sums = np.concatenate([[_U(0)], np.cumsum(mix(sets.hashes ^ _U(0xA0761D6478BD642F)), dtype=np.uint64)])
    ends = sets.ends
    return (sums[ends] - sums[ends - sets.sizes]).view(np.int64)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, sketch and digest of every document; and rows without n_shingles, whose
    ``counts`` a task adds to the counters of ``block``."""
    names = ["doc_id", "n_shingles", "sketch", "digest", "block", "counts"]
    blocks, width = SLOTS // _BLOCK, _BLOCK

    def lists(values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in slices(batch, most=TEXTS):
                sets = shingle_sets(part.column("text"))
                seen += np.bincount(_slot(sets.hashes), minlength=SLOTS)
                none = pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets.sizes), lists(_sketches(sets)), pa.array(_digests(sets)), *none], names)
        if seen.any():
            none = (pa.nulls(blocks, kind) for kind in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()))
            yield pa.RecordBatch.from_arrays([*none, pa.array(np.arange(blocks, dtype=np.int32)), lists(seen.reshape(blocks, width))], names)

    return docs.mapInArrow(tidy(run), "doc_id long, n_shingles long, sketch array<long>, digest long, block int, counts array<long>")


def common_slots(described: DataFrame) -> np.ndarray:
    """Which counters stand out: blocks are summed by Spark, and a fixed number of counters comes to the driver."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                values = counts.values.to_numpy()
                sums[block] = sums[block] + values if block in sums else values.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["block", "counts"])

    rows = described.filter("n_shingles IS NULL").select("block", "counts")
    seen = np.zeros((SLOTS // _BLOCK, _BLOCK), np.int64)
    for row in rows.repartition(partitions(described.sparkSession), "block").mapInArrow(tidy(total), rows.schema).collect():
        seen[row["block"]] = row["counts"]
    mean = max(float(seen.mean()), 1.0)
    return seen.ravel() > mean + COMMON * mean**0.5


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.empty(0, np.int64)
    return starts, np.diff(np.concatenate([starts, [len(sorted_keys)]]))


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """For keys in order: each key, its smallest id, how many others it has and the sum of their hashes;
    and key, smallest and other id of the members.

    A member that has a key twice may be given twice.
    """
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    starts, lengths = _runs(keys)
    least = np.minimum.reduceat(ids, starts) if len(starts) else ids
    head = np.repeat(least, lengths)
    other = ids != head
    hashed = np.zeros(len(ids), np.uint64)
    hashed[other] = mix(ids[other].astype(np.uint64))
    others, total = (np.add.reduceat(x, starts) if len(starts) else x for x in (other.astype(np.int64), hashed))
    return keys[starts], least, others, total, keys[other], head[other], ids[other]


def memberships(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """key, head and doc: documents that share a key with a smaller id, its ``head``; and a row for each key
    of three members or more, without them: how many ``members`` it has and their ``total`` of hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=TEXTS):
                sets = shingle_sets(part.column("text"))
                keys, owner = index_keys(sets, shared.value)
                # Equal sets also meet under a key of their own, and need no comparison then.
                some = np.flatnonzero(sets.sizes > 0)
                keys = np.concatenate([keys, mix(_digests(sets)[some].view(np.uint64))])
                owner = np.concatenate([owner, some])
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)[owner]
                key, first, others, total, met, head, doc = _stars(keys.view(np.int64), ids)
                # Groups found here travel apart from their key, whatever their size; their number and total go with it.
                spread = mix(met.view(np.uint64) ^ mix(doc.astype(np.uint64))).view(np.int64)
                group = others > 0
                firsts, groups, rest = np.full(len(key), -1), np.full(group.sum(), -1), len(met)
                without_key = np.arange(len(key) + len(groups) + rest) < len(key)
                without_head = np.arange(len(key) + len(groups) + rest) < len(key) + len(groups)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([key, key[group], spread])),
                        pa.array(np.concatenate([firsts, total[group].view(np.int64), met]), mask=without_key),
                        pa.array(np.concatenate([first, others[group], doc])),
                        pa.array(np.concatenate([firsts, groups, head]), mask=without_head),
                    ],
                    ["spread", "key", "doc", "head"],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of keys: smallest ids (no total) and groups (number, total) of the slices.
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))

        def out(key, head, doc):
            none = pa.nulls(len(key), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(head), pa.array(doc), none, none], ["key", "head", "doc", "members", "total"])

        def decide(keys, ids, totals, group):
            key, first, members, total, met, head, doc = _stars(keys[~group], ids[~group])
            if len(met):
                yield out(met, head, doc)
            members, total = members + 1, total + mix(first.astype(np.uint64))
            place = np.searchsorted(key, keys[group])
            np.add.at(members, place, ids[group])
            np.add.at(total, place, totals[group].view(np.uint64))
            many = members > 2
            if many.any():
                none = pa.nulls(int(many.sum()), pa.int64())
                columns = [pa.array(key[many]), none, none, pa.array(members[many]), pa.array(total[many].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "head", "doc", "members", "total"])

        for batch in batches:
            known = batch.filter(batch.column("head").is_valid())
            if len(known):
                yield out(*(known.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "head", "doc")))
            fresh = batch.filter(batch.column("head").is_null())
            totals = fresh.column("key")
            rows = [*(c.to_numpy(zero_copy_only=False) for c in (fresh.column("spread"), fresh.column("doc"), pc.fill_null(totals, 0), totals.is_valid()))]
            rows = [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            # The last key may go on in the next batch; two rows for each slice of the input at most.
            open_ = rows[0] == rows[0][-1]
            held = tuple(r[open_] for r in rows)
            yield from decide(*(r[~open_] for r in rows))
        yield from decide(*held)

    rows = docs.mapInArrow(tidy(index), "spread long, key long, doc long, head long")
    rows = rows.repartition(partitions(docs.sparkSession), "spread").sortWithinPartitions("spread")
    return rows.mapInArrow(tidy(meet), "key long, head long, doc long, members long, total long")


def _differing(a: list[Column], b: list[Column]) -> Column:
    """Bits in which two sketches differ: no more than the sets differ."""
    return reduce(operator.add, (F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)))


def _may_link(n_a: Column, n_b: Column, differing: Column) -> Column:
    """Neither sizes nor sketches rule the link out."""
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * 75) & (differing * 7 <= n_a + n_b)


def _about(described: DataFrame) -> DataFrame:
    """One row a document: doc, its size n, its digest and its sketch as columns."""
    words = [F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)]
    return described.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "digest", *words)


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumnsRenamed({c: f"{name}_{c}" for c in rows.columns})


def _compared(a: str, b: str) -> tuple[Column, Column]:
    """Whether two sides are the same set, and whether they may link."""
    differing = _differing(*([F.col(f"{side}_s{i}") for i in range(SKETCH)] for side in (a, b)))
    n_a, n_b = F.col(f"{a}_n"), F.col(f"{b}_n")
    same = (n_a == n_b) & (F.col(f"{a}_digest") == F.col(f"{b}_digest")) & (differing == 0)
    return same, _may_link(n_a, n_b, differing)


def _measured(pairs: DataFrame, about: DataFrame) -> DataFrame:
    """Pairs (a, b) that may link, and whether they are the ``same`` set."""
    for side in ("a", "b"):
        pairs = pairs.join(_side(about, side), F.col(side) == F.col(f"{side}_doc"))
    same, may = _compared("a", "b")
    return pairs.filter(may).select("a", "b", same.alias("same"))


def _beyond_heads(met: DataFrame, tried: DataFrame, components: DataFrame, about: DataFrame) -> DataFrame:
    """Pairs that share a key, may link and were not compared: no star shows whether they do.

    The only pair of a key of two members was compared. Alike texts share many keys with the same
    members, told by their number and the total of their 64-bit hashes: one key stands for all of
    them. A key whose stars all stay in one component is settled. Of any other key all members
    count, heads too, but equal sets only once: those outside the component that most of them are
    in are compared with every member of another component. Sizes and whole sketches are looked
    at inside the join, so it gives out only pairs that may link. ``tried`` and ``components`` are written tables.
    """
    label = components.select(F.col("doc_id").alias("doc"), F.col("component_id").alias("of"))
    few = label.count() <= FEW

    def labelled(rows: DataFrame, doc: str, of: str) -> DataFrame:
        known = label.withColumnsRenamed({"doc": doc, "of": of})
        rows = rows.join(F.broadcast(known) if few else known, doc, "left")
        return rows.withColumn(of, F.coalesce(of, doc))

    one_of_each = stored(met.filter("members IS NOT NULL").groupBy("members", "total").agg(F.min("key").alias("key")).select("key"))
    met = stored(met.filter("head IS NOT NULL").join(broadcast_if_few(one_of_each), "key", "left_semi").select("key", "head", "doc"))
    split = labelled(labelled(tried, "a", "of_a"), "b", "of_b").filter("of_a <> of_b")
    split = stored(split.select(F.col("a").alias("head"), F.col("b").alias("doc")))
    keys = stored(met.join(broadcast_if_few(split), ["head", "doc"]).select("key").distinct())
    members = met.join(broadcast_if_few(keys), "key", "left_semi").select("key", F.explode(F.array("head", "doc")).alias("doc")).distinct()
    members = labelled(members, "doc", "of").join(about, "doc")
    # Equal sets are in one component by now, so the smallest id stands for all of them.
    whole = [c for c in about.columns if c not in ("doc", "n", "digest")]
    one = members.groupBy("key", "of", "n", "digest").agg(F.min("doc").alias("doc"), *[F.min(c).alias(c) for c in whole])
    members = stored(one)
    counted = members.groupBy("key", "of").count()
    main = stored(counted.groupBy("key").agg(F.max_by("of", F.struct("count", "of")).alias("main")))
    members = stored(members.join(broadcast_if_few(main), "key").withColumn("minor", F.col("of") != F.col("main")).drop("main"))
    _, may = _compared("x", "y")
    once = (F.col("x_of") != F.col("y_of")) & (~F.col("y_minor") | (F.col("x_doc") < F.col("y_doc")))
    found = _side(members.filter("minor"), "x").join(_side(members, "y"), (F.col("x_key") == F.col("y_key")) & once & may)
    pairs = stored(found.select(F.least("x_doc", "y_doc").alias("a"), F.greatest("x_doc", "y_doc").alias("b")).distinct())
    return pairs.join(broadcast_if_few(tried), ["a", "b"], "left_anti")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link; b's are compared with copies of a's text, a bounded number each. ``pairs`` is a written table."""
    counted = stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("long").alias("parts")))
    several = broadcast_if_few(counted.filter("parts > 1"))
    placed = pairs.join(several, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))))
    members = placed.select(F.col("b").alias("doc_id"), "a", "part", F.lit(True).alias("member"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    heads = counted.select(F.col("a").alias("doc_id"), "a", parts.alias("part"), F.lit(False).alias("member"))
    roles = stored(members.unionByName(heads))
    texts = docs.join(broadcast_if_few(roles), "doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, mine = None, np.empty(0, np.uint64)
        for batch in batches:
            for part in slices(batch, most=TEXTS):
                sets = shingle_sets(part.column("text"))
                ends = sets.ends
                rows = zip(part.column("a").to_pylist(), part.column("part").to_pylist(), part.column("member").to_pylist(), part.column("doc_id").to_pylist(), strict=True)
                links = []
                for i, (a, piece, member, doc) in enumerate(rows):
                    own = sets.hashes[ends[i] - sets.sizes[i] : ends[i]]
                    if not member:
                        current, mine = (a, piece), own
                    elif current == (a, piece):
                        place = np.minimum(np.searchsorted(mine, own), max(len(mine) - 1, 0))
                        both = int((mine[place] == own).sum()) if len(mine) else 0
                        if both and 100 * both >= 75 * (len(mine) + len(own) - both):
                            links.append((a, doc))
                if links:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"]
                    )

    dealt = texts.repartition(partitions(docs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "member")
    return dealt.select("a", "part", "member", "doc_id", "text").mapInArrow(tidy(compare), "a long, b long")


def join_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id a document reaches by links.

    Empty sets (null texts, texts without words) link with nothing. Rows that repeat an id are
    documents of their own: they are in one component only if links connect their texts. A row
    without an id has no component. A table without rows gives none.
    """
    rows = keyed_groups(docs)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "n_shingles", "component_id")


def keyed_groups(docs: DataFrame) -> DataFrame:
    """The rows of :func:`join_groups` with ``__key``, which tells rows of one id and different texts
    apart, and ``__first``, the key of the component's first document."""
    keyed, shift = with_row_keys(docs.select("doc_id", "text"))
    both = stored(describe(keyed.select(F.col(KEY).alias("doc_id"), "text")))
    described = both.filter("n_shingles IS NOT NULL").select("doc_id", "n_shingles", "sketch", "digest")
    texts = keyed.select(F.col(KEY).alias("doc_id"), "text").filter(F.col("doc_id").isNotNull())
    about = _about(described)
    if shift:  # rows alike in id and text share a key
        texts, about = texts.dropDuplicates(["doc_id"]), about.filter("doc IS NOT NULL").dropDuplicates(["doc"])
    common = common_slots(both)
    components = component_ids(stored_alone(docs.sparkSession, lambda: _all_links(texts, about, common)))
    found = described.select(F.col("doc_id").alias(KEY), "n_shingles").join(components, F.col(KEY) == F.col("doc_id"), "left")
    found = found.select(KEY, "n_shingles", F.coalesce("component_id", KEY).alias("__first"))
    if not shift:
        return found.select(F.col(KEY).alias("doc_id"), "n_shingles", F.col("__first").alias("component_id"), KEY, "__first")
    ids = stored(keyed.select(F.col(KEY).alias("k"), F.col("doc_id").cast("long").alias("id")).filter("k IS NOT NULL").distinct())
    for key, name in ((KEY, "doc_id"), ("__first", "component_id")):
        found = found.join(ids.withColumnsRenamed({"k": f"k_{name}", "id": name}), F.col(key) == F.col(f"k_{name}"), "left")
    return found.select("doc_id", "n_shingles", "component_id", KEY, "__first")


def _all_links(texts: DataFrame, about: DataFrame, common: np.ndarray) -> DataFrame:
    """Links (a, b) with the same components as all: those of stars, as their components' own
    stars, and those between members of a key that stars leave apart."""
    spark = texts.sparkSession
    met = stored(memberships(texts, common))
    tried = stored(met.filter("head IS NOT NULL").select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct())
    measured = stored(_measured(tried, about))
    components = component_ids(stored_alone(spark, lambda: _links(measured, texts)))
    # Their sizes and sketches have been looked at, and equal sets are in one component.
    more = stored_alone(spark, lambda: _beyond_heads(met, tried, components, about))
    return components.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).unionByName(verified(more, texts))


def _links(measured: DataFrame, docs: DataFrame) -> DataFrame:
    """The measured pairs that link: equal sets, and those whose texts show it."""
    compared = verified(measured.filter("NOT same").select("a", "b"), docs)
    return measured.filter("same").select("a", "b").unionByName(compared)


def groups_sql() -> str:
    """The same from all pairs that share a shingle, in DuckDB; for small tables."""
    return """
        WITH RECURSIVE texts AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE
                WHEN len(w) > 4 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g
            FROM texts
        ), shingles AS (SELECT doc_id, unnest(g) AS s FROM sets),
        shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * c >= 75 * (len(x.g) + len(y.g) - c)
        ), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached AS (
            SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON l.a = r.b
        )
        SELECT doc_id, CAST(any_value(len(g)) AS BIGINT) AS n_shingles, min(b) AS component_id FROM sets JOIN reached ON a = doc_id GROUP BY doc_id
    """
