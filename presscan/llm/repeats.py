"""Removal of repeated byte strings with a Burrows-Wheeler transform.

A byte goes if it lies in a string of :data:`LENGTH` bytes that also starts
earlier: in a document with a smaller id, or earlier in its own. Documents have a key
whose order is that of the ids (``key >> shift``), see :func:`columns.with_row_keys`.

Dealing out. Every window of that length has a minimiser, its m-gram of smallest
hash. Windows that share one in a text form a stretch; equal windows have equal
minimisers, so stretches are dealt out by minimiser. A stretch whose minimiser
occurs once is done. Equal stretches (by hash) count once, for their earliest
place; the later ones repeat it as a whole.

Cores. Equal windows have their minimiser at the same offset, so those of :data:`STEP`
neighbouring offsets share the bytes that all of them cover. Stretches of a minimiser
that share no such core share no window, however many texts have the minimiser; only
the others, cut down to the windows of shared cores, go on.

Interval expansion. The different stretches of a minimiser are written one after
another and suffix-sorted. From one interval a character, intervals of suffixes
with a common prefix are extended backwards on the transform by all characters at
once, breadth first, so boundaries appear by increasing common prefix; after
LENGTH - 1 steps, the suffixes of an interval share LENGTH bytes. All of them but
the earliest repeat.

Very common passages. Tasks keep one place for equal stretches before anything is
dealt out. If more than :data:`CROWD` different stretches meet at one minimiser,
their windows are dealt out one by one, so no minimiser fills a task.

Texts travel to other tasks compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presscan.llm.columns import KEY, WHITE, partitions, with_row_keys
from presscan.llm.shingles import mix
from presscan.llm.wordbatch import slices, tidy
from presscan.session import stored, stored_alone

LENGTH, GRAM = 100, 24
CROWD = 1024
#: Offsets of the minimiser in a window that are looked at together.
STEP = 20
#: Bytes of stretches that are transformed together, unless one minimiser has more.
BLOCK = 1 << 19
#: Bytes of text that a task cuts into stretches at once; each takes about fifty bytes of memory meanwhile.
TOGETHER = 1 << 18
_PLACE_BITS = 28
_U = np.uint64
_BASE = 0x100000001B3
_MARK = "doc_id long, start int, stop int"


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the m-gram at every position; those that run over the end mean nothing."""
    level, factor, eight = data.astype(np.uint64), _BASE, None
    level += _U(1)
    for width in (1, 2, 4, 8):
        eight = level
        level = level * _U(factor)
        level[:-width] += eight[width:]
        level[-width:] = eight[-width:]
        factor = factor * factor % (1 << 64)
    level[:-16] *= _U(pow(_BASE, 8, 1 << 64))
    level[:-16] += eight[16:]
    return mix(level)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over the ``width`` values from each position on."""
    reach, span = values, 1
    while span < width:
        step = min(span, width - span)
        longer = reach.copy()
        np.minimum(reach[:-step], reach[step:], out=longer[:-step])
        reach, span = longer, span + step
    return reach


def pieces(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Runs of whole texts of some bytes together, or a part of a long one; with their rows and offsets.

    Parts of a text overlap by all but one byte of a window, so every window lies in one of them
    and memory is bounded whatever a text's length.
    """
    held, rows, size = [], [], 0
    for row, text in enumerate(texts):
        if held and size + len(text) > TOGETHER:
            yield held, np.array(rows), np.zeros(len(rows), np.int64)
            held, rows, size = [], [], 0
        if len(text) > TOGETHER:
            for at in range(0, len(text) - LENGTH + 1, TOGETHER):
                yield [text[at : at + TOGETHER + LENGTH - 1]], np.array([row]), np.array([at])
            continue
        held.append(text)
        rows.append(row)
        size += len(text)
    if held:
        yield held, np.array(rows), np.zeros(len(rows), np.int64)


def stretches(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """row, start, stop, minimiser hash, stretch hash and the minimiser's offset of every stretch."""
    import xxhash

    lengths = np.array([len(t) for t in texts], np.int64)
    raw = b"".join(texts)
    empty = np.empty(0, np.int64)
    if len(raw) < LENGTH:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty
    hashes = _grams(np.frombuffer(raw, np.uint8))
    low = _U((1 << _PLACE_BITS) - 1)
    first = _smallest((hashes & ~low) | np.arange(len(raw), dtype=np.uint64), LENGTH - GRAM + 1)
    begin = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(texts)), lengths)
    at = np.flatnonzero(np.arange(len(raw)) - begin[row] <= lengths[row] - LENGTH)
    gram = (first[at] & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (at[1:] != at[:-1] + 1)
    edge = np.flatnonzero(new)
    start = at[edge]
    stop = at[np.concatenate([edge[1:] - 1, [len(at) - 1]]).astype(np.int64)[: len(edge)]] + LENGTH
    digest = xxhash.xxh64_intdigest
    whole = np.fromiter((digest(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)), np.uint64, len(start))
    owner = row[start]
    return owner, start - begin[owner], stop - begin[owner], hashes[gram[edge]], whole, gram[edge] - start


def _earliest(keys: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, then place; and which rows of that order repeat nothing in their group of equal keys.

    These are the first place of the smallest id, and of each further document of that id.
    Rows with the same place as the row before are dropped: they are the same string.
    """
    order = np.lexsort((start, doc, *reversed(keys)))
    same = np.ones(len(order), bool)
    for key in keys:
        ordered = key[order]
        same[1:] &= ordered[1:] == ordered[:-1]
    ordered_doc, ordered_start = doc[order], start[order]
    twice = np.zeros(len(order), bool)
    twice[1:] = same[1:] & (ordered_doc[1:] == ordered_doc[:-1]) & (ordered_start[1:] == ordered_start[:-1])
    opens = ~same
    opens[:1] = True
    if shift:
        first = ordered_doc[np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))]
        own = same.copy()
        own[1:] = ordered_doc[1:] != ordered_doc[:-1]
        opens |= own & (ordered_doc >> shift == first >> shift)
    return order[~twice], opens[~twice]


def sharing(texts: list[bytes], ats: list[int]) -> list[tuple[int, int, int]]:
    """Index, start and stop within its text of what may share a window with another of the texts.

    ``ats`` has the offset of each text's minimiser, or -1 for a text that is looked at as a whole.
    """
    width = LENGTH - STEP + 1
    first: list[dict[bytes, int]] = [{} for _ in range((LENGTH - GRAM) // STEP + 2)]
    shared = [0] * len(texts)
    for i, (text, at) in enumerate(zip(texts, ats, strict=True)):
        # In the text's windows, the minimiser has the offsets from ``low`` to ``at``.
        low = at - (len(text) - LENGTH)
        for k in range(low // STEP, at // STEP + 1) if at >= 0 else (-1,):
            core = text[at - k * STEP : at - k * STEP + width] if at >= 0 else text
            other = first[k].setdefault(core, i)
            if other != i:
                shared[other] |= 1 << (k + 1)
                shared[i] |= 1 << (k + 1)
    found = []
    for i, (bits, text, at) in enumerate(zip(shared, texts, ats, strict=True)):
        if not bits:
            continue
        if at < 0:
            found.append((i, 0, len(text)))
            continue
        k_low, k_high = (bits & -bits).bit_length() - 2, bits.bit_length() - 2
        found.append((i, max(at - k_high * STEP - STEP + 1, 0), min(at - k_low * STEP + LENGTH, len(text))))
    return found


def split_suffixes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, offset and class of every LENGTH-byte window; equal windows have equal classes."""
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8).astype(np.int64) + 1
    begin = np.cumsum(lengths + 1) - lengths - 1
    data[begin + lengths] = 0  # ends a text
    n = len(data)

    # Suffix order by prefix doubling, as far as LENGTH bytes need. Up to 2^20 suffixes, a
    # key of 40 bits and the place fit one number, which sorts faster than places by key.
    bits = 20

    def shifted(values: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        if by < n:
            out[: n - by] = values[by:]
        return out

    key, known = data, 4
    for i in range(1, known):
        key = key * 512 + shifted(data, i)
    while True:
        if n < 1 << bits:
            ordered = np.sort(key << bits | np.arange(n))
            order, ordered = ordered & ((1 << bits) - 1), ordered >> bits
        else:
            order = np.argsort(key)
            ordered = key[order]
        step = np.ones(n, np.int64)
        step[1:] = ordered[1:] != ordered[:-1]
        if known >= LENGTH:
            break
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step) - 1
        key = rank * (n + 1) + shifted(rank + 1, known)
        known *= 2
    before = data[order - 1].astype(np.uint16)  # the transform: the character in front of each suffix in order
    # Backward extension by a character keeps the order of its occurrences, so its suffixes
    # are those occurrences in a row; two neighbours stay together while no boundary lies between.
    source = np.argsort(before, kind="stable").astype(np.int32)  # suffix i of the order starts with before[source[i]]
    boundary = np.ones(n, bool)
    boundary[1:] = before[source[1:]] != before[source[:-1]]
    undecided = np.flatnonzero(~boundary).astype(np.int32)
    left, right = source[undecided - 1], source[undecided]
    found = 0
    for _ in range(LENGTH - 1):
        interval = np.cumsum(boundary, dtype=np.int32)
        if interval[-1] == found:
            break
        found = interval[-1]
        split = interval.take(left) != interval.take(right)
        boundary[undecided[split]] = True
        if 8 * np.count_nonzero(split) > len(split):
            undecided, left, right = undecided[~split], left[~split], right[~split]
    interval = np.cumsum(boundary)
    text = np.repeat(np.arange(len(texts)), lengths + 1)
    offset = np.arange(n) - begin[text]
    suffix_text, suffix_offset = text[order], offset[order]
    window = suffix_offset <= lengths[suffix_text] - LENGTH
    return suffix_text[window], suffix_offset[window], interval[window]


def repeated_windows(texts: list[bytes], doc: np.ndarray, start: np.ndarray, shift: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, start and stop of runs of windows that also occur at an earlier place of the given ones."""
    text, offset, interval = split_suffixes(texts)
    order, opens = _earliest((interval,), doc[text], start[text] + offset, shift)
    again = order[~opens]
    text, offset = text[again], offset[again]
    order = np.lexsort((offset, text))
    text, offset = text[order], offset[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (offset[1:] != offset[:-1] + 1)
    edge = np.flatnonzero(new)
    last = np.concatenate([edge[1:] - 1, [len(text) - 1]]).astype(np.int64)[: len(edge)]
    first_at = start[text[edge]] + offset[edge]
    return doc[text[edge]], first_at, start[text[last]] + offset[last] + LENGTH


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and the compressed UTF-8 bytes of the text; a null text is empty."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            data = [pack(t or b"") for t in pc.cast(batch.column("text"), pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "packed"])

    return docs.mapInArrow(tidy(run), "doc_id long, packed binary")


def _unpacked(data: list[bytes]) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(d) for d in data]


def _dealt(docs: DataFrame, shift: int) -> DataFrame:
    """Places of stretches by minimiser: whole repeats (``mode`` 0), and the earliest places of
    stretches that meet different ones, few (1) or a crowd (2)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [t or b"" for t in pc.cast(part.column("text"), pa.binary()).to_pylist()]
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                for some, rows, offset in pieces(texts):
                    yield from deal(*stretches(some), ids[rows], offset)

    def deal(row, start, stop, gram, whole, at, ids, offset):
        if not len(row):
            return
        doc, start, stop = ids[row], start + offset[row], stop + offset[row]
        order, opens = _earliest((gram, whole), doc, start, shift)
        gram, whole, doc, start, stop, at = (x[order] for x in (gram, whole, doc, start, stop, at))
        # Later places of a stretch are decided; they travel apart from their minimiser.
        spread = np.where(opens, gram, mix(gram ^ mix(doc.astype(np.uint64) * _U(LENGTH) + start.astype(np.uint64))))
        place = (start << 15) | ((stop - start) << 7) | at
        columns = [spread.view(np.int64), whole.view(np.int64), doc, np.where(opens, place, ~place)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "whole", "doc_id", "place"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.empty(0, np.int64) for _ in range(4))
        crowded = None  # minimiser whose stretches are already too many

        def out(gram, doc, place, mode):
            start = place >> 15
            numbers = [c.astype(np.int32) for c in (start, start + (place >> 7 & 255), mode, place & 127)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (gram, doc, *numbers)], ["gram", "doc_id", "start", "stop", "mode", "at"])

        def decide(gram, whole, doc, place):
            order, opens = _earliest((gram, whole), doc, place >> 15, shift)
            gram, doc, place = gram[order], doc[order], place[order]
            starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            group = np.cumsum(np.concatenate([[False], gram[1:] != gram[:-1]]))
            different = np.add.reduceat(opens.astype(np.int64), starts)
            mode = np.where(different == 1, -1, np.where(different > CROWD, 2, 1))[group]
            mode = np.where(gram == crowded, 2, mode) if crowded is not None else mode
            mode = np.where(opens, mode, 0)
            kept = mode >= 0
            return out(gram[kept], doc[kept], place[kept], mode[kept])

        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "whole", "doc_id", "place")]
            done = rows[3] < 0
            if done.any():
                yield out(rows[0][done], rows[2][done], ~rows[3][done], np.zeros(done.sum(), np.int32))
            rows = [np.concatenate([h, r[~done]]) for h, r in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            last = rows[0][-1]
            wait = rows[0] == last
            crowd = int(wait.sum()) > 64 * CROWD
            if crowd:  # go on with the unfinished stretch only
                wait &= rows[1] == rows[1][-1]
            held = tuple(r[wait] for r in rows)
            if not wait.all():
                if crowd:
                    crowded = last
                yield decide(*(r[~wait] for r in rows))
        if len(held[0]):
            yield decide(*held)

    rows = docs.mapInArrow(tidy(cut), "gram long, whole long, doc_id long, place long")
    rows = rows.repartition(partitions(docs.sparkSession), "gram").sortWithinPartitions("gram", "whole")
    return rows.mapInArrow(tidy(meet), "gram long, doc_id long, start int, stop int, mode int, at int")


def _expanded(places: DataFrame, packed: DataFrame, shift: int) -> DataFrame:
    """Marks (doc_id, start, stop) of windows of the given places that repeat."""
    wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "start", "stop", "mode", "at")).alias("places"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "packed", TOGETHER):
                texts = _unpacked(part.column("packed").to_pylist())
                gram, doc, start, offset, data, crowd = [], [], [], [], [], {}
                for one, text, wants in zip(part.column("doc_id").to_pylist(), texts, part.column("places").to_pylist(), strict=True):
                    for want in wants:
                        a, b = want["start"], want["stop"]
                        if want["mode"] == 1:
                            gram.append(want["gram"])
                            doc.append(one)
                            start.append(a)
                            offset.append(want["at"])
                            data.append(text[a:b])
                            continue
                        for at in range(a, b - LENGTH + 1):
                            window = text[at : at + LENGTH]
                            crowd.setdefault(window, []).append((one, at))
                marks = []
                if crowd:
                    import xxhash

                    for window, found in crowd.items():
                        found = sorted(set(found))
                        for i, (one, at) in enumerate(found):
                            # The first place of each document of the smallest id here goes on.
                            if i and (one >> shift != found[0][0] >> shift or one == found[i - 1][0]):
                                marks.append((one, at))
                                continue
                            gram.append(xxhash.xxh64_intdigest(window) - (1 << 63))
                            doc.append(one)
                            start.append(at)
                            offset.append(-1)
                            data.append(window)
                # Windows that repeat inside this slice are decided; they travel apart as well.
                gram += [hash(p) for p in marks]
                doc += [p[0] for p in marks]
                start += [p[1] for p in marks]
                offset += [-1] * len(marks)
                data += [None] * len(marks)
                if gram:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(offset, pa.int32()), pa.array(data, pa.binary())],
                        ["gram", "doc_id", "start", "at", "data"],
                    )

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whole groups of a minimiser: as they come, and what of them may repeat.
        texts, docs, starts, ats, size, last = [], [], [], [], 0, None
        alike: tuple[list[bytes], list[int], list[int]] = ([], [], [])
        alike_size = 0

        def out(doc, start, stop):
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["doc_id", "start", "stop"]
            )

        def sift():
            nonlocal alike_size
            for i, a, b in sharing(texts, ats):
                alike[0].append(texts[i][a:b])
                alike[1].append(docs[i])
                alike[2].append(starts[i] + a)
                alike_size += b - a
            for held in (texts, docs, starts, ats):
                held.clear()

        def expand():
            nonlocal alike_size
            marks = repeated_windows(alike[0], np.array(alike[1]), np.array(alike[2]), shift)
            for held in alike:
                held.clear()
            alike_size = 0
            return out(*marks)

        for batch in batches:
            done: tuple[list, list] = ([], [])
            rows = (batch.column(c).to_pylist() for c in ("gram", "doc_id", "start", "at", "data"))
            for gram, doc, start, at, data in zip(*rows, strict=True):
                if data is None:
                    done[0].append(doc)
                    done[1].append(start)
                    continue
                if gram != last and size > BLOCK:
                    sift()
                    size = 0
                    if alike_size > BLOCK:
                        yield expand()
                last = gram
                texts.append(data)
                docs.append(doc)
                starts.append(start)
                ats.append(at)
                size += len(data)
            if done[0]:
                yield out(done[0], done[1], [s + LENGTH for s in done[1]])
        sift()
        if alike[0]:
            yield expand()

    rows = wanted.join(packed, "doc_id").select("doc_id", "packed", "places").mapInArrow(tidy(fetch), "gram long, doc_id long, start int, at int, data binary")
    rows = rows.repartition(partitions(places.sparkSession), "gram").sortWithinPartitions("gram")
    return rows.mapInArrow(tidy(transform), _MARK)


def _repeated_spans(keyed: DataFrame, shift: int) -> DataFrame:
    """doc_id, start and stop (bytes) of stretches that repeat; they may overlap or touch. ``keyed`` has doc_id, a key, and text."""
    dealt = stored(_dealt(keyed, shift))
    whole = dealt.filter("mode = 0").select("doc_id", "start", "stop")
    return whole.unionByName(_expanded(dealt.filter("mode > 0"), _packed(keyed), shift))


def _cut(keyed: DataFrame, shift: int) -> DataFrame:
    """doc_id (a key), n_bytes, spans and kept of every row of ``keyed`` (doc_id, text); a null key has no spans."""
    spans = stored_alone(keyed.sparkSession, lambda: _repeated_spans(keyed.filter(F.col("doc_id").isNotNull()), shift))
    marks = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("marks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "packed", TOGETHER):
                texts = _unpacked(part.column("packed").to_pylist())
                spans, kept = [], []
                for text, found in zip(texts, part.column("marks").to_pylist(), strict=True):
                    runs: list[list[int]] = []
                    for mark in sorted(((m["start"], m["stop"]) for m in found or ())):
                        if runs and mark[0] <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], mark[1])
                        else:
                            runs.append(list(mark))
                    edges = [0, *(x for run in runs for x in run), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    spans.append([{"start": a, "stop": b} for a, b in runs])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                        pa.array(kept, pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "spans", "kept"],
                )

    joined = _packed(keyed).join(marks, "doc_id", "left").select("doc_id", "packed", "marks")
    return joined.mapInArrow(tidy(cut), "doc_id long, n_bytes long, spans array<struct<start:int,stop:int>>, kept binary")


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (maximal removed runs: start, stop) and kept bytes.

    A null text is empty; texts shorter than LENGTH never change. Rows that repeat an id are
    documents of their own: none has the smaller id, so they do not repeat each other, and what
    one of them loses another keeps unless it repeats an earlier place itself. Rows alike in id and
    text are the same strings. Rows without an id stay as they are and repeat nothing.
    A table without rows gives none.
    """
    keyed, shift = with_row_keys(docs.select("doc_id", "text"))
    cut = _cut(keyed.select(F.col(KEY).alias("doc_id"), "text"), shift)
    if not shift:
        return cut
    ids = keyed.select(F.col(KEY).alias("__k"), F.col("doc_id").cast("long").alias("__id")).distinct()
    found = cut.join(ids, F.col("doc_id").eqNullSafe(F.col("__k")), "left")
    return found.select(F.col("__id").alias("doc_id"), "n_bytes", "spans", "kept")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with their repeats cut out of ``text``, in their own columns; other columns keep their values.

    What a cut leaves of a split character goes as well. Documents that are left
    without a word go, unless they had none before. Rows that repeat an id lose their own repeats only.
    """
    keyed, shift = with_row_keys(docs)
    known = keyed.filter(F.col(KEY).isNotNull())
    cut = _cut(known.select(F.col(KEY).alias("doc_id"), "text"), shift).withColumnsRenamed({"doc_id": "__id", "kept": "__kept"})
    cut = cut.withColumn("__cut", F.size("spans") > 0).drop("spans", "n_bytes").distinct()
    kept = F.col("__kept").cast("string")
    # Halves of characters become replacement marks, which are then left out.
    clean = F.coalesce(F.try_validate_utf8(kept), F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit("")))
    has_word = F.trim(F.translate(clean, WHITE, " " * len(WHITE))) != ""
    rows = known.withColumn("__null", F.col("text").isNull()).drop("text").join(cut, F.col(KEY) == F.col("__id"))
    rows = rows.filter(~F.col("__cut") | has_word).withColumn("text", F.when(~F.col("__null"), clean))
    return rows.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def repeats_sql() -> str:
    """n_bytes, n_removed, n_spans and the digest of what is left, from all windows, in DuckDB; for small tables."""
    return f"""
        WITH texts AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
        ), windows AS (
            SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS k FROM (SELECT doc_id, h, unnest(range(n - {LENGTH - 1})) AS i FROM texts)
        ), repeated AS (
            SELECT doc_id, i FROM (
                SELECT *, min(doc_id) OVER (PARTITION BY k) AS first_doc, min(i) OVER (PARTITION BY k, doc_id) AS first_i FROM windows
            ) WHERE doc_id > first_doc OR i > first_i
        ), runs AS (
            SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS z FROM (
                SELECT *, sum(CAST(coalesce(i > before + {LENGTH}, true) AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run
                FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM repeated)
            ) GROUP BY doc_id, run
        ), cuts AS (
            SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM runs GROUP BY doc_id
        ), kept AS (
            SELECT doc_id, n, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
                CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(len(a) + 1), lambda j: substr(h,
                    2 * (CASE WHEN j = 0 THEN 0 ELSE z[j] END) + 1,
                    2 * ((CASE WHEN j = len(a) THEN n ELSE a[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE z[j] END)))), '') END AS h
            FROM texts LEFT JOIN cuts USING (doc_id)
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
            sha256(unhex(h)) AS kept_sha256 FROM kept
    """
