"""Language identification with segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The
probability of a word is the sum over all ways to cut it into pieces of the
product of their probabilities, which a forward pass over its bytes yields; that
of a text is the product over its words. Training is one expectation step of
that model: under piece probabilities that only depend on the vocabulary's order,
a forward-backward pass gives every piece its expected count in a word, summed
over all segmentations, and the counts of each language are normalised.

Words are runs of letters in lower case, led by a space as the vocabulary writes
them, of any length: sums are rescaled every few bytes, so none leaves the range of numbers.
Expected counts are summed by Spark; the model that is broadcast has one number
per piece and language, whatever the number of documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from presscan.llm.wordbatch import CACHES, Words, letter_words, slices, tidy

UNKNOWN = "und"
#: Strength of the vocabulary's own distribution in a language's.
SMOOTHING = 2000.0
#: Bytes after which the sums of a word are rescaled.
_EVERY = 16
#: Positions of words, times languages, that a pass looks at together, unless one word has more.
_CELLS = 1 << 20


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a ranks file in rank order: all bytes, and what lower-case words can contain."""

    def usable(piece: bytes) -> bool:
        if len(piece) == 1:
            return True
        try:
            text = piece.decode()
        except UnicodeDecodeError:
            return all(b >= 0x80 for b in piece[1:])
        text = text.removeprefix(" ")
        return text == "" or (text.isalpha() and text == text.lower())

    with open(path, "rb") as lines:
        return [p for p in (base64.b64decode(line.split()[0]) for line in lines) if usable(p)]


class Pieces:
    """A trie over the vocabulary that walks all positions of many words at once.

    Its edges are one hashed table of (node, byte), so it takes little more room than the pieces.
    """

    def __init__(self, pieces: tuple[bytes, ...]):
        children, piece_at = [{}], [-1]
        for i, piece in enumerate(pieces):
            node = 0
            for byte in piece:
                nxt = children[node].get(byte)
                if nxt is None:
                    nxt = children[node][byte] = len(children)
                    children.append({})
                    piece_at.append(-1)
                node = nxt
            piece_at[node] = i
        edges = np.array([(node << 8 | byte, nxt) for node, kids in enumerate(children) for byte, nxt in kids.items()], np.int64)
        bits = max(int(len(edges)).bit_length() + 2, 4)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.edge, self.target = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        for slot, (edge, nxt) in zip(self._slot(edges[:, 0]).tolist(), edges.tolist(), strict=True):
            while self.edge[slot] >= 0:
                slot = slot + 1 & self.mask
            self.edge[slot], self.target[slot] = edge, nxt
        #: Where the first byte leads, without a search.
        self.root = np.array([children[0].get(byte, 0) for byte in range(256)], np.int32)
        self.piece_at = np.array(piece_at, np.int32)
        self.longest = max(map(len, pieces))
        order = np.arange(len(pieces)) + 10.0
        self.prior = (1 / order) / (1 / order).sum()

    def _slot(self, edge: np.ndarray) -> np.ndarray:
        return (edge.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next node, 0 where there is none."""
        wanted = node.astype(np.int64) << 8 | byte
        slot = self._slot(wanted)
        held = self.edge[slot]
        out = np.where(held == wanted, self.target[slot], 0)
        on = np.flatnonzero((held != wanted) & (held >= 0))
        while len(on):
            slot[on] = slot[on] + 1 & self.mask
            held = self.edge[slot[on]]
            hit = held == wanted[on]
            out[on[hit]] = self.target[slot[on[hit]]]
            on = on[~hit & (held >= 0)]
        return out

    def matches(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """word, offset, length and piece of all occurrences of pieces, and the words' lengths."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        at = np.arange(len(text))
        offset = (at - (ends - lengths)[word]).astype(np.int32)
        left = (lengths[word] - offset).astype(np.int32)  # bytes up to the word's end
        node, found = self.root[text], []
        for length in range(1, self.longest + 1):
            if length > 1:
                node = self._step(node, text[at])
            alive = node > 0
            word, offset, left, at, node = word[alive], offset[alive], left[alive], at[alive], node[alive]
            piece = self.piece_at[node]
            hit = piece >= 0
            found.append((word[hit], offset[hit], np.full(hit.sum(), length, np.int32), piece[hit]))
            on = left > length
            word, offset, left, at, node = word[on], offset[on], left[on], at[on] + 1, node[on]
            if not len(node):
                break
        return (*(np.concatenate(x) for x in zip(*found, strict=True)), lengths)


@lru_cache(maxsize=1)
def _trie(pieces: tuple[bytes, ...]) -> Pieces:
    return Pieces(pieces)


CACHES["language_id"] = _trie.cache_clear


class _Lattice:
    """All segmentations of a chunk of words; offsets and lengths in groups for vectorised passes.

    Sums at a position are kept relative to a scale of their word (and column), which changes at
    every :data:`_EVERY`-th position.
    """

    def __init__(self, trie: Pieces, words: list[bytes]):
        word, offset, length, piece, self.lengths = trie.matches(words)
        self.longest = trie.longest
        key = offset.astype(np.int64) * (trie.longest + 1) + length
        order = np.argsort(key, kind="stable")
        self.word, self.piece, key = word[order], piece[order], key[order]
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts = np.concatenate([[0], cuts]).astype(int)
        ends = np.concatenate([cuts, [len(key)]]).astype(int)
        self.groups = [(int(key[s] // (trie.longest + 1)), int(key[s] % (trie.longest + 1)), s, e) for s, e in zip(starts, ends, strict=True) if e > s]
        self.n = len(words)

    def forward(self, probability: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed probability of all segmentations up to a position, by (position, word, column), and the
        logarithm of its scale, by (position // _EVERY, word, column)."""
        most = int(self.lengths.max(initial=0))
        alpha = np.zeros((most + 1, self.n, probability.shape[1]))
        scale = np.zeros((most // _EVERY + 1, *alpha.shape[1:]))
        alpha[0] = 1.0

        def rescale(check: int) -> None:
            rows = alpha[check * _EVERY : check * _EVERY + self.longest]
            top = rows.max(0)
            top[top == 0] = 1.0
            rows /= top
            scale[check] = scale[check - 1] + np.log(top)

        check = 1
        for offset, length, s, e in self.groups:
            while offset >= check * _EVERY:
                rescale(check)
                check += 1
            word = self.word[s:e]
            alpha[offset + length, word] += alpha[offset, word] * probability[self.piece[s:e]]
        for rest in range(check, len(scale)):
            rescale(rest)
        return alpha, scale

    def _totals(self, alpha: np.ndarray, scale: np.ndarray) -> np.ndarray:
        each = np.arange(self.n)
        return np.log(alpha[self.lengths, each]) + scale[self.lengths // _EVERY, each]

    def log_totals(self, probability: np.ndarray) -> np.ndarray:
        return self._totals(*self.forward(probability))

    def expected(self, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """word, piece and expected number of the piece in a segmentation, for every match."""
        alpha, scale = (x[:, :, 0] for x in self.forward(prior[:, None]))
        total = self._totals(alpha, scale)
        ends = alpha[self.lengths, np.arange(self.n)]
        beta = np.zeros(alpha.shape)
        beta[self.lengths, np.arange(self.n)] = 1.0
        behind = np.zeros(self.n)  # logarithm of the scale of what lies behind
        share, check = np.zeros(len(self.piece)), len(scale) - 1
        for offset, length, s, e in reversed(self.groups):
            while offset < check * _EVERY:
                rows = beta[check * _EVERY : check * _EVERY + self.longest]
                top = rows.max(0)
                # A word that ends here has not been begun, and needs no scale.
                top[(top == 0) | (self.lengths <= check * _EVERY + self.longest)] = 1.0
                rows /= top
                behind += np.log(top)
                check -= 1
            word = self.word[s:e]
            through = prior[self.piece[s:e]] * beta[offset + length, word]
            beta[offset, word] += through
            if len(scale) == 1:  # short words, in one scale
                share[s:e] = alpha[offset, word] * through / ends[word]
                continue
            with np.errstate(divide="ignore"):  # what cannot be continued has no share
                logs = np.log(alpha[offset, word]) + np.log(through)
            share[s:e] = np.exp(logs + scale[offset // _EVERY, word] + behind[word] - total[word])
        return self.word, self.piece, share


def _chunks(words: list[bytes], columns: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words led by a space, about equally long ones together, with their numbers."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        # Lengths rise, so the last one decides how many positions the chunk has.
        cells = lengths[order[start:]] * np.arange(1, len(order) - start + 1) * columns
        some = order[start : start + max(1, int(np.searchsorted(cells, _CELLS, side="right")))]
        yield [b" " + words[i] for i in some], some
        start += len(some)


@dataclass(frozen=True)
class LanguageModel:
    """Languages in code-point order and a column of piece probabilities for each."""

    pieces: tuple[bytes, ...]
    languages: tuple[str, ...]
    probability: np.ndarray


def fit(docs: DataFrame, vocabulary: str) -> LanguageModel:
    """Learn from all rows of ``docs`` (text, lang) with a language; ``vocabulary`` is a ranks file."""
    spark = docs.sparkSession
    pieces = tuple(read_vocabulary(vocabulary))
    shared = spark.sparkContext.broadcast(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(shared.value)
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                words = letter_words(part.column("text"))
                if not words.distinct:
                    continue
                lang = part.column("lang").dictionary_encode()
                names = lang.dictionary.to_pylist()
                code = lang.indices.to_numpy(zero_copy_only=False)[words.row]
                cell = code * len(words.distinct) + words.index
                occurrences = np.bincount(cell, minlength=len(names) * len(words.distinct)).reshape(len(names), -1)
                for runs, origin in _chunks(words.distinct, 1):
                    run, piece, share = _Lattice(trie, runs).expected(trie.prior)
                    for i, name in enumerate(names):
                        seen = occurrences[i, origin[run]] * share
                        counts.setdefault(name, np.zeros(len(trie.prior)))
                        counts[name] += np.bincount(piece, weights=seen, minlength=len(trie.prior))
        for name, values in counts.items():
            some = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(values[some])],
                ["lang", "piece", "n"],
            )

    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sums = labelled.mapInArrow(tidy(count, "language_id"), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    table = sums.toArrow().to_pandas()
    prior = _trie(pieces).prior
    languages = sorted(table["lang"].unique())
    probability = np.empty((len(pieces), len(languages)))
    for i, name in enumerate(languages):
        own = table[table["lang"] == name]
        counts = SMOOTHING * prior
        counts[own["piece"].to_numpy()] += own["n"].to_numpy()
        probability[:, i] = counts / counts.sum()
    return LanguageModel(pieces, tuple(languages), probability)


def _scores(model: LanguageModel, words: Words) -> np.ndarray:
    """Log-likelihood of each row under each language."""
    trie = _trie(model.pieces)
    logs = np.zeros((len(words.distinct), len(model.languages)))
    for runs, origin in _chunks(words.distinct, len(model.languages)):
        totals = _Lattice(trie, runs).log_totals(model.probability)
        for i in range(logs.shape[1]):
            logs[:, i] += np.bincount(origin, weights=totals[:, i], minlength=len(logs))
    return np.stack(
        [np.bincount(words.row, weights=logs[words.index, i], minlength=words.rows) for i in range(logs.shape[1])], axis=1
    )


def annotate(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred and score (its posterior with all languages alike beforehand).

    A text that is null or has no letters is ``und`` with score 0, and so is every
    text if nothing could be learned. Equal likelihoods go to the first language in
    code-point order. Columns of these two names are replaced; rows stay as they are,
    repeated ones too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("lang_pred", "score")
    names = rows.columns

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        languages = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for part in slices(batch):
                words = letter_words(part.column("text"))
                best = np.full(len(part), len(languages) - 1)
                score = np.zeros(len(part))
                if words.distinct and model.languages:
                    logs = _scores(model, words)
                    some = np.bincount(words.row, minlength=len(part)) > 0
                    best[some] = logs[some].argmax(1)
                    score[some] = 1 / np.exp(logs[some] - logs[some].max(1, keepdims=True)).sum(1)
                columns = [*part.columns, pa.array(languages[best], pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score"])

    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(tidy(label, "language_id"), schema)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every document; see :func:`annotate`."""
    return annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text")


def default_vocabulary(spark: SparkSession) -> str:
    """The ranks file that ``presscan.llm.vocabulary`` names, else the public package's multilingual one."""
    named = spark.conf.get("presscan.llm.vocabulary", None)
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
