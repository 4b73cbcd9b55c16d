"""Byte-level BPE with recursive queries in DuckDB, one connection per task.

A word (a match of the splitting pattern) becomes rows of token and position. A
recursive query joins neighbouring tokens with the merge table, contracts each
word's leftmost pair of minimum rank and repeats until no pair is left. Texts
are decoded by an aggregation of token bytes in the order of positions. Words
already encoded are kept up to a bound, from task to task of a process, so a frequent word
is contracted once.

Token ids are stored as little-endian unsigned 32-bit integers in a binary column.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presscan.llm.wordbatch import CACHES, slices, tidy

#: Words kept by a process, words contracted by one query, and what makes a word long.
KNOWN, CHUNK, LONG = 500_000, 10_000, 64
#: Bytes of text, or of ids, that a task splits, encodes or decodes together: every word and token of them is held at once.
TEXTS = 1 << 20

#: One pair a word and round: the leftmost of minimum rank. A row knows the token after it and, in one number, the rank of
#: both together (a token's rank is its id) and its place, so a round looks up only the pairs that it changed.
CONTRACT = """
    WITH RECURSIVE tokens(word, pos, id, npos, nid, best, live) AS (
      SELECT s.word, s.pos, s.id, s.npos, s.nid, m.rank * 65536 + s.pos, true
      FROM starts s LEFT JOIN merges m ON m.pair = s.id::BIGINT * 4294967296 + s.nid
      UNION ALL
      SELECT u.word, u.pos, u.id, u.npos, u.nid, CASE WHEN u.changed THEN m.rank * 65536 + u.pos ELSE u.best END, u.live
      FROM (
        SELECT t.word, t.pos,
          CASE WHEN t.pos = h.hpos THEN h.made ELSE t.id END AS id,
          CASE WHEN t.pos = h.hpos THEN h.npos ELSE t.npos END AS npos,
          CASE WHEN t.pos = h.hpos THEN h.nid WHEN t.npos = h.hpos THEN h.made ELSE t.nid END AS nid,
          t.best, t.pos = h.hpos OR t.npos = h.hpos AS changed, h.word IS NOT NULL AS live
        FROM (SELECT * FROM tokens WHERE live) t LEFT JOIN (
          SELECT b.word, b.low & 65535 AS hpos, (b.low >> 16)::INTEGER AS made, b.spos, s.npos, s.nid
          FROM (
            SELECT word, min(best) AS low, arg_min(npos, best) AS spos FROM tokens WHERE live AND best IS NOT NULL GROUP BY word
          ) b
          JOIN tokens s ON s.word = b.word AND s.pos = b.spos
        ) h ON h.word = t.word
        WHERE h.spos IS NULL OR t.pos <> h.spos
      ) u LEFT JOIN merges m ON m.pair = CASE WHEN u.changed THEN u.id::BIGINT * 4294967296 + u.nid END
    )
    SELECT word, id FROM tokens WHERE NOT live ORDER BY word, pos
"""
_PAIRS = """
    SELECT s.word, s.pos, s.id, m.made, m.rank, m.alone
    FROM (SELECT word, pos, id, lead(id) OVER (PARTITION BY word ORDER BY pos) AS following FROM tokens WHERE live) s
    LEFT JOIN merges m ON m.first = s.id AND m.second = s.following
"""
#: For long words: all pairs of minimum rank in one round, leftmost first, unless a token they make could take part in
#: a pair of lower rank, which one-by-one contraction would prefer (``alone``). In a run of one token every other pair counts.
CONTRACT_LONG = f"""
    WITH RECURSIVE tokens(word, pos, id, live) AS (
        SELECT word, pos, id, true AS live FROM starts
        UNION ALL
        SELECT word, pos, CASE WHEN hit THEN made ELSE id END, best IS NOT NULL
        FROM (
            SELECT *, lag(hit) OVER (PARTITION BY word ORDER BY pos) AS swallowed
            FROM (
                SELECT *, low AND CASE WHEN alone THEN pos = leftmost ELSE row_number() OVER (PARTITION BY word, island, low ORDER BY pos) % 2 = 1 END AS hit
                FROM (
                    SELECT *, min(CASE WHEN low THEN pos END) OVER (PARTITION BY word) AS leftmost,
                        sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY pos) AS island
                    FROM (
                        SELECT *, coalesce(rank = best, false) AS low
                        FROM (SELECT *, min(rank) OVER (PARTITION BY word) AS best FROM ({_PAIRS}))
                    )
                )
            )
        )
        WHERE swallowed IS NOT true
    )
    SELECT word, id FROM tokens WHERE NOT live ORDER BY word, pos
"""
#: A text's bytes are put together in the order of its tokens; the connection has one thread, which keeps that order.
DECODE = """
    SELECT doc, string_agg(bytes, '') AS bytes
    FROM (SELECT c.doc, v.bytes FROM coded c JOIN vocabulary v USING (id) ORDER BY c.doc, c.pos)
    GROUP BY doc
"""


def _as_text(data: bytes) -> str:
    """A character above 255 for each byte, so that any bytes can be a string."""
    return "".join(chr(256 + b) for b in data)


class Codec:
    """The vocabulary of one ranks file inside a DuckDB connection."""

    def __init__(self, ranks: tuple[bytes, ...]):
        import duckdb

        self.rank = {token: i for i, token in enumerate(ranks)}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[bytes, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
        pairs = [
            (self.rank[token[:cut]], self.rank[token[cut:]], made)
            for token, made in self.rank.items()
            for cut in range(1, len(token))
            if token[:cut] in self.rank and token[cut:] in self.rank
        ]
        first, second, made = (np.array(x, np.int32) for x in zip(*pairs, strict=True))
        # A token that some pair of lower rank than its own contains.
        drawn = np.zeros(len(ranks), bool)
        for part in (first, second):
            drawn[part[made < part]] = True
        alone = drawn[made]
        pair = first.astype(np.int64) << 32 | second
        merges = pa.table({"pair": pair, "first": first, "second": second, "made": made, "rank": made.astype(np.int64), "alone": alone})
        vocabulary = pa.table({"id": np.arange(len(ranks), dtype=np.int32), "bytes": [_as_text(t) for t in ranks]})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def _contract(self, words: list[bytes], query: str) -> None:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = (np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        ids = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        last = np.concatenate([word[1:] != word[:-1], [True]])
        following = pa.array(np.concatenate([ids[1:], ids[:1]]), mask=last)
        self.db.register("starts", pa.table({"word": word, "pos": pos, "id": ids, "npos": pa.array(pos + 1, mask=last), "nid": following}))
        found = self.db.execute(query).fetchnumpy()
        self.db.unregister("starts")
        at, data = np.asarray(found["word"]), np.asarray(found["id"]).astype("<u4")
        ends = np.searchsorted(at, np.arange(len(words)), side="right") * 4
        raw, start = data.tobytes(), 0
        for token_word, end in zip(words, ends.tolist(), strict=True):
            self.known[token_word] = raw[start:end]
            start = end

    def learn(self, words: set[bytes]) -> None:
        """Encode words that are not known yet; beyond the bound, only the given ones stay known."""
        missing = words.difference(self.known)
        if len(self.known) + len(missing) > KNOWN:
            self.known = {word: self.known[word] for word in words - missing}
        fresh: list[bytes] = []
        for word in missing:
            whole = self.rank.get(word)
            if whole is None:
                fresh.append(word)
            else:
                self.known[word] = whole.to_bytes(4, "little")
        short = [w for w in fresh if len(w) <= LONG]
        for start in range(0, len(short), CHUNK):
            self._contract(short[start : start + CHUNK], CONTRACT)
        for word in fresh:
            if len(word) > LONG:
                self._contract([word], CONTRACT_LONG)

    def encode(self, texts: list[str | None], pattern) -> list[bytes]:
        split = [[w.encode() for w in pattern.findall(t)] if t else [] for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, coded: list[bytes | None]) -> list[bytes]:
        rows = [(i, c) for i, c in enumerate(coded) if c]
        out = [b""] * len(coded)
        if not rows:
            return out
        ids = np.frombuffer(b"".join(c for _, c in rows), "<u4").astype(np.int32)
        lengths = np.array([len(c) // 4 for _, c in rows])
        doc = np.repeat(np.array([i for i, _ in rows], np.int32), lengths)
        pos = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.db.register("coded", pa.table({"doc": doc, "pos": pos.astype(np.int32), "id": ids}))
        for doc, text in self.db.execute(DECODE).fetchall():
            out[doc] = text.encode("utf-16-le")[::2]
        self.db.unregister("coded")
        return out


@lru_cache(maxsize=1)
def _codec(ranks: tuple[bytes, ...]) -> Codec:
    return Codec(ranks)


CACHES["bpe"] = _codec.cache_clear


def read_ranks(path: str) -> tuple[bytes, ...]:
    """Tokens of a ranks file in the order of their ids."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return tuple(ranks[i] for i in range(len(ranks)))


def _mapped(docs: DataFrame, path: str, schema: str, work) -> DataFrame:
    """``work(codec, part)`` gives the columns after doc_id for each slice of the rows."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value)
        for batch in batches:
            for part in slices(batch, batch.schema.names[1], TEXTS):
                columns = [pa.array(c, pa.binary()) for c in work(codec, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    return docs.mapInArrow(tidy(run, "bpe"), schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of each text; none for a null or empty one. Repeated rows are rows of their own."""
    return _mapped(_texts(docs), path, "doc_id long, ids binary", lambda codec, texts: [codec.encode(texts, _compiled(pattern))])


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes that ``ids`` stand for; none for null ids."""
    rows = coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
    return _mapped(rows, path, "doc_id long, decoded binary", lambda codec, ids: [codec.decode(ids)])


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and what they decode to, in one pass over the texts."""

    def both(codec: Codec, texts: list[str | None]) -> list[list[bytes]]:
        ids = codec.encode(texts, _compiled(pattern))
        return [ids, codec.decode(ids)]

    return _mapped(_texts(docs), path, "doc_id long, ids binary, decoded binary", both)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


@lru_cache(maxsize=2)
def _compiled(pattern: str):
    import regex

    return regex.compile(pattern)
