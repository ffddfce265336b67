"""Byte-level BPE encoding, by DuckDB recursive queries in each partition, and decoding.

A batch's texts are cut by the split pattern; each distinct piece is encoded once. Its bytes become a list of
tokens; every turn of a recursive query joins the neighbours to the merge table and contracts each
piece's leftmost pair of least rank, until no piece has a pair left. Decoding takes the ids' bytes from the vocabulary
and joins them, by column. Short pieces accumulate their turns; longer ones keep only the last state (``USING KEY``),
so memory stays proportional to the piece, and contract all pairs of their least rank in one turn, from the left, where the
token so made joins no neighbour at a lesser rank.

Time is near linear in a piece, too: one of over ``PIECE`` bytes is encoded in parts, all in one query, and the parts are joined
two by two. A sequence of tokens is the encoding exactly if each two neighbours are the encoding of their bytes; so the
tokens next to a joint are encoded anew, ever more of them, until the outermost ones on both sides come out as before.

Results of pieces are kept for later batches of a task up to a bound, in two generations: when the younger holds half of the bound, it becomes the older,
and what of that is met again moves to the younger.

Null text is empty: no tokens. Equal rows give equal rows, null ids pass through, and other columns are not read. Very long
texts are cut like any other; their pieces are held at once. Special tokens are ordinary text. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from weftline.llm.common import settle, ship, text_rows

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces kept per worker; bytes of pieces per query; characters of texts cut at once; bytes beyond which a piece is long.
CACHE, CHUNK, GROUP, LONG = 300_000, 1 << 18, 1 << 20, 64
#: Bytes beyond which a piece is encoded in parts, bytes of a part, tokens on each side of a joint at first.
PIECE, PART, SIDE = 512, 128, 4

_PAIRS = """
SELECT w, min((rank::BIGINT << 32) | pos) AS best
FROM (SELECT w, unnest(toks) AS tok, unnest(toks[2:]) AS nxt, generate_subscripts(toks, 1) AS pos FROM s)
JOIN merges ON l = tok AND r = nxt GROUP BY w"""
_NEXT = "s.toks[:(best & 4294967295) - 1] || [(best >> 32)::INTEGER] || s.toks[(best & 4294967295) + 2:]"

ENCODE_SHORT = f"""
WITH RECURSIVE s(turn, w, toks) AS (
  SELECT 0, w, toks FROM given
  UNION ALL
  SELECT turn + 1, s.w, {_NEXT} FROM s JOIN ({_PAIRS}) b ON b.w = s.w
) SELECT w, toks FROM s JOIN (SELECT w, max(turn) AS turn FROM s GROUP BY w) USING (w, turn) ORDER BY w"""
ENCODE_LONG = """
WITH RECURSIVE s(w, toks) USING KEY (w) AS (
  SELECT w, toks FROM given
  UNION
  SELECT w, list(CASE WHEN hit THEN best ELSE tok END ORDER BY pos) FILTER (WHERE NOT gone) FROM (
    SELECT *, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY pos), false) AS gone FROM (
      SELECT w, pos, tok, best, coalesce(rank = best AND (pos - min(pos) OVER (PARTITION BY w, run)) % 2 = 0
        AND (safe OR pos = min(CASE WHEN rank = best THEN pos END) OVER (PARTITION BY w)), false) AS hit FROM (
        SELECT *, CASE WHEN rank = best THEN pos - row_number() OVER (PARTITION BY w, rank = best ORDER BY pos) END AS run FROM (
          SELECT p.*, rank, safe, min(rank) OVER (PARTITION BY w) AS best
          FROM (SELECT w, unnest(toks) AS tok, unnest(toks[2:]) AS nxt, generate_subscripts(toks, 1) AS pos FROM s) p
          LEFT JOIN merges ON l = tok AND r = nxt)
        WHERE best IS NOT NULL)))
  GROUP BY w
) SELECT w, toks FROM s ORDER BY w"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    """Encodes and decodes pieces with DuckDB; one per worker and vocabulary."""

    made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def __init__(self, path: str):
        ranks = read_ranks(path)
        merges = [(a, b, rank) for token, rank in ranks.items() for k in range(1, len(token))
                  if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        hasty = {x for a, b, rank in merges for x in (a, b) if rank < x}  # tokens that join a neighbour at a lesser rank than their own
        columns = [*(pa.array(c, pa.int32()) for c in zip(*merges, strict=True)), pa.array([rank not in hasty for _, _, rank in merges])]
        pairs = pa.table(columns, ["l", "r", "rank", "safe"])  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM pairs")
        self.bytes = np.array([ranks[bytes([k])] for k in range(256)], np.int32)
        self.token = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        ids = range(max(ranks.values()) + 1)
        self.digits = pa.array(list(map(str, ids)))
        self.vocabulary = pa.array([self.token.get(k, b"") for k in ids] + [b""], pa.large_binary())  # the last stands for unknown ids
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def _given(self, pieces: list[bytes]) -> pa.Table:
        offsets = np.cumsum(np.fromiter(map(len, [b"", *pieces]), np.int32, len(pieces) + 1), dtype=np.int32)
        tokens = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        return pa.table([pa.array(np.arange(len(pieces), dtype=np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))], ["w", "toks"])

    def encode(self, pieces: list[bytes]) -> pa.Table:
        """(w, toks) of non-empty pieces, in their order."""
        given = self._given(pieces)  # noqa: F841
        return self.db.sql(ENCODE_LONG if max(map(len, pieces)) > LONG else ENCODE_SHORT).to_arrow_table()

    def encode_parts(self, piece: bytes) -> list[int]:
        """Ids of a piece of any length, joined from those of its parts."""
        parts = self.encode([piece[k : k + PART] for k in range(0, len(piece), PART)]).column("toks").to_pylist()
        while len(parts) > 1:
            left = [parts[-1]] if len(parts) % 2 else []
            parts = self.joined(list(zip(parts[::2], parts[1::2], strict=False))) + left
        return parts[0]

    def joined(self, pairs: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """Ids of the bytes of both lists of each pair."""
        done: dict[int, list[int]] = {}
        side = SIDE
        while open_ := [k for k in range(len(pairs)) if k not in done]:
            windows = [b"".join(map(self.token.__getitem__, pairs[k][0][-side:] + pairs[k][1][:side])) for k in open_]
            for k, new in zip(open_, self.encode(windows).column("toks").to_pylist(), strict=True):
                a, b = pairs[k]
                if (side >= len(a) or new[0] == a[-side]) and (side >= len(b) or new[-1] == b[side - 1]):
                    done[k] = a[:-side] + new + b[side:]
            side *= 4
        return [done[k] for k in range(len(pairs))]

    def decode(self, ids: pa.ListArray) -> list[bytes]:
        """Bytes of lists of ids; null lists and unknown ids have none."""
        known = pc.fill_null(ids.values, -1).to_numpy(zero_copy_only=False)
        last = len(self.vocabulary) - 1
        tokens = self.vocabulary.take(pa.array(np.where((known >= 0) & (known < last), known, last)))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), tokens), pa.scalar(b"", pa.large_binary()))
        return joined.to_pylist()

    def learn(self, new: list[str]) -> None:
        """Encode and decode the given distinct pieces, and keep (ids as text, number of ids, bytes) of each."""
        for piece in [p for p in new if len(p) > PIECE // 4 and len(p.encode()) > PIECE]:
            toks = self.encode_parts(piece.encode())
            self.known[piece] = (" ".join(map(str, toks)), len(toks), self.decode(pa.array([toks], pa.list_(pa.int32())))[0])
        rest = [p for p in new if p not in self.known]
        for some in ([p for p in rest if len(p) <= LONG // 4], [p for p in rest if len(p) > LONG // 4]):
            data = [p.encode() for p in some]
            first, size = 0, 0
            for k, n in enumerate(map(len, data), 1):
                size += n
                if size >= CHUNK or k == len(data):
                    self.learn_chunk(some[first:k], data[first:k])
                    first, size = k, 0

    def learn_chunk(self, pieces: list[str], data: list[bytes]) -> None:
        toks = self.encode(data).column("toks").combine_chunks()
        texts = pc.binary_join(pa.ListArray.from_arrays(toks.offsets, self.digits.take(toks.values)), " ")
        self.known.update(zip(pieces, zip(texts.to_pylist(), pc.list_value_length(toks).to_pylist(), self.decode(toks), strict=True), strict=True))

    def pieces(self, texts: Iterable[str]) -> Iterator[list[tuple[str, int, bytes]]]:
        """What is kept of each piece of each text; texts are taken in groups, so new pieces are encoded together."""
        for group in _groups(texts):
            cut = [self.split(t) for t in group]
            distinct = set().union(*cut)
            if len(self.known) > CACHE // 2:
                self.known, self.older = {}, self.known
            new = [p for p in distinct if p not in self.known]
            if self.older:
                again = [p for p in new if p in self.older]
                self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
                new = [p for p in new if p not in self.known]
            if new:
                self.learn(new)
            for words in cut:
                yield [self.known[w] for w in words]


def _groups(texts: Iterable[str]) -> Iterator[list[str]]:
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= GROUP:
            yield group
            group, held = [], 0
    if group:
        yield group


def _run(path: str, row, kinds: dict[str, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            rows = [row(parts) for parts in encoder.pieces(t.decode() for t in text_rows(batch))]
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *kinds])
        encoder.forget()
        settle()

    return run


def _ids(parts) -> tuple:
    return ([int(x) for p in parts for x in p[0].split(" ")],)


def _digests(parts) -> tuple:
    ids, data = " ".join([p[0] for p in parts]), b"".join([p[2] for p in parts])
    return sum([p[1] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(data).hexdigest()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) per row of ``docs(doc_id, text)``."""
    ship(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)
    return docs.select("doc_id", "text").mapInArrow(_run(path, _ids, {"ids": pa.list_(pa.int32())}), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, bytes) per row of ``tokens(doc_id, ids)``; null or no ids give no bytes."""
    ship(tokens.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            out = encoder.decode(batch.column("ids"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns: ids and decoded bytes as digests."""
    ship(docs.sparkSession)
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    run = _run(path or public_tokenizers.path(VOCABULARY), _digests, kinds)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
