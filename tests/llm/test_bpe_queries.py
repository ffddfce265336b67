"""What the encoder asks DuckDB for: one query for a chunk of new pieces, decoding takes none."""

import sys

import public_tokenizers
import pyarrow as pa

from weftline.llm import bpe


class Counted:
    def __init__(self, db):
        self.db, self.asked = db, []

    def sql(self, query):
        self.asked.append(query)
        given = sys._getframe(1).f_locals["given"]  # noqa: F841 - DuckDB finds it by name
        return self.db.sql(query)


def test_a_chunk_of_pieces_is_one_query_over_one_row_a_piece():
    encoder = bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY))
    encoder.db = Counted(encoder.db)
    pieces = [" thoneranonti", " é́", "a", " licheinver", "🙂🏽"]
    encoder.learn(pieces)
    assert len(encoder.db.asked) == 1
    assert encoder._given([p.encode() for p in pieces]).num_rows == len(pieces)
    assert [encoder.known[p][2].decode() for p in pieces] == pieces
    assert all(len(ids.split(" ")) == n for ids, n, _ in encoder.known.values())


def test_null_lists_and_unknown_ids_have_no_bytes():
    encoder = bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY))
    a = int(encoder.bytes[ord("a")])
    ids = pa.array([[a, 10**9, a], None, [], [-5, None, a]], pa.list_(pa.int32()))
    assert encoder.decode(ids) == [b"aa", b"", b"", b"a"]
    assert encoder.decode(ids.slice(3)) == [b"a"]
