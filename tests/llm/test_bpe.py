import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqmill.llm import bpe
from seqmill.llm.queries import vocabulary

LIBRARY = Tokenizer.from_file(vocabulary())
OWN, FAST = bpe.codec(vocabulary()), bpe.codec(vocabulary(), True)
PARTS = st.sampled_from(["a", "e", "th", "ing", " ", "  ", "\n", "\t", "'s", "'", "<|endoftext|>", "<|endof", "é", "漢", "1", "²", "٣", "_", "!!", "\x1c", "\x85", "\xa0", " ", "🙂", "́", "​", "\x00", "aaaa", "A"])


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(PARTS, max_size=30).map("".join), st.text(max_size=40)))
def test_same_ids_as_the_library(text):
    ids = OWN.encode(text)
    assert ids.tolist() == library_ids(text) == FAST.encode(text).tolist()
    assert OWN.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("text", ["ab" * 20_000, "a" * 5000, "=" * 3000, " " * 3000, "xyzzy" * 1000 + "é"])
def test_long_pieces(text):
    assert OWN.encode(text).tolist() == library_ids(text)
    assert OWN.decode(OWN.encode(text)) == text


def test_a_worker_keeps_a_bounded_number_of_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 10)
    own = bpe.Codec(vocabulary())
    text = " ".join(f"w{k}" for k in range(100))
    assert own.encode(text).tolist() == library_ids(text)
    assert len(own.words) <= 10 and len(own.pieces) <= 10


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "The <|endoftext|> é", "z"), (3, "The <|endoftext|> é", "z"), (None, "w " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(df, vocabulary()).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {(i, len(library_ids(t or "")), sha(np.array(library_ids(t or ""), "<u4").tobytes()), sha((t or "").encode())) for i, t, _ in rows}
    assert bpe.digest(df, vocabulary()).count() == len(rows) and bpe.digest(df.limit(0), vocabulary()).count() == 0
    assert bpe.encode_column(df, vocabulary()).where("doc_id = 3").first().ids == library_ids(rows[2][1])
