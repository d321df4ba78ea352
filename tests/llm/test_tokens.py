"""Token files: round trips, chunks, word-wise encoding, damage, and defined cases."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import files, tokens

P = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
PATH = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [False, True])
@given(x=st.lists(st.integers(0, 2**32 - 1), max_size=70))
@settings(max_examples=40, deadline=None)
def test_planes(bits, x):
    ids = np.array(x, "<u4")
    assert files.from_planes(files.to_planes(ids, bits), len(ids), np.dtype("<u4"), bits).tolist() == x


def plain(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


ODD = ["a\x01b c \x01 d", "É é ＡＢ ½² Σας ΟΔΟΣ x", "tab\tnew\nline\r\x0bv\x0cf nb sp\x1cq", "don't 's 'S <|endoftext|> <|STARTOFTEXT|>x", "", " ", "\x00 😀👍🏽 中文字 한국어", "a" * 300 + " " + "b" * 70, "x... y…. z'. it's, ét́. -- (x) x| 3,5 x3. ß. ǅ.", "The the THE the, THE!! été, ÉTÉ"]


def test_word_by_word_is_the_same():
    e = tokens.Encoder(Tokenizer.from_file(PATH), by_word=True)
    assert e.by_word
    for _ in range(2):  # cold and remembered
        assert [np.frombuffer(x, "<u4").tolist() for x in e([t.encode() for t in ODD])] == plain(ODD)


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_any_text_word_by_word(t):
    e = tokens.Encoder(Tokenizer.from_file(PATH), by_word=True)
    assert np.frombuffer(e([t.encode("utf-8", "replace")])[0], "<u4").tolist() == plain([t.encode("utf-8", "replace").decode()])[0]


@pytest.mark.parametrize(("by_word", "bits", "chunk", "file_ids"), [(True, False, 16, 40), (False, True, 1 << 16, 1 << 20)])
def test_files_hold_every_document(docs, tmp_path, by_word, bits, chunk, file_ids):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "no id"), (7, "again"), (7, "again"), (50, "long text " * 4000)]
    made = tokens.write(docs(rows), PATH, 1, folder=f"file://{tmp_path}/t", by_word=by_word, bits=bits, chunk=chunk, file_ids=file_ids)
    got = tokens.read(made, with_ids=True).orderBy("start").collect()
    assert len(got) == len(rows)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    want = sorted((-1 if i is None else i, tuple([*x, 1])) for (i, _), x in zip(rows, plain([t or "" for _, t in rows])))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    start = 0
    for r in got:
        assert (r["start"], r["n_tokens"] * 4, r["ids_crc32"]) == (start, len(r["ids"]), zlib.crc32(r["ids"]))
        start += r["n_tokens"]


def test_empty_and_damaged(docs, tmp_path):
    assert tokens.read(tokens.write(docs([]), PATH, 1)).count() == 0
    path = f"{tmp_path}/x.tok"
    w = tokens.FileWriter(f"file://{path}", chunk=8)
    w.add(5, np.arange(20, dtype="<u4"))
    w.close()
    assert tokens.FileReader(path).read_chunk(1).tolist() == list(range(8, 16))
    raw = bytearray(open(path, "rb").read())
    raw[-1] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError, match="token file"):
        tokens.FileReader(path)
