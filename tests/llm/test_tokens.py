import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandline.llm.packing import pack
from strandline.llm.tokenfile import read_file, read_token_files, write_file, write_token_files
from strandline.llm.tokens import ChunkEncoder, vocabulary_path

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def library(name):
    t = Tokenizer.from_file(vocabulary_path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


ENCODERS = {n: (ChunkEncoder(vocabulary_path(n), joined, limit=50), library(n)) for n, joined in ((WORD, False), (BYTE, True))}


@pytest.mark.parametrize("name", [WORD, BYTE])
@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Zé.,!'\n\t\x00  \x1c\x850́<|>Σ—"), max_size=40), min_size=1, max_size=6))
def test_chunks_give_the_ids_of_whole_texts(name, texts):
    ours, theirs = ENCODERS[name]
    assert [x.tolist() for x in ours.encode(texts)] == [theirs(t) for t in texts]


@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), max_size=4))
@settings(max_examples=60, deadline=None)
def test_file_round_trip(lists):
    ids = [np.array(x, np.uint32) for x in lists]
    keys, lengths, flat = read_file(write_file([None, -(2**63), *range(len(ids))][: len(ids)], ids))
    assert keys == [None, -(2**63), *range(len(ids))][: len(ids)] and lengths.tolist() == [len(x) for x in lists]
    assert flat.tolist() == [v for x in lists for v in x]


def test_the_memo_is_bounded_in_characters():
    theirs = library(WORD)
    ours = ChunkEncoder(vocabulary_path(WORD), False, most_chars=500)
    for i in range(40):  # texts with runs of blanks are one chunk each
        text = f"some  words {i} " * 20
        assert ours.encode([text, "plain words"])[0].tolist() == theirs(text)
        assert ours.chars < 2000 and len(ours.flat) < 2000


def test_pieces_hold_every_id_once(spark, odd, none):
    assert pack(none, vocabulary_path(WORD)).count() == 0
    encode = library(WORD)
    want = sorted(tuple([*encode(r.text or ""), 1]) for r in odd.collect())
    rows = pack(odd, vocabulary_path(WORD), size=64, open_windows=2, merge_windows=2).toPandas()
    raw = rows.ids.map(lambda b: np.frombuffer(b, "<u4"))
    assert (raw.map(len) == rows.length).all() and [zlib.crc32(b) for b in rows.ids] == rows.ids_crc32.tolist()
    order = rows.sort_values(["sequence_id", "offset"])
    assert (order.groupby("sequence_id").length.cumsum() - order.length == order.offset).all()
    used = rows.groupby("sequence_id").length.sum()
    assert used.max() <= 64 and used.sum() / (64 * len(used)) > 0.95
    alone = rows[~rows.doc_id.isin([1]) & rows.doc_id.notna()].assign(raw=raw).sort_values(["doc_id", "start"])
    for doc, part in alone.groupby("doc_id"):
        assert tuple(np.concatenate(part.raw.to_list())) in want and part.length.sum() == part.doc_tokens.iloc[0]
    assert rows.length.sum() == sum(map(len, want))


def test_files_hold_documents_in_order(spark, odd, none):
    assert read_token_files(write_token_files(none, vocabulary_path(BYTE))).count() == 0
    encode = library(BYTE)
    docs = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    rows = read_token_files(write_token_files(odd, vocabulary_path(BYTE), file_ids=100)).orderBy("start").collect()
    at = 0
    for (doc, text), r in zip(docs, rows, strict=True):
        ids = np.array([*encode(text), 0], "<u4")
        assert tuple(r) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_words_are_encoded_many_at_a_time():
    ours, theirs = ChunkEncoder(vocabulary_path(BYTE), True), library(BYTE)
    asked = []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return held.encode_batch_fast(texts, **options)

    held, ours.library = ours.library, Counted()
    texts = [" ".join(f"w\u00f6rd{i}x{i * i} \u4e2d{i} {i}" for i in range(k, k + 900)) + ", (end)" for k in (0, 900)]
    assert [x.tolist() for x in ours.encode(texts)] == [theirs(t) for t in texts]
    assert len(asked) < 20 < len(ours.memo)


def asked_of(ours):
    """Every string that the library is given from now on."""
    asked, held = [], ours.library

    class Counted:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return held.encode_batch_fast(texts, **options)

    ours.library = Counted()
    return asked


def test_words_with_signs_are_encoded_many_at_a_time():
    ours, theirs = ChunkEncoder(vocabulary_path(BYTE), True), library(BYTE)
    asked = asked_of(ours)
    signs = ("$$$", ",&&&", "'s", "-", "...", "(", "<|endoftext|>", "\u200b", "\x1b", "\u0301", "\U0001f600", "'")
    texts = [" ".join(f"{a}w\u00f6rd{i}{b}" for i, (a, b) in enumerate((a, b) for a in signs for b in signs)), " ".join(signs) + " " + " ".join(s + "x" for s in signs)]
    assert [x.tolist() for x in ours.encode(texts)] == [theirs(t) for t in texts]
    assert len(asked) < 10 < 100 < len(ours.memo)


def test_a_large_vocabulary_is_encoded_once():
    ours, theirs = ChunkEncoder(vocabulary_path(BYTE), True), library(BYTE)
    texts = [" ".join(f"w{i}" for i in range(k, k + 250_000)) for k in (0, 250_000)]
    for text in texts:
        ours.encode([text])
    asked = asked_of(ours)
    assert ours.encode(["w1 again w250001 again"])[0].tolist() == theirs("w1 again w250001 again")
    assert [x.tolist() for x in ours.encode(texts)] == [theirs(t) for t in texts]
    assert sum(map(len, asked)) < 100
