import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lagscope.llm import bpe, token_count
from lagscope.llm.pretokens import byte_level

from .conftest import clashing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def lib_ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


EDGE = ["", None, " ", "  a  b ", "it's we'll I'D x'tt ''s", "é à ñandú straße ÀÉ", "12 345a6", "<|endoftext|>",
        "a <|endoftext|>  b<|endoftext|><|endoftext|> c", "<|endof<|endoftext|>text|>", "\x1c\x1d\x85  　x",
        "՘x 1\U0003fc3d y࢏", "漢字かな交じり文 한국어", "😀😀👩‍👩‍👧 é", "a" * 5000, "ab" * 20001, "!" * 3000,
        " " * 4000 + "x", "\n\n\n\t x\r\n", "\0\x01a\0", "hello world " * 3000]


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text("ab '\n<|endoftx>s1é", max_size=60))
def test_merge_equals_the_library(text):
    ids, = bpe.merges(PATH).encode([text])
    assert ids == lib_ids(text)
    assert bpe.merges(PATH).decode(ids) == LIB.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", [t for t in EDGE if t])
def test_edge_texts(text):
    coder = bpe.merges(PATH)
    assert coder.encode([text]) == [lib_ids(text)]
    lengths = token_count.Lengths({}, byte_level(PATH))
    pieces, marks = byte_level(PATH).split(text)
    lengths.learn(pieces)
    assert sum(lengths[p] for p in pieces) + len(marks) == len(lib_ids(text))


def test_decode_of_broken_utf8():
    for ids in ([100], [230, 100], [50256, 160, 159], lib_ids("é漢")[:2]):
        assert bpe.merges(PATH).decode(ids) == LIB.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abcdeé \U0001f600thing", min_size=1, max_size=70) | st.text(min_size=1, max_size=8), max_size=30))
def test_trees_in_rows_equal_single_trees(pieces):
    coder = bpe.Merges(PATH)
    coder.learn(pieces)
    assert [list(coder[p]) for p in pieces] == [coder.merge(p.encode()) for p in pieces]


@settings(max_examples=500, deadline=None)
@given(st.text(st.characters(max_codepoint=0x250), max_size=40))
def test_latin_pattern_equals_the_published_one(text):
    whole = [text[a:b] for _, (a, b) in byte_level(PATH).library.pre_tokenizer.pre_tokenize_str(text)]
    assert byte_level(PATH).split(text)[0] == whole


def test_every_character_is_cut_as_the_library_cuts_it():
    tok = byte_level(PATH)
    for c in map(chr, [*range(0x3000), 0x4E00, 0xAC00, 0xFF10, 0xFFFD, 0x1F600, 0x3FC3D]):
        text = f"a{c}1{c}!{c} {c}  {c}s"
        assert tok.split(text)[0] == [text[a:b] for _, (a, b) in tok.library.pre_tokenizer.pre_tokenize_str(text)]


def test_worker_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(token_count, "CACHE_SIZE", 3)
    monkeypatch.setattr(bpe, "CACHE_SIZE", 3)
    lengths, coder = token_count.Lengths({" the": 1}, byte_level(PATH)), bpe.Merges(PATH)
    for i in range(20):
        pieces = [f"w{i}", "x" * 100 + str(i)]
        lengths.learn(pieces)
        coder.learn(pieces)
        for p in pieces:
            assert lengths[p] == len(coder[p]) == len(lib_ids(p))
    assert len(lengths) <= 1 + 3 + 2 and len(coder) <= 3 + 2 and len(coder.old) <= 3 + 2 and lengths[" the"] == 1


def test_pack():
    table = [(" the", 1), ("x\0y", 3), ("é", 2), ("long", 300)]
    assert token_count.unpack(token_count.pack(table)) == {" the": 1, "é": 2}
    assert token_count.pack([]) == (b"", b"")


def test_counts_and_round_trip(docs_of, sf_docs):
    rows = [(i, t) for i, t in enumerate(EDGE)] + [(None, "null id"), (3, EDGE[3])]
    rows += [(r.doc_id + 1000, r.text) for r in sf_docs.collect()]
    df = clashing(docs_of(rows))
    want = sorted(((d, len((t or "").encode()), len(lib_ids(t)), len(lib_ids(t)) > 512) for d, t in rows), key=str)
    assert sorted([tuple(r) for r in token_count.token_counts(df, PATH).collect()], key=str) == want

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()
    want = sorted(((d, len(lib_ids(t)), sha(",".join(map(str, lib_ids(t)))),
                    sha(LIB.decode(lib_ids(t), skip_special_tokens=False))) for d, t in rows), key=str)
    assert sorted([tuple(r) for r in bpe.round_trip_digests(df, PATH).collect()], key=str) == want


def test_empty(docs_of):
    assert token_count.token_counts(docs_of([]), PATH).count() == 0
    assert bpe.round_trip_digests(docs_of([]), PATH).count() == 0
