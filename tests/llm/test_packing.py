import itertools
import zlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing
from tessera.llm.tokens import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip(spark):
    tok = encoder(PATH)
    texts = [None, "", "Hello WORLD  don't stop <|endoftext|> x", "été é", *(f"word{i} " * (i * 7 % 900) for i in range(300)), "long text here " * 9000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(5)
    rows = [r.asDict() for r in packing.pack(docs, PATH, 2).collect()]
    by_doc = {i: b"".join(r["ids"] for r in sorted(g, key=lambda r: r["start"])) for i, g in itertools.groupby(sorted(rows, key=lambda r: r["id"]), key=lambda r: r["id"])}
    want = {i: b"".join(x.to_bytes(4, "little") for x in [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in enumerate(texts)}
    assert by_doc == want
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) and r["doc_tokens"] == len(want[r["id"]]) // 4 for r in rows)
    total, sequences = 0, 0
    for _, g in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in g:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        total, sequences = total + at, sequences + 1
    assert sequences == -(-total // 4096)


WORDS = packing.Words(PATH)


SPECIAL = st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|STARTofTEXT|>", "A<|endoftext|>b.", "x<|ENDOFTEXT|>,", "İstanbul", "<|endoftext|", " "])


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(SPECIAL, st.text(alphabet=st.sampled_from("abAZ1'st.,!#& \n\u0085é\u0301ßΣσİ一<|endoftext>-"), max_size=12)), max_size=10))
def test_words_equal_the_tokenizer(parts):
    text = " ".join(parts)
    want = WORDS.tokenizer.encode(text, add_special_tokens=False).ids
    assert WORDS([text])[0] == b"".join(i.to_bytes(4, "little") for i in want)


def test_words_are_forgotten_and_learnt_again(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    monkeypatch.setattr(packing, "RECENT", 15)
    words = packing.Words(PATH)
    for k in range(40):
        text = " ".join(f"w{j}x, Word{j % 9}." for j in range(k % 7 * 10, k % 7 * 10 + 25))
        assert words([text])[0] == b"".join(i.to_bytes(4, "little") for i in words.tokenizer.encode(text, add_special_tokens=False).ids)
        assert len(words.names) + len(words.recent) < 250
    assert len(words.names) and words.find([b"never"]) == [None]


def test_letters_that_fall_apart_in_lower_case():
    words = packing.Words(PATH)
    text = " ".join(["İzmir" if i % 50 == 7 else f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)])
    assert words([text])[0] == b"".join(i.to_bytes(4, "little") for i in words.tokenizer.encode(text, add_special_tokens=False).ids)


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "one two", 1), (None, "one two", 1), (3, "x", 2), (3, "x", 2), (3, None, 2)]
    got = sorted((r.id or 0, r.start, r.length, r.doc_tokens) for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string, sequence_id int"), PATH, 2).collect())
    assert got == [(0, 0, 3, 3), (0, 0, 3, 3), (3, 0, 1, 1), (3, 0, 2, 2), (3, 0, 2, 2)]


def test_ties_go_to_the_window_changed_longest_ago():
    packer = packing.Packer(10, 3)
    for d in (1, 2, 3):
        assert not list(packer.add(d, 0, 6, b"\0\0\0\0" * 6))
    assert not list(packer.add(4, 0, 2, b"\0\0\0\0" * 2))
    assert [[p[0] for p in pieces] for pieces, _ in packer.windows] == [[2], [3], [1, 4]]


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH, 2).count() == 0
