import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = tokens.encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1'st.,! \n\téß一 <|endoftext>-\0"), max_size=60))
def test_pieces_add_up(text):
    assert tokens.lengths([text], TOK, {}) == [len(TOK.encode(text, add_special_tokens=False).ids)]


MIXED = "ab1Z's't.,! \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u2028\u200b\u180e\ufeff\u3000éßЖдя٣كि一语。！、，①Ⅷ\u0301😀\0_"


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "  ", "\n\n", " '", "'ll ", "don't", "слово", "語。", "12ab"]), st.text(alphabet=st.sampled_from(MIXED), max_size=8)), max_size=14))
def test_boundaries_are_safe_in_any_script(parts):
    text = "".join(parts)
    whole = len(TOK.encode(text, add_special_tokens=False).ids)
    for long in (tokens.LONG, 3):
        tokens.LONG, old = long, tokens.LONG
        try:
            pieces = tokens.pieces_of(text)
            assert "".join(pieces) == text and sum(len(TOK.encode(p, add_special_tokens=False).ids) for p in pieces) == whole
        finally:
            tokens.LONG = old


def test_long_texts_fall_into_short_pieces():
    for text in ("слово и дело " * 5000, "word\n" * 20_000, "a\0b " * 9000, "文字，文章。" * 9000, "a1b22c333" * 9000, "x\u3000y" * 9000):
        assert max(map(len, tokens.pieces_of(text))) < 50
        assert tokens.lengths([text], TOK, {}) == [len(TOK.encode(text, add_special_tokens=False).ids)]


def test_calls_are_balanced_by_bytes():
    pieces = ["語" * 100] * 50 + ["a" * 100] * 50 + ["é" * 3000]
    runs = list(tokens.by_bytes(pieces, 1000))
    assert [p for r in runs for p in r] == pieces
    assert all(sum(len(p.encode()) for p in r) <= 1000 or len(r) == 1 for r in runs)
    assert all(sum(len(p.encode()) for p in r) + len(n[0].encode()) > 1000 for r, n in zip(runs, runs[1:], strict=False))


def test_rows(spark):
    texts = ["Hello  world don't", None, "", "x" * 50_000, "a <|endoftext|> b", "word " * 30_000]
    docs = spark.createDataFrame([(i % 5, t, 1) for i, t in enumerate(texts)] + [(None, "a", 2)], "doc_id long, text string, n_tokens int")
    got = sorted(((r.id if r.id is not None else -1), r.n_bytes, r.n_tokens) for r in tokens.token_counts(docs, PATH).collect())
    want = [(i % 5, len((t or "").encode()), len(TOK.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    assert got == sorted([*want, (-1, 1, 1)])
    assert tokens.token_counts(docs.limit(0), PATH).count() == 0
