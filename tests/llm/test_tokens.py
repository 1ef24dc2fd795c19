"""SentencePiece encoding, decoding and counting against the library itself."""

import numpy as np
import pytest
import sentencepiece
from conftest import SMALL

from kinweave.llm import registry, sentencepiece_codec, token_counts
from kinweave.llm.pieces import MODEL, UNIGRAM, Pieces

ODD = ["", " ", "  two  blanks ", "tab\tand\nline\n\n", "▁ literal", "日本語 テキスト", "a" * 70, "é" * 3000, "x \0 y", "😀 ok", "Don't!!! 3.14", "trailing \n"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def texts(spark):
    small = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    return small + [(10_000 + k, t) for k, t in enumerate(ODD)] + [(10_000, ""), (None, None), (1, None)]


def test_encoding_equals_the_library_and_decodes_back(spark, library, texts):
    df = spark.createDataFrame([(*r, "x") for r in texts], "doc_id long, text string, unit string")
    # A small table of relational units leaves some to the per-row encoder: both must agree with the library.
    for hot in (200, sentencepiece_codec.HOT):
        out = sentencepiece_codec.decode(sentencepiece_codec.encode(df, hot=hot))
        assert out.columns == ["doc_id", "text", "unit", "ids", "decoded"]
        rows = out.collect()
        assert len(rows) == len(texts)
        for r in rows:
            if r["text"] is None:
                assert r["ids"] is None and r["decoded"] is None
            else:
                assert r["ids"] == library.encode(r["text"]), r["text"][:80]
                assert r["decoded"] == r["text"].replace("▁", " ")


def test_counts_equal_the_library(spark, library, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for r in token_counts.with_counts(df).collect():
        assert r["n_tokens"] == (None if r["text"] is None else len(library.encode(r["text"])))


def test_unigram_counts_are_those_of_the_best_cut():
    model = Pieces(["<unk>", "▁", "a", "b", "ab", "ba", "aba", "▁ab"], [0, -2.0, -1.0, -1.0, -1.5, -1.5, -2.5, -3.0], [2, 1, 1, 1, 1, 1, 1, 1], UNIGRAM)
    for unit in ("▁abab", "▁ba", "abaaba", "▁▁b", "c", "▁acb"):
        assert model.count(unit) == sum(len(model.fallback(p)) if p not in model.ids else 1 for p in model.viterbi(unit))


def test_unigram_lattice_and_counts_equal_all_cuts(spark):
    """Viterbi in the relational lattice, in the counts and by trying every cut, on a table with ties."""
    names = ["<unk>", "▁", "a", "b", "c", "ab", "ba", "aba", "▁ab", "bc", "cab", "é"]
    model = Pieces(names, [0, -2.0, -1.0, -1.0, -1.25, -1.5, -1.5, -2.5, -3.0, -2.25, -2.0, -4.0], [2] + [1] * 11, UNIGRAM)
    rng = np.random.default_rng(6)
    texts = [" ".join("".join(rng.choice(list("abcé?"), rng.integers(1, 8))) for _ in range(3)) for _ in range(60)]
    unknown = np.float32(-4.0 - 10.0)

    def by_hand(unit):
        best = {0: (np.float32(0), ())}
        for end in range(1, len(unit) + 1):
            ways = []
            for start in range(end):
                piece = unit[start:end]
                if piece in model.ids:
                    ways.append((best[start][0] + np.float32(model.scores[model.ids[piece]]), end - start, best[start][1] + (model.ids[piece],)))
                elif end - start == 1:
                    ways.append((best[start][0] + unknown, 1, best[start][1] + tuple(model.fallback(piece))))
            top = max(w[:2] for w in ways)
            best[end] = next((w[0], w[2]) for w in ways if w[:2] == top)
        return list(best[len(unit)][1])

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = {r["doc_id"]: r for r in sentencepiece_codec.decode(sentencepiece_codec.encode(df, model=model), model=model).collect()}
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.with_counts(df, model=model).collect()}
    for k, text in enumerate(texts):
        want = [i for u in model.units(text) if u for i in by_hand(u)]
        assert coded[k]["ids"] == want and counts[k] == len(want), text
        if "?" not in text:
            assert coded[k]["decoded"] == text


def test_columns_named_like_the_results_are_replaced(spark, library):
    df = spark.createDataFrame([(1, "a text", "old", 7, 8)], "doc_id long, text string, IDS string, decoded int, n_tokens int")
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(df))
    assert sorted(c.lower() for c in out.columns) == ["decoded", "doc_id", "ids", "n_tokens", "text"]
    r = out.first()
    assert r["ids"] == library.encode("a text") and r["decoded"] == "a text" and r["n_tokens"] == 8
    counted = token_counts.with_counts(df)
    assert len(counted.columns) == 5 and counted.first()["n_tokens"] == len(r["ids"])


def test_ids_without_a_piece_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, [1, 10_000_000, -3, 3 + 0x41]), (2, [3 + 0xC3, 300])], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in sentencepiece_codec.decode(df).collect()}
    assert got[1] == "A" and "\ufffd" in got[2]


def test_a_very_long_text(spark, library):
    text = "many words of one long text " * 20_000 + "x" * 5_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = token_counts.with_counts(sentencepiece_codec.decode(sentencepiece_codec.encode(df))).first()
    assert r["n_tokens"] == len(r["ids"]) == len(library.encode(text)) and r["decoded"] == text


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sentencepiece_codec.encode(none).count() == token_counts.with_counts(none).count() == 0


def test_queries_agree(spark):
    counts = {r["doc_id"]: r["n_tokens"] for r in registry.queries()["op6_token_counts"](spark, SMALL).collect()}
    rows = registry.queries()["op3_sentencepiece"](spark, SMALL).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == counts and all(r["round_trip"] for r in rows)
