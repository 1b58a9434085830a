"""Texts on which a pattern with an unbounded repeated group would overflow the stack."""

from pyspark.sql import functions as F

from skylark.llm import surrogates


def test_surrogates_of_very_long_texts(spark):
    texts = ["x@" + "a." * 100_000, "x@" + "a." * 2000 + "com", "a" * 300_000, "1 " * 100_000, "a:" * 100_000, "Mr. " * 50_000, "=" * 200_000, "mail ann.lee42@mail1.example.com " + "- " * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r.i: r for r in surrogates.replace_entities(df, key="k").collect()}
    assert len(got) == len(texts) and all(got[i].text == t for i, t in enumerate(texts[:1]))
    assert "ann.lee42" not in got[7].text and got[7].text.endswith("- " * 100) and got[7].n_entities == 1
    assert all(got[i].text == texts[i] and got[i].n_entities == 0 for i in (2, 3, 4, 6))
    assert surrogates.replace_entities(df.filter(F.lit(False)), key="k").count() == 0


def test_the_single_best_path_is_searched_by_astar(monkeypatch):
    """encode (n = 1) takes each distinct segment's path from backward A-star; it is the one of the lists of several."""
    from skylark.llm import piece_lattice
    from skylark.llm.queries import TOKENIZERS

    with open(f"{TOKENIZERS}/piece_bpe_32k.model", "rb") as f:
        pieces = piece_lattice.Pieces(f.read())
    texts = ["the quick fox, the slow fox", "ab" * 200 + " 中文😀", "", None]
    several = [paths[0] for paths in piece_lattice.encode_batch(pieces, texts, 3)]
    calls, search = [], piece_lattice.backward_astar
    monkeypatch.setattr(piece_lattice, "backward_astar", lambda *a: calls.append(a[0]) or search(*a))
    single = [paths[0] for paths in piece_lattice.encode_batch(pieces, texts, 1)]
    assert [(s, ids.tolist()) for s, ids in single] == [(s, ids.tolist()) for s, ids in several]
    assert len(calls) == len({x for t in texts if t for x in pieces.segment.findall("▁" + t.replace(" ", "▁"))})
