"""The corpus pipeline against a plain restatement of its stages."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from skylark.llm import piece_lattice
from skylark.llm.queries import TOKENIZERS

from test_operators import WORD, every_segmentation, plain_groups, plain_measures


def test_pipeline(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, sf_dir)
    assert kept.columns == corpus_pipeline.COLUMNS
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    assert all(not plain_measures(t)[-1] for _, t in left) and left <= Counter((i, t) for i, t, *_ in rows)

    once = stages["near-dedup"](spark, kept, sf_dir)
    groups = plain_groups([(i, t) for i, t in left if i is not None], 80)
    heads = {i for i, _, _, head in groups if head}
    assert Counter(r.doc_id for r in once.collect()) == Counter(heads) + Counter([i for i, _ in left if i is None])

    private = stages["PII"](spark, once, sf_dir)
    before, after = {r.doc_id: r.text for r in once.collect()}, private.collect()
    secret = re.compile(r"ann\.lee42@mail1\.example\.com|4785380592391139|152\.143\.123\.131")
    assert len(after) == len(before) and not any(secret.search(r.text) for r in after)
    assert all(r.text == before[r.doc_id] for r in after if not secret.search(before[r.doc_id])) and all(r.n_chars == len(r.text) for r in after)

    mixed = stages["mixing"](spark, private, sf_dir).collect()
    size = lambda t: len(WORD.findall(t))
    sums, taken = defaultdict(int), defaultdict(int)
    for r in after:
        sums[r.source] += size(r.text)
    for r in mixed:
        taken[r.source] += size(r.text)
    assert all(taken[s] <= 2 * sums[s] for s in sums) and max(Counter(r.doc_id for r in mixed).values()) <= 2
    assert abs(sum(taken.values()) - 1.5 * sum(sums.values())) <= sum(max(size(r.text) for r in after if r.source == s) for s in sums)

    encoded = corpus_pipeline.run(spark, sf_dir).collect()
    with open(f"{TOKENIZERS}/piece_bpe_32k.model", "rb") as f:
        pieces = piece_lattice.Pieces(f.read())
    assert Counter((r.doc_id, piece_lattice.decode(pieces, r.ids)) for r in encoded) == Counter((r.doc_id, r.text) for r in mixed)
    several = [list(piece_lattice.encode_batch(pieces, [r.text], 4))[0] for r in mixed]
    whole = Counter((r.doc_id, tuple(tuple(ids.tolist()) for _, ids in paths)) for r, paths in zip(mixed, several))
    assert whole == Counter((r.doc_id, (tuple(r.ids), *map(tuple, r.others))) for r in encoded) and any(len(r.others) == 3 for r in encoded)


def test_encoding_lists_the_best_segmentations(spark):
    """The pipeline's encoding gives the four best of each text, in the order of their scores, against all segmentations; one only where there are no more."""
    with open(f"{TOKENIZERS}/piece_bpe_32k.model", "rb") as f:
        pieces = piece_lattice.Pieces(f.read())
    texts = ["the fox", "aaaa", "中", "a b", "", None]
    got = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["encoding"](spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect()}
    for i, t in enumerate(texts):
        known = sorted(every_segmentation(pieces, t), key=lambda p: -p[0]) if t else [(0, ())]
        lists = [tuple(got[i].ids), *map(tuple, got[i].others)]
        assert [dict((ids, s) for s, ids in known)[x] for x in lists] == [s for s, _ in known[:4]] and len(set(lists)) == len(lists)
