"""The exact join against all pairs of sets; what is compared is counted."""

import itertools
import random
from collections import Counter

import numpy as np

from skylark.llm import linking, ngram_join, shingles
from skylark.llm.queries import QUERIES
from test_operators import WORD, family


def plain_set(text, width=4):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def plain_groups(table, percent=85, width=4):
    """(id, set size, least id of the group); rows are told apart by their place."""
    sets = [plain_set(t, width) for _, t in table]
    root = list(range(len(table)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in itertools.combinations([i for i, s in enumerate(sets) if s], 2):
        a, b = sets[i], sets[j]
        if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and find(i) != find(j) and 100 * len(a & b) >= percent * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (ident, _) in enumerate(table):
        if ident is not None:
            least[find(i)] = min(ident, least.get(find(i), ident))
    return Counter((ident, len(s), least.get(find(i))) for i, ((ident, _), s) in enumerate(zip(table, sets)))


def groups(spark, table, **options):
    df = spark.createDataFrame([(*r, "x") for r in table], "doc_id long, text string, component_id string")
    return Counter(tuple(r) for r in ngram_join.similar_groups(df, **options).collect())


def test_documents(spark, sf_dir, rows, empty):
    got = Counter(tuple(r) for r in QUERIES["op13_ngram_join"](spark, sf_dir).collect())
    assert got == plain_groups([(i, t) for i, t, *_ in rows])
    assert ngram_join.similar_groups(empty).count() == 0
    assert groups(spark, [(1, None), (2, ""), (None, " ")]) == Counter({(1, 0, 1): 1, (2, 0, 2): 1, (None, 0, None): 1})


def test_families_chains_passages_and_small_sets(spark):
    rng = random.Random(6)
    texts = family(rng, 300, 5) + family(rng, 60, 9)
    words = ["c%d" % i for i in range(400)]
    texts += [" ".join(words[i : i + 150]) for i in range(0, 250, 6)]
    half = " ".join("h%d" % i for i in range(70))
    texts += [half + " " + " ".join("r%d" % rng.randint(0, 10**6) for _ in range(9 + i % 12)) for i in range(60)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(80)]
    texts += ["x " * 40, "x x x x", "x x x x x"]
    rng.shuffle(texts)
    table = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(3, texts[10]), (None, texts[11])]
    assert groups(spark, table) == plain_groups(table)
    assert groups(spark, table, width=3, percent=70) == plain_groups(table, 70, 3)


def compared(spark, texts, monkeypatch):
    """How many pairs reach the full sets."""
    seen = []
    real = ngram_join.confirmed
    monkeypatch.setattr(ngram_join, "confirmed", lambda pairs, *rest: (seen.append(pairs.count()), real(pairs, *rest))[1])
    ngram_join.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    monkeypatch.setattr(ngram_join, "confirmed", real)
    return sum(seen)


def test_pairs_do_not_grow_with_the_square(spark, monkeypatch):
    rng = random.Random(7)
    base = family(rng, 1, 0)[0].split()
    near = lambda n, k: [" ".join(f"e{rng.randrange(10**9)}" if i in spots else w for i, w in enumerate(base)) for spots in (set(rng.sample(range(120), k)) for _ in range(n))]
    for k in (3, 8):  # around one text: linked to it but hardly among each other (3), or with none (8)
        small, large = (compared(spark, [" ".join(base), *near(n, k)], monkeypatch) for n in (60, 120))
        assert large <= 2.6 * small + 20 and large <= 260
    passage = [" ".join([*base[:70], *[f"p{rng.randrange(10**9)}" for _ in range(30)]]) for _ in range(120)]
    assert compared(spark, passage, monkeypatch) <= 20


def test_shingle_hashes():
    thue = lambda n: "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    a = thue(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    assert not np.intersect1d(shingles.shingle_set(a), shingles.shingle_set(b)).size
    assert not np.intersect1d(shingles.shingle_set("a b c d e"), shingles.shingle_set("e d c b a")).size
    assert len(shingles.shingle_set("A b\tC", 5)) == 1 and shingles.shingle_set("a B c") == shingles.shingle_set("A b\n c")
    assert shingles.prefix_length(20, 85) == 4 and shingles.prefix_length(1, 85) == 1
    levels = np.full(90, 70, np.uint8)
    assert shingles.match_count(levels, 8, 100) > 1 and shingles.match_count(np.array([7, 7, 7], np.uint8), 3, 5) == 1
    assert linking.token_set(np.arange(3, dtype="<u8").tobytes()).tolist() == [0, 1, 2]
