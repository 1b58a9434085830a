"""Alignment of two tokenizations against a plain restatement, token by token."""

import hashlib
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skylark.llm import token_alignment
from skylark.llm.queries import QUERIES, TOKENIZERS

BYTES, PIECES = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"



@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}

    def tokens(text):
        if not text:
            return [], []
        whole = (" " + text).encode()
        left = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else ([], [])

    def spans(tokens_):
        out, at = [], 0
        for i, x in tokens_:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    def align(text):
        left, right = map(spans, tokens(text))
        links = []
        j = 0
        for i, s, e in left:
            while j < len(right) and right[j][2] <= s:
                j += 1
            k = j
            while k < len(right) and right[k][1] < e:
                links.append((i, right[k][0]))
                k += 1
        cuts = sorted({e for *_, e in left} & {e for *_, e in right})
        groups, last = [], 0
        for c in cuts:
            inside = lambda side: ",".join(str(i) for i, s, e in side if last <= s and e <= c)  # noqa: B023, E731
            groups.append(inside(left) + "|" + inside(right))
            last = c
        return len(left), len(right), groups, links

    return align


def wanted(plain, table):
    aligned = [plain(t) for _, t in table]
    counts = Counter(p for *_, links in aligned for p in set(links))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for (i, _), (n_a, n_b, groups, links) in zip(table, aligned):
        best = sum(counts[p] == most[p[0]] for p in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, n_a, n_b, len(groups), len(links), best, sum(counts[p] for p in links), digest))
    return Counter(out)


ODD = ["", None, " ", "  ", "a  b", " lead", "trail ", "x\n  y\n\n z\t\tw", "don't we'll I'd", "<s> </s> <|endoftext|> <unk> <0x41>", "▁ mark", "中文字符 没有空格", "😀😀 ünï cödé ǆ", "a b  c", "\x00\x01 nul", "ﬁne Ⅷ", "word\r\nword", "1234567 89,012.5", "the the the THE", "é é", "\x1c\x1d a \x85 b"]


def test_alignment_of_the_documents(spark, sf_dir, rows, plain):
    got = QUERIES["op11_token_alignment"](spark, sf_dir).collect()
    assert Counter(tuple(r) for r in got) == wanted(plain, [(i, t) for i, t, *_ in rows])


def test_odd_texts_long_words_and_bundles(spark, plain, monkeypatch):
    rng = random.Random(2)
    long_word = "".join(rng.choice("abcdeé中") for _ in range(3000))
    table = list(enumerate([*ODD, long_word, "q" * 2000, " ".join(long_word[i : i + 70] for i in range(0, 3000, 70)), "words " * 3000]))
    table += [(7, "the the the THE"), (None, "the cat")]
    monkeypatch.setattr(token_alignment, "BUNDLE", 500)
    monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", 10)
    df = spark.createDataFrame(table, "doc_id long, text string").withColumns({"links": F.lit("x"), "n_a": F.lit(1)})
    got = token_alignment.alignment_digests(df, BYTES, PIECES).collect()
    assert Counter(tuple(r) for r in got) == wanted(plain, table)
    full = token_alignment.alignments(df, BYTES, PIECES).collect()
    want = Counter((i, n_a, n_b, ";".join(groups), tuple(links)) for (i, t) in table for n_a, n_b, groups, links in [plain(t)])
    assert Counter((r.doc_id, r.n_a, r.n_b, r.groups, tuple((x.a, x.b) for x in r.links)) for r in full) == want
    assert token_alignment.alignment_digests(df.limit(0), BYTES, PIECES).count() == 0


def test_plain_chunks_are_encoded_together(monkeypatch):
    with open(BYTES, "rb") as f, open(PIECES, "rb") as g:
        kinds = token_alignment._byte_level(f.read()), token_alignment._pieces(g.read())
    chunks = sorted({c for text in [*ODD, "q" * 2000, " ".join(f"w{i}x don't{i} é{i}" for i in range(900))] if text for c in token_alignment._chunks(text)})
    plain, odd = [c for c in chunks if token_alignment._plain(c)], [c for c in chunks if not token_alignment._plain(c)]
    assert odd and any("\u2581" in c for c in plain)
    for kind in kinds:
        calls, real = [], kind.encode
        monkeypatch.setattr(kind, "encode", lambda texts: (calls.extend(texts), real(texts))[1])  # noqa: B023
        ids, counts = kind.of(plain, odd)
        assert len(calls) < len(chunks) / 2
        alone = kind._single([*plain, *odd])[0]
        assert ids.tolist() == alone[0].tolist() and counts.tolist() == alone[1].tolist()


def test_python_only_tokenises(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = token_alignment.alignments(docs, BYTES, PIECES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_chunks_are_aligned_at_once(spark, sf_dir):
    rng = random.Random(5)
    kinds = [SimpleNamespace(lengths=np.arange(1, 9)) for _ in range(2)]
    sides, want = [[], []], []
    for _ in range(300):
        left = [rng.randrange(8) for _ in range(rng.randint(1, 6))]
        right, rest = [], sum(left) + len(left)
        while rest:
            right.append(rng.randrange(min(8, rest)))
            rest -= right[-1] + 1
        a, b = ([(i, sum(ids[:k]) + k, sum(ids[: k + 1]) + k + 1) for k, i in enumerate(ids)] for ids in (left, right))
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        inside = lambda side, s, e: ",".join(str(i) for i, x, y in side if s <= x and y <= e)
        groups = ";".join(inside(a, s, e) + "|" + inside(b, s, e) for s, e in zip([0, *cuts], cuts))
        want.append(({"groups": groups, "links": [(i << 32) + j for i, s, e in a for j, x, y in b if x < e and s < y]}, len(cuts)))
        sides[0].append(left)
        sides[1].append(right)
    ids = [np.concatenate([np.array(x, np.int32) for x in side]) for side in sides]
    aligned, n_groups = token_alignment._aligned(ids, [np.array([len(x) for x in side]) for side in sides], kinds)
    assert list(zip(aligned.to_pylist(), n_groups.tolist())) == want
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = token_alignment.alignments(docs, BYTES, PIECES)._jdf.queryExecution().executedPlan().toString()
    assert not any(f in plan for f in ("array_intersect", "zip_with", "array_position"))  # no interpreted function runs token by token
