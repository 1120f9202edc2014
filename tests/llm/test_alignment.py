"""op12: against both libraries and a plain enumeration of groups and links."""

import collections
import hashlib
import random

import numpy as np
import pytest

import public_tokenizers

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, digest) by the contract, a text at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(shown)))}
    held, out = [], []
    for text in texts:
        groups = []
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ta = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
            tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            if b"".join(ta) == b"".join(tb) == (" " + text).encode():
                ends = [set(np.cumsum([len(x) for x in t]).tolist()) for t in (ta, tb)]
                groups, at = [([], []) for _ in ends[0] & ends[1]], sorted(ends[0] & ends[1])
                for k, (ids, tokens) in enumerate(((ia, ta), (ib, tb))):
                    end, g = 0, 0
                    for i, t in zip(ids, tokens):
                        end += len(t)
                        while end > at[g]:
                            g += 1
                        groups[g][k].append(i)
        links = collections.Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.append(links)
        digest = hashlib.sha256(";".join("|".join(",".join(map(str, s)) for s in g) for g in groups).encode()).hexdigest() if groups else ""
        out.append([sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()), digest])
    count = collections.Counter(p for links in held for p in links)
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for row, links in zip(out, held):
        row += [sum(k for p, k in links.items() if count[p] == best[p[0]]), sum(k * count[p] for p, k in links.items())]
    return [tuple(r) for r in out]


def texts(n=120):
    rng = random.Random(8)
    bits = ["the", " of", "Straße", "日本語", "  ", "\n", "\n\n", "\t", "▁", "<|endoftext|>", "</s>", "<0x41>", "é", "'s", "don't", "123456", "\x00", "\x1c", "\x85", "​", " ", "😀", "x" * 40, "ing", "#$%", " a"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(n)] + [None, "", " ", "\n", "a", "plain words here", "plain words here", "ab" * 4000, "日本" * 900, "-=" * 3000 + " tail"]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def test_scores_against_both_libraries(spark):
    from genoflux.llm.alignment import linked_scores

    rows = list(enumerate(texts()))
    got = linked_scores(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string"), A_PATH, B_PATH)
    assert got.columns == ["doc_id", *COLUMNS]
    assert [tuple(r)[1:] for r in sorted(got.collect())] == brute([t for _, t in rows])


def test_counts_that_are_joined(spark):
    """With room for few pairs in the broadcast table the rest is joined; ids that are null or repeat stay apart."""
    from genoflux.llm.alignment import aligned, pair_counts, scored
    from genoflux.llm.common import Scratch

    some = texts(60)
    docs = spark.createDataFrame([(None if i % 5 == 0 else i % 7, t) for i, t in enumerate(some)], "doc_id long, text string").repartition(3)
    scratch = Scratch(spark)
    links = scratch.write(aligned(docs, A_PATH, B_PATH))
    counts = scratch.write(pair_counts(links))
    want = sorted(brute(some))
    for most in (0, 20, 1 << 20):
        assert sorted(tuple(r)[1:] for r in scored(links, counts, 32000, scratch, most).collect()) == want


def test_query_on_shipped_documents(spark):
    from genoflux.llm.op12 import op12_alignment

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in op12_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert got == dict(zip((r.doc_id for r in docs), brute([r.text for r in docs])))


def test_empty_table(spark):
    from genoflux.llm.alignment import linked_scores

    assert linked_scores(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).collect() == []


def test_large_groups_by_distinct_ids(monkeypatch):
    """Groups above the bound give the same pairs as enumerated ones, and groups are where a start reaches the running end."""
    from genoflux.llm import alignment as M

    rng = random.Random(1)
    a, b = M.ByteLevel(open(A_PATH, "rb").read()), M.Pieces(open(B_PATH, "rb").read())
    some = texts(40) + ["".join(rng.choice("ab") for _ in range(3000))]
    plain = M.Aligned(a, b, some).pairs()
    monkeypatch.setattr(M, "PLAIN_GROUP", 1)
    monkeypatch.setattr(M, "PAIRS", 50)
    split = M.Aligned(a, b, some).pairs()
    assert all(np.array_equal(x, y) for x, y in zip(plain, split)) and len(plain[0]) > 500
    group = M.coalesced(np.array([0, 2, 5]), np.array([2, 5, 9]), np.array([0, 3, 5]), np.array([3, 5, 9]))
    assert group.tolist() == [0, 0, 1, 0, 0, 1]


def test_units_that_a_worker_lets_go(monkeypatch):
    from genoflux.llm import alignment as M

    a = M.ByteLevel(open(A_PATH, "rb").read())
    some = [t for t in texts(200) if t]
    whole = a.encode(some)
    monkeypatch.setattr(M, "KEPT", 30)
    for i in range(0, len(some), 7):
        ids, n = a.encode(some[i : i + 7])
        assert np.array_equal(n, whole[1][i : i + 7]) and np.array_equal(ids, whole[0][whole[1][:i].sum() : whole[1][: i + 7].sum()])
    assert len(a.kept) < 300


def test_units_are_aligned_once(monkeypatch):
    """Texts put together from kept units are as texts aligned whole, and no library sees a kept unit again."""
    from genoflux.llm import alignment as M

    a, b = M.ByteLevel(open(A_PATH, "rb").read()), M.Pieces(open(B_PATH, "rb").read())
    rng = random.Random(5)
    words = ["the", "Straße", "日本語", "don't", "x" * 40, "<|endoftext|>", "</s>", "<0x41>", "😀", "12,345", "#$%", "ab" * 900, "\x00", "é", "'s"]
    plain = ["".join(rng.choice(words) + rng.choice("  \n") for _ in range(rng.randrange(30))) + rng.choice(words) for _ in range(60)]
    some = texts(80) + plain
    for kept in (M.KEPT, 20):
        monkeypatch.setattr(M, "KEPT", kept)
        units = M.Units(a, b)
        for i in range(0, len(some), 9):
            part = some[i : i + 9]
            whole = M.Aligned(a, b, part)
            counts, digests, pairs = units.aligned(part)
            assert counts.tolist() == [list(r) for r in zip(*(getattr(whole, c).tolist() for c in M.COUNTS))]
            assert digests == whole.digests() and all(np.array_equal(x, y) for x, y in zip(pairs, whole.pairs()))
    monkeypatch.setattr(M, "KEPT", 1000)
    units = M.Units(a, b)
    first = units.aligned(plain)
    for side in ("encode", "alone"):
        for x in (a, b):
            monkeypatch.setattr(x, side, lambda *_: pytest.fail("a kept unit was encoded again"))
    again = units.aligned(plain[::-1])
    assert again[1] == first[1][::-1]
