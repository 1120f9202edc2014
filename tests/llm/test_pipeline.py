"""The pipeline's stages against brute force, on rows of all awkward kinds."""

import random
import re

import pytest

import corpus_pipeline as P
from tests.llm.test_text_operators import ALNUM_WORD, LOWER, sets_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _survivors(rows):
    """Rows that near_duplicates keeps: of each group of linked texts one with the least doc_id (null last); which of the rows that
    share that id it is, is left open. Also the rows of each group."""
    sets = [sets_of(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    loose = [rows[i] for i in range(len(rows)) if not sets[i]]
    return loose, [[rows[i] for i in g] for g in groups.values() if sets[g[0]]]


def _checked(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in P.near_duplicates(spark, docs, "").collect()]
    loose, groups = _survivors(rows)
    left = list(got)
    for r in loose:
        left.remove(r)
    order = lambda i: (i is None, i or 0)
    for g in groups:
        least = min((r[0] for r in g), key=order)
        mine = [r for r in left if r in g]
        assert len(mine) == 1 and mine[0][0] == least
        left.remove(mine[0])
    assert not left
    return got


def test_texts_that_share_an_id(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(20))
    a, b, c, d = (text() for _ in range(4))
    row = lambda i, t: (i, t, "en", "s", 1)
    got = _checked(spark, [row(1, a), row(2, b), row(2, c), row(3, a), row(3, d)])
    assert {r[1] for r in got} == {a, b, c, d} and len(got) == 4
    # repeated rows, ids that are null, texts without words, a long text and its copy
    long = " ".join(text() for _ in range(3000))
    rows = [row(1, a), row(1, a), (1, a, "fr", "s", 1), row(None, b), row(None, b), row(None, None), row(7, None), row(7, None), row(8, ""), row(9, long), row(5, long + " x"), row(None, d), (4, d, None, None, None)]
    got = _checked(spark, rows)
    assert {r[0] for r in got if r[1] and r[1].startswith(long)} == {5}
    assert P.near_duplicates(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_links_through_a_row_without_id(spark):
    from genoflux.llm.ngram_join import jaccard_components

    words = [f"w{i}" for i in range(104)]
    texts = [" ".join(words[k : k + 100]) for k in (0, 2, 4)]  # neighbours share 94 of 98 shingles
    far = " ".join([f"x{i}" for i in range(11)] + words[11:100])
    for ids in ((1, None, 3), (1, 2, 3)):
        df = spark.createDataFrame([(ids[0], texts[0]), (ids[1], texts[1]), (ids[2], texts[2]), (9, far)], "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in jaccard_components(df, 5, "0.92").collect()}
        assert got == {ids[0]: 1, ids[1]: 1, ids[2]: 1, 9: 9}


@pytest.mark.parametrize("empty", [False, True])
def test_all_stages(spark, tmp_path, empty):
    rng = random.Random(8)
    kinds = {"en": "the of and ing tion er th", "fr": "é è que eau oi aux ment"}
    text = lambda k, n: " ".join("".join(rng.choice(kinds[k].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))
    item = " ".join(f"item{i}" for i in range(25))
    rows = [] if empty else [(i, text(k, rng.randint(8, 60)), k, "s", 1) for i, k in enumerate(["en", "fr"] * 25)]
    if not empty:
        rows += [(None, text("en", 40), "en", None, None), (70, text("en", 30) + " " + item, None, "s", 1), (71, None, "en", "s", 0), (72, "½ ² ①", "en", "s", 5), (73, text("fr", 20_000) + " token=9f8e7d6c5b4a39281706f5e4d3c2b1a0 end", "fr", "s", 1), (3, text("en", 25), "en", "s", 1), rows[4]]
    d = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([] if empty else [(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(P.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, d).write.parquet(f"{d}/{i}")
        docs = spark.read.parquet(f"{d}/{i}")
        seen[name] = before, [tuple(r) for r in docs.collect()]
    if empty:
        assert not any(after for _, after in seen.values())
        return
    before, after = seen["language_id"]
    assert {r[1] for r in before} - {r[1] for r in after} <= {None, "½ ² ①"} and all(r[2] for r in after)
    before, after = seen["near_duplicates"]
    loose, groups = _survivors(before)
    assert len(after) == len(loose) + len(groups)
    before, after = seen["decontamination"]
    windows = {tuple(item.split()[i : i + 10]) for i in range(16)}
    hit = lambda t: any(tuple(w[i : i + 10]) in windows for w in [ALNUM_WORD.findall(t.translate(LOWER))] for i in range(len(w)))
    assert sorted(map(repr, after)) == sorted(repr(r) for r in before if not hit(r[1]))
    before, after = seen["secret_scan"]
    assert [r[0] for r in sorted(after, key=repr)] and len(after) == len(before) and all(r[4] == len(r[1]) for r in after)
    changed = {r[1] for r in before} - {r[1] for r in after}
    assert len(changed) == 1 and "token=9f8e" in changed.pop() and sum("token=[SECRET] end" in r[1] for r in after) == 1
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    before, _ = seen["sentencepiece"]
    got = sorted((repr(r.doc_id), list(r.ids), r.n_tokens, r.decoded) for r in docs.select("doc_id", "ids", "n_tokens", "decoded").collect())
    assert got == sorted((repr(r[0]), sp.encode(r[1]), len(sp.encode(r[1])), sp.decode(sp.encode(r[1]))) for r in before)
    assert re.match(r"\d", "1") and docs.columns == ["doc_id", "ids", "n_tokens", "decoded"]
