"""Operators on documents against brute force, libraries and DuckDB, with nulls, empty texts, repeats and clashing columns."""

import hashlib
import os
import random
import re
from collections import Counter as Tally

import duckdb
import numpy as np
import pytest

from genoflux.llm import op03, op04, op08, op09

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORD, ALNUM_WORD = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, sig string, size string"


def made(seed=1, n=70):
    """Texts of all awkward kinds; ids repeat once and are null once."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)] + ["Été", "naïve", "ß", "the", "of", "|", "###"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 6, 30, 60, 120]))) for _ in range(n // 3)]
    hot = " ".join(rng.choice(vocab) for _ in range(80))
    texts = base + [None, "", " \n\t", "one", "Two words", "a b c d e", "A B C D E", "token = \"0123456789abcdef0123456789abcdef01234567\" x"]
    for t in base[:8]:
        texts += [t, t.upper()]
    for i in range(25):
        w = hot.split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 9)}"
        texts.append(" ".join(w))
    texts.append(" ".join(rng.choice(vocab) for _ in range(30_000)))
    rng.shuffle(texts)
    rows = [(i, t, rng.choice(["en", "fr", None]), "s", 1, 5, "x", "y") for i, t in enumerate(texts)]
    return rows + [rows[3], (None, hot, "en", "s", 1, 5, "x", "y")]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sets_of(text):
    w = SPACE_WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard_components(docs, rows, none):
    from genoflux.llm.ngram_join import jaccard_components

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
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = sorted((repr(r[0]), len(sets[i]), repr(least.get(find(i)) if sets[i] else r[0])) for i, r in enumerate(rows))
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in jaccard_components(docs).collect())
    assert got == want
    assert jaccard_components(none).count() == 0


def test_signatures_of_linked_sets_meet():
    """Random sets at and around the threshold, random classes: a linked pair always shares a signature."""
    import numpy as np
    from fractions import Fraction

    from genoflux.llm.ngram_join import signatures

    rng = np.random.default_rng(2)
    linked = 0
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        both = rng.choice(1 << 40, n, replace=False).astype(np.uint64)
        a = np.sort(np.concatenate([both, rng.choice(1 << 40, int(rng.integers(0, n // 4 + 2))).astype(np.uint64)]))
        b = np.sort(np.concatenate([both, rng.choice(1 << 40, int(rng.integers(0, n // 4 + 2))).astype(np.uint64)]))
        a, b = np.unique(a), np.unique(b)
        inter = len(np.intersect1d(a, b))
        if 5 * inter < 4 * (len(a) + len(b) - inter) or np.array_equal(a, b):
            continue
        linked += 1
        share = rng.random()
        kind = {x: (1 if rng.random() < share else 2) for x in both.tolist()}
        k = lambda s: np.array([kind.get(x, int(rng.integers(0, 2))) for x in s.tolist()])
        (sa, ma), (sb, mb) = signatures(a, k(a), Fraction("0.8")), signatures(b, k(b), Fraction("0.8"))
        met = [(i, j) for i, x in enumerate(sa.tolist()) for j, y in enumerate(sb.tolist()) if x == y]
        assert met
        assert any(9 * min(ma[i], mb[j]) >= 4 * (len(a) + len(b)) for i, j in met)
    assert linked > 500


def test_decontamination(docs, rows, none, spark):
    from genoflux.llm.decontaminate import contaminated_words, contamination_digest

    rng = random.Random(5)
    long = max((r[1] for r in rows if r[1]), key=len).split()
    items = [(1, " ".join(long[100:125])), (2, "Two, WORDS!"), (3, None), (4, ""), (5, "one"), (6, " ".join(long[110:119])), (6, " ".join(long[110:119])), (7, " ".join(rng.choice(long) for _ in range(12)))]
    want = []
    for r in rows:
        w = ALNUM_WORD.findall((r[1] or "").translate(LOWER))
        hit, found = set(), set()
        for item, text in items:
            v = ALNUM_WORD.findall((text or "").translate(LOWER))
            for s in range(max(1, len(v) - 9)) if v else ():
                win = v[s : s + 10]
                for i in range(len(w) - len(win) + 1):
                    if w[i : i + len(win)] == win:
                        hit |= set(range(i, i + len(win)))
                        found.add(str(item))
        want.append((repr(r[0]), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    table = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((repr(r[0]), *r[1:]) for r in contamination_digest(docs, table).collect()) == sorted(want)
    blocks = contaminated_words(docs.select("doc_id", "text"), table, block=4).select("doc_id", "n_hit").collect()
    assert sorted((repr(a), b) for a, b in blocks) == sorted((w[0], w[2]) for w in want)
    assert contamination_digest(docs, none.selectExpr("doc_id as item_id", "text")).where("contaminated").count() == 0
    assert contamination_digest(none, table).count() == 0


def test_token_counts(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    from genoflux.llm.token_counts import Counter, token_counts, truncate_to_budget

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    size = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    want = sorted((repr(r[0]), len((r[1] or "").encode()), size(r[1] or "")) for r in rows)
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(docs, path, 1024).collect()) == want
    assert token_counts(none, path, 1).count() == 0
    c = Counter(open(path, "rb").read())
    rng = random.Random(4)
    for _ in range(150):
        s = "".join(rng.choice("ab 's'll\n\t  12.,é▁🙂中  \x1cTHE the") for _ in range(rng.randint(0, 40)))
        assert c.count(s) == size(s)
        assert c.prefix_counts(s).tolist() == [size(s[:i]) for i in range(len(s) + 1)]
    assert c.count("<|endoftext|>a <|endoftext|>") == size("<|endoftext|>a <|endoftext|>")
    words = ["hello", "world", "it's", "we'll", "  ", "\n", "\n\n", " ", "1234", "日本語", "...", "\t", "<|endoftext|>", "'"]
    for k in range(200):
        s = (" " if k % 2 else "").join(rng.choice(words) for _ in range(rng.randrange(14)))
        inside = {i for m in re.finditer(r"<\|endoftext\|>", s) for i in range(m.start() + 1, m.end())}
        for budget in (0, 1, 3, 7, 100):
            assert c.fitting(s, budget) == max(i for i in range(len(s) + 1) if i not in inside and size(s[:i]) <= budget)
    for r in token_counts(docs, path, 20).where("doc_id is not null").select("n_tokens", "over_limit", "kept_chars", "n_bytes").collect():
        assert r.over_limit == (r.n_tokens > 20) and (r.kept_chars < r.n_bytes if r.over_limit else r.kept_chars <= r.n_bytes)
    for r in truncate_to_budget(docs.where("doc_id < 20"), path, 20).collect():
        text = dict((x[0], x[1]) for x in rows)[r.doc_id] or ""
        assert text.startswith(r.kept_text) and size(r.kept_text) <= 20
        assert r.kept_chars == len(text) or size(text[: r.kept_chars + 1]) > 20


def test_units_counted_together(monkeypatch):
    """The new units of some texts are counted by the table, as the library counts them; no short one is counted alone."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from genoflux.llm import token_counts as M

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, rng = Tokenizer.from_file(path), random.Random(6)
    size = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    bits = ["the", "Straße", "日本語", "don't", "'s", "x" * 40, "ing", "12,345", "#$%", "\x00", "é", "😀", "aaaa", "tion", "ab", "=-", "<|endoftext|>", "\x1c", "\u2060", "\t"]
    some = ["".join(rng.choice(bits[: 16 if k % 3 else 20]) + rng.choice(["", "", " ", "\n", " "]) for _ in range(rng.randrange(40))) for k in range(300)] + [None, "", " ", "\n"]
    for kept, at_once in ((M.KEPT, M.AT_ONCE), (50, 7)):
        monkeypatch.setattr(M, "KEPT", kept)
        monkeypatch.setattr(M, "AT_ONCE", at_once)
        c = M.Counter(open(path, "rb").read())
        assert c.table.ordered
        for i in range(0, len(some), 40):
            c.learn(some[i : i + 40])
            assert [c.count(s or "") for s in some[i : i + 40]] == [size(s or "") for s in some[i : i + 40]]
    c = M.Counter(open(path, "rb").read())
    monkeypatch.setattr(c, "_piece", lambda p: pytest.fail(f"{p!r} was counted alone"))
    new = "unheard words, inventionists\nthere don't recur"
    c.learn([new, None])
    assert c.count(new) == size(new)
    e, ids = c.encoder, list(c.encoder.halves)
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(3000)]
    for piece in list(c.kept) + [e.pieces[i] for i in rng.sample(ids, 2000)]:  # pairs that are met when pieces are built
        s = piece.encode().decode("latin-1") if piece in c.kept else piece
        parts = e.merged(s[: rng.randint(1, len(s))]) + e.merged(s[-2:])
        pairs += [(e.pieces.index(x), e.pieces.index(y)) for x, y in list(zip(parts, parts[1:]))[-1:]]
    ok = c.table.compatible(np.array([a << 20 | b for a, b in pairs]))
    assert ok.tolist() == [e.merged(e.pieces[a] + e.pieces[b]) == [e.pieces[a], e.pieces[b]] for a, b in pairs]
    assert 0 < ok.sum() < len(pairs)


def test_sentencepiece(docs, rows, none):
    import public_tokenizers
    import sentencepiece

    from genoflux.llm.sentencepiece_codec import Codec, encode, round_trip_digests

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in rows:
        ids = sp.encode(r[1] or "")
        want.append((repr(r[0]), len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    assert sorted((repr(r[0]), *r[1:]) for r in round_trip_digests(docs, path).collect()) == sorted(want)
    assert round_trip_digests(none, path).count() == 0
    codec, rng = Codec(open(path, "rb").read()), random.Random(9)
    for _ in range(1500):
        s = "".join(rng.choice("ab  the\n\t é▁🙂中ß|#1") for _ in range(rng.randint(0, 30)))
        ids = sp.encode(s)
        assert codec.encode(s) == ids and codec.both(s)[1] == sp.decode(ids) == codec.decode(ids)
    assert encode(docs.where("doc_id = 1"), path).first().ids is not None


def test_quality_rules(docs, rows, none):
    from genoflux.llm.quality_rules import RULES, base_columns, cascade, measured_order, quality_verdicts

    want = []
    for r in rows:
        t = r[1] or ""
        w = SPACE_WORD.findall(t)
        lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Tally(grams)
        rep = len({j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)})
        want.append((repr(r[0]), len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    got = quality_verdicts(docs).collect()
    assert sorted((repr(r[0]), *r[1:7]) for r in got) == sorted(want)
    assert not any(r.kept for r in got if r.base_failed) and any(r.kept for r in got)
    assert quality_verdicts(none).count() == 0
    order = measured_order(base_columns(docs.select("doc_id", "text")))
    assert {r.name for r, _, _ in order} == {r.name for r in RULES}
    base = base_columns(docs.select("doc_id", "text"))
    flags = [sorted(map(repr, base.select("doc_id", cascade(o).isNull().alias("k")).collect())) for o in (list(RULES), list(RULES)[::-1])]
    assert flags[0] == flags[1]


@pytest.mark.parametrize("module", [op03, op04, op08, op09])
def test_query_matches_sql(spark, module):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    name = next(x for x in vars(module) if re.match(r"op\d+_", x))
    got = getattr(module, name)(spark, SF)
    want = con.execute(module.SQL)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
