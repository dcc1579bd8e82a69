"""Operators against brute force, round trips and held-out accuracy, on documents with nulls, ties and odd columns."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from quillon.llm import components, decontaminate, langid, licenses, lm, media, passages, pieces, quality, simhash, tokenfile
from quillon.llm.common import maybe_in, scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, component long, doc long"


def make(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    words = {x: ["".join(rng.choice(s) for _ in range(rng.randint(2, 7))) for _ in range(150)] for x, s in (("en", "thaerion"), ("fr", "éàouleç"))}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    shared = say("en", 70)
    out = [(i, say(lang, rng.randint(5, 220)), lang) for i, lang in enumerate(["en", "fr"] * 30)]
    out += [(60, out[0][1], "en"), (61, out[4][1], None), (62, None, "en"), (63, "", "fr"), (64, "123 456", "en"), (65, say("en", 30) + "\n" + shared + " " + say("en", 40), "en"), (66, shared.upper() + " " + say("en", 20), "en"), (67, say("en", 10) + " " + shared.replace(" ", "\t", 3), "en")]
    out += [(68, say("en", 20000), "en"), (None, say("en", 30), "en"), (5, out[5][1], "fr")]
    return [(i, t, lang, "s", len(t or ""), "x", 7, 9) for i, t, lang in out]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def components_of(n: int, pairs) -> list[int]:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 3), (4, 5), (7, 7), (5, 6), (6, 4)]
    got = {(r.node, r.root) for r in components.connected(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 1), (4, 4), (5, 4), (6, 4)}


def test_simhash(spark, docs, rows, nothing):
    def fp(t):
        w = (t or "").lower() if (t or "").isascii() else "".join(c.lower() if c.isascii() else c for c in t)
        w = w.split()
        sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = [(r[0], fp(r[1])) for r in rows]
    got = sorted((r.doc is not None, r.doc or 0, r.fp & (2**64 - 1), r.component) for r in simhash.near_duplicates(docs).collect())
    assert [(g[1] if g[0] else None, g[2]) for g in got] == sorted(want, key=lambda x: (x[0] is not None, x[0] or 0))
    near = [(i, j) for i in range(len(want)) for j in range(i) if (want[i][1] ^ want[j][1]).bit_count() <= 3]
    label = components_of(len(want), near)
    low = {}
    for (d, _), c in zip(want, label):
        if d is not None:
            low[c] = min(d, low.get(c, d))
    assert {(g[1], g[3]) for g in got if g[0]} == {(d, low[c]) for (d, _), c in zip(want, label) if d is not None}
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted(set(low.values()))


@pytest.mark.parametrize("levels", [1, 3, 8])
def test_tree_sees_each_pair(levels):
    rng = np.random.default_rng(levels)
    x = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    y = x[:400].copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, len(y), dtype=np.uint64)
    x = np.unique(np.concatenate([x, y]))
    leaf, index, home = simhash.Tree(x[::7], levels).route(x, 3)
    assert home.sum() == len(x)
    seen = set()
    for shard in np.unique(leaf):
        own, all_ = index[(leaf == shard) & home], index[leaf == shard]
        for i in own:
            seen |= {(min(i, j), max(i, j)) for j in all_[np.bitwise_count(x[all_] ^ x[i]) <= 3] if i != j}
    assert seen == {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 3)) if i < j}


def test_overfull_shard_is_dealt(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 12, 600))  # one dense cluster
    df = spark.createDataFrame([(int(v),) for v in x], "fp long")
    monkeypatch.setattr(simhash, "TASK_ROWS", 50)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 300)
    got = {(r.node, r.root) for r in components.connected(simhash.links(df), "a", "b").collect()}
    label = components_of(len(x), [(i, j) for i in range(len(x)) for j in range(i) if int(x[i] ^ x[j]).bit_count() <= 3])
    assert got == {(int(v), int(x[c])) for v, c in zip(x, label) if label.count(c) > 1}


def test_near_pairs_in_a_shard():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    y = x[:900].copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, len(y), dtype=np.uint64)
    own, rest = np.unique(np.concatenate([x[:2000], y[:600]])), np.unique(np.concatenate([x[2000:], y[600:]]))
    a, b = simhash._near(own, rest, 3)
    assert (np.bitwise_count(a ^ b) <= 3).all()
    both = np.concatenate([own, rest])
    place = {int(v): i for i, v in enumerate(both)}
    near = np.argwhere(np.bitwise_count(own[:, None] ^ both[None]) <= 3)
    want = components_of(len(both), [(i, j) for i, j in near if i != j])
    assert components_of(len(both), [(place[int(i)], place[int(j)]) for i, j in zip(a, b)]) == want


def test_keep_one_by_row(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c, d = say(60), say(60), say(200), say(80)
    near, far = c.split(), d.split()
    near[100] = "other"
    far[20] = far[40] = far[60] = "other"
    rows = [(3, a), (5, a), (5, b), (7, c), (8, " ".join(near)), (9, d), (10, " ".join(far)), (11, None), (12, ""), (None, a), (13, b.upper()), (5, b), (14, "x y"), (15, "x y"), (16, "x z")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, __doc int, __t int, __some int, __extra int").repartition(3)
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted((str(i), t or "") for i, t in [(3, a), (5, b), (7, c), (9, d), (10, " ".join(far)), (11, ""), (None, a), (14, "x y"), (16, "x z")])
    sh = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    left, right = [c, d, "", "x y", "x y z x y z x", b, "x y"], [" ".join(near), " ".join(far), " ", "x z", "z x y z x y", b.upper(), "y x"]
    got = simhash.similarities([t.encode() for t in left], [t.encode() for t in right])
    assert np.allclose(got, [len(sh(x) & sh(y)) / len(sh(x) | sh(y)) for x, y in zip(left, right)]) and got[0] >= 0.8 > got[1]


@pytest.mark.parametrize("rounds", [1, 3])
def test_pairs_are_verified_in_rounds(spark, monkeypatch, rounds):
    """Classes are those of all similar candidate pairs, however many rounds come first; most candidates aren't similar."""
    monkeypatch.setattr(simhash, "ROUNDS", rounds)
    rng = random.Random(rounds)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(["x", "y"]) if rng.random() < 0.03 else w for w in base) for _ in range(30)]
    pairs = [(a, b, rng.randrange(1, 9)) for a in range(30) for b in range(a) if rng.random() < 0.4]
    ok = simhash.similarities([texts[a].encode() for a, _, _ in pairs], [texts[b].encode() for _, b, _ in pairs]) >= 0.8
    root = list(range(30))
    for (a, b, _), _ in filter(lambda x: x[1], zip(pairs, ok)):
        x, y = sorted((root[a], root[b]))
        root = [x if r == y else r for r in root]
    t = spark.createDataFrame(list(enumerate(texts)), "t long, text string")
    got = {r.node: r.root for r in simhash._joined(t, spark.createDataFrame(pairs, "a long, b long, n long"), 5, 0.8).collect()}
    assert ok.any() and not ok.all() and [got.get(i, i) for i in range(30)] == root


def test_shingle_fingerprints():
    text = " ".join(map(str, range(3000))).encode()
    h = simhash.shingle_fingerprints([b"a b c d e f", b"", b"x y", text])
    assert h.shape == (4, simhash.TABLES) and not h[1].any() and h[0].any() and h[2].any() and (h >> simhash.TABLE_BITS == 0).all()
    g = simhash.mix(simhash.Words([text], simhash.SPACE_WORDS).shingles(5)[0][:2996] + np.uint64(0x9E3779B97F4A7C15))
    assert int(h[3, 0]) == sum(1 << b for b in range(simhash.TABLE_BITS) if 2 * int((g >> np.uint64(b) & np.uint64(1)).sum()) > 2996)


def test_near_copies_are_found(spark):
    """Of 300 pairs with one change in 100 to 300 words, or two in 200 to 300, nearly all are one class."""
    rng = random.Random(8)
    texts = []
    for i in range(300):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(100, 300))]
        v = list(w)
        for _ in range(1 + (len(w) > 200)):
            v[rng.randrange(len(v))] = "other"
        texts += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    kept = simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} >= {2 * i for i in range(300)} and len(kept) <= 300 + 30, len(kept)


def test_language(spark, docs, rows, nothing):
    model = langid.fit(docs)
    got = {(r.doc_id, r.text): (r["__lang"], r["__score"]) for r in langid.identify(docs, model).collect()}
    for i, t, lang, *_ in rows:
        name, score = got[i, t]
        assert 0 <= score <= 1
        assert name == ("und" if not t or t[0] == "1" else "fr" if "é" in t or "à" in t or "ç" in t else "en"), (i, t)
    assert [n for n, _ in zip(*model.predict(["\u00bd \u00b2".encode(), "\u2167 12".encode(), "a".encode()]))][:2] == ["und", "und"]
    assert langid.fit(nothing) is None and langid.identify(nothing, None).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r[0] for r in rows} - {r.doc_id for r in kept.collect()} == {62, 63, 64}


def test_decontamination(spark, docs, rows, nothing):
    t = rows[0][1].split()
    items = [(1, " ".join(rows[2][1].split()[:20])), (2, " ".join(t[:3]).upper()), (10, "no such words here at all"), (3, None), (None, "x"), (4, "..."), (2, " ".join(t[:3]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    c = decontaminate.contamination(docs, bench)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r["__n"], len(r["__hits"]) // 8, len(r["__items"]), hashlib.sha256(",".join(sorted(r["__items"])).encode()).hexdigest()) for r in c.collect())
    small = [(r[0], r[1]) for r in rows]
    want = decontaminate.brute_force(small, items)
    assert got == sorted((w[0] is not None, w[0] or 0, *w[1:5]) for w in want)
    bad = {w[0] for w in want if w[5]}
    assert bad and {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {r[0] for r in rows} - bad
    assert decontaminate.contamination(nothing, bench).count() == 0 and decontaminate.contamination(docs, bench.limit(0)).where("__n > 0 and octet_length(__hits) > 0").count() == 0


def test_decontamination_in_blocks(spark, docs, rows, monkeypatch):
    items = [(i, " ".join(rows[i][1].split()[:14])) for i in range(8)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted((str(r.doc_id), r["__n"], r["__hits"], r["__items"]) for r in decontaminate.contamination(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert one == sorted((str(r.doc_id), r["__n"], r["__hits"], r["__items"]) for r in decontaminate.contamination(docs, bench).collect())


def test_longest_matches(spark, docs, rows):
    w = rows[6][1].split()
    bench = spark.createDataFrame([(1, "zz " + " ".join(w[:16]) + " zz")], "item_id long, text string")
    got = {(r.item_word, r.length, r.doc_id, r.doc_word) for r in decontaminate.longest_matches(docs, bench).collect()}
    n = min(16, len(w))
    assert (1, n, 6, 0) in got if n >= 13 else not got


def test_longest_matches_over_all_shards(spark):
    w = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([(1, " ".join(w[:40]))], "item_id long, text string")
    texts = [(1, "a " + " ".join(w[:15])), (2, "b c " + " ".join(w[:20])), (3, " ".join(w[5:60])), (4, " ".join(w[:20]) + " d")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4, "doc_id")
    got = {(r.item_word, r.length, r.doc_id, r.doc_word) for r in decontaminate.longest_matches(docs, bench).collect()}
    text = {i: t.split() for i, t in texts}
    want = set()
    for k in range(40):
        found = {}
        for d, t in text.items():
            for p in range(len(t)):
                n = 0
                while k + n < 40 and p + n < len(t) and t[p + n] == w[k + n]:
                    n += 1
                found[d, p] = n
        best = max(found.values())
        if best >= 13:
            want |= {(k, best, d, p) for (d, p), n in found.items() if n == best}
    assert got == want


NAMES = "__text __n __n_hit __hits __items spans __spans __places __words __repeated __doc __some __t __extra __lang __score".split()


def test_clashing_names(spark, rows):
    """Operators that return the table's columns leave those alone that have names they use inside."""
    docs = spark.createDataFrame([(r[0], r[1], r[2], len(r[1] or ""), *[f"{k}{n}" for k in range(len(NAMES))]) for n, r in enumerate(rows)], f"doc_id long, text string, lang string, n_chars long, {', '.join(f'{c} string' for c in NAMES)}")
    bench = spark.createDataFrame([(1, " ".join(rows[2][1].split()[:20]))], "item_id long, text string")
    by = {r[NAMES[0]]: r.asDict() for r in docs.collect()}
    for f in (langid.keep_identified, simhash.keep_one, passages.cut_repeats, lambda d: decontaminate.drop_contaminated(d, bench)):
        out = f(docs)
        assert out.columns == docs.columns
        for r in out.collect():
            assert {k: v for k, v in r.asDict().items() if k not in ("text", "n_chars")} == {k: v for k, v in by[r[NAMES[0]]].items() if k not in ("text", "n_chars")}
    named = langid.identify(docs, None)  # outputs replace columns of their names, others stay
    assert sorted(named.columns) == sorted(docs.columns) and {r["__text"] for r in named.collect()} == set(by)


def test_token_file(spark, docs, rows, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = tokenfile.read(spark, tokenfile.write(docs, path, scratch(spark, "t"))).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(rows)
    start, by = 0, sorted(got, key=lambda r: r.start)
    for r, g in zip(order, by):
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        assert (g.doc_id, g.start, g.n_tokens, np.frombuffer(g.ids, "<u4").tolist()) == (r[0], start, len(ids), ids)
        start += len(ids)
    assert tokenfile.read(spark, tokenfile.write(nothing, path, scratch(spark, "t"))).count() == 0


def test_token_files_of_a_range(spark, rows):
    """A range of several files, files that several tasks read, rows of one id in several ranges."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    many = [r[:2] for r in rows] + [(5, f"{k} {rows[k][1]}") for k in range(40)] + [(None, f"z{k}") for k in range(5)]
    files = tokenfile.write(spark.createDataFrame(many, "doc_id long, text string").repartition(4), path, scratch(spark, "t"), file_bytes=4000, most=3, block=512)
    assert files.count() > 9 and files.where("blocks > 2").count()
    by = sorted(tokenfile.read(spark, files, 2).collect(), key=lambda r: r.start)
    assert [r.start for r in by] == np.cumsum([0, *(r.n_tokens for r in by)])[:-1].tolist()
    assert [r.doc_id for r in by] == sorted((r[0] for r in many), key=lambda x: (x is not None, x or 0))
    want = sorted((str(d), t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x in many)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in by) == want


@pytest.mark.parametrize("seed", range(2))
def test_token_ids_equal_the_library(seed):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, e, rng = Tokenizer.from_file(path), tokenfile.Encoder(path), random.Random(seed)
    bits = [*".,;:!?#*%&$-_()\"'<> \n\t\r\x0b\x1c\x00\x85", "...", "'s", "a", "the", "The", "QUICK", "1", "23", "\u00e9", "\u00c9", "\u00df", "\u00ff", "\u65e5\u672c", "\U0001f600", "\u00a0", "\u2003", "  ", "<|endoftext|>" if seed else "x", "e\u0301", "\u0130", "\u212a", "\u0149", "zvj"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(4000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode([x.encode() for x in texts])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_words_of_token_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), tokenfile.Encoder(path)
    odd = ["A b.", "x...,", "It's. IT'S, 'S. don't!", "<|ENDOFTEXT|> Ab.", "<|endoftext|>. aB", "E\u0301. e\u0301, \u0130. \u212a.", "1.2. 33,4; ###", "a.\u00a0b. c.\u2003d", "\u00df. \u00e9.", ".,a", "", " \n", "a#'. b#\u2026", "\u65e5\u672c.", "\U0001f600. a\U0001f600.", "\u00f7 \u00e0\u00ff\u00df\u00fe na\u00efve \u00c9t\u00e9 \u0149a e\u0301e"]
    assert e.cuts and e.folds and e.plain
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode([x.encode() for x in odd])] == [t.encode(x, add_special_tokens=False).ids for x in odd]


@pytest.mark.parametrize("n,kinds", [(0, 1), (1, 1), (5000, 1), (3000, 2), (600000, 40000), (1025, 300)])
def test_coding(n, kinds):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % kinds).astype(np.uint32)
    file = tokenfile.File(tokenfile.pack(ids, [1, None], np.array([n // 3, n - n // 3])))
    assert np.array_equal(np.concatenate([x for _, x in file.texts()]) if n else ids, ids) and file.docs == [1, None]
    parts = [(d, x) for a in range(len(file.points)) for d, x in file.texts(a, 1)]  # a run of blocks has the documents that begin there
    assert n < 3 or [d for d, _ in parts] == [0, 1] and np.array_equal(np.concatenate([x for _, x in parts]), ids)
    if n > tokenfile.BLOCK:
        assert np.array_equal(file.block(1), ids[tokenfile.BLOCK : 2 * tokenfile.BLOCK])
        data = bytearray(file.data)
        data[int(file.points[1]["place"]) + 9] ^= 1
        with pytest.raises(ValueError):
            tokenfile.File(bytes(data)).block(1)


def test_passages(spark, docs, rows, nothing):
    found = {(r.doc, r.other) for r in passages.repeats(docs).collect()}
    want, grams = set(), {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().lower().split()
        for k in range(len(w) - 49):
            first = grams.setdefault(tuple(w[k : k + 50]), i)
            if first != i:
                want.add((i, first))
    assert want <= found and {d for d, _ in found} == {d for d, _ in want}
    cut = {r.doc_id: r for r in passages.cut_repeats(docs).collect()}
    by = {r[0]: r[1] for r in rows}
    assert cut[65].text == by[65] and cut[0].text == by[0] and cut[62].text is None
    assert len(cut[66].text.split()) <= 21 and len(cut[67].text.split()) <= 11 and cut[66].n_chars == len(cut[66].text)
    assert passages.repeats(nothing).count() == 0 and passages.cut_repeats(nothing).columns == nothing.columns


def test_near_passage(spark):
    rng = random.Random(3)
    w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    near = w[40:160]
    near[60] = "other"
    d = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(["x%d" % i for i in range(80)] + near)), (3, " ".join("y%d" % i for i in range(300)))], "doc_id long, text string")
    got = [(r.doc, r.other, r.first, r["last"]) for r in passages.repeats(d).collect()]
    assert {g[:2] for g in got} == {(2, 1)} and min(g[2] for g in got) == 80 and max(g[3] for g in got) == 199


@pytest.mark.parametrize("few,block", [(16, 512), (2, 7)])
def test_passages_meet_all(spark, tmp_path, monkeypatch, few, block):
    monkeypatch.setattr(passages, "FEW", few, raising=False)
    monkeypatch.setattr(passages, "BLOCK_ROWS", block, raising=False)
    rng = random.Random(7)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    p, q = say(70).split(), say(70)
    chunks = lambda: " ".join(" ".join(p[k : k + 10]) + " " + say(20) for k in range(rng.randrange(5), 60, 6))
    # the shingles of p, but not p itself, in the first texts and in those between the two that have it
    texts = [chunks() for _ in range(12)] + [say(30) + " " + " ".join(p)] + [chunks() for _ in range(12)] + [" ".join(p) + " " + say(40)]
    texts += [say(rng.randrange(20, 60)) + " " + q + " " + say(30) for _ in range(40)] + [say(80)]
    texts += [texts[30], texts[30]]  # copies of one of the forty
    texts += [say(60) + " " + q + " " + say(60) + " " + q + " " + say(60)]  # twice in one document
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in passages.op6_passages(spark, str(tmp_path)).collect()}
    linked = {i: r.n_links for i, r in got.items() if r.n_links}
    forty = [*range(26, 66), 67, 68, 69]
    assert linked == {12: 1, 25: 1} | {i: 42 for i in forty}
    assert got[25].passages == "0-69" and got[25].component_id == 12 and got[12].n_repeated == 0
    assert all(got[i].n_repeated == 70 and got[i].component_id == 26 for i in range(27, 66)) and got[67].n_repeated == got[67].n_words
    assert got[69].passages == "60-129,190-259"


def test_near_passages_are_found(spark):
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for i in range(600):  # 50 words, and a word put in somewhere
        p, k = say(50), rng.randrange(5, 46)
        texts += [(2 * i, " ".join(say(20) + p + say(20))), (2 * i + 1, " ".join(say(20) + p[:k] + ["other"] + p[k:] + say(20)))]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    found = {(r.doc, r.other) for r in passages.repeats(d).collect()}
    assert found <= {(2 * i + 1, 2 * i) for i in range(600)} and len(found) >= 597, len(found)


def _edited(rng, p: list[str], n: int) -> list[str]:
    p = list(p)
    for i in sorted(rng.sample(range(5, len(p) - 5), n), reverse=True):
        p[i : i + rng.randrange(2)] = ["other%d" % rng.randrange(10**9)] * rng.randrange(1, 2)
    return p


@pytest.mark.parametrize("edits,length,line", [(0, 50, 0), (1, 60, 20), (2, 100, 0), (3, 150, 20)])
def test_recall_of_passages(spark, edits, length, line):
    """150 pairs of passages at a similarity of 0.8 or more, some with a line of 20 words that all have: verbatim ones are all found, 95 of 100 of the others."""
    rng, texts, want = random.Random(edits), [], set()
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    sh = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    common = say(line)
    for i in range(150):
        p = say(length)
        p[10 : 10 + line] = common
        q = _edited(rng, p, edits)
        texts += [(2 * i, " ".join(say(20) + p + say(20))), (2 * i + 1, " ".join(say(20) + q + say(20)))]
        if len(sh(p) & sh(q)) >= 0.8 * len(sh(p) | sh(q)):
            want.add((2 * i + 1, 2 * i))
    found = {(r.doc, r.other) for r in passages.repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    assert found <= {(2 * i + 1, 2 * i) for i in range(150)} and len(want) > 100
    assert len(want & found) >= (1 if not edits else 0.95) * len(want)


@pytest.mark.parametrize("heavy", [False, True])
def test_verbatim_passages_beside_variants(spark, monkeypatch, heavy):
    rng, rows = random.Random(4), []
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for g in range(12):
        p = say(60)
        rows += [(len(rows) + v, g, v, " ".join(say(30) + (_edited(rng, p, 1) if v % 2 else p) + say(30))) for v in range(24)]
    docs = spark.createDataFrame([(i, t) for i, _, _, t in rows], "doc_id long, text string").repartition(4)
    if heavy:  # all values are dealt to three tasks
        values = [r.value for r in passages.windows(passages._known(docs, "doc_id", "text")).select("value").distinct().collect()]
        monkeypatch.setattr(passages, "_heavy", lambda *a: dict.fromkeys(values, 3))
    pairs = passages.repeats(docs).select("doc", "other").distinct()
    assert {r.doc for r in pairs.collect()} >= {i for i, _, v, _ in rows if v and v % 2 == 0}
    root = {r.node: r.root for r in components.connected(pairs, "doc", "other").collect()}
    assert len(root) >= 0.98 * len(rows) and all(root.get(i, i - v) == i - v for i, _, v, _ in rows)


@pytest.mark.parametrize("seed", range(5))
def test_compact_windows(seed):
    rng = np.random.default_rng(seed)
    value = mixed = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    if seed == 4:
        value = mixed = np.repeat(mixed[:6], 10)
    first, last = np.repeat([0, 25], [25, 35]), np.repeat([24, 59], [25, 35])
    got = set(zip(*(x.tolist() for x in passages.compact_windows(mixed, first, last, 8))))
    cover = {}
    for lo, hi in ((0, 24), (25, 59)):
        for a in range(lo, hi + 1):
            for b in range(a + 7, hi + 1):
                cover[a, b] = a + int(np.argmin(value[a : b + 1]))
    for (a, b), c in cover.items():
        assert sum(x <= a and b <= y and z == c for x, z, y in got) == 1


def test_language_model(spark, docs, rows, nothing):
    got = {(r.doc_id, r.n_tokens, r.held_out): r for r in lm.score(docs).collect()}
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    tokens = [(r[0], [*(r[1] or "").encode().lower().split(), None]) for r in rows]
    count: dict = {}
    for d, t in tokens:
        if not held(d):
            for w in t:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for d, t in tokens:
        r = got[d, len(t), held(d)]
        base = sum(np.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert r.n_known == sum(w in count for w in t) and r.train_tokens == n and abs(r.base_score - base) < 1e-4 and r.score < 0
    assert lm.score(nothing).count() == 0


def test_lists_dealt_go_before_the_answers(docs, monkeypatch):
    seen, tidy = [], lm.tidy
    monkeypatch.setattr(lm, "tidy", lambda df: seen.append(df.columns) or tidy(df))
    assert lm.score(docs).count() == docs.count()
    assert seen == [["target", "words", "rest", "asked"]] * 2  # after they are gathered, and before the answers


def test_seating():
    rng = np.random.default_rng(0)
    n = np.full(20000, 3)
    t = lm.seat(n, np.full(len(n), 0.7), 0.4, rng)
    p2 = 0.7 / (0.7 + 1 - 0.4)  # the second customer takes a new table; then the third
    want = 1 + p2 + p2 * 0.7 / (0.7 + 2 - 0.8) + (1 - p2) * 0.7 / (0.7 + 2 - 0.4)
    assert abs(t.mean() - want) < 0.02 and lm.seat(np.array([1, 500000]), np.ones(2), 0.5, rng)[0] == 1


def test_tables_are_drawn_from_their_conditional():
    """Against the weights of all seatings of five customers, counted one by one."""
    d, a, rng = 0.3, 0.8, np.random.default_rng(1)
    weight = {1: {(1,): 1.0}}
    for c in range(1, 5):  # sizes of tables to weights
        weight[c + 1] = {}
        for sizes, w in weight[c].items():
            for i in range(len(sizes)):
                key = tuple(sorted((*sizes[:i], sizes[i] + 1, *sizes[i + 1 :])))
                weight[c + 1][key] = weight[c + 1].get(key, 0) + w * (sizes[i] - d)
            key = tuple(sorted((*sizes, 1)))
            weight[c + 1][key] = weight[c + 1].get(key, 0) + w
    want = np.array([sum(w for s, w in weight[5].items() if len(s) == t) * a**t for t in range(1, 6)])
    assert np.allclose(np.exp(lm.stirling(8, d)[5, 1:6]) * a ** np.arange(1, 6), want)
    got = lm.tables(np.full(60000, 5), np.full(60000, a), d, rng)
    assert np.abs(np.bincount(got, minlength=6)[1:] / 60000 - want / want.sum()).max() < 0.01
    assert lm.tables(np.array([0, 1, 900]), np.ones(3), d, rng)[:2].tolist() == [0, 1]


def test_parent_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    each = rng.integers(1, 5, 200)
    k, c = rng.integers(0, 50, each.sum()), rng.integers(1, 9, each.sum())
    state = lm.State(0.4, 0.3, np.bincount(k, c, 50), np.bincount(k, minlength=50).astype(float), float(each.sum()), 200.0, 200)
    t, n, r = state.draw(each, k, c, rng)
    made = lm.State(0.4, 0.3, state.customers, np.bincount(k, t, 50), n.sum(), r.sum(), 200)
    assert abs(made.base(n, r).sum() + made.base(np.zeros(1), np.zeros(1))[0] - 1) < 1e-9 and (t <= c).all() and (r <= n).all() and (t >= 1).all()
    back = (lm.THETA + 0.4 * made.tables) / (lm.THETA + state.customers)
    mass = np.bincount(k, c - 0.4 * t, 50) / (lm.THETA + state.customers)
    assert np.allclose((back + mass)[state.customers > 0], 1)


def test_pieces(spark, docs, rows):
    import sentencepiece

    path = pieces.model_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.digest(docs, path).collect()
    want = sorted((str(r[0]), len(sp.encode(r[1] or "")), pieces.crc(sp.encode(r[1] or ""))) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want and all(r.exact for r in got)
    v = pieces.Vocabulary(path)
    odd = ["a  b\n c\t日本 ﬁ é", " ", "", "   lead", "tail   ", "<s> <unk> <0x0A>", "\x00\x01 😀😀", "a" * 90, "é́ x"]
    for t, ids in zip(odd, v.encode([t.encode() for t in odd])):
        assert np.frombuffer(ids, "<i4").tolist() == sp.encode(t) and v.decode(ids).decode() == t


@pytest.mark.parametrize("long", [256, 8])
def test_pieces_of_long_runs(monkeypatch, long):
    import sentencepiece

    monkeypatch.setattr(pieces, "LONG", long)
    path, rng = pieces.model_path(), random.Random(long)
    sp, v = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Vocabulary(pieces.model_path())
    letters = ["abcdefghijklmnopqrstuvwxyz", "etaoin", "ab", "a", "\u65e5\u672c\u8a9ea", "ABCabc0123+/="]
    texts = ["".join(rng.choice(x) for _ in range(n)) for x in letters for n in (1, 7, 300, 3000)]
    texts += [" ".join(texts[:6]), "the theory of then" * 200, "\u2581".join(texts[:5])]
    assert [np.frombuffer(x, "<i4").tolist() for x in v.encode([t.encode() for t in texts])] == [sp.encode(t) for t in texts]


def test_media(spark, docs, rows, nothing):
    folder = scratch(spark, "m")
    assert media.write(docs, folder) == len(rows)
    spark.dataSource.register(media.MediaArchive)
    members = spark.read.format("media_archive").option("rangebytes", 3000).load(folder)
    got = sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.features(members).collect())
    want = []
    for r in rows:
        b = (r[1] or "").encode()
        p = media.pad(b)
        want.append((str(r[0]), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want)
    assert media.write(nothing, empty := scratch(spark, "m")) == 0 and spark.read.format("media_archive").load(empty).count() == 0


def test_media_retry(tmp_path):
    class Store:
        fails = 2

        def open_input_file(self, path):
            if self.fails:
                self.fails -= 1
                raise OSError("gone")
            from pyarrow import fs

            return fs.LocalFileSystem().open_input_file(path)

    a = media._Archive(str(tmp_path / "a.tar"))
    a.add("1/3.png", media.to_png(media.pad(b"abc")))
    a.close()
    name, data = media.member(Store(), str(tmp_path / "a.tar"), 0)
    assert name == "1/3.png" and media.from_png(data)[:3] == b"abc"


def test_licenses(spark):
    text = "Some words.\nReleased under the MIT License.\nMore; licensed under CC BY-NC 4.0! This program is free\nsoftware: you can redistribute it"
    d = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "the MIT licence")], "doc_id long, text string")
    got = {r.doc_id: (r["__sentences"], r["__licences"]) for r in licenses.scan(d).collect()}
    assert got == {1: (["mit_named", "ccbync4_named", "gpl_free"], ["CC-BY-NC-4.0", "MIT"]), 2: ([], []), 3: ([], []), 4: ([], [])}


APACHE = """Copyright 2020 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
AS_IS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def test_notices_as_published(spark, tmp_path):
    import duckdb

    notices = {"Apache-2.0": [APACHE], "MIT": [MIT, "MIT License", "The MIT License"], "BSD-3-Clause": [BSD + THIRD + AS_IS], "BSD-2-Clause": [BSD + AS_IS], "GPL-3.0-or-later": [GPL], "LGPL-2.1-or-later": [LGPL], "MPL-2.0": [MPL], "GPL-2.0-or-later": [GPL.replace("Foundation, either version 3", "Foundation; either version 2").replace("software:", "software;")]}
    rows, want = [], {}
    for name, texts in notices.items():
        for text in [*texts, f"SPDX-License-Identifier: {name}"]:
            for mark in ("", "# ", "// ", " * ", ";; "):
                rows.append((len(rows), "\n".join((mark + x).rstrip() if x else mark.rstrip() for x in text.split("\n")) + "\n\ncode follows here"))
                want[len(rows) - 1] = name
    rows += [(len(rows), "We like the MIT license."), (len(rows) + 1, None), (len(rows) + 2, ""), (0, "MIT License")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in licenses.op3_licenses(spark, str(tmp_path)).collect()]
    assert len(got) == len(rows) and {(i, found) for i, _, _, found in got} == {(i, want.get(i, "")) for i, _ in rows} | {(0, "MIT")}
    assert all(k in {x for _, ids in licenses.RULES for x in ids} for k in licenses.SENTENCES)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(licenses.op3_sql()).fetchall()) == sorted(got)
    con.sql("create or replace view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(con.sql(licenses.op3_sql()).fetchall()) == sorted(tuple(r) for r in licenses.op3_licenses(spark, "/root/testdata/sf0.001").collect())


def test_quality(spark, rows, nothing):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + ("###" if i % 3 == 0 else "") for _ in range(40))) for i in range(300)] + [(300, None), (301, "")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r["__score"] for r in quality.score(d, quality.fit(d, labels)).collect()}
    assert all((got[i] > 0.5) == (i % 3 != 0) for i in range(300)) and got[300] == got[301] and 0 <= got[300] <= 1
    assert quality.score(nothing, quality.fit(nothing, labels.limit(0))).count() == 0


def test_pipeline(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(rows[2][1].split()))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    gone = {62, 63, 64, 60, 61, 2}  # no letters, copies, contaminated
    assert set(got) == {r[0] for r in rows} - gone and all(r.exact for r in got.values())


def test_links_do_not_depend_on_the_order(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 1 << 62, 60)
    x = np.unique(np.concatenate([x[i % 60 :][:1] ^ (1 << rng.integers(0, 40, 1)) for i in range(900)] + [x]))
    got = [sorted(simhash.links(spark.createDataFrame([(int(v),) for v in rng.permutation(x)], "fp long").repartition(n)).collect()) for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) > 500


@pytest.mark.parametrize("task_rows", [1 << 19, 500])
def test_near_fingerprints_by_blocks(spark, monkeypatch, task_rows):
    """All near pairs of different classes, in groups that agree in many blocks too and over several shards, and a forest of them."""
    monkeypatch.setattr(simhash, "TASK_ROWS", task_rows)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 200)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 48, 12, dtype=np.uint64)
    flip = lambda k: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 48, k).astype(np.uint64))
    x = np.unique(np.concatenate([np.array([b ^ flip(rng.integers(1, 6)) for b in np.repeat(base, 40)]), base[0] >> np.uint64(20) << np.uint64(20) | rng.integers(0, 1 << 20, 700, dtype=np.uint64)]))
    near = np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= 3, 1)
    root = np.arange(len(x)) // 3
    want = {(int(max(x[i], x[j])), int(min(x[i], x[j]))) for i, j in zip(*np.nonzero(near)) if root[i] != root[j]}
    rows = spark.createDataFrame([(0, int(v), int(v), int(r)) for v, r in zip(x, root)], "kind int, fp long, t long, root long")
    assert {(r.a, r.b) for r in simhash.apart(rows, len(x), 3, 48).collect()} == want
    found = simhash.block_links(rows.select("kind", "fp"), 3, 48)
    got = {(r.node, r.root) for r in components.connected(found, "a", "b").collect()}
    pairs = spark.createDataFrame([(int(x[i]), int(x[j])) for i, j in zip(*np.nonzero(near))], "a long, b long")
    assert got == {(r.node, r.root) for r in components.connected(pairs, "a", "b").collect()}


def test_blocks_of_many_fingerprints():
    """What one costs hardly grows with their number; a tree took 6.3 s for these, and grew."""
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 1 << 17, dtype=np.uint64))
    began = time.process_time()
    simhash.forest(x, 3, 48)
    assert time.process_time() - began < 3


def test_windows_of_a_large_group_all_meet():
    """Twenty texts share a line of 16 shingles, two of them all around it: those two meet, whoever is first; not if the later one's words are in a passage of one component already."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    line = rng.integers(0, 1 << 32, 16, dtype=np.uint32)
    around = [[rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (40, 35)] for _ in range(20)]
    around[17] = around[11]
    grams = [np.concatenate([a, line, b]).tobytes() for a, b in around]
    twice = [np.tile(rng.integers(0, 1 << 32, 2, dtype=np.uint32), 45).tobytes()] * 2  # few different shingles, in many places

    def meetings(covered, root):
        place = [(100 + i) << 32 | 45 << 16 | 45 for i in range(22)]
        columns = [[7] * 20 + [8] * 2, list(range(20)) + [30, 31], place, root + [30, 31], covered + [False] * 2]
        batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(grams + twice, pa.binary())], names=["value", "doc", "place", "root", "covered", "grams"])
        out = [r for b in passages._others(46)(iter([batch.slice(0, 13), batch.slice(13)])) for r in b.to_pylist()]
        return {(r["a"], r["b"], r["d"], r["lo"], r["hi"]) for r in out}

    small = (31, 30, 1, 76, 166)
    assert meetings([False] * 20, list(range(20))) == {(17, 11, 6, 72, 162), small}
    assert meetings([True] * 20, list(range(20))) == {(17, 11, 6, 72, 162), small}  # of two components
    assert meetings([True] * 20, [0] * 20) == {small}


def test_classes_of_contexts_grow():
    assert lm.classes_of(0) == lm.classes_of(1 << 20) == 1 << 16
    assert lm.classes_of(1 << 37) > lm.classes_of(1 << 36) > 1 << 18


def test_frequent_words_are_encoded_once(monkeypatch):
    """A worker remembers words over tasks, and frequent ones over those that come once; cuts of any number go in parts."""
    import sentencepiece

    monkeypatch.setattr(pieces, "MEMO", 50)
    monkeypatch.setattr(pieces, "CUT_CHARS", 40)
    sp, v = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()), pieces.vocabulary(pieces.model_path())
    assert v is pieces.vocabulary(pieces.model_path())
    met, cuts = [], v._cuts
    monkeypatch.setattr(v, "_cuts", lambda x: (met.extend(x), cuts(x)))
    for i in range(12):
        text = "always the same words " + " ".join(f"once{i}x{j}" for j in range(30))
        assert v.encode([text.encode()]) == [np.array(sp.encode(text), "<i4").tobytes()]
    assert met.count("▁always") <= 1 and len(met) >= 360 and len(v.memo) + len(v.past) < 200


def test_known_passages_of_a_large_group_meet_no_more():
    """Of 300 windows of one component that share a known passage only, none meets; where 299 go on alike after it, each meets the first of those, not all of them."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    some = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint32)
    line, after = some(70), some(20)

    def meetings(rest):
        grams = [np.concatenate([some(10), line, r]).tobytes() for r in rest]
        batch = pa.table({"value": [7] * 300, "doc": range(300), "place": [100 << 32 | 45 << 16 | 54] * 300, "root": [0] * 300, "covered": [False] * 300, "left": [10] * 300, "right": [20] * 300, "grams": pa.array(grams, pa.binary())})
        return {(r["a"], r["b"]) for b in passages._others(46)(iter(batch.to_batches())) for r in b.to_pylist()}

    assert meetings([some(20) for _ in range(300)]) == set()
    assert meetings([some(20)] + [after] * 299) == {(i, 1) for i in range(2, 300)}


def test_a_repeated_shingle_counts_as_often_as_the_other_has_it():
    """Two texts have a shingle ten times, two others sixty times: a run of the latter is no passage of the former."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    some = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint32)
    one = some(1)
    few = np.concatenate([some(50), np.tile(one, 10), some(49)])
    grams = [few, few, *(np.concatenate([some(20), np.tile(one, 60), some(29)]) for _ in range(2))]
    batch = pa.table({"value": [7] * 4, "doc": range(4), "place": [100 << 32 | 54 << 16 | 54] * 4, "root": range(4), "covered": [False] * 4, "grams": pa.array([g.tobytes() for g in grams], pa.binary())})
    assert {(r["a"], r["b"]) for b in passages._others(46)(iter(batch.to_batches())) for r in b.to_pylist()} == {(1, 0), (3, 2)}


def test_runs_of_one_shingle_meet_once():
    """Of 120 windows of one component with a run of 46 to 54 of one shingle, each has that run from the first, whose passage is verified at once; runs of 38 to 45 between different words are no passage of any other."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    some = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint32)
    one = some(1)

    def meetings(runs):
        grams = [np.concatenate([some(54), np.tile(one, n), some(55 - n)]) for n in runs]
        assert runs[0] >= 46 or not any(passages.passages_of(x, y, 46, 0.8) for x in grams for y in grams if x is not y)
        batch = pa.table({"value": [7] * 120, "doc": range(120), "place": [100 << 32 | 60 << 16 | 60] * 120, "root": [0] * 120, "covered": [False] * 120, "grams": pa.array([g.tobytes() for g in grams], pa.binary())})
        return [r for b in passages._others(46)(iter(batch.to_batches())) for r in b.to_pylist()]

    runs = [46 + i % 9 for i in range(120)]
    assert [(r["a"], r["b"], r.get("first"), r.get("last")) for r in sorted(meetings(runs), key=lambda r: r["a"])] == [(i, 0, 100, 99 + runs[i]) for i in range(1, 120)]
    assert meetings([38 + i % 8 for i in range(120)]) == []


def test_filter_of_ids(spark):
    """True for all ids of the other table and hardly any other, whatever the columns' names, without workers of its own."""
    docs = spark.createDataFrame([(i, "x", "y") for i in [*range(2000), None]], "doc_id long, __bits string, __bucket string")
    ids = spark.range(0, 2000, 7)
    out = maybe_in(docs, "doc_id", ids, "id", "some")
    got = {r.doc_id: r.some for r in out.collect()}
    assert len(got) == 2001 and out.columns == [*docs.columns, "some"]
    assert all(got[i] for i in range(0, 2000, 7)) and sum(got.values()) < 296 and None not in got.values()
    assert "Python" not in out._jdf.queryExecution().toString()
    assert not any(r.some for r in maybe_in(docs, "doc_id", ids.where("id < 0"), "id", "some").collect())
