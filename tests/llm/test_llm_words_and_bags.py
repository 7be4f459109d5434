"""Spelling variants, passage attention and ranked search against plain loops."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from test_llm_operators import SCHEMA, awkward, docs_of, nothing, prose  # noqa: F401

from kinframe.llm import quality, ranking, spelling

# ------------------------------------------------------------------ spelling variants


def near(a, b):
    """One inserted, deleted or replaced code point, by trying."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    out = {}
    for w, n in words.items():
        around = [v for v in words if near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = [form, None, n, len(around), words[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def found_variants(spark, words, **options):
    df = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), **options)
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("burst", [1, 32])
def test_variants_of_a_dense_vocabulary(spark, burst):
    """Few letters, so ways part everywhere, letters repeat and words end inside others."""
    rng = random.Random(5)
    words = {}
    for _ in range(500):
        words["".join(rng.choice("abé") for _ in range(rng.randrange(7, 10)))] = rng.choice([2, 3, 20, 31, 300, 4000])
    stem = "straßenbahn"
    for i in range(len(stem)):
        words[stem[:i] + stem[i + 1 :]] = 2
        words[stem[:i] + "q" + stem[i + 1 :]] = 3
        words[stem[:i] + "q" + stem[i:]] = 2
    words |= {stem: 500, stem + "z": 5000, "aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaaa": 200, "aaaaaaaaaa": 2000}
    assert found_variants(spark, words, burst=burst) == plain_variants(words)


def test_variants_of_very_long_words_and_of_one_hot_half(spark):
    long = "abcdefghij" * 2_000
    words = {long: 40, long[:9_000] + long[9_001:]: 4, long[:100] + "z" + long[101:]: 3, long + "x": 400, "z" + long: 2}
    for i in range(400):  # one first half, many second ones
        words["gemeinsamer" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) * 3] = 2 + i % 30
    assert found_variants(spark, words) == plain_variants(words)


def test_variants_without_words(spark, nothing):
    assert found_variants(spark, {"einsamkeit": 5}) == {"einsamkeit": (None, "einsamkeit", 5, 0, None)}
    assert spelling.variants(spelling.perturbed_words(nothing)).collect() == []


def test_perturbed_words(spark, awkward, monkeypatch):
    monkeypatch.setattr(spelling, "FLUSH", 50)
    rng = random.Random(2)
    texts = {r.doc_id: r.text for r in awkward.collect() if r.doc_id is not None}
    extra = [(100 + i, " ".join(f"{rng.choice(['Größe', 'ÉCLAIRS', 'Verkehrs', 'mitteln'])}{rng.choice('abc')}x{rng.randrange(3)}" for _ in range(200)), "de", "s") for i in range(40)]
    df = awkward.where("doc_id IS NOT NULL").unionByName(docs_of(spark, extra))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert len(texts) < len(rows)
    want = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] += 1
    got = {r.word: r.n for r in spelling.perturbed_words(df).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2} and got


def test_spelling_takes_awkward_rows(spark, awkward):
    rows = spelling.variants(spelling.perturbed_words(awkward)).collect()
    assert all(r.n >= 2 and len(r.word) >= 7 for r in rows)


# ------------------------------------------------------------------ passage attention


def plain_score(m, text):
    """One document, one passage and one unit at a time."""
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text or b"")]
    groups = [words[i : i + quality.PASSAGE] for i in range(0, len(words), quality.PASSAGE)]
    parts = [text[g[0][0] : g[-1][1]] for g in groups] or [b""]
    hidden, gates = [], []
    for number, part in enumerate(parts):
        # The features of a passage do not depend on its document, but for the number of passages.
        x = quality.passages([part])[0][0].astype(float)
        x[-1] = math.log1p(len(parts)) / 5
        h = [math.tanh(sum(x[i] * m.w[i, j] for i in np.flatnonzero(x)) + m.b[j]) for j in range(quality.HIDDEN)]
        t = [math.tanh(sum(h[i] * m.v[i, j] for i in range(quality.HIDDEN))) for j in range(quality.GATE)]
        s = [1 / (1 + math.exp(-sum(h[i] * m.g[i, j] for i in range(quality.HIDDEN)))) for j in range(quality.GATE)]
        hidden.append(h)
        gates.append(sum(m.u[j] * t[j] * s[j] for j in range(quality.GATE)))
    share = [math.exp(e) / sum(math.exp(f) for f in gates) for e in gates]
    z = [sum(a * h[j] for a, h in zip(share, hidden)) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-sum(c * v for c, v in zip(m.c, z)) - m.c0[0])), max(share), len(parts)


def some_model():
    r = np.random.default_rng(4)
    m = quality.untrained(2)
    return quality.Model(m.w, r.normal(size=m.b.shape), m.v * 3, m.g * 3, m.u * 3, r.normal(size=m.c.shape), np.array([0.2]))


def labelled(spark, rng, n):
    """Prose is good; documents with one passage of junk among prose are not."""
    rows, labels = [], []
    for i in range(n):
        text = prose(rng, rng.randrange(20, 400))
        bad = i % 3 == 0
        if bad:
            at = rng.randrange(0, len(text), 7)
            text = text[:at] + " ".join(f"| {rng.choice(['buy', 'now'])}$$$ {rng.randrange(99)} |" for _ in range(40)) + text[at:]
        rows.append((i, text, "en", f"s{i % 2}"))
        labels.append((i, int(not bad)))
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")


def test_gradient_matches_differences():
    rng = random.Random(1)
    x, bags = quality.passages([prose(rng, 150).encode(), b"", b"a | b $$$ " * 90])
    x, y, m = x.astype(float), np.array([1.0, 0.3, 0.0]), some_model()
    _, grad = m.gradient(x, bags, y, 0.01)
    r = np.random.default_rng(0)
    for part in quality.PARTS:
        a = getattr(m, part)
        flat = np.flatnonzero(np.abs(getattr(grad, part)).reshape(-1) > 1e-6)
        for i in r.choice(flat, min(5, len(flat)), replace=False):
            losses = []
            for step in (1e-5, -1e-5):
                b = a.copy()
                b.reshape(-1)[i] += step
                losses.append(quality.Model(**{k: b if k == part else getattr(m, k) for k in quality.PARTS}).gradient(x, bags, y, 0.01)[0])
            assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(getattr(grad, part).reshape(-1)[i], rel=1e-3, abs=1e-8)


def test_scores_match_plain_forward_pass(spark, awkward, monkeypatch):
    monkeypatch.setattr(quality, "SCORE_SLICE", 3_000)
    m = some_model()
    rows = quality.score(awkward, m, ["doc_id", "text", "state"]).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        if len(r.text or "") > 500_000:
            assert 0 <= r.score <= 1 and r.n_passages >= 1
            continue
        p, share, n = plain_score(m, r.text.encode() if r.text is not None else None)
        assert (r.score, r.top_share, r.n_passages) == (pytest.approx(p, abs=1e-5), pytest.approx(share, abs=1e-5), n)
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.top_passage < r.n_passages


def test_attention_learns_and_finds_the_passage(spark):
    docs, labels = labelled(spark, random.Random(8), 240)
    model = quality.train(docs.where("doc_id < 160"), labels)
    rows = quality.score(docs, model, ["doc_id", "text"]).collect()
    held = [r for r in rows if r.doc_id >= 160]
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) >= 0.95 * len(held)
    junk = [r for r in held if r.doc_id % 3 == 0 and r.n_passages > 3]
    hit = [r for r in junk if "$$$" in " ".join(r.text.split()[64 * r.top_passage : 64 * (r.top_passage + 1)])]
    assert len(hit) >= 0.7 * len(junk) > 0


def test_training_sample_is_bounded(spark, awkward, nothing):
    docs, labels = labelled(spark, random.Random(9), 60)
    docs = docs.unionByName(docs).unionByName(awkward)
    labels = labels.unionByName(spark.createDataFrame([(27, 1), (None, 1), (3, None), (5, 0), (5, 1)], labels.schema))
    rows = quality.training_sample(docs, labels, max_docs=20, max_bytes=20_000).collect()
    assert 0 < len({r.place for r in rows}) <= 20
    assert sum(len(t or "") for t in {r.text for r in rows}) <= 20_000
    model = quality.train(docs, labels, max_docs=20, max_bytes=20_000, steps=5)
    assert quality.score(docs, model, ["doc_id"]).count() == docs.count()
    for empty in (quality.train(nothing, labels), quality.train(docs, labels.limit(0))):
        assert {r.score for r in quality.score(awkward, empty, ["doc_id"]).collect()} == {0.5}
    assert quality.score(nothing, model, ["doc_id"]).collect() == []


def test_reruns_agree(spark):
    docs, labels = labelled(spark, random.Random(10), 60)
    once, again = (sorted((r.doc_id, r.score) for r in quality.held_out_split(docs, labels).collect()) for _ in range(2))
    assert once == again and {i for i, _ in once} == set(range(60))


# ------------------------------------------------------------------ ranked search


def plain_ranking(rows, items, k):
    """Every document scored for every item."""
    split = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(i, collections.Counter(split(t)), len(split(t))) for i, t in rows]
    docs = [d for d in docs if d[2]]
    total, words = len(docs), sum(d[2] for d in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, collections.Counter()).update(split(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, n in docs:
            m = 25 + (75 * n * total) // words
            s = sum(times * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in terms.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, place + 1, i, -s) for place, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def shelf(spark, awkward):  # noqa: F811
    rng = random.Random(12)
    rows = [(200 + i, prose(rng, rng.randrange(1, 300), 60 if i % 4 else 4000), "en", "s") for i in range(400)]
    rows += [(900 + i, rows[3][1], "en", "s") for i in range(30)]
    return awkward.unionByName(docs_of(spark, rows))


def questions(spark, rng, n):
    rows = [(i, prose(rng, rng.randrange(1, 40), 3000)) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "?!"), (3, "word3 word4 WORD5 unheardof"), (None, "word7 word900"), (n + 3, "word0 word0 word1"), (n + 4, "Ünï 你好")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize(
    "shard_bytes, short, max_terms, k",
    [(16 << 20, 1 / 16, 200_000, 10), (40_000, 1 / 16, 200_000, 10), (40_000, 0.0, 60, 3), (16 << 20, 1.0, 200_000, 10), (10_000, 0.3, 200_000, 1), (16 << 20, 0.0, 200_000, 500)],
)
def test_search_matches_plain_scores(spark, shelf, shard_bytes, short, max_terms, k, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE", 64)
    items = questions(spark, random.Random(13), 20)
    index = ranking.build_index(shelf, shard_bytes, shard_docs=150 if shard_bytes < 20_000 else 60_000)
    got = [tuple(r) for r in ranking.search(index, items, k, max_terms, short).select("item_id", "rank", "doc_id", "score").collect()]
    want = plain_ranking([(r.doc_id, r.text) for r in shelf.collect()], [(r.item_id, r.text) for r in items.collect()], k)
    assert sorted(got, key=str) == want and len(want) > 20


def test_ranges_are_skipped_without_loss():
    """Many documents, few of them good: results equal plain sums for every split of lists."""
    rng = np.random.default_rng(3)
    n, edges = 6_000, np.append(np.arange(0, 6_000, ranking.RANGE), 6_000)
    tie = rng.permutation(n)
    lists = []
    for share in (0.9, 0.5, 0.4, 0.02, 0.01, 0.001):
        docs = np.flatnonzero(rng.random(n) < share)
        lists.append((ranking.Posting(docs, rng.integers(1, 50, len(docs)) ** 2, edges), int(rng.integers(1, 90))))
    total = np.zeros(n, np.int64)
    for p, w in lists:
        total[p.docs] += w * p.impact
    order = np.lexsort((tie, -total))
    for short in (0, 0.005, 0.05, 0.6, 1):
        docs, scores = ranking.best_documents(lists, edges, 10, tie, short)
        assert docs.tolist() == order[:10].tolist() and scores.tolist() == total[order[:10]].tolist()


def test_search_of_nothing(spark, shelf, nothing):
    items = questions(spark, random.Random(14), 3)
    assert ranking.ranked_search(nothing, items).collect() == []
    assert ranking.ranked_search(shelf, items.limit(0)).collect() == []
    assert ranking.ranked_search(shelf, spark.createDataFrame([(1, "unheardof")], items.schema)).collect() == []
