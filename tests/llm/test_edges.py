"""Brute-force versions of the classifiers' parts, and rows that are empty, repeated or clash by name."""

from __future__ import annotations

import random
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, toxicity
from tessera.llm.bpe import WIDTH, Codec, encoded, vocabulary_file
from tessera.llm.components import connected
from tessera.llm.labelled import held_out_id
from tessera.llm.token_shards import slots, write_shards
from tessera.llm.toxicity import DRIFT, maximal_segments

random.seed(11)


def test_pairs_of_tokens_by_definition():
    v = Codec(vocabulary_file()).vocabulary
    rng = random.Random(5)
    inner, every = list(v.inner.values()), [*v.inner.values(), *v.final.values()]
    pairs = [(rng.choice(inner), rng.choice(every)) for _ in range(3000)]
    left_of, right_of = set(inner), set(every)
    pairs += rng.sample([p for p in v._joins if p[0] in left_of and p[1] in right_of], 3000)
    for left, right in pairs:
        a, b = v.names[left], v.names[right]
        last = b.endswith(v.suffix) and len(b) > len(v.suffix)
        assert v.stay_apart(left, right) == (v.merged(v.symbols(a + (b[: -len(v.suffix)] if last else b), last)) == [a, b]), (a, b)


def test_traversal_in_arrays_agrees_with_that_of_single_words():
    c = Codec(vocabulary_file())
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("aeinorstlh.,!éü") for _ in range(rng.randint(1, 9))) for _ in range(5000)})
    own = [w.encode() for w in words if len(w.encode()) <= WIDTH]
    ids, begins, counts = c._levels.encode(np.array(own, f"S{WIDTH}").view(np.uint8).reshape(-1, WIDTH))
    got = {x: ids[i : i + n].tolist() for x, i, n in zip(own, begins.tolist(), counts.tolist(), strict=True)}
    named = {"".join(c._bytes[b] for b in x): x for x in own}
    assert got == {named[w]: x for w, x in c.vocabulary.encode_all(named)}


def test_words_are_encoded_as_by_the_library():
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_str(vocabulary_file()), Codec(vocabulary_file())
    # capitals whose lower case lies beyond U+024F, pieces longer than the arrays, contractions, zero bytes, wide spaces
    texts = [f"a{chr(i)}b {chr(i)}. 1{chr(i)}{chr(i)}' q" for i in range(0x300)]
    texts += ["", "\n", "ß×É÷é " * 9, "Aé" * 4000, "it's I'LL o'clock''s", "a\x00b\x00", "x\u2003y\u3000z\x85w\x1cv", "a<|endoftext|>b <| c<|x"]
    rng = random.Random(3)
    texts += ["".join(rng.choice("abcDEé'sStTrevmlld19.,<|>ßÉ×÷ \n\t\x00½œŒ’中ȺẞİΣ") for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    assert [x.tolist() for x in c.encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_plain_words_need_no_memo():
    c = Codec(vocabulary_file())
    c.encode(["Plain words, größer or été 12 times; no word is looked up on its own."])
    assert not c._memo and not c._pieces


def test_stored_ids_are_small(spark, tmp_path, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr("tessera.llm.common.shared_dir", lambda _: f"file://{tmp_path}/stored")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    folder = write_shards(docs, f"{tmp_path}/shards", vocabulary=public_tokenizers.path("word_bpe_49k.json"))
    stored = sum(p.stat().st_size for p in tmp_path.glob("stored/*.parquet"))
    raw = 2 * slots(spark, folder).agg(F.sum("n_tokens")).first()[0]
    assert 0 < stored < 0.53 * raw, (stored, raw, stored / raw)


def test_encoding_of_no_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two", 9, 7), (1, "one two", 9, 7), (None, None, 9, 7)], "doc_id long, text string, id int, n_tokens int")
    assert sorted((r.id or 0, r.n_tokens) for r in encoded(docs).collect()) == [(0, 0), (1, 2), (1, 2)]
    assert encoded(docs.limit(0)).count() == 0


def _by_definition(scores: list[float], lo: int = 0, hi: int | None = None) -> list[tuple[int, int, float]]:
    """The segment of the highest score, then the same on both of its sides."""
    hi = len(scores) if hi is None else hi
    best = None
    for i in range(lo, hi):
        for j in range(i, hi):
            s = sum(scores[i : j + 1])
            if s > 0 and (best is None or s > best[2] + 1e-12):
                best = (i, j, s)
    if best is None:
        return []
    return _by_definition(scores, lo, best[0]) + [best] + _by_definition(scores, best[1] + 1, hi)


def test_all_maximal_segments_by_definition():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(1, 25)
        at = sorted(rng.sample(range(n), rng.randint(0, n)))
        own = [rng.uniform(0.1, 3) for _ in at]
        scores = [-DRIFT] * n
        for i, s in zip(at, own, strict=True):
            scores[i] = s
        got = [(a, b, round(s, 6)) for a, b, s in maximal_segments(at, own)]
        assert got == [(a, b, round(s, 6)) for a, b, s in _by_definition(scores)]


@pytest.fixture(scope="module")
def labelled(spark):
    texts = {i: " ".join(random.choice(["alpha", "beta", "gamma", "delta", "end."]) + str(random.randint(0, 40)) for _ in range(random.randint(20, 60))) for i in range(160)}
    texts |= {i: "win!! $$$ now " * random.randint(5, 20) for i in range(160, 240)}
    texts |= {300: None, 301: ""}
    docs = spark.createDataFrame([*texts.items(), (5, texts[5]), (None, texts[6])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 160), int(i >= 160)) for i in texts if i < 300], "doc_id long, quality int, toxic int")
    return texts, docs, labels


def test_quality_against_one_array(spark, labelled):
    """The same scores from normal equations over one array, and a stepwise fit by its min-max definition."""
    texts, docs, labels = labelled
    got = {r["__id"]: r for r in quality.scored(docs, labels).collect()}
    ids = [i for i in texts if i < 300 and not held_out_id(i)]
    ids += [5] if not held_out_id(5) else []  # a repeated row teaches as often as it is there
    x = quality.statistics([texts[i].encode() for i in ids]).astype(np.float32).astype(float)
    y = np.array([float(i < 160) for i in ids])
    n, d = x.shape
    mean, scale = x.mean(0), np.maximum(np.sqrt(np.maximum((x**2).mean(0) - x.mean(0) ** 2, 0)), 1e-3)
    rng = np.random.default_rng(quality.SEED)
    m = quality.Model(mean, scale, rng.normal(0, 1 / np.sqrt(d), (d, quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES), np.zeros(0), np.array([0.0]), np.array([0.5]))
    f = m.features(x)
    penalty = quality.RIDGE * n * np.eye(f.shape[1])
    penalty[0, 0] = 1e-9
    m.beta = np.linalg.solve(f.T @ f + penalty, f.T @ y)
    r = m.raw(x)
    k = np.clip(((r + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = sorted(set(k))
    place, level = (np.array([v[k == b].mean() for b in bins]) for v in (r, y))
    weight = np.array([(k == b).sum() for b in bins], float)
    fit = [max(min(np.average(level[a : c + 1], weights=weight[a : c + 1]) for c in range(i, len(bins))) for a in range(i + 1)) for i in range(len(bins))]
    own = quality.statistics([(texts[i] or "").encode() for i in texts]).astype(np.float32).astype(float)
    m.knots, m.levels = place, np.array(fit)
    assert np.all(np.diff(fit) >= -1e-12)
    for i, want in zip(texts, m.score(own), strict=True):
        assert got[i].score == pytest.approx(want, abs=2e-3), i
        assert got[i].held_out == held_out_id(i) and got[i].predicted == int(got[i].score >= 0.3)
    assert got[None].held_out and got[None].score == pytest.approx(got[6].score)


def test_classifiers_without_rows_or_labels(spark, labelled):
    _, docs, labels = labelled
    for scored in (quality.scored, toxicity.scored):
        assert scored(docs.limit(0), labels).count() == 0
        plain = scored(docs, labels.limit(0)).select("score").distinct().collect()
        assert all(0 <= r.score <= 1 for r in plain)
        assert scored(docs, labels).count() == docs.count()


def test_hubs_and_others_are_joined(spark, monkeypatch):
    monkeypatch.setattr("tessera.llm.components.HUB", 5)
    rng = random.Random(9)
    edges = [(0, i) for i in range(1, 60)] + [(rng.randint(60, 90), rng.randint(60, 90)) for _ in range(40)] + [(None, 1), (3, 3)]
    root = {i: i for e in edges if None not in e and e[0] != e[1] for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a in root and b in root:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    df = spark.createDataFrame(edges, "x long, y long").orderBy(F.rand(1)).repartition(4)
    assert {r.node: r.root for r in connected(df).collect()} == {i: find(i) for i in root}
