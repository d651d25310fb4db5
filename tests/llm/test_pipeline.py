"""Each stage of the pipeline against a brute-force version on what its predecessor kept."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

random.seed(3)
VOCAB = [f"v{i}" for i in range(300)]


def _text(n):
    return " ".join(random.choice(VOCAB) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    passage, item, other, base = _text(60), _text(40), _text(30), _text(150)
    texts = {i: _text(random.randint(40, 120)) for i in range(300)}
    texts |= {i: "win !! now !! " * 30 + str(i) for i in range(300, 400)}
    texts |= {400 + i: f"{_text(50)} {passage} {_text(20)}" for i in range(8)}
    texts |= {420 + i: base.replace(" ", f" z{i} ", 1) for i in range(6)} | {430: base, 431: base}
    texts |= {440: f"{_text(60)} {item} {_text(5)}", 441: _text(30) + " " + item, 450: None, 451: ""}
    texts |= {442: f"{_text(900)} {other} {_text(600)}"}  # under a twentieth
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s0", len(t or ""), i * 2) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(not 300 <= i < 400), 0) for i in texts if i < 400], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "never here at all"), (3, other.upper())], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_stages(spark, tables):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, tables))
        kept.append({r.doc_id: r for r in docs.collect()})
        if len(kept) < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    quality, near, cut, clean, ids = kept
    assert not set(range(300, 400)) & set(quality) and set(range(300)) <= set(quality)

    sets = {i: {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} for i, r in quality.items() if (w := _words((r.text or "").lower()))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert set(near) == {i for i in quality if i not in sets or find(i) == i}
    assert len([i for i in near if 420 <= i <= 431]) == 1

    first: dict[tuple, int] = {}
    for i, r in sorted(near.items()):
        w = _words(r.text)
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    for i, r in near.items():
        w, gone = _words(r.text), set()
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone |= set(range(p, p + 13))
        want = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else r.text
        assert cut[i].text == want and cut[i].n_chars == (len(want) if want is not None else 0)
    assert set(cut) == set(near) and any(cut[i].text != near[i].text for i in cut)
    plain = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").lower()) for i, r in cut.items()}
    held = {tuple(w[p : p + 13]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect() for w in [re.findall(r"\w+", r.text.lower())] for p in range(max(1, len(w) - 12))}
    hit = {i for i, w in plain.items() if any(tuple(w[p : p + k]) in held for k in (4, 13) for p in range(len(w) - k + 1))}
    assert set(cut) - set(clean) == hit and {440, 442} <= hit

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in clean.items():
        want = t.encode(r.text or "", add_special_tokens=False).ids
        assert ids[i].n_tokens == len(want) and ids[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert {r.doc_id for r in corpus_pipeline.run(spark, tables).collect()} == set(ids)


def test_empty_tables_and_repeated_ids(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    spark.read.parquet(f"{tables}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    few = docs.where("doc_id < 3 OR doc_id IN (440, 450)")
    odd = few.unionByName(few.where("doc_id = 1")).unionByName(few.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == [(False, 0), (False, 1), (False, 1), (False, 2), (False, 440), (False, 450), (True, 0)]
    for f in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{f}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{f}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
