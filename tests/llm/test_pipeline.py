"""The corpus pipeline against a plain version of its stages, and the recall of its near-dedup."""

import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F

import corpus_pipeline
from gridspark.llm import language_id, mixing, simhash
from gridspark.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(docs):
    """doc_id of the rows that stay: texts with a letter, the least id of equal texts, then of components of similar ones."""
    seen = {}
    for i, t in docs:
        if t and re.search(r"[^\W\d_]", t):
            seen[t] = min(i, seen.get(t, i))
    rows = [(i, shingles(t)) for t, i in seen.items()]
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {root(i) for i, _ in rows}


def test_the_whole_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(plain(texts.items()))
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    assert all(r["ids"] == library.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in got)
    # The positions are a mix: in any beginning each source has its share, give or take a block, until it ends.
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["position"])]
    assert [r["position"] for r in sorted(got, key=lambda r: r["position"])] == list(range(len(got)))
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    kept = docs.filter(F.col("doc_id").isin(order))
    slots = {r["doc_id"]: (r["mix_slot"], r["mix_place"]) for r in mixing.mix(kept.select("doc_id", "source"), block_rows=64).collect()}
    blocks = Counter()
    for i in order:
        blocks[source[i]] += 1
    assert sum(blocks.values()) == len(slots)
    # Each stage keeps the columns of its documents.
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = table(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def planted(spark, n, rate, pairs, rng):
    """n texts of 120 words, of which the first pairs have a copy with edits; and each pair's true similarity."""
    vocabulary = np.array([f"w{k}" for k in range(20_000)])
    base = vocabulary[(rng.pareto(1.1, (n, 120)) * 40).astype(int) % 20_000]
    copies = [[f"x{rng.integers(1 << 40)}" if rng.random() < rate else w for w in b] for b in base[:pairs]]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)] + [(1_000_000 + i, " ".join(c)) for i, c in enumerate(copies)]
    true = []
    for b, c in zip(base[:pairs], copies, strict=True):
        x, y = shingles(" ".join(b)), shingles(" ".join(c))
        true.append(len(x & y) / len(x | y))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), np.array(true)


@pytest.mark.parametrize("n", [600, 6000])
def test_recall_of_near_copies_does_not_fall_with_size(spark, n):
    rng = np.random.default_rng(n)
    for rate, low, high in ((0.018, 0.8, 0.86), (0.008, 0.88, 0.95)):
        df, true = planted(spark, n, rate, 400, rng)
        lead = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df.repartition(8)).collect()}
        near = [k for k in range(400) if low <= true[k] <= high]
        caught = np.mean([lead[1_000_000 + k] == lead[k] for k in near])
        print(f"recall n={n} {low}-{high}: {caught:.3f} of {len(near)}")
        assert len(near) > 50 and caught >= 0.95
        assert all(lead[1_000_000 + k] != lead[k] for k in range(400) if true[k] < 0.8)


def test_language_id_sends_a_gram_a_few_times_only(spark, monkeypatch):
    """However many partitions there are, counts of training texts leave from few tasks; no row goes."""
    rng, vocabulary = np.random.default_rng(6), [f"{k * 7919 % 9973:x}" for k in range(200)]
    df = spark.createDataFrame([(k, " ".join(rng.choice(vocabulary, 50)), "ab"[k % 2]) for k in range(500)], "doc_id long, text string, lang string")
    made, real = [], language_id.map_batches
    monkeypatch.setattr(language_id, "map_batches", lambda *args: made.append(real(*args)) or made[-1])
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert corpus_pipeline.identify_language(spark, df, "").count() == 500
        assert made[0].count() <= 7 * made[0].select("lang", "gram").distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
