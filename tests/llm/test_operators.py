"""The operators against plain versions of themselves, and on awkward rows."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridspark.llm import chat, exact_dedup, katz, language_id, mixing, quality, queries, sentencepiece_codec, simhash, token_counts, url_filter, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 4000
AWKWARD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "same text here", "en", "a"), (4, "same text here", None, "b"), (4, "same text here", None, "b"), (None, "same text here", "en", None),
    (None, "no id", "de", "a"), (5, " \n\t ", "en", "a"), (6, LONG, "en", "a"), (7, LONG + "x", "en", "a"), (8, "12345 !!", "en", "a"), (9, "é à ▁  <|endoftext|> \u3000 x", "fr", "a"), (9, "other text, same id", "fr", "a"),
]


def low(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeats, empty and long texts, and columns whose names clash with inner ones."""
    rows = [(*r, "x", 1) for r in AWKWARD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, digest string, pid int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def rows(df):
    return [r.asDict() for r in df.collect()]


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def test_slices_are_read_right():
    t = pq.read_table(f"{SF}/documents.parquet")["text"].combine_chunks()
    part = t.slice(77, 40)
    assert words.words(part, True)[0].to_pylist() == [w for x in part.to_pylist() for w in WORD.findall(low(x))]


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(docs, odd, none, keep):
    for df in (docs, odd, none):
        got = rows(exact_dedup.exact_dedup(df, keep=keep))
        groups = defaultdict(list)
        for i, t in texts(df):
            groups[hashlib.sha256(t.encode()).hexdigest()].append(i)
        assert Counter((r["doc_id"], r["text_sha256"]) for r in got) == Counter((i, s) for s, g in groups.items() for i in g)
        for r in got:
            g = [i for i in groups[r["text_sha256"]] if i is not None]
            assert r["group_size"] == len(groups[r["text_sha256"]]) and r["keep_id"] == ((max if keep == "max" else min)(g) if g else None)
        kept = [r for r in got if r["kept"]]
        assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_dedup_groups_over_many_partitions(spark):
    df = spark.range(0, 4000, 1, 40).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id % 7) END AS text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        got = rows(exact_dedup.exact_dedup(df))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 4000 and sum(r["kept"] for r in got) == 8 and {r["group_size"] for r in got if r["doc_id"] % 3 == 0} == {1334}
    assert {r["keep_id"] for r in got if r["doc_id"] % 3 == 0} == {0}


def test_exact_copies_go(docs, odd):
    for df in (docs, odd):
        out = exact_dedup.drop_exact_copies(df)
        assert out.columns == df.columns
        assert sorted(t for _, t in texts(out)) == sorted({t for _, t in texts(df)})


def test_mixing(spark, docs, odd, none):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 's0' WHEN id % 7 = 0 THEN null ELSE concat('s', id % 5) END AS source", "'x' AS period")
    got = rows(mixing.mix(df, block_rows=4))
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    assert len({(r["mix_slot"], r["mix_place"]) for r in got}) == 3000
    share = {r["source"]: r["share"] / r["period"] for r in rows(mixing.target_shares(df))}
    assert math.isclose(sum(share.values()), 1)
    by = defaultdict(dict)
    for r in got:
        by[r["source"] or ""][r["mix_block"]] = r["mix_slot"]
        assert r["mix_release"] <= r["mix_slot"] < r["mix_deadline"]
    for source, blocks in by.items():  # less than one block from the target at any time
        for b, slot in blocks.items():
            assert abs((slot + 1) * share[source] - b) < 1 + 1e-9
    # A plain earliest-deadline-first simulation gives the same slots.
    sizes, period = {s: round(w * 1000) for s, w in share.items()}, 1000
    done, plan = dict.fromkeys(sizes, 0), {}
    for t in range(period):
        ready = [(-(-(done[s] + 1) * period // n), -n, s) for s, n in sizes.items() if done[s] < n and done[s] * period // n <= t]
        s = min(ready)[2]
        done[s] += 1
        plan[s, done[s]] = t
    assert all(plan[s, b] == slot for s, blocks in by.items() for b, slot in blocks.items() if (s, b) in plan)
    clash = df.limit(50).withColumn("mix_slot", F.lit("mine"))
    assert {type(r["mix_slot"]) for r in mixing.mix(clash).collect()} == {int}
    for df in (docs, odd, none):
        out = mixing.mixed_order(df)
        assert out.columns == df.columns and Counter(map(str, out.collect())) == Counter(map(str, df.collect()))


def test_mixing_leaves_out_sources_without_a_weight(spark):
    df = spark.range(100).selectExpr("id AS doc_id", "concat('s', id % 4) AS source")
    assert {r["source"] for r in rows(mixing.mix(df, weights={"s0": 3, "s1": 1}))} == {"s0", "s1"}


def plain_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return low(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_url_filter(spark):
    pages = spark.read.parquet(f"{SF}/../sf0.01/pages.parquet")
    odd = spark.createDataFrame([(900001, None), (900002, "no scheme"), (900003, "HTTP://WWW.Example.COM/en/1?x#y"), (900004, "x://com"), (900005, "x://É.com/a://b"), (900001, None)], "page_id bigint, url string")
    df = pages.select("page_id", "url").unionByName(odd)
    got = rows(url_filter.filter_urls(df, queries.URL_RULES))
    urls = [(r["page_id"], r["url"]) for r in df.collect()]
    assert Counter(r["page_id"] for r in got) == Counter(i for i, _ in urls)
    urls = dict(urls)
    order, said, parsed = 4, {}, {}
    for r in got:
        host, path = parsed[r["page_id"]] = plain_url(urls[r["page_id"]])
        fits = [(len(x), x, v) for v, x in queries.URL_RULES if (host == x.partition("/")[0] or host.endswith("." + x.partition("/")[0])) and path.startswith("/" + x.partition("/")[2])]
        _, rule, said[r["page_id"]] = max(fits, default=(0, None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
    # The models, by plain counting.
    counts, seen = {v: Counter() for v in ("allow", "block")}, Counter((*parsed[r["page_id"]], said[r["page_id"]]) for r in got)
    gram = lambda h, p: "\x02" * order + (h + p).translate(str.maketrans("123456789", "0" * 9)) + "\x03"
    held = lambda h, p: zlib.crc32((h + p).encode()) % 5 == 0
    for (h, p, v), n in seen.items():
        if v and not held(h, p):
            t = gram(h, p)
            for i in range(order, len(t)):
                for k in range(order + 1):
                    counts[v][t[i - k : i], t[i]] += n
    tot, kinds = ({v: Counter() for v in counts} for _ in range(2))
    for v, c in counts.items():
        for (ctx, _), n in c.items():
            tot[v][ctx] += n
            kinds[v][ctx] += 1

    def prob(v, ctx, ch):
        below = prob(v, ctx[1:], ch) if ctx else 1 / 256
        return (counts[v][ctx, ch] + kinds[v][ctx] * below) / (tot[v][ctx] + kinds[v][ctx]) if tot[v][ctx] else below

    def score(h, p):
        t = gram(h, p)
        return sum(math.log(prob("allow", t[i - order : i], t[i])) - math.log(prob("block", t[i - order : i], t[i])) for i in range(order, len(t))) / (len(t) - order)

    open_ = [r for r in got if r["rule"] is None]
    assert open_ and all(math.isclose(r["score"], score(r["host"], r["path"]), rel_tol=1e-6, abs_tol=1e-9) for r in open_)
    blocked, allowed = ([r["score"] for r in open_ if r["verdict"] == v] for v in ("block", "allow"))
    assert not blocked or not allowed or max(blocked) < min(allowed)
    assert all(r["verdict"] == said[r["page_id"]] for r in got if r["rule"])
    assert {r["verdict"] for r in rows(url_filter.filter_urls(odd.limit(2), queries.URL_RULES))} == {"allow"}
    assert rows(url_filter.filter_urls(odd.limit(0), queries.URL_RULES)) == []


@pytest.mark.parametrize("chunk", [64, 1000, 32768])
def test_sentencepiece(docs, odd, none, chunk):
    model = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    for df in (docs.limit(60), odd.filter(F.length("text") < 5000) if chunk == 64 else odd, none):
        df = df.select("doc_id", F.col("text").alias("text"), F.lit(1).alias("row")).cache()
        got = Counter((r["doc_id"], tuple(r["ids"]), r["n_tokens"]) for r in rows(sentencepiece_codec.encode(df, model, chunk=chunk)))
        assert got == Counter((i, tuple(library.encode(t)), len(library.encode(t))) for i, t in texts(df))
    back = rows(sentencepiece_codec.encode(odd, model, chunk=chunk))
    assert all(r["round_trip"] for r in back if r["doc_id"] not in (9,))


def test_sentencepiece_without_spaces(spark):
    model = tokenizer_path("piece_bpe_32k.model")
    rng = np.random.default_rng(0)
    text = ["".join(rng.choice(list("theinga"), 5000)), "a" * 999, "▁" * 50 + " " * 777, "é" * 300 + "日本" * 100]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id bigint, text string")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    assert {r["doc_id"]: r["ids"] for r in rows(sentencepiece_codec.encode(df, model, chunk=100))} == {i: library.encode(t) for i, t in enumerate(text)}


def plain_katz(pairs):
    held = {k: zlib.crc32(str(i).encode()) % 7 == 2 for k, (i, _) in enumerate(pairs)}
    toks = [[*WORD.findall(low(t)), "\n"] for _, t in pairs]
    uni, bi = Counter(), Counter()
    for k, t in enumerate(toks):
        if not held[k]:
            uni.update(t)
            bi.update(zip([" ", *t], t))
    n, v, d = sum(uni.values()), len(uni), sum(not h for h in held.values())
    disc = katz.discounts([sum(c == r for c in bi.values()) for r in range(1, 7)])
    of = defaultdict(dict)
    for (a, b), c in bi.items():
        of[a][b] = c
    base = lambda w: (uni[w] + 1) / (n + v + 1)
    hist = lambda a: d if a == " " else uni[a]

    def seen(a, b):
        c = of[a][b]
        total = hist(a) + (all(x > 5 for x in of[a].values()))
        return (disc[c - 1] if c <= 5 else 1) * c / total

    def prob(a, b):
        if not hist(a):
            return base(b)
        if b in of[a]:
            return seen(a, b)
        return (1 - sum(seen(a, x) for x in of[a])) / (1 - sum(map(base, of[a]))) * base(b)

    return held, toks, uni, n, base, prob


def test_katz(docs, odd, none):
    for df in (docs, odd.filter("doc_id IS NOT NULL")):
        pairs = texts(df)
        held, toks, uni, n, base, prob = plain_katz(pairs)
        want = sorted((i, held[k], len(t), sum(uni[w] > 0 for w in t), n, round(sum(math.log10(base(w)) for w in t), 5), round(sum(math.log10(prob(a, b)) for a, b in zip([" ", *t], t)), 4)) for k, ((i, _), t) in enumerate(zip(pairs, toks)))
        got = sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 4)) for r in rows(katz.score_documents(df)))
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-6, atol=1e-3)
        a = next(w for w in uni if w != "\n")
        assert math.isclose(sum(prob(a, b) for b in uni) + prob(a, "never seen"), 1, rel_tol=1e-9)
    assert rows(katz.score_documents(none)) == []
    assert len(rows(katz.score_documents(odd))) == len(AWKWARD)


def test_katz_deals_out_frequent_contexts(spark):
    df = spark.range(400).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60), k -> concat_ws(' ', 'the', concat('w', (id * 61 + k * k) % 700)))) AS text")
    pairs = texts(df)
    held, toks, uni, n, base, prob = plain_katz(pairs)
    got = {r["doc_id"]: r["score"] for r in rows(katz.score_documents(df))}
    for (i, _), t in list(zip(pairs, toks))[:40]:
        assert math.isclose(got[i], sum(math.log10(prob(a, b)) for a, b in zip([" ", *t], t)), rel_tol=1e-6)


def test_katz_packing():
    a = [np.array([0, 5, 2**40]), np.array([], np.int64), np.array([0.5, -1e300])]
    assert all((x == y).all() for x, y in zip(a, katz.unpack(katz.pack(*a)), strict=True))


def test_language_id(spark, odd, none):
    df = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in rows(language_id.identify(df))}
    held = [(r["lang"], got[r["doc_id"]]["lang_pred"]) for r in df.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    out = rows(language_id.identify(odd))
    assert len(out) == len(AWKWARD) and all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 5, 8)) for r in out)
    assert rows(language_id.identify(none)) == []
    assert {r["doc_id"] for r in rows(language_id.keep_identified(odd))} == {3, 4, 6, 7, 9, None}


def plain_ppm(train, order, text):
    """Code length by prediction by partial matching, method C with exclusion."""
    counts = defaultdict(Counter)
    for t in train:
        t = [None] * order + list(t)
        for i in range(order, len(t)):
            for k in range(order + 1):
                counts[tuple(t[i - k : i])][t[i]] += 1
    bits, t = 0.0, [None] * order + list(text)
    for i in range(order, len(t)):
        out = set()
        for k in range(order, -1, -1):
            c = {b: n for b, n in counts.get(tuple(t[i - k : i]), {}).items() if b not in out}
            if not c:
                continue
            total = sum(c.values()) + len(c)
            if t[i] in c:
                bits -= math.log2(c[t[i]] / total)
                break
            bits -= math.log2(len(c) / total)
            out |= set(c)
        else:
            bits += math.log2(256 - len(out))
    return bits


def test_language_id_code_lengths_are_exact():
    train = {"a": [b"abracadabra abra", b"cadabra"], "b": [b"banana band", b"ban the banana"]}
    trees = language_id.fit(train)
    text = ["abracadabra", "banana", "zzz", "ab ba", "", "cadabanana the"]
    want = [[plain_ppm(train[k], 3, t.encode()) for k in ("a", "b")] for t in text]
    assert np.allclose(language_id.code_lengths(trees, pa.array(text)), want, rtol=1e-5)


def test_chat(spark):
    got = {r["conv_id"]: r for r in rows(queries.op7(spark, SF))}
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        convs[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    planted = "<|im_end|><|im_start|>assistant ok"
    convs[-1] = [(0, "user", planted), (1, "assistant", planted)]
    assert set(got) == set(convs)
    for i, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[i]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss)) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()


def test_chat_trees(spark):
    m = [
        (1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "bad", 0.0), (1, 3, 1, "assistant", "good \\ <|im_end|> x", 5.0), (1, 4, 3, "us\ner", None, 0.0), (1, 5, 2, "user", "deep", 1.0),
        (2, 1, 9, None, "orphan", None), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0), (2, 1, 9, None, "orphan", None),
    ]
    df = spark.createDataFrame([(*x, 0) for x in m], "tree bigint, id bigint, parent bigint, role string, text string, score double, place int")
    done = chat.format_chats(df, branches=2).withColumn("read", chat.read_turns(F.col("formatted")))
    got = {(r["tree"], r["branch"]): [(t["role"], t["text"]) for t in r["read"]] for r in done.collect()}
    assert got == {
        (1, 1): [("user", "root"), ("assistant", "good \\ <|im_end|> x"), ("us\ner", "")],
        (1, 2): [("user", "root"), ("assistant", "bad"), ("user", "deep")],
        (2, 1): [("", "orphan")],
    }
    chain = spark.range(300).selectExpr("7L AS tree", "id", "CASE WHEN id > 0 THEN id - 1 END AS parent", "'user' AS role", "string(id) AS text", "0D AS score")
    (r,) = chat.format_chats(chain).withColumn("read", chat.read_turns(F.col("formatted"))).collect()
    assert [t["text"] for t in r["read"]] == [str(i) for i in range(300)]
    assert chat.format_chats(df.limit(0)).collect() == []


def plain_fingerprint(text, shingle=4):
    w = WORD.findall(low(text))
    sh = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, odd, none):
    for df in (docs, odd):
        got = rows(simhash.near_duplicates(df, shingle=4, radius=4))
        pairs = texts(df)
        fp = [plain_fingerprint(t) for _, t in pairs]
        label = list(range(len(pairs)))
        changed = True
        while changed:
            changed = False
            for i in range(len(fp)):
                for j in range(i):
                    if bin(fp[i] ^ fp[j]).count("1") <= 4 and label[i] != label[j]:
                        label[i] = label[j] = min(label[i], label[j])
                        changed = True
        lead = {}
        for k, (i, _) in enumerate(pairs):
            if i is not None:
                lead[label[k]] = min(i, lead.get(label[k], i))
        want = Counter((i, f"{fp[k]:016x}", lead.get(label[k])) for k, (i, _) in enumerate(pairs))
        assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert rows(simhash.near_duplicates(none)) == []


def test_simhash_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    v = np.concatenate([base ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64) for _ in range(k)]) for k in range(1, 9)])
    for group in (np.zeros(len(v)), np.sort(rng.integers(0, 30, len(v)))):
        for radius in (3, 4, 7, 12):
            i, j = simhash.close_pairs(v, group, radius)
            want = {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if group[a] == group[b] and bin(int(v[a] ^ v[b])).count("1") <= radius}
            assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


def test_near_copies_go(spark, odd, none):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [list(rng.choice(vocabulary, 300)) for _ in range(40)]
    copies = []
    for k, b in enumerate(base):
        for c in range(3):
            x = list(b)
            for at in rng.choice(300, 2 + c, replace=False):
                x[at] = rng.choice(vocabulary)
            copies.append((1000 * (c + 1) + k, " ".join(x)))
    df = spark.createDataFrame([(k, " ".join(b)) for k, b in enumerate(base)] + copies, "doc_id bigint, text string")
    left = {r["doc_id"] for r in simhash.drop_near_copies(df).collect()}
    assert left >= set(range(40)) and len(left) <= 42
    out = simhash.drop_near_copies(odd)
    assert out.columns == odd.columns and rows(simhash.drop_near_copies(none)) == []


def test_quality(spark, odd, none):
    df = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/../sf0.01/labels.parquet").collect()}
    for d in (df, odd):
        got = rows(quality.quality(d))
        want = []
        for i, t in texts(d):
            w = WORD.findall(t)
            grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
            n = Counter(grams)
            rep = {k + x for k, g in enumerate(grams) if n[g] > 1 for x in range(3)}
            seen, dup = set(), 0
            for line in t.split("\n"):
                if WORD.search(line):
                    dup += line in seen
                    seen.add(line)
            want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)))
        keys = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert Counter(tuple(r[k] for k in keys) for r in got) == Counter(want)
        assert not any(r["kept"] for r in got if r["base_failed"])
        if d is df:
            passed = [(labels[r["doc_id"]], r["kept"]) for r in got if r["doc_id"] in labels and not r["base_failed"]]
            assert np.mean([k for q, k in passed if q == 1]) > 0.98 and np.mean([k for q, k in passed if q == 0]) < 0.1
    assert rows(quality.quality(none)) == []


def test_quality_scatter_is_robust(spark):
    rng = np.random.default_rng(1)
    good, bad = rng.normal(5, 1, (4000, 5)), rng.normal(40, 1, (800, 5))
    df = spark.createDataFrame([("g", [float(v) for v in x]) for x in np.concatenate([good, bad])], "grp string, x array<double>")
    (r,) = quality.scatter(df, 4).collect()
    cov = np.linalg.inv(np.array(r["inverse"]).reshape(5, 5))
    assert np.allclose(r["centre"], 5, atol=0.1) and np.allclose(np.diag(cov), 1, atol=0.3)


def test_token_counts(docs, odd, none):
    model = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(model)
    for df in (docs, odd, none):
        got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows(token_counts.count_tokens(df, model, 512)))
        n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
        assert got == Counter((i, len(t.encode()), n(t), n(t) > 512) for i, t in texts(df))


def test_token_counts_of_odd_texts():
    model = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(model)
    t = ["  a\n b \n c ", "a\n \nb", "\u00a0 x\u3000 y", "foo \n", " foo", "foo  bar<|endoftext|>  ", "aaaaaaaaaaa", "don't I'LL", "\u200b x \u180e y", "x" * 3000, "日本語 тест 😀", ""]
    assert token_counts.Merges(model).tokens(pa.array(t)).tolist() == [len(library.encode(x, add_special_tokens=False).ids) for x in t]


def test_queries_keep_their_names():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{k}" for k in range(1, 11)] and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    json.dumps(queries.ORACLE_SQL)


def edited(rng, words, share):
    """The words with runs of single changes, one in about 1 / share places."""
    return [f"x{rng.integers(1 << 40)}" if rng.random() < share else w for w in words]


def shingle_set(text, shingle=5):
    w = WORD.findall(low(text))
    return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()


def test_near_copies_are_those_of_whole_shingle_sets(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = list(rng.choice(vocabulary, 60))
    pairs, i = [], 0
    for _ in range(300):
        base = list(rng.choice(vocabulary, 150)) + passage
        pairs.append((" ".join(base), " ".join(edited(rng, base, 0.027))))
    text = [t for pair in pairs for t in pair]
    j = [len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b)) for a, b in pairs]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id bigint, text string")
    lead = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    near = [k for k in range(300) if 0.8 <= j[k] < 0.83]
    assert len(near) > 20 and np.mean([lead[2 * k + 1] == 2 * k for k in near]) >= 0.95
    far = [k for k in range(300) if 0.7 <= j[k] < 0.8]
    assert len(far) > 50 and all(lead[2 * k + 1] == 2 * k + 1 for k in far)


def test_near_copies_of_a_large_bucket(spark):
    """Many texts share their rarest shingles, most of them less than similar: a forest of links isn't enough."""
    rng = np.random.default_rng(12)
    base = [f"w{k}" for k in range(300)]
    text = [" ".join(edited(rng, base, rng.choice([0.002, 0.01, 0.02, 0.04]))) for _ in range(150)]
    s = [shingle_set(t) for t in text]
    label = list(range(len(s)))
    for a in range(len(s)):
        for b in range(a):
            if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]) and label[a] != label[b]:
                x, y = sorted((label[a], label[b]))
                label = [x if v == y else v for v in label]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df, radius=128).collect()}
    assert 1 < len(set(label)) < len(label) and got == dict(enumerate(label))


def test_encodings_keep_the_order_of_the_mix(spark, docs, tmp_path):
    """Files and rows of the mix, in their order, are the positions of the last stage: giants and repeats included."""
    df = docs.unionByName(docs.limit(50).withColumn("text", F.repeat(F.lit("far too long a text "), 2500))).repartition(7)
    path = str(tmp_path / "mixed")
    mixing.mixed_order(df, block_rows=4).write.parquet(path)
    want = [(r["doc_id"], r["text"]) for f in sorted(tmp_path.glob("mixed/part-*")) for r in pq.read_table(f, columns=["doc_id", "text"]).to_pylist()]
    got = sorted(corpus_pipeline.encode(spark, spark.read.parquet(path), "").collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(df.count()))
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert [(r["doc_id"], r["decoded_sha256"]) for r in got if r["round_trip"]] == [(i, digest(t)) for (i, t), r in zip(want, got, strict=True) if r["round_trip"]]
    # The first slots of each source, in any stretch, are its share of the mix.
    share = {r["source"]: r["share"] / r["period"] for r in rows(mixing.target_shares(df))}
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    start = Counter(source[r["doc_id"]] or "" for r in got[:200])
    assert all(abs(start[s] - 200 * w) <= 8 for s, w in share.items())


def test_chat_keeps_a_null_tree(spark):
    rows_ = [(None, 1, None, "user", "a", 0.0), (None, 2, 1, "assistant", "b", 1.0), (None, 3, 1, "assistant", "c", 2.0), (None, 4, 3, "user", "d", 2.0), (7, 1, None, "user", "e", 0.0)]
    df = spark.createDataFrame(rows_, "tree bigint, id bigint, parent bigint, role string, text string, score double")
    assert {r["tree"]: r["n_turns"] for r in chat.format_chats(df).collect()} == {None: 3, 7: 1}
    plain = df.filter("id <= 2")
    assert {r["tree"]: r["n_turns"] for r in chat.format_chats(plain, ids_unique=True).collect()} == {None: 2, 7: 1}


def test_near_copies_of_other_rows_stay(spark):
    """Rows that repeat an id, or have none, go only as copies of a text, one by one."""
    rng = np.random.default_rng(5)
    a, b, c, d, e = (" ".join(f"w{k}" for k in rng.integers(0, 9000, 200)) for _ in range(5))
    data = [(1, a), (9, a + " x"), (9, b), (None, a + " y"), (None, c), (7, d), (7, e), (7, e), (None, c), (2, None), (3, ""), (None, " \n")]
    df = spark.createDataFrame([(*r, 5) for r in data], "doc_id bigint, text string, id int")
    out = simhash.drop_near_copies(df)
    assert out.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(1, a), (9, b), (None, c), (7, d), (7, e), (2, None)])


def test_simhash_of_a_hot_fingerprint(spark):
    """A third of all rows has one fingerprint, and a star of near ones has one centre."""
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'one hot text of some words' ELSE concat('t', id, ' u', id * 7, ' v', id % 11) END AS text")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, radius=2).collect()}
    assert len(got) == 3000 and {got[i] for i in range(0, 3000, 3)} == {got[0]}


def test_exact_dedup_ranges_follow_bytes():
    found = sorted([(b"a", 3), (b"abc", 1), (b"abd", 9), (b"hot" * 50, 1), (b"hot" * 50, 2), (b"hot" * 50, 7), (b"z", 0)])
    bounds = exact_dedup.cut(found, 7)
    assert bounds == sorted(bounds) and (b"hot" * 50, 2) in bounds and all(len(t) < 4 for t, i in bounds if i < 0)
    pid = exact_dedup._ranges(bounds, pa.array([t.decode() for t, _ in found]), pa.array([i for _, i in found]), 1).to_pylist()
    assert pid == sorted(pid) and len(set(pid)) == len(bounds) + 1


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_copies_over_many_ranges(spark, keep):
    """A hot text over many ranges and batches; ids that repeat or are null; names that clash."""
    df = spark.range(0, 3000, 1, 30).selectExpr(
        "CASE WHEN id % 50 = 1 THEN null WHEN id % 50 = 2 THEN id - 1000 ELSE id END AS doc_id",
        "CASE WHEN id % 3 = 0 THEN repeat('hot', 40) WHEN id % 7 = 0 THEN null WHEN id % 7 = 1 THEN '' ELSE concat('t', id % 200) END AS text", "id AS pid", "'x' AS txt")
    best = {}
    rank = lambda i: (i is None, i if keep == "min" else -(i or 0))
    for i, t in texts(df):
        best[t] = min(best.get(t, (None, None)), rank(i), key=lambda r: (r[0] is None, r))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        out = exact_dedup.drop_exact_copies(df, keep=keep)
        assert out.columns == df.columns
        got = texts(out)
        marked = Counter(r["text_sha256"] for r in rows(exact_dedup.exact_dedup(df, keep=keep)) if r["kept"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(got) == len(best) and all(rank(i) == best[t] for i, t in got)
    assert marked == Counter(hashlib.sha256(t.encode()).hexdigest() for t in best)


def test_language_id_learns_from_long_texts(spark):
    """A language that has long texts only is learned all the same, in one pass or in several."""
    rng = np.random.default_rng(2)
    def some(letters, n):
        return " ".join("".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(n))
    data = [(i, some("abcde", 20), "aa") for i in range(40)] + [(100 + i, some("vwxyz", 4000), "zz") for i in range(40)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string").repartition(4)
    for size in (language_id.TREE_BYTES, 1):
        before, language_id.TREE_BYTES = language_id.TREE_BYTES, size
        try:
            got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
        finally:
            language_id.TREE_BYTES = before
        assert all(got[i]["lang_pred"] == lang and 0.99 < got[i]["score"] <= 1 for i, _, lang in data)


@pytest.mark.parametrize("long", [None, 200])
def test_language_id_counts_do_not_follow_the_partitions(spark, monkeypatch, long):
    """Texts of a language are counted together: a gram doesn't leave once from each of many partitions. A large group of copies counts once."""
    rng, words_ = np.random.default_rng(5), [f"{k * 7919 % 9973:x}" for k in range(200)]
    data = [(k, " ".join(rng.choice(words_, 60 if k % 9 else 30)), "ab"[k % 2]) for k in range(600)]
    df = spark.createDataFrame([*data, *((1000 + k, "one text that is copied", "a") for k in range(400))], "doc_id long, text string, lang string")
    made, real = [], language_id.map_batches
    monkeypatch.setattr(language_id, "map_batches", lambda *args: made.append(real(*args)) or made[-1])
    if long:
        monkeypatch.setattr(language_id, "LONG", long)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = language_id.training_grams(df, F.lit(True), "doc_id", "text", "lang", 400, 3)
        n = made[0].count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for lang in "ab":
        grams, counts = language_id.count_grams(pa.array([t for _, t, x in data if x == lang] + ["one text that is copied"] * (lang == "a"), pa.large_string()), 3)
        assert (got[lang][0] == grams).all() and (got[lang][1] == counts).all()
    if long is None:
        assert n <= 7 * sum(len(g) for g, _ in got.values())


def test_mixing_of_many_sources(spark):
    """More sources than shares, most of them of one share: each has its own slots, within its deadlines."""
    df = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 4 = 0 THEN 'big' ELSE concat('s', id % 1999) END AS source")
    got = rows(mixing.mix(df, block_rows=1, shares=100))
    share = {r["source"]: r["share"] for r in rows(mixing.target_shares(df, shares=100))}
    assert len(share) == 2000 and sum(share.values()) == 2000 and share["big"] == max(share.values())
    assert len(got) == 6000 == len({r["mix_slot"] for r in got}) and all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in got)


def test_mixed_order_depends_on_the_files_alone(spark, docs, tmp_path):
    path, key = str(tmp_path / "docs"), "spark.sql.files.maxPartitionBytes"
    docs.repartition(3).write.parquet(path)
    found = []
    for size in ("128m", "16k"):
        spark.conf.set(key, size)
        try:
            found.append([r["mix_slot"] for r in mixing.mix(spark.read.parquet(path), block_rows=4, by_id=False).orderBy("doc_id", "mix_slot").collect()])
        finally:
            spark.conf.unset(key)
    assert found[0] == found[1]


def plain_quality(docs_, least_rows=50):
    """kept by numpy alone: the same estimate, group by group."""
    feats, groups = {}, defaultdict(list)
    for k, (lang, source, t) in enumerate(docs_):
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        rep = len({i + x for i, g in enumerate(grams) if n[g] > 1 for x in range(3)})
        if len(w) < 50 or 100 * rep > 50 * len(w):
            continue
        lines = [x for x in t.split("\n") if WORD.search(x)]
        chars = sum(map(len, w))
        feats[k] = [chars / len(w), math.sqrt(sum(c in "#*$%&|<>" for c in t) / chars), math.sqrt(sum("A" <= c <= "Z" for c in t) / chars), math.sqrt(rep / len(w)), math.sqrt((len(lines) - len(set(lines))) / max(len(lines), 1))]
        groups[lang or "", source or ""].append(k)
    merged = defaultdict(list)
    for g, ks in groups.items():
        merged[g if len(ks) >= least_rows else "*"] += ks
    floor = np.diag(np.square([f for _, f in quality.FEATURES.values()]))
    kept = set()
    for ks in merged.values():
        x = np.array([feats[k] for k in ks])
        centre, inverse = np.percentile(x, 50, axis=0, method="inverted_cdf"), np.linalg.inv(floor)

        def distances(centre, inverse, x=x):
            return np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)

        def moments(rows_, factor):
            return rows_.mean(0), np.linalg.inv(np.cov(rows_.T, bias=True) * factor + floor)

        for _ in range(10):
            d = distances(centre, inverse)
            old = centre
            centre, inverse = moments(x[d <= np.percentile(d, 75, method="inverted_cdf")], 0.75 / 0.5309)
            if (abs(centre - old) / np.sqrt(np.diag(floor))).max() < 0.01:
                break
        centre, inverse = moments(x[distances(centre, inverse) <= 12.8325], 0.975 / 0.9239)
        kept |= {k for k, d in zip(ks, distances(centre, inverse)) if d <= 35.8882}
    return kept


def test_quality_keeps_what_a_plain_estimate_keeps(spark):
    df = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    data = [(r["doc_id"], r["lang"], r["source"], r["text"] or "") for r in df.collect()]
    want = plain_quality([d[1:] for d in data])
    got = {r["doc_id"]: r["kept"] for r in rows(quality.quality(df))}
    off = [d[0] for k, d in enumerate(data) if got[d[0]] != (k in want)]
    assert len(off) <= 2, off


def test_quality_rejects_an_outlier_in_each_statistic(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("etaoinshr"), rng.integers(3, 7)))
    line = lambda: " ".join(word() for _ in range(8)).capitalize()
    plain = lambda: "\n".join(line() for _ in range(20))
    twice = [line() for _ in range(5)]
    odd_ones = ["\n".join("x" * 9 + " " + line().replace(" ", "iiiiiii ") for _ in range(20)), plain().replace("a", "#"), plain().upper(), "\n".join([*twice, *twice, *(line() for _ in range(15))]), "\n".join(["same words", *(x for _ in range(14) for x in (line(), "same words"))])]
    df = spark.createDataFrame([(i, plain(), "en", "a") for i in range(300)] + [(1000 + i, t, "en", "a") for i, t in enumerate(odd_ones)], "doc_id bigint, text string, lang string, source string")
    got = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in rows(quality.quality(df))}
    assert all(got[i][0] for i in range(300)) and not any(got[1000 + i][0] for i in range(5)), [got[1000 + i] for i in range(5)]


def test_chat_ranks_the_leaves_of_a_hot_tree(spark):
    """One root with very many replies, beside small trees; a repeated id keeps its least row."""
    df = spark.range(4000).selectExpr("IF(id < 3000, 1L, id) AS tree", "id", "IF(id < 3000 AND id > 0, 0L, NULL) AS parent", "'assistant' AS role", "string(id) AS text", "cast(id * 7 % 2999 AS double) AS score")
    df = df.unionByName(spark.createDataFrame([(3500, 3500, None, "assistant", "0", 1.0)], df.schema))
    got = [r.asDict() for r in chat.format_chats(df, branches=3).collect()]
    best = sorted(range(1, 3000), key=lambda i: (-(i * 7 % 2999) / 2, i))[:3]
    hot = sorted((r for r in got if r["tree"] == 1), key=lambda r: r["branch"])
    assert [r["formatted"].split("\n")[3].removesuffix("<|im_end|>") for r in hot] == [str(i) for i in best] and len(got) == 1003
    assert ">assistant\n0<|" in next(r["formatted"] for r in got if r["tree"] == 3500)


def test_token_counts_of_one_giant_run():
    model = tokenizer_path("byte_bpe_50k.json")
    rng = np.random.default_rng(4)
    t = ["".join(rng.choice(list("theinga"), 9000)), "a" * 5000, "日本" * 2000 + " end"]
    assert token_counts.Merges(model).tokens(pa.array(t)).tolist() == [len(Tokenizer.from_file(model).encode(x, add_special_tokens=False).ids) for x in t]
