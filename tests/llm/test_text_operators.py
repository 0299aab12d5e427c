"""Quality rules, SentencePiece, language id, SimHash and line dedup against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from treelark.llm import language_id, line_dedup, mixing, quality_rules, sentencepiece_bpe, simhash
from treelark.llm.common import BLOCK_ROWS, Workspace, components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, verdict string, row int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(n))


LONG = words(3000, 1)
ODD = [
    (0, words(120, 2), "en", "a", 5, "x", 1),
    (1, None, "en", "a", None, None, None),
    (2, "", None, None, 0, "x", 1),
    (3, " \n\t ", "fr", "", 3, "x", 1),
    (4, LONG, "en", "a", 5, "x", 1),
    (5, LONG, "en", "b", 5, "x", 1),
    (5, LONG, "en", "b", 5, "x", 1),
    (None, words(60, 3), "en", "b", 5, "x", 1),
    (7, "one two three " * 40 + "\nA a\nA a\n\n\nA a", "en", "b", 5, "x", 1),
    (8, "ÉÉ \x1f x y #$ %&|<> 😀 \x0b z", "fr", "c", 5, "x", 1),
    (9, words(60, 4) + "\n" + words(60, 5), "en", "c", 5, "x", 1),
    (10, "head\n" + words(60, 5), "en", "c", 5, "x", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (4, 1, 0), (7, 0, 0), (None, 1, 1), (8, None, None), (0, 1, 0)], "doc_id bigint, quality int, toxic int")


def test_quality_counts(spark, odd):
    rows = quality_rules.quality(odd, labels(spark)).select("row.*", "verdict.*").drop("row", "verdict")
    got = Counter((r["doc_id"], r["text"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows.collect())
    want = Counter()
    for doc, text, *_ in ODD:
        w = WORD.findall(text or "")
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        mark = [False] * len(w)
        for i in range(len(w) - 2):
            if c[tuple(w[i : i + 3])] > 1:
                mark[i] = mark[i + 1] = mark[i + 2] = True
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want[doc, text, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(mark), len(w) < 50 or 100 * sum(mark) > 50 * len(w)] += 1
    assert got == want


def test_quality_of_long_texts_side_by_side(spark):
    texts = [f"w{k} x{k % 2} " * 300_000 for k in range(4)] + ["one short text", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    every = quality_rules.quality(docs.coalesce(1), labels(spark)).select("row.doc_id", "verdict.*").collect()
    alone = quality_rules.quality(docs.repartition(6, "doc_id"), labels(spark)).select("row.doc_id", "verdict.*").collect()
    assert sorted(every) == sorted(alone) and [r["n_words"] for r in sorted(every)] == [600_000] * 4 + [3, 0]


def test_quality_threshold_is_deterministic_and_empty_is_fine(spark, odd, none):
    a = quality_rules.quality(odd, labels(spark)).select("row.doc_id", "verdict.*").collect()
    b = quality_rules.quality(odd.repartition(5), labels(spark)).select("row.doc_id", "verdict.*").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.THRESHOLD) for r in a)
    assert quality_rules.quality(none, labels(spark).limit(0)).count() == 0


def test_quality_score_is_the_mean_log_ratio():
    text = [b"a b a", b"c d", None]
    codes, counts, distinct = quality_rules.flat_words(text)
    found, doc = quality_rules.ngram_buckets(codes, counts, distinct, 64)
    assert Counter(doc.tolist()) == {0: 5, 1: 3}
    again, _ = quality_rules.ngram_buckets(*quality_rules.flat_words([b"a b a"]), 64)
    assert sorted(again.tolist()) == sorted(found[doc == 0].tolist())


def test_quality_score_against_brute_force(spark, odd):
    """Counts of hashed n-grams by dictionary, and the mean log ratio of every document."""
    got = quality_rules.quality(odd, labels(spark)).select("row.doc_id", "row.text", "verdict.score").collect()

    def buckets(text):
        h = [(zlib.crc32(w.encode()) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64 for w in WORD.findall(text or "")]
        pairs = [(a * 0xC2B2AE3D27D4EB4F % 2**64 ^ b) * 0xD6E8FEB86659FD93 % 2**64 for a, b in zip(h, h[1:])]
        return [x >> 50 for x in h + pairs]

    raw, target = Counter(), Counter()
    for d, t, *_ in ODD:
        raw.update(buckets(t))
        if d in (0, 4):
            target.update(buckets(t))
    n, k = sum(raw.values()), quality_rules.BUCKETS
    p = {b: (raw[b] + 1) / (n + k) for b in raw}
    prior = quality_rules.PRIOR
    ratio = {b: np.log((target[b] + prior * k * p[b]) / (sum(target.values()) + prior * k) / p[b]) for b in raw}
    assert k == 1 << 14
    for x in got:
        own = buckets(x["text"])
        assert abs(x["score"] - (sum(ratio[b] for b in own) / len(own) if own else 0)) < 1e-8


def test_quality_separates_noise(spark):
    rows = [(i, words(100, i % 30 + 100), "en", "a", 0, "", 0) for i in range(90)] + [(1000 + i, " | ".join(f"x{i}{k}" for k in range(80)), "en", "a", 0, "", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    good = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    ratios = quality_rules.log_ratios(quality_rules.ngram_counts(docs, quality_rules.trusted_ids(good)), prior=0.05)
    score = dict(quality_rules.score_documents(docs, ratios).select("row.doc_id", "verdict.score").collect())
    assert min(v for k, v in score.items() if k < 90) > max(v for k, v in score.items() if k >= 1000)


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.model_path())


def test_sentencepiece_equals_the_library():
    sp, model = library(), sentencepiece_bpe.bpe(sentencepiece_bpe.model_path())
    r = random.Random(5)
    letters = list("abcdeEtThin  \n\t▁ 　é😀中文ﬁ\x00\x1f.,12") + ["  ", "    ", "\n\n", "the", "ing", "<s>", "</s>", "<0x41>"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(2000)] + ["a" * 3000, "ab" * 2000, " " * 500, "thethe" * 500, ""]
    for t, ids in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(t, add_bos=True, add_eos=True), t
        assert model.decode_bytes(ids).decode() == sp.decode(sp.encode(t)), t


def test_sentencepiece_documents(odd, none):
    sp = library()
    rows = sentencepiece_bpe.encode_documents(odd).select("row.text", "verdict.*").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        ids = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids) and r["decoded"] == sp.decode(ids)
    digest = sentencepiece_bpe.encode_documents(odd, digests=True).select("verdict.ids_sha256").collect()
    assert sorted(r[0] for r in digest) == sorted(hashlib.sha256(r["ids"]).hexdigest() for r in rows)
    assert sentencepiece_bpe.encode_documents(none).count() == 0


def test_language_id(spark, odd, none):
    vocabulary = {"en": "the and of to thing", "de": "der die und zu dass", "fr": "le la et de que"}
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(vocabulary[k].split()) for _ in range(30)), k, "s", 0, "", 0) for i in range(200) for k in [r.choice(sorted(vocabulary))]]
    rows += [(900, None, "en", "s", 0, "", 0), (901, "123 --- ²", "de", "s", 0, "", 0), (902, "", None, "s", 0, "", 0), (None, "der die und", "de", "s", 0, "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = language_id.identify(docs).select("row.doc_id", "row.lang", "verdict.*").withColumn("held", language_id.held_out()).collect()
    assert len(found) == len(rows)
    for x in found:
        assert x["held"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2)
        assert 0 <= x["score"] <= 1
        assert x["lang_pred"] == ("und" if x["doc_id"] in (900, 901, 902) else x["lang"])
    assert language_id.identify(none).count() == 0
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).select("verdict.lang_pred").distinct().collect()
    assert [x[0] for x in unlabelled] == ["und"]


def test_language_posteriors_against_brute_force(spark):
    rows = [(1, "Aa ba", "x"), (3, "ab ca", "x"), (4, "zz za", "y"), (5, "bz", "y"), (7, "az ab", "y")]
    rows = [(d, t, k) for d, t, k in rows if zlib.crc32(str(d).encode()) % 4 != 2] + [(20, "ab z", None), (21, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, keep=["doc_id"]).select("row.*", "verdict.*").collect()}

    def grams(t):
        m = [ord(c) * 0x9E3779B1 % 2**32 for c in t.lower()]
        two = [(a * 0x85EBCA6B % 2**32) ^ b for a, b in zip(m, m[1:])]
        three = [(a * 0xC2B2AE35 % 2**32) ^ b for a, b in zip(two, m[2:])]
        return [h * 0x27D4EB2F % 2**32 >> 17 for h in two + three]

    counts, n_docs = {}, Counter(k for _, _, k in rows if k)
    for _, t, k in rows:
        if k:
            counts.setdefault(k, Counter()).update(grams(t))
    alpha, size = language_id.ALPHA, language_id.BUCKETS
    assert size == 1 << 15
    for d, t, _ in rows:
        logs = {k: np.log((n_docs[k] + 1) / (sum(n_docs.values()) + len(n_docs))) + sum(np.log((c[g] + alpha) / (sum(c.values()) + alpha * size)) for g in grams(t)) for k, c in counts.items()}
        total = sum(np.exp(v - max(logs.values())) for v in logs.values())
        best = min(logs, key=lambda k: (-logs[k], k))
        assert got[d][0] == best and abs(got[d][1] - 1 / total) < 1e-4


def brute_components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(120)] + [(2000, 2000 + k) for k in range(1, 300)]
    got = dict(components(Workspace(spark), spark.createDataFrame(links, "a bigint, b bigint")).collect())
    want = brute_components({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in links)}
    assert components(Workspace(spark), spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in [None, "", " \n", "A", "A b C", "one two three four", words(200, 9).title(), "É É x \x1f y"]:
        assert simhash.fingerprint(t.encode() if t is not None else None) & (2**64 - 1) == brute_fingerprint(t)


@pytest.mark.parametrize("dense", [False, True])
def test_simhash_components(spark, dense):
    """Random links, and a group larger than a block whose members share most variants."""
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = base + [x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))) for x in base for _ in range(3)]
    if dense:
        fps += [base[0] ^ sum(1 << b for b in r.sample(range(64), 2)) for _ in range(BLOCK_ROWS + 300)]
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)] + [(5000, 0), (5001, 0)]
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(Workspace(spark), spark.createDataFrame(rows, "doc_id bigint, fp bigint")).collect()}
    v = np.array([x[1] for x in rows], np.int64)
    near = np.bitwise_count((v[:, None] ^ v[None, :]).view(np.uint64)) <= 4
    want = brute_components([x[0] for x in rows], [(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    assert got == want


def test_simhash_documents(spark, odd, none):
    ws = Workspace(spark)
    kept = simhash.one_of_each(ws, odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 0), (True, 0), (True, 1), (True, 4), (True, 7), (True, 8), (True, 9), (True, 10)]
    assert simhash.one_of_each(Workspace(spark), none).count() == 0


def brute_lines(docs, least):
    """Every run of lines, of any length, that has enough words and stood before; its lines go."""
    order = sorted({(d is not None, d or 0, t) for d, t in docs if t is not None})
    seen, gone = set(), {}
    for key in order:
        lines = key[2].split("\n")
        n = [len(WORD.findall(x)) for x in lines]
        own = set()
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                run = tuple(lines[i : j + 1])
                if sum(n[i : j + 1]) >= least:
                    if run in seen:
                        gone.setdefault(key, set()).update(range(i, j + 1))
                    own.add((i, run))
                    if sum(1 for a, x in own if x == run and a < i):
                        gone.setdefault(key, set()).update(range(i, j + 1))
        seen |= {x for _, x in own}
    return {k: "\n".join(x for i, x in enumerate(k[2].split("\n")) if i not in gone.get(k, ())) for k in order}


def test_line_dedup(spark, odd, none):
    r = random.Random(8)
    pool = [words(r.randint(0, 12), 50 + k) for k in range(14)] + [""]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 14))), "en", "s", 0, "", 0) for i in range(60)] + ODD[1:9]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute_lines([(x[0], x[1]) for x in rows], 20)
    got = line_dedup.dedup(Workspace(spark), docs, 20).select("row.doc_id", F.col("row.text").alias("old"), "text", "n_lines", "spans").collect()
    assert len(got) == len(rows)
    for x in got:
        assert x["text"] == (None if x["old"] is None else want[x["doc_id"] is not None, x["doc_id"] or 0, x["old"]])
    assert line_dedup.dedup(Workspace(spark), none).count() == 0
    whole = {x["doc_id"]: x["text"] for x in line_dedup.dedup(Workspace(spark), odd).select("row.doc_id", "text").collect()}
    assert whole[4] == LONG and whole[5] == "" and whole[10] == "head"


def test_line_dedup_of_runs_with_many_blank_lines(spark):
    thin = "\n\n".join(words(50, 77).split())
    gap = words(25, 78) + "\n" * 150 + words(25, 79)
    rows = [(1, "a\n" + thin + "\nb"), (2, "c\n" + thin + "\nd"), (3, gap), (4, "e\n" + gap + "\nf"), (5, "g\n" + "\n" * 300 + "h")]
    assert thin.count("\n") + 1 == 99
    want = brute_lines(rows, 50)
    got = line_dedup.dedup(Workspace(spark), spark.createDataFrame(rows, "doc_id bigint, text string")).select("row.doc_id", "row.text", F.col("text").alias("new")).collect()
    assert {(True, x["doc_id"], x["text"]): x["new"] for x in got} == want
    assert want[True, 2, rows[1][1]] == "c\nd" and want[True, 4, rows[3][1]] == "e\nf"


def test_mixing(spark, odd, none):
    r = random.Random(2)
    rows = [(i, words(r.randint(5, 60), i), "en", s, 0, "", 0) for i, s in enumerate(["hot"] * 300 + ["b"] * 60 + ["c"] * 30)]
    rows += [(1000 + k, *x[1:]) for k, x in enumerate(ODD[1:4])]
    docs = spark.createDataFrame(rows, SCHEMA)
    ws = Workspace(spark)
    found = mixing.copies(ws, docs).select("row.doc_id", "row.source", "n_tokens", "copies", "weight").collect()
    assert len(found) == len(rows) and all(x["copies"] >= 1 for x in found)
    tokens, passed = Counter(), Counter()
    for x in found:
        assert x["n_tokens"] == len(WORD.findall(dict((d, t) for d, t, *_ in rows)[x["doc_id"]] or ""))
        tokens[x["source"]] += x["n_tokens"]
        passed[x["source"]] += x["n_tokens"] * x["copies"]
    rate = {s: passed[s] / tokens[s] for s in tokens if tokens[s]}
    assert min(rate.values()) >= 1 - 1e-9 and max(rate.values()) <= mixing.REPETITION_LIMIT + 1e-9
    assert abs(max(rate.values()) - mixing.REPETITION_LIMIT) < 0.2
    assert mixing.mixed(Workspace(spark), docs).count() == sum(x["copies"] for x in found)
    assert mixing.mixed(Workspace(spark), odd).columns == odd.columns
    assert mixing.mixed(Workspace(spark), none).count() == 0


@pytest.mark.parametrize("target", [{}, {"entropy": 0.9}, {"budget": 9_000}, {"budget": 200}, {"repetition_limit": 1.0}])
def test_copies_against_brute_force(spark, target, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_BITS", 3)
    r = random.Random(6)
    rows = [(i, words(r.randint(0, 40), i), s) for i, s in enumerate(["hot"] * 250 + ["b"] * 70 + ["c"] * 30 + [None] * 9)] + [(900, "", "empty"), (901, None, "empty")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("copies", F.lit("clash"))
    found = mixing.copies(Workspace(spark), docs, **target).select("row.doc_id", "row.source", "n_tokens", "weight", "copies", "block_rank", "order").collect()
    size = {d: len(WORD.findall(t or "")) for d, t, _ in rows}
    total = Counter()
    for d, _, s in rows:
        total[s] += size[d]
    p = {s: n / sum(total.values()) for s, n in total.items() if n}
    if "entropy" in target:
        entropy = lambda a: -sum((w := x**a / sum(y**a for y in p.values())) * np.log(w) for x in p.values())
        a = next(k / 1e5 for k in range(100_001) if entropy(k / 1e5) <= 0.9)
    else:
        limit = target.get("repetition_limit", mixing.REPETITION_LIMIT)
        a = next(k / 1e5 for k in range(100_001) if max(p.values()) ** (1 - k / 1e5) <= limit * min(p.values()) ** (1 - k / 1e5) + 1e-9)
    weight = {s: x**a / sum(y**a for y in p.values()) for s, x in p.items()}
    budget = target.get("budget", max(total[s] / weight[s] for s in p))
    assert {x["doc_id"]: x["n_tokens"] for x in found} == size and len(found) == len(rows)
    for s in set(total):
        own = sorted((x for x in found if x["source"] == s), key=lambda x: (x["block_rank"], x["order"]))
        if not total[s]:
            assert all(x["copies"] == 1 for x in own)
            continue
        assert abs(own[0]["weight"] - weight[s]) < 1e-3
        mine = round(budget * own[0]["weight"]) if "budget" in target else None
        passes = min(x["copies"] for x in own) if all(x["copies"] == own[0]["copies"] for x in own) or mine is None else mine // total[s]
        more = [x["copies"] - passes for x in own]
        assert set(more) <= {0, 1} and more == sorted(more, reverse=True)  # a prefix of the permutation
        spent = sum(x["copies"] * x["n_tokens"] for x in own)
        want = budget * weight[s]
        assert spent <= want * (1 + 2e-3) + 1 and want - spent <= 40 + want * 2e-3  # short of the budget by less than the next document


def test_blocks_take_turns_by_a_bijection(spark):
    rows = spark.range(1 << 10).select(F.col("id").alias("order"), F.lit(10).alias("bits")).select(mixing.turn_of().alias("t")).collect()
    assert sorted(x["t"] for x in rows) == list(range(1 << 10)) != [x["t"] for x in rows]


def test_mixing_entropy(spark):
    sources = spark.createDataFrame([("a", 0.7), ("b", 0.2), ("c", 0.1)], "skey string, p double")
    a = mixing.exponent(sources, entropy=1.0)
    w = np.array([0.7, 0.2, 0.1]) ** a
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 1.0) < 1e-4
