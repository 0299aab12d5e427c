"""Importance resampling, secret scans and vector codes against brute force, with odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from treelark.llm import queries, resampling, secret_scan, vector_codes
from treelark.llm.common import Workspace

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, row int, score string, `__part` int, verdict string"


def equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, DATA).select(*rel.columns)
    return Counter(map(tuple, got.collect())) == Counter(rel.fetchall())


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_vector_codes"])
def test_equals_sql(spark, name):
    assert equals_sql(spark, name)


def test_crc_of_joined_texts():
    rng = random.Random(1)
    parts = [(rng.randbytes(rng.choice([0, 1, 5, 300, 70_000])), rng.randbytes(rng.choice([0, 1, 7, 255, 65_537]))) for _ in range(50)]
    first, second = (np.array([zlib.crc32(p[k]) for p in parts], np.uint32) for k in (0, 1))
    got = resampling.followed(first, second, np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in itertools.pairwise(words)]


def draw(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([d[1] for d in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    rows = []
    for ident, text in docs:
        words, fs = features(text)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        rows.append([ident, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: len(able) * 25 // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def test_resampling_of_odd_rows(spark):
    rng = random.Random(5)
    words = ["Alpha", "beta", "ГАММА", "déjà", "x1", "7", "Ångström"]
    docs = [(k, rng.choice([" ", "\n", "-", "\x00", "\x7f"]).join(rng.choices(words, k=rng.choice([0, 1, 19, 20, 40])))) for k in range(150)]
    docs += [(7, docs[7][1])] * 5 + [(200, None), (201, ""), (None, "alpha beta " * 30), (None, "alpha beta " * 12), (202, "beta " * 60_000), (-3, "x1 " * 20)]
    target = ["alpha alpha beta", None, "", "déjà x1"]
    df = spark.createDataFrame([(*d, 1, "s", 2, "v") for d in docs], DOCS)
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    found = resampling.resample(Workspace(spark), df, goal, last=1)
    assert found.select("row.*").columns == df.columns
    assert Counter((r["row"]["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect()) == draw(docs, target)
    none = resampling.resample(Workspace(spark), df.limit(0), goal)
    assert none.count() == 0 and none.select("row.*").columns == df.columns
    few = resampling.resample(Workspace(spark), df.limit(3), goal.limit(0), keep=["doc_id"])
    assert few.count() == 3 and few.where("rank is not null").count() == 0


@pytest.mark.parametrize("wanted", [1, 999, 2000])
def test_cutoff_by_medians(spark, wanted):
    rng = random.Random(wanted)
    rows = [(rng.choice([-5, 0, 0, 0, 3, rng.randrange(-50, 50)]), rng.randrange(40), rng.randrange(3), k) for k in range(2000)]
    cut = [0, 1, 700, 703, 2000]  # partitions of very unlike sizes
    parts = [spark.createDataFrame(rows[a:b], "lost bigint, id bigint, n_features bigint, at bigint").coalesce(1) for a, b in itertools.pairwise(cut)]
    keys = parts[0]
    for p in parts[1:]:
        keys = keys.union(p)
    assert resampling.cutoff(keys, wanted, last=1) == sorted(rows)[wanted - 1]


def test_rounds_discard_a_quarter(spark):
    keys = spark.range(0, 5000, 1, 7).selectExpr("pmod(xxhash64(id), 100) AS lost", "id", "0L AS n_features", "id AS at")
    left = sum(n for _, n, _ in resampling.medians(keys, None, None, None))
    found = resampling.medians(keys, None, None, None)
    pivot = resampling.weighted_median([(n, k) for _, n, k in found])
    sides = Counter()
    for side, n, _ in resampling.medians(keys, None, None, pivot):
        sides[side] += n
    assert sum(sides.values()) == left - 1 and max(sides.values()) <= 0.75 * left + 7


def test_ranks_cover_all_rows_in_order(spark):
    df = spark.range(0, 3000, 1, 9).selectExpr("pmod(xxhash64(id), 50) AS a", "id")
    got = [(r["rank"], r["a"], r["id"]) for r in resampling.ranked(Workspace(spark), df, ["a", "id"]).collect()]
    want = sorted((r["a"], r["id"]) for r in df.collect())
    assert sorted(got) == [(k + 1, *x) for k, x in enumerate(want)]


RANKS = {w: k for k, w in enumerate("password secret the horse staple correct battery dragon token abandoned".split())}


def cheapest(value, ranks):
    """Over all segmentations of a short value."""
    by = {}
    for a, b, bits, _ in secret_scan.segments_of(value, ranks):
        by[a, b] = min(bits, by.get((a, b), math.inf))
    brute, best = secret_scan.alphabet_bits(value), math.inf
    n = len(value)
    for cuts in itertools.product([0, 1], repeat=max(0, n - 1)):
        at = [0, *[k + 1 for k, c in enumerate(cuts) if c], n]
        best = min(best, sum(2 + min(by.get((a, b), math.inf), (b - a) * brute) for a, b in itertools.pairwise(at)))
    return best if n else 0.0


def test_guess_cost_is_least():
    rng = random.Random(3)
    pieces = ["horse", "1999", "qwe", "aa", "aaa", "Q", "!", "9", "0a", "th3", "ñ", "12", "$ta"]
    for _ in range(60):
        value = "".join(rng.choices(pieces, k=4))[:12]
        assert math.isclose(secret_scan.guess_bits(value, RANKS)[0], cheapest(value, RANKS)), value
        spans = secret_scan.guess_bits(value, RANKS)[1]
        assert "".join(value[a:b] for a, b, _ in spans) == value
    assert secret_scan.guess_bits("", RANKS) == (0.0, [])


@pytest.mark.parametrize(
    ("value", "kinds"),
    [("dragon", ["word"]), ("p@$$w0rd", ["word"]), ("2019-12-31", ["date"]), ("19840523", ["date"]), ("zzzzzzzz", ["repeat"]), ("xq7xq7xq7", ["repeat"]), ("qwertyuiop", ["walk"]), ("Tr0ub4dor&3", ["brute"]), ("horse9Kq!Z", ["word", "brute"])],
)
def test_patterns_of_segments(value, kinds):
    assert [k for _, _, k in secret_scan.guess_bits(value, RANKS)[1]] == kinds


def plain_base(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [("assign", *m.span()) for m in assign.finditer(text) if len(m.group(2)) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(9)
    pieces = ["Password", "PASSWD", "secret", "ToKen", "api_key", "apikey", "api-key", "paſſword", "toKen", '"', "'", " ", "  ", ":", "=", "\n", "é", "AKIA", "ABCDEFGH12345678", "abc", "deadbeef" * 3, "0f" * 11, "x.y/z+", "hunter2", "İ"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 12)))
        assert [s for s in secret_scan.spans_of(text, RANKS) if s[0] != "guess"] == plain_base(text), text


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("the password was k8Fj2#qLz9 then", ["k8Fj2#qLz9"]),
        ("export DB_PASSWORD='9sK!2mNq0zX'", ["9sK!2mNq0zX"]),
        ("Authorization: Bearer abC9d8e7F6g5h4.", ["abC9d8e7F6g5h4"]),
        ("mysql --password Zx9kQ2mT7a db", ["Zx9kQ2mT7a"]),
        ("<password>Zx9!kQ2m#</password>", ["Zx9!kQ2m#"]),
        ("postgres://bob:Zx9kQ2mT7a@db/x", ["Zx9kQ2mT7a"]),
        ("pwd=q7!Xm2$LpW9", ["q7!Xm2$LpW9"]),
        ("The secret: never tell. The password is required. token: abandoned, pass: 1999", []),
        ("a token of thanks; secretary: X9kQ2mT7aZ; compass=Zx9kQ2mT7a", []),
        ("password = qwertyuiop password = 2019-12-31 password=dragon9", []),
    ],
)
def test_values_in_credential_contexts(text, values):
    assert [text[a:b] for k, a, b in secret_scan.spans_of(text, RANKS) if k == "guess"] == values


def test_scan_of_odd_rows(spark):
    long = "the horse " * 30_000 + 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"' + " of" * 1000
    docs = [(1, None), (2, ""), (3, long), (3, long), (None, "é password: Zx9kQ2mT7a"), (5, "password" * 5000), (6, "secret=" + "q7Xm" * 10_000)]
    df = spark.createDataFrame([(*d, 1, "s", 2, "v") for d in docs], DOCS)
    found = secret_scan.scan(df)
    assert found.select("row.*").columns == df.columns
    got = Counter((r["row"]["doc_id"], r["verdict"]["base_sha256"], r["verdict"]["n_assign"], r["verdict"]["n_access"], r["verdict"]["n_hex"]) for r in found.collect())
    want = Counter()
    for ident, text in docs:
        spans = plain_base(text or "")
        kinds = Counter(k for k, _, _ in spans)
        want[ident, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), kinds["assign"], kinds["access"], kinds["hex"]] += 1
    assert got == want
    said = {r["row"]["doc_id"]: r["verdict"]["spans"] for r in found.collect()}
    assert said[1] == said[2] == "" and said[None] == "assign:2:22,guess:12:22" and said[3].endswith(",hex:300009:300049,guess:300009:300049")
    assert secret_scan.scan(df.limit(0)).count() == 0
    few = spark.createDataFrame([("Horse and dragon",)] * 40 + [("horse? once",)] * 9 + [("alone",), (None,)], "text string")
    ranks, common = secret_scan.dictionary(few), len(set(secret_scan.COMMON))
    assert ranks["password"] == 0 and list(ranks)[common:] == ["horse", "and", "dragon", "once"]
    assert list(secret_scan.dictionary(few, size=3))[common:] == ["horse", "and", "dragon"] and len(secret_scan.dictionary(few, size=0)) == common


def test_secrets_of_the_table(spark):
    got = {r["doc_id"]: r for r in queries.op12_secret_scan(spark, DATA).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for k, text in texts.items():
        assert [s for s in got[k]["spans"].split(",") if s and not s.startswith("guess")] == [f"{a}:{b}:{c}" for a, b, c in plain_base(text)]
        assert (got[k]["n_guess"] > 0) <= bool(re.search("(?i)token|secret|pass|key|auth|bearer|://", text))


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, lab, [math.floor(4096 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return Counter()
    width = max(1, -(-max(len(v) for _, _, v in kept) // parts))
    kept = [(i, lab, v + [0] * (width * parts - len(v))) for i, lab, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, _, v in kept:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(o) for c in zip(*o, strict=True)] if o else b for o, b in zip(own, books[p], strict=True)]
    found = [(i, lab, [near(cut(v, p), books[p]) for p in range(parts)]) for i, lab, v in kept]
    by = Counter()
    for _, lab, n in found:
        by[lab] += sum(d for d, _ in n)
    return Counter((i, "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n), by[lab]) for i, lab, n in found)


def coded(spark, rows):
    df = spark.createDataFrame([(i, v, lab, "r", 1) for i, v, lab in rows], "vec_id bigint, embedding array<float>, label int, row string, code int")
    ws = Workspace(spark)
    found, books = vector_codes.compress(ws, df)
    return Counter((r["row"]["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.with_label_errors(ws, found).collect()), books


def test_codes_of_odd_rows(spark):
    rng = random.Random(2)
    value = lambda: rng.choice([-1.5, 0.0, 0.25, 0.25, rng.uniform(-1, 1)])
    as_float = lambda v: np.array(v, np.float32).astype(float).tolist()
    rows = [(k, as_float([value() for _ in range(16)]), rng.choice([1, 2, None])) for k in range(120)] + [(500, [0.25] * 16, 1)] * 40
    rows += [(200, None, 1), (201, [], 1), (202, [float("nan")] * 16, 1), (203, [1.0, None], 2), (204, [float("inf")] * 16, 2), (205, as_float([0.5] * 11), None), (None, as_float([0.1] * 16), 3), (3, as_float([0.7] * 16), 4)]
    got, _ = coded(spark, rows)
    assert got == plain_codes(rows)
    few = [(k, [0.1 * k] * 8, None) for k in range(5)]
    assert coded(spark, few)[0] == plain_codes([(k, as_float(v), lab) for k, v, lab in few])
    assert coded(spark, [(1, [], None)])[0] == Counter({(1, "00" * 8, 0, 0): 1})
    empty, books = coded(spark, [(1, None, None), (2, [float("nan")], 1)])
    assert not empty and vector_codes.digest(books) == hashlib.sha256(b"").hexdigest()


def test_trie_gives_the_nearest_entries(monkeypatch):
    rng = np.random.default_rng(4)
    for leaves in (1, 3, 50, 10_000):
        monkeypatch.setattr(vector_codes, "SUBTREE", leaves)
        for width, high in ((1, 400), (3, 4), (5, 30)):
            parts = np.unique(rng.integers(-high, high, (700, width)), axis=0)
            book = rng.integers(-high, high, (6, width))
            far = ((parts[:, None, :] - book) ** 2).sum(2)
            entry, least = vector_codes.nearest(parts, book)
            assert (entry == far.argmin(1)).all() and (least == far.min(1)).all()
