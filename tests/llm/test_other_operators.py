"""HTML extraction, chat formatting, token shards and embeddings against brute force, with odd rows."""

import hashlib
import json
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from treelark.llm import chat_format, embedding_dedup, html_extract, queries, sentencepiece_bpe, token_shards
from treelark.llm.common import BLOCK_ROWS, Workspace

NAV = '<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>'


def page(k, body, extra=""):
    return f'<!DOCTYPE html><html><head><title>t{k}</title><style>p{{}}</style><script>if (a < b) "</p>";</script></head><body class="has-sidebar">{NAV}<div>Read all our stories</div>{extra}<div class="text">{body}</div><footer>f{k}</footer></body></html>'


def test_extraction_by_marks():
    html = page(1, "<h1>T &amp; U</h1><p>one\n <b>two</b><br>three<p>four<form><p>no</form><aside>no</aside>", '<div id="cookieNotice">no</div><div class="ad">no</div>')
    assert html_extract.extract(html) == "Read all our stories\n\nT & U\n\none two three\n\nfour"
    article = '<header>no</header><main><article><header><h1>H</h1></header><p>a &lt; b&#33;</p><div class="comments"><article class="comment"><p>no</p></article></div></article></main><p>no</p>'
    assert html_extract.extract(article) == "H\n\na < b!"
    assert html_extract.extract(None) == html_extract.extract("") == ""
    assert html_extract.extract("<p>a < b <i>c</b><p>d <a href='x") == "a < b c\n\nd"
    assert html_extract.extract("<ul><li>x<li>y</ul>plain") == "x\n\ny\n\nplain"
    assert html_extract.extract("<p>" + "w " * 200_000) == " ".join(["w"] * 200_000)


def test_marks_leave_article_text():
    body = '<h2 id="discussion">D</h2><section class="discussion"><h2 id="related-work">R</h2></section><p id="ad-hoc-analysis">a</p><div class="ad-hoc-analysis">b</div><div class="ad">no</div><ol class="comments"><li>no</ol>'
    want = "D\n\nR\n\na\n\nb"
    assert html_extract.extract(f"<nav>no</nav><article>{body}</article>") == want
    assert html_extract.extract(f'<main><h1>Title</h1><p>Intro</p><div class="share">no</div><article>{body}</article></main>') == f"Title\n\nIntro\n\n{want}"
    assert html_extract.extract('<div><h2 id="search">S</h2><p id="ad">p</p></div><div id="search">no</div>') == "S\n\np"
    assert html_extract.extract("<p>so <math><mi>x</mi> = 1</math> holds <object>o</object></p><select><option>c</select>") == "so x = 1 holds o\n\nc"


def test_wrapper_drops_constant_texts_only():
    pages = [page(k, f"<p>story {k} begins</p><p>story {k} ends</p>") for k in range(8)]
    wrapper = html_extract.induce(pages)
    assert html_extract.extract(pages[3], wrapper) == "story 3 begins\n\nstory 3 ends"
    copies = html_extract.induce([page(k, "<p>the same story</p><p>on all pages</p>") for k in range(8)])
    assert html_extract.extract(pages[3].replace("story 3 begins", "the same story"), copies).startswith("Read all our stories\n\nthe same story")


def test_wrapper_of_short_articles_in_much_boilerplate():
    def short(k, body):
        menu, foot = ("".join(f"<div>{t} {i}</div>" for i in range(n)) for t, n in (("menu item", 10), ("footer line", 3)))
        return f"<body><div>{menu}</div><div>{body}</div><div>{foot}</div></body>"

    pages = [short(k, "".join(f"<p>story {k} part {i}</p>" for i in range(3))) for k in range(12)]
    assert html_extract.extract(pages[5], html_extract.induce(pages)) == "\n\n".join(f"story 5 part {i}" for i in range(3))
    copies = [short(k, "<p>one story</p><p>copied</p>") for k in range(12)]
    wrapper = html_extract.induce(copies + pages[:4])
    assert html_extract.extract(copies[0], wrapper) == "one story\n\ncopied"
    assert "one story" in html_extract.extract(copies[0], html_extract.induce(copies))
    rare = [p.replace("<body>", "<body><section><p>only in some</p></section>") if k < 5 else p for k, p in enumerate(pages)]
    assert "only in some" not in html_extract.extract(rare[0], html_extract.induce(rare))


def plain_page(k):
    """A page without a mark: menu and footer in bare containers, with words that differ from page to page."""
    menu = "".join(f'<li><a href="/{k}{i}">topic {k * 7 + i}</a></li>' for i in range(6))
    story = f"<h1>Story {k}</h1>" + "".join(f"<p>In story {k} part {i} says {'much ' * 20}and more.</p>" for i in range(5)) + f'<ul><li>See <a href="x">source {k}</a> for all of it</ul>'
    return f"<body><div><ul>{menu}</ul></div><div><p>Buy {k} now</p></div><div><div>{story}</div></div><div>made by {k}</div></body>"


def test_wrapper_keeps_short_text_beside_the_article():
    def with_summary(k):
        words = " ".join(f"w{k}x{i}" for i in range(12))
        menu = "".join(f'<li><a href="/{k}{i}">topic {k * 7 + i}</a></li>' for i in range(6))
        return f"<body><div><ul>{menu}</ul></div><div><p>Buy {k} now</p></div><section><p>{words}</p></section><div>{''.join(f'<p>In story {k} part {i} says {chr(97 + i) * 9} {k * i}.</p>' * 3 for i in range(12))}</div><div>made by {k}</div></body>"

    pages = [with_summary(k) for k in range(12)]
    wrapper = html_extract.induce(pages)
    for k, source in enumerate(pages):
        got = html_extract.extract(source, wrapper)
        assert got.startswith(f"w{k}x0 w{k}x1 ") and f"In story {k} part 11" in got
        assert "topic" not in got and "Buy" not in got and "made by" not in got


def test_wrapper_decides_slots_by_what_varies():
    pages = [plain_page(k) for k in range(10)]
    wrapper = html_extract.induce(pages)
    want = "\n\n".join(["Story 3", *(f"In story 3 part {i} says {'much ' * 20}and more." for i in range(5)), "See source 3 for all of it"])
    assert html_extract.extract(pages[3], wrapper) == want
    alone = html_extract.extract(pages[3])
    assert alone != want and "topic 21" in alone and "made by 3" in alone  # the wrapper makes the difference
    other = "<body><section><p>a page of another make</p></section></body>"
    assert html_extract.extract(other, wrapper) == "a page of another make"


def test_wrapper_does_without_marks(monkeypatch):
    pages = [page(k, f"<h1>T {k}</h1><p>story {k} begins {'word ' * 30}</p><p>story {k} ends</p>", f'<div class="ad">Offer {k}</div><aside>Aside {k}</aside>') for k in range(12)]
    with_marks = [html_extract.extract(x, html_extract.induce(pages)) for x in pages]
    assert with_marks[0] == f"T 0\n\nstory 0 begins {('word ' * 30).strip()}\n\nstory 0 ends"
    for name in ("DROPPED_TAGS", "DROPPED_WORDS", "ARTICLE_NAMES", "HEADER_WORDS"):
        monkeypatch.setattr(html_extract, name, set())
    # a footer of nothing but a word that is another one on each page is what varies: marks alone know it
    assert [html_extract.extract(x, html_extract.induce(pages)) for x in pages] == [f"{x}\n\nf{k}" for k, x in enumerate(with_marks)]
    assert all(html_extract.extract(x) != y for x, y in zip(pages, with_marks, strict=True))


def test_spark_counts_give_the_wrappers_of_induction(spark):
    rows = [(k, f"https://x.org/{k}", plain_page(k)) for k in range(10)] + [(50 + k, f"https://y.org/{k}", page(k, f"<p>story {k} begins</p>")) for k in range(9)] + [(70 + k, "https://y.org/c", page(99, "<p>copied</p>")) for k in range(9)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r["host"]: r["wrapper"] for r in html_extract.wrappers(Workspace(spark), df).collect()}
    assert set(found) == {"x.org", "y.org"}
    for host, wrapper in found.items():
        own = [h for _, u, h in rows if f"//{host}/" in u]
        assert [html_extract.extract(h, wrapper) for h in own] == [html_extract.extract(h, html_extract.induce(own)) for h in own]
    assert html_extract.extract(plain_page(3), found["x.org"]).startswith("Story 3\n\nIn story 3")
    assert html_extract.extract(rows[-1][2], found["y.org"]) == "copied"


def test_skeletons_and_words_come_from_all_pages(spark):
    def own(k):
        links = "".join(f'<li><a href="/{k}{i}">further {k * 3 + i}</a></li>' for i in range(4))
        more = f'<div class="zz"><ul>{links}</ul></div>' if k % 40 == 7 else ""  # 5 of 200 pages
        story = "".join(f"<p>In story {k} part {i} says {'much ' * 20}and w{k}.</p>" for i in range(4))
        return f"<body><div><p>by a{k} of b{k}</p></div><div><h1>Story {k}</h1>{story}</div>{more}</body>"

    rows = [(k, f"https://x.org/{k}", own(k)) for k in range(200)] + [(1000 + k, f"https://x.org/c{k}", own(1)) for k in range(400)]
    for parts in (2, 5):
        df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(parts)
        [wrapper] = [r["wrapper"] for r in html_extract.wrappers(Workspace(spark), df).collect()]
        assert "div.zz" in wrapper
        for k in range(7, 200, 40):
            text = html_extract.extract(own(k), wrapper)
            assert "further" not in text and f"Story {k}" in text
        assert parts == 2 or wrapper == before
        before = wrapper
    root = html_extract.load(html_extract.merged({html_extract.tree_of(h): 1 for _, _, h in rows}))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for x in html_extract.in_order(root):
        x.asked = x.number > 0
    asking = spark.createDataFrame([("x.org", html_extract.dump(root))], "host string, wrapper string")
    [said] = html_extract.recurring_words(Workspace(spark), pages, asking).collect()
    want = html_extract.recurring(root, [h for _, _, h in rows])
    assert {x["slot"]: (x["recur"], x["every"]) for x in said["said"]} == want and any(n for n, _ in want.values())


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "x", '<a "' * 250_000, "<a " * 300_000, "<!--" * 200_000, "</div>" * 200_000, "<p><div>" * 50_000, '<a href="' * 100_000 + ">", "<" * 1_000_000, "<li>" * 100_000])
def test_hostile_pages(html):
    wrapper = html_extract.induce([plain_page(k) for k in range(5)] + [html])
    began = time.process_time()
    html_extract.extract(html, wrapper)
    assert time.process_time() - began < 15  # quadratic work would take hours


def test_tree_matching_counts_pairs():
    slot = html_extract.Slot("")
    html_extract.align(slot, [html_extract.parse("<div><h1>a</h1><p>b</p></div>")], True, {})
    assert html_extract.match(slot, [html_extract.parse("<div><p>x</p></div><ul><li>y</ul>")], {}) == 3


def test_pages(spark):
    rows = [(k, f"https://x.org/{k}", page(k, f"<p>story {k} begins</p>")) for k in range(12)] + [(20, "https://y.org/1", page(20, "<p>alone</p>")), (21, None, "<p>no url</p>"), (22, "https://x.org/n", None), (23, "bad url", ""), (3, "https://x.org/3", page(3, "<p>story 3 begins</p>"))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("wrapper", F.lit("clash")).withColumn("host", F.lit(1))
    got = [(r["page_id"], r["text"]) for r in html_extract.extract_pages(Workspace(spark), pages).collect()]
    want = [(k, f"story {k} begins") for k in [*range(12), 3]] + [(20, "Read all our stories\n\nalone"), (21, "no url"), (22, ""), (23, "")]
    assert sorted(got) == sorted(want)
    assert html_extract.extract_pages(Workspace(spark), pages.limit(0)).count() == 0


def test_escapes_are_reversible():
    r = random.Random(0)
    parts = [*chat_format.CONTROL, "\\", "<", "[", "|", "im_start", "\n", "x", "s>", "/INST]"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        e = chat_format.escape(t)
        assert chat_format.unescape(e) == t and not any(c in e for c in chat_format.CONTROL)
        role = r.choice(["user", "assistant", t])
        whole, a, b = chat_format.write_turn(role, t)
        assert chat_format.read_turn(whole) == (role, t)
        assert chat_format.unescape(whole[a:b]) == (t if role == "assistant" else "")


LAYOUTS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q", "weight": 1}, {"role": "assistant", "content": None}]}, [("system", "s"), ("user", "q"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3}, [("user", "q"), ("assistant", "a")]),
    ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "j", "output": "o", "extra": {"deep": [1]}}, [("user", "i\n\nj"), ("assistant", "o")]),
    ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": 7}, [("user", "p"), ("assistant", "7")]),
]


def test_layouts_by_fingerprint(spark):
    rows = [(k, json.dumps(x)) for k, (x, _) in enumerate(LAYOUTS)] + [(90, "not json"), (91, None), (92, '{"nothing": 1}'), (93, "[1]")]
    got = defaultdict(list)
    for r in chat_format.turns_from_json(spark.createDataFrame(rows, "conv_id bigint, record string")).orderBy("conv_id", "turn").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    for k, (_, turns) in enumerate(LAYOUTS):
        assert got[k] == turns
    assert all(got[k] == [(None, None)] for k in (90, 91, 92, 93))
    odd = [(1, '{"prompt": "a\\ud800", "response": "\\ud83d\\ude00 \\udc00"}'), (2, '{"messages": [{"role": "a\\udfff", "content": "x"}]}'), (3, "[" * 100_000), (4, '{"a":' * 100_000)]
    turns = chat_format.turns_from_json(spark.createDataFrame(odd, "conv_id bigint, record string"))
    assert sorted((r["conv_id"], r["role"], r["text"]) for r in turns.where("role is not null").collect()) == [(1, "assistant", "😀 \ufffd"), (1, "user", "a\ufffd"), (2, "a\ufffd", "x")]
    assert turns.where("role is null").count() == 2
    assert len(chat_format.BY_FINGERPRINT) == len(chat_format.LAYOUTS)


def test_conversations(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "human", None), (2, 1, "assistant", "b"), (2, 0, None, "a\\<s>"), (None, 0, "assistant", ""), (3, 0, "a\nb%", "x"), (3, None, "user", "first")]
    rows += [(7, k, "assistant" if k % 2 else "user", f"t{k}<|im_end|>") for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("layout", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(chat_format.turns_from_rows(df))).collect()}
    turns = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, v[1] is not None, v[1] or 0)):
        turns[c].append(({"human": "user", None: "unknown"}.get(r, r), x or ""))
    assert set(got) == set(turns)
    for c, own in turns.items():
        loss = "".join(x for r, x in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_turns(chat_format.turns_from_rows(df.limit(0)))).count() == 0
    stored = Workspace(spark).save(chat_format.format_turns(chat_format.turns_from_rows(df)).orderBy(F.desc("nth")), "segments")  # order is in the rows
    assert {r["conv_id"]: r for r in chat_format.read_back(stored).collect()} == got


def test_turns_are_found_wherever_the_text_is_cut():
    r, said = random.Random(1), [("user", "</s><|im_end|>\n"), ("assistant", "<|im_end|>\n<|im_start|>user\nx"), ("tool\n", ""), ("assistant", "z")]
    written = [chat_format.write_turn(*x) for x in said]
    text, spans = "".join(x[0] for x in written), []
    for k, (_, a, z) in enumerate(written):
        at = sum(len(x[0]) for x in written[:k])
        spans += [(at + a, at + z)] if z > a else []
    whole = chat_format.Reader()
    for turn, a, z in written:
        whole.feed(turn, a, z)
    for _ in range(50):
        reader = chat_format.Reader()
        cuts = sorted({0, len(text), *(r.randrange(len(text)) for _ in range(5))} - {x for a, z in spans for x in range(a + 1, z)})
        for a, z in zip(cuts, cuts[1:]):
            own = [(x - a, y - a) for x, y in spans if a <= x and y <= z]
            reader.feed(text[a:z], *(own[0] if len(own) == 1 else (0, 0)))
            reader.spans += [(a + x, a + y) for x, y in own[1:]] if len(own) > 1 else []
            if len(own) > 1:
                break
        else:
            assert reader.row(1) == whole.row(1)
    assert whole.n == 4


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4096, 70000])
def test_permutation(n):
    assert sorted(token_shards.permute(np.arange(n), n).tolist()) == list(range(n))


def documents_in_shards(shards, width, seq_len):
    """The ids of every document, put together from the shards by the index; every slot must be filled once from end to end."""
    slots = token_shards.read_slots(shards.root, 0, shards.sequences, shards.sequences, width, seq_len)
    filled, found = defaultdict(list), defaultdict(list)
    for r in token_shards.with_digests(shards, width, seq_len).collect():
        piece = slots[r["slot"]][r["place"] * width : (r["place"] + r["n_ids"]) * width]
        assert hashlib.sha256(piece).hexdigest() == r["ids_sha256"]
        filled[r["slot"]].append((r["place"], r["n_ids"]))
        found[r["doc_id"]].append((r["first"], r["n_ids"], piece))
    assert sorted(filled) == list(range(shards.sequences)) == list(range(len(slots)))
    for s, own in filled.items():
        at = 0
        for place, n in sorted(own):
            assert place == at
            at += n
        assert at * width == len(slots[s]) <= seq_len * width
    return found, slots


def test_shards(spark):
    texts = [(i, "x" * (i * 37 % 1500) + "é") for i in range(300)] + [(None, "null id"), (900, None), (901, ""), (902, "long " * 30000)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("slot", F.lit("clash"))
    shards = token_shards.materialise(Workspace(spark), docs, "cast(text as binary)", 1, 64, parts=4)
    found, slots = documents_in_shards(shards, 1, 64)
    assert {i: b"".join(x[2] for x in sorted(own)) for i, own in found.items()} == {i: t.encode() for i, t in texts if t}
    assert sum(len(x) < 64 for x in slots) <= 4  # only a part's last sequence is short
    assert shards.index.select("shard").distinct().count() > 1
    first = len(slots) // 2 - 700
    assert token_shards.read_slots(shards.root, first, 1500, len(slots), 1, 64) == slots[first : first + 1500]
    empty = token_shards.materialise(Workspace(spark), docs.limit(0), "cast(text as binary)", 1)
    assert empty.index.count() == empty.sequences == 0


def test_shards_are_kept_in_a_target_folder(spark, tmp_path):
    docs = spark.createDataFrame([(i, "abc" * i) for i in range(100)], "doc_id bigint, text string")
    for k, target in enumerate((str(tmp_path / "kept"), f"file://{tmp_path}/uri/")):
        shards = token_shards.materialise(Workspace(spark), docs, "cast(text as binary)", 1, 64, target=target)
        found, slots = documents_in_shards(shards, 1, 64)
        assert token_shards.read_manifest(target.rstrip("/")) == {"sequences": len(slots), "seq_len": 64, "width": 1}
        assert b"".join(x[2] for x in sorted(found[99])) == b"abc" * 99 and not list(tmp_path.rglob("*.crc"))
        with pytest.raises(ValueError, match="exists"):
            token_shards.materialise(Workspace(spark), docs, "cast(text as binary)", 1, 64, target=target)
    empty = token_shards.materialise(Workspace(spark), docs.limit(0), "cast(text as binary)", 1, target=str(tmp_path / "none"))
    assert empty.sequences == token_shards.read_manifest(str(tmp_path / "none"))["sequences"] == 0


def test_folders_named_as_spark_names_them(monkeypatch):
    asked = []
    monkeypatch.setattr(token_shards.fs, "FileSystem", type("Fake", (), {"from_uri": staticmethod(lambda uri: asked.append(uri) or (None, uri))}))
    for uri in ("s3a://bucket/a/b", "s3n://bucket/a", "dbfs:/mnt/a", "dbfs:///mnt/a", "hdfs://host/a", "file:///a", "/a/b"):
        token_shards.store_of(uri)
    assert asked == ["s3://bucket/a/b", "s3://bucket/a", "/dbfs/mnt/a", "/dbfs/mnt/a", "hdfs://host/a", "file:///a", "/a/b"]


def test_repeated_rows_have_places_of_their_own(spark):
    docs = spark.createDataFrame([(5, "again" * 30)] * 7 + [(6, "once")], "doc_id bigint, text string")
    found, _ = documents_in_shards(token_shards.materialise(Workspace(spark), docs, "cast(text as binary)", 1, 64), 1, 64)
    assert sum(n for _, n, _ in found[5]) == 7 * 150 and sum(n for _, n, _ in found[6]) == 4


def test_slots_do_not_depend_on_the_dealing_of_rows(spark):
    docs = spark.createDataFrame([(i % 190, "x" * (i % 190 * 37 % 900)) for i in range(200)] + [(None, "y")], "doc_id bigint, text string")
    found = []
    for dealt in (docs.coalesce(1), docs.repartition(7), docs.orderBy(F.desc("doc_id")).coalesce(2)):
        shards = token_shards.materialise(Workspace(spark), dealt, "cast(text as binary)", 1, 64)
        found.append(sorted((r["slot"], r["place"], r["doc_id"] or -1, r["first"], r["n_ids"]) for r in shards.index.collect()))
    assert found[0] == found[1] == found[2] and sorted({x[0] for x in found[0]}) == list(range(shards.sequences))


def test_slots_hold_when_the_scan_is_planned_anew(spark, tmp_path, monkeypatch):
    path, key, usual = str(tmp_path / "docs"), "spark.sql.files.maxPartitionBytes", token_shards.range_of
    spark.range(4000).selectExpr("id as doc_id", "repeat('z', 100) as text").repartition(16).write.parquet(path)
    before = spark.conf.get(key)

    def planned_anew(n, stride):
        spark.conf.set(key, "16k")
        return usual(n, stride)

    monkeypatch.setattr(token_shards, "range_of", planned_anew)
    try:
        shards = token_shards.materialise(Workspace(spark), spark.read.parquet(path), "cast(text as binary)", 1, 64)
        assert shards.index.select("slot").distinct().count() == shards.sequences
        assert shards.index.groupBy("doc_id").agg(F.sum("n_ids").alias("n")).where("n = 100").count() == 4000
    finally:
        spark.conf.set(key, before)


def test_slots_that_are_not_filled_once_are_an_error(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "doc_id bigint, text string")
    usual = Workspace.save

    def lossy(ws, df, name, **options):
        return usual(ws, df.where("doc_id <> 7") if name == "shards-ids" else df, name, **options)

    monkeypatch.setattr(Workspace, "save", lossy)
    with pytest.raises(Exception, match="once each"):
        token_shards.materialise(Workspace(spark), docs, "cast(text as binary)", 1, 64, parts=1)


def test_query_shards_token_ids(spark, tmp_path):
    import sentencepiece

    texts = {1: "some plain text", 2: None, 3: "", 4: "long and 😀 odd " * 400} | {k: f"some text {k} " * 20 for k in range(5, 45)}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.model_path())
    got = defaultdict(list)
    for r in queries.op8_token_shards(spark, str(tmp_path)).collect():
        got[r["doc_id"]].append((r["first"], r["n_ids"], r["ids_sha256"]))
    assert set(got) == set(texts)
    for d, t in texts.items():
        ids, at = np.array([sp.bos_id(), *sp.encode(t or ""), sp.eos_id()], "<u2"), 0
        for first, n, digest in sorted(got[d]):
            assert first == at and digest == hashlib.sha256(ids[at : at + n].tobytes()).hexdigest()
            at += n
        assert at == len(ids)


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(0)
    o = embedding_dedup.units(r.standard_normal((4000, 64)))
    noise = embedding_dedup.units(r.standard_normal((4000, 64)))
    q = embedding_dedup.units(0.9 * o + 0.3 * noise)
    code, factor = embedding_dedup.codes(o)
    estimate = np.einsum("ij,ij->i", embedding_dedup.signs(code), q.astype(np.float32) @ embedding_dedup.rotation(64)) / factor
    true = np.einsum("ij,ij->i", o, q)
    assert abs((estimate - true).mean()) < 2e-3
    close = true >= 0.95
    assert (estimate[close] >= embedding_dedup.least_estimate(factor[close], 256, 0.95)).mean() > 0.999


@pytest.mark.parametrize("dense", [False, True])
def test_embeddings(spark, dense):
    r = np.random.default_rng(3)
    base = r.standard_normal((200, 64))
    near = np.concatenate([base[:80] + 0.03 * r.standard_normal((80, 64)), base[:50] + 0.3 * r.standard_normal((50, 64)), 2 * base[:10], base[:10]])
    if dense:
        near = np.concatenate([near, base[199] + 0.02 * r.standard_normal((BLOCK_ROWS + 200, 64))])
    v = np.concatenate([base, near]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(None, None), (None, [5.0, 5.0, 5.0]), (90001, None), (90002, []), (90003, [0.0] * 64), (90004, [float("nan")] + [1.0] * 63), (90005, [None] + [1.0] * 63), (90006, [1.0, 2.0]), (90007, [2.0, 4.0]), (90008, [1e-30] * 64), (90009, [float("inf")] * 64)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").withColumn("rep", F.lit("clash")).withColumn("size", F.lit(0))
    got = {x["vec_id"]: x for x in embedding_dedup.near_duplicates(Workspace(spark), df).collect()}
    assert len(got) == len(rows) + len(odd) - 1  # two rows have no id
    u = embedding_dedup.units(v)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    true, found = linked.sum(), sum(got[i]["n_links"] for i in range(len(rows)))
    assert found <= true and found >= 0.995 * true
    for i in range(200):
        if linked[i].any():
            assert got[i]["n_links"] <= linked[i].sum()
    for i, _ in odd:
        assert got[i]["n_links"] == (1 if i in (90006, 90007) else 0) and got[i]["kept"] in (True, False)
    assert got[90007]["component_id"] == 90006 and not got[90007]["kept"] and got[90001]["kept"]
    assert embedding_dedup.near_duplicates(Workspace(spark), df.limit(0)).count() == 0
