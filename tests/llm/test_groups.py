"""Operators across rows: near-duplicates, fingerprints, components, decontamination, quality, pages, archives."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatstream.llm import components, decontaminate, edit_fingerprint, html_templates, minhash, warc, weak_quality

DOCS = "doc_id long, text string"


class Union(dict):
    def __missing__(self, k):
        return k

    def root(self, k):
        while self[k] != k:
            k = self[k]
        return k

    def link(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self[b] = a


def family(rnd, words, size, edits):
    base = [rnd.choice(words) for _ in range(60)]
    for _ in range(size):
        own = list(base)
        for _ in range(rnd.randint(0, edits)):
            own[rnd.randrange(60)] = rnd.choice(words)
        yield " ".join(own)


def plain_groups(docs, words):
    sets = {}
    for d, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        own = {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        sets.setdefault(d, []).append(own)
    union, ids = Union(), sorted(d for d in sets if d is not None)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                union.link(a, b)
    return {d: union.root(d) for d in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, words):
    rnd = random.Random(words)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [t for edits in (2, 6, 9, 14) for t in family(rnd, vocabulary, 25, edits)]
    texts += ["Same Text here", "same text HERE", "same\ttext  here ", "a", "A", "é", "É", None, "", " \n", "long " * 3000, "long " * 3001]
    docs = [(i * 3, t) for i, t in enumerate(texts)] + [(9000, texts[0]), (9000, "another text of this id"), (9001, "another text of this id"), (None, texts[0])]
    rnd.shuffle(docs)
    frame = spark.createDataFrame(docs, DOCS).withColumn("component_id", F.lit("x")).withColumn("bands", F.lit(1))
    rows = minhash.near_duplicates(frame, words).collect()
    want = plain_groups(docs, words)
    assert len(rows) == len(docs)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (want[r.doc_id] == r.doc_id)


def test_no_documents(spark):
    none = spark.createDataFrame([], DOCS)
    assert minhash.near_duplicates(none).count() == 0
    assert edit_fingerprint.fingerprints(none).count() == 0
    assert decontaminate.marked(none, spark.createDataFrame([(1, "a benchmark item of some words")], "item_id long, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    union = Union()
    for a, b in edges:
        union.link(a, b)
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: union.root(n) for e in edges if e[0] != e[1] for n in e}


def test_alike_families_without_links_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK", 8)
    rng = np.random.default_rng(1)
    table = rng.integers(0, 2, (60, 64)).astype(np.uint8)
    table[59], table[58] = table[1], table[30]
    buckets = spark.createDataFrame([(1, i) for i in range(60)], "bucket long, node long")
    signatures = spark.createDataFrame([(i, bytearray(table[i].tobytes())) for i in range(60)], "node long, signature binary")
    found = {r.node: r.component for r in components.linked_components(buckets, signatures, np.uint8, 60).collect()}
    assert found == {1: 1, 59: 1, 30: 30, 58: 30}


def test_fingerprints_equal_a_plain_walk(spark):
    rnd = random.Random(6)
    texts = ["", None, "x", "ab", "é🙂" * 30, "same " * 40, "same " * 40, *("".join(rnd.choices("abcdef gh", k=rnd.randint(1, 400))) for _ in range(40)), "q" * 20_000]
    docs = [(i * 7 - 20, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, DOCS).withColumn("part", F.lit(1)).withColumn("extra", F.lit(1))
    rows = {r.doc_id: r for r in edit_fingerprint.fingerprints(frame).collect()}
    order = sorted(docs, reverse=True)
    print_of = lambda t: edit_fingerprint.Walk(t).fingerprint()
    for k, (d, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[:len(t) - len(t) // 2] + following[:len(t) // 2]
        r = rows[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), print_of(t), print_of(edited))
        assert r.near_edited == edit_fingerprint.likeness(print_of(t), print_of(edited)) and r.near_next == edit_fingerprint.likeness(print_of(t), print_of(following))
    single = edit_fingerprint.fingerprints(spark.createDataFrame([(1, "abcd")], DOCS)).collect()
    assert [(r.near_edited >= 0, r.near_next) for r in single] == [(True, 1.0)]
    assert edit_fingerprint.fingerprints(spark.createDataFrame([(None, "a"), (3, "b"), (3, "c"), (3, "b")], DOCS)).count() == 4


def test_few_edits_keep_a_fingerprint_and_find_each_other(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("abcdefghij klmnop", k=900)) for _ in range(12)]
    near = []
    for t in texts:
        at = rnd.randrange(850, 900)
        near.append(t[:at] + "#" + t[at + 1:])
    likes = [edit_fingerprint.likeness(edit_fingerprint.Walk(a).fingerprint(), edit_fingerprint.Walk(b).fingerprint()) for a, b in zip(texts, near, strict=True)]
    assert min(likes) > 0.85
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *near])], DOCS)
    prints = edit_fingerprint.fingerprints(rows)
    found = {r.doc_id: r.group_id for r in edit_fingerprint.near_groups(prints).collect()}
    assert found == {i: i % 12 for i in range(24)}


def test_decontamination(spark):
    items = [
        (1, "When Anna buys 12 apples for 3 dollars each and then Anna sells 5 of them to her neighbour before noon."),
        (2, "the quick brown fox jumps over the lazy dog while nobody looks at it"), (3, "too short"), (4, None), (5, "what is the capital of peru"),
    ]
    first = "When Bob buys 40 apples for 7 dollars each and then Bob sells 9 of them to her neighbour before noon. End"
    docs = [
        (10, first), (11, first.replace("then Bob", "then Carl")), (12, "x " * 3000 + "THE QUICK BROWN FOX, JUMPS over the lazy\ndog while nobody looks at it%%% yes"),
        (13, "the quick brown fox jumps over the lazy cat as every child in this town will tell you"), (14, None), (15, ""), (16, "well, what is the capital of peru?"),
        (16, "well, what is the capital of peru?"), (None, items[1][1]), (18, "when anna buys 12 apples for 3 dollars each and then anna sells 5 of them to her neighbour before noon"), (17, "12 13 14 15 16 17 18 19 20 21 22 23 24 25"),
    ]
    frame = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("x")).withColumn("words", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = [(r.doc_id, r.contaminated, r.item_ids) for r in decontaminate.marked(frame, bench).collect()]
    assert sorted(f for f in found if f[1]) == [(10, True, [1]), (12, True, [2]), (16, True, [5]), (16, True, [5]), (18, True, [1])]
    assert len(found) == len(docs)
    left = decontaminate.clean(frame, bench)
    assert left.columns == frame.columns and left.count() == 6
    assert decontaminate.marked(frame, bench.limit(0)).filter("contaminated").count() == 0


def test_short_items_and_broken_copies_are_met_at_every_offset(spark):
    words = "amber birch cedar dahlia elder fennel ginger hazel iris juniper kale lotus maple nettle olive parsley quince rose sage thyme".split()
    items = [(n, " ".join(words[:n])) for n in (8, 9, 10)] + [(20, " ".join(reversed(words)))]
    broken = [w if k % 9 != 8 else "other" for k, w in enumerate(reversed(words))]  # runs of eight, 18 of 20 words
    docs = [(10 * n + at, " ".join([*["well"] * at, *words[:n], "end"])) for n in (8, 9, 10) for at in range(3)] + [(200 + at, " ".join([*["well"] * at, *broken])) for at in range(3)]
    found = decontaminate.marked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    # eight of nine words are enough for the item of nine, eight of ten for that of ten
    assert {r.doc_id: r.item_ids for r in found} == {d: [8, 9, 10] if d < 200 else [20] for d, _ in docs}


def test_items_of_numbers_and_names_are_found_word_for_word(spark):
    items = [
        (1, "Compute 12 + 15 * 31 - 7"), (2, "please List Anna, Bert, Carla, Dora, Emil, Fritz, Gerda, Hans and Ida"), (3, "twelve angry men"),
        (4, "A farmer has many cows and buys one more"), (5, "1 2 3 4 5 6 7 8 9 10 11"), (6, "say why 1 2 3 4 5 6 7 8 and then give reasons for your answer here below"),
        (7, "Name Paris"),
    ]
    docs = [
        (10, "Now compute 12 + 15 * 31 - 7 please"), (11, "Now compute 9 + 8 * 4 - 3 please"), (12, "so please List Anna, Bert, Carla, Dora, Emil, Fritz, Gerda, Hans and Ida now"),
        (13, "PLEASE list anna, bert, carla, dora, emil, fritz, gerda, hans and ida"), (14, "please List Otto, Paul, Quinn, Rosa, Sven, Toni, Ute, Vera and Willi now"),
        (15, "we saw Twelve Angry Men again"), (16, "twelve very angry men"), (17, "Question 3. A farmer has many cows and buys one more"), (18, "it is 1 2 3 4 5 6 7 8 9 10 11"),
        (19, "it is 2 3 4 5 6 7 8 9 10 11 12 13"), (20, "well say why 1 2 3 4 5 6 7 8 and"), (21, "they Name Paris"), (22, "they Name London"),
    ]
    found = decontaminate.marked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.item_ids for r in found if r.contaminated} == {10: [1], 12: [2], 13: [2], 15: [3], 17: [4], 18: [5], 21: [7], 19: [5]}


def test_quality_and_toxicity(spark):
    rnd = random.Random(8)
    words = [a + b for a in ("ther", "onin", "edha", "stou", "whan", "lyre") for b in ("ing", "tion", "ent", "ers", "able", "hat")]
    docs, labels = [], []
    for i in range(400):
        own, kind = rnd.choices(words, k=rnd.randint(20, 120)), ("clean", "clean", "symbols", "capitals", "toxic")[i % 5]
        if kind == "symbols":
            own = [w + "%%%" for w in own]
        if kind == "capitals":
            own = [w.upper() + "!!" for w in own]
        if kind == "toxic":
            own[3:3] = ["idiot", "scum", "grrmbl"]
        docs.append((i, " ".join(own)))
        if i % 2:
            labels.append((i, int(kind in ("clean", "toxic")), int(kind == "toxic")))
    frame = spark.createDataFrame([*docs, (900, None), (901, ""), (902, "Yes."), (0, docs[0][1])], DOCS).withColumn("kept", F.lit("x"))
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = weak_quality.scored(frame, weak_quality.train(frame, given)).collect()
    assert len(found) == 404
    kept = {r.doc_id: r.kept for r in found}
    wrong = [i for i in range(400) if kept[i] != (i % 5 < 2)]
    assert len(wrong) <= 8 and all(kept[i] for i in (900, 901, 902))
    unlabelled = weak_quality.scored(frame, weak_quality.train(frame, given.limit(0))).collect()
    assert sum(r.kept != (r.doc_id % 5 < 2) for r in unlabelled if r.doc_id < 400) <= 20
    assert weak_quality.scored(frame.limit(0), weak_quality.train(frame.limit(0), given)).count() == 0


def test_toxic_words_that_no_list_holds_and_short_clean_texts(spark):
    """Labelled documents teach the words; others with them go, and short clean texts stay."""
    rnd = random.Random(21)
    words = [a + b for a in ("ther", "onin", "edha", "stou", "whan", "lyre") for b in ("ing", "tion", "ent", "ers", "able", "hat")]
    abuse = ["grrmbl", "zzyxo", "quarkle", "fnordy", "blattak", "snorfel"]
    docs, labels = [], []
    for i in range(1000):
        own, toxic = rnd.choices(words, k=rnd.randint(15, 90)), i % 10 == 0
        if toxic:
            own[2:2] = rnd.sample(abuse, 3)
        if i % 10 == 1:
            own = [w + "%%%" for w in own]
        docs.append((i, " ".join(own)))
        if i < 500:
            labels.append((i, int(i % 10 != 1), int(toxic)))
    short = [(2000 + i, " ".join(rnd.choices(words, k=rnd.randint(1, 7))).capitalize() + ".") for i in range(100)]
    frame, given = spark.createDataFrame([*docs, *short], DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in weak_quality.scored(frame, weak_quality.train(frame, given)).collect()}
    assert sum(not kept[i] for i in range(500, 1000) if i % 10 == 0) >= 0.9 * 50
    assert sum(not kept[i] for i in range(500, 1000) if i % 10 == 1) >= 0.9 * 50
    assert sum(kept[i] for i in range(1000) if i % 10 > 1) >= 0.98 * 800
    assert all(kept[i] for i, _ in short)


def test_a_text_nobody_judges_is_kept():
    eager = weak_quality.Scorer((np.zeros(1 << 16, np.float32), 9.0), None)
    assert eager.shares("Yes.") == (0.0, 0.0) and eager.shares("a | b | c")[0] > 0.99 and eager.shares(None) == (0.0, 0.0)
    long = "tion " * 200_000
    assert eager.shares(long)[0] > 0.99


def test_a_rare_class_is_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(weak_quality, "TRAIN_DOCUMENTS", 180)
    rnd = random.Random(11)
    words = [a + b for a in ("ther", "onin", "edha", "stou", "whan", "lyre") for b in ("ing", "tion", "ent", "ers", "able", "hat")]
    toxic = set(range(0, 6000, 300))
    docs = [(i, " ".join([*rnd.choices(words, k=25), *(["idiot", "scum", "moron"] if i in toxic else [])])) for i in range(6000)]
    frame = spark.createDataFrame(docs, DOCS)
    given = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 6000, 3)], "doc_id long, quality int, toxic int")
    found = weak_quality.scored(frame, weak_quality.train(frame, given)).filter("not kept").collect()
    assert {r.doc_id for r in found} == toxic
    assert weak_quality.quotas({"--": 10**9, "-+": 5, "+-": 300}) == {"--": 154, "-+": 5, "+-": 20}


def test_label_model_finds_who_is_right():
    rnd = random.Random(9)
    counts = collections.Counter()
    for _ in range(4000):
        bad = rnd.random() < 0.3
        counts["".join("0" if rnd.random() < 0.2 else "+-"[(rnd.random() < right) != bad] for right in (0.95, 0.9, 0.55, 0.9))] += 1
    found = weak_quality.posteriors(dict(counts))
    assert found["++-+"] > 0.95 and found["--+-"] < 0.05
    assert weak_quality.posteriors({}) == {}


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav>menu</nav><div class="cookie-notice">We use cookies</div><main><article><header><h2>Head {0}</h2></header><p>One &lt;b&gt; {0}
  two<br>three</p><aside>side</aside><div class="ad">buy</div><p>Four <a href="x">link</a> five<form><p>in form</form><p>Six<ul><li>a<li>b</ul><section id="comments"><p>first!</p></section></article></main><div class="sidebar">sb</div><footer>f</footer><script>var a="<p>x</p>"</script></body></html>"""
PLAIN = """<html><body><div class="n1"><a href=1>Home</a> <a href=2>About</a></div><div class="x1"><h1>Story {0}</h1><p>{1}</p><p>{2}</p></div><div class="z"><p>Read more of our stories every day of the week and tell everybody</p></div></body></html>"""


def test_main_text(spark):
    rnd = random.Random(10)
    say = lambda: " ".join(rnd.choices(["alpha", "beta", "gamma", "delta", "epsilon"], k=40))
    said = [(say(), say()) for _ in range(30)]
    rows = [(i, f"http://a.example/{i}", PLAIN.format(i, *s)) for i, s in enumerate(said)]
    rows += [(100, "http://b.example/", PAGE.format("x")), (101, None, None), (102, "http://b.example/", ""), (103, "nothing", "just text &amp; &#233;"), (104, "http://c.example", "<div>" * 3000 + "deep"), (100, "http://b.example/", PAGE.format("x"))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("x"))
    found = html_templates.main_texts(frame).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    by = {r.page_id: r.text for r in found}
    assert [by[i] for i in range(30)] == [f"Story {i}\n{a}\n{b}" for i, (a, b) in enumerate(said)]
    assert by[100] == "Head x\nOne <b> x two three\nFour link five\nSix\na\nb"
    assert [by[i] for i in range(101, 105)] == ["", "", "just text & é", "deep"]
    assert html_templates.main_texts(frame.limit(0)).count() == 0


def test_equivalence_classes_nest():
    pages = [["body", "ul", *["li", "a"] * n, "div", "end"] for n in (2, 3, 5)]
    classes = html_templates.equivalence_classes(pages)
    assert sorted(classes) == [["body", "ul", "div", "end"], ["li", "a"]]
    outer, inner = classes.index(["body", "ul", "div", "end"]), classes.index(["li", "a"])
    assert html_templates.nested(classes, pages) == {inner: outer}
    assert html_templates.equivalence_classes([["a", "b"], ["b", "a"]]) == []


def test_tokens_are_told_apart_by_their_slot():
    """``p`` comes in two slots of the frame's class, once to four times and twice."""
    pages = [["top", *["p"] * (k + 1), "ad", "p", "p", "end"] for k in range(4)]
    assert html_templates.equivalence_classes(pages) == [["top", "ad", "end"], [html_templates.Role("p", 5)], [html_templates.Role("p", 4)]]
    # tokens found equally often in different slots are no class; nor is a token whose order differs
    pages = [["top", *["a"] * n, "mid", *["b"] * n, "end"] for n in (1, 2, 3)]
    assert html_templates.equivalence_classes(pages) == [["top", "mid", "end"], ["a"], ["b"]]
    assert html_templates.equivalence_classes([["top", "x", "mid", "end"], ["top", "mid", "end", "x"], ["top", "mid", "x", "end"]])[0] == ["top", "mid", "end"]


def test_classes_nest_on_random_pages():
    """Occurrence vectors, order and nesting of what is found, by brute force."""
    rnd = random.Random(12)
    for _ in range(200):
        frame = rnd.sample("abcdefgh", 5)
        pages = []
        for _ in range(5):
            page = []
            for k, t in enumerate(frame):
                page += [t, *["xy", "z", "w"][k % 3] * rnd.randrange(3), *rnd.choices("uv", k=rnd.randrange(2))]
            pages.append(page)
        classes, inside = html_templates.deduced(pages, [True] * 5)
        assert [t for t in classes[0] if t in frame] == frame
        plain = [c for c in classes if not any(isinstance(t, html_templates.Role) for t in c)]
        homes = html_templates.nested(plain, pages)
        assert plain != classes or all(homes[k] == 0 for k in range(1, len(plain)))
        for c in plain:
            vectors = {tuple(p.count(t) for p in pages) for t in c}
            assert len(vectors) == 1 and sum(map(bool, *vectors)) == 5
            assert all([t for t in p if t in c] == c * p.count(c[0]) for p in pages)
        assert all(i for p, row in zip(pages, inside) for t, i in zip(p, row) if t in frame)


def test_the_template_decides_inside_a_marked_article():
    rnd = random.Random(13)
    words = [a + b for a in ("ther", "onin", "edha", "stou", "whan") for b in ("ing", "tion", "ent", "ers", "able", "hat")]
    say = lambda n: " ".join(rnd.choices(words, k=n))
    html = "<html><body><article><h1>{}</h1><div class=k>Read this in our app</div><p>{}</p><p>{}</p><p>Tell your friends about us</p></article></body></html>"
    said = [(f"Story {k}", say(30), say(20)) for k in range(20)]
    texts, _ = html_templates.extract_block([html.format(*s) for s in said])
    assert texts == ["\n".join(s) for s in said]
    # the same words in another slot are the article's own
    pages = [html.format(h, a, b).replace("</article>", "<div class=k>Read this in our app</div></article>" if k == 3 else "</article>") for k, (h, a, b) in enumerate(said)]
    assert html_templates.extract_block(pages)[0][3].count("Read this in our app") == 1
    # versions of one article repeat its text, not the template's
    parts = [say(6) for _ in range(12)]
    versions = [f"<article><h1>Versions</h1>{''.join(f'<p>{say(6) if j == k else p}</p>' for j, p in enumerate(parts))}</article>" for k in range(12)]
    texts, _ = html_templates.extract_block(versions)
    assert all(t.count("\n") == 12 and t.startswith("Versions") for t in texts)
    # pages may have nothing in common, and two are too few to tell
    assert html_templates.deduced([["a"], [], ["b"], ["c"]], [True] * 4) == ([], [[False], [], [False], [False]])
    assert html_templates.extract_block(["", "a", "<p>b", "<div>c"])[0] == ["", "a", "b", "c"]
    assert html_templates.extract_block([html.format(*s) for s in said[:2]])[0][0].count("\n") == 4


def test_archives(spark):
    rows = [(i, f"http://www.Example.com:80/{i % 4}?q#f", f"<p>é {i % 7}\r\n\r\nWARC/1.1\r\n") for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "x\r\ny", "only"), (None, "http://a.b/", "twice"), (103, "http://a.b/", "twice"), (103, "http://a.b/", "twice"), (104, "http://a.b/", "z" * 200_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("x")).withColumn("key", F.lit(1))
    found = warc.archived(frame).collect()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        first = last[h or ""]
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), *(("response", None) if first == i else ("revisit", first))))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=lambda r: str(r)) == sorted(want, key=lambda r: str(r))
    order = [(r.key, r.captured_at, -1 if r.page_id is None else r.page_id) for r in found]
    assert order == sorted(order) and "com,example)/0?q" in {o[0] for o in order}
    assert warc.archived(frame, min_bytes=100).filter("record_type = 'revisit'").count() == 0
    assert warc.archived(frame.limit(0)).count() == 0


def test_loser_tree_merges_any_number_of_runs():
    rnd = random.Random(11)
    for k in range(8):
        runs = [sorted((rnd.randrange(20), r) for _ in range(rnd.randrange(6))) for r in range(k)]
        assert list(warc.merge_runs([[(x,) for x in r] for r in runs])) == sorted((x,) for r in runs for x in r)


def test_a_slice_of_texts_is_cut_into_shingles_in_little_memory():
    """Each Python worker of an executor holds one at a time."""
    import tracemalloc

    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    words = [f"word{k * 7919 % 4001}" for k in range(4001)]
    text = " ".join(words[:120])
    column = pa.array([text] * (6_000_000 // len(text)))
    tracemalloc.start()
    try:
        _, first = next(minhash.slices(column))
        minhash.shingle_sets(first, 5)
        assert tracemalloc.get_traced_memory()[1] < 80_000_000
    finally:
        tracemalloc.stop()
