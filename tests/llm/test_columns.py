"""Operators on single rows: chat examples, pieces, personal data, languages, against plain versions."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatstream.llm import chat_examples, langid, pieces, pii
from chatstream.llm.queries import tokenizer_path

SAID = r"\### Assistant: </turn> ok"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- chat examples


def test_chat_examples_read_back(spark):
    rows = [
        (1, 0, "user", "a & b <turn>"), (1, 1, "assistant", SAID), (1, 2, "user", "&lt;"), (1, 3, "assistant", "é🙂\n</turn>\n"), (1, 3, "assistant", "tie"),
        (2, 0, "us\ner", None), (3, None, None, None), (None, 0, "assistant", "x"), (-7, 0, "user", SAID), (-7, 1, "assistant", SAID),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("extra")).withColumn("turns", F.lit(1))
    found = {r.conv_id: r for r in chat_examples.formatted_digest(frame).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: tuple((v is not None, v or 0 if not isinstance(v, str) else v) for v in (r[1],)) + (r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(found) == set(by)
    for conv, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        got = found[conv]
        assert (got.n_turns, got.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (got.loss_chars, got.loss_sha256) == (len(loss), sha(loss))


def test_every_assistant_turn_is_an_example_with_what_precedes_it(spark):
    frame = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a<"), (1, 2, "user", "r"), (1, 3, "assistant", "b")], "conv_id long, turn long, role string, text string")
    formatted = chat_examples.format_conversations(frame)
    texts = [(r.example, r.context, r.target) for r in chat_examples.with_texts(formatted).orderBy("example").collect()]
    first = "<turn>user\nq</turn>\n<turn>assistant\n"
    assert texts == [(0, first, "a&lt;"), (1, f"{first}a&lt;</turn>\n<turn>user\nr</turn>\n<turn>assistant\n", "b")]
    assert chat_examples.examples(formatted).count() == 2
    assert chat_examples.formatted_digest(frame.limit(0)).count() == 0


def test_the_loss_text_comes_from_the_examples(spark, monkeypatch):
    frame = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a<"), (1, 2, "assistant", "b"), (None, 0, "assistant", "x"), (2, 0, "user", "r")], "conv_id long, turn long, role string, text string")
    made = chat_examples.with_texts
    monkeypatch.setattr(chat_examples, "with_texts", lambda formatted: made(formatted).withColumn("target", F.concat("example", "target")))
    found = {r.conv_id: (r.n_turns, r.loss_chars, r.loss_sha256) for r in chat_examples.formatted_digest(frame).collect()}
    assert found == {1: (3, 5, sha("0a<1b")), None: (1, 2, sha("0x")), 2: (1, 0, sha(""))}


# --- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(pieces.read_model(tokenizer_path()))


def test_pieces_equal_the_library(vocabulary):
    rnd = random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "▁", "日", "🙂", "\x00", "!!", "%%%", "er", "e", "s", "1", "\r", "́", "ﬁ", "ab" * 90]
    texts = ["", " ", "\n", "▁", *("".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(1500))]
    ids, _, numbers = vocabulary.encode_slice(texts)
    for text, own in zip(texts, numbers, strict=True):
        mine = [i for k in own.tolist() for i in ids[k]]
        assert mine == vocabulary.library.encode(text)
        assert vocabulary.decode(mine) == vocabulary.library.decode(mine) == text.replace("▁", " ")


def test_rows_and_heap_agree(vocabulary):
    for text in ("the", "aaaaaaaaaaaa", "internationalisation", "▁▁▁▁▁", "日本のx"):
        points = np.array([ord(c) for c in text], np.int64)
        assert vocabulary.encode_segments(points, np.array([0]), np.array([len(points)]))[0] == vocabulary.merge_long(text)


def test_encoded_documents(spark, vocabulary):
    texts = ["one two", None, "", "one two", "x" * 30_000, "é " * 5000]
    frame = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = {r.doc_id: r for r in pieces.encode_documents(frame, tokenizer_path()).collect()}
    assert pieces.encode_documents(frame, tokenizer_path()).columns == ["doc_id", "text", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    for k, t in enumerate(texts):
        ids = vocabulary.library.encode(t or "", add_eos=True)
        written = " ".join(map(str, ids))
        assert (rows[k].n_tokens, rows[k].ids, rows[k].ids_sha256, rows[k].decoded_sha256) == (len(ids), written, sha(written), sha(t or ""))
    assert pieces.encoded_digest(frame.limit(0), tokenizer_path()).count() == 0


def test_a_batch_of_texts_is_encoded_in_little_memory(vocabulary):
    """Each Python worker of an executor holds one slice at a time."""
    rnd = random.Random(3)
    words = ["".join(rnd.choices("aeinorst", k=rnd.randint(2, 9))) for _ in range(20_000)]
    texts = [None, *(" ".join(rnd.choices(words, k=300)) for _ in range(1_500))]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    done = 0
    tracemalloc.start()
    try:
        for part in pieces.slices(batch, 1):
            counts, *_ = pieces._encoded(vocabulary, [t or "" for t in part.column(1).to_pylist()], True)
            done += len(counts)
        assert done == len(texts) and tracemalloc.get_traced_memory()[1] < 60_000_000
    finally:
        tracemalloc.stop()


# --- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(digits[::-1]))
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def in_words(spans) -> str:
    return ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in spans)


def test_personal_data(spark):
    rnd = random.Random(5)
    parts = ["a", "1", "22", "333", "4111 1111 1111 1111", "4111111111111111", "+", "@", ".", "-", " ", "(", ")", "x.y@", "_", "%", "﷐", "é", "🙂", "256", "1.2.3.4", "a@b.c", "\n"]
    texts = [None, "", "1" * 20_000, "a@b.c " * 500, *("".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(300))]
    more = ["mail bob [at] example [dot] org", "see 10[.]0[.]0[.]1 there", "not 10[.]0[.]0[.] here"]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, *more])], "doc_id long, text string, spans int")
    found = {r.doc_id: r for r in pii.found_digest(frame).collect()}
    assert len(found) == len(texts) + len(more)
    for k, text in enumerate([*texts, *more]):
        want = plain_spans(text or "")
        assert found[k].base_sha256 == sha(in_words(want)), text
        assert [found[k][f"n_{kind}"] for kind in PATTERNS] == [sum(s[1] == j for s in want) for j in range(4)]
        assert set(filter(None, in_words(want).split(","))) <= set(found[k].spans.split(","))
    assert found[len(texts)].spans == "email:5:31"
    assert found[len(texts) + 1].spans == "ip:4:18"
    assert found[len(texts) + 2].spans == ""
    assert pii.found_digest(frame.limit(0)).count() == 0


def test_redaction(spark):
    frame = spark.createDataFrame([(1, "x a@b.c, +1 (017) 555-7713 y", 28, "s"), (2, None, None, "t"), (3, "clean 12", 8, None), (4, "+4111 1111 1111 1111z", 21, "u")], "doc_id long, text string, n_chars long, base string")
    rows = pii.redact(frame, pii.boost([])).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(1, "x [EMAIL], [PHONE] y", 20, "s"), (2, None, None, "t"), (3, "clean 12", 8, None), (4, "+[CARD]z", 8, "u")]


def test_boosted_trees_learn_what_passes():
    rows = [(2, 6, 0, 0, 0, c, 1, 1, fold, 90 if c == 2 else 5, 5 if c == 2 else 90) for c in (0, 2, 5) for fold in (0, 1)]
    trees = pii.boost(rows)
    x = np.array([r[:8] for r in rows[::2]])
    scores = trees.prior + sum(pii._value(t, x) for t in trees.trees)
    assert scores[1] > 0 > max(scores[0], scores[2])
    assert pii.boost([]).trees == []


# --- languages


def test_languages(spark):
    rnd = random.Random(2)
    words = {"en": ["the", "and", "thing", "with"], "de": ["der", "und", "schein", "für"], "fr": ["les", "eaux", "dans", "été"]}
    rows = [(i, " ".join(rnd.choices(words[k], k=12)), k) for i, k in enumerate(rnd.choices(list(words), k=240))]
    frame = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 !?", "en"), (902, "the and", None), (903, "", "de"), (None, "und der", "de"), (5, rows[5][1], rows[5][2])], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    found = langid.identify(frame, langid.fit(frame)).collect()
    assert len(found) == 246
    by = {r.doc_id: r for r in found}
    assert np.mean([by[i].lang_pred == k for i, _, k in rows if by[i].held_out]) > 0.97
    assert [by[i].lang_pred for i in (900, 901, 903)] == ["und"] * 3 and by[902].lang_pred == "en" and by[None].held_out
    assert all(0 <= r.score <= 1 for r in found)
    nothing = frame.limit(0)
    assert langid.identify(frame, langid.fit(nothing)).filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(nothing, langid.fit(nothing)).count() == 0


def test_temperature_calms_an_overconfident_model():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 2000)
    right = rng.random(2000) < 0.8
    scores = np.where((labels == 1) == right, 1, -1)[:, None] * np.array([-6.0, 6.0])
    assert langid.softmax(np.array([-6.0, 6.0]) / langid.temperature(scores, labels))[1] == pytest.approx(0.8, abs=0.03)
