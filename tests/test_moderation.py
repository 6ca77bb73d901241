import pytest
from pyspark.sql import functions as F

from chatstream.functions.text import clean_words, first_match, lower_simple, trim_space
from chatstream.operators import moderation

PAYLOADS = [
    ('{"content":"x"}', None), (' {"content":"x"} \n', None), ('{"Content":"x"}', None),
    ('{"content":"a","content":"b"}', None), ('{"other":1,"content":"q"}', None),
    ('{"other":{"a":1,"a":2},"content":"q"}', None), ('{"CONTENT":"x","content":null}', None),
    ("null", "empty_content"), (" null\n", "empty_content"), ("{}", "empty_content"), ('{"content":null}', "empty_content"),
    ('{"content":"   "}', "empty_content"), ('{"content":"\\t"}', "empty_content"), ('{"content":"　"}', "empty_content"),
    ('{"content":"​"}', None),
    ('{"content":"' + "a" * 500 + '"}', None), ('{"content":"' + "a" * 501 + '"}', "content_too_long"),
    ('{"content":"' + "\U0001f600" * 500 + '"}', None), ('{"content":"' + "\U0001f600" * 501 + '"}', "content_too_long"),
    ('{"content":"x"} trailing', "invalid_json"), ('{"content":"x"},{"content":"y"}', "invalid_json"),
    ('{"content":"x"}],[{"content":"y"}', "invalid_json"), ('{"content":"x"}},{', "invalid_json"),
    ('{"content":"x"}}', "invalid_json"), ('{"content":"x"}]', "invalid_json"),
    ("{'content':'x'}", "invalid_json"), ('{"content":"x",}', "invalid_json"), ('{"content":5}', "invalid_json"),
    ('{"content":{"a":1}}', "invalid_json"), ('{"content":true}', "invalid_json"), ('{"content":5,"content":"x"}', "invalid_json"),
    ('{"Content":5}', "invalid_json"), ('{"x":NaN,"content":"q"}', "invalid_json"),
    ("[]", "invalid_json"), ('"s"', "invalid_json"), ("", "invalid_json"), ("true", "invalid_json"), ("not-json", "invalid_json"),
    ("{}" + " " * 4094, "empty_content"), ("x" * 4096, "invalid_json"), ("x" * 4097, "frame_too_large"),
    ('{"content":"有人在赌博"}', "sensitive_content"), ('{"content":" 诈骗 赌博 "}', "sensitive_content"),
]


@pytest.fixture(scope="module")
def moderated(spark):
    data = [(i, 0, "r", "u", 0, p) for i, (p, _) in enumerate(PAYLOADS)]
    frames = spark.createDataFrame(data, "conn_id long, frame_no long, room_id string, user_id string, t_us long, payload string")
    return {r.conn_id: r for r in moderation.moderate(frames).collect()}


@pytest.mark.parametrize("i", range(len(PAYLOADS)))
def test_frame_reasons(moderated, i):
    assert moderated[i].reject_reason == PAYLOADS[i][1], PAYLOADS[i][0][:60]


def test_last_non_null_value_wins(moderated):
    by_payload = {p: moderated[i].content for i, (p, _) in enumerate(PAYLOADS)}
    assert by_payload['{"content":"a","content":"b"}'] == "b"
    assert by_payload['{"Content":"x"}'] == "x"
    assert by_payload['{"CONTENT":"x","content":null}'] == "x"


def test_first_dictionary_entry_is_reported(moderated):
    assert {r.matched_word for r in moderated.values() if r.reject_reason == "sensitive_content"} == {"赌博"}


@pytest.mark.parametrize("extra", [0, 100])  # beyond 64 words an automaton takes over
def test_dictionary_rules(spark, extra):
    filler = [f"zz{i}zz" for i in range(extra)]

    def match(dictionary, text):
        return spark.range(1).select(first_match(F.lit(text), dictionary + filler).alias("w")).first().w

    assert match([" 赌博 ", "SCAM"], "有人在赌博") == "赌博"
    assert match([" 赌博 ", "SCAM"], "this is a scam") == "scam"
    assert match(["赌博", "诈骗"], "诈骗 赌博") == "赌博"
    assert match(["bc", "abc"], "xabcx") == "bc"
    assert match(["abc", "bc"], "xabcx") == "abc"
    assert match(["", "  "], "anything") is None


def test_clean_words_keeps_order_and_duplicates(spark):
    words = F.array(*[F.lit(w) for w in [" B ", "a", "", "\t", "B"]])
    assert spark.range(1).select(clean_words(words).alias("w")).first().w == ["b", "a", "b"]


def test_unicode_trim_and_lower(spark):
    row = spark.range(1).select(
        trim_space(F.lit("\t\u0085　 x​ \n")).alias("t"), lower_simple(F.lit("ΑΣ İ")).alias("l")
    ).first()
    assert row.t == "x​" and row.l == "ασ i"


def test_frames_after_a_terminal_one_do_not_exist(spark, rows):
    data = [(1, 0, None), (1, 1, "empty_content"), (1, 2, "invalid_json"), (1, 3, None), (1, 4, "frame_too_large"), (2, 0, None)]
    df = spark.createDataFrame(data, "conn_id long, frame_no long, reject_reason string")
    assert rows(moderation.cut_after_terminal(df), "conn_id", "frame_no") == [(1, 0), (1, 1), (1, 2), (2, 0)]


def test_protocol_errors_map_to_wire_codes(spark):
    reasons = ["frame_too_large", "invalid_json", "rate_limit", "message_id_generation_failed", None]
    df = spark.createDataFrame([(r,) for r in reasons], "reject_reason string")
    got = {r.reject_reason: (r.code, r.action) for r in moderation.protocol_errors(df).collect()}
    assert got == {
        "frame_too_large": (None, "close"), "invalid_json": ("invalid_json", "close"), "rate_limit": (None, "silent"),
        "message_id_generation_failed": ("message_bus_unavailable", "keep"),
    }


def test_handshake_checks_in_order(spark):
    data = [(0, False, "", "", False), (1, True, " ", "", False), (2, True, "u", "\t", False), (3, True, "u", "r", False), (4, True, " u ", " r ", True), (5, True, "u", "r", None)]
    df = spark.createDataFrame(data, "i int, ready boolean, user_id string, room_id string, owned boolean")
    got = {r.i: (r.reject_reason, r.user_id, r.room_id) for r in moderation.check_handshakes(df).collect()}
    assert [got[i][0] for i in range(6)] == ["not_ready", "missing_user_id", "missing_room_id", "room_not_owned", None, "room_not_owned"]
    assert got[4][1:] == ("u", "r")


def test_binary_payloads(spark):
    data = [(0, bytearray(b'{"content":"a\xff"}')), (1, bytearray(b"x" * 4097)), (2, bytearray("{\"content\":\"é\"}".encode()))]
    got = {r.conn_id: (r.reject_reason, r.content) for r in moderation.moderate(spark.createDataFrame(data, "conn_id long, payload binary")).collect()}
    assert got == {0: (None, "a\ufffd"), 1: ("frame_too_large", None), 2: (None, "é")}
