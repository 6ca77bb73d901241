"""Shards, collocations and resampling against plain versions and against their SQL."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from chatstream.llm import collocations, resampling, shards
from chatstream.llm.common import stored
from chatstream.llm.queries import ORACLE, QUERIES
from chatstream.llm.ranking import ranked
from chatstream.llm.wordlists import frequent_words

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from check_oracle import TABLES, rows as counted  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert counted(df.columns, df.collect()) == counted(columns, result.fetchall())


# --- ranks


def test_ranks_of_groups_of_any_size(spark):
    frame = spark.range(5000).selectExpr("id", "if(id % 10 < 7, 'hot', if(id % 10 < 9, null, 'x')) AS g", "pmod(id * 7919, 5000) AS v")
    got = ranked(frame, ["g"], [frame.v.desc()], "rank").collect()
    for g in ("hot", None, "x"):
        mine = sorted((r for r in got if r.g == g), key=lambda r: -r.v)
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
    same = ranked(spark.range(300).selectExpr("1 AS g"), ["g"], [], "rank").collect()
    assert sorted(r["rank"] for r in same) == list(range(1, 301))


# --- shards


def plain_shards(docs, n, tolerance):
    key = lambda d: (int(hashlib.md5((d[1] or "").encode()).hexdigest()[:15], 16), -(2**63) if d[0] is None else d[0])
    docs = sorted(docs, key=key)
    size = [len((d[1] or "").encode()) + 8 for d in docs]
    ends = [0]
    for s in size:
        ends.append(ends[-1] + s)
    whole = [0] + [ends[i + 1] for i in range(len(docs)) if i + 1 == len(docs) or key(docs[i])[0] != key(docs[i + 1])[0]]
    cuts = []
    for k in range(1, n):
        target = k * ends[-1] // n
        group = min(whole, key=lambda e: (abs(e - target), e))
        cuts.append(group if abs(group - target) <= int(ends[-1] * tolerance / n) else min(ends, key=lambda e: (abs(e - target), e)))
    found, slots = Counter(), Counter()
    for d, s, end in zip(docs, size, ends[1:]):
        shard = sum(c <= end - s for c in cuts)
        found[d[0], s, zlib.crc32((d[1] or "").encode()), shard, slots[shard]] += 1
        slots[shard] += 1
    return found


def test_shards_equal_a_plain_sort(spark):
    rng = random.Random(5)
    words = ["a", "bb", "ccc", "ü", "\U0001f600"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(400)]
    docs += [(1000 + i, "the same text in a third of the rows") for i in range(300)]
    docs += [(None, None)] * 60 + [(7, "twice")] * 50 + [(-5, ""), (2**62, "x" * 3000), (-(2**63) + 1, "y")]
    frame = spark.createDataFrame([(*d, "l", "clash") for d in docs], SCHEMA + ", shard string")
    for n, tolerance in ((24, 0.01), (3, 0.3), (1, 0.0), (60, 0.0)):
        got = shards.shard_documents(frame, n, tolerance)
        assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got.collect()) == plain_shards(docs, n, tolerance)
    sizes = Counter()
    for (_, size, _, shard, _), n in plain_shards(docs, 24, 0.01).items():
        sizes[shard] += size * n
    longest = 3008
    assert max(sizes.values()) - min(sizes.values()) <= 2 * longest


def test_shards_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = (Counter(map(tuple, shards.shard_documents(docs.repartition(n)).collect())) for n in (1, 13))
    assert one == many
    assert shards.shard_documents(docs.limit(0)).count() == 0


def test_probes_find_borders_over_the_whole_range_of_keys(spark):
    keys = [-(2**63), -1, 0, 1, 2**63 - 1]
    frame = stored(spark.createDataFrame([(k, i, 10) for i, k in enumerate(keys)], "k long, i long, size long"), "t")
    found = shards.borders(frame, ["k", "i"], "size", [10, 20, 25, 40], 0)
    below = [sum((k,) <= b.at[:1] if b.inclusive else (k,) < b.at[:1] for k in keys) for b in found]
    assert below == [1, 2, 2, 4]


# --- collocations


def plain_collocations(docs, order, least, absorbed, top):
    counts, n = Counter(), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for m in range(1, order + 1):
                for i in range(len(ws) - m + 1):
                    counts[lang, tuple(ws[i : i + m])] += 1
    candidates = {k: c for k, c in counts.items() if len(k[1]) > 1 and c >= least}
    gone = set()
    for (lang, p), c in candidates.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                part = (lang, p[i : i + size])
                if 100 * c >= absorbed * counts[part]:
                    gone.add(part)
    found = {}
    for (lang, p), a in candidates.items():
        if (lang, p) not in gone:
            score, _, left, right = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])}


@pytest.mark.parametrize(("order", "words", "common"), [(3, 1000, 1024), (3, 3, 4), (3, 0, 4), (4, 5, 8), (2, 2, 2), (3, 1000, 4), (4, 1000, 10), (2, 1000, 5)])
def test_collocations_equal_a_plain_count(spark, monkeypatch, order, words, common):
    monkeypatch.setattr(collocations, "COMMON", common)
    rng = random.Random(order * 10 + words)
    some = ["The", "of", "ünd", "\x00", "a\x1cb", "x", "y", "\U0001f600z"]
    docs = [(i, "".join(rng.choice(some) + rng.choice([" ", " ", "\t", "  ", ", ", "\n", ".", " ! "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, ""])) for i in range(60)]
    docs += [(None, None, "en"), (3, "", None), (3, "  .. ", "xx")] + [(9, "hot pair of words here", "en")] * 30
    frame = spark.createDataFrame([(*d, 1, "clash") for d in docs], SCHEMA + ", n long, phrase string")
    got = {tuple(r) for r in collocations.collocations(frame, order, 4, 50, 25, words).collect()}
    assert got == plain_collocations(docs, order, 4, 50, 25)


def test_no_text_no_phrases(spark):
    frame = spark.createDataFrame([(1, None, None)], SCHEMA)
    assert collocations.collocations(frame).count() == collocations.collocations(frame.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    frame = spark.createDataFrame([(10**14, 10**14 + 1, 10**14 + 3)], "a long, l long, r long").selectExpr("cast(a AS decimal(15,0)) a", "cast(l AS decimal(15,0)) l", "cast(r AS decimal(15,0)) r")
    got = frame.selectExpr("(cast(1000000 AS decimal(7,0)) * (a * a)) div (l * r) AS s").first().s
    assert got == 10**6 * 10**28 // ((10**14 + 1) * (10**14 + 3))


def test_frequent_words_take_equal_counts_together(spark):
    frame = spark.createDataFrame([("a a a b b c c d",), (None,), ("",)], "text string")
    for limit, want in ((0, []), (1, [b"a"]), (2, [b"a"]), (3, [b"a", b"b", b"c"]), (9, [b"a", b"b", b"c", b"d"])):
        assert [w for w, _ in frequent_words(frame, lambda t: t.encode().split(), limit)] == want
    assert frequent_words(frame, lambda t: t.encode().split(), 9, 2) == [(b"a", 3), (b"b", 2), (b"c", 2)]


# --- resampling


def plain_resampling(docs, target, order, buckets, percent, least):
    def features(text):
        ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(ws), [zlib.crc32(" ".join(ws[i : i + m]).encode()) % buckets for m in range(1, order + 1) for i in range(len(ws) - m + 1)]

    s, t = (Counter(b for text in texts for b in features(text)[1]) for texts in ([d[1] for d in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (sum(s.values()) + buckets) / ((s[b] + 1.0) * (sum(t.values()) + buckets))))
    found = []
    for doc_id, text, _ in docs:
        n, fs = features(text)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, fs))
        found.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in found if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = i + 1
    return Counter(tuple(r[:5]) for r in found)


@pytest.mark.parametrize(("order", "words"), [(1, 1000), (1, 0), (3, 4)])
def test_resampling_equals_a_plain_count(spark, order, words):
    rng = random.Random(order + words)
    some = ["The", "of", "über", "x9", "日本", "zz", "é", "A1"]
    text = lambda k: "".join(rng.choice(some) + rng.choice([" ", ", ", "-", "\n", "\x00", "_"]) for _ in range(k))
    docs = [(i, text(rng.randint(0, 50)), "l") for i in range(80)] + [(None, None, None), (500, "", "l"), (501, "...", "l"), (502, text(5000), "l")]
    target = [text(30) for _ in range(5)] + [None, ""]
    frame = spark.createDataFrame([(*d, 1) for d in docs], SCHEMA + ", score long")
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(frame, aim, 30, 8, order, 97, dictionary_words=words)
    assert Counter(map(tuple, got.collect())) == plain_resampling(docs, target, order, 97, 30, 8)
    assert resampling.resample(frame.limit(0), aim.limit(0)).count() == 0


def test_joined_checksums():
    rng = random.Random(3)
    pairs = [(rng.randbytes(rng.randint(0, 300)), rng.randbytes(rng.choice([0, 1, 7, 300, 70000]))) for _ in range(50)]
    first, second = (np.array([zlib.crc32(p[i]) for p in pairs], dtype=np.uint32) for i in (0, 1))
    got = resampling.joined_crc(first, second, np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]
