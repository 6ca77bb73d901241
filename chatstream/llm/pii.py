"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators of high recall propose spans: the four base patterns, and looser ones (spelled-out mail addresses, phone
numbers without a plus, defanged and version 6 addresses, card numbers with odd separators). Each candidate has format
and context features of few values each. Base matches that pass or fail their check (Luhn, parts at most 255, number of
digits) are the labels; they are counted by feature values over all documents, and boosted trees are fitted to that table
of counts, whose size the feature values bound. The trees become one column expression. A proposed span is added when
its score reaches the threshold of its kind, calibrated on documents the trees did not see, and it overlaps no base span.

Positions are code points. They come from splitting a text at marks set around each match, which is linear in its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatstream.functions.pinning import pinned
from chatstream.llm.common import stored, text_or_empty

KINDS = ["email", "ip", "card", "phone"]
#: Set around matches; a text's own is put as another non-character first, which no pattern matches either.
MARK, OTHER = "﷐", "﷑"

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: kind, pattern, a cheap test that texts with a match pass. Possessive and guarded, so that no text takes more than
#: linear time or deep recursion: at a run of characters only its beginning (or the end of a match) can begin a match.
BASE = [
    ("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", lambda t: t.contains("@")),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]")),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9][\x20-]?[0-9]")),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+")),
]
_AT, _DOT = r"(?:\x20?[(\[{]\x20?(?:at|AT|@)\x20?[)\]}]\x20?|\x20(?:at|AT)\x20|\x20?@\x20?)", r"(?:\x20?[(\[{]\x20?(?:dot|DOT|\.)\x20?[)\]}]\x20?|\x20(?:dot|DOT)\x20)"
LOOSE = [
    ("email", rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+{_AT}{_HOST}{{1,63}}+(?:{_DOT}{_HOST}{{2,63}}+){{1,4}}+", lambda t: F.lower(t).contains("dot") | t.rlike(r"[(\[{]\x20?\.")),
    ("ip", r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3})(?![0-9A-Za-z:])", lambda t: t.rlike(r"[0-9A-Fa-f](?::|\[\.\])[0-9A-Fa-f]")),
    ("card", r"(?<![0-9])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])", lambda t: t.rlike(r"[0-9]{4}[./_][0-9]{4}")),
    ("phone", r"(?<![0-9A-Za-z+.=\"-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])", lambda t: t.rlike(r"[0-9][)\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3}")),
]
# fixed values: words that stand before personal data or before other numbers
CONTEXT = [
    r"(?i)(?:tel|phone|call|mobile|fax|cell|whatsapp)\b[^A-Za-z]*$", r"(?i)(?:card|visa|credit|mastercard|amex|payment|debit)\b[^A-Za-z]*$",
    r"(?i)(?:e-?mail|contact|write to|reach)\b[^A-Za-z]*$", r"(?i)(?:ip|host|server|address|from)\b[^A-Za-z]*$", r"(?i)(?:token|key|hash|id|sha|secret|version|order|isbn|serial)\b[^A-Za-z]*$",
]
FEATURES = ["kind", "digits", "separators", "before", "after", "context", "uniform", "first"]
ROUNDS, DEPTH, RATE, LEAST_PRECISION = 24, 3, 0.3, 0.95


def _spans(parts: Column, starts: Column, kind: int, base: bool) -> Column:
    """Candidates from a text split at its marks, where every second part is a match, and the start of each part."""
    def candidate(i: Column) -> Column:
        before, after = F.substring(F.get(parts, i - 1), -32, 32), F.substring(F.get(parts, i + 1), 1, 1)
        return _candidate(kind, base, F.get(starts, i), F.get(parts, i), before, after)

    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), candidate)).otherwise(_none())


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x)


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,kind:int,base:boolean,valid:boolean," + ",".join(f"{f}_:int" for f in FEATURES[1:]) + ">>)")


def _candidate(kind: int, base: bool, start: Column, value: Column, before: Column, after: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    other = F.regexp_replace(value, "[0-9A-Za-z]", "")
    n = F.char_length(digits)
    bins = sum(((n >= k).cast("int") for k in (1, 7, 10, 12, 14, 16, 17, 20)), F.lit(0))
    edge = lambda c: F.when(c.rlike("[A-Za-z]"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike("[\"'=]"), 3).otherwise(0)
    context = F.lit(0)
    for k in range(len(CONTEXT), 0, -1):
        context = F.when(before.rlike(CONTEXT[k - 1]), k).otherwise(context)
    found = [bins, F.least(F.char_length(other), F.lit(4)), edge(F.substring(before, -1, 1)), edge(after), context,
             (F.char_length(F.replace(other, F.substring(other, 1, 1))) == 0).cast("int"), F.when(digits.rlike("^[3-6]"), 1).otherwise(0)]
    return F.struct(
        start.alias("start"), (start + F.char_length(value)).alias("end"), F.lit(kind).alias("kind"), F.lit(base).alias("base"),
        F.coalesce(_valid(kind, value, digits, n) if base or KINDS[kind] == "card" else F.lit(True), F.lit(False)).alias("valid"),
        *(f.cast("int").alias(f"{name}_") for f, name in zip(found, FEATURES[1:], strict=True)))


def _valid(kind: int, value: Column, digits: Column, n: Column) -> Column:
    if KINDS[kind] == "email":
        return F.lit(True)
    if KINDS[kind] == "ip":
        significant = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(significant, lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))
    if KINDS[kind] == "phone":
        return n.between(10, 15)
    # Luhn: of every second digit from the right, twice its value less 9 if that is over 9
    single = F.split(F.reverse(digits), "")
    doubled = F.transform(single, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.when(n.between(14, 19), F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0).otherwise(False)


def with_candidates(documents: DataFrame) -> DataFrame:
    """Adds ``candidates``: every match of every generator in the whole text."""
    text = text_or_empty("text")
    out = documents.withColumn("_t", pinned(F.when(text.contains(MARK), F.translate(text, MARK, OTHER)).otherwise(text)))
    for k, (kind, pattern, test) in enumerate(BASE + LOOSE):
        marked = F.split(F.regexp_replace("_t", f"({_shifted(pattern)})", f"{MARK}$1{MARK}"), MARK, -1)
        out = out.withColumn(f"_p{k}", pinned(F.when(test(F.col("_t")), marked)))
    for k, (kind, _, _) in enumerate(BASE + LOOSE):
        out = _with_starts(out, f"_p{k}", f"_s{k}")
        spans = _spans(F.col(f"_p{k}"), F.col(f"_s{k}"), KINDS.index(kind), k < len(BASE))
        out = out.withColumn(f"_c{k}", F.when(F.col(f"_p{k}").isNotNull(), spans).otherwise(_none()))
    names = [f"_c{k}" for k in range(len(BASE + LOOSE))]
    return out.withColumn("candidates", F.concat(*names)).drop("_t", *names, *(f"_{c}{k}" for k in range(len(names)) for c in "ps"))


def _with_starts(rows: DataFrame, parts: str, name: str, block: int = 64) -> DataFrame:
    """Adds the start of each part: sums of lengths, first of blocks, then inside the block, so that it takes little more than linear time.

    Each step is pinned: inlined into the next one's lambda it would be done again for every part.
    """
    inner = F.sequence(F.lit(0), F.size(parts) - 1)
    blocks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / block).cast("int"))
    rows = rows.withColumn("_l", pinned(F.transform(parts, lambda p: F.char_length(p))))
    rows = rows.withColumn("_b", pinned(F.transform(blocks, lambda c: _total(F.slice("_l", c * block + 1, F.lit(block))))))
    rows = rows.withColumn("_b", pinned(F.transform(blocks, lambda c: _total(F.slice("_b", F.lit(1), c)))))
    start = lambda i: F.get("_b", F.floor(i / block).cast("int")) + _total(F.slice("_l", F.floor(i / block).cast("int") * block + 1, i % block))
    return rows.withColumn(name, pinned(F.transform(inner, start))).drop("_l", "_b")


def _shifted(pattern: str) -> str:
    """The pattern inside one more group: references to groups count one up."""
    return pattern.replace(r"\1", r"\2")


@dataclass
class Trees:
    """Boosted trees and the threshold of each kind. A tree is a leaf value or (feature, limit, at most, above)."""

    trees: list
    prior: float
    thresholds: list[float]

    def score(self, candidate: Column) -> Column:
        """Log odds of a candidate."""
        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            f, limit, low, high = tree
            name = "kind" if f == 0 else f"{FEATURES[f]}_"
            return F.when(candidate[name] <= limit, of(low)).otherwise(of(high))

        return sum((of(t) for t in self.trees), F.lit(self.prior))

    def accepted(self, candidate: Column) -> Column:
        least = F.get(F.array(*map(F.lit, self.thresholds)), candidate["kind"])
        return ~candidate["base"] & candidate["valid"] & (self.score(candidate) >= least)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    best = (1e-6, None)
    if depth:
        whole = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            for limit in np.unique(x[:, f])[:-1].tolist():
                low = x[:, f] <= limit
                gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - whole
                if gain > best[0]:
                    best = (gain, (f, limit, low))
    if best[1] is None:
        return float(-RATE * g.sum() / (h.sum() + 1))
    f, limit, low = best[1]
    return f, limit, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, limit, low, high = tree
    return np.where(x[:, f] <= limit, _value(low, x), _value(high, x))


def boost(counts: list[tuple]) -> Trees:
    """Trees from rows (feature values..., fold, passed, failed): fitted on fold 0, thresholds from fold 1.

    A kind without failing matches gets even odds as its threshold; without any rows all scores are even odds too.
    """
    table = np.array([list(map(int, r)) for r in counts], np.int64).reshape(-1, len(FEATURES) + 3)
    fit, check = table[table[:, -3] == 0], table[table[:, -3] == 1]
    x, yes, no = fit[:, :-3], fit[:, -2].astype(float), fit[:, -1].astype(float)
    prior = float(np.log((yes.sum() + 1) / (no.sum() + 1)))
    score, trees = np.full(len(x), prior), []
    for _ in range(ROUNDS if len(x) else 0):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grow(x, (yes + no) * p - yes, (yes + no) * p * (1 - p), DEPTH))
        score += _value(trees[-1], x)
    thresholds = []
    held = prior + sum((_value(t, check[:, :-3]) for t in trees), np.zeros(len(check)))
    for kind in range(len(KINDS)):
        of = check[:, 0] == kind
        order = np.argsort(-held[of], kind="stable")
        passed, failed = check[of][order, -2].cumsum(), check[of][order, -1].cumsum()
        good = np.flatnonzero(passed >= LEAST_PRECISION * (passed + failed))
        thresholds.append(max(0.0, float(held[of][order][good[-1]])) if len(good) else 0.0)
    return Trees(trees, prior, thresholds)


def fit(candidates: DataFrame) -> Trees:
    """Trees from all base matches of all documents; what comes to the driver is one row for each set of feature values."""
    rows = candidates.select(F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("fold"), F.explode("candidates").alias("c")).filter("c.base")
    keys = [F.col("c.kind").alias("kind"), *(F.col(f"c.{f}_").alias(f) for f in FEATURES[1:])]
    counts = rows.groupBy(*keys, "fold").agg(F.count_if(F.col("c.valid")).alias("passed"), F.count_if(~F.col("c.valid")).alias("failed"))
    return boost(counts.collect())


def with_spans(candidates: DataFrame, trees: Trees) -> DataFrame:
    """Replaces ``candidates`` by ``base`` and ``spans``: arrays of (start, kind, end), sorted.

    ``spans`` holds the base spans and the proposed ones that are accepted and overlap none of them; of proposed spans of
    one kind that overlap each other (they come from different patterns) all stay.
    """
    plain = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    base = F.transform(F.filter("candidates", lambda c: c["base"] & c["valid"]), plain)
    more = F.transform(F.filter("candidates", trees.accepted), plain)
    out = candidates.withColumn("base", pinned(F.array_sort(base))).withColumn("_more", pinned(more)).drop("candidates")
    free = F.filter("_more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return out.withColumn("spans", pinned(F.array_sort(F.array_distinct(F.concat("base", free))))).drop("_more")


def written(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found_digest(documents: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans by kind, base_sha256 and spans of each row.

    Null and empty texts have no spans. Rows are returned as often as they come; other columns are ignored.
    """
    known = stored(with_candidates(documents.select("doc_id", "text")).drop("text"), "candidates")
    found = with_spans(known, fit(known))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def redact(documents: DataFrame, trees: Trees) -> DataFrame:
    """The documents with every span in text replaced by its kind in brackets; n_chars follows, if there is one.

    Where spans overlap, the part that an earlier one covers goes with that one. Other columns stay as they are; a null
    text stays null.
    """
    columns = documents.columns
    inner = documents.select(F.struct(*columns).alias("_row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    found = with_spans(with_candidates(inner), trees)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    reach = F.transform("spans", lambda s, i: F.coalesce(F.array_max(F.transform(F.slice("spans", F.lit(1), i), lambda e: e["end"])), F.lit(0)))
    found = found.withColumn("_reach", pinned(reach))
    pieces = F.transform(F.arrays_zip("spans", "_reach"), lambda z: F.concat(
        F.substr("text", z["_reach"] + 1, F.greatest(F.lit(0), z["spans"]["start"] - z["_reach"])),
        F.when(z["spans"]["end"] > z["_reach"], F.get(names, z["spans"]["kind"])).otherwise("")))
    end = F.coalesce(F.array_max(F.transform("spans", lambda s: s["end"])), F.lit(0))
    text = F.when(F.size("spans") > 0, F.concat(F.array_join(pieces, ""), F.substr("text", end + 1))).otherwise(F.col("text"))
    found = found.withColumn("_text", pinned(text))
    picked = [F.col("_text").alias(c) if c == "text" else F.when(F.size("spans") > 0, F.char_length("_text").cast("long")).otherwise(F.col(f"_row.{c}")).alias(c) if c == "n_chars" else F.col(f"_row.`{c}`").alias(c) for c in columns]
    return found.select(*picked)
