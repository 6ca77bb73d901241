"""Quality and toxicity of documents from a weak-label model.

Overlapping heuristic labellers look at a document and vote for bad, good or nothing; the rows of ``labels`` are one more
labeller, which is silent on most documents. For toxicity one labeller knows fixed words of abuse, another learns words
from labelled documents (how many toxic and how many clean ones hold them), so abuse in words that no list holds is
met too. Expectation-maximisation estimates from the votes of all documents how often each labeller, where it votes, says
what for good and for bad documents (labellers are independent given the class), separately for low quality and for
toxicity. The posterior of each pattern of votes labels a bounded sample, on which a hashed linear scorer is trained. The
sample takes rare patterns in a larger share; the scores are calibrated to the share they have in the corpus.

The scorer decides, from the whole text only, but a text on which no labeller of low quality has an opinion is never of
low quality. Absence of abuse speaks for a document only where words could be learned.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatstream.llm.common import stored
from chatstream.llm.langid import BITS, follow_leader

#: Documents that the scorer is trained on, at most; the sample is by a hash of doc_id in
#: each stratum of votes, so a class that is rare in the corpus is not absent from it.
TRAIN_DOCUMENTS = 8000
#: Posteriors between these leave a document out of the training.
UNSURE = (0.1, 0.9)
STEPS = 50
# fixed values: words of abuse
ABUSE = frozenset("trash pathetic idiot worthless disgusting stupid clown scum loser moron".split())
_WORD = re.compile(r"[^\W\d_]+")


def measures(text: str) -> dict[str, float]:
    """Shares that the labellers and the scorer look at, of the whole text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    upper = ((points >= 65) & (points <= 90)) | ((points >= 192) & (points <= 222))
    lower = ((points >= 97) & (points <= 122)) | (points >= 223)
    digit, space = (points >= 48) & (points <= 57), points <= 32
    letters = int(upper.sum() + lower.sum())
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    return {
        "words": len(words),
        "symbols": (len(points) - letters - int(digit.sum()) - int(space.sum())) / max(1, len(points)),
        "capitals": int(upper.sum()) / max(1, letters),
        "repeated": sum(a == b for a, b in zip(words, words[1:])) / n,
        "variety": len(set(words)) / n,
        "bars": text.count("|") / n,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "length": sum(map(len, words)) / n,
    }


#: Labellers of low quality: +1 bad, -1 good, 0 no opinion.
QUALITY = [
    lambda m: 0 if m["words"] < 8 else 1 if m["symbols"] > 0.08 else -1 if m["symbols"] < 0.05 else 0,
    lambda m: 0 if m["words"] < 8 else 1 if m["capitals"] > 0.3 else -1 if m["capitals"] < 0.1 else 0,
    lambda m: 0 if m["words"] < 8 else 1 if m["repeated"] > 0.2 else -1 if m["repeated"] < 0.05 else 0,
    lambda m: 0 if not 50 <= m["words"] <= 5000 else 1 if m["variety"] < 0.35 else -1 if m["variety"] > 0.55 else 0,
    lambda m: 1 if m["bars"] > 0.1 else 0,
    lambda m: 1 if m["lines"] > 0.4 else 0,
    lambda m: 0 if m["words"] < 20 else 1 if not 3 < m["length"] < 8 else -1,
]
#: A word is learned if so many toxic documents hold it, this share of them too, and it is so much more frequent there than
#: in clean ones (natural logarithm). Rare words of the corpus are many, and some meet toxic documents alone by chance.
LEARNED_LEAST, LEARNED_SHARE, LEARNED_ODDS = 5, 0.02, 2.5
#: Labelled documents to learn from, about so many toxic ones and so many clean ones, by a hash of doc_id.
LEARN_DOCUMENTS = 10_000
#: Learned words at most, those in the most toxic documents; and what they must add up to for a vote.
LEARNED_WORDS, LEARNED_VOTE = 4096, 6.0
#: Labellers of toxicity: fixed words, then learned ones.
TOXIC = [
    lambda words, learned, seeded: 1 if len(words & ABUSE) > 1 else -1 if seeded and not words & ABUSE else 0,
    lambda words, learned, seeded: _learned_vote(sum(learned[w] for w in words if w in learned), learned),
]


def _learned_vote(odds: float, learned: dict[str, float]) -> int:
    return 0 if not learned or 0 < odds < LEARNED_VOTE else 1 if odds else -1


def distinct_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def learned_words(documents: DataFrame, toxic: DataFrame | None) -> dict[str, float]:
    """Words that speak for toxicity and their log odds, from labelled documents (``toxic``: doc_id, t of + or -).

    A bounded sample of the labels is taken to the documents, so no text is shuffled. Without labels (None) all documents
    with two words of abuse stand in for toxic ones and those without for clean ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[int]] = {}
            for text, t in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = distinct_words(text.as_py())
                t = t or {0: "-", 1: None}.get(len(words & ABUSE), "+")
                for word in {*words, ""} if t else ():
                    held.setdefault(word, [0, 0])[t == "+"] += 1
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), *(pa.array([n[k] for n in held.values()], pa.int64()) for k in (0, 1))], names=["word", "clean", "toxic"])

    labelled = documents.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if toxic is None:
        labelled = labelled.withColumn("t", F.lit(None).cast("string"))
    else:
        sizes = {r.t: r["count"] for r in toxic.filter("t <> '0'").groupBy("t").count().collect()}
        limit = F.create_map(*[F.lit(x) for t, n in sizes.items() for x in (t, min(2**63 - 1, int(min(1.0, LEARN_DOCUMENTS / n) * 2**64) - 2**63))])
        chosen = toxic.filter("t <> '0'").filter(F.xxhash64(F.lit("learn"), "doc_id") <= limit[F.col("t")])
        labelled = labelled.join(F.broadcast(chosen), "doc_id")
    counts = labelled.select("text", "t").mapInArrow(run, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = stored(counts.filter(f"toxic >= {LEARNED_LEAST} or word = ''"), "words")
    all_ = counts.filter("word = ''").first()  # the empty word is in every document
    if all_ is None:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (all_.toxic + 1)) - F.log((F.col("clean") + 0.5) / (all_.clean + 1))
    best = counts.filter("word <> ''").withColumn("odds", odds).filter((F.col("odds") >= LEARNED_ODDS) & (F.col("toxic") >= LEARNED_SHARE * all_.toxic)).orderBy(F.col("toxic").desc(), "word").limit(LEARNED_WORDS)
    return {r.word: r.odds for r in best.collect()}


def votes(documents: DataFrame, learned: dict[str, float] | None = None, seeded: bool = True) -> DataFrame:
    """doc_id, quality_votes and toxic_votes (one character of + - 0 for each labeller) of each row; null texts get none.

    ``seeded`` says that nobody labelled toxic documents: then to lack the fixed words is a vote too.
    """
    learned = learned or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = {1: "+", -1: "-", 0: "0"}
        for batch in batches:
            low, toxic = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                m, words = measures(text), distinct_words(text)
                low.append("".join(sign[f(m)] for f in QUALITY))
                toxic.append("".join(sign[f(words, learned, seeded)] for f in TOXIC))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low), pa.array(toxic)], names=["doc_id", "quality_votes", "toxic_votes"])

    rows = documents.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, quality_votes string, toxic_votes string")


def posteriors(counts: dict[str, int]) -> dict[str, float]:
    """Probability of bad for each pattern of votes, by expectation-maximisation over the patterns and their counts."""
    patterns = sorted(counts)
    if not patterns:
        return {}
    weight = np.array([counts[p] for p in patterns], float)
    seen = np.array([[["-", "0", "+"].index(v) for v in p] for p in patterns])
    # start: the last labeller (people) where it has an opinion, the majority of the others elsewhere, with a doubt
    opinion = np.where(seen[:, -1] != 1, 3 * (seen[:, -1] - 1), (seen - 1).sum(1))
    bad = 1 / (1 + np.exp(-1.5 * opinion + 1))
    for _ in range(STEPS):
        share = (weight * bad).sum() / weight.sum()
        odds = np.full(len(patterns), np.log((share + 1e-9) / (1 - share + 1e-9)))
        for k in range(seen.shape[1]):
            voted = seen[:, k] != 1  # silence says nothing
            for v in (0, 2):
                is_v = seen[:, k] == v
                yes = ((weight * bad * is_v).sum() + 0.1) / ((weight * bad * voted).sum() + 0.2)
                no = ((weight * (1 - bad) * is_v).sum() + 0.1) / ((weight * (1 - bad) * voted).sum() + 0.2)
                odds[is_v] += np.log(yes / no)
        bad = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(patterns, bad.tolist(), strict=True))


def word_features(text: str) -> np.ndarray:
    """Buckets of a text's distinct words and of their beginnings."""
    words = distinct_words(text)
    return _buckets([*words, *{f"{w[:5]}~" for w in words if len(w) > 5}])


def measure_features(text: str) -> np.ndarray:
    return _measured(measures(text))


def _measured(m: dict[str, float]) -> np.ndarray:
    """Buckets of a text's measures in steps, alone and in pairs; those of a few words are counted apart and are less."""
    if m["words"] < 8:
        return _buckets(["few", f"few bars{min(20, int(m['bars'] * 20))}", f"few lines{min(10, int(m['lines'] * 10))}"])
    steps = [f"{k}{min(20, int(m[k] * per))}" for k, per in (("symbols", 50), ("capitals", 20), ("repeated", 20), ("bars", 20), ("lines", 10))]
    return _buckets([*steps, f"variety{int(m['variety'] * 10)}/{len(str(int(m['words'])))}", f"length{min(12, int(m['length']))}", *(f"{a}&{b}" for k, a in enumerate(steps) for b in steps[:k])])


def _buckets(names: list[str]) -> np.ndarray:
    return np.unique(np.array([zlib.crc32(n.encode()) & ((1 << BITS) - 1) for n in names], np.int64))


@dataclass
class Scorer:
    """Two hashed linear scorers, of low quality and of toxicity; one without weights finds nothing."""

    low: tuple[np.ndarray, float] | None
    toxic: tuple[np.ndarray, float] | None

    def shares(self, text: str | None) -> tuple[float, float]:
        """Probabilities of low quality and of toxicity."""
        if not text or not text.strip():
            return 0.0, 0.0
        m = measures(text)
        judged = self.low and any(f(m) for f in QUALITY)
        return _share(self.low, _measured(m)) if judged else 0.0, _share(self.toxic, word_features(text)) if self.toxic else 0.0


def _share(model: tuple[np.ndarray, float], buckets: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(model[0][buckets].sum() + model[1], -30, 30))))


def _fitted(rows: list[tuple[np.ndarray, float, float]], l1: float) -> tuple[np.ndarray, float] | None:
    """A linear scorer of the rows (buckets, posterior, documents they stand for) that are sure; None unless they show both classes."""
    sure = [(b, np.ones(len(b)), int(p > 0.5), n) for b, p, n in rows if not UNSURE[0] < p < UNSURE[1]]
    if len({k for _, _, k, _ in sure}) < 2:
        return None
    weights, bias = follow_leader([r[:3] for r in sure], 2, alpha=0.1, l1=l1, l2=0.1)
    weight, intercept = (weights[1] - weights[0]).astype(np.float32), float(bias[1] - bias[0])
    slope, shift = _calibrated(np.array([weight[b].sum() + intercept for b, *_ in sure]), np.array([r[2] for r in sure]), np.array([r[3] for r in sure], float))
    return weight * np.float32(slope), intercept * slope + shift


def _calibrated(logits: np.ndarray, bad: np.ndarray, stand_for: np.ndarray) -> tuple[float, float]:
    """Slope and shift that give the logits the odds among all documents, by Newton's method on the weighted log loss.

    Rare classes are taken in a larger share, so each row counts for as many documents as it stands for; the slope is held
    near 1 by a small penalty where the classes are apart.
    """
    w = stand_for / stand_for.mean()
    at = np.array([1.0, 0.0])
    x = np.stack([logits, np.ones(len(logits))], axis=1)

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((w * (np.logaddexp(0, z) - bad * z)).sum() + 0.05 * (v[0] - 1) ** 2 + 1e-4 * v[1] ** 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        gradient = x.T @ (w * (p - bad)) + [0.1 * (at[0] - 1), 2e-4 * at[1]]
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag([0.1, 2e-4]), gradient)
        while loss(at - step) > loss(at) and np.abs(step).max() > 1e-9:
            step /= 2
        at = at - step
        if np.abs(step).max() < 1e-6:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def _kind(bad: float) -> str:
    return "+" if bad >= UNSURE[1] else "-" if bad <= UNSURE[0] else "0"


def quotas(sizes: dict[str, int]) -> dict[str, int]:
    """Documents to take of each stratum: all of a small one, a ninth of the sample at least, the rest in proportion."""
    least = {k: min(n, TRAIN_DOCUMENTS // 9) for k, n in sizes.items()}
    left, over = TRAIN_DOCUMENTS - sum(least.values()), sum(sizes.values()) - sum(least.values())
    return {k: least[k] + min(n - least[k], left * (n - least[k]) // over if over else 0) for k, n in sizes.items()}


def train(documents: DataFrame, labels: DataFrame) -> Scorer:
    """A scorer from the votes on all documents; contradicting labels of one doc_id are none, and no labels at all are no hindrance."""
    sign = lambda good: F.when(F.min(good) != F.max(good), "0").when(F.min(good) == 1, "-").when(F.min(good) == 0, "+").otherwise("0")
    given = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(sign(F.col("quality").cast("int")).alias("q"), sign(1 - F.col("toxic").cast("int")).alias("t"))
    seeded = given.filter("t <> '0'").isEmpty()
    learned = learned_words(documents, None if seeded else given.select("doc_id", "t"))
    known = votes(documents, learned, seeded).join(given, "doc_id", "left").select("doc_id", F.concat("quality_votes", F.coalesce("q", F.lit("0"))).alias("low"), F.concat("toxic_votes", F.coalesce("t", F.lit("0"))).alias("toxic"))
    known = stored(known, "votes")
    total, by = 0, {}
    for name in ("low", "toxic"):  # at most 3 to the power of the labellers rows
        counts = {r[0]: r[1] for r in known.groupBy(name).count().collect()}
        by[name], total = posteriors(counts), sum(counts.values())
    if not total:
        return Scorer(None, None)
    # strata by what the votes say of both classes: the rare ones whole, or a fair part of the sample of each
    kinds = {name: F.create_map(*[F.lit(x) for p, bad in by[name].items() for x in (p, _kind(bad))]) for name in by}
    known = known.withColumn("stratum", F.concat(*[kinds[name][F.col(name)] for name in ("low", "toxic")]))
    sizes = {r[0]: r[1] for r in known.groupBy("stratum").count().collect()}  # at most 9 rows
    quota = quotas(sizes)
    place = F.xxhash64(F.lit("quality"), "doc_id")
    limit = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(2**63 - 1, int(min(1.0, 2 * (quota[k] + 100) / n) * 2**64) - 2**63))])
    near = stored(known.withColumn("place", place).filter(F.col("place") <= limit[F.col("stratum")]), "chosen")  # about twice the sample
    sample = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null").join(F.broadcast(near), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pa.array([f(t.as_py()).astype(np.uint16).tobytes() for t in batch.column(0)], pa.binary()) for f in (measure_features, word_features)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *found], names=["low", "toxic", "stratum", "place", "of_measures", "of_words"])

    found = sample.select("text", "low", "toxic", "stratum", "place").mapInArrow(run, "low string, toxic string, stratum string, place long, of_measures binary, of_words binary").collect()
    taken, used = [], dict.fromkeys(sizes, 0)
    for r in sorted(found, key=lambda r: (r.place, r.low, r.toxic, r.of_words)):
        if used[r.stratum] < quota[r.stratum]:
            used[r.stratum] += 1
            taken.append(r)
    read = lambda b: np.frombuffer(b, np.uint16).astype(np.int64)
    stands_for = {k: sizes[k] / max(1, n) for k, n in used.items()}
    return Scorer(
        _fitted([(read(r.of_measures), by["low"][r.low], stands_for[r.stratum]) for r in taken], 0.1),
        _fitted([(read(r.of_words), by["toxic"][r.toxic], stands_for[r.stratum]) for r in taken], 0.3),
    )


def scored(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """All columns of documents, with low, toxic (probabilities) and kept (both below one half).

    Null, empty and blank texts are clean. Columns of these three names are replaced.
    """
    rows = documents.drop("low", "toxic", "kept")
    where = rows.columns.index("text")
    names = [*rows.columns, "low", "toxic", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [scorer.shares(t.as_py()) for t in batch.column(where)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s[0] for s in shares], pa.float64()), pa.array([s[1] for s in shares], pa.float64()), pa.array([max(s) < 0.5 for s in shares], pa.bool_())], names=names)

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("low", T.DoubleType()), T.StructField("toxic", T.DoubleType()), T.StructField("kept", T.BooleanType())]))
