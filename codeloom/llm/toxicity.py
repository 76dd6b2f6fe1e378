"""Toxicity scores: boosted trees over dense text features, with isotonic calibration.

Features are lexicon densities, nearness of lexicon words to second-person words, capitals, punctuation and
obfuscation rates of the whole text. The lexicon is a fixed list of insults and, from labelled rows, words and
word beginnings that mark toxic texts. Rows used to learn are at most ``SAMPLE_ROWS`` labelled ones outside the
held-out fold, chosen by a hash of the id: two fifths of them give the lexicon, two fifths the trees and
one fifth the calibration, so no stage sees its own answers. Every word and word beginning that is frequent and telling enough
enters the lexicon; the sample's bound bounds their number.

Cases: a null text is an empty one and is scored; a null id is scored, is not held out and takes no label; an
id labelled twice counts as toxic if any of its labels says so; null labels are left out; a labelled id's rows with one text count once,
and the sample's bound holds for rows, however often an id repeats; repeated rows are each scored; very long texts are scored whole; other columns don't matter; without labels of both
kinds the fixed list alone gives the score; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, sigmoid
from .common import cut, small_batches, tidy

SAMPLE_ROWS = 20_000
#: Learned lexicon: toxic documents an entry needs, and its odds against the others' rate.
LEXICON_DOCS, LEXICON_ODDS = 5, 8.0
PREFIXES = (4, 5, 6)
HELD_OUT = 5

#: Fixed insults in four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns imbecile cretin jerk freak pig "
    "idiote crétin crétins débile abruti ordure salaud connard imbécile minable dumm dummkopf blödmann trottel arschloch abschaum widerlich versager "
    "estúpido estúpida tonto tonta imbécil basura escoria asqueroso patético inútil payaso".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch euer ihr tú ti usted ustedes tus vosotros".split())

_WORD = re.compile(r"[^\W\d_]+")
_CAPS = re.compile(rb"\b[A-Z]{2,}\b")
_MIXED = re.compile(r"\b[^\W\d_]+[0-9@$*!#|+]+[^\W_]\w*")
_SPACED = re.compile(r"\b(?:[^\W\d_][ .*_-]){3,}[^\W\d_]\b")
_REPEAT = re.compile(r"([^\W\d_])\1\1")
_LEET = str.maketrans("013457@$!|+", "oieastasiit", "*#")
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_SYMBOL, _POINT = b"#$%&*@^~|<>{}[]\\/=+_", b".,;:'\"()-"


@dataclass(frozen=True)
class Lexicon:
    """Learned words and word beginnings with their log odds."""

    words: dict[str, float]
    starts: dict[str, float]


def _hits(words: list[str], lexicon: Lexicon) -> list[tuple[int, float, bool]]:
    """Place, weight and whether it's a fixed insult, of each word that the lexicon has."""
    learned, starts = lexicon.words, lexicon.starts
    out = []
    for i, w in enumerate(words):
        if w in INSULTS:
            out.append((i, max(1.0, learned.get(w, 1.0)), True))
        elif w in learned:
            out.append((i, learned[w], False))
        elif w[:4] in starts:
            out.append((i, starts[w[:4]], False))
        elif w[:5] in starts:
            out.append((i, starts[w[:5]], False))
        elif w[:6] in starts:
            out.append((i, starts[w[:6]], False))
    return out


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Dense features of a whole text."""
    text = text or ""
    low, raw = text.lower(), text.encode("utf-8", "surrogatepass")
    words = _WORD.findall(low)
    n, size = max(1, len(words)), max(1, len(raw))
    hits = _hits(words, lexicon)
    near = 0.0
    if hits:
        second = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
        if len(second):
            near = max(1.0 / (1.0 + np.abs(second - i).min()) for i, _, _ in hits)
    else:
        second = ()
    share = lambda drop: (size - len(raw.translate(None, drop))) / size if raw else 0.0
    mixed = [m.translate(_LEET) for m in _MIXED.findall(low)]
    spaced = [re.sub(r"[ .*_-]", "", m) for m in _SPACED.findall(low)]
    hidden = sum(1 for w in [*mixed, *spaced] if w in INSULTS or w in lexicon.words or w[:5] in lexicon.starts)
    weights = [w for _, w, _ in hits]
    fixed = sum(f for _, _, f in hits)
    upper, lower = share(_UPPER), share(_LOWER)
    return [
        len(hits) / n, fixed / n, sum(weights) / n, max(weights, default=0.0), np.log1p(len(hits)), len({words[i] for i, _, _ in hits}) / n,
            float(len({words[i] for i, _, _ in hits})),
        near, len(second) / n, upper / max(1e-9, upper + lower), len(_CAPS.findall(raw)) / n, share(b"!"), share(b"?"), share(_POINT), share(_SYMBOL),
            share(_DIGIT),
        len(mixed) / n, len(spaced) / n, hidden / n, float(hidden), len(_REPEAT.findall(low)) / n, len(text) / n, np.log1p(len(words)),
    ]


def fold(id_: Column, salt: str = "") -> Column:
    """CRC-32 of the id as text, with ``salt`` after it."""
    text = id_.cast("string")
    return F.crc32(F.encode(F.concat(text, F.lit(salt)) if salt else text, "UTF-8"))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, label, step) of at most ``most`` labelled rows outside the held-out fold; step 0-4."""
    one = labels.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (fold(F.col("id")) % HELD_OUT != 0))
    one = one.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    # at most ``most`` ids and labels, and as many texts of them, so both may be broadcast
    body = F.xxhash64("text")
    picked = docs.join(F.broadcast(one), "id").select("id", body.alias("body"), "label").distinct().orderBy(F.xxhash64("id"), "id", "body").limit(most)
    picked = F.broadcast(cut(picked, "toxic-ids").withColumnRenamed("id", "_id"))
    rows = docs.join(picked, (F.col("id") == F.col("_id")) & (body == F.col("body"))).dropDuplicates(["id", "body"])
    return rows.select("text", F.col("label").cast("int").alias("label"), (fold(F.col("id"), "/step") % 5).cast("int").alias("step"))


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and word beginnings whose share of toxic rows is far above their share of others."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    starts = F.flatten(F.array(*[F.transform(F.filter(words, lambda w, k=k: F.length(w) > k), lambda w,
        k=k: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in PREFIXES]))
    terms = sample.select("label", F.explode(F.array_distinct(F.concat(words, starts))).alias("term"))
    n1, n0 = (sample.filter(F.col("label") == y).count() for y in (1, 0))
    if not n1 or not n0:
        return Lexicon({}, {})
    counted = terms.groupBy("term").agg(F.sum("label").alias("pos"), F.count("label").alias("all"))
    odds = ((F.col("pos") + 0.5) / (n1 + 1)) / ((F.col("all") - F.col("pos") + 0.5) / (n0 + 1))
    best = counted.filter(F.col("pos") >= LEXICON_DOCS).withColumn("odds", odds).filter(F.col("odds") >= LEXICON_ODDS)
    found = best.orderBy("term").collect()
    kinds: tuple[dict[str, float], dict[str, float]] = ({}, {})
    for r in found:
        kinds[r.term.endswith("*")][r.term.rstrip("*")] = float(np.log(r.odds))
    return Lexicon(*kinds)


@dataclass
class Scorer:
    lexicon: Lexicon
    trees: Boosted | None

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts], float).reshape(len(texts), -1)
        if not len(x):
            return np.zeros(0)
        return sigmoid(60.0 * x[:, 1] - 2.0) if self.trees is None else self.trees.score(x)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Scorer:
    """Learn from ``docs`` (id, text) and ``labels`` (id, label). Only features and the lexicon reach the driver."""
    sample = cut(labelled_sample(docs, labels, most), "toxic-sample")
    lexicon = learn_lexicon(sample.filter("step < 2"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            x = [np.array(features(t, lexicon)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.binary()), "label": b.column("label"), "step": b.column("step")})

    rows = sample.filter("step >= 2").mapInArrow(describe, "x binary, label int, step int").collect()
    rows.sort(key=lambda r: (r.step, bytes(r.x), r.label))
    if len({r.label for r in rows if r.step < 4}) < 2:
        return Scorer(lexicon, None)
    x, y, step = np.array([np.frombuffer(r.x) for r in rows]), np.array([r.label for r in rows], float), np.array([r.step for r in rows])
    trees = Boosted().fit(x[step < 4], y[step < 4])
    last = step == 4
    return Scorer(lexicon, trees.calibrate(x[last], y[last]) if len(set(y[last])) == 2 else trees)


def score_rows(df: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            s = scorer.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "held_out": b.column("held_out"), "score": pa.array(s),
                "predicted": pa.array((s >= 0.5).astype("i4"))})

    out = F.coalesce(fold(F.col("id")) % HELD_OUT == 0, F.lit(False)).alias("held_out")
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.select("id", "text", out).mapInArrow(tidy(scan), "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
    label_col: str = "toxic") -> DataFrame:
    """Fit on the labelled rows of ``df``, then score every row."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    return score_rows(df, fit(docs, known), id_col, text_col)


def keep_clean(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the rows whose own text isn't rejected."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scorer = fit(docs, labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label")))

    place = df.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            yield b.filter(pa.array(scorer.score(b.column(place).to_pylist()) < 0.5))

    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names may hold dots or repeat
    return plain.mapInArrow(tidy(keep), plain.schema).toDF(*df.columns)
