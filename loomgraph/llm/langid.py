"""Language identification in two steps: the family, then one-versus-one linear SVMs among its languages.

Features are frequencies of hashed character n-grams (1 to 3) of the whole lower-cased text, in which everything but
letters is a space.  Models are trained on a bounded sample; prediction reads every text in vectorised batches: the
mean of an n-gram weight over a text is its decision value.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship


#: Expected documents a language in the training sample; with more than LANGUAGES languages each gets fewer, at least one.
PER_LANGUAGE, LANGUAGES = 300, 64
#: Languages of fewer rows are trained on all of them.
FEWEST = 40
FEATURES = 1 << 13
UNKNOWN = "und"
#: Frequency of an n-gram that the sample lacks; characters beyond which a longer text isn't held to a closer likeness.
RARE, STEADY = 1e-6, 200
#: A document is rejected when it has no letter or scores below this.
LEAST_SCORE = 0.5
# Families of languages by code; a code that isn't here is a family of its own.
FAMILIES = {"germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"), "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"), "slavic": ("bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"), "uralic": ("et", "fi", "hu")}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids of all texts' n-grams (3 rows), where each text begins, and which have a letter."""
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) + 3 for t in low])
    codes = np.frombuffer("".join(f" {t}  " for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[codes]
    codes = np.where(is_letter, codes, np.uint32(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    one = codes * np.uint32(0x9E3779B1)
    two = one[:-1] * np.uint32(31) + codes[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(31) + codes[2:] * np.uint32(0xC2B2AE35)
    n = len(codes) - 2
    ids = np.stack([one[:n], two[:n], three]) >> np.uint32(19)
    return ids.astype(np.int32), starts, np.add.reduceat(is_letter, starts) > 0


def vectors(texts: list[str]) -> np.ndarray:
    """N-gram frequencies of each text."""
    ids, starts, _ = _grams(texts)
    ends = np.concatenate([starts[1:], [ids.shape[1] + 2]]) - 2
    out = np.zeros((len(texts), FEATURES), np.float32)
    for k, (a, b) in enumerate(zip(starts, ends)):
        out[k] = np.bincount(ids[:, a:b].ravel(), minlength=FEATURES)[:FEATURES] / (3 * (b - a))
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (hinge loss) by dual coordinate descent; y is +1 or -1."""
    square, alpha, w, b = np.einsum("ij,ij->i", x, x) + 1.0, np.zeros(len(x)), np.zeros(x.shape[1], np.float32), 0.0
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * c
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            step = min(max(alpha[i] - (y[i] * (float(w @ x[i]) + b) - 1) / square[i], 0.0), weight[i])
            if step != alpha[i]:
                w += np.float32((step - alpha[i]) * y[i]) * x[i]
                b += (step - alpha[i]) * y[i]
                alpha[i] = step
    return w, float(b)


@dataclass
class Model:
    """families: their names; by_family: each one's languages; pairs: (a, b) names to weights and bias, a is positive."""

    families: list[str]
    by_family: dict[str, list[str]]
    pairs: dict[tuple[str, str], tuple[np.ndarray, float]]
    scale: np.ndarray
    #: The log frequency of each n-gram in the sample, all languages weighing the same, with its mean and deviation there.
    profile: tuple[np.ndarray, float, float] | None = None
    #: Least margin and least likeness of clean documents, see ``calibrate``.
    cuts: tuple[float, float] = (-math.inf, -math.inf)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text, the logistic of how far its margin and its likeness are above their cuts.

        Under 0.5 one of the two is less than a clean document's.
        """
        langs, margins, likes = self.measure(texts)
        above = [min(m - self.cuts[0], x - self.cuts[1], 30.0) for m, x in zip(margins, likes)]
        return langs, [0.0 if lang == UNKNOWN else 1 / (1 + math.exp(-2 * max(a, -30.0))) for lang, a in zip(langs, above)]

    def measure(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, margin and likeness of each text.

        The margin is the smallest of the chosen language's and family's duels, below 0 where one was lost. Likeness is the
        mean log frequency of the text's n-grams, as deviations from the sample's at the text's length.
        """
        if not texts:
            return [], [], []
        ids, starts, lettered = _grams(texts)
        ends = np.concatenate([starts[1:], [ids.shape[1] + 2]]) - 2
        cuts, n = np.stack([starts, ends], axis=1).ravel(), 3 * (ends - starts)
        whole = np.concatenate([ids, np.full((3, 2), FEATURES, np.int32)], axis=1)

        def means(w: np.ndarray) -> np.ndarray:
            each = w[whole[0]] + w[whole[1]] + w[whole[2]]
            return np.add.reduceat(each, cuts, dtype=np.float64)[::2] / n

        margin = {pair: means(np.append(w * self.scale, np.float32(0))) + b for pair, (w, b) in self.pairs.items()}
        if self.families:
            w, mean, dev = self.profile
            like = means(w)
        langs, margins, likes = [], [], []
        for k in range(len(texts)):
            if not lettered[k] or not self.families:
                langs.append(UNKNOWN)
                margins.append(0.0)
                likes.append(0.0)
                continue
            family, sure = self._duel([("family", f) for f in self.families], margin, k)
            lang, also = self._duel([("lang", x) for x in self.by_family[family]], margin, k)
            langs.append(lang)
            margins.append(min(sure, also))
            likes.append((float(like[k]) - mean) / (dev * math.sqrt(3 / n[k] + 1 / STEADY)))
        return langs, margins, likes

    @staticmethod
    def _duel(names: list[tuple[str, str]], margin: dict, k: int) -> tuple[str, float]:
        votes = {x: [0, 0.0] for _, x in names}
        least = {x: 30.0 for _, x in names}
        for a, b in itertools.combinations(names, 2):
            m = float(margin[a, b][k])
            won = a[1] if m >= 0 else b[1]
            votes[won][0] += 1
            votes[won][1] += abs(m)
            least[a[1]], least[b[1]] = min(least[a[1]], m), min(least[b[1]], -m)
        best = max(votes, key=lambda x: (votes[x], x))
        return best, least[best]


def train(x: np.ndarray, langs: list[str]) -> Model:
    """A model from frequency vectors, which it scales in place, and their languages."""
    names = sorted(set(langs))
    family_of = {x: _FAMILY.get(x, x) for x in names}
    families = sorted(set(family_of.values()))
    by_family = {f: [x for x in names if family_of[x] == f] for f in families}
    scale = (1 / np.sqrt(x.mean(axis=0) + 1e-4)).astype(np.float32) if len(x) else np.ones(FEATURES, np.float32)
    y, fam = np.array(langs), np.array([family_of[v] for v in langs])
    mean = np.mean([x[y == name].mean(axis=0, dtype=np.float64) for name in names], axis=0) if names else np.ones(FEATURES) / FEATURES
    w = np.log(np.maximum(mean, RARE))
    mu = float(mean @ w)
    profile = np.append(w, 0).astype(np.float32), mu, max(math.sqrt(max(0.0, float(mean @ (w - mu) ** 2))), 1e-3)
    x *= scale  # in place: the sample is the driver's largest object
    pairs = {}
    for kind, labels, groups in (("family", fam, [families]), ("lang", y, list(by_family.values()))):
        for group in groups:
            for a, b in itertools.combinations(group, 2):
                rows = (labels == a) | (labels == b)
                pairs[(kind, a), (kind, b)] = linear_svm(x[rows], np.where(labels[rows] == a, 1, -1))
    return Model(families, by_family, pairs, scale, profile)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            raw = [v.tobytes() for v in vectors(part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], names=["lang", "v"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Train on rows that aren't held out and have a language and a text with a letter.

    Each language's rows are sampled by a hash of id and text at the rate that gives ``per_language`` of them, so at most
    about LANGUAGES * per_language vectors of FEATURES floats reach the driver, whatever the table's size; every language is
    learned, and with more than LANGUAGES of them the rows of each are fewer. A quarter of the sample, chosen by another hash
    from languages of at least FEWEST rows, isn't trained on but sets the cuts. Held-out rows are never read.
    """
    ship(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("i"), docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(~held_out(F.col("i")))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], {}, {}, np.ones(FEATURES, np.float32))
    each = max(1.0, per_language * min(1.0, LANGUAGES / len(counts)))
    rates = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each / n))])
    chance = F.coalesce(rates[F.col("lang")], F.lit(0.0))
    u = F.pmod(F.xxhash64("i", F.length("text"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.where((u < chance) & F.col("text").rlike(r"\p{L}"))
    many = [lang for lang, n in counts.items() if n >= FEWEST]
    spare = F.col("lang").isin(many) & (F.pmod(F.xxhash64("i", F.length("text"), F.lit("cuts")), F.lit(4)) == 0)
    got = rows.where(~spare).select("lang", "text").mapInArrow(_sampled, "lang string, v binary").toArrow()
    if not got.num_rows:
        return Model([], {}, {}, np.ones(FEATURES, np.float32))
    langs, x = got.column("lang").to_pylist(), np.empty((got.num_rows, FEATURES), np.float32)
    for k, v in enumerate(got.column("v")):
        x[k] = np.frombuffer(v.as_buffer(), np.float32)
    del got
    order = sorted(range(len(langs)), key=lambda k: (langs[k], zlib.crc32(x[k])))  # the same model from any order of rows
    model = train(x[order], [langs[k] for k in order])
    del x
    calibrate(model, rows.where(spare).select("lang", "text"))
    return model


def calibrate(model: Model, spare: DataFrame) -> None:
    """Set the cuts from (lang, text) that the model wasn't trained on: twice as far from the median as the lowest named rightly.

    So the documents like them stay, odd ones included; where none is named rightly, nothing is rejected.
    """
    sent = spare.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                langs, margins, likes = sent.value.measure(part.column(1).to_pylist())
                right = pa.array([a == b for a, b in zip(langs, part.column(0).to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(margins, pa.float64()), pa.array(likes, pa.float64())], names=["m", "x"]).filter(right)

    got = spare.mapInArrow(run, "m double, x double").toArrow()
    if got.num_rows:
        m, x = (got.column(c).to_numpy() for c in ("m", "x"))
        m, x = (float(2 * v.min() - np.median(v)) for v in (m, x))
        model.cuts = min(m, 0.0), x  # a won duel is no reason to reject


def _predictor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            langs: list[str] = []
            scores: list[float] = []
            k = 0
            while k < len(texts):  # groups of about a million characters
                size, end = len(texts[k]), k + 1
                while end < len(texts) and size + len(texts[end]) < 1 << 20:
                    size, end = size + len(texts[end]), end + 1
                a, b = model.value.predict(texts[k:end])
                langs += a
                scores += b
                k = end
            rest = [batch.column(n) for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*[n for n in batch.schema.names if n != "text"], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row, from its text alone; null or letterless texts are ``und``, score 0.

    A null id counts as "" for held_out, repeated rows repeat, an empty table gives no rows, a text of any length is read
    whole, and other columns are ignored.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_predictor(sent), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without the rows that are ``und`` or score under ``least``; same columns. A model of no language keeps all.

    Repeated rows share their fate, an empty table stays empty, and columns of any name pass through.
    """
    if not model.families:
        return docs
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                langs, scores = sent.value.predict([t or "" for t in part.column(text_col).to_pylist()])
                yield part.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
