"""Language identification with error-correcting output codes.

Every language gets a codeword; for each bit a linear classifier over hashed character 1- to
3-grams predicts it. A text's language is the one whose codeword has the smallest loss under
the classifiers' margins, each weighted by how well its bit was learned. The gap between the
two smallest losses gives the score, and flags ambiguous texts.

The classifiers are fitted on ``per_language`` different texts of each language (all texts of a
smaller one), taken in the order of a hash of the text; predictions read whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from seqatlas.llm.common import Sent, bounded_batches, release

DIMENSIONS = 1 << 12
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1: one bit for each way to split up to five languages, else random dense codes.

    Columns are never constant and never repeat another or its opposite.
    """
    if n < 2:
        return np.ones((n, 1), int)
    if n <= 5:
        splits = [c for size in range(1, n) for c in combinations(range(n), size) if 0 in c]
        return np.array([[1 if i in c else -1 for c in splits] for i in range(n)])
    rng, width, best = np.random.default_rng(7), int(np.ceil(10 * np.log2(n))), None
    for _ in range(200):
        code = rng.choice([-1, 1], (n, width))
        code[:, np.abs(code.sum(0)) == n] = 0
        code = code[:, (code != 0).all(0)]
        gap = min(int((code[i] != code[j]).sum()) for i, j in combinations(range(n), 2))
        if best is None or gap > best[0]:
            best = gap, code
    return best[1]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Hashed counts of character 1- to 3-grams of the whole text, as square roots of unit length.

    Lower-cased letters count as they are, all else as one blank between words.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _letters(points)
    points = np.where(letter, points, np.uint32(32))
    keep = np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32))) if len(points) else letter
    p = points[keep].astype(np.uint64)
    counts = np.zeros(DIMENSIONS)
    h = np.zeros(len(p), np.uint64)
    for n in (1, 2, 3):
        if len(p) < n:
            break
        h = h[: len(p) - n + 1] * np.uint64(0x9E3779B1) + p[n - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n)
        z = h ^ (h >> np.uint64(29))
        counts += np.bincount(((z * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(52)).astype(np.int64), minlength=DIMENSIONS)
    root = np.sqrt(counts)
    return (root / max(np.linalg.norm(root), 1e-12)).astype(np.float32)


def _letters(points: np.ndarray) -> np.ndarray:
    small = (points >= 97) & (points <= 122)
    high = points >= 0xAA
    if high.any():
        distinct, at = np.unique(points[high], return_inverse=True)
        small[high] = np.array([chr(c).isalpha() for c in distinct.tolist()])[at]
    return small


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # dimensions x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding, sums to 1

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss of every codeword for every row: the trusted mean of log(1 + exp(-margin))."""
        margins = x @ self.weights + self.bias
        return np.stack([(np.logaddexp(0, -margins * c) * self.trust).sum(1) for c in self.code], 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword, and its share among exp(-4 loss) of all codewords (the score)."""
        losses = self.losses(x)
        share = np.exp(-4 * (losses - losses.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        best = losses.argmin(1)
        return best, share[np.arange(len(x)), best]


def fit(x: np.ndarray, languages: list[str], labels: np.ndarray, rounds: int = 120, penalty: float = 1e-5) -> Model:
    """Logistic regression for each bit by accelerated gradient descent; a bit's trust is its accuracy over chance."""
    code = codewords(len(languages))
    target = code[labels].astype(np.float32)
    weights = np.zeros((x.shape[1], code.shape[1]), np.float32)
    bias = np.zeros(code.shape[1], np.float32)
    moved, moved_bias, momentum, step = weights.copy(), bias.copy(), 1.0, 3.0
    for _ in range(rounds if len(x) else 0):
        slope = -target / (1 + np.exp(target * (x @ moved + moved_bias))) / len(x)
        new, new_bias = moved - step * (x.T @ slope + penalty * moved), moved_bias - step * slope.sum(0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        k = (momentum - 1) / following
        moved, moved_bias = new + k * (new - weights), new_bias + k * (new_bias - bias)
        weights, bias, momentum = new, new_bias, following
    right = ((x @ weights + bias) * target > 0).mean(0) if len(x) else np.ones(code.shape[1])
    trust = np.clip(right - 0.5, 0.01, None)
    return Model(languages, code, weights, bias, trust / trust.sum())


def training_sample(labelled: DataFrame, per_language: int = 400) -> DataFrame:
    """Different labelled texts with a letter: the ``per_language`` first of each language in the order of their hash.

    A language of fewer texts keeps all of them. Copies are told by their 64-bit hash. The hashes of a
    language are counted in logarithmic steps of a thirty-second; only texts up to the step with
    the last wanted one, few more than ``per_language``, are ranked.
    """
    # Code points without a category may be letters of a newer Unicode; has_letter decides on them.
    rows = labelled.where(F.col("text").rlike(r"[\p{L}\p{Cn}]") & F.col("lang").isNotNull()).select("text", "lang", F.xxhash64("text").alias("_hash"))
    place = F.col("_hash").cast("double") + float(1 << 63)
    step = F.when(place < 1, F.lit(0)).otherwise(F.floor(F.log2(place) * 32)).cast("int")
    counts = rows.select("lang", "_hash").distinct().groupBy("lang", step.alias("_step")).agg(F.count("*").alias("n"))
    # At most 2,049 rows for each language.
    by_language: dict[str, dict[int, int]] = {}
    for r in counts.collect():
        by_language.setdefault(r["lang"], {})[r["_step"]] = r["n"]
    last = []
    for lang, steps in by_language.items():
        total = 0
        for at in sorted(steps):
            total += steps[at]
            if total >= per_language:
                break
        last.append((lang, at))
    limits = labelled.sparkSession.createDataFrame(last, "lang string, _last int")
    near = rows.join(F.broadcast(limits), "lang").where(step <= F.col("_last")).select("lang", "text", "_hash").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_hash", "text"))
    return near.withColumn("_place", place).where(F.col("_place") <= per_language).select("text", "lang")


def train(labelled: DataFrame, per_language: int = 400) -> Model:
    """A model of all languages of ``labelled`` (text, lang); features are computed where the rows are."""

    def vectorise(batches):
        for batch in batches:
            batch = batch[[has_letter(t) for t in batch["text"]]]
            yield pd.DataFrame({"lang": batch["lang"], "x": [(np.minimum(features(t), 1) * 65535).astype("<u2").tobytes() for t in batch["text"]]})

    # At most ``per_language`` rows of each language.
    rows = training_sample(labelled, per_language).mapInPandas(vectorise, "lang string, x binary").toPandas()
    languages = sorted(rows["lang"].unique())
    x = np.frombuffer(b"".join(rows["x"]), "<u2").reshape(-1, DIMENSIONS).astype(np.float32) / 65535
    return fit(x, languages, np.searchsorted(np.array(languages, object), rows["lang"].to_numpy(object)) if len(rows) else np.zeros(0, int))


def identify(docs: DataFrame, model: Model, ambiguous_below: float = 0.5) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous for every row of (doc_id, text).

    A null text and one without a letter are ``und`` with score 0 and not ambiguous, as is every
    text when nothing could be learned. Repeated rows give repeated rows.
    """
    bounded_batches(docs.sparkSession)
    shared = Sent(docs.sparkSession, model)

    def run(batches):
        release()
        m = shared.value
        for batch in batches:
            names, scores, unclear = predictions(m, batch["text"].tolist(), ambiguous_below)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": names, "score": scores, "ambiguous": unclear})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def predictions(model: Model, texts: list[str | None], ambiguous_below: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, scores and ambiguity of texts."""
    names, scores, unclear = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    if not model.languages:
        return names, scores, unclear
    known = [i for i, t in enumerate(texts) if has_letter(t)]
    for a in range(0, len(known), 512):
        part = known[a : a + 512]
        best, share = model.predict(np.stack([features(texts[i]) for i in part]))
        for i, b, s in zip(part, best, share):
            names[i], scores[i], unclear[i] = model.languages[b], float(s), s < ambiguous_below
    return names, scores, unclear


def held_out(doc_id="doc_id"):
    """The rows kept for testing: crc32 of the id as text leaves 1 modulo 3 (a null id is never held out)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def label_documents(docs: DataFrame, per_language: int = 400, ambiguous_below: float = 0.5) -> DataFrame:
    """Learn from the rows that are not held out, predict all."""
    model = train(docs.where(~held_out()), per_language)
    out = identify(docs, model, ambiguous_below)
    return out.withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def reject_unidentified(docs: DataFrame, per_language: int = 400, ambiguous_below: float = 0.5) -> DataFrame:
    """The documents whose language is known and clear, with all their columns."""
    bounded_batches(docs.sparkSession)
    model = Sent(docs.sparkSession, train(docs.where(~held_out()), per_language))
    at = docs.columns.index("text")

    def keep(batches):
        import pyarrow as pa

        release()
        for batch in batches:
            names, _, unclear = predictions(model.value, batch.column(at).to_pylist(), ambiguous_below)
            yield batch.filter(pa.array([n != "und" and not u for n, u in zip(names, unclear)]))

    return docs.mapInArrow(keep, docs.schema)
