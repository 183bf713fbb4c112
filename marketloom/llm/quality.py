"""Quality scores by compression with dictionaries of good and of bad text.

One zstandard dictionary is trained from texts labelled 1 and one from texts labelled 0.
A text is cut into pieces of one size, however long it is, and every piece is compressed
with both: in one long frame the text's own history would take over from the dictionaries,
and only its head would be judged. The difference of the two sums of sizes over the text's
own size says which dictionary knows it better, and their mean over its size how repetitive
its pieces are.
Logistic calibration, fitted on labelled texts that neither dictionary has seen, turns
the two numbers into a probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.caches import forget

#: The fit takes at most so many labelled rows of each class, half of them for the
#: dictionaries, the other half for calibration, and none longer than the second bound.
SAMPLE_ROWS = 6000
SAMPLE_CHARS = 200_000
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: Bytes of the pieces that texts are cut into: near the length of the texts of the fit.
PIECE_BYTES = 4096
THRESHOLD = 0.7


@dataclass
class QualityModel:
    """Two dictionaries and the weights of (1, size difference, mean size)."""

    good: bytes = b""
    bad: bytes = b""
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])
    usual: list[float] = field(default_factory=lambda: [0.0, 0.0])
    level: int = LEVEL

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Size difference and mean size of each text, over its bytes; the usual ones without text."""
        import zstandard

        sides = [
            zstandard.ZstdCompressor(
                level=self.level, dict_data=_dictionary(d), write_content_size=False, write_dict_id=False, write_checksum=False
            )
            for d in (self.good, self.bad)
        ]
        rows = []
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            if raw:
                good, bad = (sum(len(side.compress(piece)) for piece in pieces(raw)) for side in sides)
                rows.append(((bad - good) / len(raw), (bad + good) / 2 / len(raw)))
            else:
                rows.append(tuple(self.usual))
        return np.array(rows, float).reshape(-1, 2)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.good or not self.bad:
            margin = np.full(len(texts), self.weights[0])
        else:
            margin = self.weights[0] + self.features(texts) @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def pieces(raw: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """All of ``raw``, cut evenly into as few pieces of at most ``size`` bytes as it takes."""
    n = -(-len(raw) // size)
    return (raw[len(raw) * k // n : len(raw) * (k + 1) // n] for k in range(n))


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data)


def train_dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too few texts to train on, their own bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:]


def calibrate(features: np.ndarray, labels: np.ndarray, penalty: float = 1e-3, steps: int = 30) -> list[float]:
    """Weights of a lightly penalised logistic regression, by Newton steps."""
    centre, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(features)), (features - centre) / spread])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * penalty
        w += np.linalg.solve(hessian, x.T @ (labels - p) - penalty * w)
    slopes = w[1:] / spread
    return [float(w[0] - slopes @ centre), *map(float, slopes)]


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    sample_chars: int = SAMPLE_CHARS,
    dictionary_bytes: int = DICTIONARY_BYTES,
    level: int = LEVEL,
) -> QualityModel:
    """Fit on a bounded sample of the labelled rows, taken in the order of a hash of the id.

    Null labels, null ids, ids without a document and empty texts teach nothing. Where one
    class is missing, every text gets the smoothed share of label 1.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = {0: 0, 1: 0}
    known |= {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    model = QualityModel(level=level, weights=[float(np.log((known[1] + 1) / (known[0] + 1))), 0.0, 0.0])
    order = F.xxhash64("doc_id")
    ids = [rows.where(F.col("label") == k).orderBy(order, "doc_id").limit(2 * sample_rows) for k in (0, 1)]
    chosen = F.broadcast(ids[0].union(ids[1]))  # 4 x sample_rows rows at most
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, sample_chars)).join(chosen, "doc_id")
    found = {0: [], 1: []}
    for k in (0, 1):
        for r in texts.where(F.col("label") == k).orderBy(order, "doc_id", "text").limit(sample_rows).toLocalIterator():
            found[k].append(r.text)
    if min(len(found[0]), len(found[1])) < 2:
        return model
    seen = {k: [t.encode("utf-8", "surrogatepass") for t in found[k][::2]] for k in (0, 1)}
    model.good, model.bad = train_dictionary(seen[1], dictionary_bytes), train_dictionary(seen[0], dictionary_bytes)
    fresh = {k: found[k][1::2] for k in (0, 1)}
    features = model.features(fresh[1] + fresh[0])
    model.usual = [float(v) for v in features.mean(axis=0)]
    y = np.array([1.0] * len(fresh[1]) + [0.0] * len(fresh[0]))
    model.weights = calibrate(features, y)
    # the classes' shares in the sample are not those of the labels
    model.weights[0] += float(np.log((known[1] + 1) / (known[0] + 1)) - np.log(len(fresh[1]) / len(fresh[0])))
    return model


def score_quality(docs: DataFrame, model: QualityModel, keep: tuple[str, ...], name: str = "score") -> DataFrame:
    """The columns ``keep`` and, as ``name``, the score of each row's whole ``text``.

    Null and empty texts score as the usual calibration text. Repeated rows stay; other
    columns are not read. Empty in, empty out.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    read = [*keep] if "text" in keep else [*keep, "text"]
    at = read.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            score = model.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score, pa.float64())], names=[*keep, name])

    out = StructType([*(docs.schema[c] for c in keep), StructField(name, DoubleType())])
    return docs.select(*read).mapInArrow(scored, out)


def held_out(doc_id: str, folds: int, fold: int):
    """Whether crc32 of the id as text has this remainder; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels.where(~held_out("doc_id", 4, 2)))
    return score_quality(docs, model, ("doc_id",)).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op4_quality": op4_quality}
CHECKS: dict[str, str] = {}
