"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's features are its byte n-grams of ORDERS, ASCII letters lowered and every other ASCII byte
taken as a gap, hashed into BUCKETS. Their embeddings are averaged over the whole text and a softmax
scores the languages. Embeddings and weights are trained by stochastic gradient descent in numpy on a
bounded sample (PER_LANGUAGE rows of a language, ROWS in all; documented parameters). Workers hash the sample; the driver gets bags of
counts, at most BUCKETS a row, and no text. A part of the sample that training never sees sets the softmax's temperature.

Rejection weighs how likely a text's n-grams are in the learned languages against how likely they are in noise: half of
it the same texts with their letters shuffled, half any n-gram at all. A text is rejected where the evidence, summed over its
n-grams, speaks for noise; where more than REJECT of the texts kept out of training that are named rightly would be, the bound is lowered to let
these pass. So texts of languages that were not learned, other scripts and letter junk go, and short clean texts, on which there is little evidence, stay.
Languages beyond the ROWS / 10 most frequent are not learned.

Since average and softmax are linear up to the end, the trained model is one table of BUCKETS x
languages (or x DIM, whichever is narrower), which workers gather from in numpy.

Defined cases: null text, or text without a letter, is ``und`` with score 0 and is rejected; so is all
when no labelled row exists; ties between languages go to the first by code point; rows repeat as
they are; texts of any length are read whole; extra columns are kept by the filter and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _A, marked, pick, place_of, sliced, text_bytes, written

ORDERS, BUCKETS, DIM = (2, 3, 4), 1 << 16, 16
PER_LANGUAGE, ROWS = 1000, 20_000
EPOCHS, RATE, REJECT = 4, 0.5, 0.002
#: Tasks that hash the sample.
TASKS = 8
UNKNOWN = "und"
_BLOCK = 1 << 19
_LETTER = regex.compile(r"\p{L}")

_CODES = np.arange(256, dtype=np.uint64) + np.uint64(1)
_CODES[:128] = 1
_CODES[97:123] = np.arange(98, 124)
_CODES[65:91] = np.arange(98, 124)


#: How much of an n-gram that neither side has shown counts, against one in BUCKETS.
SMOOTH = 0.02

Bag = tuple[np.ndarray, np.ndarray]


def features(data: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram at each byte; BUCKETS where it would cross the end of its text."""
    n = len(data)
    codes = _CODES[data]
    h = np.zeros(n, np.uint64)
    m = max(0, n - order + 1)
    for j in range(order):
        h[:m] = (h[:m] + codes[j : j + m]) * np.uint64(_A)
    out = (h >> np.uint64(48)).astype(np.int64) if BUCKETS == 1 << 16 else (h >> np.uint64(20)).astype(np.int64) % BUCKETS
    if m < n:
        out[m:] = BUCKETS
    for back in range(1, order):
        at = ends - back
        out[at[(at >= 0) & (at < n)]] = BUCKETS
    return out


def bag(text: str) -> Bag:
    """The buckets of a text, and how often each occurs."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    idx = np.concatenate([features(data, np.array([len(data)]), n) for n in ORDERS]) if len(data) else np.zeros(0, np.int64)
    found, n = np.unique(idx[idx < BUCKETS], return_counts=True)
    return found.astype(np.uint16 if BUCKETS <= 1 << 16 else np.uint32), n.astype(np.uint16 if n.max(initial=0) < 1 << 16 else np.uint32)


def scrambled(text: str) -> str:
    """The same letters in any order, everything else in its place; alike for the same text."""
    letters = [i for i, c in enumerate(text) if c.isalpha()]
    out = list(text)
    for i, j in zip(letters, np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace"))).permutation(letters).tolist()):
        out[i] = text[j]
    return "".join(out)


@dataclass
class Model:
    """languages; table (BUCKETS + 1 rows, the last zero); project (None if the table has logits); known: of each bucket the
    evidence for a learned language against noise; threshold: of that evidence, below which a text is rejected."""

    languages: list[str]
    table: np.ndarray
    project: np.ndarray | None
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    known: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + 1))
    notes: dict = field(default_factory=dict)

    def _mixed(self, mean: np.ndarray) -> np.ndarray:
        return (np.einsum("ij,jk->ik", mean, self.project) if self.project is not None else mean) + self.bias

    def of_bags(self, bags: list[Bag]) -> tuple[np.ndarray, np.ndarray]:
        """Logits and evidence of bags."""
        mean = np.array([(self.table[b] * n[:, None]).sum(0) / max(1, n.sum()) for b, n in bags], float).reshape(len(bags), self.table.shape[1])
        return self._mixed(mean), np.array([float((self.known[b] * n).sum()) for b, n in bags])

    def logits(self, column: pa.Array) -> np.ndarray:
        """One row a text, untempered."""
        return self.seen(column)[0]

    def seen(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Logits and evidence of each text, read once, in blocks."""
        wide = self._wide()
        data, rows = text_bytes(column)
        total = np.zeros((len(rows) - 1, wide.shape[1]))
        count = np.zeros(len(rows) - 1)
        look = max(ORDERS) - 1
        for at in range(0, len(data), _BLOCK):
            end = min(len(data), at + _BLOCK)
            part = data[at : min(len(data), end + look)]
            lo, hi = np.searchsorted(rows, at, "right") - 1, np.searchsorted(rows, end, "left")
            inside = np.arange(lo, hi)[rows[lo + 1 : hi + 1] > rows[lo:hi]]  # texts with bytes here
            begin = np.maximum(rows[inside], at) - at
            ends = rows[1:][(rows[1:] > at) & (rows[1:] <= at + len(part))] - at
            for order in ORDERS:
                idx = features(part, ends, order)[: end - at]
                total[inside] += np.add.reduceat(wide[idx], begin, axis=0)
                count[inside] += np.add.reduceat((idx != BUCKETS).astype(np.int64), begin)
        return self._mixed(total[:, :-1] / np.maximum(count, 1)[:, None]), total[:, -1]

    def _wide(self) -> np.ndarray:
        """The table with the evidence beside it, so that both are gathered at once."""
        if getattr(self, "_both", None) is None or self._both.shape[1] != self.table.shape[1] + 1:
            self._both = np.hstack([self.table, self.known[:, None].astype(self.table.dtype)])
        return self._both

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        return self.judged(column)[:2]

    def judged(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and whether it is rejected."""
        if not self.languages:
            return [UNKNOWN] * len(column), np.zeros(len(column)), np.ones(len(column), bool)
        z, evidence = self.seen(column)
        z /= self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        score = p[np.arange(len(p)), best]
        named = [self.languages[b] for b in best]
        rejected = evidence < self.threshold
        for i, text in enumerate(column.to_pylist()):
            if not text or not _LETTER.search(text):
                named[i], score[i], rejected[i] = UNKNOWN, 0.0, True
        return named, score, rejected


def train(texts: list[str], labels: list[str], seed: int = 11) -> Model:
    return fit([bag(t) for t in texts], labels, _noise_of([bag(scrambled(t)) for t in texts]), seed)


def _noise_of(bags: list[Bag]) -> np.ndarray:
    """The mean share of each bucket."""
    total = np.zeros(BUCKETS)
    for found, n in bags:
        total[found] += n / max(1, n.sum())
    return total / max(1, len(bags))


def evidence_of(known: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Of each bucket, the log of how likely it is in the learned languages against noise; both are mean shares."""
    any_of_them = 1.0 / BUCKETS
    told = np.log((known + SMOOTH * any_of_them) / (0.5 * noise + (0.5 + SMOOTH) * any_of_them))
    return np.append(told, 0.0)


def fit(bags: list[Bag], labels: list[str], noise: np.ndarray, seed: int = 11) -> Model:
    """On every fifth-but-one bag, calibrated on the fifth. ``noise``: the mean shares of the scrambled texts."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1, 1)), None, np.zeros(1))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    held = set(order[: len(bags) // 5].tolist()) if len(bags) >= 50 else set()
    y = np.array([languages.index(x) for x in labels])
    fitted = [i for i in order.tolist() if i not in held]
    known = evidence_of(_noise_of([bags[i] for i in fitted]), noise)
    # All bags lie in two arrays, which go back whole when training ends.
    ends = np.cumsum([0, *[len(b) for b, _ in bags]]).tolist()
    buckets, shares = np.empty(ends[-1], np.uint16 if BUCKETS <= 1 << 16 else np.uint32), np.empty(ends[-1], np.float32)
    for i, (found, n) in enumerate(bags):
        buckets[ends[i] : ends[i + 1]], shares[ends[i] : ends[i + 1]] = found, n / max(1, n.sum())
        if held and i not in held:
            bags[i] = None  # what training reads lies in the arrays
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weight, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    weight += rng.normal(0, 0.1, weight.shape)
    epochs = max(EPOCHS, min(200, 5000 // max(1, len(fitted))))  # small samples are seen more often
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for i in rng.permutation(fitted).tolist():
            idx, share = buckets[ends[i] : ends[i + 1]], shares[ends[i] : ends[i + 1]]
            if not len(idx):
                continue
            mean = np.einsum("i,ij->j", share, embed[idx])  # no threaded BLAS on the driver
            z = np.einsum("i,ij->j", mean, weight) + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = np.einsum("ij,j->i", weight, p)
            weight -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            # An embedding's share is small; its step is scaled by the bag's inverse mean share.
            embed[idx] -= rate * min(50.0, len(idx) / 8) * np.outer(share, back)
    del buckets, shares
    table = np.vstack([embed, np.zeros((1, DIM), np.float32)])
    narrow = len(languages) <= DIM
    model = Model(languages, np.einsum("ij,jk->ik", table, weight) if narrow else table, None if narrow else weight, bias.astype(float))
    model.known = known
    check = sorted(held) or fitted
    (z, evidence), truth = model.of_bags([bags[i] for i in check]), y[check]

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(-(s[np.arange(len(s)), truth] - np.log(np.exp(s).sum(1))).mean())

    model.temperature = min((2.0 ** (k / 4) for k in range(-16, 17)), key=loss)
    right = z.argmax(1) == truth
    model.threshold = float(min(0.0, np.quantile(evidence[right], REJECT))) if right.any() else 0.0
    model.notes = {"fitted": len(fitted), "calibrated": len(check), "accuracy": float(right.mean()) if len(right) else 0.0}
    return model


_BAG = "lang string, r int, buckets binary, counts binary, noise binary"


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bag of each row; on each task's last row, with r 0 and no language, the scrambled texts' shares summed up."""
    total, rows, schema = np.zeros(BUCKETS), 0, pa.schema([("lang", pa.string()), ("r", pa.int32()), ("buckets", pa.binary()), ("counts", pa.binary()), ("noise", pa.binary())])
    for batch in batches:
        out = []
        for lang, text, r in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), batch.column("r").to_pylist()):
            found, n = bag(text)
            out.append((lang, r, found.tobytes(), n.tobytes(), None))
            found, n = bag(scrambled(text))
            total[found] += n / max(1, n.sum())
            rows += 1
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema)
    if rows:
        yield pa.RecordBatch.from_pylist([{"lang": None, "r": rows, "buckets": None, "counts": None, "noise": total.tobytes()}], schema)


def sample(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE, rows: int = ROWS) -> tuple[list[Bag], list[str], np.ndarray]:
    """Bags, languages and the noise's mean shares of a bounded sample of labelled texts, alike for the same rows: those whose ids hash lowest."""
    labelled = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    labelled = labelled.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)))
    counts = labelled.groupBy("lang").count()
    top = counts.orderBy(F.desc("count"), "lang").limit(rows // 10)
    keep = max(1, top.count())
    share = max(1, min(per_language, rows // keep))
    cut = top.select("lang", F.least(F.lit(1.0), F.lit(1.3 * share + 20) / F.col("count")).alias("cut"))
    few = labelled.join(F.broadcast(cut), "lang").filter(F.col("h") < F.col("cut") * F.lit(float(1 << 30)))  # rows // 10 languages at most
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    found = few.select("lang", "doc_id", "h", "text").withColumn("r", rank).filter(F.col("r") <= share).select("lang", "text", "r").coalesce(TASKS)
    told = found.mapInArrow(sliced(_bagged, 100, tidy=True), _BAG).collect()  # ``rows`` bags and a vector of BUCKETS a task
    kind = np.uint16 if BUCKETS <= 1 << 16 else np.uint32
    counts = lambda b, n: np.frombuffer(n, np.uint16 if len(n) * np.dtype(kind).itemsize == len(b) * 2 else np.uint32)
    bags = sorted(((x["lang"], x["r"], x["buckets"], x["counts"]) for x in told if x["lang"] is not None), key=lambda x: x[:2])
    noise = [(np.frombuffer(x["noise"], np.float64), x["r"]) for x in told if x["lang"] is None]
    mean = sum((v for v, _ in noise), np.zeros(BUCKETS)) / max(1, sum(n for _, n in noise))
    return [(np.frombuffer(b, kind), counts(b, n)) for _, _, b, n in bags], [x[0] for x in bags], mean


def identify(docs: DataFrame, usable: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, Model]:
    """doc_id, lang_pred, score, rejected (and the columns in ``keep``) of each row, and the model.
    ``usable`` (over doc_id, text, lang) says which rows may be learned from; by default all."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id=doc_id, text=text, lang=lang).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = model or fit(*sample(rows, usable if usable is not None else F.lit(True)))
    out = rows.select("doc_id", "text")
    kind = out.schema["doc_id"].dataType.simpleString()
    if kind == "void":
        out, kind = out.withColumn("doc_id", F.col("doc_id").cast("long")), "bigint"
    return out.mapInArrow(sliced(predictor(model, drop=("text",)), tidy=True), f"doc_id {kind}, lang_pred string, score double, rejected boolean"), model


def predictor(model: Model, text: str = "text", drop: tuple[str, ...] = ()):
    """Adds lang_pred, score and rejected to Arrow batches."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, score, rejected = model.judged(batch.column(text))
            columns = {n: batch.column(n) for n in batch.schema.names if n not in drop}
            columns |= {"lang_pred": pa.array(named, pa.string()), "score": pa.array(np.clip(score, 0, 1), pa.float64()), "rejected": pa.array(rejected, pa.bool_())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return predict


def accepted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs``, all their columns, whose language is not rejected. Only texts go through the
    model; rows are then found by a hash of id and text, and few of them are shuffled for it."""
    rows = pick(docs, doc_id=doc_id, text=text, lang=lang).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(*sample(rows, F.lit(True)))
    judged = rows.select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("key"), "text").mapInArrow(sliced(predictor(model, drop=("text",)), tidy=True), "key long, lang_pred string, score double, rejected boolean")
    gone = written(judged.filter("rejected").select("key").distinct(), "langid-rejected")
    names, columns = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    at = [F.lit(None) if i is None else F.col(f"c{i}") for i in (place_of(docs, doc_id), place_of(docs, text))]
    told = marked(docs.toDF(*columns).withColumn("key", F.xxhash64(*[c.cast("string") for c in at])), gone)
    kept = told.filter("not _maybe").select(*columns).unionByName(told.filter("_maybe").join(gone, "key", "left_anti").select(*columns))
    return kept.toDF(*names)
