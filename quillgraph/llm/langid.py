"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.session import narrow_batches
from quillgraph.llm.text import text_slices

#: Bounds of the labelled sample: languages, rows of each (about; by a hash of the row), characters of a row
#: (a longer text is sampled from a hashed place on).
MAX_LANGUAGES, ROWS_PER_LANGUAGE, SAMPLE_CHARS = 256, 500, 1 << 15
BUCKETS, DIMS, ORDERS = 1 << 16, 16, (2, 3, 4)
#: A small sample is gone through more often: every fit takes about STEPS steps.
STEPS, BATCH, RATE = 600, 32, 2.0
#: A text is rejected if its language is not likelier than all others together, and if it scores below
#: all but this share of the calibration texts of its length.
EVEN_ODDS, KNOWN_REJECTED = 0.5, 0.001
# Code points of letters of many scripts, first and last.
SCRIPTS = ((0x0250, 0x02A0), (0x0370, 0x03E0), (0x0400, 0x0500), (0x0531, 0x0570), (0x05D0, 0x05DB), (0x0620, 0x06B0), (0x0904, 0x0920), (0x0E01, 0x0E12), (0x10D0, 0x10E0), (0x3041, 0x30DC), (0x4E00, 0x9F00), (0xAC00, 0xD700))
#: Subwords of a text at which the calibration changes.
LENGTH_STEPS = (8, 16, 32, 64, 128, 256)
UNDETERMINED = "und"

_FOLD = np.zeros(256, np.uint8)  # letters, lower-cased; 0 ends a word
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ODD = np.uint32(0x9E3779B1)


def subwords(data: np.ndarray, bounds: np.ndarray):
    """For each order, the bucket of the subword at every byte; BUCKETS where none starts.

    Subwords are UTF-8 byte runs of one word with its borders; Latin capitals are lower-cased.
    """
    n = len(data)
    b = _FOLD[data]
    if n > 1:  # capitals of the Latin-1 block are C3 80..9E
        up = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
        b[up] += 32
    # A border of 0 goes before, between and after texts, so that no subword spans two of them.
    at = bounds[:-1]
    padded = np.insert(b, at, 0)
    starts = at + np.arange(len(at))
    padded = np.concatenate([padded, np.zeros(max(ORDERS), np.uint8)]).astype(np.uint32)
    m = n + len(at)
    out = []
    key = padded[:m].copy()
    inner = np.ones(m, bool)
    for k in range(1, max(ORDERS)):
        nxt = padded[k : m + k]
        key |= nxt << np.uint32(8 * k)
        if k + 1 in ORDERS:
            full = inner & ((padded[:m] != 0) | (nxt != 0)) if k == 1 else inner
            bucket = (((key * _ODD) ^ np.uint32((k * 0x85EBCA6B) & 0xFFFFFFFF)) * _ODD) >> np.uint32(16)
            bucket[~full] = BUCKETS
            out.append(bucket)
        inner = inner & (nxt != 0)
    return starts, out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language: embedding times output weights
    bias: np.ndarray
    heat: np.ndarray  # temperature by length step
    threshold: np.ndarray  # least accepted score by length step

    def logits(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits and the number of subwords of each text."""
        starts, orders = subwords(data, bounds)
        total = np.zeros((len(starts), len(self.languages)))
        count = np.zeros(len(starts), np.int64)
        for bucket in orders:
            count += np.add.reduceat((bucket != BUCKETS).astype(np.int32), starts)
            for c in range(len(self.languages)):
                total[:, c] += np.add.reduceat(self.table[:, c][bucket], starts)
        return total / np.maximum(count, 1)[:, None] + self.bias, count

    def accepted(self, scores: np.ndarray, count: np.ndarray) -> np.ndarray:
        return scores >= self.threshold[np.searchsorted(LENGTH_STEPS, count, "right")]

    def scores(self, logits: np.ndarray, count: np.ndarray) -> np.ndarray:
        z = logits / self.heat[np.searchsorted(LENGTH_STEPS, count, "right")][:, None]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 11) -> Model | None:
    """Fit on random stretches of 12 to 400 bytes of the texts; a fifth of the texts is kept to calibrate."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    gold = np.array([languages.index(x) for x in labels])
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    held = rng.random(len(raw)) < 0.2
    if held.all() or not held.any() or len(raw) < 10:
        held[:] = False
        held[: len(raw) // 5] = True
    fit = np.flatnonzero(~held) if (~held).any() else np.arange(len(raw))
    emb = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS + 1, DIMS))
    emb[BUCKETS] = 0
    w, bias = rng.normal(0, 0.1, (DIMS, len(languages))), np.zeros(len(languages))

    def stretch(x: np.ndarray) -> np.ndarray:
        size = int(rng.choice((12, 25, 50, 100, 200, 400)))
        at = int(rng.integers(0, max(1, len(x) - size)))
        return x[at : at + size]

    weight = len(gold) / (len(languages) * np.bincount(gold, minlength=len(languages)))
    epochs = -(-STEPS // -(-len(fit) // BATCH))
    steps = epochs * -(-len(fit) // BATCH)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(fit)
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            parts = [stretch(raw[r]) for r in rows]
            bounds = np.cumsum([0, *map(len, parts)])
            starts, orders = subwords(np.concatenate(parts), bounds)
            ids, owner = [], []
            own = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(orders[0]))))
            for bucket in orders:
                ok = bucket != BUCKETS
                ids.append(bucket[ok]), owner.append(own[ok])
            ids, owner = np.concatenate(ids), np.concatenate(owner)
            count = np.maximum(np.bincount(owner, minlength=len(rows)), 1)
            hidden = np.zeros((len(rows), DIMS))
            np.add.at(hidden, owner, emb[ids])
            hidden /= count[:, None]
            z = hidden @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), gold[rows]] -= 1
            p *= weight[gold[rows]][:, None] / len(rows)
            rate = RATE * (1 - step / steps)
            back = p @ w.T / count[:, None]
            w -= rate * hidden.T @ p
            bias -= rate * p.sum(0)
            np.subtract.at(emb, ids, rate * 16 * back[owner])
            step += 1
    model = Model(languages, (emb @ w).astype(np.float32), bias, np.ones(len(LENGTH_STEPS) + 1), np.zeros(len(LENGTH_STEPS) + 1))
    _calibrate(model, [raw[r] for r in (np.flatnonzero(held) if held.any() else fit)], gold[held] if held.any() else gold[fit], stretch, rng)
    return model


def _no_language(rng, n: int) -> list[np.ndarray]:
    """Invented texts of no language: letters at random from thirty neighbouring code points of some script."""
    made = []
    for _ in range(n):
        first = int(rng.integers(*SCRIPTS[int(rng.integers(len(SCRIPTS)))]))
        letters = rng.integers(first, first + 30, int(rng.choice((4, 8, 16, 32, 64, 128))))
        text = "".join(" " if rng.random() < 0.15 else chr(c) for c in letters)
        made.append(np.frombuffer(text.encode(), np.uint8))
    return made


def _calibrate(model: Model, raw, gold, stretch, rng) -> None:
    """Temperatures by length that make scores probabilities, then the rejection thresholds.

    A temperature is the one of least loss over calibration texts, which should score their language,
    and over invented texts of no language, which should score all languages alike. Without the
    latter, texts that are told apart without a mistake would make every score a certainty.
    """
    parts, want = list(raw), list(gold)
    for _ in range(4):
        parts += [stretch(x)[: int(rng.integers(4, 400))] for x in raw]
        want += list(gold)
    strange = _no_language(rng, max(60, len(parts) // 4))
    want = np.array([*want, *[-1] * len(strange)])
    parts += strange
    logits, count = model.logits(np.concatenate([*parts, np.empty(0, np.uint8)]), np.cumsum([0, *map(len, parts)]))
    step = np.searchsorted(LENGTH_STEPS, count, "right")
    grid = np.geomspace(0.05, 20, 60)
    last = 1.0
    for s in reversed(range(len(model.heat))):
        rows = np.flatnonzero((step == s) & (count > 0))
        if (want[rows] >= 0).sum() >= 20:
            target = np.where(want[rows, None] < 0, 1 / len(model.languages), want[rows, None] == np.arange(len(model.languages)))

            def loss(t, rows=rows, target=target):
                z = logits[rows] / t
                z = z - z.max(1, keepdims=True)
                return -(target * (z - np.log(np.exp(z).sum(1, keepdims=True)))).sum(1).mean()

            last = float(grid[int(np.argmin([loss(t) for t in grid]))])
        model.heat[s] = last
    top = model.scores(logits, count).max(1)
    for at in range(len(model.heat)):
        own = top[(step == at) & (count > 0) & (want >= 0)]
        # Too few texts of a length to tell: a text of it is accepted from the least score seen on.
        model.threshold[at] = min(EVEN_ODDS, float(np.quantile(own, KNOWN_REJECTED, method="lower"))) if len(own) else 0.0


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_language_model(docs: DataFrame, id_col: str = "doc_id") -> Model | None:
    """Fit on a bounded sample: about ROWS_PER_LANGUAGE labelled rows of each of the most common languages.

    Rows held out, without a label, a text or an id take no part. Null if nothing is labelled.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return None
    unit = 1 << 40
    quota = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(1.0, ROWS_PER_LANGUAGE / r["n"]) * unit)))])
    row = F.xxhash64(F.col(id_col).cast("string"), "text")
    chosen = usable.where(F.pmod(row, F.lit(unit)) < F.coalesce(quota[F.col("lang")], F.lit(0))).where(F.col("text").rlike(r"\p{L}"))
    place = F.pmod(F.xxhash64(row, F.lit(1)), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    sample = chosen.select(F.col(id_col).cast("string").alias("k"), "lang", row.alias("row"), F.col("text").substr(place.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    # Repeated rows are one, so that as many rows are chosen as the quota says.
    rows = sample.groupBy("k", "lang", "row").agg(F.min("text").alias("text")).toArrow().sort_by([("k", "ascending"), ("text", "ascending")])
    return train(rows.column("text").to_pylist(), rows.column("lang").to_pylist())


def _predict(column: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and acceptance of every text of a column."""
    n = len(column)
    langs, scores, ok = [UNDETERMINED] * n, np.zeros(n), np.zeros(n, bool)
    letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if model is None:
        return langs, scores, ok
    for row, data, bounds in text_slices(column):
        logits, count = model.logits(data, bounds)
        p = model.scores(logits, count)
        best = p.argmax(1)
        fine = model.accepted(p.max(1), count)
        for i in np.flatnonzero(letters[row : row + len(best)]):
            langs[row + i] = model.languages[best[i]]
            scores[row + i] = p[i, best[i]]
            ok[row + i] = fine[i]
    return langs, scores, ok


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, accepted) of every row, from the whole text alone.

    Null, empty and letterless texts are ``und`` with score 0 and are not accepted; so is everything
    if nothing was labelled. Repeated rows get equal predictions; other columns are not read.
    """

    narrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            langs, scores, ok = _predict(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores), pa.array(ok)], names=[id_col, "held_out", "lang_pred", "score", "accepted"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col, held_out(id_col).alias("held_out")).mapInArrow(run, f"{id_col} {kind}, held_out boolean, lang_pred string, score double, accepted boolean")


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is rejected; all columns stay."""
    where = docs.columns.index(text_col)
    narrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            _, _, ok = _predict(batch.column(where), model)
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)


def op3_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of ``documents``, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit_language_model(docs))
