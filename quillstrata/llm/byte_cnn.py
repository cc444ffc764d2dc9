"""Language identification by a convolutional network over bytes, trained and applied in numpy.

Each byte has a learned vector; filters of several widths slide over a window of fixed length, each keeps its largest response,
and a softmax layer tells the language.  A text is cut into consecutive windows (each begins WIDEST - 1 bytes early, so that
no byte sequence is lost at a border), all of its windows are scored, and the windows' log-probabilities are averaged,
weighted by their bytes.

For scoring, the byte vectors are multiplied into the filters beforehand: a filter's response is then a sum of table rows, one for
each pair of neighbouring bytes, so no matrix product is left but the last one.

Training uses a bounded sample: of each language that the table has, however many, the TRAIN_ROWS texts of lowest hash (fewer, if
all languages together would take more than TRAIN_TOTAL; one at least), and of each text TRAIN_PIECES pieces of WINDOW characters spread
evenly over it.  Scoring reads whole texts.

Defined results: null texts and texts without a letter (Unicode category L) are `und` with score 0; of languages with equal scores the
first by name is told; rows are answered one by one, so repeated rows repeat; very long texts are scored in parts; without any
training row every text is `und`; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import give_back

WINDOW, WIDTHS, WIDEST = 256, (2, 3, 4), 4
DIM, FILTERS = 8, 8
#: Texts for each language and for all of them; pieces of each text; passes.
TRAIN_ROWS, TRAIN_TOTAL, TRAIN_PIECES, PASSES, RATE = 400, 100_000, 4, 6, 0.01
UNKNOWN = "und"
_LIKE_LETTER = re.compile(r"[^\W\d_]")  # also finds numbers such as ½ and Ⅷ
_BATCH, _ROWS = 4096, 256  # windows scored at once (1 MB of bytes); texts taken from Arrow at once


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LIKE_LETTER.finditer(text))


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded windows (n, WINDOW) of bytes and the number of new bytes in each."""
    step = WINDOW - (WIDEST - 1)
    n = max(1, -(-(len(data) - (WIDEST - 1)) // step))
    padded = np.zeros((n - 1) * step + WINDOW, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    sizes = np.full(n, step, np.float32)
    sizes[-1] = max(1, len(data) - (n - 1) * step)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step], sizes


@dataclass
class Network:
    """embed (256, DIM); kernels by width (width * DIM, FILTERS); bias (3 * FILTERS); out (3 * FILTERS, languages); out_bias."""

    languages: list[str]
    embed: np.ndarray
    kernels: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], seed: int = 0) -> Network:
        rng, names = np.random.default_rng(seed), sorted(set(langs))
        cut = [windows(t.encode())[0] for t in texts]
        x = np.concatenate(cut)
        y = np.repeat([names.index(v) for v in langs], [len(c) for c in cut])
        f = FILTERS * len(WIDTHS)
        net = cls(names, rng.normal(0, 0.5, (256, DIM)).astype(np.float32), [rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(f, np.float32), rng.normal(0, f**-0.5, (f, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
        net.embed[0] = 0
        params = [net.embed, *net.kernels, net.bias, net.out, net.out_bias]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(PASSES):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 64):
                t += 1
                for p, g, m, v in zip(params, net._gradients(x[order[at : at + 64]], y[order[at : at + 64]]), first, second, strict=True):  # Adam
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
                net.embed[0] = 0
        return net

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, e = len(x), self.embed[x]
        pooled, best, cuts = [], [], []
        for w, k in zip(WIDTHS, self.kernels, strict=True):
            c = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
            r = c @ k
            a = r.argmax(axis=1)
            pooled.append(np.take_along_axis(r, a[:, None], 1)[:, 0])
            best.append(a)
            cuts.append(c)
        h = np.concatenate(pooled, axis=1) + self.bias
        on = np.maximum(h, 0)
        z = on @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        dh = (p @ self.out.T) * (h > 0)
        de, dks = np.zeros_like(self.embed), []
        for i, (w, k) in enumerate(zip(WIDTHS, self.kernels, strict=True)):
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            dk = np.zeros_like(k)
            rows = np.arange(n)
            for j in range(FILTERS):
                dk[:, j] = d[:, j] @ cuts[i][rows, best[i][:, j]]
                back = (d[:, j, None] * k[:, j]).reshape(n, w, DIM)
                for o in range(w):
                    np.add.at(de, x[rows, best[i][:, j] + o], back[:, o])
            dks.append(dk)
        return [de, *dks, dh.sum(0), on.T @ p, p.sum(0)]

    def tables(self) -> list[np.ndarray]:
        """Responses of filters to two neighbouring bytes: widths 2 and 3 (first two) and 4 (first, last two), and to width 3's last byte."""
        one = [[self.embed @ k[j * DIM : (j + 1) * DIM] for j in range(w)] for w, k in zip(WIDTHS, self.kernels, strict=True)]
        two = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        (a0, a1), (b0, b1, b2), (c0, c1, c2, c3) = one
        return [np.ascontiguousarray(np.concatenate([two(a0, a1), two(b0, b1), two(c0, c1)], axis=1)), b2, np.ascontiguousarray(two(c2, c3))]

    def scorer(self):
        """(windows, WINDOW) bytes -> log-probabilities."""
        heads, third, tail = self.tables()

        def score(x: np.ndarray) -> np.ndarray:
            n, m = len(x), WINDOW - WIDEST + 1
            pooled = np.empty((n, FILTERS * 3), np.float32)
            for at in range(0, n, 64):  # 64 windows: the responses stay in the cache
                part = x[at : at + 64].astype(np.uint16)
                pair = (part[:, :-1] << 8) | part[:, 1:]
                r = heads.take(pair, 0, mode="clip")
                r[:, :-1, FILTERS : 2 * FILTERS] += third.take(part[:, 2:], 0, mode="clip")
                r[:, :m, 2 * FILTERS :] += tail.take(pair[:, 2:], 0, mode="clip")
                pooled[at : at + 64, :FILTERS] = r[:, :, :FILTERS].max(1)
                pooled[at : at + 64, FILTERS : 2 * FILTERS] = r[:, :-1, FILTERS : 2 * FILTERS].max(1)
                pooled[at : at + 64, 2 * FILTERS :] = r[:, :m, 2 * FILTERS :].max(1)
            z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
            z -= z.max(1, keepdims=True)
            return z - np.log(np.exp(z).sum(1, keepdims=True))

        return score


def _decider(net: Network | None):
    """(languages, scores) of a list of texts; every window of every text is scored."""
    score = net.scorer() if net else None

    def decide(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        preds, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if not waiting:
                return
            counts = [len(w) for _, w, _ in waiting]
            logp = score(np.concatenate([w for _, w, _ in waiting])) * np.concatenate([s for _, _, s in waiting])[:, None]
            total = np.add.reduceat(logp, np.cumsum([0, *counts[:-1]]), axis=0)
            for (i, _, sizes), row in zip(waiting, total, strict=True):
                p = np.exp((row - row.max()) / sizes.sum())
                preds[i], scores[i] = net.languages[int(row.argmax())], float(p.max() / p.sum())
            waiting.clear()

        held = 0
        for i, text in enumerate(texts if net else ()):
            if text and has_letter(text):
                waiting.append((i, *windows(text.encode())))
                held += len(waiting[-1][1])
                if held >= _BATCH:
                    flush()
                    held = 0
        flush()
        return preds, scores

    return decide


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)
    give_back()


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = _decider(net)
        for batch in _parts(batches):
            preds, scores = decide(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def pieces(text: F.Column) -> F.Column:
    """TRAIN_PIECES pieces of WINDOW characters, spread evenly from the text's begin to its end."""
    room = F.greatest(F.length(text) - WINDOW, F.lit(0))
    starts = F.transform(F.sequence(F.lit(0), F.lit(TRAIN_PIECES - 1)), lambda k: F.floor(room * k / (TRAIN_PIECES - 1)).cast("int") + 1)
    return F.transform(F.array_distinct(starts), lambda at: F.substring(text, at, F.lit(WINDOW)))


def train(docs: DataFrame) -> Network | None:
    """Fits on rows that aren't held out (see above for the sample)."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(1, min(TRAIN_ROWS, TRAIN_TOTAL // len(counts)))
    # a threshold on the hash leaves some 2 `each` of each language in one scan for all of them
    space = 1 << 40
    bounds = [(lang, space if n <= 4 * each else space * 2 * each // n) for lang, n in counts.items()]
    bound = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound bigint"))
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(space))
    drawn: dict[str, list[tuple[int, list[str]]]] = {}
    for r in rows.withColumn("h", h).join(bound, "lang").filter("h < bound").select("lang", "h", pieces(F.col("text")).alias("cut")).collect():
        drawn.setdefault(r["lang"], []).append((r["h"], r["cut"]))
    texts, names = [], []
    for lang, found in sorted(drawn.items()):
        cut = [t for _, c in sorted(found)[:each] for t in c if has_letter(t)]
        texts += cut
        names += [lang] * len(cut)
    return Network.fit(texts, names) if texts else None


def report(docs: DataFrame) -> DataFrame:
    """The columns of query op7."""
    out = predict(docs, train(docs))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, net: Network | None, least_score: float) -> DataFrame:
    """docs (doc_id, text, lang and any others) whose language is known with least_score or more; a null lang becomes the prediction."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = _decider(net)
        for batch in _parts(batches):
            preds, scores = decide(batch.column("text").to_pylist())
            keep = [i for i, (p, s) in enumerate(zip(preds, scores, strict=True)) if p != UNKNOWN and s >= least_score]
            part = batch.take(pa.array(keep, pa.int64()))
            lang = [known if known is not None else preds[i] for i, known in zip(keep, part.column("lang").to_pylist(), strict=True)]
            columns = [pa.array(lang, pa.string()) if c == "lang" else part.column(c) for c in names]
            yield pa.record_batch(columns, names)

    return docs.mapInArrow(run, docs.schema)
