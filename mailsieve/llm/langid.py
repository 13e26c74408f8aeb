"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word between two spaces forwards and backwards and labels every
position with a distribution over the languages; a document's probabilities are the mean over
all positions of its whole text.  Digits and ASCII punctuation part words, ASCII
letters are folded, words over ``LONGEST`` bytes are read in pieces.  Since no state crosses a word border,
a word is labelled once and remembered by its worker; what it is worth does not depend on
where it stands.

Training is backpropagation through time in numpy, on the driver, over a bounded sample of labelled
rows: about ``DOCS_ALL`` documents, shared evenly among all languages (``DOCS_EACH`` at most and ``DOCS_LEAST``
at least of each), and ``WORDS_EACH`` words of each document.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import remembered

DOCS_EACH = 200
DOCS_ALL = 12_800
DOCS_LEAST = 8
WORDS_EACH = 40
LONGEST = 30
HIDDEN = 16
#: Languages up to which groups and memories have their full size; with more they shrink in proportion.
FULL = 64
EPOCHS = 3
#: Words remembered by a worker; past it the memory is emptied and filled anew.
KEPT_WORDS = 400_000
UNKNOWN = "und"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    found = text.encode("utf-8", "replace").translate(_FOLD).split()
    if any(len(w) > LONGEST for w in found):
        found = [w[i:i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _table(words: list[bytes]) -> np.ndarray:
    """Words of one length as steps x words, with a space on either side."""
    n = len(words[0])
    x = np.full((len(words), n + 2), 32, np.uint8)
    x[:, 1:-1] = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)
    return x.T


def _by_length(words: list[bytes], most: int) -> Iterator[np.ndarray]:
    """Positions of the words, in groups of one length of at most ``most``."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        for at in range(0, len(group), most):
            yield group[at:at + most]


def shrunk(most: int, labels: int) -> int:
    """``most`` rows of up to ``FULL`` labels, or so many of more labels as take the same memory."""
    return max(1, most * FULL // max(FULL, labels))


class Network:
    """Parameters by direction: ``x`` (byte to gates), ``u`` (state to gates), ``b``; and the labels' ``w``, ``c``."""

    def __init__(self, labels: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {f"{n}{d}": rng.normal(0, s, shape).astype(np.float32) for d in "fb" for n, s, shape in (
            ("x", 0.3, (256, 3 * hidden)), ("u", hidden ** -0.5, (hidden, 3 * hidden)), ("b", 0.0, (3 * hidden,)))}
        self.p |= {"w": rng.normal(0, hidden ** -0.5, (2 * hidden, labels)).astype(np.float32),
                   "c": np.zeros(labels, np.float32)}

    def _forward(self, x: np.ndarray, d: str, keep: bool):
        h, p = self.h, self.p
        state, states, memory = np.zeros((x.shape[1], h), np.float32), [], []
        wx, u = p["x" + d] + p["b" + d], p["u" + d]
        for row in x:
            g, s = wx[row], state @ u
            zr = _sigmoid(g[:, :2 * h] + s[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(g[:, 2 * h:] + r * s[:, 2 * h:])
            if keep:
                memory.append((state, z, r, n, s[:, 2 * h:]))
            state = n + z * (state - n)
            states.append(state)
        return np.stack(states), memory

    def _backward(self, x: np.ndarray, d: str, memory, grad: np.ndarray, out: dict) -> None:
        h, u = self.h, self.p["u" + d]
        gx, gu = np.zeros((256, 3 * h), np.float32), np.zeros_like(u)
        carry, eye = np.zeros_like(grad[0]), np.eye(256, dtype=np.float32)
        for t in range(len(x) - 1, -1, -1):
            before, z, r, n, sn = memory[t]
            g = grad[t] + carry
            dn = g * (1 - z) * (1 - n * n)
            dz = g * (before - n) * z * (1 - z)
            dr = dn * sn * r * (1 - r)
            ds = np.concatenate([dz, dr, dn * r], 1)
            gx += eye[x[t]].T @ np.concatenate([dz, dr, dn], 1)
            gu += before.T @ ds
            carry = g * z + ds @ u.T
        out["x" + d], out["u" + d], out["b" + d] = gx, gu, gx.sum(0)

    def labels(self, x: np.ndarray, keep: bool = False):
        """Probabilities, steps x words x languages, of every position."""
        f, mf = self._forward(x, "f", keep)
        b, mb = self._forward(x[::-1], "b", keep)
        both = np.concatenate([f, b[::-1]], 2)
        e = both @ self.p["w"] + self.p["c"]
        e = np.exp(e - e.max(2, keepdims=True))
        return e / e.sum(2, keepdims=True), (both, mf, mb)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        prob, (both, mf, mb) = self.labels(x, keep=True)
        d = prob.copy()
        d[:, np.arange(len(y)), y] -= 1
        d *= (weight / (len(x) * len(y)))[None, :, None]
        flat, h = d.reshape(-1, d.shape[2]), self.h
        out = {"w": both.reshape(-1, 2 * h).T @ flat, "c": flat.sum(0)}
        up = d @ self.p["w"].T
        self._backward(x, "f", mf, up[:, :, :h], out)
        self._backward(x[::-1], "b", mb, up[::-1, :, h:], out)
        return out

    def fit(self, words: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.01) -> None:
        """Adam; languages weigh alike whatever their share of the words."""
        share = np.bincount(y, minlength=len(self.p["c"])) / len(y)
        weights = (1 / np.maximum(share, 1e-9) / (share > 0).sum())[y].astype(np.float32)
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        rng, step = np.random.default_rng(11), 0
        for epoch in range(epochs):
            order = rng.permutation(len(words))
            groups = [order[g] for g in _by_length([words[i] for i in order], batch)]
            rng.shuffle(groups)
            for group in groups:
                step += 1
                g = self.gradients(_table([words[i] for i in group]), y[group], weights[group] * len(group) / batch)
                size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                lr = rate * (0.5 ** epoch) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                for k, v in g.items():
                    v = v * min(1.0, 1.0 / (size + 1e-9))
                    mean[k] += 0.1 * (v - mean[k])
                    square[k] += 0.001 * (v * v - square[k])
                    self.p[k] -= lr * mean[k] / (np.sqrt(square[k]) + 1e-8)

    def worth(self, words: list[bytes]) -> np.ndarray:
        """Sum over the positions of each word of the language probabilities."""
        out = np.zeros((len(words), len(self.p["c"])), np.float32)
        for group in _by_length(words, shrunk(4096, out.shape[1])):
            out[group] = self.labels(_table([words[i] for i in group]))[0].sum(0)
        return out


def sample(docs: DataFrame, docs_each: int = DOCS_EACH, words_each: int = WORDS_EACH,
           docs_all: int = DOCS_ALL) -> list[tuple[str, list[bytes]]]:
    """Labelled words of a bounded sample: documents of least hashed id, among those with words, of each language."""
    known = docs.where(F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7F]") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    many = known.select("lang").distinct().count()
    docs_each = min(docs_each, max(DOCS_LEAST, docs_all // max(1, many)))
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (known.select("lang", "doc_id")
              .withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= docs_each).select("doc_id").distinct())

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            cut = []
            for r in rows:
                words = words_of(r["text"])
                own = random.Random(zlib.crc32(str(r["doc_id"]).encode()))
                cut.append(own.sample(words, min(words_each, len(words))))
            yield pa.RecordBatch.from_pydict({"doc_id": [r["doc_id"] for r in rows],
                                              "lang": [r["lang"] for r in rows],
                                              "words": pa.array(cut, pa.list_(pa.binary()))})

    some = known.join(F.broadcast(chosen), "doc_id").select("doc_id", "lang", "text")
    rows = some.mapInArrow(pick, "doc_id long, lang string, words array<binary>").collect()
    return [(r.lang, [bytes(w) for w in r.words]) for r in sorted(rows, key=lambda r: (r.doc_id, r.lang))]


def train(docs: DataFrame, **bounds: int) -> tuple[list[str], Network]:
    """Languages and network from rows of ``doc_id, text, lang``."""
    rows = sample(docs, **bounds)
    langs = sorted({lang for lang, words in rows if words})
    code = {lang: i for i, lang in enumerate(langs)}
    words = [w for lang, some in rows for w in some]
    net = Network(max(1, len(langs)))
    if words:
        net.fit(words, np.array([code[lang] for lang, some in rows for _ in some]))
    return langs, net


def predict(docs: DataFrame, langs: list[str], net: Network, lettered: str | None = None) -> DataFrame:
    """Adds ``lang_pred, score`` to the rows; only the text is looked at, all columns stay
    (but columns of these two names).

    ``und`` with score 0 where the text is null or has no letter, or nothing could be learned; a column
    named ``lettered``, if one is asked for, says whether the text has a letter.
    Repeated rows get equal answers; an empty table gives no rows.  One pass, no shuffle.
    """
    docs = docs.drop("lang_pred", "score")
    n = max(1, len(langs))
    step, kept = shrunk(500, n), shrunk(KEPT_WORDS, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[bytes, int] = remembered(object(), dict)
        worth = np.zeros((1024, n), np.float32)
        for batch in batches:
            pred, score, letters = [], [], []
            for at in range(0, batch.num_rows, step):
                texts = batch.column("text").slice(at, step).to_pylist()
                some = [words_of(t) if t else [] for t in texts]
                if len(place) > kept:
                    place.clear()
                new = list(set().union(*some).difference(place))
                if new:
                    start = len(place)
                    if start + len(new) > len(worth):
                        worth = np.concatenate([worth[:start], np.zeros((start + 2 * len(new), n), np.float32)])
                    worth[start:start + len(new)] = net.worth(new)
                    place.update(zip(new, range(start, start + len(new))))
                for text, words in zip(texts, some):
                    letters.append(bool(words) and has_letter(text))
                    if not letters[-1] or not langs:
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    total = worth[np.fromiter(map(place.__getitem__, words), np.int64, len(words))].sum(0, dtype=np.float64)
                    share = total / total.sum()
                    best = int(np.argmax(np.round(share, 6)))
                    pred.append(langs[best])
                    score.append(min(1.0, round(float(share[best]), 6)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                 *([pa.array(letters, pa.bool_())] if lettered else [])],
                names=[*batch.schema.names, "lang_pred", "score", *([lettered] if lettered else [])])

    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double")
    if lettered:
        schema = schema.add(lettered, "boolean")
    return docs.mapInArrow(run, schema)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
