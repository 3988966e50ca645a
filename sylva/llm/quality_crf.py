"""Document quality from a linear-chain conditional random field over lines (operator 6).

Every line is good or bad. Its score depends on features of the line and of its neighbours, and a
transition score joins the labels of adjacent lines. Forward-backward gives each line's probability
of being good; their mean, weighted by line length, is calibrated to the document's score.

Lines have no labels of their own; they are latent. A document's label says how much of it, by length,
is good: at least GOOD_SHARE of a good one and at most BAD_SHARE of a bad one. Learning starts from
what lines look like by themselves and then alternates (expectation maximisation with posterior
constraints, Ganchev et al., 2010): line probabilities are the chain's, moved as little as meets the
share, and the chain is fitted to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .near_dedup import _BASE, _BYTE, _powers_to, mix, word_hashes

#: Learning uses at most about this many labelled documents, in the order of a hash, up to this many characters in all (and LINE_COST for each line).
FIT_DOCS, FIT_CHARS, LINE_COST = 4000, 10_000_000, 100
#: How much of a document's text, by length, its label says is good: no less in a good one, no more in a bad one.
GOOD_SHARE, BAD_SHARE = 0.9, 0.5
#: Rounds of expectation and maximisation.
EM_ROUNDS = 2
_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "mark": b"#*$%&<>@^~_=+\\{}", "pipe": b"|",
    "shout": b"!", "stop": b".,;:?'\"-()", "space": b" \t\r\v\f", "wide": bytes(range(0xC0, 0x100)), "rest": bytes(range(0x80, 0xC0)),
}
_KIND = np.full(256, len(_KINDS), np.uint8)
for _i, _bytes in enumerate(_KINDS.values()):
    _KIND[list(_bytes)] = _i
N_LINE = 15
N_FEATURES = 3 * N_LINE + 2


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, lines per text). Every text has at least one line; all of them are taken whole."""
    data = np.frombuffer(b"".join(x.encode() + b"\n" for x in texts), np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    per_text = np.array([x.count("\n") + 1 for x in texts])
    doc = np.repeat(np.arange(len(texts)), per_text)
    kind = _KIND[data]
    n = {name: np.add.reduceat(kind == i, starts, dtype=np.int64) for i, name in enumerate(_KINDS)}
    size = ends - starts
    chars = size - n["rest"]
    letters = n["upper"] + n["lower"] + n["wide"]
    up, down = _powers_to(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])])
    line_hash = mix((sums[ends] - sums[starts]) * down[starts] + size.astype(np.uint64))
    same_line = _repeats(line_hash, doc) & (chars > 0)

    words, word_counts = word_hashes(texts)
    word_doc = np.repeat(np.arange(len(texts)), word_counts)
    blank = np.concatenate([[True], (kind == list(_KINDS).index("space")) | (data == 10)])
    word_line = np.searchsorted(ends, np.flatnonzero(blank[:-1] & ~blank[1:]))
    n_words = np.bincount(word_line, minlength=len(ends))
    again = np.zeros(len(words), bool)
    if len(words) >= 3:
        windows = mix(words[:-2] * np.uint64(3) + mix(words[1:-1]) * np.uint64(5) + mix(mix(words[2:])) * np.uint64(7))
        inside = word_doc[:-2] == word_doc[2:]
        again[:-2][inside] = _repeats(windows[inside], word_doc[:-2][inside])
    repeated = np.bincount(word_line, weights=again, minlength=len(ends))

    c, w = np.maximum(chars, 1), np.maximum(n_words, 1)
    last = data[np.maximum(ends - 1, 0)]
    own = np.stack(
        [
            np.log1p(chars), np.log1p(n_words), letters / c, n["upper"] / np.maximum(letters, 1), n["digit"] / c, n["mark"] / c, n["mark"] / w, n["pipe"] / w,
            n["shout"] / w, n["stop"] / w, n["wide"] / c, np.minimum(chars / w, 30) / 10, np.isin(last, list(b".?!")) & (chars > 0), same_line, repeated / w,
        ],
        axis=1,
    ).astype(np.float64)
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    final = np.concatenate([doc[1:] != doc[:-1], [True]])
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[final] = 0, 0
    return np.concatenate([own, before, after, first[:, None], final[:, None]], axis=1), np.maximum(chars, 1), per_text


def _repeats(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each hash occurs more than once in its text."""
    _, inverse, counts = np.unique(mix(hashes + doc.astype(np.uint64) * np.uint64(_BASE)), return_inverse=True, return_counts=True)
    return counts[inverse] > 1


@dataclass
class Crf:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of a line being good
    bias: float
    change: np.ndarray  # 2 x 2 scores of adjacent labels
    slope: float = 1.0
    offset: float = 0.0

    def unary(self, features: np.ndarray) -> np.ndarray:
        return (features - self.mean) / self.scale @ self.weights + self.bias

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all lines of all texts the probability of being good and the length, and how many lines each text has."""
        features, lengths, per_text = line_features(texts)
        return forward_backward(self.unary(features), per_text, self.change)[0], lengths, per_text

    def score(self, texts: list[str]) -> np.ndarray:
        """A number from 0 to 1 for each text, higher for a likelier good one."""
        good, lengths, per_text = self.lines(texts)
        return sigmoid(self.slope * pooled(good, lengths, per_text) + self.offset)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def pooled(good: np.ndarray, lengths: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """The log odds of each text's mean line probability, lines weighted by length."""
    begins = np.cumsum(per_text) - per_text
    p = np.clip(np.add.reduceat(good * lengths, begins) / np.add.reduceat(lengths, begins), 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def forward_backward(unary: np.ndarray, per_text: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Each line's probability of being good, the expected counts of adjacent labels, and the sum of log normalisers.

    All texts advance together, line by line; those with more lines come first, so the ones still
    running are a prefix.
    """
    order = np.argsort(-per_text, kind="stable")
    counts, begins = per_text[order], (np.cumsum(per_text) - per_text)[order]
    running = np.searchsorted(-counts, -np.arange(1, int(counts[0]) + 1), "right")
    kernel = np.exp(change - change.max())
    shift = np.maximum(unary, 0)
    emit = np.stack([np.exp(-shift), np.exp(unary - shift)], axis=1)
    ahead, scale = np.empty_like(emit), np.empty(len(unary))
    state = np.ones((len(counts), 2))
    alone = int(np.searchsorted(-running, -1, "left"))  # from this line on, one text is left
    if len(running) - alone < 64:
        alone = len(running)
    for t, n in enumerate(running[:alone]):
        at = begins[:n] + t
        state = (state[:n] @ kernel if t else state[:n]) * emit[at]
        scale[at] = total = state.sum(1)
        state = state / total[:, None]
        ahead[at] = state
    behind = np.ones_like(emit)
    pairs = np.zeros((2, 2))
    if alone < len(running):
        _long_tail(slice(begins[0] + alone, begins[0] + len(running)), alone > 0, emit, kernel, ahead, behind, scale, pairs)
    for t in range(alone - 1, 0, -1):
        n = running[t]
        at = begins[:n] + t
        follow = emit[at] * behind[at] / scale[at][:, None]
        pairs += np.einsum("ni,ij,nj->ij", ahead[at - 1], kernel, follow)
        behind[at - 1] = follow @ kernel.T
    good = ahead[:, 1] * behind[:, 1]
    good /= good + ahead[:, 0] * behind[:, 0]
    return good, pairs, float(np.log(scale).sum() + shift.sum() + change.max() * (per_text - 1).sum())


def _long_tail(lines: slice, has_before: bool, emit: np.ndarray, kernel: np.ndarray, ahead: np.ndarray, behind: np.ndarray, scale: np.ndarray, pairs: np.ndarray) -> None:
    """Both passes over the lines that only the longest text has, one by one in plain Python, into the arrays given."""
    (k00, k01), (k10, k11) = kernel.tolist()
    own, first = emit[lines].tolist(), lines.start
    a0, a1 = ahead[first - 1].tolist() if has_before else (0.0, 0.0)
    forth, totals = [], []
    for i, (e0, e1) in enumerate(own):
        s0, s1 = ((a0 * k00 + a1 * k10) * e0, (a0 * k01 + a1 * k11) * e1) if i or has_before else (e0, e1)
        total = s0 + s1
        a0, a1 = s0 / total, s1 / total
        forth.append((a0, a1))
        totals.append(total)
    ahead[lines], scale[lines] = forth, totals
    b0 = b1 = 1.0
    back = [(b0, b1)]
    p00 = p01 = p10 = p11 = 0.0
    before = [ahead[first - 1].tolist() if has_before else None, *forth]
    for i in range(len(own) - 1, -1 if has_before else 0, -1):
        f0, f1 = own[i][0] * b0 / totals[i], own[i][1] * b1 / totals[i]
        x0, x1 = before[i]
        p00, p01, p10, p11 = p00 + x0 * k00 * f0, p01 + x0 * k01 * f1, p10 + x1 * k10 * f0, p11 + x1 * k11 * f1
        b0, b1 = f0 * k00 + f1 * k01, f0 * k10 + f1 * k11
        back.append((b0, b1))
    begin = first - 1 if has_before else first
    behind[begin : lines.stop] = back[::-1]
    pairs += [[p00, p01], [p10, p11]]


def constrained(unary: np.ndarray, lengths: np.ndarray, per_text: np.ndarray, change: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line probabilities and expected pairs of the distribution nearest to the chain's whose shares fit the labels.

    It is the chain with every line's score moved by its share of the text's length times a number of
    the text, which bisection finds for all texts together.
    """
    begins = np.cumsum(per_text) - per_text
    total = np.add.reduceat(lengths, begins).astype(np.float64)
    part = lengths / np.repeat(total / per_text, per_text)
    sign = np.where(labels == 1, 1.0, -1.0)
    share = lambda good: np.add.reduceat(good * lengths, begins) / total
    fits = lambda good: np.where(labels == 1, share(good) >= GOOD_SHARE, share(good) <= BAD_SHARE)
    low, high = np.zeros(len(labels)), np.full(len(labels), 64.0)
    high[fits(forward_backward(unary, per_text, change)[0])] = 0
    for _ in range(8):
        middle = (low + high) / 2
        enough = fits(forward_backward(unary + np.repeat(sign * middle, per_text) * part, per_text, change)[0])
        low, high = np.where(enough, low, middle), np.where(enough, middle, high)
    good, pairs, _ = forward_backward(unary + np.repeat(sign * high, per_text) * part, per_text, change)
    return good, pairs


def fit_texts(texts: list[str], labels: np.ndarray, decay: float = 1.0, rounds: int = 25) -> Crf:
    """Latent line labels by EM, each maximisation by L-BFGS with a squared penalty; then the two calibration numbers by Newton steps."""
    features, lengths, per_text = line_features(texts)
    mean, scale = features.mean(0), features.std(0) + 1e-6
    x = (features - mean) / scale
    n = N_FEATURES

    def fitted(p: np.ndarray, y: np.ndarray, seen: np.ndarray, free: np.ndarray) -> np.ndarray:
        def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
            unary, change = x @ p[:n] + p[n], p[n + 1 :].reshape(2, 2)
            good, pairs, log_norm = forward_backward(unary, per_text, change)
            value = log_norm - (y * unary).sum() - (seen * change).sum() + decay / 2 * (p @ p)
            grad = np.concatenate([x.T @ (good - y), [(good - y).sum()], (pairs - seen).ravel()]) + decay * p
            return value / len(y), grad * free / len(y)

        return lbfgs(loss, p, rounds)

    by_itself = np.zeros(n + 5)
    by_itself[:N_LINE] = by_itself[n] = 1
    p = fitted(np.zeros(n + 5), np.repeat(labels.astype(np.float64), per_text), np.zeros((2, 2)), by_itself)
    for _ in range(EM_ROUNDS):
        y, seen = constrained(x @ p[:n] + p[n], lengths, per_text, p[n + 1 :].reshape(2, 2), labels)
        p = fitted(p, y, seen, np.ones(n + 5))
    crf = Crf(mean, scale, p[:n], float(p[n]), p[n + 1 :].reshape(2, 2))
    good, _, _ = forward_backward(crf.unary(features), per_text, crf.change)
    z = np.stack([pooled(good, lengths, per_text), np.ones(len(texts))], axis=1)
    ab = np.array([1.0, 0.0])
    for _ in range(30):
        q = sigmoid(z @ ab)
        ab -= np.linalg.solve(z.T @ (z * (q * (1 - q))[:, None]) + np.eye(2), z.T @ (q - labels) + (ab - [1.0, 0.0]))
    if ab[0] > 0:
        crf.slope, crf.offset = float(ab[0]), float(ab[1])
    return crf


def lbfgs(loss, p: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    value, grad = loss(p)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step = -grad
        kept = []
        for s, y in reversed(past):
            a = s @ step / (s @ y)
            kept.append(a)
            step = step - a * y
        if past:
            s, y = past[-1]
            step = step * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(kept), strict=True):
            step = step + s * (a - y @ step / (s @ y))
        slope, rate = grad @ step, 1.0
        if slope >= 0:
            step, slope, past = -grad, -(grad @ grad), []
        for _ in range(25):
            new = p + rate * step
            new_value, new_grad = loss(new)
            if new_value <= value + 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        if (new - p) @ (new_grad - grad) > 1e-12:
            past = [*past[1 - memory :], (new - p, new_grad - grad)]
        done = value - new_value < 1e-7
        p, value, grad = new, new_value, new_grad
        if done:
            break
    return p


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> Crf:
    """Learn from labelled documents that are not held out, of each label half of ``fit_docs`` at most.

    They are chosen by a hash of the id, and then taken in the order of that hash as long as their
    characters stay within ``fit_chars``; one that would go beyond is left out. This bounds what comes to
    the driver: first ids and sizes, then the texts. Rows of labels with a null in id or quality, or
    an id with both labels, teach nothing. With documents of one label or none, the score is that
    label's rate.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    one = 1 << 30
    share = {q: int(one * min(1.0, fit_docs / 2 / n)) for q, n in counts.items()}
    place = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(one))
    chosen = known.where(place < F.when(F.col("quality") == 1, share.get(1, 0)).otherwise(share.get(0, 0))).select("doc_id", "quality", place.alias("place"))
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text")).where(F.col("text").isNotNull())
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    sizes = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "place").agg(F.sum(F.length("text") + LINE_COST * lines).alias("size")).collect()  # about fit_docs rows
    left, taken = fit_chars, []
    for r in sorted(sizes, key=lambda r: (r["place"], r["doc_id"])):
        if r["size"] <= left:
            left -= r["size"]
            taken.append((r["doc_id"],))
    wanted = docs.sparkSession.createDataFrame(taken, "doc_id bigint").join(chosen, "doc_id")
    rows = texts.join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "quality").collect()  # fit_chars characters
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    if len({r["quality"] for r in rows}) < 2:
        rate = (sum(r["quality"] for r in rows) + 1) / (len(rows) + 2)
        flat = np.zeros(N_FEATURES)
        return Crf(flat, flat + 1, flat, float(np.log(rate / (1 - rate))), np.zeros((2, 2)))
    return fit_texts([r["text"] for r in rows], np.array([r["quality"] for r in rows]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` from its whole text alone.

    A null or empty text is one empty line; a null id stays and is not held out; repeated rows give a
    row each; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(x) for x in texts], chars=2_000_000):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(crf.score(texts[a:b]), pa.float64())], ["doc_id", "score"])

    source = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    scored = source.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
