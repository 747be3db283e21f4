"""Language identification: a bidirectional gated recurrent network over bytes.

Every byte of a text gets a label distribution from a forward and a backward state; a document's
prediction is the mean over its positions. The network is trained in numpy by backpropagation
through time on a bounded sample of labelled rows (``SAMPLE_DOCS`` for each language, a window of
``SAMPLE_BYTES`` from a place in the text that its hash picks). One more class, learned from drawn
noise (codes, random characters, scripts that no learned language uses), stands for text in no
learned language; its mean over a document's words is the document's ``foreign``.

Prediction reads every byte of every text: texts are cut into stretches that run side by side, each
with some bytes of its neighbours before and after, whose labels don't count.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catchment.llm.common import map_batches

#: Labelled documents of each language, and bytes of each, that training uses at most.
SAMPLE_DOCS, SAMPLE_BYTES = 250, 512
HIDDEN, STRETCH, EPOCHS, SEED = 8, 64, 10, 7
#: Bytes of a stretch in prediction, and of its neighbours on either side.
WIDE, CONTEXT = 128, 16
#: A document is in no learned language from this mean probability of the noise class on.
FOREIGN_AT = 0.8
#: Stretches that a task runs side by side, at most.
LANES = 4096
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """Weights: for each direction the input table (256 x 3H) and recurrent matrix (3H x H); then the output layer.

    The output layer has a row for each label and a last one for text in none of these languages.
    """

    labels: list[str]
    table: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def new(labels: list[str], hidden: int, seed: int) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        return Network(
            labels,
            [draw(256, 3 * hidden, s=0.4) for _ in range(2)],
            [draw(3 * hidden, hidden, s=hidden**-0.5) for _ in range(2)],
            draw(len(labels) + 1, 2 * hidden, s=hidden**-0.5),
            np.zeros((len(labels) + 1, 1), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.recurrent, self.out, self.bias]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _run(net: Network, way: int, steps: np.ndarray, keep: bool = False):
    """States (T, H, N) of one direction over ``steps`` (T, N) bytes; what backpropagation needs as well, if kept."""
    hidden = net.recurrent[way].shape[1]
    table, gates, cand = net.table[way], net.recurrent[way][: 2 * hidden], net.recurrent[way][2 * hidden :]
    n = steps.shape[1]
    h = np.zeros((hidden, n), np.float32)
    states, saved = np.empty((len(steps), hidden, n), np.float32), []
    for t, byte in enumerate(steps):
        x = np.ascontiguousarray(table[byte].T)
        g = _sigmoid(x[: 2 * hidden] + gates @ h)
        z, r = g[:hidden], g[hidden:]
        rh = r * h
        c = np.tanh(x[2 * hidden :] + cand @ rh)
        new = c + z * (h - c)
        if keep:
            saved.append((h, z, r, rh, c))
        h = states[t] = new
    return states, saved


def _probabilities(net: Network, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """(T, L, N) label distributions."""
    hidden = forward.shape[1]
    scores = net.out[:, :hidden] @ forward + net.out[:, hidden:] @ backward + net.bias
    scores -= scores.max(1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(1, keepdims=True)
    return scores


def _gradients(net: Network, steps: np.ndarray, real: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients of the mean cross-entropy over all real positions, through time."""
    hidden = net.recurrent[0].shape[1]
    forward, kept_f = _run(net, 0, steps, True)
    backward, kept_b = _run(net, 1, steps[::-1], True)
    p = _probabilities(net, forward, backward[::-1])
    total = max(real.sum(), 1)
    picked = np.take_along_axis(p, target[None, None, :].repeat(len(steps), 0), 1)[:, 0]
    loss = -(np.log(picked + 1e-9) * real).sum() / total
    d = p * real[:, None]
    d[:, target, np.arange(len(target))] -= real
    d /= total
    both = np.concatenate([forward, backward[::-1]], 1)
    d_out, d_bias = np.einsum("tln,thn->lh", d, both, optimize=True), d.sum((0, 2))[:, None]
    d_both = np.einsum("lh,tln->thn", net.out, d, optimize=True)
    tables, recurrents = [], []
    for way, kept, d_states, order in ((0, kept_f, d_both[:, :hidden], steps), (1, kept_b, d_both[::-1, hidden:], steps[::-1])):
        gates, cand = net.recurrent[way][: 2 * hidden], net.recurrent[way][2 * hidden :]
        d_table, d_rec = np.zeros_like(net.table[way]), np.zeros_like(net.recurrent[way])
        d_h = np.zeros_like(kept[0][0])
        for t in range(len(order) - 1, -1, -1):
            h, z, r, rh, c = kept[t]
            d_new = d_h + d_states[t]
            d_c = d_new * (1 - z) * (1 - c * c)
            d_z = d_new * (h - c) * z * (1 - z)
            d_rh = cand.T @ d_c
            d_r = d_rh * h * r * (1 - r)
            d_g = np.concatenate([d_z, d_r])
            d_h = d_new * z + d_rh * r + gates.T @ d_g
            d_rec[: 2 * hidden] += d_g @ h.T
            d_rec[2 * hidden :] += d_c @ rh.T
            np.add.at(d_table, order[t], np.concatenate([d_g, d_c]).T)
        tables.append(d_table)
        recurrents.append(d_rec)
    return float(loss), [*tables, *recurrents, d_out.astype(np.float32), d_bias.astype(np.float32)]


def stretches(texts: list[bytes], width: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (N, width), how many are real, and the text each stretch is from."""
    sizes = np.array([len(x) for x in texts], np.int64)
    counts = -(-sizes // width)
    owner = np.repeat(np.arange(len(texts)), counts)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    real = np.minimum(sizes[owner] - rank * width, width)
    flat = np.frombuffer(b"".join(texts) + bytes(width), np.uint8)
    begin = (np.cumsum(sizes) - sizes)[owner] + rank * width
    return np.lib.stride_tricks.sliding_window_view(flat, width)[begin] if len(owner) else np.empty((0, width), np.uint8), real, owner


#: First and last code points of scripts that noise is drawn from.
_SCRIPTS = [(0x370, 0x3FF), (0x400, 0x4FF), (0x590, 0x5FF), (0x600, 0x6FF), (0x900, 0x97F), (0xE00, 0xE7F), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]


def noise(count: int, size: int, seed: int, known: list[bytes] = ()) -> list[bytes]:
    """``count`` texts of up to ``size`` bytes in no language.

    In turn: hexadecimal and base-64 codes, printable ASCII, keys hit at random, digits and signs,
    scripts of which ``known`` texts hold no letter.
    """
    r = np.random.default_rng(seed)
    used = {c for x in known for c in set(x.decode("utf-8", "ignore"))}
    scripts = [(a, b) for a, b in _SCRIPTS if not any(a <= ord(c) <= b for c in used)]
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=", "".join(map(chr, range(33, 127))), "asdfghjklqwxzvbnm", "0123456789.,:;-+%#*/()[]{}<>|=_"]
    out = []
    for k in range(count):
        n = int(r.integers(size // 8, size))
        kind = k % (len(alphabets) + 2 * bool(scripts))
        if kind < len(alphabets):
            letters = np.array(list(alphabets[kind]))
        else:
            low, high = scripts[int(r.integers(len(scripts)))]
            letters = np.array([chr(c) for c in r.integers(low, high + 1, 40)])
        drawn = r.choice(letters, n)
        if k % 2 or kind >= len(alphabets):
            drawn[r.random(n) < 0.12] = " "
        out.append("".join(drawn).encode()[:size])
    return out


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fits the network by Adam on stretches of the texts and of noise; every position has its text's label."""
    names = sorted(set(labels))
    net = Network.new(names, hidden, seed)
    place = {name: k for k, name in enumerate(names)}
    drawn = noise(max(1, len(texts) // max(1, len(names))), SAMPLE_BYTES, seed, texts) if texts else []
    data, real, owner = stretches([*texts, *drawn])
    if not len(data):
        return net
    target = np.array([place[x] for x in labels] + [len(names)] * len(drawn))[owner]
    r = np.random.default_rng(seed)
    weights = net.parameters()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step, batch = 0, 256
    for epoch in range(epochs):
        order = r.permutation(len(data))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            mask = (np.arange(STRETCH)[:, None] < real[own]).astype(np.float32)
            _, grads = _gradients(net, data[own].T, mask, target[own])
            step += 1
            rate = 0.02 * (1 - 0.9 * epoch / epochs)
            for w, g, m, v in zip(weights, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def in_words(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which bytes are in words: runs of letters (any byte beyond ASCII is one) that hold no digit or underscore.

    ``starts`` are the places where texts begin, so that no run goes on into the next text.
    """
    letter = (flat >= 0x80) | ((flat | 0x20) - np.uint8(ord("a")) < 26)
    other = (flat - np.uint8(ord("0")) < 10) | (flat == ord("_"))
    edge = np.ones(len(flat), bool)
    edge[1:] = (letter | other)[1:] != (letter | other)[:-1]
    edge[starts] = True
    begin = np.flatnonzero(edge)
    mixed = np.add.reduceat(other, begin) > 0
    return letter & ~np.repeat(mixed, np.diff(np.append(begin, len(flat))))


def predict(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean distribution over the positions of each text (texts x labels and one more for no language); zero for empty ones.

    The last column is the mean over the bytes in words, as numbers and codes are in no language;
    over all bytes, where a text has no word.
    """
    sizes = np.array([len(x) for x in texts], np.int64)
    counts = -(-sizes // WIDE)
    owner = np.repeat(np.arange(len(texts)), counts)
    core = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * WIDE
    # A stretch's bytes in its text: its own from ``core`` on, and those around it.
    begin = np.maximum(core - CONTEXT, 0)
    low = core - begin
    high = np.minimum(core + WIDE, sizes[owner]) - begin
    real = np.minimum(core + WIDE + CONTEXT, sizes[owner]) - begin
    flat = np.frombuffer(b"".join(texts) + bytes(WIDE + 2 * CONTEXT), np.uint8)
    firsts = np.cumsum(sizes) - sizes
    begin += firsts[owner]
    worded = in_words(flat, firsts)
    lone = np.add.reduceat(worded, firsts, dtype=np.int64) * (sizes > 0) if len(sizes) else sizes
    worded |= np.repeat(np.append(lone == 0, True), np.append(sizes, WIDE + 2 * CONTEXT))
    total = np.zeros((len(texts), len(net.labels) + 1))
    order = np.argsort(-real, kind="stable")  # full stretches first, so that lanes end together
    for k in range(0, len(order), LANES):
        own = order[k : k + LANES]
        width = int(real[own].max())
        places = np.arange(width)[:, None]
        steps = flat[begin[own] + places]
        # The backward pass begins at each stretch's last byte.
        short = int(real[own].min()) < width
        turned = np.where(places < real[own], real[own] - 1 - places, places) if short else None
        forward, _ = _run(net, 0, steps)
        back = np.take_along_axis(steps, turned, 0) if short else steps[::-1]
        backward, _ = _run(net, 1, np.ascontiguousarray(back))
        backward = np.take_along_axis(backward, turned[:, None, :], 0) if short else backward[::-1]
        p = _probabilities(net, forward, backward)
        p *= ((places >= low[own]) & (places < high[own]))[:, None]
        p[:, -1] *= worded[begin[own] + places]
        np.add.at(total, owner[own], p.sum(0).T)
    total[:, :-1] /= np.maximum(sizes, 1)[:, None]
    total[:, -1] /= np.where(lone > 0, lone, np.maximum(sizes, 1))
    return total


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, docs_each: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES) -> tuple[list[bytes], list[str]]:
    """A bounded labelled sample: windows of ``size`` bytes, at most ``docs_each`` texts of each language.

    Rows are picked by a hash of doc_id and length, at a rate set by their language's count. Every
    language has its rows, so the sample grows with the number of languages only.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return [], []
    pick = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) / float(1 << 30)
    rates = F.create_map(*[F.lit(x) for row in counts for x in (row["lang"], min(1.0, 1.5 * docs_each / row["count"]))])
    spot = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.greatest(F.lit(1), F.length("text") - size + 1)).cast("int") + 1
    rows = known.where(pick < rates[F.col("lang")]).select("lang", F.substring("text", spot, F.lit(size)).alias("text"), pick.alias("pick"), "doc_id")
    seen: dict[str, int] = {}
    texts, labels = [], []
    for row in rows.orderBy("pick", "doc_id").limit(2 * docs_each * len(counts)).collect():
        if seen.setdefault(row["lang"], 0) < docs_each:
            seen[row["lang"]] += 1
            texts.append(row["text"].encode()[:size])
            labels.append(row["lang"])
    return texts, labels


def fit(docs: DataFrame, **options) -> Network:
    """Trains on the bounded sample of the documents that are not held out."""
    return train(*training_rows(docs), **options)


def judged(net: Network, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Language, score and foreign of each whole text; see ``identify``."""
    good = [bool(net.labels and x and _LETTER.search(x)) for x in texts]
    p = predict(net, [x.encode() if ok else b"" for x, ok in zip(texts, good)])
    best = p[:, :-1].argmax(1) if net.labels else [0] * len(texts)
    lang = [net.labels[k] if ok else UNKNOWN for k, ok in zip(best, good)]
    score = [min(1.0, float(row[k])) if ok else 0.0 for row, k, ok in zip(p, best, good)]
    return lang, score, [min(1.0, float(row[-1])) if ok else 1.0 for row, ok in zip(p, good)]


def identify(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and foreign to ``docs``; columns of those names are replaced, all others kept.

    Null texts and texts without a letter are ``und`` with score 0 and foreign 1, as are all texts
    where the network has learned no language. Repeated rows get the same prediction. The score is
    the mean probability of the predicted language over all bytes, foreign that of none of them over
    the bytes in words.
    """
    added = ["lang_pred", "score", "foreign"]
    docs = docs.drop(*added)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("foreign", T.DoubleType())])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            lang, score, foreign = judged(net, batch.column(names.index(text)).to_pylist())
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(foreign, pa.float64())], [*names, *added])

        return work

    return map_batches(docs, make, schema)


def in_languages(docs: DataFrame, net: Network, languages: Collection[str] | None = None, foreign_at: float = FOREIGN_AT, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is in no learned language, or in none of ``languages``.

    A row goes where the network gives no language the mean probability ``foreign_at`` or more over
    its words, where its predicted language isn't wanted, and where its text is null or letterless.
    Columns are kept as they are.
    """
    wanted = set(net.labels if languages is None else languages)

    def make(at=docs.columns.index(text)):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            lang, _, foreign = judged(net, batch.column(at).to_pylist())
            return batch.filter(pa.array([x in wanted and f < foreign_at for x, f in zip(lang, foreign)], pa.bool_()))

        return work

    return map_batches(docs, make, docs.schema)
