"""Word-level language labels for code-switched text by a linear-chain conditional random field.

A word's score for a language is the sum of learned weights of its prefixes and suffixes of one to
four bytes, its byte trigrams, the word itself and the languages whose lexicon (most frequent words)
holds it; learned transitions score neighbouring labels. Labels are the languages of the ``lang``
column. Training maximises the likelihood of made code-switched sequences, runs of words from labelled
documents of different languages, by AdaGrad, gradients from forward-backward. The training
sample is TRAIN_DOCS documents of each language, the least hashes of doc_id: a bound on the fit of
the classifier alone; labelling covers every word of every text.

Labelling takes the highest posterior marginal of each word by forward-backward, exactly, over whole
texts. All texts of a chunk form one chain (a text's first word forgets what was before), cut
into blocks whose transfer matrices are multiplied side by side, so numpy steps go over hundreds of
blocks at once and a text of any length costs the same per word. The weights (1 MB for each label)
are broadcast. There may be any number of labels: lexicon membership is a row of words of 62 bits.
Words of many labels are handled in smaller chunks. One pass, no shuffle.

Defined cases: null, empty and wordless texts have no words, no language and no spans; a null or
empty lang is no label and never trained on; with fewer than two labels every word gets the only one
(or none); labels that tie go to the first in order; texts are labelled whole whatever their length; rows that
repeat are each labelled, and count once in the sample; an empty table gives an empty result; extra columns are
not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Slices, chunks, lean, lowered, mix, read, small, string_buffer, word_spans

TRAIN_DOCS = 150
LEXICON = 1500
BITS = 18
SEQUENCES = 3000
EPOCHS = 4
#: Words of a made sequence, and of a run of one language in it.
SEQUENCE_WORDS, RUN = 48, (3, 14)
RATE, DECAY = 0.15, 1e-6
AFFIX = 4
#: Labels of a word of lexicon membership; bytes of text handled at once with up to CHUNK_LABELS labels.
MEMBERS = 62
CHUNK, CHUNK_LABELS = 1 << 20, 16


class Model:
    """Weights (rows x labels), transition scores, start scores and lexica."""

    def __init__(self, labels: list[str], lexicon: tuple[np.ndarray, np.ndarray]):
        self.labels = labels
        n = len(labels)
        self.words, self.sets = lexicon  # sorted word hashes, bit sets of labels (words x label words)
        self.weights = np.zeros(((1 << BITS) + n + 1, n), np.float32)
        self.next = np.zeros((n, n))
        self.first = np.zeros(n)


def features(part: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray, sets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of each word (words x 2 * AFFIX + 1 + n), row of the trigram at each byte, first and last
    trigram byte of each word as (start, end))."""
    top = np.uint64(64 - BITS)
    sl = Slices(part)
    size = end - start
    cols = []
    for k in range(1, AFFIX + 1):
        cut = np.minimum(k, size)
        cols.append((mix(sl(start, start + cut) + np.uint64(2 * k)) >> top).astype(np.int32))
        cols.append((mix(sl(end - cut, end) + np.uint64(2 * k + 1)) >> top).astype(np.int32))
    whole = sl(start, end)
    cols.append((mix(whole + np.uint64(99)) >> top).astype(np.int32))
    none = np.int32((1 << BITS) + n)
    if len(words):
        at = np.minimum(np.searchsorted(words, whole), len(words) - 1)
        held = np.where((words[at] == whole)[:, None], sets[at], 0)
    else:
        held = np.zeros((len(whole), -(-n // MEMBERS)), np.int64)
    for k in range(n):
        cols.append(np.where(held[:, k // MEMBERS] >> k % MEMBERS & 1, np.int32((1 << BITS) + k), none))
    # trigrams; what is outside the word counts as one blank
    code = part.astype(np.uint32)
    left = np.concatenate([[0], code[:-1]]).astype(np.uint32)
    right = np.concatenate([code[1:], [0]]).astype(np.uint32)
    left[start] = 0
    right[end - 1] = 0
    key = left << 16 | code << 8 | right
    tri = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> top).astype(np.int32)
    return np.stack(cols, axis=1), tri, size


def scores(m: Model, part: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Word scores (words x labels)."""
    rows, tri, _ = features(part, start, end, m.words, m.sets, len(m.labels))
    out = np.zeros((len(start), len(m.labels)), np.float32)
    for k in range(rows.shape[1]):
        out += m.weights[rows[:, k]]
    if len(start):
        at = np.stack([start, end], axis=1).ravel()
        body = np.concatenate([tri, [0]])
        out += np.add.reduceat(m.weights[body], at, axis=0)[::2]
    return out


def chain(score: np.ndarray, first: np.ndarray, follow: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Posterior marginals of every word. ``begin`` marks words that start a text."""
    n, k = score.shape
    if not n:
        return np.zeros((0, k))
    e = np.exp(score.astype(np.float64) - score.max(axis=1, keepdims=True))
    a, s = np.exp(follow - follow.max()), np.exp(first - first.max())
    length = max(1, int(np.sqrt(n)))
    blocks = -(-n // length)
    pad = blocks * length - n
    e = np.concatenate([e, np.ones((pad, k))]).reshape(blocks, length, k)
    b = np.concatenate([begin, np.ones(pad, bool)]).reshape(blocks, length)
    b[0, 0] = True

    def forward(v: np.ndarray, t: int) -> np.ndarray:
        """Rows ``v`` (blocks x m x labels) through word ``t`` of every block."""
        w = np.where(b[:, t, None, None], v.sum(axis=2, keepdims=True) * s, v @ a) * e[:, t, None, :]
        return w / np.maximum(w.sum(axis=(1, 2), keepdims=True), 1e-300)

    p = np.broadcast_to(np.eye(k), (blocks, k, k))
    for t in range(length):
        p = forward(p, t)
    enter = np.empty((blocks, k))
    leave = np.empty((blocks, k))
    x = np.ones(k) / k
    for i in range(blocks):
        enter[i] = x
        x = x @ p[i]
        x /= x.sum()
    x = np.ones(k)
    for i in range(blocks - 1, -1, -1):
        leave[i] = x
        x = p[i] @ x
        x /= x.sum()
    alpha = np.empty((length, blocks, k))
    v = enter[:, None, :]
    for t in range(length):
        v = forward(v, t)
        alpha[t] = v[:, 0]
    beta = leave
    post = np.empty((length, blocks, k))
    for t in range(length - 1, -1, -1):
        post[t] = alpha[t] * beta
        eb = e[:, t] * beta
        beta = np.where(b[:, t, None], (eb @ s)[:, None], eb @ a.T)
        beta = beta / np.maximum(beta.sum(axis=1, keepdims=True), 1e-300)
    post = post.transpose(1, 0, 2).reshape(-1, k)[:n]
    return post / post.sum(axis=1, keepdims=True)


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, text) of the bounded training sample."""
    some = docs.where("lang <> '' AND text IS NOT NULL AND doc_id IS NOT NULL").select("lang", "doc_id")
    # repeated rows have one rank; the ranks are cut in each input partition before the shuffle
    w = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = some.withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= TRAIN_DOCS).select("doc_id").distinct()
    rows = docs.where("lang <> '' AND text IS NOT NULL").join(small(ids, "langid-sample"), "doc_id", "left_semi").select("lang", "doc_id", "text").collect()
    return [(r[0], r[2]) for r in sorted(rows, key=lambda r: (r[0], r[1], r[2]))]


def sequences(texts: list[tuple[str, str]], labels: list[str], count: int, seed: int = 7) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """Made code-switched sequences: words (lower-case bytes) and labels."""
    rng = np.random.default_rng(seed)
    by: list[list[list[bytes]]] = [[] for _ in labels]
    for lang, text in texts:
        raw = np.frombuffer((text.lower() + "\n").encode(), np.uint8)
        s, e = word_spans(raw)
        body = raw.tobytes()
        w = [body[i:j] for i, j in zip(s.tolist(), e.tolist())]
        if w:
            by[labels.index(lang)].append(w)
    held = [i for i, d in enumerate(by) if d]
    words, gold = [], []
    for _ in range(count):
        seq: list[bytes] = []
        lab: list[int] = []
        mono = rng.random() < 0.5
        lang = held[rng.integers(len(held))]
        while len(seq) < SEQUENCE_WORDS:
            doc = by[lang][rng.integers(len(by[lang]))]
            n = min(len(doc), SEQUENCE_WORDS if mono else int(rng.integers(*RUN)))
            at = int(rng.integers(len(doc) - n + 1))
            seq += doc[at : at + n]
            lab += [lang] * n
            if not mono:
                lang = held[rng.integers(len(held))]
        words.append(seq[:SEQUENCE_WORDS])
        gold.append(np.array(lab[:SEQUENCE_WORDS]))
    return words, gold


def lexica(texts: list[tuple[str, str]], labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of each language's most frequent words, and the languages of each as rows of bits."""
    sets: dict[int, list[int]] = {}
    for k, lang in enumerate(labels):
        hs = []
        for x, text in texts:
            if x == lang:
                raw = np.frombuffer((text.lower() + "\n").encode(), np.uint8)
                hs.append(Slices(raw)(*word_spans(raw)))
        if hs:
            h, n = np.unique(np.concatenate(hs), return_counts=True)
            for v in h[np.lexsort((h, -n))[:LEXICON]].tolist():
                sets.setdefault(v, []).append(k)
    keys = np.array(sorted(sets), np.uint64)
    bits = np.zeros((len(keys), -(-len(labels) // MEMBERS)), np.int64)
    for i, v in enumerate(sorted(sets)):
        for k in sets[v]:
            bits[i, k // MEMBERS] |= 1 << k % MEMBERS
    return keys, bits


def _flat(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    body = b" ".join(w for seq in words for w in seq) + b"\n"
    size = np.array([len(w) for seq in words for w in seq])
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    return np.frombuffer(body, np.uint8), start, start + size


def train(texts: list[tuple[str, str]]) -> Model:
    """The model of labelled texts; the same for the same texts."""
    labels = sorted({x for x, _ in texts})
    m = Model(labels, lexica(texts, labels))
    k = len(labels)
    if k < 2:
        return m
    words, gold = sequences(texts, labels, max(SEQUENCES, 40 * k))
    part, start, end = _flat(words)
    rows, tri, size = features(part, start, end, m.words, m.sets, k)
    t = SEQUENCE_WORDS
    rows = rows.reshape(len(words), t, -1)
    y = np.stack(gold)
    start, end = start.reshape(-1, t), end.reshape(-1, t)
    grad2 = np.full(m.weights.shape, 1e-6, np.float32)
    g_next, g_first = np.full((k, k), 1e-6), np.full(k, 1e-6)
    rng = np.random.default_rng(11)
    one = np.eye(k)
    for _ in range(EPOCHS):
        order = rng.permutation(len(words))
        for at in range(0, len(order), 50):
            b = order[at : at + 50]
            r = rows[b]
            pos = [np.concatenate([np.arange(i, j) for i, j in zip(start[x], end[x])]) for x in b]
            owner = np.concatenate([np.repeat(np.arange(t), end[x] - start[x]) + i * t for i, x in enumerate(b)])
            g = tri[np.concatenate(pos)]
            score = m.weights[r].sum(axis=2).reshape(-1, k).astype(np.float64)
            np.add.at(score, owner, m.weights[g])
            score = score.reshape(len(b), t, k)
            # forward-backward in the log domain over the batch
            lse = lambda z, ax: np.log(np.exp(z - z.max(axis=ax, keepdims=True)).sum(axis=ax)) + z.max(axis=ax)
            f = np.empty_like(score)
            f[:, 0] = m.first + score[:, 0]
            for i in range(1, t):
                f[:, i] = lse(f[:, i - 1, :, None] + m.next, 1) + score[:, i]
            back = np.zeros_like(score)
            for i in range(t - 2, -1, -1):
                back[:, i] = lse(m.next + (score[:, i + 1] + back[:, i + 1])[:, None, :], 2)
            z = lse(f[:, -1], 1)
            mar = np.exp(f + back - z[:, None, None])
            pair = np.exp(f[:, :-1, :, None] + m.next + (score + back)[:, 1:, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
            real = np.zeros((k, k))
            np.add.at(real, (y[b][:, :-1].ravel(), y[b][:, 1:].ravel()), 1)
            d = ((one[y[b]] - mar) / len(b)).reshape(-1, k).astype(np.float32)
            ids = np.concatenate([r.reshape(-1), g])
            step = np.concatenate([np.repeat(d, r.shape[2], axis=0), d[owner]])
            uniq, inv = np.unique(ids, return_inverse=True)
            total = np.zeros((len(uniq), k), np.float32)
            np.add.at(total, inv, step)
            total -= DECAY * m.weights[uniq]
            grad2[uniq] += total**2
            m.weights[uniq] += RATE * total / np.sqrt(grad2[uniq])
            m.weights[-1] = 0
            gn, gf = (real - pair) / len(b), (one[y[b][:, 0]] - mar[:, 0]).mean(axis=0)
            g_next += gn**2
            g_first += gf**2
            m.next += RATE * gn / np.sqrt(g_next)
            m.first += RATE * gf / np.sqrt(g_first)
    return m


def label(m: Model, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, label) of every word of consecutive lowered texts."""
    part = data[off[0] : off[-1]]
    start, end = word_spans(part)
    doc = np.searchsorted(off - off[0], start, "right") - 1
    if not len(start) or not m.labels:
        return doc[:0], doc[:0]
    begin = np.ones(len(doc), bool)
    begin[1:] = doc[1:] != doc[:-1]
    if len(m.labels) == 1:
        return doc, np.zeros(len(doc), np.int64)
    return doc, chain(scores(m, part, start, end), m.first, m.next, begin).argmax(axis=1)


def summed(m: Model, off: np.ndarray, data: np.ndarray) -> list[pa.Array]:
    """n_words, lang, share, n_switches, span_langs and span_words of consecutive lowered texts."""
    doc, lab = label(m, off, data)
    n, k = len(off) - 1, max(1, len(m.labels))
    count = np.zeros((n, k), np.int64)
    np.add.at(count, (doc, lab), 1)
    words = count.sum(axis=1)
    best = count.argmax(axis=1)
    none = words == 0
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lab[1:] != lab[:-1])
    at = np.flatnonzero(new)
    spans = np.bincount(doc[at], minlength=n)
    where = pa.array(np.concatenate([[0], np.cumsum(spans)]).astype(np.int32))
    names = pa.array(m.labels or [""], pa.string())
    share = np.where(none, 0, count.max(axis=1) * 10000 // np.maximum(words, 1))
    return [
        pa.array(words.astype(np.int32)),
        names.take(pa.array(best, mask=none)),
        pa.array(share.astype(np.int32), mask=none),
        pa.array(np.maximum(spans - 1, 0).astype(np.int32)),
        pa.ListArray.from_arrays(where, names.take(pa.array(lab[at]))),
        pa.ListArray.from_arrays(where, pa.array(np.diff(at, append=len(doc)).astype(np.int32))),
    ]


def labelled(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, lang, share, n_switches, span_langs, span_words): the runs of words of one
    language of every document, in order, its main language and that one's share of 10,000."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    names = ["doc_id", "n_words", "lang", "share", "n_switches", "span_langs", "span_words"]

    def run(batches):
        m = held.value
        for b in batches:
            off, data = string_buffer(b.column(1))
            for i, j in chunks(off, CHUNK * CHUNK_LABELS // max(CHUNK_LABELS, len(m.labels))):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *summed(m, off[i : j + 1], data)], names=names)

    given = docs.select("doc_id", lowered(F.col("text")).alias("low"))
    return given.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words int, lang string, share int, n_switches int, span_langs array<string>, span_words array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return labelled(docs, train(sample(docs)))
