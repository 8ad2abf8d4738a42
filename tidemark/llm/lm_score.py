"""Language-model scores of whole texts.

The model predicts subword ids. One causal self-attention layer reads a
window of ids and gives, for each place, the classes of the next id; an id
within its class follows the corpus counts. Classes of ids that begin a word
and of ids that continue one are apart, so the model gives proper
probabilities of words: the ids of the word, and then a beginning. A word's
probability is a mixture of that and of its add-one share of the corpus, as in
the base score.

What is learnt comes from the training rows, those whose crc32 of the doc_id
as text leaves another remainder than `held` modulo `folds`:

* counts of all words, and of all subword ids through them, in one shuffle;
* the attention weights, trained in numpy by Adam: a warm-up on a bounded
  sample of windows at the driver, then ROUNDS rounds in parallel over windows
  that cover every id of every training row, averaged after each. Windows are
  dealt by hash into groups of about GROUP_WINDOWS, so the weights do not
  depend on how the input is split;
* the classes of ids, by their neighbours in the windows of all training rows;
* the mixture weight, on all training rows: the scoring pass adds up each text
  under every candidate weight.

Scoring lays each text out in windows of WIDTH ids that overlap by
WIDTH - STRIDE; a place is scored once, in the window that has most before it.
All windows of a batch go through masked attention together. Texts never
share a window, so a score does not depend on other rows.

Words of any count: the frequent ones (count at least N / most_words, so at
most `most_words` of them) are broadcast; the counts of other words join by
word, per occurrence, and are mixed in there.

Words are runs of other than U+0020 and U+0009-U+000D, A-Z in lower case;
each text has one end token more. Null text is empty: one token. A null
doc_id counts as the text "" for the split. Repeated rows get equal results,
extra columns are ignored, an empty table gives no rows. Without training
rows V = N = 0, the base score is log10(1/(1)) per token and the model knows
only its prior.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, staged, text_of
from .encoders import encoder, multi_ranks
from .nptext import U64, Batch, chunks, mix

FOLDS, HELD = 7, 2
MOST_WORDS = 1 << 20
WIDTH, STRIDE, AT_ONCE, PART = 40, 32, 32, 64
DIM, CLASSES, FREQUENT = 24, 96, 4096
TALLY_WORDS, LEAST_STEPS = 600_000, 400
SAMPLE_WINDOWS, GROUP_WINDOWS, BLOCK_WINDOWS, ROUNDS, MERGERS = 6000, 1 << 16, 1 << 18, 2, 16
MIXTURES = tuple(k / 20 for k in range(1, 20))
END = -1  # stands for the end token until the vocabulary is known


# ---- words and ids -------------------------------------------------------------------------------------------------


def is_held(keys: list, folds: int, held: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if k is None else str(k).encode()) % folds == held for k in keys], bool)


def spaced(b: Batch, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words joined by single spaces, each with one before it."""
    size = ends - starts + 1
    at = np.cumsum(size) - size
    out = np.full(int(size.sum()), 32, np.uint8)
    take = np.ones(len(out), bool)
    take[at] = False
    step = np.repeat(starts - at - 1, size)
    out[take] = b.bytes[(np.arange(len(out)) + step)[take]]
    return out.tobytes()


def encode_words(path: str, b: Batch, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of the words one after another, and where each word's begin (and the end)."""
    enc, lengths, _ = encoder(path)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    raw = spaced(b, starts, ends)
    ids = np.asarray(enc.encode_to_numpy(raw.decode("utf-8", "replace"), disallowed_special=()), np.int64).astype(np.int32)
    begin = np.concatenate(([0], np.cumsum(lengths[ids], dtype=np.int64)))
    word = np.concatenate(([0], np.cumsum(ends - starts + 1)))
    if begin[-1] == word[-1]:
        at = np.searchsorted(begin, word)
        if (begin[at] == word).all():
            return ids, at
    # an unusual blank joined two words in one id: encode word by word
    each = [np.asarray(enc.encode_to_numpy(" " + b.string(s, e), disallowed_special=()), np.int64).astype(np.int32) for s, e in zip(starts, ends)]
    return np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))


# ---- the network ---------------------------------------------------------------------------------------------------


class Vocabulary:
    """Classes of ids, and the log share of each id within its class."""

    def __init__(self, id_counts: np.ndarray, ends: int, starts_word: np.ndarray, profile: np.ndarray | None, classes: int = CLASSES, frequent: int = FREQUENT, seed: int = 3):
        n = len(id_counts)
        self.end = n
        weight = np.append(id_counts, ends).astype(float) + 0.5
        begins = np.append(starts_word, True)
        order = np.argsort(-weight, kind="stable")
        half = (classes - 1) // 2
        self.cls = np.zeros(n + 1, np.int32)
        self.starting = classes - half  # classes below begin a word; the first is the end token's
        for flag, low, k in ((True, 1, classes - half - 1), (False, classes - half, half)):
            ids = order[(begins[order] == flag) & (order != n)]
            self.cls[ids] = low + self._group(ids, weight, profile, k, seed)
        self.classes = classes
        total = np.bincount(self.cls, weight, minlength=classes)
        self.within = (np.log(weight) - np.log(total[self.cls])).astype(np.float32)
        # frequent ids have vectors of their own, the others one per class; 0 is the blank before a text
        self.vector = (1 + min(frequent, n + 1) + self.cls).astype(np.int32)
        own = order[: min(frequent, n + 1)]
        self.vector[own] = 1 + np.arange(len(own))
        self.vectors = 1 + len(own) + classes
        self.share = np.log((total + 1e-6) / total.sum())

    @staticmethod
    def _group(ids: np.ndarray, weight: np.ndarray, profile: np.ndarray | None, k: int, seed: int) -> np.ndarray:
        """Groups of about equal mass by neighbourhood profile; ids without one by count alone."""
        mass = np.cumsum(weight[ids]) / weight[ids].sum()
        rough = np.minimum((mass * k).astype(int), k - 1)
        if profile is None or len(ids) <= k:
            return rough
        x = profile[ids]
        known = np.flatnonzero(x.any(axis=1))
        if len(known) <= k:
            return rough
        x = x[known]
        x /= x.sum(axis=1, keepdims=True)
        np.sqrt(x, out=x)
        w = weight[ids[known]] ** 0.75
        rng = np.random.default_rng(seed)
        centre = x[np.unique(np.concatenate((np.arange(k // 2), rng.choice(len(x), k, replace=False, p=w / w.sum()))))[:k]]
        for _ in range(12):
            to = (x @ centre.T - 0.5 * (centre**2).sum(axis=1)).argmax(axis=1)
            for c in range(len(centre)):
                if (to == c).any():
                    centre[c] = np.average(x[to == c], axis=0, weights=w[to == c])
        to = (x @ centre.T - 0.5 * (centre**2).sum(axis=1)).argmax(axis=1)
        out = np.full(len(ids), k - 1)
        out[known] = to
        rare = np.setdiff1d(np.arange(len(ids)), known)
        out[rare] = k - 1
        return out


def initial(v: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shape = {"e": (v.vectors, DIM), "p": (WIDTH, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "o": (DIM, DIM), "c": (DIM, v.classes), "r": (DIM, v.classes)}
    w = {n: rng.normal(0, 0.3 if n == "e" else DIM**-0.5, s).astype(np.float32) for n, s in shape.items()}
    w["p"] *= 0.3
    w["b"] = v.share.astype(np.float32)
    return w


SEEN = np.tri(WIDTH, dtype=np.float32)
MASK = np.where(np.arange(WIDTH)[None, :] <= np.arange(WIDTH)[:, None], 0, -1e9).astype(np.float32)


def by(m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """m @ w as one product of two matrices instead of one for each window."""
    return (m.reshape(-1, m.shape[-1]) @ w).reshape(*m.shape[:-1], w.shape[1])


def forward(w: dict[str, np.ndarray], x: np.ndarray, first: int):
    """Class scores of the ids after the places from `first` on. x: vector numbers (windows, WIDTH)."""
    h = w["e"][x] + w["p"]
    tail = h[:, first:]
    kv = by(h, np.concatenate((w["k"], w["v"]), axis=1))
    k, val = kv[..., :DIM], kv[..., DIM:]
    q = by(tail, w["q"] * np.float32(DIM**-0.5))
    a = q @ k.transpose(0, 2, 1)
    a += MASK[first:]
    a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(axis=2, keepdims=True)
    z = a @ val
    y = by(z, w["o"])
    y += tail
    np.tanh(y, out=y)
    logits = by(y, w["c"])
    logits += by(w["e"][x[:, first:]], w["r"])
    logits += w["b"]
    return logits, (h, tail, k, val, q, a, z, y)


def gradient(w: dict[str, np.ndarray], x: np.ndarray, first: int, target: np.ndarray, on: np.ndarray, many: int | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the places that count, and its gradient. many: by how many places to
    divide, for windows that are a part of a batch."""
    if first:
        target, on = (np.pad(m, ((0, 0), (first, 0))) for m in (target, on))
    g, back = {n: np.zeros_like(m) for n, m in w.items()}, np.empty((x.size, DIM), w["e"].dtype)
    loss = add_slopes(w, x, target, on, max(int(on.sum()) if many is None else many, 1), g, back, {})
    add_rows(g["e"], x.reshape(-1), back)
    return loss, g


def add_slopes(w: dict[str, np.ndarray], x: np.ndarray, target: np.ndarray, on: np.ndarray, many: int, g: dict[str, np.ndarray], to_ids: np.ndarray, room: dict[str, np.ndarray]) -> float:
    """The windows' part of the loss. Their part of the gradient is added to `g`; what falls on the vectors
    of ids goes to `to_ids` place by place, so that a batch adds it up once. room: arrays kept from part to part,
    as memory given back and asked for again costs as much as the products."""
    n, width = x.shape
    kind, at = w["e"].dtype, x.reshape(-1)

    def kept(name: str, *shape: int) -> np.ndarray:
        if name not in room or len(room[name]) < shape[0]:
            room[name] = np.empty(shape, kind)
        return room[name][: shape[0]]

    # the state after attention, the id's own vector, and a one for the bias
    own, state, h = w["e"].take(at, axis=0, out=kept("own", len(at), DIM), mode="clip"), kept("state", len(at), 2 * DIM + 1), kept("h", len(at), DIM)
    state[:, DIM : 2 * DIM], state[:, -1] = own, 1
    np.add(own.reshape(n, width, DIM), w["p"], out=h.reshape(n, width, DIM))
    sides = np.concatenate((w["q"] * np.float32(DIM**-0.5), w["k"], w["v"], np.zeros((DIM, 1), kind)), axis=1)
    three = np.matmul(h, sides, out=kept("three", len(at), 3 * DIM + 1)).reshape(n, width, 3 * DIM + 1)
    three[..., -1] = 1
    q, k, val = three[..., :DIM], three[..., DIM : 2 * DIM], three[..., 2 * DIM :]
    a = np.matmul(q, k.transpose(0, 2, 1), out=kept("a", n, width, width))
    if beyond(a):
        a += MASK
        a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    a *= SEEN
    z = np.matmul(a, val, out=kept("z", n, width, DIM + 1)).reshape(-1, DIM + 1)  # the last column has the sums, so `a` need not be divided by them
    part = 1 / z[:, DIM:]
    z = np.multiply(z[:, :DIM], part, out=own)
    y = np.matmul(z, w["o"], out=kept("y", len(at), DIM))
    y += h
    np.tanh(y, out=y)
    state[:, :DIM] = y
    out = np.concatenate((w["c"], w["r"], w["b"][None]))
    p = np.matmul(state, out, out=kept("p", len(at), out.shape[1]))
    if beyond(p):
        p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    sums, hit = p @ np.ones(p.shape[1], kind), np.arange(0, p.size, p.shape[1]) + target.reshape(-1)
    share = (on.reshape(-1) / many).astype(kind)
    flat = p.reshape(-1)
    loss = -float((np.log(flat.take(hit) / sums + kind.type(1e-30)) * share).sum())
    p *= (share / sums)[:, None]
    flat[hit] -= share
    dout = state.T @ p
    g["c"] += dout[:DIM]
    g["r"] += dout[DIM:-1]
    g["b"] += dout[-1]
    back = np.matmul(p, out[:-1].T, out=kept("back", len(at), 2 * DIM))
    y *= y
    dy = np.subtract(1, y, out=y)
    dy *= back[:, :DIM]
    g["o"] += z.T @ dy
    dz = kept("dz", n, width, DIM + 1)
    np.multiply(np.matmul(dy, w["o"].T, out=to_ids).reshape(n, width, DIM), part.reshape(n, width, 1), out=dz[..., :DIM])
    np.negative(np.einsum("nid,nid->ni", dz[..., :DIM], z.reshape(n, width, DIM)), out=dz[..., DIM])
    ds = np.matmul(dz, val.transpose(0, 2, 1), out=kept("ds", n, width, width))
    ds *= a
    dthree = kept("dthree", n, width, 3 * DIM)
    np.matmul(ds, k, out=dthree[..., :DIM])
    np.matmul(ds.transpose(0, 2, 1), q, out=dthree[..., DIM : 2 * DIM])
    np.matmul(a.transpose(0, 2, 1), dz[..., :DIM], out=dthree[..., 2 * DIM :])
    dthree = dthree.reshape(-1, 3 * DIM)
    dsides = h.T @ dthree
    g["q"] += dsides[:, :DIM] * np.float32(DIM**-0.5)
    g["k"] += dsides[:, DIM : 2 * DIM]
    g["v"] += dsides[:, 2 * DIM :]
    np.matmul(dthree, sides[:, :-1].T, out=to_ids)
    to_ids += dy
    g["p"] += to_ids.reshape(n, width, DIM).sum(axis=0)
    to_ids += back[:, DIM:]
    return loss


def add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds each row to the one of its number; over single cells, which numpy does faster than over rows."""
    np.add.at(out.reshape(-1), (at.astype(np.intp)[:, None] * DIM + np.arange(DIM)).reshape(-1), rows.reshape(-1))


def beyond(scores: np.ndarray, most: float = 60) -> bool:
    """Whether exponentials of the scores could overflow, or all those of a row vanish."""
    return max(scores.max(initial=0), -scores.min(initial=0)) > most


def train(w: dict[str, np.ndarray], windows: np.ndarray, v: Vocabulary, rate: float, passes: int, seed: int, batch: int = 128) -> tuple[dict[str, np.ndarray], float]:
    """Adam over windows of WIDTH + 1 ids (END closes a text, -2 is the blank before it)."""
    names = list(w)
    flat = np.concatenate([w[n].reshape(-1) for n in names])
    first, second, slope, room, t, losses = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat), np.empty_like(flat), 0, []
    w, g = ({n: part.reshape(w[n].shape) for n, part in zip(names, np.split(m, np.cumsum([w[n].size for n in names])[:-1]))} for m in (flat, slope))  # views of them
    to_ids, kept = np.empty((batch * WIDTH, DIM), flat.dtype), {}
    vector, cls = np.append(v.vector, (0, v.vector[v.end])), np.append(v.cls, (0, v.cls[v.end]))  # so that -2 and END find theirs at the end
    rng = np.random.default_rng(seed)
    steps = max(1, passes * ((len(windows) + batch - 1) // batch))
    for _ in range(passes):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), batch):
            ids = windows[order[lo : lo + batch]]
            x, target, on = vector[ids[:, :-1]], cls[ids[:, 1:]], ids[:, 1:] != -2
            many, loss = max(int(on.sum()), 1), 0.0
            slope[:] = 0
            for k in range(0, len(ids), PART):  # parts of a batch stay in the cache
                loss += add_slopes(w, x[k : k + PART], target[k : k + PART], on[k : k + PART], many, g, to_ids[k * WIDTH : min(k + PART, len(x)) * WIDTH], kept)
            add_rows(g["e"], x.reshape(-1), to_ids[: x.size])
            losses.append(loss)
            t += 1
            step = np.float32(rate * (1 - t / (steps + 1)) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t))
            first *= np.float32(0.9)
            first += np.multiply(slope, np.float32(0.1), out=room)
            second *= np.float32(0.99)
            slope *= slope
            second += np.multiply(slope, np.float32(0.01), out=slope)
            np.sqrt(second, out=room)
            room += np.float32(1e-6)
            np.divide(first, room, out=room)
            flat -= np.multiply(room, step, out=room)
    return w, float(np.mean(losses[-20:])) if losses else 0.0


def vectors(ids: np.ndarray, v: Vocabulary) -> np.ndarray:
    return np.where(ids == -2, 0, v.vector[np.where(ids < 0, v.end, ids)])


# ---- scoring -------------------------------------------------------------------------------------------------------


class Tables:
    """The weights laid out for scoring: what depends on one id is looked up."""

    def __init__(self, w: dict[str, np.ndarray], v: Vocabulary):
        kv, one = np.concatenate((w["k"], w["v"]), axis=1), lambda n, x: np.full((n, 1), x, np.float32)
        # the last column is one, so that the sums of the attention come with the values
        self.kv, self.kv_at = np.concatenate((w["e"] @ kv, one(v.vectors, 1)), axis=1), np.concatenate((w["p"] @ kv, one(WIDTH, 0)), axis=1)
        self.q, self.q_at = w["e"] @ w["q"] * np.float32(DIM**-0.5), w["p"] @ w["q"] * np.float32(DIM**-0.5)
        self.e, self.p, self.near, self.o, self.c = w["e"], w["p"], w["e"] @ w["r"] + w["b"], w["o"], w["c"]
        norm = lambda m: float(np.sqrt((m**2).sum(axis=1)).max(initial=0))
        self.steep = (norm(self.q) + norm(self.q_at)) * (norm(self.kv[:, :DIM]) + norm(self.kv_at[:, :DIM])) > 60
        self.high = float(np.abs(self.c).sum(axis=0).max() + np.abs(self.near).max()) > 60
        self.ones = np.ones(v.classes, np.float32)

    def scores(self, x: np.ndarray, first: int) -> np.ndarray:
        """The same as `forward`, rows flattened; scores are capped where their exponentials could overflow."""
        n, width = x.shape
        tail = x[:, first:]
        kv = self.kv.take(x, axis=0)
        kv += self.kv_at[:width]
        q = self.q.take(tail, axis=0)
        q += self.q_at[first:width]
        a = q @ kv[..., :DIM].transpose(0, 2, 1)
        if self.steep:
            np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        a *= SEEN[first:width, :width]
        z = a @ kv[..., DIM:]
        y = (z[..., :DIM] / z[..., DIM:]).reshape(-1, DIM) @ self.o
        own = self.e.take(tail, axis=0)
        own += self.p[first:width]
        y += own.reshape(-1, DIM)
        np.tanh(y, out=y)
        logits = y @ self.c
        logits += self.near.take(tail.reshape(-1), axis=0)
        if self.high:
            np.minimum(logits, 60, out=logits)
        return logits


def word_log_probs(tables: Tables, v: Vocabulary, ids: np.ndarray, at: np.ndarray, text_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural logs of the model's probability of each word, and of each text's end.

    ids: all subwords; at: where each word begins (and the end); text_words:
    the first word of each text (and the end).
    """
    texts = len(text_words) - 1
    begin = at[text_words[:-1]]
    own = at[text_words[1:]] - begin + 1  # with the end
    lead = WIDTH - STRIDE
    rows = -(-own // STRIDE)
    room = rows * STRIDE + lead + 1
    edge = np.concatenate(([0], np.cumsum(room)))
    flat = np.full(int(edge[-1]), -2, np.int32)
    home = edge[:-1] + lead + 1
    place = np.arange(len(ids)) + np.repeat(home - begin, own - 1)
    flat[place] = ids
    flat[home + own - 1] = v.end
    x = np.where(flat == -2, 0, v.vector[flat]).astype(np.int32)
    window = np.repeat(edge[:-1] - np.cumsum(rows) * STRIDE + rows * STRIDE, rows) + np.arange(int(rows.sum())) * STRIDE
    chosen, starting = np.zeros(len(flat), np.float32), np.zeros(len(flat), np.float32)
    cls = v.cls[np.where(flat < 0, v.end, flat)]
    # always AT_ONCE, the last ones filled up with one of them: products of one shape round alike, and stay in the cache
    window = np.concatenate((window, np.full(-len(window) % AT_ONCE, window[0]))) if len(window) else window
    for lo in range(0, len(window), AT_ONCE):
        s = window[lo : lo + AT_ONCE]
        logits = tables.scores(x[s[:, None] + np.arange(WIDTH)], lead)
        target = (s[:, None] + np.arange(lead + 1, WIDTH + 1)).reshape(-1)
        own_logit = logits.take(np.arange(0, logits.size, v.classes) + cls[target])
        np.exp(logits, out=logits)
        every, begun = (np.log(logits[:, :k] @ tables.ones[:k] + np.float32(1e-30)) for k in (v.classes, v.starting))
        chosen[target] = own_logit - every
        starting[target] = begun - every
    got = np.where(flat < 0, 0, chosen + v.within[np.where(flat < 0, v.end, flat)])
    ends = got[home + own - 1] - starting[home + own - 1]
    if not len(at) > 1:
        return np.zeros(0), ends.astype(float)
    head = place[at[:-1]]
    words = np.add.reduceat(got[place], at[:-1]).astype(float)
    return words - starting[head] + starting[place[at[1:] - 1] + 1], ends.astype(float)


class Model:
    """What a worker needs to score texts."""

    def __init__(self, path, vocabulary, weights, word_hash, word_count, word_ids, word_at, end_count, total, distinct):
        self.path, self.v, self.tables = path, vocabulary, Tables(weights, vocabulary)
        self.word_ids, self.word_at = word_ids, word_at
        self.word_hash, self.word_count, self.end_count, self.total, self.distinct = word_hash, word_count, end_count, total, distinct

    def parts(self, texts: list[str]):
        """Batch, words, their corpus counts where frequent (else 0), and log probabilities by attention."""
        b = Batch(texts, lower=True)
        starts, ends = b.words()
        owner = b.text_of(starts)
        h = b.hashes(starts, ends)
        row = np.full(len(h), -1)
        if len(self.word_hash) and len(h):
            i = np.minimum(np.searchsorted(self.word_hash, h), len(self.word_hash) - 1)
            row = np.where(self.word_hash[i] == h, i, -1)
        known = np.where(row >= 0, self.word_count[row], 0) if len(self.word_hash) else np.zeros(len(h), np.int64)
        ids, at = self.encoded(b, starts, ends, row)
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        logp, logend = word_log_probs(self.tables, self.v, ids, at, first)
        return b, starts, ends, owner, known, logp, logend

    def encoded(self, b: Batch, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and where each word's begin: frequent words from the table, only the others by the encoder."""
        new = np.flatnonzero(row < 0)
        fresh, fresh_at = encode_words(self.path, b, starts[new], ends[new])
        source = np.concatenate((self.word_ids, fresh))
        begin = np.empty(len(row), np.int64)
        size = np.empty(len(row), np.int64)
        old = np.flatnonzero(row >= 0)
        begin[old], size[old] = self.word_at[row[old]], self.word_at[row[old] + 1] - self.word_at[row[old]]
        begin[new], size[new] = len(self.word_ids) + fresh_at[:-1], np.diff(fresh_at)
        at = np.concatenate(([0], np.cumsum(size)))
        return source[np.arange(at[-1]) + np.repeat(begin - at[:-1], size)], at

    def mixed(self, count: np.ndarray, logp: np.ndarray):
        """Natural logs of the mixtures of a share of the corpus and the attention's probability, one array per weight."""
        p = np.exp(logp)
        apart = count / (self.total + self.distinct + 1) - p
        for x in MIXTURES:
            out = apart * x
            out += p
            yield np.log(out, out=out)


def best_mixture(scored: DataFrame, rare: DataFrame, floor: int) -> float:
    """The mixture weight under which all words of all training texts are most probable; each
    word's own occurrence is taken out of its count. Only sums per weight come back."""

    def run(batches):
        total = np.zeros(len(MIXTURES))
        for batch in batches:
            share, p = np.maximum(batch.column(0).to_numpy(), 1) / floor, np.exp(batch.column(1).to_numpy())
            total += [np.log(x * share + (1 - x) * p).sum() for x in MIXTURES]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(MIXTURES))), pa.array(total)], names=["k", "s"])

    often = scored.where("fit is not null").select(F.posexplode("fit").alias("k", "s")).select(F.col("k").cast("long"), "s")
    less = rare.where("not held_out").select("n", "p").mapInArrow(run, "k long, s double")
    sums = {r["k"]: r["s"] for r in often.unionByName(less).groupBy("k").agg(F.sum("s").alias("s")).collect()}
    return MIXTURES[max(sums, key=lambda k: (sums[k], -k))] if sums and any(sums.values()) else 0.5


# ---- the operator --------------------------------------------------------------------------------------------------


class Tally:
    """Words and their counts over many chunks of texts, up to a bound."""

    def __init__(self):
        self.h, self.n, self.words = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, b: Batch, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
        order = np.argsort(h)
        new = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]) != 0) if len(h) else np.zeros(0, np.int64)
        at, n, h = order[new], np.diff(np.append(new, len(h))), h[order[new]]
        i = np.searchsorted(self.h, h)
        old = np.zeros(len(h), bool)
        inside = i < len(self.h)
        old[inside] = self.h[i[inside]] == h[inside]
        self.n[i[old]] += n[old]
        fresh = ~old
        words = np.empty(int(fresh.sum()), object)
        words[:] = [b.string(s, e) for s, e in zip(starts[at[fresh]].tolist(), ends[at[fresh]].tolist())]
        self.h = np.insert(self.h, i[fresh], h[fresh])
        self.n = np.insert(self.n, i[fresh], n[fresh])
        self.words = np.insert(self.words, i[fresh], words)


def covering(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Windows of WIDTH + 1 ids over whole texts, in which each id and each text's end has
    one place to be predicted. at: where each text's ids begin (and the end)."""
    own = np.diff(at) + 1  # with the end
    rows = -(-own // WIDTH)
    edge = np.concatenate(([0], np.cumsum(rows * WIDTH + 1)))
    flat = np.full(int(edge[-1]), -2, np.int32)
    flat[np.arange(len(ids)) + np.repeat(edge[:-1] + 1 - at[:-1], own - 1)] = ids
    flat[edge[:-1] + own] = END
    first = np.repeat(edge[:-1] - (np.cumsum(rows) - rows) * WIDTH, rows) + np.arange(int(rows.sum())) * WIDTH
    return flat[first[:, None] + np.arange(WIDTH + 1)]


def gathered(words: list, counts: list, windows: np.ndarray, texts: int, deal: np.ndarray) -> pa.RecordBatch:
    n, k = len(words), len(windows)
    narrow = windows.astype(np.uint16)
    if not (unsigned(narrow) == windows).all():
        raise ValueError("a vocabulary of more than 65534 ids")
    raw = pa.array([*[None] * n, *[w.tobytes() for w in narrow], None], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([*words, *[None] * (k + 1)], pa.string()), pa.array([*counts, *[None] * k, texts], pa.int64()), raw, pa.array([*[None] * n, *deal.view(np.int64).tolist(), None], pa.int64())],
        names=["word", "n", "window", "deal"],
    )


def unsigned(narrow: np.ndarray) -> np.ndarray:
    """Ids of two bytes; the last two values are END and the blank before a text."""
    wide = narrow.astype(np.int32)
    return np.where(wide >= 65534, wide - 65536, wide)


def unpacked(windows: list[bytes]) -> np.ndarray:
    """Windows as written by `gathered`."""
    return unsigned(np.frombuffer(b"".join(windows), np.uint16)).reshape(-1, WIDTH + 1)


def dealt(windows: np.ndarray, texts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A hash of each window, its doc_id and its place in the text: what orders and groups the
    windows however the rows are split. texts: the text of each window; keys: a number of each text."""
    first = np.searchsorted(texts, texts)
    with np.errstate(over="ignore"):
        h = (windows.astype(np.int64).view(U64) * (np.arange(1, WIDTH + 2, dtype=U64) * U64(0x9E3779B97F4A7C15) | U64(1))).sum(axis=1)
        return mix(h + mix(keys[texts] + mix((np.arange(len(texts)) - first).astype(U64))))


def gather(docs: DataFrame, path: str, folds: int, held: int) -> DataFrame:
    """From training rows: (word, count) combined within a task as far as TALLY_WORDS allows,
    windows of ids that cover the texts, each with the hash it is dealt by, and the number of
    rows. Rows without doc_id are dealt by where they are read."""
    none, no_deal = np.zeros((0, WIDTH + 1), np.int32), np.zeros(0, U64)

    def run(batches):
        tally, row = Tally(), TaskContext.get().partitionId() << 33
        for batch in batches:
            train = np.flatnonzero(~is_held(batch.column(0).to_pylist(), folds, held))
            texts, own = batch.column(1).take(pa.array(train)).to_pylist(), batch.column(0).take(pa.array(train))
            keys = own.fill_null(0).to_numpy(zero_copy_only=False).view(U64).copy()
            nil = own.is_null().to_numpy(zero_copy_only=False)
            keys[nil] = mix(np.arange(row, row + int(nil.sum())).astype(U64))
            row += int(nil.sum())
            for lo, hi in chunks(texts):
                b = Batch(texts[lo:hi], lower=True)
                starts, ends = b.words()
                h = b.hashes(starts, ends)
                tally.add(b, starts, ends, h)
                _, one, word = np.unique(h, return_index=True, return_inverse=True)
                some, some_at = encode_words(path, b, starts[one], ends[one])
                size = np.diff(some_at)[word]
                at = np.concatenate(([0], np.cumsum(size)))
                ids = some[np.arange(at[-1]) + np.repeat(some_at[:-1][word] - at[:-1], size)]
                begin = at[np.searchsorted(b.text_of(starts), np.arange(hi - lo + 1))]
                windows = covering(ids, begin)
                of = np.repeat(np.arange(hi - lo), -(-(np.diff(begin) + 1) // WIDTH))
                yield gathered([], [], windows, hi - lo, dealt(windows, of, keys[lo:hi]))
                if len(tally.h) >= TALLY_WORDS:
                    yield gathered(tally.words.tolist(), tally.n.tolist(), none, 0, no_deal)
                    tally = Tally()
        yield gathered(tally.words.tolist(), tally.n.tolist(), none, 0, no_deal)

    return docs.mapInArrow(run, "word string, n long, window binary, deal long")


def id_counts(counts: DataFrame, path: str) -> np.ndarray:
    """Corpus counts of subword ids, from the counts of words."""
    size = len(encoder(path)[2])

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            b = Batch(words)
            ids, at = encode_words(path, b, b.starts, b.ends)
            total += np.bincount(ids, np.repeat(n, np.diff(at)), minlength=size).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    rows = counts.select("word", "n").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def profiles(windows: DataFrame, size: int, top: np.ndarray) -> np.ndarray:
    """How often each id stands next to each of some frequent ids, in all windows."""
    column = np.full(size + 2, -1, np.int32)  # the last two for END and the blank before a text
    column[top] = np.arange(len(top))
    wide = 2 * len(top)
    if size * wide > np.iinfo(np.int32).max:
        raise ValueError("too many neighbours for cells of four bytes")

    def run(batches):
        total = np.zeros(size * wide, np.int32)  # 100 MB for 50,000 ids and 256 neighbours, whatever the input
        seen = 0
        for batch in batches:
            w = unpacked(batch.column(0).to_pylist())
            seen += w.size
            near, row = column[w], np.where(w < 0, -wide, w * np.int32(wide))
            for shift in (1, 2):
                for of, by, base in ((row[:, shift:], near[:, :-shift], 0), (row[:, :-shift], near[:, shift:], len(top))):
                    cell = (of + by)[(of >= 0) & (by >= 0)]
                    cell += np.int32(base)
                    np.add.at(total, cell, np.int32(1))
            if seen > 1 << 28:  # before a count could overflow
                yield filled(total)
                total[:] = 0
                seen = 0
        yield filled(total)

    def filled(total: np.ndarray) -> pa.RecordBatch:
        cell = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell].astype(np.int64))], names=["cell", "n"])

    found = windows.select("window").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").cast("float").alias("n")).toArrow()
    out = np.zeros(size * wide, np.float32)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, wide)


def trained_round(windows: DataFrame, groups: int, w: dict[str, np.ndarray], v: Vocabulary, rate: float, seed: int) -> dict[str, np.ndarray]:
    """One pass over all windows, dealt by hash into groups that train in parallel, in blocks a
    task holds; weights averaged by number of windows."""
    spark = windows.sparkSession
    shared = spark.sparkContext.broadcast((w, v))
    names = sorted(w)
    sizes = [w[n].size for n in names]

    def fit(batches):
        w0, v0 = shared.value
        out, held, many = w0, [], 0
        for batch in batches:
            held.append(unpacked(batch.column(0).to_pylist()))
            many += len(held[-1])
            if sum(map(len, held)) >= BLOCK_WINDOWS:
                out, held = train(out, np.concatenate(held), v0, rate, 1, seed)[0], []
        if held:
            out, _ = train(out, np.concatenate(held), v0, rate, 1, seed)
        if many:
            flat = np.concatenate([out[n].reshape(-1) for n in names]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % MERGERS], pa.int32()), pa.array([many], pa.int64()), pa.array([flat], pa.list_(pa.float32()))], names=["slot", "n", "w"])

    def merge(batches):
        total, n = None, 0
        for batch in batches:
            for k in range(len(batch)):
                flat = batch.column(2)[k].values.to_numpy().astype(float)
                m = batch.column(1)[k].as_py()
                total, n = (flat * m if total is None else total + flat * m), n + m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32)], pa.list_(pa.float32()))], names=["slot", "n", "w"])

    schema = "slot int, n long, w array<float>"
    groups_of = windows.repartition(groups, "deal").sortWithinPartitions("deal").select("window")
    made = groups_of.mapInArrow(fit, schema).repartition(MERGERS, "slot").mapInArrow(merge, schema).toArrow().to_pylist()
    if not made:
        return w
    flat = sum(np.array(r["w"], float) * r["n"] for r in made) / sum(r["n"] for r in made)
    return {n: part.reshape(w[n].shape).astype(np.float32) for n, part in zip(names, np.split(flat, np.cumsum(sizes)[:-1]))}


def learn(docs: DataFrame, path: str, folds: int, held: int, most_words: int) -> tuple[Model, DataFrame, int, int]:
    """The model, the counts of all training words, N and V. docs: doc_id, text."""
    spark = docs.sparkSession
    found = staged(gather(docs, path, folds, held), "gathered")
    counts = staged(found.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    tally = counts.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    ends = found.where("word is null and window is null").agg(F.sum("n").alias("n")).first()["n"] or 0
    total, distinct = (tally["n"] or 0) + ends, tally["v"] + (ends > 0)
    often = counts.where(F.col("n") * F.lit(most_words) >= F.lit(total)).toPandas()  # at most most_words rows
    words = often["word"].tolist()
    h = hash_words(words)
    order = np.argsort(h)
    b = Batch([words[i] for i in order])
    word_ids, word_at = encode_words(path, b, b.starts, b.ends)
    ids = id_counts(counts, path)
    windows = found.where("window is not null").select("window", "deal")
    groups = -(-windows.count() // GROUP_WINDOWS)
    sample = unpacked(windows.orderBy("deal").limit(SAMPLE_WINDOWS).toPandas()["window"].tolist())
    begins = np.array([t[:1] == b" " for t in encoder(path)[2]])
    top = np.argsort(-ids, kind="stable")[:256]
    v = Vocabulary(ids, ends, begins, profiles(windows, len(ids), top) if len(sample) else None)
    w = initial(v)
    if len(sample):
        w, _ = train(w, sample, v, 0.01, max(3, -(-LEAST_STEPS * 64 // len(sample))), 11, batch=64)
        for k in range(ROUNDS):
            w = trained_round(windows, groups, w, v, 0.004 / (k + 1), 100 + k)
    model = Model(path, v, w, h[order], often["n"].to_numpy(np.int64)[order], word_ids, word_at, ends, total, distinct)
    return model, counts, total, distinct


def hash_words(words: list[str]) -> np.ndarray:
    b = Batch(words)
    return b.hashes(b.starts, b.ends) if words else np.zeros(0, U64)


def lm_score(docs: DataFrame, ranks_path: str | None = None, folds: int = FOLDS, held: int = HELD, most_words: int = MOST_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigrams) and score (the model), both log10 of the whole text."""
    spark = docs.sparkSession
    ready(spark)
    path = ranks_path or multi_ranks()
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    model, counts, total, distinct = learn(rows, path, folds, held, most_words)
    shared = spark.sparkContext.broadcast(model)
    floor = np.log10(total + distinct + 1)

    def score(batches):
        m, part, k = shared.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            out = is_held(keys, folds, held)
            n, known_n, base, value, fit, rare, rare_p, edges = [], [], [], [], np.zeros(len(MIXTURES)), [], [], []
            for lo, hi in chunks(texts):
                size = hi - lo
                b, starts, ends, owner, known, logp, logend = m.parts(texts[lo:hi])
                tokens = np.bincount(owner, minlength=size) + 1
                n.append(tokens)
                known_n.append(np.bincount(owner, known > 0, minlength=size).astype(np.int64) + (m.end_count > 0))
                often = known > 0
                base.append(np.bincount(owner[often], np.log10(known[often] + 1.0) - floor, minlength=size) + (np.log10(m.end_count + 1.0) - floor))
                words, ending = m.mixed(known[often] + 1, logp[often]), m.mixed(np.full(size, m.end_count + 1), logend)
                value.append(np.stack([np.bincount(owner[often], w, minlength=size) + e for w, e in zip(words, ending)], axis=1) / np.log(10))
                often &= ~out[lo:hi][owner]
                fit += [w.sum() for w in m.mixed(known[often], logp[often])]
                some = np.flatnonzero(known == 0)
                raw = b.bytes.tobytes()
                rare += [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[some].tolist(), ends[some].tolist())]
                rare_p.append(logp[some])
                edges.append(np.bincount(owner[some], minlength=size))
            rid = [(part << 33) + k + i for i in range(len(texts))]
            k += len(texts)
            join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(edges) if edges else np.zeros(0, np.int64)))), pa.int32())
            listed = lambda x, t, offsets=offsets: pa.ListArray.from_arrays(offsets, pa.array(x, t))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid, pa.int64()), pa.array(keys, pa.int64()), pa.array(out), join(n, pa.int64()), join(known_n, pa.int64()), join(base, pa.float64()), pa.array(list(np.concatenate(value)) if value else [], pa.list_(pa.float64())), pa.array([fit] + [None] * (len(texts) - 1) if texts else [], pa.list_(pa.float64())), listed(rare, pa.string()), listed(np.concatenate(rare_p) if rare_p else [], pa.float64())],
                names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "values", "fit", "rare", "rare_p"],
            )

    scored = staged(rows.mapInArrow(score, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, values array<double>, fit array<double>, rare array<string>, rare_p array<double>"), "scored")
    rare = scored.select("rid", "held_out", F.explode(F.arrays_zip("rare", "rare_p")).alias("r")).select("rid", "held_out", F.col("r.rare").alias("word"), F.col("r.rare_p").alias("p"))
    less = counts.where(F.col("n") * F.lit(most_words) < F.lit(total))
    rare = staged(rare.join(less, "word", "left").select("rid", "held_out", F.coalesce("n", F.lit(0)).alias("n"), "p"), "rare")
    mixture = best_mixture(scored, rare, total + distinct + 1)
    n = F.col("n")
    mixed = F.log10(F.lit(mixture) * (n + 1) / F.lit(float(total + distinct + 1)) + F.lit(1 - mixture) * F.exp("p"))
    rest = rare.groupBy("rid").agg(F.count_if(n > 0).alias("more"), F.sum(F.log10(n + 1.0) - F.lit(float(floor))).alias("add"), F.sum(mixed).alias("value"))
    out = scored.drop("rare", "rare_p", "fit").join(rest, "rid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("add", F.lit(0.0))).alias("base_score"), (F.col("values")[MIXTURES.index(mixture)] + F.coalesce("value", F.lit(0.0))).alias("score"),
    )
