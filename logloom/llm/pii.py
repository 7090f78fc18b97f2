"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions.

The model tags every character of a window O, or B/I of a kind. It is trained here, in numpy, on labelled spans (the base
patterns' spans of a bounded sample, with the same texts as negatives elsewhere). At scoring, each text is covered by
overlapping windows of fixed place; every window is decoded (Viterbi over the CRF) and windows are reconciled over the
whole text: in an overlap a span comes from the window in which it lies further from an edge, touching parts of one kind
are joined, and spans that overlap an earlier kept one of the same kind (base spans first) are dropped.

Every kind of span holds a digit or an ``@``; a decoded span without one is discarded. A window without any such character
can therefore add nothing and is not decoded: the result is the same as decoding all of them.

All work is per document, in one pass without a shuffle. Null or empty text has no spans. Texts of any length are read
whole, in linear time. Rows repeat freely; a null id is kept. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import batches_of, filled, pick

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 128, 64
HIDDEN = 16
TAGS = 1 + 2 * len(KINDS)
MARKS = re.compile(r"[0-9@]")
ROWS = 2000
SCHEMA = "doc_id bigint, base array<struct<kind:string,start:bigint,stop:bigint>>, found array<struct<kind:string,start:bigint,stop:bigint>>"

# --- base patterns -------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]  # kind, start, stop


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run of local characters before each ``@`` that a domain follows."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            done = match.end()
            out.append((start, done))
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then start."""
    if not MARKS.search(text):
        return []
    out: list[Span] = [(0, a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


# --- model ---------------------------------------------------------------------------------------------

def character_classes(codes: np.ndarray) -> np.ndarray:
    """0: outside a window; ASCII by itself; all other letters and signs share one class."""
    return np.where(codes < 0, 0, np.where(codes < 128, codes + 1, 129)).astype(np.int64)


CLASSES = 130


@dataclass
class Tagger:
    """For each direction: input table (class to 4 gates), recurrent matrix; then tag weights, tag bias, transitions."""
    table: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.recurrent, self.out, self.bias, self.moves]


def fresh(hidden: int, seed: int) -> Tagger:
    rng = np.random.default_rng(seed)
    tables = []
    for _ in range(2):
        t = rng.normal(0, 0.3, (CLASSES, 4 * hidden))
        t[:, hidden:2 * hidden] += 1.0  # forget gates start open
        tables.append(t.astype(np.float32))
    return Tagger(tables, [rng.normal(0, 0.2, (hidden, 4 * hidden)).astype(np.float32) for _ in range(2)],
                  rng.normal(0, 0.2, (2 * hidden, TAGS)).astype(np.float32), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def run_direction(classes: np.ndarray, table: np.ndarray, recurrent: np.ndarray, keep: bool):
    """Hidden states (length, batch, hidden) of one direction; with ``keep`` also what the gradient needs."""
    hidden = recurrent.shape[0]
    length, batch = classes.shape
    h, c = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
    states, saved = np.empty((length, batch, hidden), np.float32), []
    for t in range(length):
        z = table[classes[t]] + h @ recurrent
        gates = sigmoid(z[:, :3 * hidden])
        fresh_ = np.tanh(z[:, 3 * hidden:])
        i, f, o = gates[:, :hidden], gates[:, hidden:2 * hidden], gates[:, 2 * hidden:]
        before = c
        c = f * c + i * fresh_
        squashed = np.tanh(c)
        if keep:
            saved.append((i, f, o, fresh_, before, squashed, h))
        h = o * squashed
        states[t] = h
    return states, saved


def back_direction(classes: np.ndarray, recurrent: np.ndarray, saved: list, grad: np.ndarray):
    hidden = recurrent.shape[0]
    d_table, d_recurrent = np.zeros((CLASSES, 4 * hidden), np.float32), np.zeros_like(recurrent)
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    for t in range(len(saved) - 1, -1, -1):
        i, f, o, fresh_, before, squashed, h_before = saved[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - squashed ** 2)
        dz = np.concatenate([dc * fresh_ * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - fresh_ ** 2)], axis=1)
        np.add.at(d_table, classes[t], dz)
        d_recurrent += h_before.T @ dz
        dh, dc = dz @ recurrent.T, dc * f
    return d_table, d_recurrent


def emissions(model: Tagger, classes: np.ndarray, keep: bool = False):
    """Tag scores (length, batch, tags) of windows given as (length, batch) classes."""
    ahead, saved_a = run_direction(classes, model.table[0], model.recurrent[0], keep)
    back, saved_b = run_direction(classes[::-1], model.table[1], model.recurrent[1], keep)
    both = np.concatenate([ahead, back[::-1]], axis=2)
    return both @ model.out + model.bias, both, (saved_a, saved_b)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def crf_gradient(scores: np.ndarray, moves: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the gold paths, and its gradients."""
    length, batch, tags = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0]
    for t in range(1, length):
        alpha[t] = scores[t] + log_sum(alpha[t - 1][:, :, None] + moves[None], 1)
    for t in range(length - 2, -1, -1):
        beta[t] = log_sum(moves[None] + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    total = log_sum(alpha[-1], 1)
    grad = np.exp(alpha + beta - total[None, :, None])
    d_moves = np.zeros_like(moves)
    for t in range(1, length):
        d_moves += np.exp(alpha[t - 1][:, :, None] + moves[None] + (scores[t] + beta[t])[:, None, :] - total[:, None, None]).sum(axis=0)
    which = np.arange(batch)
    path = scores[0, which, gold[0]].copy()
    grad[0, which, gold[0]] -= 1
    for t in range(1, length):
        path += scores[t, which, gold[t]] + moves[gold[t - 1], gold[t]]
        grad[t, which, gold[t]] -= 1
        np.add.at(d_moves, (gold[t - 1], gold[t]), -1)
    return float((total - path).mean()), grad / batch, d_moves / batch


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tag path of each window: (length, batch)."""
    length, batch, tags = scores.shape
    best, back = scores[0], np.empty((length, batch, tags), np.int8)
    for t in range(1, length):
        step = best[:, :, None] + moves[None]
        back[t] = step.argmax(axis=1)
        best = step.max(axis=1) + scores[t]
    path = np.empty((length, batch), np.int64)
    path[-1] = best.argmax(axis=1)
    for t in range(length - 1, 0, -1):
        path[t - 1] = back[t, np.arange(batch), path[t]]
    return path


def allowed(moves: np.ndarray) -> np.ndarray:
    """Transitions with I only after B or I of its kind."""
    out = moves.copy()
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        for tag in range(TAGS):
            if tag not in (inside, inside - 1):
                out[tag, inside] = -1e4
    return out


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        tags[a:b] = 2 + 2 * kind
        tags[a] = 1 + 2 * kind
    return tags


def train(texts: list[str], labelled: list[list[Span]], hidden: int = HIDDEN, steps: int = 450, batch: int = 32, seed: int = 5, rate: float = 0.015) -> Tagger:
    """Fit on the windows that hold a digit or ``@``; spans cut by a window's edge are labelled up to the edge."""
    rng = np.random.default_rng(seed)
    model = fresh(hidden, seed)
    inputs, golds = [], []
    for text, spans in zip(texts, labelled):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        tags = tags_of(len(codes), spans)
        for a in starts_of(text):
            part, gold = np.full(WINDOW, -1, np.int64), np.zeros(WINDOW, np.int64)
            piece = codes[a:a + WINDOW]
            part[:len(piece)], gold[:len(piece)] = piece, tags[a:a + WINDOW]
            if gold[0] and gold[0] % 2 == 0:
                gold[0] -= 1
            inputs.append(character_classes(part))
            golds.append(gold)
    if not inputs:
        return model
    x, y = np.array(inputs).T, np.array(golds).T
    parameters = model.parameters()
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    order, at = rng.permutation(x.shape[1]), 0
    for step in range(1, steps + 1):
        if at >= len(order):
            order, at = rng.permutation(x.shape[1]), 0
        part = order[at:at + batch]
        at += batch
        classes = np.ascontiguousarray(x[:, part])
        scores, both, (ahead, back) = emissions(model, classes, keep=True)
        _, grad, d_moves = crf_gradient(scores, model.moves, y[:, part])
        grad = grad.astype(np.float32)
        d_out = np.tensordot(both, grad, axes=([0, 1], [0, 1]))
        d_both = grad @ model.out.T
        ta, ra = back_direction(classes, model.recurrent[0], ahead, d_both[:, :, :hidden])
        tb, rb = back_direction(classes[::-1], model.recurrent[1], back, d_both[::-1, :, hidden:])
        grads = [ta, tb, ra, rb, d_out, grad.sum(axis=(0, 1)), d_moves]
        norm = np.sqrt(sum(float((g ** 2).sum()) for g in grads))
        now = rate * (1 - (step - 1) / steps)
        for p, g, m, v in zip(parameters, grads, first, second):
            g = g / max(1.0, norm / 5.0)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return model


# --- windows and their reconciliation ------------------------------------------------------------------

def starts_of(text: str) -> list[int]:
    """Starts of the windows (every STRIDE characters) that hold a digit or ``@``."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    out: list[int] = []
    done = -1
    for match in MARKS.finditer(text):
        p = match.start()
        low = max(done + 1, -(-(p - WINDOW + 1) // STRIDE), 0)
        high = min(p // STRIDE, last)
        out += [w * STRIDE for w in range(low, high + 1)]
        done = max(done, high)
    return out


def spans_in(tags: np.ndarray) -> list[Span]:
    """Spans of one window's path."""
    out: list[Span] = []
    for i in np.flatnonzero(tags).tolist():
        kind, begins = (int(tags[i]) - 1) // 2, tags[i] % 2 == 1
        if not begins and out and out[-1][0] == kind and out[-1][2] == i:
            out[-1] = (kind, out[-1][1], i + 1)
        else:
            out.append((kind, i, i + 1))
    return out


def decode(model: Tagger, texts: list[str], batch: int = 1024) -> list[list[Span]]:
    """The model's spans of each whole text, reconciled over its windows."""
    places = [(n, a) for n, text in enumerate(texts) for a in starts_of(text)]
    raw: dict[int, list[tuple[int, int, int, int]]] = {}
    moves = allowed(model.moves)
    codes: dict[int, np.ndarray] = {}
    for at in range(0, len(places), batch):
        part = places[at:at + batch]
        x = np.full((WINDOW, len(part)), -1, np.int64)
        for j, (n, a) in enumerate(part):
            if n not in codes:
                codes = {n: np.frombuffer(texts[n].encode("utf-32-le", "surrogatepass"), np.uint32)}
            piece = codes[n][a:a + WINDOW]
            x[:len(piece), j] = piece
        paths = viterbi(emissions(model, character_classes(x))[0], moves)
        for j in np.flatnonzero(paths.any(axis=0)).tolist():
            n, a = part[j]
            for kind, s, e in spans_in(paths[:, j]):
                raw.setdefault(n, []).append((kind, a + s, a + min(e, len(texts[n]) - a), a))
    return [reconcile(texts[n], raw[n]) if n in raw else [] for n in range(len(texts))]


def reconcile(text: str, found: list[tuple[int, int, int, int]]) -> list[Span]:
    """Spans of one text from (kind, start, stop, window) hits: each character is decided by the window it is deepest in."""
    def owner(p: int) -> int:
        """The start of the window whose middle is nearest to ``p``."""
        last = max(0, -(-(len(text) - WINDOW) // STRIDE))
        w = min(max(0, (p - WINDOW // 2 + STRIDE // 2) // STRIDE), last)
        return w * STRIDE

    kept: list[Span] = []
    for kind, a, b, window in sorted(found, key=lambda x: (x[1], x[2])):
        if owner((a + b - 1) // 2) != window and not (b - a >= STRIDE // 2):
            continue
        if kept and kept[-1][0] == kind and a <= kept[-1][2]:
            kept[-1] = (kind, kept[-1][1], max(b, kept[-1][2]))
        else:
            kept.append((kind, a, b))
    out: list[Span] = []
    for kind, a, b in kept:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if KINDS[kind] != "email":  # never a part of a number
            while a > 0 and "0" <= text[a - 1] <= "9":
                a -= 1
            while b < len(text) and "0" <= text[b] <= "9":
                b += 1
        if b - a >= 6 and MARKS.search(text, a, b):
            out.append((kind, a, b))
    return out


def merged(base: list[Span], extra: list[Span]) -> list[Span]:
    """Base spans, and model spans that overlap none of any kind; by kind, then start."""
    taken = sorted((a, b) for _, a, b in base)
    out = list(base)
    at = 0
    for kind, a, b in sorted(extra, key=lambda s: s[1:]):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if not (at < len(taken) and taken[at][0] < b) and not (len(out) > len(base) and out[-1][2] > a):
            out.append((kind, a, b))
    return sorted(out)


# --- operators -----------------------------------------------------------------------------------------

def fit(docs: DataFrame, sample_rows: int = 300, sample_chars: int = 20_000, **settings) -> Tagger:
    """Train on the base spans of at most ``sample_rows`` different texts with a digit or ``@`` and of at most
    ``sample_chars`` characters: those with the smallest hashes.

    About twice as many hashes lie under the threshold that their estimated number gives, whatever the number of tasks,
    and copies meet before anything is sent on; so the driver sees a bounded number of texts.
    """
    marked = pick(docs, "text").filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= sample_chars))
    hashed = marked.select("text", F.xxhash64("text").alias("h"))
    distinct = hashed.agg(F.approx_count_distinct("h")).first()[0]
    if distinct > 2 * sample_rows:
        hashed = hashed.filter(F.col("h") < F.lit(2 ** 64 * 2 * sample_rows // distinct - 2 ** 63))
    one_each = hashed.groupBy("h").agg(F.min("text").alias("text"))
    rows = [r["text"] for r in one_each.orderBy("h").limit(sample_rows).collect()]
    return train(rows, [base_spans(t) for t in rows], **settings)


def find(model: Tagger, texts: list[str]) -> tuple[list[list[Span]], list[list[Span]]]:
    base = [base_spans(t) for t in texts]
    return base, [merged(b, e) for b, e in zip(base, decode(model, texts))]


def finder(model: Tagger):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, ROWS):
            base, found = find(model, filled(batch.column("text")).to_pylist())
            columns = [pa.array([[{"kind": KINDS[k], "start": a, "stop": b} for k, a, b in spans] for spans in side], kind) for side in (base, found)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "base", "found"])
    return run


def find_personal_data(docs: DataFrame, model: Tagger) -> DataFrame:
    """doc_id, base spans and all spans (base and the model's), each by kind and start, in code points."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(finder(model), SCHEMA)


def masked(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, model: Tagger) -> DataFrame:
    """The documents with every span replaced by ``<kind>`` (overlapping spans by the first kind's name)."""
    names = docs.columns
    plain = docs.toDF(*(f"_{i}" for i in range(len(names))))
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, ROWS):
            texts = batch.column(text).to_pylist()
            _, found = find(model, [t or "" for t in texts])
            changed = pa.array([masked(t, s) if s else t for t, s in zip(texts, found)], batch.schema.field(text).type)
            yield batch.set_column(text, batch.schema.field(text).name, changed)

    return plain.mapInArrow(run, plain.schema).toDF(*names)
