"""Operator 2, PII: a character-level bidirectional LSTM with CRF transitions, in numpy.

Labels are O and, for each kind, first and inner character (BIO).  The model is trained on the
driver from labelled spans (a bounded, seeded set of rows; `TRAIN_ROWS`) and sent to the tasks
with the stage's code (some ten thousand floats, whatever the corpus's size).

Decoding: overlapping windows of `WINDOW` characters, `STRIDE` apart, are decoded by Viterbi in
batches and reconciled over the whole text: each position takes its label from the window in
whose middle it lies deepest, then adjacent labels are joined to spans.  A whole span holds a digit or an
at sign, so decoding starts from the windows over these and goes on, window by window, as long as labels
reach over: the spans are those of decoding every window.  Base rules (regular expressions with checks) are kept beside the model's spans; a model
span that overlaps a base span is merged into it, so it adds only what the rules miss.

Defined results: null text is empty; an empty text has no spans; repeated rows get equal results;
an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textkit as tk

KINDS = ["email", "ip", "card", "phone"]

#: Fixed values of the base rules.
_LOCAL = r"[A-Za-z0-9._%+-]"
_EMAIL_TAIL = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
EMAIL_HERE = re.compile(rf"{_LOCAL}++{_EMAIL_TAIL}")
EMAIL = re.compile(rf"(?<!{_LOCAL}){_LOCAL}++{_EMAIL_TAIL}")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches.  A match can begin only where a run of local characters does, or where the
    last match ended; other starts would share the run's ending, so trying them is in vain."""
    at = 0
    while text.find("@", at) >= 0:
        m = EMAIL_HERE.match(text, at) if at else None
        m = m or EMAIL.search(text, at)
        if not m:
            return
        yield m.span()
        at = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


# ---------------------------------------------------------------- the model

WINDOW, STRIDE = 64, 32
#: Bytes of text whose windows are held at once.
BYTES = 1 << 20
HIDDEN, EMBED, EPOCHS, BATCH, RATE, SEED = 16, 8, 16, 64, 0.03, 7
#: Bound of the labelled rows that the model is fitted on.
TRAIN_ROWS = 400
LABELS = 1 + 2 * len(KINDS)
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 \n.,:;-+()@_%/\"'=#*"
#: 0: any other character, 1: beyond the text's ends.
_CODE = {c: i + 2 for i, c in enumerate(_ALPHABET)} | {c.upper(): i + 2 for i, c in enumerate(_ALPHABET[:26])}
_TABLE = np.zeros(128, np.int64)
for _c, _i in _CODE.items():
    _TABLE[ord(_c)] = _i
N_CODES = len(_ALPHABET) + 2


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 128, _TABLE[np.minimum(points, 127)], 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Tagger:
    """Embedding, one LSTM in each direction, linear scores, CRF transitions."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)

        def init(*shape):
            return (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"E": init(N_CODES, EMBED), "O": init(2 * HIDDEN, LABELS), "o": np.zeros(LABELS, np.float32), "T": 0.1 * init(LABELS, LABELS)}
        for d in "fb":
            self.p |= {f"W{d}": init(EMBED, 4 * HIDDEN), f"U{d}": init(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        n, steps, _ = x.shape
        pre = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        h, c, out, memo = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.empty((n, steps, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.p[f"U{d}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            was = (h, c)
            c = f * c + i * g
            h = o * np.tanh(c)
            out[:, t] = h
            if keep:
                memo.append((t, i, f, o, g, c, *was))
        return out, memo

    def scores(self, x: np.ndarray, keep: bool = False):
        e = self.p["E"][x]
        (hf, mf), (hb, mb) = self._lstm(e, "f", keep), self._lstm(e, "b", keep)
        h = np.concatenate((hf, hb), 2)
        return h @ self.p["O"] + self.p["o"], (e, h, mf, mb)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi paths of a batch of windows."""
        s, _ = self.scores(x)
        best, back = s[:, 0], []
        for t in range(1, s.shape[1]):
            step = best[:, :, None] + self.p["T"]
            back.append(step.argmax(1))
            best = step.max(1) + s[:, t]
        path = [best.argmax(1)]
        rows = np.arange(len(x))
        for b in reversed(back):
            path.append(b[rows, path[-1]])
        return np.stack(path[::-1], 1)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of the CRF and its gradients."""
        s, (e, h, mf, mb) = self.scores(x, keep=True)
        n, steps, k = s.shape
        T = self.p["T"]
        alpha, beta = np.empty_like(s), np.zeros_like(s)

        def lse(a, axis):
            m = a.max(axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis))

        alpha[:, 0] = s[:, 0]
        for t in range(1, steps):
            alpha[:, t] = s[:, t] + lse(alpha[:, t - 1, :, None] + T, 1)
        for t in range(steps - 2, -1, -1):
            beta[:, t] = lse(T + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        ds = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + T + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        dT = pair.sum((0, 1))
        rows = np.arange(n)[:, None]
        gold = s[rows, np.arange(steps), y].sum() + T[y[:, :-1], y[:, 1:]].sum()
        ds[rows, np.arange(steps), y] -= 1
        np.add.at(dT, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        ds = (ds / n).astype(np.float32)
        g = {"T": (dT / n).astype(np.float32), "O": np.einsum("ntj,ntk->jk", h, ds), "o": ds.sum((0, 1))}
        dh, de = ds @ self.p["O"].T, np.zeros_like(e)
        for d, memo, part in (("f", mf, dh[:, :, :HIDDEN]), ("b", mb, dh[:, :, HIDDEN:])):
            gh, gc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            gU, dz = np.zeros_like(self.p[f"U{d}"]), np.zeros((n, steps, 4 * HIDDEN), np.float32)
            for t, i, f, o, q, c, h0, c0 in reversed(memo):
                tc = np.tanh(c)
                gh = gh + part[:, t]
                gc = gc + gh * o * (1 - tc * tc)
                dz[:, t] = np.concatenate((gc * q * i * (1 - i), gc * c0 * f * (1 - f), gh * tc * o * (1 - o), gc * i * (1 - q * q)), 1)
                gU += h0.T @ dz[:, t]
                gh, gc = dz[:, t] @ self.p[f"U{d}"].T, gc * f
            g |= {f"U{d}": gU, f"W{d}": np.einsum("nte,ntz->ez", e, dz), f"c{d}": dz.sum((0, 1))}
            de += dz @ self.p[f"W{d}"].T
        g["E"] = np.zeros_like(self.p["E"])
        np.add.at(g["E"], x.ravel(), de.reshape(-1, EMBED))
        return (z.sum() - gold) / n, g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        r, m, v, k, losses = np.random.default_rng(seed), {}, {}, 0, []
        for epoch in range(epochs):
            total, order = 0.0, r.permutation(len(x))
            for at in range(0, len(x), BATCH):
                loss, g = self.step(x[order[at : at + BATCH]], y[order[at : at + BATCH]])
                total, k = total + loss, k + 1
                size = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                for name, a in g.items():
                    a = a * min(1.0, 5.0 / (size + 1e-9))
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * a
                    v[name] = 0.999 * v.get(name, 0) + 0.001 * a * a
                    rate = RATE * (1 - epoch / epochs)
                    self.p[name] -= (rate * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
            losses.append(total / max(1, len(x) // BATCH))
        return losses


def labelled(rows: int = TRAIN_ROWS, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled spans to train on: seeded texts with personal data of each kind and with look-alikes."""
    r = np.random.default_rng(seed)

    def digits(n):
        return "".join(map(str, r.integers(0, 10, n)))

    def word():
        return "".join(r.choice(["th", "er", "on", "an", "re", "in", "ou", "le", "de", "ung", "ment", "io", "ar"], r.integers(1, 4)))

    def card():
        body = r.choice(["4", "51", "37", "6011"]) + digits(11)
        check = next(d for d in "0123456789" if luhn(body + d))
        body += check
        return "".join(body[i : i + 4] + str(sep) for i in range(0, len(body), 4)).rstrip(" -") if (sep := r.choice(["", " ", "-"])) else body

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return str(r.choice([f"+1 ({a}) {b}-{c}", f"+{1 + r.integers(0, 98)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"+44 {a}{b}{c}"]))

    def ip():
        return ".".join(str(r.integers(0, 256)) for _ in range(4))

    def email():
        return f"{word()}{r.choice(['.', '_', '', digits(2)])}{word()}@{word()}{r.choice(['', '7', digits(1)])}.{r.choice(['com', 'example.com', 'org', 'net', 'co.uk'])}"

    def decoy():
        return str(r.choice([digits(4), digits(2) + "%", f"{digits(1)}.{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", "".join(r.choice(list("0123456789abcdef"), 40)), f"AKIA{word().upper()}{digits(6)}", f"@{word()}", digits(22), f"password={''.join(r.choice(list('0123456789abcdef'), 18))}"]))

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(r.integers(2, 5)):
            text += " ".join(word() for _ in range(r.integers(1, 6))) + str(r.choice([" ", " ", ": ", ", "]))
            if r.random() < 0.55:
                kind = KINDS[r.integers(0, len(KINDS))]
                value = make[kind]()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            else:
                text += decoy()
            text += str(r.choice([" ", ". ", ", ", "\n"]))
        out.append((text, spans))
    return out


def windows_of(marks: np.ndarray) -> np.ndarray:
    """Numbers of the windows that hold a mark: window k starts at k * STRIDE, so windows overlap by half, and
    the first and last reach over the ends."""
    return np.unique(np.concatenate((marks // STRIDE, marks // STRIDE - 1)))


def cut_windows(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate((np.ones(WINDOW, np.int64), code, np.ones(2 * WINDOW, np.int64)))
    return padded[(starts + WINDOW)[:, None] + np.arange(WINDOW)]


def training_set(rows: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for text, spans in rows:
        y = np.zeros(len(text) + 3 * WINDOW, np.int64)
        for kind, a, b in spans:
            k = 1 + 2 * KINDS.index(kind)
            y[WINDOW + a], y[WINDOW + a + 1 : WINDOW + b] = k, k + 1
        starts = np.arange(-STRIDE, len(text), STRIDE)
        xs.append(cut_windows(codes(text), starts))
        ys.append(y[(starts + WINDOW)[:, None] + np.arange(WINDOW)])
    return np.concatenate(xs), np.concatenate(ys)


@lru_cache(2)
def trained(rows: int = TRAIN_ROWS, seed: int = SEED) -> Tagger:
    """The model, fitted here and now; equal arguments give equal parameters."""
    model = Tagger(seed)
    model.fit(*training_set(labelled(rows, seed)), seed=seed)
    return model


def reconcile(length: int, numbers: np.ndarray, paths: np.ndarray) -> np.ndarray:
    """One label a position: of the two windows over it, the one in whose middle it lies deeper (the earlier
    one at equal depth); positions under no window have label 0.  ``numbers`` are sorted."""
    label = np.zeros((-(-length // STRIDE) + 2) * STRIDE, np.int64).reshape(-1, STRIDE)
    inner = np.arange(STRIDE) > STRIDE - 1 - np.arange(STRIDE)  # deeper in the window that starts here
    label[numbers + 1] = paths[:, :STRIDE]
    late = np.isin(numbers + 1, numbers)  # the next window is decoded too
    label[numbers[~late] + 2] = paths[~late, STRIDE:]
    label[numbers[late] + 2] = np.where(inner, label[numbers[late] + 2], paths[late, STRIDE:])
    return label[1:].ravel()[:length]


def join_labels(label: np.ndarray, text: str) -> list[tuple[str, int, int]]:
    """Spans of equal kind; those too short for any kind, or without its signs, are dropped."""
    out: list[tuple[str, int, int]] = []
    on = np.flatnonzero(label)
    for i in on:
        kind = KINDS[(label[i] - 1) // 2]
        if out and out[-1][0] == kind and out[-1][2] == i and label[i] % 2 == 0:
            out[-1] = (kind, out[-1][1], i + 1)
        else:
            out.append((kind, int(i), int(i) + 1))
    return [s for s in out if _plausible(s[0], text[s[1] : s[2]])]


def _plausible(kind: str, value: str) -> bool:
    """Whole values only: the model finds where, this says whether all of it is there."""
    n = sum(c.isdigit() for c in value)
    if value != value.strip() or not value:
        return False
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@.,]{2,}", value))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", value)) and all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 13 <= n <= 19 and luhn("".join(c for c in value if c.isdigit())) and bool(re.fullmatch(r"[0-9][0-9 .\-/]*[0-9]", value))
    return 10 <= n <= 15 and bool(re.fullmatch(r"[+(0-9][0-9 ().\-/]*[0-9]", value)) and bool(re.search(r"[ ()\-]", value))


def model_spans(model: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """The model's spans of each text; windows of all texts are decoded together, in blocks.

    Every span holds a digit or @, or it would not be whole.  So the windows over these marks are decoded, and
    from each window with a label the windows next to it, until none is new: all labels of a span, as if every
    window were decoded."""
    code = [codes(text) for text in texts]
    last = np.array([(len(c) - 1) // STRIDE for c in code], np.int64)
    have: list[dict[int, np.ndarray]] = [{} for _ in texts]
    todo = [windows_of(np.flatnonzero(((c >= _CODE["0"]) & (c <= _CODE["9"])) | (c == _CODE["@"]))) for c in code]
    while any(map(len, todo)):
        owner = np.repeat(np.arange(len(texts)), [len(k) for k in todo])
        number = np.concatenate(todo)
        every = np.concatenate([cut_windows(code[t], k * STRIDE) for t, k in enumerate(todo) if len(k)])
        paths = np.concatenate([model.decode(every[i : i + 2048]) for i in range(0, len(every), 2048)])
        for t, k, path in zip(owner.tolist(), number.tolist(), paths, strict=True):
            have[t][k] = path
        on = paths.any(1)
        beside = [set() for _ in texts]
        for t, k in zip(owner[on].tolist(), number[on].tolist(), strict=True):
            beside[t].update(j for j in (k - 1, k + 1) if -1 <= j <= last[t] and j not in have[t])
        todo = [np.array(sorted(b), np.int64) for b in beside]
    out = []
    for text, own in zip(texts, have, strict=True):
        k = np.array(sorted(own), np.int64)
        out.append(join_labels(reconcile(len(text), k, np.stack([own[i] for i in k.tolist()])), text) if own else [])
    return out


def merged(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and those of the model that overlap none of them, by kind as listed, then start."""
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    # of the base spans that start before this one's end, does any end after its start?
    before = [bisect_left(starts, s[2]) for s in more]
    add = [s for s, n in zip(more, before, strict=True) if not n or reach[n - 1] <= s[1]]
    return sorted([*base, *add], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect_in(column: pa.Array, model: Tagger) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text of an Arrow column."""
    column = pc.fill_null(column, "")
    may = pc.match_substring_regex(column, r"[0-9@]").to_numpy(zero_copy_only=False)
    out: list[tuple[list, list]] = [([], [])] * len(column)
    picked = np.flatnonzero(may)
    texts = column.take(pa.array(picked)).to_pylist()
    for i, text, more in zip(picked, texts, model_spans(model, texts), strict=True):
        base = base_spans(text)
        out[i] = (base, merged(base, more))
    return out


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id", model: Tagger | None = None) -> DataFrame:
    """One row per document: key, base spans and all spans, listed as kind:start:end (code points)."""
    model = model or trained()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.blocks(batches, "text", BYTES):
            found = detect_in(batch.column("text"), model)
            counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *counts, pa.array([listed(b) for b, _ in found], pa.string()), pa.array([listed(a) for _, a in found], pa.string())],
                [key, *(f"n_{k}" for k in KINDS), "base", "spans"],
            )

    given = docs.selectExpr(f"`{key}` as key", f"`{text}` as text")
    return given.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")


def redact(docs: DataFrame, text: str = "text", model: Tagger | None = None) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; other columns as they were."""
    model = model or trained()
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.blocks(batches, at, BYTES):
            column = batch.column(at)
            found = detect_in(column, model)
            hit = [i for i, (_, spans) in enumerate(found) if spans]
            if hit:
                values = column.to_pylist()
                for i in hit:
                    values[i] = replaced(values[i], found[i][1])
                column = pa.array(values, column.type)
            yield batch.set_column(at, batch.schema.field(at).name, column)

    return docs.mapInArrow(run, docs.schema)


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"<{kind.upper()}>"] if a >= at else []
        at = max(at, b)
    return "".join([*out, text[at:]])
