"""Personal data in texts: fixed patterns, and a character-level BiLSTM with a CRF for what they miss.

The patterns take the leftmost longest run and drop it when its check fails:
two values side by side ("+1 (555) 555-5555 4111111111111111") are one run and
both are lost. The tagger reads characters in windows of WINDOW that overlap
by half. Each window is decoded by itself; a span cut off by a window's edge
is left to the next window; the spans of all windows of a text are reconciled
by the non-overlapping choice of the largest total score. Every kind of value
holds a digit or an @, so windows without either hold none and are not read.
A decoded span counts if its kind's pattern and check accept exactly it,
nothing alphanumeric touches it, and no pattern span lies across it.

The tagger is trained in numpy on values that the patterns found (at most
SAMPLE of a kind, and as many windows with digits but without a value), which
are set into the texts around them singly and side by side.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Tags: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Labelled values of a kind that the tagger is trained on, at most, and characters kept around each.
SAMPLE, AROUND = 400, 64
#: Characters of a window and of the step to the next one; windows that are read in one go.
WINDOW, STEP, BATCH = 128, 64, 512
#: Size of the tagger: character codes, embedding, hidden units a direction.
CODES, EMBED, HIDDEN = 160, 12, 16
#: Training: rounds, windows a round, their length, rate.
ROUNDS, WINDOWS, TRAIN_LENGTH, RATE = 360, 48, 96, 0.015
#: Least mean probability of a decoded span's tags.
SURE = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_DIGITS = re.compile(r"[0-9]+")
_SPACED = re.compile(r"[0-9][0-9 -]*")
_GAP = re.compile(r"[ -]{2,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")
_SIGN = re.compile(r"\S*[0-9@+]\S*")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            last = m.end()
            yield begin, last
        at = text.find("@", max(at + 1, last))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Of digit runs joined by single dots, four by four from the left."""
    for run in _DOTTED.finditer(text):
        chain: list[tuple[int, int]] = []
        for m in _DIGITS.finditer(text, run.start(), run.end()):
            if chain and m.start() != chain[-1][1] + 1:
                chain = []
            chain.append(m.span())
            if len(chain) == 4:
                parts = [text[a:b].lstrip("0") or "0" for a, b in chain]
                if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                    yield chain[0][0], chain[3][1]
                chain = []


def cards(text: str) -> Iterator[tuple[int, int]]:
    """Of digit runs joined by single blanks or hyphens, the whole chains."""
    for run in _SPACED.finditer(text):
        at = run.start()
        for gap in [*(m.span() for m in _GAP.finditer(text, run.start(), run.end())), (run.end(), run.end())]:
            piece = text[at: gap[0]].rstrip(" -")
            digits = piece.replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield at, at + len(piece)
            at = gap[1]


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m.group())) <= 15:
            yield m.span()


PATTERNS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not ANCHOR.search(text):
        return []
    return [(k, a, b) for k, kind in enumerate(KINDS) for a, b in PATTERNS[kind](text)]


def whole(kind: int, value: str) -> bool:
    """Whether ``value`` as it stands is one of its kind."""
    return list(PATTERNS[KINDS[kind]](value)) == [(0, len(value))]


# --- tagger ------------------------------------------------------------------

_ALLOWED = np.zeros((TAGS, TAGS), bool)
_ALLOWED[:, 0] = _ALLOWED[:, 1::2] = True
for _k in range(len(KINDS)):
    _ALLOWED[1 + 2 * _k, 2 + 2 * _k] = _ALLOWED[2 + 2 * _k, 2 + 2 * _k] = True
_NEVER = np.float32(-1e4)


def codes(text: str) -> np.ndarray:
    """Character codes: ASCII as it is, the rest hashed; 0 fills a window up."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(c < 128, np.maximum(c, 1), 128 + c % (CODES - 128))


def _sigmoid(x):
    return np.float32(0.5) * (np.tanh(x * np.float32(0.5)) + np.float32(1))


def _log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Weights: embedding, both directions' input, recurrent and bias weights, output layer, CRF transitions and start."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) * (1 / np.sqrt(shape[-2] if len(shape) > 1 else 1))).astype(np.float32)
        self.w = {
            "embed": make(CODES, EMBED) * np.float32(3), "into": make(2, EMBED, 4 * HIDDEN), "back": make(2, HIDDEN, 4 * HIDDEN), "bias": np.zeros((2, 1, 4 * HIDDEN), np.float32),
            "out": make(2 * HIDDEN, TAGS), "tag": np.zeros(TAGS, np.float32), "next": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32),
        }
        self.w["bias"][:, :, HIDDEN: 2 * HIDDEN] = 1  # remember at first

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """Tag scores (time, windows, tags) of code windows (windows, time), and what the gradient needs."""
        w, (n, t) = self.w, x.shape
        e = w["embed"][x.T]
        e = np.stack([e, e[::-1]])  # direction, time, window
        z = np.matmul(e.reshape(2, t * n, EMBED), w["into"]).reshape(2, t, n, 4 * HIDDEN) + w["bias"][:, None]
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        hs, cs, gates = np.empty((t + 1, 2, n, HIDDEN), np.float32), np.empty((t + 1, 2, n, HIDDEN), np.float32), np.empty((t, 2, n, 4 * HIDDEN), np.float32)
        hs[0] = cs[0] = 0
        for k in range(t):
            a = z[:, k] + np.matmul(h, w["back"])
            a[..., : 3 * HIDDEN] = _sigmoid(a[..., : 3 * HIDDEN])
            a[..., 3 * HIDDEN:] = np.tanh(a[..., 3 * HIDDEN:])
            c = a[..., HIDDEN: 2 * HIDDEN] * c + a[..., :HIDDEN] * a[..., 3 * HIDDEN:]
            h = a[..., 2 * HIDDEN: 3 * HIDDEN] * np.tanh(c)
            gates[k], cs[k + 1], hs[k + 1] = a, c, h
        seen = np.concatenate([hs[1:, 0], hs[:0:-1, 1]], axis=2)
        return seen @ w["out"] + w["tag"], {"x": x, "e": e, "hs": hs, "cs": cs, "gates": gates, "seen": seen}

    def links(self) -> np.ndarray:
        return np.where(_ALLOWED, self.w["next"], _NEVER)

    def begin(self) -> np.ndarray:
        out = self.w["start"].copy()
        out[2::2] = _NEVER  # a window does not begin inside a value
        return out

    def posteriors(self, score: np.ndarray, pairs: bool = False):
        """Tag probabilities (time, windows, tags), the log partition, and expected transition counts if asked for."""
        t, n, _ = score.shape
        link = self.links()
        ahead, behind = np.empty_like(score), np.zeros_like(score)
        ahead[0] = self.begin() + score[0]
        for k in range(1, t):
            ahead[k] = _log_sum(ahead[k - 1][:, :, None] + link, 1) + score[k]
        for k in range(t - 2, -1, -1):
            behind[k] = _log_sum(link + (score[k + 1] + behind[k + 1])[:, None, :], 2)
        total = _log_sum(ahead[-1], 1)
        p = np.exp(ahead + behind - total[:, None])
        if not pairs:
            return p, total, None
        both = ahead[:-1, :, :, None] + link + (score[1:] + behind[1:])[:, :, None, :] - total[:, None, None]
        return p, total, np.exp(both).sum(axis=(0, 1))

    def gradient(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags (windows, time) and its gradient."""
        w, (n, t) = self.w, x.shape
        score, m = self.forward(x)
        p, total, expected = self.posteriors(score, True)
        y, rows = tags.T, np.arange(n)
        own = np.take_along_axis(score, y[:, :, None], 2).sum(axis=(0, 2)) + self.begin()[y[0]] + self.links()[y[:-1], y[1:]].sum(axis=0)
        d = p.copy()
        np.put_along_axis(d, y[:, :, None], np.take_along_axis(d, y[:, :, None], 2) - 1, 2)
        d /= n
        g = {"tag": d.sum(axis=(0, 1)), "out": np.einsum("tnh,tnk->hk", m["seen"], d, optimize=True)}
        met = np.zeros((TAGS, TAGS), np.float32)
        np.add.at(met, (y[:-1].ravel(), y[1:].ravel()), 1)
        g["next"] = np.where(_ALLOWED, (expected - met) / n, 0)
        g["start"] = p[0].sum(axis=0) / n - np.bincount(y[0], minlength=TAGS) / n
        dh_out = d @ w["out"].T
        dz = np.empty_like(m["gates"])
        dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        H = HIDDEN
        for k in range(t - 1, -1, -1):
            dh = dh + np.stack([dh_out[k, :, :H], dh_out[t - 1 - k, :, H:]])
            a, c = m["gates"][k], np.tanh(m["cs"][k + 1])
            i, f, o, u = a[..., :H], a[..., H: 2 * H], a[..., 2 * H: 3 * H], a[..., 3 * H:]
            dc = dc + dh * o * (1 - c * c)
            dz[k] = np.concatenate([dc * u * i * (1 - i), dc * m["cs"][k] * f * (1 - f), dh * c * o * (1 - o), dc * i * (1 - u * u)], axis=2)
            dc = dc * f
            dh = np.matmul(dz[k], w["back"].transpose(0, 2, 1))
        flat = dz.transpose(1, 0, 2, 3).reshape(2, t * n, 4 * H)
        g["bias"] = flat.sum(axis=1, keepdims=True)
        g["back"] = np.matmul(m["hs"][:-1].transpose(1, 3, 0, 2).reshape(2, H, t * n), flat)
        g["into"] = np.matmul(m["e"].reshape(2, t * n, EMBED).transpose(0, 2, 1), flat)
        de = np.matmul(flat, w["into"].transpose(0, 2, 1)).reshape(2, t, n, EMBED)
        g["embed"] = np.zeros_like(w["embed"])
        np.add.at(g["embed"], x.T, de[0] + de[1][::-1])
        return float((total - own).mean()), g

    def train(self, examples: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[float]:
        """Adam over batches of (codes, tags); the loss of every round."""
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second, losses = {k: np.zeros_like(v) for k, v in self.w.items()}, []
        for r, (x, tags) in enumerate(examples, 1):
            loss, g = self.gradient(x, tags)
            losses.append(loss)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            rate = RATE * min(1.0, 2 * (1 - r / (ROUNDS + 1)))
            for k, v in g.items():
                v = (v * min(1.0, 5 / (norm + 1e-9))).astype(np.float32)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                self.w[k] = (self.w[k] - rate * first[k] / (1 - 0.9**r) / (np.sqrt(second[k] / (1 - 0.99**r)) + 1e-6)).astype(np.float32)
        return losses

    def decode(self, x: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        """(kind, first, end, score) of the values in every window (windows, time), on the likeliest path of tags."""
        score, _ = self.forward(x)
        p, _, _ = self.posteriors(score)
        t, n, _ = score.shape
        link, best = self.links(), np.empty(score.shape, np.int8)
        now = self.begin() + score[0]
        for k in range(1, t):
            step = now[:, :, None] + link
            best[k] = step.argmax(axis=1)
            now = step.max(axis=1) + score[k]
        tags = np.empty((t, n), np.int64)
        tags[-1] = now.argmax(axis=1)
        for k in range(t - 1, 0, -1):
            tags[k - 1] = best[k][np.arange(n), tags[k]]
        sure = np.take_along_axis(p, tags[:, :, None], 2)[:, :, 0]
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in range(n)]
        for k, j in zip(*(v.tolist() for v in np.nonzero((tags % 2 == 1).T))):
            kind, end = int(tags[j, k] // 2), j + 1
            while end < t and tags[end, k] == 2 * kind + 2:
                end += 1
            out[k].append((kind, j, end, float(sure[j:end, k].mean())))
        return out


# --- labelled values and training windows ------------------------------------

@dataclass
class Labelled:
    """A value that the patterns found (kind -1: a text with digits and no value) and the text around it."""

    kind: int
    before: str
    value: str
    after: str


def labelled(docs: DataFrame, sample: int = SAMPLE) -> list[Labelled]:
    """At most ``sample`` values of each kind, and as many texts without one: those of the smallest hashes of (doc_id, start)."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        kept: dict[int, list] = {k: [] for k in range(-1, len(KINDS))}
        for b in it:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = text.as_py() or ""
                found = pattern_spans(text)
                if not found and (m := ANCHOR.search(text)):
                    found = [(-1, m.start(), m.start())]
                for k, a, z in found:
                    if z - a > AROUND:
                        continue
                    own = (-zlib.crc32(f"{doc}:{a}:{k}".encode()), text[max(0, a - AROUND): a], text[a:z], text[z: z + AROUND])
                    if len(kept[k]) < sample:
                        heapq.heappush(kept[k], own)
                    elif own > kept[k][0]:
                        heapq.heapreplace(kept[k], own)
        rows = [(k, -h, x, v, y) for k, rows in kept.items() for h, x, v, y in rows]
        cols = list(zip(*rows)) or [()] * 5
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kind", "h", "before", "value", "after"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "kind int, h long, before string, value string, after string")
    # A task keeps the smallest hashes of each kind, so the smallest of all are among them.
    rows, order = rows.withColumn("of", F.spark_partition_id() % 200), ["h", "before", "value", "after"]
    for key in (["kind", "of"], ["kind"]):  # by groups of tasks first, so that the last step ranks at most 200 lists of a kind
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("r") <= sample)
    least = rows.orderBy("kind", "r").collect()
    return [Labelled(r.kind, r.before, r.value, r.after) for r in least]


def examples(values: list[Labelled], rounds: int = ROUNDS, seed: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Training batches: values with new digits, one to three of them side by side, inside the texts around values."""
    rng = np.random.default_rng(seed)
    by = {k: [v for v in values if v.kind == k] for k in range(-1, len(KINDS))}
    kinds = [k for k in range(len(KINDS)) if by[k]]
    digits, gaps = re.compile("[0-9]"), [" ", " ", " ", " ", ", ", "\n", "; ", ". "]
    pick = lambda rows: rows[int(rng.integers(len(rows)))]
    # What stands around a value may hold others: only the part up to the next sign of one is context.
    before, after = [_SIGN.split(v.before)[-1] for v in values], [_SIGN.split(v.after)[0] for v in values]
    for _ in range(rounds):
        x, tags = np.zeros((WINDOWS, TRAIN_LENGTH), np.int64), np.zeros((WINDOWS, TRAIN_LENGTH), np.int64)
        for n in range(WINDOWS):
            if by[-1] and rng.random() < 0.2:
                v = pick(by[-1])
                text, marks = v.before + v.value + v.after, []
            else:
                text, marks = pick(before), []
                text = text[int(rng.integers(len(text) + 1)):]
                text += "" if not text or text[-1].isspace() else " "
                for k in range(int(rng.choice([1, 2, 3], p=[0.4, 0.4, 0.2]))):
                    text += pick(gaps) if k else ""
                    v = pick(by[pick(kinds)])
                    value = digits.sub(lambda _: str(rng.integers(10)), v.value) if v.kind != 3 else v.value[:2] + digits.sub(lambda _: str(rng.integers(10)), v.value[2:])
                    marks.append((v.kind, len(text), len(text) + len(value)))
                    text += value
                rest = pick(after)
                text += rest if rest[:1].isspace() or not rest else " " + rest
            text = text[:TRAIN_LENGTH]
            x[n, : len(text)] = codes(text)
            for k, a, z in marks:
                if z <= TRAIN_LENGTH:
                    tags[n, a:z] = 2 * k + 2
                    tags[n, a] = 2 * k + 1
                else:
                    x[n, a:] = tags[n, a:] = 0
        yield x, tags


def fit(docs: DataFrame, sample: int = SAMPLE) -> Tagger | None:
    """The tagger, trained on a bounded sample of pattern values; None if the texts hold no value."""
    values = labelled(docs, sample)
    if not any(v.kind >= 0 for v in values):
        return None
    tagger = Tagger()
    tagger.train(examples(values))
    return tagger


# --- whole texts ---------------------------------------------------------------

def windows(text: str) -> Iterator[int]:
    """Starts of the windows that hold a digit or an @, every STEP characters."""
    last = -1
    for m in ANCHOR.finditer(text):
        k = m.start()
        for s in range(max(last + 1, -(-(k - WINDOW + 1) // STEP), 0), k // STEP + 1):
            last = s
            yield s * STEP


def reconcile(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The non-overlapping (kind, start, end) of the largest total score; of equal spans the surest counts, of ties the earlier end."""
    best: dict[tuple[int, int, int], float] = {}
    for k, a, z, s in spans:
        best[k, a, z] = max(s, best.get((k, a, z), 0.0))
    rows = sorted((z, a, k, s) for (k, a, z), s in best.items())
    ends, total, back = [0], [0.0], [None]
    from bisect import bisect_right

    for z, a, k, s in rows:
        under = bisect_right(ends, a) - 1
        if total[under] + s > total[-1]:
            ends.append(z)
            total.append(total[under] + s)
            back.append((under, (k, a, z)))
    out, at = [], len(ends) - 1
    while at:
        at, span = back[at]
        out.append(span)
    return out[::-1]


def tagged_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) that the tagger finds in each text, reconciled over its windows."""
    found: list[list] = [[] for _ in texts]
    held: list[tuple[int, int]] = []

    def read():
        size = max(min(WINDOW, len(texts[n]) - a) for n, a in held)
        x = np.zeros((len(held), size), np.int64)
        for r, (n, a) in enumerate(held):
            c = codes(texts[n][a: a + WINDOW])
            x[r, : len(c)] = c
        for (n, a), spans in zip(held, tagger.decode(x)):
            length = min(WINDOW, len(texts[n]) - a)
            for kind, s, z, sure in spans:
                cut = (s == 0 and a > 0) or (z >= length and a + length < len(texts[n]))
                if not cut and z <= length and sure >= SURE:
                    found[n].append((kind, a + s, a + z, sure))
        held.clear()

    for n, text in enumerate(texts):
        for a in windows(text):
            held.append((n, a))
            if len(held) >= BATCH:
                read()
    if held:
        read()
    return [reconcile(f) for f in found]


def added_spans(text: str, base: list[tuple[int, int, int]], tagged: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The tagged spans that hold in themselves and lie across no pattern span."""
    taken = sorted((a, z) for _, a, z in base)
    out = []
    for k, a, z in tagged:
        value = text[a:z]
        alone = not (a and text[a - 1].isalnum()) and not (z < len(text) and text[z].isalnum())
        if alone and whole(k, value) and not any(a < q and p < z for p, q in taken):
            out.append((k, a, z))
    return out


def find(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """``docs`` plus personal: array of (kind, start, end, base), by kind as in KINDS, then start; code points, end exclusive.

    Pattern spans (base) always stay, the tagger adds to them. A null text is
    empty; rows are independent, repeated rows get equal results; an existing
    column ``personal`` is replaced. Without a tagger only the patterns count.
    """
    from pyspark.sql import types as T

    docs = docs.drop("personal")
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(tagger)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("personal", T.ArrayType(span))])

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for b in it:
            found: list[list] = [[] for _ in range(b.num_rows)]
            marked: list[int] = []
            texts: list[str] = []
            for n, text in enumerate(b.column("text")):
                text = text.as_py() or ""
                if ANCHOR.search(text):
                    marked.append(n)
                    texts.append(text)
            tagged = tagged_spans(texts, sent.value) if sent.value is not None else [[] for _ in texts]
            for n, text, more in zip(marked, texts, tagged):
                base = pattern_spans(text)
                rows = [(*s, True) for s in base] + [(*s, False) for s in added_spans(text, base, more)]
                found[n] = [{"kind": KINDS[k], "start": a, "end": z, "base": own} for k, a, z, own in sorted(rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*names, "personal"])

    return docs.mapInArrow(run, schema)
