"""Operator 8, secret scans: rules, and a character CNN over candidates.

Rules find assignments, access keys and hex strings; their spans all stay.
Further candidates are all unbroken runs of LEAST or more key characters with
letters and digits, or with letters of both cases amid them.  A small
convolutional network (numpy) reads every candidate, the rules' too, with
CONTEXT characters on either side: it adds further ones above its threshold as
kind ``model`` and gives each span its calibrated probability.  Candidates
longer than BODY are read in windows that overlap, STEP apart, and count by
their likeliest window.

The network is trained on labelled findings that ``labelled_findings`` makes
from a seed (secrets and look-alikes in varied contexts), Platt-calibrated on
a second split, with the highest threshold that keeps RECALL of a third
split's secrets.

Defined cases: null and empty texts have no spans (the digest of the empty
string); a text of any length is read whole; null doc_ids and repeated rows are
kept; candidates that lie wholly in rules' spans add none, others may overlap
rules' spans; an empty table gives no rows; other columns are kept
by ``scan`` and ignored by the query.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the maximal runs, as the shorter ones fail
#: Characters of a further candidate, at least.
LEAST = 20
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}")
MIXED = re.compile(r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[a-z][A-Z].*[a-z][A-Z]").search
KINDS = ("assign", "access", "hex", "model")

CONTEXT, BODY, STEP = 24, 48, 8
WIDTH = 2 * CONTEXT + BODY
CLASSES, FILTERS, SPAN = 12, 24, 5
RECALL, SEED = 0.98, 5


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' findings."""
    out = []
    low = text.lower()
    if "token" in low or "secret" in low or "passw" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """A run of capitals after a small letter, or a digit beside letters."""
    return [m.span() for m in CANDIDATE.finditer(text) if MIXED(m.group())]


def _class_table() -> np.ndarray:
    """Character classes: 0 padding, then letters by case and use, digits, marks."""
    table = np.full(128, 11, dtype=np.int64)
    for chars, k in (("abcdef", 1), ("ghijklmnopqrstuvwxyz", 2), ("ABCDEF", 3), ("GHIJKLMNOPQRSTUVWXYZ", 4), ("0123456789", 5), ("+/", 6), ("_-", 7), ("=:", 8), (" \t\r\n", 9), ("\"'`", 10)):
        for c in chars:
            table[ord(c)] = k
    return table


TABLE = _class_table()


def slices(a: int, b: int) -> list[tuple[int, int]]:
    """The bodies in which a candidate is read."""
    if b - a <= BODY:
        return [(a, b)]
    return [(k, k + BODY) for k in (*range(a, b - BODY, STEP), b - BODY)]


def windows(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Class codes of context, body (of BODY characters at most) and context."""
    out = np.zeros((len(spans), WIDTH), dtype=np.uint8)
    for row, (a, b) in zip(out, spans):
        for at, s in ((CONTEXT - min(a, CONTEXT), text[max(0, a - CONTEXT) : a]), (CONTEXT, text[a:b]), (CONTEXT + BODY, text[b : b + CONTEXT])):
            codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            row[at : at + len(codes)] = TABLE[np.minimum(codes, 127)]
    return out


def labelled_findings(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """n windows and labels, half of them secrets; of long bodies one window,
    the one with most of the secret if it lies among other key characters."""
    rng = random.Random(seed)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    pick = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    word = lambda: pick(letters, 2, 9)
    both = letters + letters.upper() + digits

    def secret() -> str:
        return rng.choice((
            lambda: base64.b64encode(rng.randbytes(rng.randint(18, 48))).decode(),
            lambda: pick(both, 24, 64),
            lambda: rng.choice(("sk_live_", "ghp_", "xoxb-", "glpat-", "pk_test_", "AIza")) + pick(both, 20, 40),
            lambda: base64.urlsafe_b64encode(rng.randbytes(rng.randint(24, 60))).decode(),
            lambda: pick(digits + "ABCDEF", 32, 64),
            lambda: pick(digits + letters, 28, 60),
        ))()

    def plain() -> str:
        return rng.choice((
            lambda: "_".join(word() for _ in range(4)) + "_" + pick(digits, 1, 4),
            lambda: "-".join(word() for _ in range(5)) + "-20" + pick(digits, 2, 2),
            lambda: "/".join(word() for _ in range(5)) + "/v" + pick(digits, 1, 1),
            lambda: pick(digits, 4, 4) + "-" + "-".join(pick(digits, 2, 4) for _ in range(4)) + word(),
            lambda: "".join(word().capitalize() for _ in range(5)) + pick(digits, 1, 3),
            lambda: word() * 3 + "=" + pick(digits, 3, 12) + "_" * rng.randint(6, 14),
            lambda: pick("=-_", 18, 30) + word() + pick(digits, 1, 2),
            lambda: pick(digits, 16, 24) + rng.choice(("x", "kg", "th")),
            lambda: path(6, 16) + rng.choice("/-_=") + pick(digits, 1, 4),
            lambda: path(3, 8) + rng.choice("/-_=") + pick(digits, 1, 8) + rng.choice("/-_=") + path(3, 8),
        ))()

    def path(a: int, b: int) -> str:
        return "".join(word() + rng.choice("//-_=") for _ in range(rng.randint(a, b))) + word()

    x, y = [], []
    for i in range(n):
        label = i % 2
        body = secret() if label else plain()
        while len(body) < LEAST:
            body += secret() if label else word()
        front, back = "", ""
        if label and rng.random() < 0.3:
            front, back = path(1, 6) + rng.choice("/="), rng.choice("/=") + path(1, 6)
        lead = rng.choice(("", " ", "key ", "auth: ", 'value = "', "credential=")) if rng.random() < 0.5 else " "
        before = " ".join(word() for _ in range(5)) + lead
        after = rng.choice(('"', " ", ",", "\n", ". ")) + " ".join(word() for _ in range(5))
        start = len(before) + len(front)
        inside = lambda s: min(s[1], start + len(body)) - max(s[0], start)  # noqa: E731, B023
        spans = slices(len(before), start + len(body) + len(back))
        most = max(map(inside, spans))
        x.append(windows(before + front + body + back + after, [rng.choice([s for s in spans if inside(s) == most])]))
        y.append(label)
    return np.concatenate(x), np.array(y, dtype=np.float64)


class CharCNN:
    """Class embedding by one-hot, one convolution, maximum and mean over body
    and context, and a logistic output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.kernel = rng.normal(0, 0.3, (SPAN * CLASSES, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = rng.normal(0, 0.3, 3 * FILTERS)
        self.base = np.zeros(1)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gather = x[:, np.arange(WIDTH - SPAN + 1)[:, None] + np.arange(SPAN)] + np.arange(SPAN) * CLASSES
        h = self.kernel[gather].sum(axis=2) + self.bias
        return gather, np.maximum(h, 0)

    def pooled(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        body = h[:, CONTEXT : CONTEXT + BODY]
        at = body.argmax(axis=1)
        return np.concatenate([body.max(axis=1), body.mean(axis=1), h.mean(axis=1)], axis=1), at

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self.pooled(self.hidden(x[a : a + 512])[1])[0] @ self.out + self.base for a in range(0, len(x), 512))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.01, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        params = [self.kernel, self.bias, self.out, self.base]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), 64):
                part = order[a : a + 64]
                gather, h = self.hidden(x[part])
                pool, at = self.pooled(h)
                r = (1 / (1 + np.exp(-np.clip(pool @ self.out + self.base, -40, 40))) - y[part]) / len(part)
                g = r[:, None] * self.out
                dh = np.repeat(g[:, None, 2 * FILTERS :] / h.shape[1], h.shape[1], axis=1)
                dh[:, CONTEXT : CONTEXT + BODY] += g[:, None, FILTERS : 2 * FILTERS] / BODY
                np.add.at(dh, (np.arange(len(part))[:, None], CONTEXT + at, np.arange(FILTERS)), g[:, :FILTERS])
                dh *= h > 0
                flat = gather.ravel()
                per_row = np.repeat(dh.reshape(-1, FILTERS), SPAN, axis=0)
                dk = np.stack([np.bincount(flat, per_row[:, f], SPAN * CLASSES) for f in range(FILTERS)], axis=1)
                t += 1
                for p, g1, m, v in zip(params, (dk, dh.sum(axis=(0, 1)), pool.T @ r, np.array([r.sum()])), first, second):
                    m[:] = 0.9 * m + 0.1 * g1
                    v[:] = 0.999 * v + 0.001 * g1 * g1
                    p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling."""
        raw = self.raw(x)
        for _ in range(300):
            r = 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -40, 40))) - y
            self.scale -= 0.1 * float((r * raw).mean())
            self.shift -= 0.1 * float(r.mean())

    def constrain(self, x: np.ndarray, y: np.ndarray) -> None:
        """The highest threshold that keeps RECALL of the secrets."""
        secrets = np.sort(self.probability(x[y == 1]))
        self.threshold = float(secrets[int((1 - RECALL) * len(secrets))])


def train(n: int = 4800) -> CharCNN:
    """Fitted on five eighths of n findings, calibrated on half of the others,
    its threshold set on the rest."""
    x, y = labelled_findings(n)
    a, b = n * 5 // 8, n * 13 // 16
    model = CharCNN()
    model.fit(x[:a], y[:a])
    model.calibrate(x[a:b], y[a:b])
    model.constrain(x[b:], y[b:])
    return model


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def uncovered(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The spans, in ascending order, that sorted base spans don't wholly hold."""
    merged: list[list[int]] = []
    for a, _, b in base:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]
    return [s for s in spans if (k := bisect.bisect_right(starts, s[0])) == 0 or merged[k - 1][1] < s[1]]


def scored(texts: list[str], model: CharCNN) -> tuple[list, list]:
    """The rules' spans of each text, and all its spans as (start, kind, end,
    probability)."""
    base = [rule_spans(t) for t in texts]
    read = [(i, (a, b), kind) for i, own in enumerate(base) for a, kind, b in own]
    read += [(i, s, 3) for i, t in enumerate(texts) for s in uncovered(candidates(t), base[i])]
    every: list[list] = [[] for _ in texts]
    order = sorted(range(len(read)), key=lambda k: read[k][0])
    read = [read[k] for k in order]
    for (i, (a, b), kind), p in zip(read, likeliest(texts, [(i, s) for i, s, _ in read], model).tolist()):
        if kind < 3 or p >= model.threshold:
            every[i].append((a, kind, b, p))
    return base, [sorted(e) for e in every]


def found(texts: list[str], model: CharCNN) -> tuple[list, list]:
    """The rules' spans and all spans (start, kind, end) of each text."""
    base, every = scored(texts, model)
    return base, [[s[:3] for s in e] for e in every]


def likeliest(texts: list[str], free: list[tuple[int, tuple[int, int]]], model: CharCNN, at_once: int = 4096) -> np.ndarray:
    """The greatest probability over each candidate's windows."""
    out = np.zeros(len(free))
    read = ((n, i, s) for n, (i, span) in enumerate(free) for s in slices(*span))
    for part in itertools.batched(read, at_once):
        x = np.concatenate([windows(texts[i], [s for _, _, s in own]) for i, own in itertools.groupby(part, key=lambda r: r[1])])
        np.maximum.at(out, [n for n, _, _ in part], model.probability(x))
    return out


OUT = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "probabilities")


def scan(docs: DataFrame, model: CharCNN | None = None) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256, spans and the spans'
    probabilities, which replace columns of the same names."""
    model, docs = model or train(), docs.drop(*OUT)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.pieces(batch, "text"):
                base, every = scored(common.texts_of(part), model)
                counts = [pa.array([sum(k == kind for _, k, _ in b) for b in base], pa.int64()) for kind in range(3)]
                digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *counts, digests, pa.array([joined([s[:3] for s in e]) for e in every]), pa.array([[s[3] for s in e] for e in every], pa.list_(pa.float64()))], names=[*names, *OUT])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, probabilities array<double>"])
    return docs.mapInArrow(run, schema)


def blanked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with asterisks in the place of sorted spans, which may overlap."""
    out, at = [], 0
    for a, _, b in spans:
        if b > at:
            out += [text[at:a], "*" * (b - max(a, at))]
            at = b
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, model: CharCNN | None = None) -> DataFrame:
    """docs with each found span of text replaced by as many asterisks."""
    model, names = model or train(), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.pieces(batch, "text"):
                texts = part.column("text").to_pylist()
                for i, spans in enumerate(found([t or "" for t in texts], model)[1]):
                    if spans:
                        texts[i] = blanked(texts[i], spans)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in names], names=names)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
