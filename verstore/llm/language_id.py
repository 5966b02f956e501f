"""Operator 2, language identification with hyperdimensional profiles.

Every letter has a random +-1 vector.  A trigram's vector binds (multiplies)
its letters' vectors, permuted (rolled) by their place; a document bundles
(adds) its trigrams' vectors; a language's prototype bundles the unit vectors
of its training documents.  A document's language is the prototype with the
greatest cosine.

Trigrams of a piece of text are counted first and bundled as one matrix
product, counts x trigram vectors, so work per character is a few array steps.

Defined cases: null texts and texts without letters are ``und`` with score 0;
ties go to the language that sorts first; documents with null doc_id or null
lang are never trained on; a text of any length counts whole, in slices of LONG
characters; without training rows all are ``und``; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Dimensions, and symbols (0 bounds words; letters beyond Latin share some).
DIMENSIONS, SYMBOLS = 512, 128
#: Characters that are bundled at once.
LONG = 1 << 20
UNDETERMINED = "und"

_symbols: list[np.ndarray] = []


def symbol_table() -> np.ndarray:
    """Symbol of each code point, 0 for all that are no letters."""
    if not _symbols:
        table = np.zeros(0x110000, dtype=np.uint32)
        letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        points = np.flatnonzero(letters)
        table[points] = 27 + points % (SYMBOLS - 27)
        for k in range(26):
            table[[65 + k, 97 + k]] = 1 + k
        for c in range(0xC0, 0x250):  # capitals count as their small letters
            if letters[c]:
                table[c] = 27 + ord(chr(c).lower()[0]) % (SYMBOLS - 27)
        _symbols.append(table)
    return _symbols[0]


class Space:
    """The letters' vectors and what is derived from them; the seed fixes all."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7):
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.float32), (SYMBOLS, dimensions))
        self.places = [np.roll(letters, 2 - k, axis=1) for k in range(3)]
        self.dimensions = dimensions
        self.slot = np.zeros(SYMBOLS**3, dtype=np.int32)

    def bundle(self, texts: list[str], most_cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of texts, and how many letters each has; texts above LONG
        characters are bundled slice by slice."""
        long = [i for i, t in enumerate(texts) if len(t) > LONG]
        if not long:
            return self._bundled(texts, most_cells)
        out, n = self._bundled(["" if len(t) > LONG else t for t in texts], most_cells)
        for i in long:
            for a in range(0, len(texts[i]), LONG):
                v, letters = self._bundled([texts[i][max(a - 1, 0) : a + LONG + 1]], most_cells, a > 0, a + LONG < len(texts[i]))
                out[i] += v[0]
                n[i] += letters[0]
        return out, n

    def _bundled(self, texts: list[str], most_cells: int, before: bool = False, after: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """before, after: the first, the last character is there as a neighbour only."""
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        doc = np.repeat(np.arange(len(texts), dtype=np.int64), lengths + 1)[: len(codes)]
        sym = symbol_table()[codes]
        edge = np.zeros(1, dtype=np.uint32)
        sym = np.concatenate([edge, sym, edge])
        gram = (sym[:-2] * SYMBOLS + sym[1:-1]) * SYMBOLS + sym[2:]
        keep = np.flatnonzero(sym[1:-1])  # grams centred on a letter
        keep = keep[(keep >= before) & (keep < len(codes) - after)]
        n_letters = np.bincount(doc[keep], minlength=len(texts))
        gram, doc = gram[keep], doc[keep]
        seen = np.zeros(SYMBOLS**3, dtype=bool)
        seen[gram] = True
        distinct = np.flatnonzero(seen)
        self.slot[distinct] = np.arange(len(distinct))
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        if not len(distinct):
            return out, n_letters
        column = self.slot[gram]
        rows = max(1, most_cells // max(1, len(distinct)))
        where = np.searchsorted(doc, np.arange(0, len(texts) + rows, rows))
        for width in range(0, len(distinct), 8192):  # trigram vectors of some columns at a time
            ids = distinct[width : width + 8192]
            vectors = self.places[0][ids // SYMBOLS**2] * self.places[1][ids // SYMBOLS % SYMBOLS] * self.places[2][ids % SYMBOLS]
            for k, (a, b) in enumerate(zip(where, where[1:])):
                here, cols = doc[a:b] - k * rows, column[a:b] - width
                if len(distinct) > 8192:
                    inside = (cols >= 0) & (cols < len(ids))
                    here, cols = here[inside], cols[inside]
                n = min(rows, len(texts) - k * rows)
                counts = np.bincount(here * len(ids) + cols, minlength=n * len(ids)).astype(np.float32).reshape(n, -1)
                out[k * rows : k * rows + n] += counts @ vectors
        return out, n_letters


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def train(docs: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and prototypes from all training documents.

    Each task sends one partial sum per language; the sums' mean is taken off,
    as what languages share tells none apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dimensions), {}
        for batch in batches:
            for part in common.pieces(batch, "text", 1 << 20):
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                vectors, n = space.bundle(common.texts_of(part))
                vectors = unit(vectors).astype(np.float64)
                for lang in set(langs.tolist()):
                    sums[lang] = sums.get(lang, 0) + vectors[(langs == lang) & (n > 0)].sum(axis=0)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total], pa.list_(pa.float64()))], names=["lang", "total"])

    learned = docs.where(~common.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    parts = learned.mapInArrow(run, "lang string, total array<double>")
    # one row for each language and dimension before the driver sees it
    sums = parts.select("lang", F.posexplode("total").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v")).toPandas()
    langs = sorted(sums["lang"].unique())
    found = np.zeros((len(langs), dimensions))
    found[[langs.index(x) for x in sums["lang"]], sums["i"].to_numpy(dtype=np.int64)] = sums["v"]
    found = unit(found) if len(langs) else found
    return langs, unit(found - found.mean(axis=0)) if len(langs) > 1 else found


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """docs with lang_pred and score, (1 + cosine) / 2; lang itself isn't read."""
    weights = prototypes.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(weights.shape[1])
        for batch in batches:
            for part in common.pieces(batch, "text", 1 << 20):
                vectors, n = space.bundle(common.texts_of(part))
                if langs:
                    cosines = unit(vectors) @ weights.T
                    best = cosines.argmax(axis=1)
                    score = np.clip((1 + cosines[np.arange(len(best)), best].astype(np.float64)) / 2, 0, 1)
                    said = np.where(n > 0, np.array(langs, dtype=object)[best], UNDETERMINED)
                else:
                    score, said = np.zeros(len(n)), np.full(len(n), UNDETERMINED, dtype=object)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(said.tolist(), pa.string()), pa.array(np.where(n > 0, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", common.held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, *train(docs))
