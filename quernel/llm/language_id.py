"""Language identification with error-correcting output codes.

Each language gets a codeword; one binary n-gram classifier per code bit scores a text, and loss-weighted decoding
picks the nearest codeword. Evidence grows with the square root of a text's n-grams, so the gap between the two nearest
codewords is measured in units of it; a small gap is flagged as ambiguous: mixed texts, and other languages than those
learned. A text whose n-grams give no bit's classifier any evidence to speak of is in none of the languages.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.shared import in_slices

UNDETERMINED = "und"


@dataclass(frozen=True)
class Params:
    dims: int = 1 << 14  #: hashed n-gram features
    per_lang: int = 4000  #: training documents per language, about; the bound of the sample
    dense_bits: int = 48  #: code length for more than 6 languages
    ambiguous_below: float = 1.0  #: least gap between the losses of the two nearest codewords, per root of the n-grams
    least_evidence: float = 0.45  #: log odds an n-gram of the bit that tells most, below which a text is in no learned language
    smooth: float = 2e-5


_LETTERS = np.array([c if chr(c).isalpha() else 32 for c in range(128)], dtype=np.uint32)


def features(text: str, dims: int) -> np.ndarray:
    """Counts of hashed character 1-, 2- and 3-grams of the whole lower-cased text; ASCII non-letters are spaces."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
    c = np.where(c < 128, _LETTERS[c & 127], c)
    shift = np.uint32(32 - (dims.bit_length() - 1))
    a = c * np.uint32(2654435761)
    two = (a[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
    three = (two[:-1] + c[2:] * np.uint32(668265263)) * np.uint32(374761393) if len(c) > 2 else two[:0]
    two = two[~((c[:-1] == 32) & (c[1:] == 32))]
    return np.bincount(np.concatenate([a[c != 32] >> shift, two >> shift, three >> shift]), minlength=dims)


def codewords(n: int, dense_bits: int) -> np.ndarray:
    """n rows of +1/-1: the exhaustive code for up to 6 languages, else a fixed dense random code."""
    if n <= 6:
        bits = [[1] + [1 if (col >> k) & 1 else -1 for k in range(n - 1)] for col in range(max(0, 2 ** (n - 1) - 1))]
        return np.array(bits, dtype=np.float64).reshape(len(bits), n).T
    rng = np.random.default_rng(20240229)
    while True:
        code = rng.choice([-1.0, 1.0], size=(n, dense_bits))
        split = (np.abs(code.sum(axis=0)) < n).all()
        apart = min(int((code[i] != code[:i]).sum(axis=1).min()) for i in range(1, n))
        if split and apart >= max(1, dense_bits // 5):
            return code
        dense_bits += n > 128  # many languages need a longer code to stay apart


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray  #: dims x bits, log odds
    bit_weight: np.ndarray  #: how well each bit's two sides are told apart
    params: Params

    def judge(self, text: str | None) -> tuple[str, float, bool, bool]:
        """(language, score, ambiguous, foreign); `und`, 0, True, True if there is no text, no letter in it or no model."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False, False
        x = features(text, self.params.dims)
        root = np.sqrt(x.sum())
        z = x @ self.weights / root
        loss = np.logaddexp(0.0, -self.code * z) @ self.bit_weight
        order = np.argsort(loss, kind="stable")
        p = np.exp(loss[order[0]] - loss)
        ambiguous = bool(loss[order[1]] - loss[order[0]] < self.params.ambiguous_below * root)
        return self.langs[order[0]], float(1 / p.sum()), ambiguous, bool(np.abs(z).max() < self.params.least_evidence * root)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        return self.judge(text)[:3]


def _model(counts: dict[str, np.ndarray], p: Params) -> Model:
    langs = tuple(sorted(counts))
    code = codewords(len(langs), p.dense_bits)
    if not langs or not code.shape[1]:
        return Model(langs, code, np.zeros((p.dims, 0)), np.zeros(0), p)
    rate = np.array([counts[x] / max(1, counts[x].sum()) for x in langs])
    weights, apart = [], []
    for bit in code.T:
        pos, neg = rate[bit > 0].mean(axis=0) + p.smooth, rate[bit < 0].mean(axis=0) + p.smooth
        weights.append(np.log(pos / neg))
        mid = (pos + neg) / 2
        apart.append((pos @ np.log(pos / mid) + neg @ np.log(neg / mid)) / 2)  # Jensen-Shannon divergence
    apart = np.array(apart)
    return Model(langs, code, np.array(weights).T, len(apart) * apart / apart.sum() if apart.sum() else np.ones(len(apart)), p)


def fit(labelled: DataFrame, params: Params = Params()) -> Model:
    """Fits on (doc_id, text, lang); rows without text or lang teach nothing.

    The sample holds about params.per_lang documents of each language, chosen by a hash of the id and the text; its
    whole texts are counted on executors, and only one compressed vector of fixed size per language and task reaches the
    driver. Every value of lang is learned, however many there are.
    """
    rows = labelled.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return _model({}, params)
    chosen = rows
    if often := {k: params.per_lang / n for k, n in sizes.items() if n > params.per_lang}:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(y) for kv in often.items() for y in kv]), F.col("lang")), F.lit(1.0))
        chosen = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share * (1 << 20))
    dims = params.dims

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in in_slices(batches, 0):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = features(text, dims)
                total[lang] = total[lang] + x if lang in total else x
        for lang, x in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": [zlib.compress(x.astype(np.int64).tobytes(), 1)]}, schema=pa.schema([("lang", pa.string()), ("counts", pa.binary())]))

    counts: dict[str, np.ndarray] = {}
    tasks = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-params.per_lang * len(sizes) // 500)))
    for r in chosen.select("text", "lang").repartition(tasks).mapInArrow(count, "lang string, counts binary").toLocalIterator():
        x = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int64)
        counts[r["lang"]] = counts[r["lang"]] + x if r["lang"] in counts else x
    return _model(counts, params)


def held_out(doc_id) -> F.col:
    """True for the documents no model learns from: crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row; only the text decides. Repeated rows give repeated rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = shared.value
        for b in in_slices(batches):
            said = [m.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64()), pa.array([x[2] for x in said], pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def language_id(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Fits on the documents that are not held out and labels all: doc_id, held_out, lang_pred, score, ambiguous.

    Null, empty or letterless text is `und` with score 0. Without any labelled row all texts are `und`. Equal texts are
    judged alike, ties go to the first language in order of its name, very long texts count whole, an empty table gives
    an empty one. Other columns of docs are ignored.
    """
    model = fit(docs.filter(~held_out(F.col("doc_id"))), params)
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents in one of the learned languages, with their own columns; `und` ones go, whatever their label, and
    so do those that are ambiguous and far from every codeword.

    Null, empty and letterless texts go, and all rows where no document has a label. Repeated rows are judged alike.
    """
    model = fit(docs.filter(~held_out(F.col("doc_id"))), params)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for b in in_slices(batches, at):
            yield b.filter(pa.array([not m.judge(t)[3] for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
