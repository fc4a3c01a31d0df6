"""Language identification (operator 9): a family first, then one-versus-one linear SVMs within it.

Features are the relative frequencies of hashed byte trigrams of the whole text (A-Z folded, runs of other than letters as one
space). A linear model's value is then the mean of its weights over the text's trigrams, so prediction is one gather for each
model and needs no feature vectors. Family models are one against the rest; in a family each pair of languages has an SVM,
and the language with the most won pairs (ties: largest sum of margins, then the name) is predicted.

Training: PER_LANGUAGE labelled documents of each language at most, drawn by the smallest hashes of their ids (ties: of their texts), so
the sample's size depends on the number of languages and not on the input's. Of these the whole texts are learned: each is cut in
pieces of PIECE characters, which are dealt in turn to PIECES vectors of frequencies, and only these leave the executors. SVMs are
fitted by averaged stochastic subgradient steps on the hinge loss with a fixed order: results repeat.

Filtering also drops what the predicted language doesn't fit: a text whose mean log-probability of trigrams there is far below
that of the language's own texts. Half of the sample's vectors give the probabilities and the other half the border: the lowest
of them or FAR standard deviations below their mean, whichever is lower, as for texts of PIECE characters, and for shorter texts
more by the square root of their length. A language of fewer than JUDGED vectors rejects nothing; without labels all texts with
letters stay.

Results: und and score 0 for null, empty and texts without a letter. Languages outside FAMILIES are families of their own.
Without labelled documents everything is und. One labelled language: all texts with letters get it, with score 1. Repeated
rows get the same prediction. Ties of won pairs and of margins go to the name that sorts first. Long texts are read whole. Columns of
the input with the name of a new column are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import append_columns, own_names

#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "semitic": ["ar", "he", "mt"],
}
PER_LANGUAGE = 300
#: A sampled text is cut in pieces of so many characters, which make up so many vectors (one for each piece, if it has fewer).
PIECE = 400
PIECES = 4
#: How far below its language's own texts a text is dropped, and the vectors that a language needs for that.
FAR = 6.0
JUDGED = 40
#: Texts whose trigrams are held at once.
TEXTS_AT_ONCE = 250
BITS = 12
EPOCHS = 8
PENALTY = 1e-5
UND = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Bytes as features see them. ASCII letters in lower case, bytes of other letters as they are, others one space.
FOLD = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts and how many each has (one at least)."""
    folded = [b" " + b" ".join((t or "").encode().translate(FOLD).split()) + b"  " for t in texts]
    size = np.array([len(f) for f in folded]) if folded else np.zeros(0, np.int64)
    b = np.frombuffer(b"".join(folded) + b"  ", np.uint8).astype(np.uint32)
    third = b[2:].copy()
    third[np.cumsum(size) - 1] = 0x20  # not the first letter of the next text
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + third * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int32), size


def vectors(text: str | None) -> list[tuple[int, np.ndarray]]:
    """How many trigrams each of the text's vectors counts, and their numbers; all of the text is in one of them."""
    pieces = [text[k : k + PIECE] for k in range(0, len(text), PIECE)] if text else []
    out = []
    for g in range(min(PIECES, len(pieces))):
        own = pieces[g::PIECES]
        if any(LETTER.search(p) for p in own):
            n = np.zeros(1 << BITS, np.int64)
            for k in range(0, len(own), 1000):  # bounds the memory of trigrams
                h, size = trigrams(own[k : k + 1000])
                n += np.bincount(h[: int(size.sum())], minlength=1 << BITS)
            out.append((int(n.sum()), n))
    return out


def _svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM; y is 1 or -1. Classes weigh the same."""
    scale = 1 / np.sqrt(np.mean(x**2, axis=0) + 1e-8)
    z = x * scale
    z /= max(float(np.sqrt((z**2).sum(1)).mean()), 1e-9)
    norm = scale / max(float(np.sqrt(((x * scale) ** 2).sum(1)).mean()), 1e-9)
    weigh = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32) * len(y)
    w, bias = np.zeros(x.shape[1], np.float32), 0.0
    mean_w, mean_b, steps = np.zeros_like(w), 0.0, 0
    rng = np.random.default_rng(7)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = 4.0 / (1 + epoch)
        for k in range(0, len(order), 64):
            of = order[k : k + 64]
            wrong = y[of] * (z[of] @ w + bias) < 1
            w *= 1 - rate * PENALTY
            if wrong.any():
                g = (y[of] * weigh[of])[wrong] / len(of)
                w += rate * (g @ z[of][wrong])
                bias += rate * 0.1 * float(g.sum())
            if epoch >= EPOCHS // 2:
                mean_w += w
                mean_b += bias
                steps += 1
    return (mean_w / max(steps, 1) * norm).astype(np.float32), mean_b / max(steps, 1)


@dataclass
class Model:
    families: list[list[str]] = field(default_factory=list)
    #: (families or languages of the two sides, weights, bias); a family's other side is None.
    family_models: list[tuple[np.ndarray, float]] = field(default_factory=list)
    pair_models: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    #: Of each language that judges: log-probabilities of trigrams, the mean of its pieces and how far below a text may be.
    borders: dict[str, tuple[np.ndarray, float, float]] = field(default_factory=dict)

    def strange(self, texts: list[str | None], langs: list[str]) -> np.ndarray:
        """Which texts don't fit the language predicted for them."""
        h, size = trigrams(texts)
        ends, out = np.cumsum(size), np.zeros(len(texts), bool)
        for i, lang in enumerate(langs):
            if lang in self.borders:
                logs, mean, far = self.borders[lang]
                own = logs[h[ends[i] - size[i] : ends[i]]]
                out[i] = own.mean(dtype=np.float64) < mean - far * max(1.0, (PIECE / size[i]) ** 0.5)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        h, size = trigrams(texts)
        starts = np.cumsum(size) - size
        value = lambda m: np.add.reduceat(m[0][h[: int(size.sum())]], starts, dtype=np.float64) / size + m[1]
        langs, scores = [UND] * len(texts), [0.0] * len(texts)
        if not self.families or not texts:
            return langs, scores
        if len(self.families) > 1:
            margins = np.stack([value(m) for m in self.family_models])
            family, sure = margins.argmax(0), _sigmoid(np.sort(margins, 0)[-1] - np.sort(margins, 0)[-2])
        else:
            family, sure = np.zeros(len(texts), int), np.ones(len(texts))
        pairs = {p: value(m) for p, m in self.pair_models.items()}
        for i, t in enumerate(texts):
            if not t or not LETTER.search(t):
                continue
            own = self.families[family[i]]
            won = dict.fromkeys(own, (0, 0.0))
            for a, b in combinations(own, 2):
                v = float(pairs[a, b][i])
                for lang, s in ((a, v), (b, -v)):
                    won[lang] = (won[lang][0] + (s > 0), won[lang][1] + s)
            best = min(own, key=lambda k: (-won[k][0], -won[k][1], k))
            least = min((float(pairs[p][i]) * (1 if p[0] == best else -1) for p in combinations(own, 2) if best in p), default=None)
            langs[i] = best
            scores[i] = float(sure[i]) * (1.0 if least is None else float(_sigmoid(np.float64(least))))
        return langs, scores


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(2 * x, -40, 40)))


def fit(rows: list[tuple[str, str]], families: dict[str, list[str]] | None = None) -> Model:
    """A model of labelled texts (language, text)."""
    found = [(lang, size, n) for lang, text in sorted(rows) for size, n in vectors(text)]
    x = np.stack([n / size for _, size, n in found]).astype(np.float32) if found else np.zeros((0, 1 << BITS), np.float32)
    return fitted([lang for lang, _, _ in found], np.array([size for _, size, _ in found]), x, families)


def fitted(labels: list[str], size: np.ndarray, x: np.ndarray, families: dict[str, list[str]] | None = None) -> Model:
    """A model of vectors of relative frequencies, the trigrams that each counts, and their languages."""
    of = {lang: name for name, langs in (families or FAMILIES).items() for lang in langs}
    model = Model()
    if not labels:
        return model
    labels_at = np.array(labels)
    names: dict[str, list[str]] = {}
    for lang in sorted(set(labels)):
        names.setdefault(of.get(lang, lang), []).append(lang)
    model.families = list(names.values())
    for lang in sorted(set(labels)):
        own = np.nonzero(labels_at == lang)[0]
        if len(own) >= JUDGED:
            counts = (x[own[::2]] * PIECE).sum(0, dtype=np.float64) + 0.5
            logs = np.log(counts / counts.sum()).astype(np.float32)
            values = (x[own[1::2]] @ logs).astype(np.float64)
            # a vector of more trigrams is nearer to the mean: as far as one of PIECE would be
            off = (values - values.mean()) * np.sqrt(np.maximum(size[own[1::2]] / PIECE, 1))
            model.borders[lang] = (logs, float(values.mean()), max(FAR * float(off.std()), -float(off.min())))
    if len(names) > 1:
        model.family_models = [_svm(x, np.where(np.isin(labels_at, langs), 1, -1).astype(np.float32)) for langs in model.families]
    for langs in model.families:
        for a, b in combinations(langs, 2):
            of_pair = np.isin(labels_at, [a, b])
            model.pair_models[a, b] = _svm(x[of_pair], np.where(labels_at[of_pair] == a, 1, -1).astype(np.float32))
    return model


def sample(docs: DataFrame, labelled: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """The vectors of at most PER_LANGUAGE documents of each language, by the smallest hashes of their ids: languages, sizes, frequencies.

    Hashes are counted by their magnitude, to an eighth of a power of two, so the driver gets a few hundred counts for each
    language, whatever the input's size, and reads off about where each language's sample ends. What is left is ranked.
    """
    lang = F.col(lang_col).cast("string")
    rows = docs.where(labelled & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    place = F.xxhash64(F.col(id_col)).bitwiseAND(F.lit((1 << 63) - 1))
    mark = F.floor(F.log2(place.cast("double") + 1) * 8).cast("int")
    counts = rows.groupBy(lang.alias("lang"), mark.alias("mark")).count().collect()
    last, total = {}, {}
    for r in sorted(counts, key=lambda r: r.mark):
        if total.get(r.lang, 0) < PER_LANGUAGE:
            last[r.lang], total[r.lang] = r.mark, total.get(r.lang, 0) + r["count"]
    if not last:
        return [], np.zeros(0, np.int64), np.zeros((0, 1 << BITS), np.float32)
    ends = F.create_map(*[F.lit(x) for pair in sorted(last.items()) for x in pair])
    few = rows.where(mark <= ends[lang]).select(lang.alias("lang"), place.alias("place"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("text"))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "tie"))).where(F.col("rank") <= PER_LANGUAGE)
    kind = pa.struct([("size", pa.int64()), ("at", pa.binary()), ("n", pa.binary())])

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            found = [(size, n, np.nonzero(n)[0]) for size, n in vectors(t.as_py())]
            out.append([{"size": size, "at": at.astype("<u2").tobytes(), "n": (n[at] / size).astype("<f4").tobytes()} for size, n, at in found])
        return pa.StructArray.from_arrays([pa.array(out, pa.list_(kind))], ["vectors"])

    made = append_columns(few, ["text"], run, "vectors array<struct<size: bigint, at: binary, n: binary>>")
    found = made.select("lang", "place", "tie", F.posexplode("vectors").alias("i", "v")).orderBy("lang", "place", "tie", "i").select("lang", "v.size", "v.at", "v.n").toArrow()
    x = np.zeros((found.num_rows, 1 << BITS), np.float32)
    for i, (at, n) in enumerate(zip(found.column("at"), found.column("n"))):
        x[i, np.frombuffer(at.as_py(), "<u2")] = np.frombuffer(n.as_py(), "<f4")
    return found.column("lang").to_pylist(), found.column("size").to_numpy(), x


def identify(docs: DataFrame, labelled: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", families: dict[str, list[str]] | None = None, fitting: bool = False) -> DataFrame:
    """docs with lang_pred and score, learned from the rows of docs where labelled holds (all, if None) and lang_col isn't null.

    fitting: texts that don't fit their language are und with score 0; without any language, lang_pred is null for texts with letters.
    """
    model = fitted(*sample(docs, F.lit(True) if labelled is None else labelled, id_col, text_col, lang_col), families)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for k in range(0, len(texts), TEXTS_AT_ONCE):
            some = texts[k : k + TEXTS_AT_ONCE].to_pylist()
            a, b = sent.value.predict(some)
            if fitting and not sent.value.families:
                a = [None if t and LETTER.search(t) else UND for t in some]
            elif fitting:
                strange = sent.value.strange(some, a).tolist()
                a, b = [UND if s else x for s, x in zip(strange, a)], [0.0 if s else x for s, x in zip(strange, b)]
            langs += a
            scores += b
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return append_columns(docs, [text_col], run, "lang_pred string, score double")


def filtered(docs: DataFrame, **options) -> DataFrame:
    """docs without those in which no language is found or that don't fit the one that is; their columns as they were."""
    rows, at = own_names(docs)
    columns = {k: at[options.pop(k, d)] for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("lang_col", "lang"))}
    found = identify(rows, **columns, **options, fitting=True).where(~F.col("lang_pred").eqNullSafe(UND))
    return found.select(*[F.col(n).alias(c) for c, n in at.items()])
