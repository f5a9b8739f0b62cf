"""Language identification by hierarchical discrimination.

Byte 3- and 4-grams are hashed into one vector, square-rooted and scaled to length 1. Linear support vector machines
first choose the language family, one against one, and then the language inside it, one against one.

Defined results: a text that is null or has no letter is `und` with score 0; without any labelled row everything is
`und`; a family with one language needs no second decision. Only text and lang of the rows given for training are used.
Training takes at most `per_lang` rows of each language, chosen by a hash of doc_id: a bounded sample. Predictions read
whole texts. Existing columns called lang_pred or score are replaced; other columns pass through.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import utf8

#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
    "semitic": "ar he mt",
    "indic": "bn gu hi mr ne pa ur",
}
BITS = 13
PER_LANG = 400
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    found = _LETTER.search(text)
    return bool(found) and (found[0].isalpha() or any(c.isalpha() for c in text))


def family(lang: str) -> str:
    code = re.split(r"[-_]", lang.lower())[0]
    return next((k for k, v in FAMILIES.items() if code in v.split()), "other")


def vectors(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each text: square roots of hashed n-gram counts, of length 1. Texts are read whole."""
    out = np.zeros((len(at) - 1, 1 << BITS), np.float32)
    shift = np.uint32(32 - BITS)
    for i, (a, b) in enumerate(itertools.pairwise(at.tolist())):
        x = np.frombuffer(data[a:b].tobytes().translate(_TABLE), np.uint8).astype(np.uint32)
        if len(x) < 3:
            x = np.concatenate([x, np.full(3 - len(x), 32, np.uint32)])
        three = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
        four = three[:-1] | x[3:] << np.uint32(24)
        count = np.bincount((three * np.uint32(2654435761)) >> shift, minlength=1 << BITS)
        count += np.bincount((four * np.uint32(2246822519)) >> shift, minlength=1 << BITS)
        row = np.sqrt(count, dtype=np.float32)
        out[i] = row / np.sqrt(np.float32(max(count.sum(), 1)))
    return out


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by accelerated gradient steps; y is 1 or -1."""
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = last = np.zeros(x.shape[1] + 1, np.float32)  # the bias comes last
    step = 1.0 / (1.0 / c + 2.0 * 2.0)
    for k in range(rounds):
        look = w + (k / (k + 3.0)) * (w - last)
        pull = share * y * np.maximum(0, 1 - y * (x @ look[:-1] + look[-1]))
        last, w = w, look - np.float32(step) * (look / np.float32(c) - 2 * np.append(pull @ x, pull.sum()))
        w = w.astype(np.float32)
    return w[:-1], float(w[-1])


@dataclass
class LanguageModel:
    """Pairs of families, and of languages in a family, each with a machine whose positive side is the first."""

    groups: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    @classmethod
    def train(cls, langs: list[str], x: np.ndarray) -> LanguageModel:
        groups: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            groups.setdefault(family(lang), []).append(lang)
        kinds, labels = np.array([family(v) for v in langs]), np.array(langs)
        pairs = [("", a, b) for a, b in itertools.combinations(sorted(groups), 2)]
        pairs += [(g, a, b) for g in sorted(groups) for a, b in itertools.combinations(groups[g], 2)]
        found = []
        for g, a, b in pairs:
            of = labels if g else kinds
            rows = (of == a) | (of == b)
            found.append(svm(x if rows.all() else x[rows], np.where(of[rows] == a, 1, -1).astype(np.float32)))
        if not found:
            return cls(groups)
        return cls(groups, pairs, np.stack([w for w, _ in found], 1), np.array([b for _, b in found], np.float32))

    def _decide(self, margins: np.ndarray, group: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Votes, then summed margins; the score is the winner's least certain duel."""
        n = len(margins)
        votes, sums, least = np.zeros((n, len(names))), np.zeros((n, len(names))), np.ones((n, len(names)))
        for k, (g, a, b) in enumerate(self.pairs):
            if g == group and a in names:
                sure = 1 / (1 + np.exp(-4 * margins[:, k].clip(-8, 8).astype(float)))
                for name, p in ((a, sure), (b, 1 - sure)):
                    i = names.index(name)
                    votes[:, i] += p > 0.5
                    sums[:, i] += p
                    least[:, i] = np.minimum(least[:, i], p)
        best = (votes * 1000 + sums).argmax(1)
        return best, least[np.arange(n), best]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.groups:
            return ["und"] * len(x), np.zeros(len(x))
        margins = x @ self.weights + self.bias
        kinds = sorted(self.groups)
        kind, score = self._decide(margins, "", kinds)
        out = [""] * len(x)
        for i, name in enumerate(kinds):
            rows = np.flatnonzero(kind == i)
            lang, p = self._decide(margins[rows], name, self.groups[name])
            score[rows] *= p
            for r, j in zip(rows.tolist(), lang.tolist(), strict=True):
                out[r] = self.groups[name][j]
        return out, score


def fit(labelled: DataFrame, per_lang: int = PER_LANG) -> LanguageModel:
    """Trains on at most per_lang rows of each language of labelled (doc_id, text, lang). Two reads: counts, then the sample."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel()
    key = F.xxhash64(F.lit("langid"), F.col("doc_id").cast("string"))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.5 * (per_lang + 20) / n))])
    near = rows.where(F.pmod(key, F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    found = near.select("lang", "text", key.alias("key")).mapInArrow(_packed, "lang string, key long, at binary, v binary").collect()
    kept: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["key"], r["at"], r["v"])):
        kept.setdefault(r["lang"], []).append(r)
    chosen = [r for v in kept.values() for r in v[:per_lang]]
    del found, kept
    x = np.zeros((len(chosen), 1 << BITS), np.float32)
    for i, r in enumerate(chosen):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["v"], np.float32)
    return LanguageModel.train([r["lang"] for r in chosen], x)


def _packed(batches):
    """The vectors of texts without their zeros: bounded by 2 ** BITS numbers, whatever the text's length."""
    import pyarrow as pa

    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            rows = [(np.flatnonzero(v).astype(np.uint16), v) for v in vectors(*utf8(part.column("text")))]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("key"), pa.array([i.tobytes() for i, _ in rows], pa.binary()), pa.array([v[i].tobytes() for i, v in rows], pa.binary())], names=["lang", "key", "at", "v"])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score; texts are the only input of a prediction."""
    kept = docs.drop("lang_pred", "score")

    def predict(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                text = part.column("text")
                names, score = model.predict(vectors(*utf8(text)))
                for i, t in enumerate(text):
                    if not t.is_valid or not has_letter(t.as_py()):
                        names[i], score[i] = "und", 0.0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(predict, T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
