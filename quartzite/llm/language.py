"""Language identification by a string kernel: the blended-spectrum presence kernel, Nyström landmarks, and one-versus-
rest kernel ridge regression.

Two texts are as alike as the share of distinct letter n-grams (n = 1, 2, 3) that both have: |A and B| / sqrt(|A| |B|).
Bounded, labelled landmarks span the feature space: k(x, landmarks) K^(-1/2). Ridge regression of 0/1 targets for each
language on these features gives weights; a batch of texts is scored by two matrix products, presence x landmarks, and
kernel x weights.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzite.llm.common import row_groups, small_batches

#: Bounds of the fit: labelled texts in all, of them landmarks, and n-grams of all landmarks together (beyond a landmark for each language).
SAMPLE, LANDMARKS, GRAMS = 1600, 256, 200_000
#: Characters of a text that are turned to n-grams at a time, and flags for the n-grams that its letters could make.
PIECE, FLAGS = 1_000_000, 1 << 22
RIDGE = 1e-3
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)


class Grams:
    """Presence of letter n-grams, n = 1 to 3, over an alphabet of classes: 0 for what is no letter, 1 for letters outside the alphabet.

    An n-gram is a number: its classes as digits, behind all shorter ones.
    """

    def __init__(self, alphabet: str):
        self.size = len(alphabet) + 2
        self.classes = _letters().astype(np.int32)
        for k, c in enumerate(alphabet):
            self.classes[ord(c)] = k + 2
        self.width = self.size + self.size**2 + self.size**3

    def codes(self, text: str) -> np.ndarray:
        """A text's distinct n-grams, ascending; none if it has no letter. What is all outside letters says nothing and isn't one."""
        c = self.classes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        flags = np.zeros(self.size, bool)
        flags[c] = True
        here = np.flatnonzero(flags)
        if not here.any():
            return np.zeros(0, np.int64)
        # numbers over the text's own classes are small: flags for all that there could be
        n, m = self.size, len(here)
        digit = np.zeros(n, np.int32)
        digit[here] = np.arange(m, dtype=np.int32)
        if m**3 <= FLAGS:
            twos, threes = np.zeros(m * m, bool), np.zeros(m**3, bool)
            for k in range(0, len(c), PIECE):
                d = digit[c[k : k + PIECE + 2]]
                two = d[:-1] * m + d[1:]
                twos[two] = True
                threes[two[:-1] * m + d[2:]] = True
            twos, threes = np.flatnonzero(twos), np.flatnonzero(threes)
        else:
            found: list[list[np.ndarray]] = [[], []]
            for k in range(0, len(c), PIECE):
                d = digit[c[k : k + PIECE + 2]].astype(np.int64)
                two = d[:-1] * m + d[1:]
                found[0].append(np.unique(two))
                found[1].append(np.unique(two[:-1] * m + d[2:]))
            twos, threes = (np.unique(np.concatenate(f)) for f in found)
        a, b = np.divmod(threes, m)
        twos, threes = here[twos // m] * n + here[twos % m], (here[a // m] * n + here[a % m]) * n + here[b]
        return np.concatenate([here[here > 0], twos[twos > 0] + n, threes[threes > 0] + n + n * n])

    def fill(self, text: str, flags: np.ndarray) -> bool:
        """Sets the flags of a text's n-grams; whether it has a letter."""
        found = self.codes(text)
        flags[found] = True
        return len(found) > 0


class LanguageModel:
    """The kernel machine: alphabet, the n-grams of the landmarks, landmark rows, weights and languages."""

    def __init__(self, alphabet: str, codes: list[np.ndarray], labels: list[str], landmarks: int, ridge: float):
        self.alphabet, self.languages = alphabet, sorted(set(labels))
        order = np.argsort([hash_of(i) for i in range(len(codes))], kind="stable")
        taken: list[int] = []
        rows = {lang: [i for i in order if labels[i] == lang] for lang in self.languages}
        self.grams = np.zeros(0, np.int64)
        while len(taken) < min(landmarks, len(codes)) and (len(taken) < len(self.languages) or len(self.grams) < GRAMS):
            for lang in self.languages:  # in turn, so that each language has its share
                if rows[lang] and len(taken) < landmarks:
                    taken.append(rows[lang].pop(0))
            self.grams = np.unique(np.concatenate([self.grams, *(codes[i] for i in taken[-len(self.languages) :])]))
        self.rows = self._unit([codes[i] for i in taken])
        kernel = (self.rows @ self.rows.T).astype(np.float64)
        value, vector = np.linalg.eigh(kernel)
        keep = value > 1e-6 * value[-1]
        root = vector[:, keep] / np.sqrt(value[keep])
        phi = np.concatenate([(self._unit(codes[k : k + 64]) @ self.rows.T).astype(np.float64) @ root for k in range(0, len(codes), 64)])
        target = np.array([[label == lang for lang in self.languages] for label in labels], float)
        weight = np.sqrt(1.0 / np.array([labels.count(x) for x in labels]))[:, None]  # languages weigh the same
        left, right = phi * weight, target * weight
        solved = np.linalg.solve(left.T @ left + ridge * np.eye(phi.shape[1]), left.T @ right)
        self.weights = (root @ solved).astype(np.float32)

    def _unit(self, codes: list[np.ndarray]) -> np.ndarray:
        """Presence rows over the landmarks' n-grams, divided by the root of each text's whole count."""
        out = np.zeros((len(codes), len(self.grams)), np.float32)
        for r, c in zip(out, codes, strict=True):
            if not len(c):
                continue
            at = np.minimum(np.searchsorted(self.grams, c), len(self.grams) - 1)
            r[at[self.grams[at] == c]] = 1 / np.sqrt(len(c))
        return out

    def predict(self, texts: list[str | None], grams: Grams, step: int = 64) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for k in range(0, len(texts), step):
            codes = [grams.codes(t) if t else np.zeros(0, np.int64) for t in texts[k : k + step]]
            value = (self._unit(codes) @ self.rows.T) @ self.weights
            langs += [self.languages[b] if len(c) else UNKNOWN for b, c in zip(value.argmax(1), codes, strict=True)]
            scores += [float(min(1.0, max(0.0, v))) if len(c) else 0.0 for v, c in zip(value.max(1), codes, strict=True)]
        return langs, scores


def hash_of(i: int) -> int:
    return (i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF


def fit(labelled: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Fits on at most `sample` labelled texts, the same number of each language as far as there are; None without any.

    The choice hangs on a hash of the id alone. Rows whose text or language is null don't take part.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not sizes:
        return None
    each = max(1, sample // len(sizes))
    # a hash threshold first leaves little more than is needed of each language, then its smallest hashes are taken
    spark = labelled.sparkSession
    share = F.broadcast(spark.createDataFrame([(k, min(1.0, 2.0 * each / n + 64.0 / n)) for k, n in sizes.items()], "lang string, share double"))
    dice = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    taken = rows.join(share, "lang").where(dice < F.col("share")).withColumn("dice", dice)
    taken = taken.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("dice", "id", "text"))).where(F.col("k") <= each)

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for _, texts in row_groups(batches, "text"):
            for t in texts:
                seen.update(t.lower())
        yield pa.RecordBatch.from_arrays([pa.array([c for c in seen if c.isalpha()], pa.string())], ["letter"])

    taken = taken.select("id", "lang", "text").persist()
    found = taken.mapInArrow(letters, "letter string").distinct()  # of a bounded sample, and of what Unicode has
    alphabet = "".join(sorted(r["letter"] for r in found.collect()))
    if not alphabet:
        taken.unpersist()
        return None

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(alphabet)
        for part, texts in row_groups(batches, "text"):
            out = [grams.codes(t).astype("<i8").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("lang"), pa.array(out, pa.binary())], ["id", "lang", "codes"])

    kind = labelled.schema[id_col].dataType.simpleString()
    got = sorted(taken.mapInArrow(codes, f"id {kind}, lang string, codes binary").where("length(codes) > 0").collect(), key=lambda r: (r["lang"], str(r["id"]), r["codes"]))
    taken.unpersist()
    if not got:
        return None
    return LanguageModel(alphabet, [np.frombuffer(r["codes"], "<i8") for r in got], [r["lang"] for r in got], landmarks, ridge)


def predict(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score added: `und` and 0 where the text is null or has no letter, or nothing was learned.

    Only the text is looked at. A text's letters are all read. score is the winner's ridge value held within 0 and 1.
    Columns of docs with the new names are replaced.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: LANDMARKS rows of n-grams, of which there are GRAMS and one text for each language at most
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    base = docs.select(*kept)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in base.schema.fields)}, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        grams = Grams(model.alphabet) if model else None
        for part, texts in row_groups(batches, text_col):
            langs, scores = model.predict(texts, grams) if model else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    return base.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 4, is 2: documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with held_out, lang_pred and score: learned from the labelled documents that aren't held out, told from texts alone."""
    model = fit(docs.where(~held_out(id_col)), id_col=id_col, **options)
    return predict(docs.withColumn("held_out", held_out(id_col)), model)
