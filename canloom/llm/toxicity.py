"""Toxicity by noisy-channel deobfuscation.

A word that looks disguised (signs or digits among letters, letters three times in a row, letters set apart)
is a lattice: each observed character may stand for itself, for the letters it resembles, for nothing if it
parts letters, for a blank if it parts words, and a run of one letter for one or two of it. Viterbi decoding under a character trigram model
with channel costs restores the likeliest word. A logistic model over restored words and their beginnings
then scores the text.

* The character model is counted over all documents, whatever their language.
* Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0, on at most ``SAMPLE`` rows of
  each label (the smallest hashes of doc_id), each with the weight of the rows that it stands for, so that the share
  learnt is that of all learnable labels at every size. Features are the text alone.
* Null and empty texts have no words and get the score of the intercept. Without labelled rows, or with one
  label only, every score is that label's share (0 without any). Labels that repeat a doc_id: the largest counts.
* Documents that repeat a labelled doc_id: the first by text is learnt from; repeated rows are scored alike. An empty table
  gives no rows. Very long texts are scored over all their words; words that a task remembers are bounded. Columns of docs
  that clash with ours keep their names and values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from canloom.llm.common import fresh_name, materialize, scratch, small_batches
from canloom.llm.quality import BITS, _counter, KneserNey, symbols

#: Labelled rows of each label that the classifier is fitted on, at most.
SAMPLE = 4000
FOLDS, HELD = 5, 0
#: Hash space of features, and the features a model keeps at most.
SPACE, FEATURES = 1 << 22, 4000
#: Words whose features a task remembers.
REMEMBERED = 100_000
#: New words that are looked at together, and letters of those that are taken as columns of bytes.
TOGETHER, SHORT = 20_000, 32

#: What a sign or digit may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Bits that a stand-in, a dropped sign, a sign as a blank and a shortened run cost.
STAND_IN, DROPPED, PARTED, SHORTENED = 1.0, 1.0, 1.0, 0.5

_APART = re.compile(r"(?<!\S)(?:(?:[^\W_]|[@$!|+(€£])[ \t._*\-]+){2,}(?:[^\W_]|[@$!|+(€£])(?![^\W_])")
_EDGE = re.compile(r"^[^\w@$!|+€£]+|[\W_]+$")
#: The edge less the stand-ins at the end.
_BARE = re.compile(r"^[^\w@$!|+€£]+|(?:(?![@$!|+(€£])[\W_])+$")
_ODD = re.compile(r"[^\w]|[\d_]|(\w)\1\1")
_LETTER = re.compile(r"[^\W\d_]")


class Restorer:
    """Decodes disguised words under the character model."""

    def __init__(self, model: KneserNey | None):
        size = 1 << BITS
        cube = np.full(size**3, -float(BITS)) if model is None else np.log2(np.maximum(model.probability(np.arange(size**3)), 1e-12))
        self.cube = cube.reshape(size, size, size).astype(np.float32)
        self.of: dict[str, int] = {}

    def symbol(self, c: str) -> int:
        if c not in self.of:
            self.of[c] = int(symbols(c)[0])
        return self.of[c]

    @staticmethod
    def lattice(word: str) -> list[list[tuple[str, float]]]:
        out, i = [], 0
        while i < len(word):
            c, n = word[i], 1
            while i + n < len(word) and word[i + n] == c:
                n += 1
            if c.isalpha():
                out.append([(c, 0.0 if n == 1 else SHORTENED)] + [(c + c, 0.0 if n == 2 else SHORTENED)] * (n > 1))
            else:
                options = [(x, STAND_IN) for x in LOOKS.get(c, "")] + [(x + x, STAND_IN) for x in LOOKS.get(c, "") if n > 1]
                if not c.isdigit():
                    options += [("", DROPPED), (" ", PARTED)]
                out.append(options or [(c, 0.0)])
            i += n
        return out

    def decode(self, word: str, ending: bool = False) -> str:
        """The likeliest word; with ``ending``, a stand-in at the end must stand for letters."""
        blank = self.symbol(" ")
        # values with the way that led there, as (what came before, letters)
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, blank): (0.0, None)}
        lattice = self.lattice(word)
        if ending:
            lattice[-1] = [o for o in lattice[-1] if o[0].strip()] or lattice[-1]
        for options in lattice:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (value, way) in best.items():
                for letters, cost in options:
                    x, y, v = a, b, value - cost
                    for c in letters:
                        s = self.symbol(c)
                        v += float(self.cube[x, y, s])
                        x, y = y, s
                    if (x, y) not in new or new[x, y][0] < v:
                        new[x, y] = (v, (way, letters))
            best = new
        way, text = max(((v + float(self.cube[a, b, blank]), w) for (a, b), (v, w) in best.items()), key=lambda x: x[0])[1], []
        while way:
            way, letters = way
            text.append(letters)
        return "".join(reversed(text))

    def _read(self, word: str) -> str:
        if word.isalpha():
            return self.decode(word) if _ODD.search(word) else word
        return self.decode(word) if _LETTER.search(word) else ""

    def restore(self, word: str) -> str:
        """The word in small letters, restored if it looks disguised; several words have blanks between."""
        return self._read(_EDGE.sub("", word.lower()))

    def readings(self, word: str) -> set[str]:
        """All words that a token may be: restored, its parts by blanks, and with the stand-ins at its end."""
        low = word.lower()
        if low.isalpha() and not _ODD.search(low):
            return {low}  # letters alone have no edge, and are read as they are
        shorn = _EDGE.sub("", low)
        bare = shorn if len(shorn) == len(low) else _BARE.sub("", low)
        if bare == shorn and shorn.isalpha() and not _ODD.search(shorn):
            return {shorn}
        found = set()
        for text in [self._read(shorn), *([self.decode(bare, True)] if bare != shorn and _LETTER.search(bare) else [])]:
            parts = text.split()
            found.update(parts)
            if len(parts) > 1:
                found.add("".join(parts))
        return found


def words_of(text: str) -> set[str]:
    """The distinct words of a text, those set apart letter by letter also as one."""
    found = set(text.split())
    for m in _APART.finditer(text):
        found.add(re.sub(r"[ \t._*\-]", "", m[0]))
    return found


def features(word: str) -> list[int]:
    if len(word) < 3:
        return []
    raw = word.encode()
    ends = range(4, min(len(word), 8)) if len(raw) == len(word) else [len(word[:n].encode()) for n in range(4, min(len(word), 8))]
    out, held, at = [crc32(raw) % SPACE], 0, 0
    for end in ends:  # each beginning goes on from the one before
        held, at = crc32(raw[at:end], held), end
        out.append(crc32(b"*", held) % SPACE)
    return out


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()


def plain_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``features`` of words of up to SHORT ASCII letters in small letters, a row each (-1: none), and whether each has a letter
    three times in a row. The crc32 of all words goes on by a letter at a time."""
    flat = np.frombuffer(("\n".join(words).lower() + "\n").encode(), np.uint8)
    end = np.flatnonzero(flat == 10)
    start = np.concatenate(([0], end[:-1] + 1))
    size = end - start
    line = np.append(flat, np.zeros(SHORT, np.uint8))
    out = np.full((len(words), 5), -1, np.int64)
    odd, state, last = np.zeros(len(words), bool), np.full(len(words), 0xFFFFFFFF, np.uint32), []
    step = lambda s, c: _CRC[(s ^ c) & 255] ^ (s >> 8)
    for j in range(int(size.max())):
        there, c = j < size, line[start + j]
        state = np.where(there, step(state, c), state)
        last = [*last[-2:], c]
        if j >= 2:
            odd |= there & (last[0] == c) & (last[1] == c)
        if 4 <= j + 1 <= 7:
            longer = size > j + 1
            out[longer, j - 2] = (~step(state[longer], np.uint32(42))) % SPACE
    known = size >= 3
    out[known, 0] = ~state[known] % SPACE
    return out, odd


def features_of(words: set[str]) -> list[int]:
    return sorted({x for w in words for x in features(w)})


class Model:
    """A logistic model over the features kept; ``weights`` by feature.

    Rows are the stretches of ``values`` (features below SPACE, distinct in a row) between ``offsets``; a row of label y
    stands for ``stands_for[y]`` rows.
    """

    def __init__(self, values: np.ndarray, offsets: np.ndarray, labels: np.ndarray, stands_for: tuple[float, float] = (1.0, 1.0)):
        self.weights: dict[int, float] = {}
        positive = int(labels.sum())
        if not positive or positive == len(labels):
            self.bias = 36.0 if positive else -36.0
            return
        rows, toxic = np.repeat(np.arange(len(labels)), np.diff(offsets)), np.repeat(labels == 1, np.diff(offsets))
        bad, good = np.bincount(values[toxic], minlength=SPACE), np.bincount(values[~toxic], minlength=SPACE)
        # features of toxic rows that are surer than chance, the surest first
        found = np.flatnonzero(bad >= 3)
        k, g = bad[found] + 0.5, good[found] + 0.5
        p, q = k / (positive + 1), g / (len(labels) - positive + 1)
        z = np.log(p / q) / np.sqrt(1 / k + 1 / g)
        sure = (z > 2) & (p > 2 * q)
        kept = found[sure][np.argsort(-z[sure], kind="stable")][:FEATURES]
        place = np.full(SPACE, -1, np.int32)
        place[kept] = np.arange(len(kept))
        own = place[values]
        at, own = rows[own >= 0], own[own >= 0]
        weight = np.where(labels == 1, stands_for[1], stands_for[0])
        weight = weight / weight.sum()
        w, b = np.zeros(len(kept)), float(np.log(weight[labels == 1].sum() / weight[labels != 1].sum()))
        gw, gb = np.full(len(kept), 1e-6), 1e-6
        for _ in range(300):
            margin = b + np.bincount(at, w[own], len(labels))
            error = (1 / (1 + np.exp(-np.clip(margin, -36, 36))) - labels) * weight
            g = np.bincount(own, error[at], len(kept)) + 1e-4 * w
            gw += g * g
            gb += error.sum() ** 2
            w -= 0.5 * g / np.sqrt(gw)
            b -= 0.5 * error.sum() / np.sqrt(gb)
        self.bias, self.weights = float(b), dict(zip(kept.tolist(), w.tolist()))


def learnable(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS != HELD


def character_model(docs: DataFrame) -> KneserNey | None:
    """Trigrams of all texts in small letters."""
    lower = docs.select(F.lit("").alias("lang"), F.lower("text").alias("text")).where("text <> ''")
    counts = lower.mapInArrow(_counter(3, every=True), "lang string, code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most 2**18 rows
    code, n = (table.column(k).to_numpy() for k in range(2))
    order = np.argsort(code)
    return KneserNey(code[order], n[order], 3) if len(code) else None


def learnt(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of all labels that may be learnt from."""
    return labels.where("doc_id is not null and toxic is not null").where(learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sample(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the rows that the classifier is fitted on."""
    known = learnt(labels)
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def surest(rows: DataFrame) -> list[int]:
    """The features that a model of rows(toxic, features) may keep, and some more: so many numbers, whatever the texts."""
    n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"), F.count("*").alias("all")).first()
    seen = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).where("bad >= 3")
    k, g = F.col("bad") + 0.5, F.col("good") + 0.5
    lift = F.log(k / (n.bad + 1) / (g / (n["all"] - n.bad + 1)))
    z = lift / F.sqrt(1 / k + 1 / g)
    # a little slack: the model decides
    return sorted(r.feature for r in seen.where((z > 1.9) & (lift > 0.65)).orderBy(z.desc(), "feature").limit(FEATURES + FEATURES // 8).select("feature").collect())


def fit(docs: DataFrame, labels: DataFrame, restorer) -> Model:
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample(labels)), "doc_id")
    # 2 * SAMPLE rows at most: of rows that share a doc_id the first by text
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", F.xxhash64("doc_id", "text").alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, known = restorer.value, {}
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                own = set()
                for w in words_of(text):
                    if (f := known.get(w)) is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        f = known[w] = features_of(r.readings(w))
                    own.update(f)
                rows.append(sorted(own))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), batch.column(1), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "row", "features"])

    with scratch(docs.sparkSession):
        # a bounded table: however many partitions a shuffle has, it is a few files
        every = materialize(chosen.mapInArrow(run, "toxic int, row long, features array<int>"), "features", narrow=True)
        kept = surest(every)
        table = every.select("toxic", "row", F.array_intersect("features", F.array(*map(F.lit, kept)).cast("array<int>")).alias("features")).orderBy("row", "toxic").toArrow().combine_chunks()
    if not table.num_rows:
        return Model(np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0, np.int64))
    lists = table.column("features").chunk(0)
    known = {r.toxic: r.n for r in learnt(labels).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    stands_for = tuple(max(1.0, known.get(y, 0) / SAMPLE) for y in (0, 1))
    return Model(lists.values.to_numpy(), lists.offsets.to_numpy(), table.column("toxic").to_numpy().astype(np.int64), stands_for)


def score(docs: DataFrame, labels: DataFrame, column: str = "toxicity") -> DataFrame:
    """docs with a column more, the likelihood of label 1."""
    spark = docs.sparkSession
    small_batches(spark)
    restorer = spark.sparkContext.broadcast(Restorer(character_model(docs)))
    model = spark.sparkContext.broadcast(fit(docs, labels, restorer))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, m, known = restorer.value, model.value, {}
        kept = np.zeros(SPACE + 1, bool)  # the last place is what -1 means
        kept[list(m.weights)] = True

        def learn(new: set[str]) -> None:
            words = [w for w in new if len(w) <= SHORT and w.isascii() and w.isalpha()]
            if words:
                made, odd = plain_features(words)
                known.update(dict.fromkeys(words, ()))
                found = kept[made]
                for i in np.flatnonzero(found.any(axis=1) & ~odd).tolist():
                    known[words[i]] = tuple(made[i][found[i]].tolist())
                new = new.difference(words).union(words[i] for i in np.flatnonzero(odd).tolist())
            for w in new:
                known[w] = tuple(x for x in features_of(r.readings(w)) if x in m.weights)

        def margins(texts: list[str | None]) -> Iterator[float]:
            waiting, new = [], set()
            for i, text in enumerate(texts, 1):
                waiting.append(words_of(text) if text else ())
                new.update(w for w in waiting[-1] if w not in known)
                if len(new) >= TOGETHER or i == len(texts):
                    learn(new)
                    for words in waiting:
                        own = {x for w in words if (f := known[w]) for x in f}
                        yield m.bias + sum(m.weights[x] for x in sorted(own))
                    waiting, new = [], set()
                    if len(known) >= REMEMBERED:
                        known.clear()

        for batch in batches:
            margins_ = list(margins(batch.column(at).to_pylist()))
            value = 1 / (1 + np.exp(-np.clip(np.array(margins_, np.float64), -36, 36)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], [*batch.schema.names, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that are predicted toxic."""
    name = fresh_name(docs, "toxicity")
    return score(docs, labels, name).where(F.col(name) < 0.5).drop(name)
