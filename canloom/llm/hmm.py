"""Language-model scores by a hidden Markov model.

Symbols. The ``FREQUENT`` words that training texts have most often are symbols of their own; all others belong to one of ``CLASSES`` classes by their last three bytes. A rare word's probability is that of its
class, which the hidden states emit, times its own share of the class: (c + 1) / (tokens + words + 1) of the class,
where c is its count over all training documents; one share is left for words never seen.

Training. Baum-Welch over all training documents: each partition runs the forward and backward recursions over its
sequences and gives expected counts, which Spark adds up by symbol. Texts of up to ``STRETCH`` tokens are run whole;
longer ones in stretches of so many, each with ``CONTEXT`` tokens more on both sides, so that the messages at a cut have
forgotten where they began; every token, and every move, cuts included, is counted once.
Scoring. The scaled forward recursion over the whole text gives its exact likelihood under the model.

Counts of rare words stay distributed: pairs (document, rare word) meet them in a join that no frequent word takes
part in, as those are known to every task; so no key is hot but a word that only held-out texts hold.

* Null and empty texts are the end token alone. Rows whose doc_id is null train and aren't held out.
* Rows are told apart by a number that they get as they are written, so repeated rows need no rule. Rare words are joined
  by a 64-bit hash. Very long texts are read, and scored, whole. An empty table gives no rows; other columns of docs
  aren't looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canloom.llm.common import materialize, small_batches, utf8

FOLDS, HELD = 7, 2
STATES, ROUNDS = 8, 6
FREQUENT, CLASSES, TAIL = 16384, 1024, 3
STRETCH, CONTEXT = 1024, 64
#: How much likelier than another a state follows itself before training.
LASTING = 200.0
#: Tokens that one forward or backward run holds.
TOKENS = 1 << 20
#: Words whose counts a task gathers before it hands them on.
GATHERED = 400_000
#: No text has this word: the end of a text.
END = b" "


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def words(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z alone; \x20 and \x09-\x0D


def word_hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for t in utf8(batch.column(0)):
            held.update(words(t))
            held[END] += 1
            if len(held) > GATHERED:
                yield out()
                held.clear()
    if held:
        yield out()


class Lexicon:
    """Symbols and class sizes; bounded whatever the corpus."""

    def __init__(self, heavy: dict[bytes, int], class_tokens: np.ndarray, class_words: np.ndarray):
        self.symbol = {w: i for i, w in enumerate(sorted(heavy))}
        self.log = {w: math.log10(n + 1) for w, n in heavy.items()}
        self.first = len(self.symbol)
        self.size = self.first + CLASSES
        self.room = np.log10(class_tokens + class_words + 1.0)
        self.unigram = np.concatenate(([heavy[w] for w in self.symbol], class_tokens)).astype(np.float64)

    def read(self, text: bytes) -> list[int]:
        """The symbols of a text, with the end."""
        get, first, out = self.symbol.get, self.first, []
        add = out.append
        for w in words(text):
            s = get(w)
            add(first + crc32(w[-TAIL:]) % CLASSES if s is None else s)
        add(self.symbol[END])
        return out


class Model:
    def __init__(self, start: np.ndarray, later: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.later, self.move, self.emit = start, later, move, emit

    @classmethod
    def first(cls, unigram: np.ndarray, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        # states that last: a stretch of text pulls them apart in a round or two, where brief ones would stay alike
        move = rng.uniform(0.5, 1.5, (STATES, STATES)) + LASTING * np.eye(STATES)
        emit = (unigram + 0.5)[:, None] * rng.uniform(0.2, 1.8, (len(unigram), STATES))
        return cls(np.full(STATES, 1 / STATES), np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @classmethod
    def of_counts(cls, start: np.ndarray, later: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Model:
        share = (unigram + 0.5) / (unigram + 0.5).sum()
        emit = emit + 2.0 * share[:, None]
        return cls((start + 0.1) / (start + 0.1).sum(), (later + 0.1) / (later + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(1, keepdims=True), emit / emit.sum(0))

    def expect(self, x: np.ndarray, length: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of stretches x[n, t] (``length`` symbols each, longest first): starts, later starts, moves, emissions; and log-likelihood.

        Only symbols from ``first`` to before ``last`` count, and moves to them; a stretch opens its text where first is 0."""
        opening = first == 0
        n, steps = x.shape
        # states first, stretches last: every step works on long rows
        move = self.move.astype(np.float32)
        back = np.ascontiguousarray(move.T)
        by_step = np.ascontiguousarray(x.T)
        table = self.emit.astype(np.float32)
        live = np.searchsorted(-length, -np.arange(steps + 1)).tolist()  # stretches with more than t symbols
        alpha, emitted = np.empty((steps, STATES, n), np.float32), np.empty((steps, STATES, n), np.float32)
        scale = np.ones((steps, n), np.float32)
        for t in range(steps):
            k = live[t]
            emitted[t, :, :k] = table[by_step[t, :k]].T
            if t:
                a = back @ alpha[t - 1, :, :k]
                a *= emitted[t, :, :k]
            else:
                a = np.where(opening, self.start[:, None], self.later[:, None]).astype(np.float32) * emitted[0]
            np.sum(a, axis=0, out=scale[t, :k])
            np.divide(a, scale[t, :k], out=alpha[t, :, :k])
        every = not first.any() and (last == length).all()

        def own_at(t: int, k: int):
            return np.float32(1) if every else ((first[:k] <= t) & (t < last[:k])).astype(np.float32)

        # emitted becomes, step by step from the end, what the next step's symbol and the rest say of its state
        total = np.zeros((STATES, STATES))
        beta = np.ones((STATES, n), np.float32)
        for t in range(steps - 1, -1, -1):
            if j := live[t + 1]:
                right = emitted[t + 1, :, :j]
                total += (alpha[t, :, :j] if every else alpha[t, :, :j] * own_at(t + 1, j)) @ right.T
                beta[:, :j] = move @ right
            k = live[t]
            emitted[t, :, :k] *= beta[:, :k]
            emitted[t, :, :k] /= scale[t, :k]
            alpha[t, :, :k] *= beta[:, :k]
        own = np.concatenate([by_step[t, : live[t]] for t in range(steps)])
        flat = np.concatenate([alpha[t, :, : live[t]] if every else alpha[t, :, : live[t]] * own_at(t, live[t]) for t in range(steps)], axis=1)
        emissions = np.stack([np.bincount(own, f, len(self.emit)) for f in flat], 1)
        gamma = alpha[0].astype(np.float64)
        logs = sum(float((np.log(scale[t, : live[t]]) * own_at(t, live[t])).sum(dtype=np.float64)) for t in range(steps))
        return gamma[:, opening].sum(1), gamma[:, ~opening].sum(1), total * self.move, emissions, logs

    def likelihood(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 of the probability of each whole sequence, by the scaled forward recursion."""
        length = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-length, kind="stable")
        line = np.concatenate([texts[i] for i in order]) if len(texts) else np.empty(0, np.uint16)
        at = np.cumsum(length[order]) - length[order]
        out = np.zeros(len(texts))
        longest = -length[order]
        a = np.tile(self.start, (len(texts), 1))
        for t in range(int(length.max(initial=0))):
            k = int(np.searchsorted(longest, -t))
            a = (a[:k] @ self.move if t else a) * self.emit[line[at[:k] + t]]
            c = a.sum(1)
            out[:k] += np.log10(c)
            a /= c[:, None]
        back = np.empty(len(texts))
        back[order] = out
        return back


def _sequences(lexicon):
    """(key, doc_id, held_out, text) to the row's figures from frequent words, its symbols, and its rare words (hash and number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Lexicon = lexicon.value
        logs = np.zeros(x.size)
        logs[[x.symbol[w] for w in x.log]] = list(x.log.values())
        room = np.concatenate((np.zeros(x.first), x.room))
        known, hash_of = x.symbol, {}
        for batch in batches:
            made, hashes, times, ends = [], [], [], [0]
            for t in utf8(batch.column(3)):
                made.append(np.array(x.read(t), np.uint16))
                own = Counter([w for w in words(t) if w not in known])
                if len(hash_of) > GATHERED:
                    hash_of.clear()
                hash_of |= {w: word_hash(w) for w in own if w not in hash_of}
                hashes += map(hash_of.__getitem__, own)
                times += own.values()
                ends.append(len(hashes))
            cols = [
                pa.array([len(s) for s in made], pa.int64()),
                pa.array([int((s < x.first).sum()) for s in made], pa.int64()),
                pa.array([float(logs[s].sum()) for s in made]),
                pa.array([float(room[s].sum()) for s in made]),
                pa.array([s.tobytes() for s in made], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes, pa.int64())),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times, pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], ["key", "doc_id", "held_out", "n_tokens", "n_frequent", "logs", "room", "symbols", "rare", "times"])

    return run


def _class_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for batch in batches:
        of = np.array([crc32(w[-TAIL:]) % CLASSES for w in batch.column(0).to_pylist()], np.int64)
        tokens += np.bincount(of, batch.column(1).to_numpy(), CLASSES).astype(np.int64)
        kinds += np.bincount(of, minlength=CLASSES)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(tokens), pa.array(kinds)], ["class", "tokens", "words"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(list(map(word_hash, batch.column(0).to_pylist())), pa.int64()), batch.column(1)], ["word", "n"])


def _gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches until they hold ``most`` tokens, with their symbols."""
    held, seqs, size = [], [], 0
    for batch in batches:
        own = [np.frombuffer(s, np.uint16) for s in batch.column(column).to_pylist()]
        held.append(batch)
        seqs += own
        size += sum(map(len, own))
        if size >= most:
            yield held, seqs
            held, seqs, size = [], [], 0
    if held:
        yield held, seqs


def stretches(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """A text's stretches with context, and from where to where in each the symbols are its own."""
    for i in range(0, len(symbols), STRETCH):
        before = min(i, CONTEXT)
        yield symbols[i - before : i + STRETCH + CONTEXT], before, before + min(STRETCH, len(symbols) - i)


def _expectations(model):
    """Symbols to rows (id, k0..): expected counts by symbol; ids below 0 are moves, starts and the likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        total = None
        for _, seqs in _gathered(batches, "symbols", TOKENS):
            parts = sorted((p for s in seqs for p in stretches(s)), key=lambda p: -len(p[0]))
            at = 0
            while at < len(parts):
                own = parts[at : at + max(1, TOKENS // len(parts[at][0]))]
                at += len(own)
                length = np.array([len(s) for s, _, _ in own], np.int64)
                x = np.zeros((len(own), int(length[0])), np.int64)
                for row, (s, _, _) in zip(x, own):
                    row[: len(s)] = s
                got = m.expect(x, length, np.array([a for _, a, _ in own]), np.array([b for _, _, b in own]))
                total = list(got) if total is None else [a + b for a, b in zip(total, got)]
        if total is not None:
            start, later, moves, emit, likelihood = total
            table = np.concatenate((moves, [start, later, np.full(STATES, likelihood)], emit))
            ids = np.concatenate((-1 - np.arange(STATES + 3), np.arange(len(emit)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(c) for c in table.T)], ["id", *(f"k{k}" for k in range(STATES))])

    return run


def baum_welch(sequences: DataFrame, unigram: np.ndarray, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model after so many rounds over all sequences(symbols), and the log-likelihood before each."""
    spark, model, history = sequences.sparkSession, Model.first(unigram), []
    cols = [f"k{k}" for k in range(STATES)]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        sums = sequences.select("symbols").mapInArrow(_expectations(sent), "id int, " + ", ".join(f"{c} double" for c in cols)).groupBy("id").agg(*(F.sum(c).alias(c) for c in cols))
        table = sums.toArrow()  # one row for each symbol and state
        if not table.num_rows:
            break
        ids = table.column(0).to_numpy()
        values = np.stack([table.column(c).to_numpy() for c in cols], 1)
        at = {int(i): values[j] for j, i in enumerate(ids)}
        moves = np.stack([at[-1 - k] for k in range(STATES)])
        emit = np.zeros((len(unigram), STATES))
        emit[ids[ids >= 0]] = values[ids >= 0]
        history.append(float(at[-3 - STATES][0]))
        model = Model.of_counts(at[-1 - STATES], at[-2 - STATES], moves, emit, unigram)
    return model, history


def _likelihoods(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for held, seqs in _gathered(batches, "symbols", 4 * TOKENS):
            value, at = m.likelihood(seqs), 0
            for batch in held:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(value[at : at + batch.num_rows])], [*batch.schema.names[:-1], "likelihood"])
                at += batch.num_rows

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    # the number of a row is read from storage only, where it no longer changes
    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    counts = materialize(rows.where("not held_out").select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = F.col("word") == F.lit(END)
    top = counts.where(~end).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    heavy = {bytes(r.word): r.n for r in top} | {END: next((r.n for r in counts.where(end).collect()), 0)}
    # the others come behind the last of these
    last = (top[-1].n, bytes(top[-1].word)) if top else (0, b"")
    rare = counts.where(~end & ((F.col("n") < last[0]) | (F.col("n") == last[0]) & (F.col("word") > F.lit(last[1]))))
    sizes = rare.mapInArrow(_class_sizes, "class int, tokens long, words long").groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect()
    tokens, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sizes:
        tokens[r["class"]], distinct[r["class"]] = r["tokens"], r["words"]
    lexicon = Lexicon(heavy, tokens, distinct)
    sent = spark.sparkContext.broadcast(lexicon)

    fields = "key long, doc_id long, held_out boolean, n_tokens long, n_frequent long, logs double, room double"
    sequences = materialize(rows.mapInArrow(_sequences(sent), fields + ", symbols binary, rare array<long>, times array<int>"), "sequences")
    model, _ = baum_welch(sequences.where("not held_out"), lexicon.unigram)
    trained = spark.sparkContext.broadcast(model)
    scored = materialize(sequences.drop("rare", "times").mapInArrow(_likelihoods(trained), fields + ", likelihood double"), "likelihoods")

    pairs = sequences.select("key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("key", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    hashed = rare.mapInArrow(_hashed, "word long, n long")
    known = pairs.join(hashed, "word").groupBy("key").agg(F.sum("times").alias("times"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare"))
    every = scored.join(known, "key", "left")
    rare_logs = F.coalesce(F.col("rare"), F.lit(0.0))
    frequent = F.col("n_frequent") if heavy[END] else F.lit(0)
    return every.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (frequent + F.coalesce("times", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + rare_logs - F.col("n_tokens") * math.log10(total + kinds + 1)).alias("base_score"),
        (F.col("likelihood") + rare_logs - F.col("room")).alias("score"),
    )
