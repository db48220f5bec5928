"""Product codes of vectors in whole numbers; nearest entries by annular norm pruning.

A component x becomes floor(4096 * x), a vector is cut into ``PARTS`` equal parts, and each position has a codebook of
its own: it starts as that part of the ``ENTRIES`` smallest vec_ids and is moved ``ROUNDS`` times to the floor of its
parts' mean. Entries are sorted by norm. By the triangle inequality an entry at distance d of a part has a norm within d
of the part's, so a part starts at the entry next in norm, binary-searches the interval that its best distance allows,
and walks outward from there; each better distance narrows the interval. What lies inside, the edges included, is
evaluated in whole numbers, so that the result (ties go to the lower index) is that of trying all entries.

A round is one pass in which tasks give their sums for each position and entry, 128 rows a task whatever the vectors are;
only 128 sums reach the driver. Vectors themselves are never shuffled. Labels are added up before they are joined back.

* A vector that is null, or holds a null, NaN or infinite component, is dropped; a double that no float of 32 bits can hold
  counts as infinite. Finite components of any size are right: parts beyond ``PLAIN`` are computed in unbounded integers.
  An error beyond the range of a long is given as the largest long.
* The length of the first kept vector that ``PARTS`` divides is the table's (smallest vec_id). A vector of another length,
  or of none, is returned with null code, null error and no part in codebooks and sums.
* Repeated rows and vec_ids are rows of their own; ties of vec_ids go by the vectors. Null vec_ids come last. Fewer than
  ``ENTRIES`` rows start as many entries. An empty table gives an empty result. Null labels are a label of their own.
* Further columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canloom.llm.common import materialize

PARTS, ENTRIES, ROUNDS = 8, 16, 6
UNITS = 4096
#: Components up to this size are computed in longs: a distance of 64 such components is below 2**62.
PLAIN = 2**27
PLAIN_WIDTH = 64
#: Sums of a task are passed on in two decimals: high * LIMB + low.
LIMB = 2**80
#: Beyond all floats of 32 bits.
INFINITE = 2.0**128
#: Label sums up to so many rows are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 50_000
LARGEST = 2**63 - 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows whose vector has nothing but finite components."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < INFINITE, F.lit(False)))
    return vectors.where(F.col("embedding").isNotNull() & finite).select("vec_id", "label", "embedding")


def whole(column: pa.Array, width: int) -> np.ndarray:
    """floor(4096 * x) of equally long lists: longs, or unbounded integers where a component needs them."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * UNITS).reshape(-1, width)
    if width <= PARTS * PLAIN_WIDTH and (not x.size or np.abs(x).max() <= PLAIN):
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


class Codebook:
    """The entries of one position, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        norms = np.sqrt((entries * entries).sum(1).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        #: Distances evaluated so far.
        self.evaluated = 0

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part and the squared distance to it."""
        n, last = len(parts), len(self.order) - 1
        norm = np.sqrt((parts * parts).sum(1).astype(np.float64))
        after = np.minimum(np.searchsorted(self.norms, norm), last)
        before = np.maximum(after - 1, 0)
        start = np.where(norm - self.norms[before] <= self.norms[after] - norm, before, after)
        entry, best = self.order[start], self._distances(parts, start)
        left, right, open_ = start - 1, start + 1, np.arange(n)
        while len(open_):
            # a little wider than the distance, so that rounded roots never leave an entry out
            reach = np.sqrt(best[open_].astype(np.float64)) * (1 + 1e-9) + norm[open_] * 1e-9
            inner = np.searchsorted(self.norms, norm[open_] - reach, "left")
            outer = np.searchsorted(self.norms, norm[open_] + reach, "right")
            down, up = open_[left[open_] >= inner], open_[right[open_] < outer]
            for rows, at in ((down, left), (up, right)):
                if len(rows):
                    self._improve(parts, rows, at[rows], entry, best)
            left[down] -= 1
            right[up] += 1
            open_ = np.union1d(down, up)
        return entry, best

    def _distances(self, parts: np.ndarray, at: np.ndarray) -> np.ndarray:
        self.evaluated += len(parts)
        apart = parts - self.entries[self.order[at]]
        return (apart * apart).sum(1)

    def _improve(self, parts: np.ndarray, rows: np.ndarray, at: np.ndarray, entry: np.ndarray, best: np.ndarray) -> None:
        found, which = self._distances(parts[rows], at), self.order[at]
        better = (found < best[rows]) | (found == best[rows]) & (which < entry[rows])
        best[rows[better]], entry[rows[better]] = found[better], which[better]


def _books(codebooks: list[list[list[int]]]) -> list[Codebook]:
    """Entries as longs where all of a position allow it. A part in unbounded integers makes its differences so, too."""
    plain = all(abs(x) <= PLAIN for book in codebooks for entry in book for x in entry) and len(codebooks[0][0]) <= PLAIN_WIDTH
    return [Codebook(np.array(book, np.int64 if plain else object)) for book in codebooks]


def _summing(codebooks: list[list[list[int]]], width: int):
    """For each position and entry of a task: how many parts it has, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, w = _books(codebooks), width // PARTS
        size = len(codebooks[0])
        counts, sums = np.zeros((PARTS, size), np.int64), np.zeros((PARTS, size, w), object)
        for batch in batches:
            x = whole(batch.column(0), width)
            for p, book in enumerate(books):
                parts = x[:, p * w : (p + 1) * w]
                entry, _ = book.nearest(parts)
                counts[p] += np.bincount(entry, minlength=size)
                for e in np.unique(entry):
                    sums[p, e] += parts[entry == e].sum(0)
        rows = [(p, e, int(counts[p, e]), [int(v) for v in sums[p, e]]) for p, e in zip(*np.nonzero(counts))]
        pairs = [[divmod(v, LIMB) for v in s] for *_, s in rows]
        limbs = pa.list_(pa.decimal128(38, 0))
        names = ["position", "entry", "n", "high", "low"]
        arrays = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([[_decimal(v[k]) for v in r] for r in pairs], limbs) for k in (0, 1))], names)

    return run


def _decimal(v: int):
    from decimal import Decimal

    return Decimal(v)


def _moved(kept: DataFrame, codebooks: list[list[list[int]]], width: int) -> list[list[list[int]]]:
    """Codebooks after one round: an entry becomes the floor of its parts' mean, or stays if it has none."""
    w = width // PARTS
    sums = kept.select("embedding").mapInArrow(_summing(codebooks, width), "position int, entry int, n long, high array<decimal(38,0)>, low array<decimal(38,0)>")
    total = [F.sum(F.col(c)[k]).alias(f"{c}{k}") for c in ("high", "low") for k in range(w)]
    out = [[entry[:] for entry in book] for book in codebooks]
    for r in sums.groupBy("position", "entry").agg(F.sum("n").alias("n"), *total).collect():  # PARTS * ENTRIES rows at most
        out[r.position][r.entry] = [(int(r[f"high{k}"]) * LIMB + int(r[f"low{k}"])) // r.n for k in range(w)]
    return out


def _coding(codebooks: list[list[list[int]]], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, w = _books(codebooks), width // PARTS
        for batch in batches:
            x = whole(batch.column("embedding"), width)
            found = [book.nearest(x[:, p * w : (p + 1) * w]) for p, book in enumerate(books)]
            codes = np.stack([entry for entry, _ in found], 1).astype(np.uint8)
            errors = np.sum([distance.astype(object) for _, distance in found], 0) if len(x) else []
            columns = [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([min(int(e), LARGEST) for e in errors], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return run


def digest(codebooks: list[list[list[int]]]) -> str:
    """Lowercase hex SHA-256 of all components, by position, entry and place, in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in codebooks for entry in book for x in entry).encode()).hexdigest()


def fit(kept: DataFrame) -> tuple[list[list[list[int]]], int]:
    """The final codebooks (position, entry, component) and the length of the vectors they are for; none for no vectors."""
    length = F.size("embedding")
    fits = kept.where((length > 0) & (length % PARTS == 0))
    first = fits.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(length.alias("n")).first()
    if first is None:
        return [], 0
    w, same = first.n // PARTS, fits.where(length == first.n)
    rows = same.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(ENTRIES).collect()
    seeds = [[int(np.floor(np.float64(x) * UNITS)) for x in r.embedding] for r in rows]
    codebooks = [[s[p * w : (p + 1) * w] for s in seeds] for p in range(PARTS)]
    for _ in range(ROUNDS):
        codebooks = _moved(same, codebooks, first.n)
    return codebooks, first.n


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every usable row of vectors(vec_id, embedding, label)."""
    kept = materialize(usable(vectors), "vectors")
    codebooks, width = fit(kept)
    kind = dict(kept.dtypes)
    schema = f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"
    bare = kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not codebooks:
        coded = bare
    else:
        fits = F.size("embedding") == width
        coded = kept.where(fits).mapInArrow(_coding(codebooks, width), schema).unionByName(bare.where(~fits))
    coded = materialize(coded, "codes", narrow=True)
    # a decimal sum can't overflow; the largest long stands for what is beyond
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = materialize(coded.groupBy("label").agg(total.alias("label_error")), "label-errors", narrow=True).withColumnRenamed("label", "of")
    few = sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = coded.join(F.broadcast(sums) if few else sums.hint("merge"), _same(F.col("label"), F.col("of")))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
