"""Vector code compression: product codes found by an integer Walsh-Hadamard transform.

Each component x becomes the integer floor(SCALE * x). Vectors are cut into PARTS equal consecutive parts, and each part position has a codebook
of up to ENTRIES entries. A part and its codebook are zero-padded to a power of two and transformed by the integer Walsh-Hadamard
transform in sequency order. Without scaling that transform multiplies squared distances by the padded width, exactly. Squared
differences of coefficients are added up in that order; the first ones hold most of the distance, so most entries are past the best known
distance after one or two and are dropped then. What remains at the end has its exact distance, the least one wins, then the lower index.

1. The codebooks start as the parts of the kept vectors of the ENTRIES smallest ids (Spark takes them as a top-k).
2. Each of ROUNDS rounds assigns all parts and adds up, task by task, the components of each entry's parts; these sums, one
   row a number, are summed by Spark, so what returns to the driver is as large as the codebooks, whatever the rows.
3. The last assignment gives codes and errors, written once; errors are summed per label before they are shuffled and joined back.

Every pass reads the vectors themselves, so nothing of their size is written or kept, and a lost task reads its rows again.

Arithmetic is that of 64-bit integers where a bound on all values says that it suffices, else of integers of any length.

Defined cases: vectors that are null or hold null or non-finite components are dropped; a vector shorter than the longest, or a dimension
that PARTS does not divide, is padded with zeros at its end; null ids come last, equal ids in order of their vectors; rows that repeat are rows
of their own; fewer vectors than ENTRIES make fewer entries; an error, or a label's sum of them, that a long can't hold is null; a label whose
sum has a null error has the sum of the others; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rowpact.llm.common import Scratch, lookup

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Rows of a batch that are compared with the entries at once.
STEP = 2048
#: Bits of a number of which sums are added up apart, so that no sum of them leaves 64 bits.
LIMB = 40
_LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), as 64-bit integers where all fit, else as integers of any length."""
    values = values.astype(np.float64)
    if not values.size or np.abs(values).max() < 2.0 ** 45:
        return np.floor(values * scale).astype(np.int64)
    whole = [int(x) * scale if abs(x) >= 2.0 ** 45 * 256 else int(np.floor(x * scale)) for x in values.ravel()]
    return np.array(whole, object).reshape(values.shape)


def _rows(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """A list column as rows of dim integers, shorter vectors padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = integers(column.flatten().to_numpy(zero_copy_only=False), scale)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), flat.dtype)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def sequency(width: int) -> np.ndarray:
    """Places of the transform's coefficients by their number of sign changes."""
    signs = np.eye(width, dtype=np.int64)
    changes = (np.diff(hadamard(signs), axis=1) != 0).sum(1)
    return np.argsort(changes, kind="stable")


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The transform of each row (a power of two long) by sums and differences."""
    out, half = rows, 1
    while half < rows.shape[1]:
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(rows.shape)
        half *= 2
    return out


class Codebooks:
    """Entries of all part positions; assigns rows of integers."""

    def __init__(self, entries: np.ndarray):
        """entries: part position, entry, component."""
        self.entries = entries
        self.parts, self.count, self.width = entries.shape
        self.padded = 1 << max(self.width - 1, 0).bit_length()
        self.order = sequency(self.padded)
        self.most = int(np.abs(entries).max()) if entries.size else 0
        #: Values up to which twice the padded width of them, squared and added up, stay below 2 ** 62.
        self.safe = int((2 ** 62 // self.padded) ** 0.5) // (2 * self.padded)

    def _transformed(self, rows: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(rows), self.padded), rows.dtype)
        wide[:, : self.width] = rows
        return hadamard(wide)[:, self.order]

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of each part, for rows of parts * width integers."""
        kind = np.int64
        if rows.dtype == object or max(self.most, int(np.abs(rows).max()) if rows.size else 0) > self.safe:
            kind = object
        codes = np.zeros((len(rows), self.parts), np.int64)
        errors = np.zeros((len(rows), self.parts), kind)
        if not self.width or not len(rows):
            return codes, errors
        for p in range(self.parts):
            entries = self._transformed(self.entries[p].astype(kind))
            for a in range(0, len(rows), STEP):
                part = rows[a : a + STEP, p * self.width : (p + 1) * self.width].astype(kind)
                codes[a : a + STEP, p], errors[a : a + STEP, p] = self._nearest(self._transformed(part), entries)
        return codes, errors

    def _nearest(self, rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = (rows[:, :1] - entries[None, :, 0]) ** 2
        close = first.argmin(1)
        # The whole distance of one entry that starts well: none that is past it can win.
        bound = ((rows - entries[close]) ** 2).sum(1)
        row, entry = np.nonzero(first <= bound[:, None])
        total, done, step = first[row, entry], 1, 1
        while done < self.padded:
            step = min(step, self.padded - done)
            total = total + ((rows[row, done : done + step] - entries[entry, done : done + step]) ** 2).sum(1)
            live = np.flatnonzero(total <= bound[row])
            row, entry, total = row[live], entry[live], total[live]
            done, step = done + step, step * 2
        start = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(total, start)
        best = np.flatnonzero(total == least[row])
        # Entries of a row are in order of their index, so the first of the best is the lowest.
        best = best[np.flatnonzero(np.diff(row[best], prepend=-1))]
        return entry[best], total[best] // self.padded

    def digest(self) -> str:
        """Of all components in order of part, entry, position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _limbs(value: int) -> list[tuple[int, int]]:
    """Numbers v at k so that value is the sum of v << LIMB * k; each is short."""
    out, k = [], 0
    while abs(value) >> LIMB:
        out.append((k, value & ((1 << LIMB) - 1)))
        value, k = value >> LIMB, k + 1
    return [*out, (k, value)]


def _sums(kept: DataFrame, books: Codebooks, scale: int) -> dict[int, int]:
    """Slot -> sum: the components of each (part, entry), then the number of its parts."""
    parts, count, width = books.entries.shape
    dim = parts * width

    def run(batches):
        sums: dict[int, int] = {}
        for batch in batches:
            rows = _rows(batch.column("vector"), dim, scale)
            codes, _ = books.assign(rows)
            for p in range(parts):
                part, code = rows[:, p * width : (p + 1) * width], codes[:, p]
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                if not len(used):
                    continue
                if part.dtype != object and int(np.abs(part).max(initial=0)) * len(part) > _LONG:
                    part = part.astype(object)
                added = np.add.reduceat(part[order], first, axis=0) if width else np.zeros((len(used), 0), np.int64)
                numbers = np.diff([*first.tolist(), len(code)]).tolist()
                for entry, row, number in zip(used.tolist(), added.tolist(), numbers, strict=True):
                    slot = (p * count + entry) * (width + 1)
                    for k, x in enumerate([*row, number]):
                        sums[slot + k] = sums.get(slot + k, 0) + int(x)
        out = [(slot, k, v) for slot, value in sums.items() for k, v in _limbs(value)]
        yield pa.RecordBatch.from_pydict(
            {"slot": pa.array([x[0] for x in out], pa.int64()), "limb": pa.array([x[1] for x in out], pa.int32()), "v": pa.array([x[2] for x in out], pa.int64())})

    found = kept.select("vector").mapInArrow(run, "slot long, limb int, v long").groupBy("slot", "limb").agg(F.sum("v").alias("v"))
    total: dict[int, int] = {}
    for slot, limb, v in found.collect():  # as many numbers as the codebooks have
        total[slot] = total.get(slot, 0) + (v << LIMB * limb)
    return total


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of a frame of vec_id and vector, all usable."""
    dim = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-dim // parts)
    first = kept.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).toArrow()
    column = first.column("vector").combine_chunks()
    start = _rows(column, parts * width, scale)
    books = Codebooks(start.reshape(len(start), parts, width).transpose(1, 0, 2))
    for _ in range(rounds if len(start) else 0):
        sums = _sums(kept, books, scale)
        new = books.entries.astype(object)
        for p in range(parts):
            for e in range(books.count):
                slot = (p * books.count + e) * (width + 1)
                if number := sums.get(slot + width, 0):
                    new[p, e] = [sums[slot + k] // number for k in range(width)]
        fits = not new.size or max(abs(x) for x in new.ravel().tolist()) <= 1 << 60
        books = Codebooks(new.astype(np.int64) if fits else new)
    return books


def encode(vectors: DataFrame, scratch: Scratch, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
           entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """vec_id, label, code, error, label_error of each kept vector, and the codebooks that decode the codes."""
    kept = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label")).filter(usable(F.col("vector")))
    books = train(kept, parts, entries, rounds, scale)
    dim = parts * books.width

    def run(batches):
        for batch in batches:
            codes, errors = books.assign(_rows(batch.column("vector"), dim, scale))
            # Two digits an entry; more entries than they can tell take four.
            wide = codes.astype(np.uint8 if books.count <= 256 else ">u2").tobytes().hex()
            step = len(wide) // len(codes) if len(codes) else 0
            error = [x if x <= _LONG else None for x in errors.sum(1).tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([wide[k * step : (k + 1) * step] for k in range(len(codes))], pa.string()),
                 pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    schema = kept.select("vec_id", "label", F.lit("").cast("string").alias("code"), F.lit(None).cast("long").alias("error")).schema
    coded = scratch.stage(kept.mapInArrow(run, schema), "codes")
    by_label = scratch.stage(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label_errors")
    return lookup(coded, by_label, ["label"]), books


def decode(code: str, books: Codebooks) -> list[int]:
    """The integers that a code stands for."""
    step = 2 if books.count <= 256 else 4
    return [x for p in range(books.parts) for x in books.entries[p, int(code[p * step : (p + 1) * step], 16)].tolist()]
