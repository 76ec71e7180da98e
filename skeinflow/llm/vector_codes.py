"""Product codes of vectors by Lloyd's rounds whose sums are kept up by differences.

Each part position has a codebook of its own. A round gives every part of a vector the nearest entry, and writes the
assignments beside those of the round before. Sums and counts of the entries are a running table of whole numbers:
only parts whose entry changed add to it, a minus for the old entry and a plus for the new one, summed up within
the task before they are shuffled. Codebooks have PARTS x ENTRIES entries, whatever the data, and are broadcast."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import brief, checkpoint, release, tidied
from .vectors import dots, finite, integers, limit

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors whose distances to all entries one pass holds.
PASS = 1024
_LONG = (1 << 63) - 1


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part and its squared distance. parts: vector, position, component; book: position, entry,
    component. Of entries at one distance the first counts."""
    code, error = np.empty(parts.shape[:2], dtype=np.uint8), np.empty(parts.shape[:2], dtype=np.int64)
    for k in range(parts.shape[1]):
        own, entries = parts[:, k], book[k]
        if not own.shape[1]:
            code[:, k] = error[:, k] = 0
            continue
        exact = np.int64 if max(np.abs(own).max(initial=0), np.abs(entries).max(initial=0)) ** 2 * own.shape[1] * 4 >= 2**53 else np.float64
        a, b = own.astype(exact), entries.astype(exact)
        far = (a * a).sum(axis=1)[:, None] - 2 * dots(own, entries).astype(exact) + (b * b).sum(axis=1)
        code[:, k] = far.argmin(axis=1)
        error[:, k] = far[np.arange(len(own)), code[:, k]]
    return code, error


class Codes:
    """Rounds over `rows(vec_id, label, embedding, ...)` for one width of parts."""

    def __init__(self, rows: DataFrame, parts: int, entries: int, scale: int):
        self.parts = parts
        first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
        longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
        self.part = -(-longest // parts)
        self.width = self.part * parts
        self.ints = functools.partial(integers, scale=scale, width=self.width, largest=limit(4 * self.width))
        start = self.ints(first.column("embedding"))
        self.book = start.reshape(len(start), parts, self.part).transpose(1, 0, 2)
        self.rows = rows.select("vec_id", "label", "embedding", F.lit(None).cast("binary").alias("code"))
        zero = [(k, j, 0, [Decimal(0)] * self.part) for k in range(parts) for j in range(len(start))]
        self.sums = rows.sparkSession.createDataFrame(zero, "part int, entry int, n long, sums array<decimal(38,0)>")

    def _assigned(self, last: bool):
        """Adds the round's codes; last: in place of the vectors, with the error."""
        ints, book, shape = self.ints, self.book, (-1, self.parts, self.part)

        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, PASS):
                    b = whole.slice(at, PASS)
                    code, error = nearest(ints(b.column("embedding")).reshape(shape), book)
                    new = pa.array([c.tobytes() for c in code], pa.binary())
                    if last:
                        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), new, pa.array(error.sum(axis=1))], ["vec_id", "label", "code", "error"])
                    else:
                        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("embedding"), b.column("code"), new], ["vec_id", "label", "embedding", "was", "code"])

        return run

    def _changes(self):
        """Rows (part, entry, n, sums): what parts that changed take from entries and bring to them, one row for each entry
        and task."""
        ints, shape = self.ints, (*self.book.shape[:2], self.part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums = np.zeros(shape[:2], dtype=np.int64), np.zeros(shape, dtype=object)
            for b in batches:
                new = np.frombuffer(b"".join(b.column("code").to_pylist()), dtype=np.uint8).reshape(-1, shape[0])
                known = np.array([x is not None for x in b.column("was").to_pylist()])
                old = np.frombuffer(b"".join(x or bytes(shape[0]) for x in b.column("was").to_pylist()), dtype=np.uint8).reshape(-1, shape[0])
                changed = (new != old) | ~known[:, None]
                vec, part = np.nonzero(changed)
                if not len(vec):
                    continue
                moved = ints(b.column("embedding")).reshape(-1, shape[0], shape[2])[vec, part].astype(np.int64)
                here = np.zeros(shape, dtype=np.int64)
                for sign, entry, on in ((1, new[vec, part], np.ones(len(vec), dtype=bool)), (-1, old[vec, part], known[vec])):
                    np.add.at(here, (part[on], entry[on]), sign * moved[on])
                    np.add.at(n, (part[on], entry[on]), sign)
                sums += here  # numbers of any size
            at = np.argwhere((n != 0) | (sums != 0).any(axis=2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1].astype(np.int32)), pa.array(n[at[:, 0], at[:, 1]]), pa.array([[Decimal(x) for x in s] for s in sums[at[:, 0], at[:, 1]]], pa.list_(pa.decimal128(38, 0)))],
                ["part", "entry", "n", "sums"],
            )

        return run

    def turn(self) -> None:
        """One round: assigns, brings the sums up to date, moves the entries."""
        self.rows = checkpoint(self.rows.select("vec_id", "label", "embedding", "code").mapInArrow(self._assigned(False), self._schema("embedding, was binary, code binary")))
        changes = self.rows.select("embedding", "was", "code").mapInArrow(self._changes(), self.sums.schema)
        total = F.array(*[F.sum(F.col("sums")[j]).cast("decimal(38,0)") for j in range(self.part)]).cast("array<decimal(38,0)>")
        self.sums = checkpoint(self.sums.unionByName(changes).groupBy("part", "entry").agg(F.sum("n").alias("n"), total.alias("sums")))
        book = self.book.copy()
        for r in self.sums.where("n > 0").collect():  # PARTS x ENTRIES rows at most
            book[r["part"], r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
        self.book = book
        release(self.rows.sparkSession)

    def _schema(self, rest: str) -> str:
        kinds = {f.name: f.dataType.simpleString() for f in self.rows.schema}
        return ", ".join(f"{x} {kinds[x]}" if x in kinds and " " not in x else x for x in ("vec_id", "label", *rest.split(", ")))

    def coded(self) -> DataFrame:
        """Rows (vec_id, label, code, error) by the entries as they are."""
        return self.rows.select("vec_id", "label", "embedding", "code").mapInArrow(self._assigned(True), self._schema("code binary, error bigint"))

    def digest(self) -> str:
        """SHA-256 of all components of all entries, by part, entry and place."""
        return hashlib.sha256(",".join(str(int(x)) for x in self.book.reshape(-1)).encode()).hexdigest()


def encode(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, code, error, label_error, codebooks_sha256) of `rows(vec_id, embedding, label)`: a byte for each part in
    hexadecimal, the squared distances to the entries summed up over the vector and over its label's vectors (nulls
    are one label), and the digest of the codebooks.

    Components are floor(scale * x). Vectors that are null or hold null, NaN or infinite components are left out. Each
    codebook starts as the parts of the vectors of the `entries` (256 at most) least vec_ids, nulls last; with fewer vectors
    it has fewer entries. Equal rows count each. Vectors of unequal lengths, or whose length `parts` doesn't divide, end
    in zeros. Components are held within the range in which no error of a vector leaves a long (over 500,000 for 64 of
    them); an error of a label is held at the largest long. Other columns, of any name, are not read."""
    own = rows.select("vec_id", "label", "embedding").where(finite(F.col("embedding")))
    codes = Codes(own, parts, entries, scale)
    if not codes.book.shape[1]:
        return own.select("vec_id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit(codes.digest()).alias("codebooks_sha256")).limit(0)
    for _ in range(rounds):
        codes.turn()
    found = checkpoint(codes.coded())
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    by_label = brief(checkpoint(found.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))))
    both = found.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return both.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def _floors(x: str) -> str:
    return f"list_transform({x}, lambda x: floor({SCALE} * x::double)::bigint)"


def _sql() -> str:
    """The whole result in SQL: rounds written one after another over parts as lists."""
    fine = "embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"
    width = f"(len(v) // {PARTS})"
    steps = [
        f"k as (select vec_id, label, {_floors('embedding')} as v from embeddings where {fine})",
        f"p as (select vec_id, label, i as part, v[i * {width} + 1:(i + 1) * {width}] as x from k, range({PARTS}) r(i))",
        f"f as (select vec_id, row_number() over (order by vec_id) - 1 as entry from k qualify entry < {ENTRIES})",
        "b0 as (select part, entry, x as e from p join f using (vec_id))",
    ]
    for t in range(ROUNDS + 1):
        steps.append(f"a{t} as (select vec_id, label, part, any_value(x) as x, min((d, entry)) as m from (select p.vec_id, p.label, p.part, x, entry, list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from p join b{t} using (part)) group by vec_id, label, part)")
        if t < ROUNDS:
            steps.append(f"c{t} as (select part, m[2] as entry, count(*) as n, pos, sum(x[pos]) as s from a{t}, (select unnest(range(1, max(len(x)) + 1)) as pos from p) group by part, m[2], pos)")
            steps.append(f"b{t + 1} as (select part, entry, coalesce(l, e) as e from b{t} left join (select part, entry, list(floor(s::double / n)::bigint order by pos) as l from c{t} group by part, entry) using (part, entry))")
    return f"""with {', '.join(steps)},
z as (select vec_id, label, string_agg(printf('%02x', m[2]), '' order by part) as code, sum(m[1])::bigint as error from a{ROUNDS} group by vec_id, label),
h as (select sha256(string_agg(e[pos]::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from b{ROUNDS}, (select unnest(range(1, max(len(x)) + 1)) as pos from p))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from z, h"""


SQL = _sql()
