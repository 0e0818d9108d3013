"""Whitening of embeddings through the exact characteristic polynomial of their integer scatter matrix.

1. Each entry becomes an integer. Distinct vectors make up the fit list, written once to the shared folder.
2. Tasks sum y and y y^T (y = x without its fixed offset) in exact integers; one row per cell of the matrix and task is shuffled. With
   n vectors and sums T, M = n Y - T T^T is n^2 times the covariance V, so M's eigenvalues are n^2 times those of V.
3. The characteristic polynomial of M is computed modulo many primes, some to a task, by Hessenberg reduction and the recurrence of its leading
   minors; Chinese remaindering puts the integer coefficients together. A bound on the coefficients says how many primes it takes.
4. All roots are real. By Descartes' rule, exact for such polynomials, the sign changes of p(x + a) count the roots above a, so
   bisection isolates the largest ones with certainty, and the sign of the square-free part refines them to `BITS` bits.
5. Components are null vectors of M - mu I by inverse iteration on `PRECISION`-bit fixed-point numbers; a root of multiplicity k takes k start
   vectors, made orthogonal.
6. A second pass over the fit list measures the whitened covariance; a last one projects every row.

The driver holds d x d integers, d + 1 coefficients and the components: bounded by the dimension, `MAX_DIM` at most, not by the rows.

Defined cases: rows whose vector is null, or holds an entry that is null, not finite or too large for a 64-bit integer, are dropped. Of the rest,
the most frequent length counts as the dimension (ties: the longer one) and rows of another length or without entries are dropped.
Components without variance are left out, so a table of equal vectors gives no row. Repeated rows and ids are projected as
often as they occur and count once in the fit list. A deviation beyond 64 bits is null. Empty table: no row. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb, gcd, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.session import cut_lineage

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
MAX_DIM = 1024
#: Relative accuracy of the roots, and bits behind the point in the inverse iteration.
BITS, PRECISION = 160, 320
PRIMES_PER_TASK = 16
#: Integers up to here are exact as doubles, so a matrix product below it may use them.
EXACT = 1 << 53


# ---- the fit list and its scatter ---------------------------------------------------------------------------------

def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x) of the usable rows: x = floor(SCALE * c) + OFFSET."""
    c = F.transform(vector, lambda v: F.floor(v.cast("double") * SCALE))
    far = float(1 << 62)
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double") * SCALE) < far, F.lit(False)))
    kept = rows.filter(usable).select(F.col(key).alias("id"), F.transform(c, lambda v: v.cast("long") + OFFSET).alias("x"))
    sizes = kept.groupBy(F.size("x").alias("d")).count().agg(F.max_by("d", F.struct("count", "d"))).first()[0]  # one number
    if sizes is not None and sizes > MAX_DIM:
        raise ValueError(f"vectors have {sizes} entries, more than {MAX_DIM}")
    return kept.filter(F.size("x") == (sizes or 0))


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return col.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a^T b of integers, as Python integers: by doubles in slices short enough to be exact, else by Python integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    step = (EXACT - 1) // most if most else len(a)
    if step < 1:
        return a.astype(object).T @ b.astype(object)
    out = np.zeros((a.shape[1], b.shape[1]), object)
    for i in range(0, len(a), max(1, step)):
        part = a[i : i + step].astype(np.float64).T @ b[i : i + step].astype(np.float64)
        out = out + part.astype(np.int64).astype(object)
    return out


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's count, sums and products, cell by cell as decimals' text; cell (-1, -1) is the count, (-1, j) a sum."""
    n, total, square = 0, None, None
    for batch in batches:
        if batch.num_rows:
            y = _matrix(batch) - OFFSET
            one = np.ones((len(y), 1), np.int64)
            s, q = exact_product(one, y)[0], exact_product(y, y)
            n, total, square = n + len(y), (s if total is None else total + s), (q if square is None else square + q)
    if n:
        i, j = np.triu_indices(len(total))
        values = [n, *total.tolist(), *square[i, j].tolist()]
        at = [-1, *[-1] * len(total), *i.tolist()], [-1, *range(len(total)), *j.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array([str(v) for v in values])], names=["i", "j", "v"])


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of y and the products y y^T over the fit list (x), exact. Cells are added in three limbs, so no sum overflows."""
    parts = fit.select("x").mapInArrow(_scatter, "i int, j int, v string")
    size, sign = F.ltrim("v", F.lit("-")), F.when(F.col("v").startswith("-"), -1).otherwise(1)
    padded = F.lpad(size, 54, "0")
    limbs = [F.sum(sign * F.substring(padded, 1 + 18 * k, 18).cast("decimal(38,0)")).alias(f"v{k}") for k in range(3)]
    n, total, cells = 0, {}, {}
    for r in parts.groupBy("i", "j").agg(*limbs).collect():  # d (d + 3) / 2 + 1 rows
        v = (int(r.v0) * 10**18 + int(r.v1)) * 10**18 + int(r.v2)
        if r.i < 0 and r.j < 0:
            n = v
        elif r.i < 0:
            total[r.j] = v
        else:
            cells[r.i, r.j] = v
    d = len(total)
    return n, [total[j] for j in range(d)], [[cells[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]


def centred_scatter(n: int, total: list[int], square: list[list[int]]) -> list[list[int]]:
    """M = n Y - T T^T: n^2 times the covariance."""
    return [[n * square[i][j] - total[i] * total[j] for j in range(len(total))] for i in range(len(total))]


# ---- the characteristic polynomial --------------------------------------------------------------------------------

def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all 32-bit numbers."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    d = n - 1
    r = (d & -d).bit_length() - 1
    d >>= r
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(r - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes below 2^31 whose product has more than `bits` bits."""
    out, p, have = [], (1 << 31) - 1, 0.0
    while have <= bits + 2:
        if is_prime(p):
            out.append(p)
            have += np.log2(p)
        p -= 2
    return out


def coefficient_bits(m: list[list[int]]) -> int:
    """Bits of the largest coefficient at most: |e_k| <= C(d, k) r^k for a bound r of all eigenvalues (Gershgorin, or the trace of a PSD matrix)."""
    d = len(m)
    r = max(1, min(max(sum(abs(v) for v in row) for row in m), sum(m[i][i] for i in range(d))))
    return max((comb(d, k) * r**k).bit_length() for k in range(d + 1)) + 1


def charpoly_mod(m: np.ndarray, p: int) -> np.ndarray:
    """det(x I - m) modulo the prime p, the constant coefficient first: Hessenberg form by similarity, then its leading minors."""
    h, d = m % p, len(m)
    for k in range(d - 2):
        rows = np.flatnonzero(h[k + 1 :, k])
        if not len(rows):
            continue
        i = k + 1 + int(rows[0])
        if i != k + 1:
            h[[i, k + 1]] = h[[k + 1, i]]
            h[:, [i, k + 1]] = h[:, [k + 1, i]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1][None, :]) % p
        # the inverse from the right: column k + 1 gains u_i times column i; products are reduced before they are added
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u[None, :] % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        now = -h[k - 1, k - 1] * polys[k - 1] % p
        now[1:] = (now[1:] + polys[k - 1][:-1]) % p
        below = 1
        for i in range(1, k):
            below = below * int(h[k - i, k - i - 1]) % p
            if not below:
                break
            now = (now - int(h[k - i - 1, k - 1]) * below % p * polys[k - i - 1]) % p
        polys[k] = now
    return polys[d]


def _charpolys(m: list[list[int]], moduli: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = np.array(m, object)
        for batch in batches:
            at = batch.column(0).to_pylist()
            out = [charpoly_mod((big % moduli[i]).astype(np.int64), moduli[i]).tolist() for i in at]
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["id", "c"])

    return run


def characteristic_polynomial(spark, m: list[list[int]]) -> list[int]:
    """The integer coefficients of det(x I - M), the constant one first. Each task takes `PRIMES_PER_TASK` primes."""
    moduli = primes(coefficient_bits(m))
    tasks = -(-len(moduli) // PRIMES_PER_TASK)
    found = dict(spark.range(0, len(moduli), 1, tasks).mapInArrow(_charpolys(m, moduli), "id long, c array<long>").collect())
    product, coefficients = 1, [0] * (len(m) + 1)
    for i, p in enumerate(moduli):  # Garner: one prime at a time
        inverse = pow(product % p, -1, p)
        coefficients = [c + product * ((r - c) * inverse % p) for c, r in zip(coefficients, found[i], strict=True)]
        product *= p
    return [c - product if c > product // 2 else c for c in coefficients]


# ---- its largest roots --------------------------------------------------------------------------------------------

def _content_free(p: list[int]) -> list[int]:
    while len(p) > 1 and p[-1] == 0:
        p = p[:-1]
    g = 0
    for c in p:
        g = gcd(g, c)
    return [c // g for c in p] if g > 1 else p


def _derivative(p: list[int]) -> list[int]:
    return [k * c for k, c in enumerate(p)][1:]


def _square_free_mod(p: list[int], q: int) -> bool:
    """Whether p modulo the prime q has no repeated root; then p has none either."""
    a, b = [c % q for c in p], [c % q for c in _derivative(p)]
    while b and b[-1] == 0:
        b.pop()
    while b:
        inverse = pow(b[-1], -1, q)
        while len(a) >= len(b):
            f, s = a[-1] * inverse % q, len(a) - len(b)
            for i, c in enumerate(b):
                a[s + i] = (a[s + i] - f * c) % q
            a.pop()
            while a and a[-1] == 0:
                a.pop()
        a, b = b, a
    return len(a) == 1


def _remainder(a: list[int], b: list[int]) -> list[int]:
    a = a[:]
    while len(a) >= len(b):
        f, g, s = a[-1], b[-1], len(a) - len(b)
        a = [c * g for c in a]
        for i, c in enumerate(b):
            a[s + i] -= f * c
        a.pop()
    return _content_free(a) if any(a) else []


def _quotient(a: list[int], b: list[int]) -> list[int]:
    """a / b without remainder, up to a constant."""
    rest, out = [Fraction(c) for c in a], []
    while len(rest) >= len(b):
        f = rest[-1] / b[-1]
        out.append(f)
        for i, c in enumerate(b):
            rest[len(rest) - len(b) + i] -= f * c
        rest.pop()
    common_ = 1
    for f in out:
        common_ = common_ * f.denominator // gcd(common_, f.denominator)
    return _content_free([int(f * common_) for f in reversed(out)])


def square_free(p: list[int]) -> list[int]:
    """The polynomial with each root of p once."""
    if any(_square_free_mod(p, q) for q in primes(90) if p[-1] % q):
        return p
    a, b = _content_free(p), _content_free(_derivative(p))
    while b:
        a, b = b, _remainder(a, b)
    return _quotient(p, a)


def _at(p: list[int], a: int, bits: int) -> int:
    """2^(bits * degree) p(a / 2^bits): its sign is that of the value."""
    v, scale = p[-1], 0
    for c in reversed(p[:-1]):
        scale += bits
        v = v * a + (c << scale)
    return v


def roots_above(p: list[int], a: int) -> int:
    """How many roots of p (all real) are larger than the integer a, with multiplicity: the sign changes of p(x + a)."""
    q = p[:]
    if a:
        for i in range(len(q) - 1):
            for k in range(len(q) - 2, i - 1, -1):
                q[k] += a * q[k + 1]
    signs = [c > 0 for c in q if c]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def largest_roots(p: list[int], count: int, bound: int) -> list[tuple[Fraction, int]]:
    """(root, multiplicity) of the largest positive roots of p (all real, at most `bound`), `count` with multiplicity at least if there are."""
    p = _content_free(p)
    zero = next(i for i, c in enumerate(p) if c)
    p = p[zero:]
    if len(p) < 2:
        return []
    simple = square_free(p)
    # roots apart by less than 1 need a finer grid: substitute x / 2^f until every bracket holds one distinct root
    fine, brackets = 0, []
    while True:
        d, e = len(p) - 1, len(simple) - 1
        scaled = [c << (fine * (d - k)) for k, c in enumerate(p)]
        once = [c << (fine * (e - k)) for k, c in enumerate(simple)]
        todo, brackets, whole, left = [(0, (bound << fine) + 1, roots_above(once, 0), 0)], [], True, count
        while todo and left > 0:
            low, high, above_low, above_high = todo.pop()
            if above_low == above_high:
                continue
            if above_low - above_high == 1:
                times = roots_above(scaled, low) - roots_above(scaled, high)
                brackets.append((low, high, times))
                left -= times
            elif high - low == 1:
                whole = False
                break
            else:
                # halve the logarithm while the bracket is wide: eigenvalues spread over orders of magnitude
                mid = max(low + 1, isqrt(max(low, 1) * high)) if high > 4 * max(low, 1) else (low + high) // 2
                above = roots_above(once, mid)
                todo += [(low, mid, above_low, above), (mid, high, above, above_high)]
        if whole:
            break
        fine = 2 * fine + 16
    out = []
    for low, high, times in brackets:
        # (low, high] holds one root of the square-free part: its sign changes there
        bits = max(0, BITS - max(low, 1).bit_length())
        a, b = low << bits, high << bits
        up = _at(once, b, bits)
        if up:
            while b - a > 1 and (b - a).bit_length() > b.bit_length() - BITS:
                mid = (a + b) >> 1
                v = _at(once, mid, bits)
                if v == 0:
                    a = b = mid
                elif (v > 0) == (up > 0):
                    b = mid
                else:
                    a = mid
        else:
            a = b
        out.append((Fraction(a + b, 2 << (bits + fine)), times))
    return out


# ---- components ---------------------------------------------------------------------------------------------------

def _shift(v: np.ndarray, bits: int) -> np.ndarray:
    return v >> bits if bits >= 0 else v << -bits


def null_vectors(m: list[list[int]], root: Fraction, times: int) -> list[np.ndarray]:
    """Orthonormal null vectors of M - root I, as integers over 2^PRECISION, by inverse iteration.

    The matrix is scaled so that its largest entry is about 1; elimination takes the largest pivot of each column, and a pivot of nothing
    becomes the smallest number, which blows up just the wanted directions.
    """
    d, one = len(m), 1 << PRECISION
    top = max(1, max(abs(v) for row in m for v in row))
    shift = PRECISION - top.bit_length()
    a = np.array([[_fixed(Fraction(v) - (root if i == j else 0), shift) for j, v in enumerate(row)] for i, row in enumerate(m)], object).reshape(d, d)
    order, lower = list(range(d)), np.zeros((d, d), object)
    for k in range(d):
        i = k + max(range(d - k), key=lambda r: abs(a[k + r, k]))
        if i != k:
            a[[i, k]], lower[[i, k]] = a[[k, i]], lower[[k, i]]
            order[i], order[k] = order[k], order[i]
        if a[k, k] == 0:
            a[k, k] = 1
        f = np.array([(int(v) << PRECISION) // int(a[k, k]) for v in a[k + 1 :, k]], object)
        lower[k + 1 :, k] = f
        if len(f):
            a[k + 1 :, k:] = a[k + 1 :, k:] - ((f[:, None] * a[k, k:][None, :]) >> PRECISION)

    def solve(b: np.ndarray) -> np.ndarray:
        y = b[order].copy()
        for k in range(d):
            y[k + 1 :] = y[k + 1 :] - ((lower[k + 1 :, k] * y[k]) >> PRECISION)
        x = np.zeros(d, object)
        for k in range(d - 1, -1, -1):
            x[k] = (int(y[k]) << PRECISION) // int(a[k, k])
            y[:k] = y[:k] - ((a[:k, k] * x[k]) >> PRECISION)
        return x

    def unit(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            norm = max(1, isqrt(sum(int(v) * int(v) for v in x)))
            x = np.array([(int(v) << PRECISION) // norm for v in x], object)
            for o in others:
                x = x - ((o * (int((o * x).sum()) >> PRECISION)) >> PRECISION)
        norm = max(1, isqrt(sum(int(v) * int(v) for v in x)))
        return np.array([(int(v) << PRECISION) // norm for v in x], object)

    out: list[np.ndarray] = []
    for t in range(times):
        x = np.array([one // (1 + (7 * i + 13 * t) % (d + 5)) for i in range(d)], object)  # any start that no eigenvector is orthogonal to by design
        for _ in range(4):
            x = unit(solve(unit(x, out)), out)
        out.append(x)
    return out


def _fixed(v: Fraction, bits: int) -> int:
    return (v.numerator << bits) // v.denominator if bits >= 0 else v.numerator // (v.denominator << -bits)


def _double(v: int) -> float:
    return float(Fraction(int(v), 1 << PRECISION))


class Whitening:
    """What the fit list gives: n, the sums of x, eigenvalues, and the matrix that takes n x - S to whitened coordinates."""

    def __init__(self, n: int, sums: list[int], trace: int, roots: list[tuple[Fraction, int]], m: list[list[int]], components: int):
        self.n, self.sums = n, sums
        vectors, values = [], []
        for root, times in sorted(roots, reverse=True):
            vectors += null_vectors(m, root, times)
            values += [root] * times
        vectors, values = vectors[:components], values[:components]
        self.values = [float(v / (n * n)) for v in values]
        self.explained = [float(v / trace) for v in values]
        self.vectors = [[_double(v) for v in x] for x in vectors]
        # (n x - S) / n projected and over sqrt(mu / n^2): the factors n cancel
        roots_ = [_root(v) for v in values]
        self.weights = np.array([[v / r for v in x] for x, r in zip(self.vectors, roots_, strict=True)]).T

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: 64-bit where they fit, else Python integers."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(abs(s) for s in self.sums)
        kind = np.int64 if most < 1 << 62 else object
        return self.n * x.astype(kind) - np.array(self.sums, kind)[None, :]

    def project(self, deviations: np.ndarray) -> np.ndarray:
        return deviations.astype(np.float64) @ self.weights


def _root(v: Fraction) -> float:
    """sqrt(v) to double precision whatever its size."""
    bits = max(0, 140 - (v.numerator // v.denominator).bit_length())
    bits += bits % 2
    return float(Fraction(isqrt((v.numerator << bits) // v.denominator), 1 << (bits // 2)))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct `x` of `vectors`, or None where nothing varies; and the fit list."""
    spark = vectors.sparkSession
    distinct = cut_lineage(vectors.select("x").distinct(), "whitening-fit")
    n, total, square = scatter(distinct)
    m = centred_scatter(n, total, square)
    trace = sum(m[i][i] for i in range(len(m)))
    if not trace:
        return None, distinct
    roots = largest_roots(characteristic_polynomial(spark, m), components, trace)
    return Whitening(n, [t + n * OFFSET for t in total], trace, roots, m, components), distinct


def _moments(w: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = w.weights.shape[1]
        s, q, n = np.zeros(k), np.zeros((k, k)), 0
        for batch in batches:
            if batch.num_rows:
                z = w.project(w.deviations(_matrix(batch)))
                s, q, n = s + z.sum(axis=0), q + z.T @ z, n + len(z)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([s.tolist()]), pa.array([q.ravel().tolist()])], names=["s", "q"])

    return run


def identity_error(w: Whitening, fit_list: DataFrame) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity. Rows are centred exactly before they are
    multiplied; what rounding leaves of their mean is taken off as well."""
    k = w.weights.shape[1]
    parts = fit_list.mapInArrow(_moments(w), "s array<double>, q array<double>")
    sums = parts.select(F.posexplode(F.concat("s", "q")).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()  # k + k^2 rows
    v = np.array([r.v for r in sorted(sums)])
    mean = v[:k] / w.n
    return float(np.abs(v[k:].reshape(k, k) / w.n - np.outer(mean, mean) - np.eye(k)).max())


def _project(w: Whitening, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = w.weights.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            off = w.deviations(_matrix(batch))
            fits = off.dtype == np.int64 and int(np.abs(off).max()) ** 2 * off.shape[1] < 1 << 63
            square = (off * off).sum(axis=1).tolist() if fits else [sum(int(v) ** 2 for v in row) for row in off]
            square = pa.array([v if v < 1 << 63 else None for v in square], pa.int64())
            rows = np.repeat(np.arange(batch.num_rows), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(len(rows), w.n)), square.take(pa.array(rows)),
                pa.array(w.project(off).ravel()), pa.array(np.tile(np.array(w.explained), batch.num_rows)), pa.array(np.full(len(rows), error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable input row and component: key, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = integer_vectors(rows, key, vector)
    w, fit_list = fit(vectors, components)
    if w is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", key)
    return vectors.mapInArrow(_project(w, identity_error(w, fit_list)), schema).withColumnRenamed("id", key)
