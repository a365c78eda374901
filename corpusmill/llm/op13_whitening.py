"""Embedding whitening by the exact characteristic polynomial.

Entries are made integers, so the scatter matrix n * sum(x x') - S S' is exact: tasks multiply with
limbs so small that doubles hold every sum, and Spark adds what they find.  From there on the work
depends on the number of dimensions only, not on that of rows:

1. characteristic polynomial: for enough primes below 2^31, each a row of a Spark job, the matrix is
   brought to Hessenberg form modulo the prime, and its polynomial read off; Chinese remaindering
   joins them to the integer coefficients;
2. roots: a polynomial whose roots are all real has exactly as many above a number as its Taylor shift
   has changes of sign.  Bisection by that count isolates them, with their multiplicities; quadratic
   interval refinement, with exact signs, narrows them until they tell neighbours apart by far;
3. components: inverse iteration in whole numbers of some hundred bits, each component a row of a
   Spark job; those of a multiple root are made orthogonal.

Two more passes whiten the rows: one for the covariance of the whitened values, one for the result.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: entries beyond are taken as these, so that they fit a long
LARGEST = 1 << 62
LIMB_BITS = 20
#: rows multiplied at once: products of two limbs of 20 bits, so many times, are exact as doubles
ROWS_AT_ONCE = 1 << 12
#: digits in which tasks hand on their sums
DIGIT_BITS = 30
#: a root is known to so many bits below itself, and below the gap to its neighbours
ROOT_BITS, GAP_BITS = 120, 90


# ---------------------------------------------------------------- exact sums


def usable(embeddings: DataFrame, vector: str, key: str) -> DataFrame:
    """key and _v of rows whose vector is there and whose entries are all finite numbers."""
    v = embeddings[vector].cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return embeddings.where(v.isNotNull() & finite).select(embeddings[key], v.alias("_v"))


def integers(column: pa.ListArray, d: int) -> np.ndarray:
    """floor(64 * c) of the entries, a row for each vector."""
    values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
    return np.clip(values, -float(LARGEST), float(LARGEST)).astype(np.int64)


def gram(x: np.ndarray) -> np.ndarray:
    """x' x of whole numbers, exact (an object array)."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), ROWS_AT_ONCE):
        rest, limbs = x[at : at + ROWS_AT_ONCE], []
        while len(limbs) < 3 and (rest != 0).any() and np.abs(rest).max() >= 1 << LIMB_BITS:
            limbs.append((rest & ((1 << LIMB_BITS) - 1)).astype(np.float64))
            rest = rest >> LIMB_BITS
        limbs.append(rest.astype(np.float64))
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << LIMB_BITS * (i + j)
    return total


def exact_sums(rows: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of floor(64 * c) by dimension, and the sums of their products."""
    upper = np.triu_indices(d)

    def run(batches):
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = integers(batch.column(0), d)
            n += len(x)
            for at in range(0, len(x), ROWS_AT_ONCE):
                part = x[at : at + ROWS_AT_ONCE]
                sums += (part >> 32).sum(axis=0).astype(object) * (1 << 32) + (part & 0xFFFFFFFF).sum(axis=0).astype(object)
            products += gram(x)
        if not n:
            return
        numbers = [n, *sums, *products[upper]]
        entry, place, digit = [], [], []
        for k, v in enumerate(numbers):
            sign, v, at = (-1, -v, 0) if v < 0 else (1, v, 0)
            while v:
                entry.append(k)
                place.append(at)
                digit.append(sign * int(v & ((1 << DIGIT_BITS) - 1)))
                v, at = v >> DIGIT_BITS, at + 1
        yield pa.RecordBatch.from_arrays([pa.array(entry, pa.int32()), pa.array(place, pa.int32()), pa.array(digit, pa.int64())], ["entry", "place", "digit"])

    found = [0] * (1 + d + len(upper[0]))
    digits = rows.select("_v").mapInArrow(run, "entry int, place int, digit long").groupBy("entry", "place").agg(F.sum("digit").alias("digit"))
    for r in digits.collect():  # d * (d + 3) / 2 + 1 numbers of a few digits, however many rows
        found[r.entry] += r.digit << DIGIT_BITS * r.place
    products = [[0] * d for _ in range(d)]
    for i, j, v in zip(*upper, found[1 + d :]):
        products[i][j] = products[j][i] = v
    return found[0], found[1 : 1 + d], products


# ---------------------------------------------------------------- characteristic polynomial


def is_prime(n: int) -> bool:
    """For n below 2^32; to these bases Miller and Rabin's test is exact there."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7) if n != p):
        return False
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if n != base and x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(product_over: int) -> list[int]:
    """Primes below 2^31, largest first, whose product exceeds a number."""
    found, product, n = [], 1, (1 << 31) - 1
    while product <= product_over:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def hessenberg(h: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo p with zeros below the first subdiagonal."""
    d = len(h)
    for m in range(1, d - 1):
        at = np.flatnonzero(h[m:, m - 1])
        if not len(at):
            continue
        k = m + int(at[0])
        if k != m:
            h[[m, k]] = h[[k, m]]
            h[:, [m, k]] = h[:, [k, m]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    return h


def polynomial_mod(matrix: list[list[int]], p: int) -> list[int]:
    """det(x I - matrix) modulo p, from the constant up."""
    d = len(matrix)
    h = hessenberg(np.array([[v % p for v in row] for row in matrix], np.int64).reshape(d, d), p)
    of = np.zeros((d + 1, d + 1), np.int64)  # of[k]: the polynomial of the leading k rows and columns
    of[0, 0] = 1
    for k in range(1, d + 1):
        of[k, 1:] = of[k - 1, :-1]
        of[k] = (of[k] - h[k - 1, k - 1] * of[k - 1]) % p
        below = 1
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            if not below:
                break
            of[k] = (of[k] - below * int(h[i - 1, k - 1]) % p * of[i - 1]) % p
    return of[d].tolist()


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """det(x I - matrix) of a positive semidefinite whole-number matrix, from the constant up."""
    d = len(matrix)
    mean = sum(matrix[i][i] for i in range(d)) // d + 1
    # coefficients are elementary symmetric functions of roots that aren't negative: at most those of equal roots
    chosen = primes(max(math.comb(d, k) * mean**k for k in range(d + 1)))

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([polynomial_mod(matrix, p) for p in own], pa.list_(pa.int64()))], ["p", "c"])

    tasks = min(len(chosen), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in chosen], "p long").repartition(tasks).mapInArrow(run, "p long, c array<long>").collect()
    product = math.prod(chosen)
    found = [0] * (d + 1)
    for p, residues in rows:
        rest = product // p
        weight = rest * pow(rest, -1, p)
        for k, r in enumerate(residues):
            # signs alternate: the coefficient's size is what the remainders of its positive form give
            found[k] += (r if (d - k) % 2 == 0 else -r) * weight
    return [v % product * (1 if (d - k) % 2 == 0 else -1) for k, v in enumerate(found)]


# ---------------------------------------------------------------- roots


def derivative(c: list[int]) -> list[int]:
    return [k * v for k, v in enumerate(c)][1:]


def primitive(c: list[int]) -> list[int]:
    while c and not c[-1]:
        c = c[:-1]
    g = math.gcd(*c) if c else 1
    return [v // g for v in c]


def remainder(a: list[int], b: list[int]) -> list[int]:
    """A multiple of the remainder of a by b, without fractions."""
    a = list(a)
    while len(a) >= len(b):
        top, shift = a[-1], len(a) - len(b)
        a = [v * b[-1] for v in a]
        for k, v in enumerate(b):
            a[k + shift] -= top * v
        a = primitive(a[:-1])
        if not a:
            break
    return a


def distinct_part(c: list[int]) -> list[int]:
    """The polynomial with each root once."""
    for p in ((1 << 31) - 1, (1 << 31) - 19):  # both prime; a modular gcd of degree 0 proves that there are no multiple roots
        a, b = [v % p for v in c], [v % p for v in derivative(c)]
        while b and not b[-1]:
            b.pop()
        while b:
            inverse = pow(b[-1], -1, p)
            while len(a) >= len(b):
                f, s = a[-1] * inverse % p, len(a) - len(b)
                for k, v in enumerate(b):
                    a[k + s] = (a[k + s] - f * v) % p
                while a and not a[-1]:
                    a.pop()
            a, b = b, a
        if len(a) == 1:
            return c
    a, b = primitive(c), primitive(derivative(c))
    while b:
        a, b = b, primitive(remainder(a, b))
    if len(a) == 1:
        return c
    # exact division by the common part
    rest, quotient = [Fraction(v) for v in c], []
    while len(rest) >= len(a):
        f = rest[-1] / a[-1]
        quotient.append(f)
        s = len(rest) - len(a)
        for k, v in enumerate(a):
            rest[k + s] -= f * v
        rest.pop()
    scale = math.lcm(*(f.denominator for f in quotient))
    return primitive([int(f * scale) for f in reversed(quotient)])


def roots_above(c: list[int], num: int, bits: int) -> int:
    """How many roots of a polynomial with real roots only exceed num / 2^bits."""
    d = len(c) - 1
    shifted = [v << bits * (d - k) for k, v in enumerate(c)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            shifted[k] += num * shifted[k + 1]
    signs = [v > 0 for v in shifted if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(c: list[int], num: int, bits: int) -> int:
    total, shift = 0, 0
    for v in reversed(c):
        total = total * num + (v << shift)
        shift += bits
    return (total > 0) - (total < 0)


def isolated(c: list[int], wanted: int, whole: list[int]) -> list[tuple[int, int, int, int]]:
    """(low, high, bits, multiplicity): the largest roots of c are each alone in (low, high] / 2^bits, until `wanted` roots of `whole` are found."""
    top = sum(map(abs, c[:-1])).bit_length() if len(c) > 1 else 0
    # every root is at most the sum of all of them
    top = min(top, (abs(c[-2]) // abs(c[-1]) + 1).bit_length()) if len(c) > 1 else 0
    found, have = [], 0
    waiting = [(0, 1 << top, 0, roots_above(c, 0, 0), 0)]  # (low, high, bits, roots above low, roots above high)
    while waiting and have < wanted:
        low, high, bits, above_low, above_high = waiting.pop()
        if above_low == above_high:
            continue
        if above_low == above_high + 1 and low:
            times = 1 if c is whole else roots_above(whole, low, bits) - roots_above(whole, high, bits)
            found.append((low, high, bits, times))
            have += times
            continue
        if high - low == 1:
            low, high, bits = low * 2, high * 2, bits + 1
        middle = (low + high) // 2
        above = roots_above(c, middle, bits)
        waiting += [(low, middle, bits, above_low, above), (middle, high, bits, above, above_high)]
    return found


def narrowed(c: list[int], low: int, high: int, bits: int, width: Fraction) -> tuple[int, int, int]:
    """The interval of a single root, at most `width` wide, by quadratic refinement with exact signs."""
    if sign_at(c, high, bits) == 0:
        return high, high, bits
    at_low = sign_at(c, low, bits)
    if at_low == 0:  # another root ends here, outside the interval
        at_low = -sign_at(c, high, bits)
    step, slope = 2, derivative(c)
    while Fraction(high - low, 1 << bits) > width:
        # a grid of 2^step cells; the cell that the tangent at the middle points to is tried first
        low, high, bits = low << step, high << step, bits + step
        cell = (high - low) >> step
        middle = (low + high) // 2
        value, rise = (sum_at(p, middle, bits) for p in (c, slope))
        guess = middle - (value // rise if rise else 0)  # c has a degree more than its slope, hence a factor 2^bits more
        guess = low + (min(max(guess, low), high - 1) - low) // cell * cell
        tried = False
        for a in (guess, guess - cell, guess + cell):
            if a < low or a + cell > high:
                continue
            end = sign_at(c, a + cell, bits)
            if end == 0:
                return a + cell, a + cell, bits
            if (at_low if a == low else sign_at(c, a, bits)) == -end:
                low, high, tried = a, a + cell, True
                at_low = -end
                break
        if tried:
            step = min(2 * step, 512)
            continue
        step = max(1, step // 2)
        end = sign_at(c, middle, bits)
        if end == 0:
            return middle, middle, bits
        if end == at_low:
            low = middle
        else:
            high = middle
    return low, high, bits


def sum_at(c: list[int], num: int, bits: int) -> int:
    """2^(bits * degree) times the polynomial's value at num / 2^bits."""
    total, shift = 0, 0
    for v in reversed(c):
        total = total * num + (v << shift)
        shift += bits
    return total


def largest_roots(c: list[int], wanted: int) -> list[tuple[Fraction, Fraction, int]]:
    """(root, how far off it may be at most, multiplicity), largest first; roots at zero are left out."""
    while c and not c[0]:
        c = c[1:]
    if len(c) < 2:
        return []
    once = distinct_part(c)
    # one more than wanted: its distance counts too
    spans = isolated(once, wanted + 1, c)
    rough = []
    for low, high, bits, times in spans:
        width = Fraction(low + high, 1 << bits) / 2 / (1 << 24)
        rough.append((*narrowed(once, low, high, bits, width), times))
    found = []
    for i, (low, high, bits, times) in enumerate(rough):
        if sum(t for *_, t in found) >= wanted:
            break
        gaps = [Fraction(high, 1 << bits)]
        for other in (rough[i - 1] if i else None, rough[i + 1] if i + 1 < len(rough) else None):
            while other is not None:
                a, b = sorted(((low, high, bits), other[:3]), key=lambda r: Fraction(r[0], 1 << r[2]))
                gap = Fraction(b[0], 1 << b[2]) - Fraction(a[1], 1 << a[2])
                if gap > Fraction(high - low, 1 << bits) or gap > 0 and low == high:
                    gaps.append(gap)
                    break
                # still too wide to tell the two apart
                width = max(Fraction(high - low, 1 << bits), Fraction(other[1] - other[0], 1 << other[2])) / (1 << 32)
                low, high, bits = narrowed(once, low, high, bits, width) if low < high else (low, high, bits)
                other = (*narrowed(once, *other[:3], width), other[3]) if other[0] < other[1] else other
        width = min(gaps[0] / (1 << ROOT_BITS), min(gaps) / (1 << GAP_BITS))
        if low < high:
            low, high, bits = narrowed(once, low, high, bits, width)
        found.append((Fraction(low + high, 2 << bits), max(width, Fraction(1, 1 << 4096)), times))
    return found


# ---------------------------------------------------------------- components


def null_vectors(matrix: list[list[int]], root: Fraction, off: Fraction, times: int) -> list[list[float]]:
    """Unit vectors that the matrix stretches by `root`: inverse iteration in fixed-point numbers."""
    d = len(matrix)
    bits = max(64, 64 - math.floor(math.log2(off.numerator) - math.log2(off.denominator)))
    shift = int(root * (1 << bits))
    a = [[(v << bits) - (shift if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
    order = list(range(d))
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[pivot] = a[pivot], a[k]
        order[k], order[pivot] = order[pivot], order[k]
        if not a[k][k]:
            a[k][k] = 1  # the root to the last bit
        own, top = a[k], a[k][k]
        for i in range(k + 1, d):
            if a[i][k]:
                f = (a[i][k] << bits) // top
                row = a[i]
                row[k] = f
                for j in range(k + 1, d):
                    row[j] -= f * own[j] >> bits

    def scaled(x):
        largest = max(map(abs, x)).bit_length()
        return [v << bits - largest if largest <= bits else v >> largest - bits for v in x]

    def apart(x):
        for _ in range(2):
            for y in found:
                share = Fraction(sum(p * q for p, q in zip(x, y)), sum(q * q for q in y))
                x = [p - share.numerator * q // share.denominator for p, q in zip(x, y)]
        return x

    found: list[list[int]] = []
    for number in range(times):
        x = [(1 << bits) + ((number + 1) * (i + 1) * 0x9E3779B1 % 65521 << bits - 16) for i in range(d)]
        for _ in range(3):
            x = scaled(apart(x))
            x = [x[i] for i in order]
            for i in range(d):
                x[i] -= sum(a[i][j] * x[j] for j in range(i)) >> bits
            for i in range(d - 1, -1, -1):
                x[i] = ((x[i] - (sum(a[i][j] * x[j] for j in range(i + 1, d)) >> bits)) << bits) // a[i][i]
                if abs(x[i]).bit_length() > 4 * bits:  # only the direction matters
                    x = [v >> 2 * bits for v in x]
        found.append(scaled(apart(x)))
    return [[float(Fraction(v, math.isqrt(sum(q * q for q in x)) or 1)) for v in x] for x in found]


def principal(spark: SparkSession, matrix: list[list[int]], wanted: int = COMPONENTS) -> list[tuple[Fraction, list[float]]]:
    """(eigenvalue, unit vector) of a positive semidefinite whole-number matrix, largest first, without the zeros."""
    roots = largest_roots(characteristic(spark, matrix), wanted)
    if not roots:
        return []

    def run(batches):
        for batch in batches:
            for k, root, off, times in zip(*(c.to_pylist() for c in batch.columns)):
                vectors = null_vectors(matrix, Fraction(root), Fraction(off), times)
                yield pa.RecordBatch.from_arrays([pa.array([k] * times, pa.int32()), pa.array(vectors, pa.list_(pa.float64()))], ["k", "v"])

    rows = spark.createDataFrame([(k, str(r), str(off), times) for k, (r, off, times) in enumerate(roots)], "k int, root string, off string, times int")
    vectors: dict[int, list] = {}
    for r in rows.repartition(len(roots)).mapInArrow(run, "k int, v array<double>").collect():
        vectors.setdefault(r.k, []).append(r.v)
    return [(roots[k][0], v) for k in sorted(vectors) for v in vectors[k]][:wanted]


# ---------------------------------------------------------------- whitening


def whitened_rows(x: np.ndarray, n: int, sums: list[int], basis: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """(values on the components, exact squared deviation from the mean) of rows of whole numbers."""
    reach = n * (int(np.abs(x).max()) if x.size else 0) + max(map(abs, sums))
    if reach < 1 << 62:
        y = n * x - np.array(sums, np.int64)
        exact = (y * y).sum(axis=1).tolist() if reach * reach * len(sums) < 1 << 63 else [sum(v * v for v in row) for row in y.tolist()]
    else:
        y = n * x.astype(object) - np.array(sums, object)
        exact = [sum(v * v for v in row) for row in y]
    return y.astype(np.float64) @ basis, [v if v < 1 << 63 else None for v in exact]


def whiten(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", wanted: int = COMPONENTS) -> DataFrame:
    """Rows (key, component, n, deviation, whitened, explained, identity_error) of all usable vectors on up to `wanted` components.

    Vectors that are null or hold a null or non-finite entry are left out, and so are those of another
    length than most have (of lengths equally frequent, the largest counts).  Entries whose 64-fold
    exceeds 2^62 are taken as that.  Components with no variance are left out: equal vectors, a
    single one, empty ones and an empty table give an empty result.  Rows that repeat, and null or
    repeated keys, each count and come back.  deviation is null where it exceeds a long.  Extra columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings, vector, key)
    kind = dict(embeddings.dtypes)[key]
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths or not lengths[0].d:
        return spark.createDataFrame([], schema)
    d = lengths[0].d
    rows = rows.where(F.size("_v") == d)
    n, sums, products = exact_sums(rows, d)
    scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    found = principal(spark, scatter, wanted)
    if not found:
        return spark.createDataFrame([], schema)
    trace = sum(scatter[i][i] for i in range(d))
    explained = [float(root / trace) for root, _ in found]
    k = len(found)
    # x - S / n is (n x - S) / n, and the covariance is the scatter over n^2
    basis = np.array([[v / root_of(root) for v in unit] for root, unit in found]).T

    def moments(batches):
        count, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w, _ = whitened_rows(integers(batch.column(0), d), n, sums, basis)
            if not len(w):
                continue
            own = w.mean(axis=0)
            move, total = own - mean, count + len(w)
            spread += (w - own).T @ (w - own) + np.outer(move, move) * (count * len(w) / total)
            mean, count = mean + move * (len(w) / total), total
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([mean.tolist()]), pa.array([spread.ravel().tolist()])], ["count", "mean", "spread"])

    parts = cut(rows.select("_v").mapInArrow(moments, "count long, mean array<double>, spread array<double>"))
    means = parts.select("count", F.posexplode("mean").alias("i", "m")).groupBy("i").agg((F.sum(F.col("count") * F.col("m")) / n).alias("m")).collect()
    centre = F.array(*[F.lit(r.m) for r in sorted(means)])
    moved = parts.select("count", F.zip_with("mean", centre, lambda a, b: a - b).alias("m"), F.posexplode("spread").alias("at", "s"))
    i, j = F.floor(F.col("at") / k).cast("int"), F.col("at") % k
    entry = F.col("s") + F.col("count") * F.get("m", i) * F.get("m", j)
    covariance = moved.groupBy("at").agg((F.sum(entry) / n).alias("c")).collect()  # a number for each pair of components
    error = max(abs(r.c - (r["at"] // k == r["at"] % k)) for r in covariance)

    def run(batches):
        names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                w, deviation = whitened_rows(integers(part.column(1), d), n, sums, basis)
                m = len(w)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(deviation, pa.int64()).take(pa.array(each)), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ], names)

    return rows.mapInArrow(run, schema)


def root_of(x: Fraction) -> float:
    """Square root, to double precision whatever the size."""
    shift = max(0, 128 - x.numerator.bit_length() + x.denominator.bit_length())
    shift += shift % 2
    return float(Fraction(math.isqrt((x.numerator << shift) // x.denominator), 1 << shift // 2))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": query}
ORACLES: dict[str, str] = {}
