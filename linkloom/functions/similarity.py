"""Two-string similarities. Kernels are plain Python that run in one Arrow pass over all columns that need them, each
distinct pair of a batch once; those made of common subsequences take all pairs of a batch at a time, in arrays, with the
same results. What built-in functions express is a Column expression.

Ratios lie in 0..100. Two empty strings are equal (100); one empty string against another scores 0.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@functools.lru_cache(1 << 16)
def _places(text: str) -> dict[str, int]:
    """A bit mask of its places for each character."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


@functools.lru_cache(1 << 16)
def _sorted(text: str) -> str:
    return " ".join(sorted(text.split()))


@functools.lru_cache(1 << 16)
def _token_set(text: str) -> frozenset[str]:
    return frozenset(text.split())


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel longest common subsequence."""
    if len(a) < len(b):
        a, b = b, a
    where = _places(a)
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def indel_ratio(a: str, b: str) -> float:
    if a == b:
        return 100.0
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string against a window of the longer, windows over its ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    m, letters, best = len(a), set(a), 0.0
    for start in range(1 - m, len(b)):
        window = b[max(0, start) : start + m]
        if window[-1] in letters or start + m > len(b):
            best = max(best, indel_ratio(a, window))
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(_sorted(a), _sorted(b))


def token_set_ratio(a: str, b: str) -> float:
    """Best of the ratios between the shared tokens and the shared tokens with either side's own."""
    ta, tb = _token_set(a), _token_set(b)
    if not ta or not tb:
        return 0.0
    both, left, right = sorted(ta & tb), sorted(ta - tb), sorted(tb - ta)
    if both and (not left or not right):
        return 100.0
    core, one, two = " ".join(both), " ".join(both + left), " ".join(both + right)
    out = indel_ratio(one, two)
    return max(out, indel_ratio(core, one), indel_ratio(core, two)) if both else out


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    whole = indel_ratio(a, b)
    if longer < 1.5:
        return max(whole, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if longer <= 8 else 0.6
    ta, tb = _token_set(a), _token_set(b)
    parts = 100.0 if ta & tb else partial_ratio(" ".join(sorted(ta - tb)), " ".join(sorted(tb - ta)))
    return max(whole, scale * partial_ratio(a, b), 0.95 * scale * max(parts, partial_ratio(_sorted(a), _sorted(b))))


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    both = {*a, *b}
    used = next(c for c in map(chr, range(len(both) + 1)) if c not in both)
    rest, hits = b, []
    for i, c in enumerate(a):
        j = rest.find(c, max(0, i - reach), i + reach + 1)
        if j >= 0:
            rest = f"{rest[:j]}{used}{rest[j + 1 :]}"
            hits.append(c)
    if not hits:
        return 0.0
    moved = sum(x != y for x, y in zip(hits, (c for c, r in zip(b, rest) if r == used))) // 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    lead = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + lead * weight * (1 - jaro) if jaro > 0.7 else jaro


@functools.lru_cache(1 << 15)
def _word_grams(word: str, low: int, high: int) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in range(low, min(high, len(w)) + 1) for i in range(len(w) - n + 1)]


@functools.lru_cache(1 << 14)
def char_ngrams(text: str, low: int = 2, high: int = 4) -> Counter:
    """Character n-grams inside blank-padded words."""
    return Counter([g for w in text.split() for g in _word_grams(w, low, high)])


@functools.lru_cache(1 << 14)
def _squares(text: str) -> int:
    return sum(n * n for n in char_ngrams(text).values())


def char_cosine(a: str, b: str) -> float:
    x, y = char_ngrams(a), char_ngrams(b)
    if not x or not y:
        return 0.0
    return float(sum([x[g] * y[g] for g in x.keys() & y.keys()]) / np.sqrt(_squares(a) * _squares(b)))


_word_ratio = functools.lru_cache(1 << 16)(indel_ratio)


@functools.lru_cache(1 << 14)
def _letters_in_order(text: str) -> list[str]:
    return ["".join(sorted(t)) for t in text.split()]


def sorted_letters_ratio(a: str, b: str) -> float:
    """How well the words of ``a`` are spelled by words of ``b`` whatever the order of letters: the mean of each word's best
    ratio. A pair that its lengths alone keep below the best so far isn't compared."""
    mine, other = _letters_in_order(a), _letters_in_order(b)
    if not mine or not other:
        return 0.0
    total = 0.0
    for word in mine:
        best = 0.0
        for o in sorted(other, key=lambda o: abs(len(o) - len(word))):
            if 200.0 * min(len(o), len(word)) / (len(o) + len(word)) <= best:
                break
            best = max(best, _word_ratio(word, o))
        total += best
    return total / len(mine)


def best_variant(a: tuple[str, ...], b: tuple[str, ...]) -> float | None:
    """Best token-set ratio over two lists of core names; null where neither has more than one."""
    return max(token_set_ratio(s, t) for s in a for t in b) if len(a) > 1 or len(b) > 1 else None


KERNELS: dict[str, Callable] = {
    "ratio": indel_ratio, "partial": partial_ratio, "tsort": token_sort_ratio, "tset": token_set_ratio, "wratio": weighted_ratio,
    "jw": jaro_winkler, "char_cos": char_cosine, "sorted_ratio": sorted_letters_ratio, "variants": best_variant,
}


#: Longest text that is compared in arrays, letters that a batch may have for that, and pairs that go through at a time.
LONGEST, LETTERS, TOGETHER = 120, 250, 2048


def _strands(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Semi-local longest common subsequences of many pairs, one a column: a and b hold a character a row, with a filling that
    matches nothing. Strands run through the table of each pair, from its left edge (numbered upwards from 0) and top edge (from
    len(a) on), and two cross once at most; returned is which strand ends below each character of b. So the common subsequence
    of a and b[i:j] is shorter than j - i by the strands in i..j-1 of number len(a) + i or more (Tiskin). Cells of a diagonal
    don't depend on each other."""
    m, n = len(a), len(b)
    a = np.ascontiguousarray(a[::-1])
    left = np.repeat(np.arange(m, dtype=np.uint8)[:, None], a.shape[1], 1)
    top = np.repeat(np.arange(m, m + n, dtype=np.uint8)[:, None], a.shape[1], 1)
    for d in range(m + n - 1):
        low, high = max(0, d - m + 1), min(n - 1, d) + 1
        own = slice(low + m - 1 - d, high + m - 1 - d)
        h, v = left[own], top[low:high]
        out = np.minimum(h, v)
        out ^= (out ^ v) & np.negative((a[own] == b[low:high]).view(np.uint8))  # v where the characters match
        v ^= h
        v ^= out
        h[:] = out
    return top


def _counted(flags: np.ndarray) -> np.ndarray:
    return np.add.reduce(flags.view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64)


def _whole(top: np.ndarray, m: int, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """``indel_ratio``; la, lb: lengths."""
    return 200.0 * (lb - _counted(top >= m)) / np.maximum(la + lb, 1)


def _windows(top: np.ndarray, m: int, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """``partial_ratio`` of a shorter a that isn't empty."""
    inside, best, missed = np.arange(m)[:, None] < la, np.zeros(len(la)), np.zeros(len(la), np.int64)
    for j in range(1, min(m, len(top)) + 1):  # windows over the start of b
        missed += top[j - 1] >= m
        best = np.maximum(best, np.where(j <= la, 200.0 * (j - missed) / (la + j), 0.0))
    for i in range(1, len(top)):
        size = np.minimum(la, lb - i)
        flags = top[i : i + m] >= m + i
        flags &= inside[: len(flags)]
        best = np.maximum(best, np.where(size > 0, 200.0 * (size - _counted(flags)) / (la + np.maximum(size, 1)), 0.0))
    return best


def _in_arrays(pairs: list[tuple[str, str]], ratio: Callable) -> list[float] | None:
    """``ratio`` (``_whole`` or ``_windows``) of pairs of texts of ``LONGEST`` characters at most; None where a batch has too many letters."""
    texts = dict.fromkeys(t for pair in pairs for t in pair)
    width = max(map(len, texts), default=0)
    codes = np.frombuffer("".join(t.ljust(width) for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), width)
    if codes.max(initial=0) < LETTERS:
        codes = codes.astype(np.uint8)
    else:
        letters, found = np.unique(codes, return_inverse=True)
        if len(letters) > LETTERS:
            return None
        codes = found.reshape(codes.shape).astype(np.uint8)
    size, place = np.fromiter(map(len, texts), np.int64, len(texts)), dict(zip(texts, range(len(texts))))
    x, y = (np.fromiter((place[p[k]] for p in pairs), np.int64, len(pairs)) for k in (0, 1))
    out = np.empty(len(pairs))
    order = np.argsort(size[x] * 256 + size[y], kind="stable")
    for at in range(0, len(order), TOGETHER):
        some = order[at : at + TOGETHER]
        la, lb = size[x[some]], size[y[some]]
        m, n = max(1, int(la.max())), max(1, int(lb.max()))
        a, b = np.full((m, len(some)), 254, np.uint8), np.full((n, len(some)), 255, np.uint8)
        for filled, of, length in ((a, x, la), (b, y, lb)):
            k = min(len(filled), width)
            np.copyto(filled[:k], codes[of[some], :k].T, where=np.arange(k)[:, None] < length)
        top = _strands(a, b)
        top[np.arange(n)[:, None] >= lb] = 0  # below the filling
        out[some] = ratio(top, m, la, lb)
    return out.tolist()


class _Batch:
    """Kernels of a batch's pairs that share what they have compared."""

    def __init__(self):
        self.known: dict[str, dict] = {"ratio": {}, "partial": {}}

    def _compared(self, kind: str, pairs: list, asked: list, plain: Callable, ratio: Callable) -> list[float]:
        """Of ``pairs``; ``asked``: those of which the array's work is needed."""
        known = self.known[kind]
        new = [p for p in dict.fromkeys(asked) if p not in known]
        short = [p for p in new if max(map(len, p)) <= LONGEST]
        if short and (found := _in_arrays(short, ratio)) is not None:
            known.update(zip(short, found))
        known.update((p, plain(*p)) for p in new if p not in known)
        return [known[p] for p in pairs]

    def ratio(self, pairs: list) -> list[float]:
        self.known["ratio"].update((p, 100.0) for p in pairs if p[0] == p[1])
        return self._compared("ratio", pairs, pairs, indel_ratio, _whole)

    def partial(self, pairs: list) -> list[float]:
        pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
        self.known["partial"].update(((a, b), (100.0 if a or not b else 0.0)) for a, b in pairs if not a or a in b)
        return self._compared("partial", pairs, pairs, partial_ratio, _windows)

    def tsort(self, pairs: list) -> list[float]:
        return self.ratio([(_sorted(a), _sorted(b)) for a, b in pairs])

    def tset(self, pairs: list) -> list[float]:
        out, asked = [], []
        for a, b in pairs:
            ta, tb = _token_set(a), _token_set(b)
            if not ta or not tb:
                out.append(0.0)
                continue
            both, left, right = sorted(ta & tb), sorted(ta - tb), sorted(tb - ta)
            if both and (not left or not right):
                out.append(100.0)
                continue
            n, one, two = len(" ".join(both)), " ".join(both + left), " ".join(both + right)
            asked.append((len(out), (one, two)))
            out.append(max(200.0 * n / (n + len(one)), 200.0 * n / (n + len(two))))  # shared tokens come first in either
        for (at, _), x in zip(asked, self.ratio([p for _, p in asked])):
            out[at] = max(out[at], x)
        return out

    def wratio(self, pairs: list) -> list[float]:
        full = [p for p in dict.fromkeys(pairs) if p[0] and p[1]]
        longer = {p: max(map(len, p)) / min(map(len, p)) for p in full}
        out, whole = dict.fromkeys(pairs, 0.0), dict(zip(full, self.ratio(full)))
        near, far = [p for p in full if longer[p] < 1.5], [p for p in full if longer[p] >= 1.5]
        for p, x, y in zip(near, self.tsort(near), self.tset(near)):
            out[p] = max(whole[p], 0.95 * max(x, y))
        own = [(_token_set(a), _token_set(b)) for a, b in far]
        parts = self.partial([("", "") if x & y else (" ".join(sorted(x - y)), " ".join(sorted(y - x))) for x, y in own])  # two empty ones give 100
        for p, all_of, part, in_order in zip(far, self.partial(far), parts, self.partial([(_sorted(a), _sorted(b)) for a, b in far])):
            scale = 0.9 if longer[p] <= 8 else 0.6
            out[p] = max(whole[p], scale * all_of, 0.95 * scale * max(part, in_order))
        return [out[p] for p in pairs]


def batch_kernel(kind: str, pairs: list[tuple], batch: _Batch | None = None) -> list[float | None]:
    """The kernel's values of all pairs, each distinct one worked out once."""
    if hasattr(_Batch, kind):
        return getattr(batch or _Batch(), kind)(pairs)
    known = {pair: KERNELS[kind](*pair) for pair in dict.fromkeys(pairs)}
    return [known[pair] for pair in pairs]


def with_kernels(df: DataFrame, wanted: dict[str, tuple[str, str, str]]) -> DataFrame:
    """df with a double column for each name -> (kernel, column, column). One Arrow pass computes all of them; null strings
    count as empty, and a kernel sees each pair of a batch once."""
    columns = list(df.columns)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in wanted]])
    sides = sorted({c for _, *pair in wanted.values() for c in pair})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = {}
            for c in sides:
                values = batch.column(columns.index(c)).to_pylist()
                text[c] = [tuple(v) if isinstance(v, list) else v or "" for v in values]
            own = _Batch()
            found = [pa.array(batch_kernel(kind, list(zip(text[a], text[b])), own), pa.float64()) for kind, a, b in wanted.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*columns, *wanted])

    return df.mapInArrow(run, schema)


def similarity(df: DataFrame, kind: str, a: str = "a", b: str = "b", out: str = "similarity") -> DataFrame:
    return with_kernels(df, {out: (kind, a, b)})


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda t: t != "")


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters two strings share from the start."""
    n = F.least(F.length(a), F.length(b))
    same = F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: x == y)
    other = F.array_position(same, F.lit(False))
    return F.when(other > 0, other - 1).otherwise(n).cast("double")


def anagram_share(a: Column, b: Column) -> Column:
    """The share of the words of ``a`` that are an anagram of a word of ``b``; 0 where either has no word."""
    ordered = lambda text: F.transform(_words(text), lambda t: F.array_join(F.array_sort(F.split(t, "")), ""))
    mine, other = ordered(a), ordered(b)
    return F.when((F.size(mine) > 0) & (F.size(other) > 0), F.size(F.filter(mine, lambda x: F.array_contains(other, x))) / F.size(mine)).otherwise(0.0)


def letters_in_common(a: Column, b: Column) -> Column:
    """Letters that both have, counted with repetitions, as a share of the longer string; blanks aside."""
    a, b = F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit(""))
    count = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    both = F.transform(F.array_distinct(F.split(a, "")), lambda c: F.least(count(a, c), count(b, c)))
    return F.when((a != "") & (b != ""), F.aggregate(both, F.lit(0), lambda s, x: s + x) / F.greatest(F.length(a), F.length(b))).otherwise(0.0)
