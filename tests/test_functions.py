import pytest
from pyspark.sql import functions as F

from linkloom.functions import normalize as N
from linkloom.functions import similarity as S


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "clean"), [("P.V.T. Ltd", "pvt ltd"), ("12th & 3rd Street", "12 and 3 street"), ("O'Neil + Sons", "oneil and sons"), (None, ""), ("मॉडर्न", "monddrn"), ("प्राइवेट", "praaivett"), ("Straße", "strasse"), ("2eme rue", "2 rue")])
def test_basic_clean(spark, raw, clean):
    assert one(spark, raw, N.basic_clean) == clean


@pytest.mark.parametrize(("tok", "fixed"), [("8rothers", "brothers"), ("c0mite", "comite"), ("a1", "a1"), ("12ab", "12ab"), ("brothers", "brothers")])
def test_leet(spark, tok, fixed):
    assert one(spark, tok, N.fix_leet) == fixed


@pytest.mark.parametrize(("tok", "key"), [("sharma", "srm"), ("shurma", "srm"), ("limittedd", "lmtd"), ("limited", "lmtd"), ("123", "123")])
def test_skeleton(spark, tok, key):
    assert one(spark, tok, N.skeleton) == key == N.skeleton_of(tok)


def test_names(spark):
    joined = lambda c: F.array_join(N.name_tokens(c), " ")
    assert one(spark, "Vang Private Limited", joined) == one(spark, "vang Pvt. Ltd", joined) == "vang pvt ltd"
    assert one(spark, "bydynamic.com", joined) == "bydynamic"
    core = lambda c: F.array_join(N.core_tokens(N.name_tokens(c)), " ")
    assert one(spark, "The Vang Praaivett Limittedd", core) == "vang"
    assert one(spark, "The Company", core) == "the co"
    assert one(spark, "vang ltd | www.vang.com", N.name_variants) == ["vang ltd | www.vang.com", "vang ltd", "www.vang.com"] or one(spark, "a | b", N.name_variants)[0] == "a | b"
    assert one(spark, "Foo dba Bar", N.name_variants) == ["Foo dba Bar", "Foo", "Bar"]
    assert one(spark, "Foo", N.name_variants) == ["Foo"]


def test_addresses(spark):
    joined = lambda c: F.array_join(N.address_tokens(c), " ")
    assert one(spark, "1020 Fielding Lane, Michigan", joined) == "1020 fielding ln mi"
    assert one(spark, "12 Road, Michigan City", joined) == "12 rd michigan city"
    assert one(spark, "0094 x 3503-3507", N.numbers) == ["3503", "3507", "94"]
    assert one(spark, "<null> 400001 0012 Main", N.house_number) == "12"
    assert [one(spark, x, N.postal_code) for x in ("12 a 400001", "b 400 001", "12 Main 10001-1234", "10001", "none")] == ["400001", "400001", "10001", "", ""]


def test_block_tokens(spark):
    row = spark.createDataFrame([("vang regional finance", "1020 Fielding Ln")], "n string, a string").select(N.block_tokens(N.core_tokens(N.name_tokens(F.col("n"))), N.address_tokens(F.col("a"))).alias("t")).first()["t"]
    assert {"ns:vangregionalfinance", "#:1020", "ab:#1020_fldng", "ab:fldng_ln"} <= set(row) and row == sorted(row)


def test_kernels():
    assert S.indel_ratio("abcd", "abxd") == 75.0 and S.indel_ratio("", "") == 100.0 and S.indel_ratio("", "a") == 0.0
    assert S.partial_ratio("bcd", "abcde") == 100.0 and S.token_sort_ratio("b a", "a b") == 100.0
    assert S.token_set_ratio("a b c", "b a") == 100.0 and S.token_set_ratio("", "a") == 0.0
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.char_cosine("abc", "abc") == pytest.approx(1) and S.sorted_letters_ratio("abc de", "cba ed") == 100.0


def test_native_similarities_by_brute_force(spark):
    import random
    from collections import Counter

    r = random.Random(2)
    rows = [tuple("".join(r.choices("aab c", k=r.randrange(9))).strip() for _ in range(2)) for _ in range(300)] + [("computer", "cmogpurre"), ("", ""), ("x", "")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.letters_in_common(F.col("a"), F.col("b")).alias("bag"), S.anagram_share(F.col("a"), F.col("b")).alias("anagram"), S.common_prefix(F.col("a"), F.col("b")).alias("prefix"))
    for x in got.collect():
        a, b = x["a"], x["b"]
        la, lb = Counter(a.replace(" ", "")), Counter(b.replace(" ", ""))
        assert x["bag"] == pytest.approx((la & lb).total() / max(la.total(), lb.total()) if la and lb else 0.0)
        wa, wb = ([sorted(w) for w in t.split()] for t in (a, b))
        assert x["anagram"] == pytest.approx(sum(w in wb for w in wa) / len(wa) if wa and wb else 0.0)
        assert x["prefix"] == max(n for n in range(min(len(a), len(b)) + 1) if a[:n] == b[:n])
        best = lambda w: max(S.indel_ratio("".join(w), "".join(o)) for o in wb)
        assert S.sorted_letters_ratio(a, b) == pytest.approx(sum(map(best, wa)) / len(wa) if wa and wb else 0.0)


def test_kernels_in_one_pass(spark):
    df = spark.createDataFrame([("a b", None, ["x"]), ("a b", "b a", ["x", "y"]), (None, None, ["z"])], "a string, b string, v array<string>")
    got = S.with_kernels(df, {"r": ("ratio", "a", "b"), "t": ("tsort", "a", "b"), "d": ("variants", "v", "v")}).collect()
    assert [(x["r"], x["t"], x["d"]) for x in got] == [(0.0, 0.0, None), (pytest.approx(100 / 3), 100.0, 100.0), (100.0, 100.0, None)]


@pytest.mark.parametrize(("raw", "plain"), [("Привет Щука", "Privet Shchuka"), ("Αθήνα", "Athena"), ("محمد", "mhmd"), ("さくら", "sakura"), ("서울", "seoul"), ("Łódź naïve", "Lodz naive"), ("१२ ١٢", "12 12"), ("ﬁ ②", "fi 2"), ("გამარ", "gamar")])
def test_transliteration(raw, plain):
    assert N.to_ascii(raw) == plain


def test_ideographs_stay_apart():
    words = {N.to_ascii(c).strip() for c in "中国东京大阪"}
    assert len(words) == 6 and all(w.isascii() and w.isalpha() for w in words)


def test_over_distinct(spark):
    df = spark.createDataFrame([(1, "A & B"), (2, "A & B"), (3, None), (4, "")], "i int, t string")
    got = N.over_distinct(df, "t", lambda c: {"clean": N.basic_clean(c)})
    assert sorted((x["i"], x["clean"]) for x in got.collect()) == [(1, "a and b"), (2, "a and b"), (3, ""), (4, "")]


def test_lcs_by_brute_force():
    import random

    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choices("abc", k=r.randrange(9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert S.lcs_length(a, b) == table[-1][-1]


def test_batch_kernels_by_the_plain_ones():
    import random
    import time

    r, pairs = random.Random(5), [("", ""), ("", "a"), (" ", ""), ("a\0", "\0a"), ("x" * 120, "x" * 119 + "y"), ("ab" * 61, "b" * 130)]
    for letters, most in (("ab", 9), ("abc ", 14), ("aéñ 中ж\0", 20), ("abcdefgh  ", 40)):
        pairs += [tuple("".join(r.choices(letters, k=r.randrange(most))) for _ in range(2)) for _ in range(300)]
    many = ["".join(chr(0x4E00 + r.randrange(400)) for _ in range(9)) for _ in range(200)]  # more letters than a batch's table has
    for kind in ("ratio", "partial", "tsort", "tset", "wratio"):
        for some in (pairs, list(zip(many, reversed(many))), []):
            assert S.batch_kernel(kind, some) == [S.KERNELS[kind](*p) for p in some]
    names = [tuple("".join(r.choices("abcdefghijkl ", k=30)) for _ in range(2)) for _ in range(2000)]
    began = time.thread_time()
    plain = [S.partial_ratio(*p) for p in names]
    middle = time.thread_time()
    got = S.batch_kernel("partial", names)
    assert got == plain and time.thread_time() - middle < 0.5 * (middle - began)


def test_plain_kernels_by_brute_force():
    import random
    from collections import Counter

    r = random.Random(6)
    for _ in range(300):
        a, b = ("".join(r.choices("abc ", k=r.randrange(12))) for _ in range(2))
        x, y = (Counter(g for w in t.split() for n in (2, 3, 4) for g in (f" {w} "[i : i + n] for i in range(len(w) + 3 - n))) for t in (a, b))
        norm = (sum(n * n for n in x.values()) * sum(n * n for n in y.values())) ** 0.5
        assert S.char_cosine(a, b) == pytest.approx(sum(n * y[g] for g, n in x.items()) / norm if norm else 0.0)
        used, hits, reach = set(), [], max(0, max(len(a), len(b)) // 2 - 1)
        for i, c in enumerate(a):
            j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == c), None)
            if j is not None:
                used.add(j)
                hits.append(c)
        moved, m = sum(p != b[j] for p, j in zip(hits, sorted(used))) // 2, len(hits)
        jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3 if m else float(a == b)
        lead = next((i for i, (p, q) in enumerate(zip(a[:4], b[:4])) if p != q), min(4, len(a), len(b)))
        assert S.jaro_winkler(a, b) == pytest.approx(jaro + lead * 0.1 * (1 - jaro) if 0.7 < jaro < 1 else jaro)
