import hashlib
import random
import re

import pytest

from linkloom.llm import common, decontam, langid, matroska, ngram_join, pii, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, passage string, node long, words string, anchor long, size long"


def frame(spark, rows):
    """Rows (id, text[, lang[, source]]) in a table with extra columns whose names the operators use inside."""
    full = [(i, t, *(list(rest) + [None, None])[:2], len(t or ""), "x", 1, "y", 2, 3) for i, t, *rest in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


# ---------------------------------------------------------------- substring dedup
def removed_by_brute_force(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot, hot_bound", [(1000, 500_000), (1, 500_000), (1, 0)])
def test_substring_dedup_by_brute_force(spark, hot, hot_bound):
    r = random.Random(3)
    shared = [prose(r, n) for n in (50, 51, 80, 200, 49)]
    rows = [(i, " ".join(x for k in range(3) for x in (prose(r, r.randrange(30)), r.choice(shared)))) for i in range(60)]
    rows += [(100, "for " * 120), (99, "for " * 70), (101, ""), (102, "a b\x0bc \x00d"), (103, rows[0][1]), (103, rows[1][1]), (104, prose(r, 30_000))]
    got = substring_dedup.substring_dedup(frame(spark, [*rows, (105, None)]), hot=hot, hot_bound=hot_bound, shard_words=500)
    found = sorted((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got.collect())
    assert found == removed_by_brute_force([*rows, (105, None)], 50)


def test_substring_dedup_null_id_and_empty(spark):
    text = prose(random.Random(1), 90)
    got = {x["doc_id"]: x["n_removed"] for x in substring_dedup.substring_dedup(frame(spark, [(None, text), (5, text)])).collect()}
    assert got == {None: 0, 5: 0}
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


def test_automaton_first_holders():
    m = substring_dedup.Automaton()
    for holder, words in enumerate(["a b c d".split(), "x b c y".split(), "b c d b c d".split()]):
        m.add([w.encode() for w in words], holder)
    q = [w.encode() for w in "z b c d x b".split()]
    assert m.repeats(q, 2, 9) == [False, True, True, False, True]
    assert m.repeats(q, 2, 1) == [False, True, True, False, False]
    assert m.repeats(q, 3, 9) == [False, True, False, False]


# ---------------------------------------------------------------- n-gram Jaccard join
def components_by_brute_force(rows, k=5, percent=75):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    label = {i: i for i, _ in sets}
    for _ in sets:
        for a, x in sets:
            for b, y in sets:
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(s), label[i]) for i, s in sets}


def test_ngram_components_by_brute_force(spark):
    r = random.Random(5)
    rows = []
    for base in range(6):
        words = prose(r, r.choice([5, 40, 90, 160])).split()
        for _ in range(7):
            for _ in range(r.randrange(3)):
                words = [*words]
                words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(90, "Two Words"), (91, "two words"), (92, ""), (93, " \n"), (94, "for " * 50), (95, "for for for for for"), (96, rows[0][1]), (97, prose(r, 20_000)), (98, None)]
    got = ngram_join.ngram_components(frame(spark, rows), frequent=2)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == components_by_brute_force(rows)


@pytest.mark.parametrize("crowded, heavy", [(0.25, 10_000), (0.25, 5), (2.0, 10_000)])
def test_ngram_components_in_a_crowd(spark, crowded, heavy):
    """Many copies of one text on both sides of the threshold, with and without the second count of frequent tokens and heavy tokens."""
    r = random.Random(8)
    base, rows = prose(r, 110).split(), []
    for i in range(60):
        words = list(base)
        for _ in range(r.randrange(10)):
            at = r.randrange(len(words))
            words[at : at + r.randrange(3)] = [r.choice([f"n{r.randrange(10**6)}", r.choice(base)])]
        rows.append((i, " ".join(words)))
    rows += [(100 + i, prose(r, 60) + " " + " ".join(base[:40])) for i in range(20)]
    want = components_by_brute_force(rows)
    assert len({c for _, c in want.values()}) > 25
    got = ngram_join.ngram_components(frame(spark, rows), frequent=4, crowded=crowded, heavy=heavy)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == want


def test_ngram_components_edges(spark):
    got = ngram_join.ngram_components(frame(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "q r s t u v"), (4, "q r s t u v")])).collect()
    assert {(x["doc_id"], x["component_id"]) for x in got} == {(None, 3), (3, 3), (4, 3)}
    assert ngram_join.ngram_components(frame(spark, [])).count() == 0
    kept = ngram_join.keep_one_of_each(frame(spark, [(1, "a b c d e"), (2, "A b c d e"), (3, None), (4, "")]))
    assert sorted(x["doc_id"] for x in kept.collect()) == [1, 3, 4]


def test_keep_one_with_repeated_and_null_ids(spark):
    a, b, c, d = "a b c d e f", "q r s t u v", "k l m n o p", "z y x w v u"
    rows = [(5, a), (5, a), (6, a), (None, a), (7, b), (6, c), (None, d), (None, d), (8, None), (8, ""), (None, None), (9, b), (9, "one of its own here"), (5, None)]
    got = ngram_join.keep_one_of_each(frame(spark, rows)).collect()
    want = [(5, a), (7, b), (6, c), (None, d), (8, None), (8, ""), (None, None), (9, "one of its own here"), (5, None)]
    assert sorted(str((x["doc_id"], x["text"])) for x in got) == sorted(map(str, want))


# ---------------------------------------------------------------- decontamination
def edit_distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != t))
    return min(row)


def test_leaks_by_brute_force(spark):
    r = random.Random(7)
    items = [(k, prose(r, 30, 10**5)) for k in range(5)]
    plain = lambda s: re.sub(r"[^a-z0-9]+", " ", s.lower()).strip()
    rows = []
    for i in range(50):
        k, t = r.choice(items)
        chars = list(t)
        for _ in range(r.choice([0, 0, 5, 10, 18, 40])):
            chars[r.randrange(len(chars))] = r.choice("abcdefgh")
        rows.append((i, prose(r, 20) + " " + ("".join(chars).upper() if i % 3 else "".join(chars)) + ".\n" + prose(r, 20)))
    rows += [(90, None), (91, ""), (92, "short"), (93, prose(r, 30_000) + " " + items[0][1])]
    bench = spark.createDataFrame([*items, (7, None), (8, "tiny")], "item_id long, text string")
    found = decontam.find_leaks(frame(spark, rows), bench).collect()
    got = {(x["doc_id"], x["item_id"]): x["edits"] for x in found}
    index = decontam.ItemIndex(items, 10, 0.08)
    for i, t in rows[:50]:
        for j, (k, item) in enumerate(items):
            d = edit_distance_in(plain(item), plain(t))
            assert ((i, k) in got) == (d <= index.budget[j]), (i, k, d)
            if (i, k) in got:
                assert got[i, k] == d
    assert got[93, 0] == 0 and not any(i in (90, 91, 92) for i, _ in got)
    span = next(x for x in found if x["doc_id"] == 93)
    assert rows[-1][1][span["start"] : span["end"]] == items[0][1]
    kept = {x["doc_id"] for x in decontam.drop_leaking(frame(spark, rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in got}
    assert decontam.find_leaks(frame(spark, rows), bench.where("false")).count() == 0
    split = decontam.find_leaks(frame(spark, rows), bench, block_chars=200)
    assert {(x["doc_id"], x["item_id"]) for x in split.collect()} == set(got)


def test_leaks_of_short_and_nameless_items(spark):
    """Items shorter than a q-gram match as whole words; equal items without an id all match, in any block."""
    text = "one two three four five six seven"
    bench = spark.createDataFrame([(1, text), (None, text), (None, text), (2, "B-2!"), (3, "?!"), (4, ""), (5, None), (2, "B-2!")], "item_id long, text string")
    rows = [(1, f"x {text} y"), (2, "vitamin b 2, and b2 or b 22"), (3, "B.2"), (None, text), (4, None), (5, "b 2")]
    want = sorted(map(str, [(1, i, 2, 2 + len(text), 0) for i in (1, None, None)] + [(None, i, 0, len(text), 0) for i in (1, None, None)] + [(2, 2, 8, 11, 0), (3, 2, 0, 3, 0), (5, 2, 0, 3, 0)] * 1 + [(2, 2, 8, 11, 0), (3, 2, 0, 3, 0), (5, 2, 0, 3, 0)]))
    for size in (4_000_000, 20):
        got = decontam.find_leaks(frame(spark, rows), bench, block_chars=size)
        assert sorted(str(tuple(x)) for x in got.collect()) == want
        kept = decontam.drop_leaking(frame(spark, rows), bench, block_chars=size)
        assert sorted(x["doc_id"] for x in kept.collect()) == [2, 3, 4, 5] and kept.columns == frame(spark, rows).columns


def test_sieve_loses_no_match():
    r = random.Random(12)
    items = [(k, prose(r, 12, 10**5)) for k in range(40)]
    index, sieve = decontam.ItemIndex(items, 10, 0.08), decontam.Sieve(10)
    sieve.add(index)
    clean = 0
    for _ in range(400):
        chars = list(prose(r, 15) + " " + r.choice(items)[1])
        for _ in range(r.choice([0, 5, 8, 60])):
            chars[r.randrange(len(chars))] = r.choice("abcdefgh")
        text = "".join(chars)
        assert sieve.keeps(text) or not index.matches(text)
        clean += not sieve.keeps(prose(r, 60, 10**5))
    assert clean > 390


# ---------------------------------------------------------------- media
def test_matroska_round_trip(spark):
    r = random.Random(2)
    rows = [(1, None), (2, ""), (3, "a" * 64), (4, "é" * 5000), (5, prose(r, 60_000)), (6, "a" * 64)]
    got = {x["doc_id"]: x for x in matroska.media_columns(frame(spark, rows)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        pad = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest())
    assert got[3]["media_sha256"] == got[6]["media_sha256"]


def test_matroska_lacing_unknown_sizes_and_damage():
    e, n = matroska._element, matroska._uint
    entry = n(matroska.NUMBER, 1) + n(matroska.KIND, 2) + e(matroska.CODEC, b"A")
    xiph = b"\x81\x00\x05\x02\x02" + bytes([255, 1, 3]) + b"x" * 256 + b"yyy" + b"zz"
    fixed = b"\x81\xff\xff\x04\x01" + b"ab" * 2
    ebml = b"\x81\x00\x00\x06\x02" + matroska._ebml_lace([4, 2, 5]) + b"aaaabbccccc"
    group = e(matroska.GROUP, e(matroska.BLOCK, ebml) + n(0xFB, 1))
    cluster = matroska._id(matroska.CLUSTER) + b"\x01" + b"\xff" * 7 + n(matroska.TIME, 100) + e(matroska.SIMPLE, xiph) + e(matroska.SIMPLE, fixed) + group
    segment = matroska._id(matroska.SEGMENT) + b"\xff" + e(matroska.TRACKS, e(matroska.ENTRY, entry)) + cluster + cluster
    data = e(matroska.EBML, e(matroska.DOC_TYPE, b"webm")) + segment
    got = matroska.parse_matroska(data)
    assert got.error == "" and got.doc_type == "webm" and len(got.packets) == 16
    assert [p[3] for p in got.packets[:8]] == [256, 3, 2, 2, 2, 4, 2, 5]
    assert got.packets[0][1] == 105_000_000 and got.packets[3][1] == 99_000_000 and not got.packets[7][4]
    assert data[got.packets[1][2] : got.packets[1][2] + 3] == b"yyy"
    for cut in range(len(data)):
        matroska.parse_matroska(data[:cut])
    assert matroska.parse_matroska(None).error == "empty" and matroska.parse_matroska(b"\x00").error


def test_packet_and_cue_tables(spark):
    media = spark.createDataFrame([(1, bytearray(matroska.write_matroska(b"\x80" * 300_000))), (2, None)], "doc_id long, content binary")
    packets = matroska.packet_table(media).orderBy("packet").collect()
    assert len(packets) == 293 and packets[1]["timestamp_ns"] == 128_000_000 and sum(p["n_bytes"] for p in packets) == 300_000
    assert matroska.cue_table(media).count() == 3


# ---------------------------------------------------------------- personal data
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_by_regex(text):
    out = {}
    for kind, pattern in BASE.items():
        spans = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                spans.append(m.span())
        out[kind] = spans
    return out


def test_pii_by_regex():
    r = random.Random(4)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "0001.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+1", "é", ".", "-", "7", "a@b.c@d.ef", "+12(3", "....", "1.2.3"]
    for _ in range(3000):
        text = "".join(r.choice(parts) + r.choice(["", " ", "x"]) for _ in range(r.randrange(12)))
        assert pii.base_spans(text) == base_by_regex(text), text


def test_pii_rows(spark):
    rows = [(1, None), (2, ""), (3, "iban DE89 3704 0044 0532 0130 00 ok"), (4, "iban DE89 3704 0044 0532 0130 01"), (5, "my ssn 123-45-6789"), (6, "code 123-45-6789"), (7, "1" * 300_000 + "a" * 300_000)]
    got = {x["doc_id"]: x for x in pii.detect_pii(frame(spark, rows)).collect()}
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[3]["spans"] == "iban:5:32"
    assert got[4]["spans"] == "" and got[5]["spans"] == "ssn:7:18" and got[6]["spans"] == "" and got[7]["n_card"] == 0


# ---------------------------------------------------------------- language and toxicity
def test_language_mixture(spark):
    r = random.Random(6)
    make = {"aa": "the then this that with other", "bb": "der die das und nicht schnell", "cc": "les dans avec pour nous très"}
    say = lambda k, n: " ".join(r.choice(make[k].split()) for _ in range(n))
    rows = [(i, say(k, 40), k) for i, k in enumerate(["aa", "bb", "cc"] * 20)] + [(200, None, "aa"), (201, "", None), (202, "123 !!", "bb"), (203, say("aa", 60) + " " + say("bb", 60), None), (204, say("cc", 200_000), None)]
    docs = frame(spark, rows)
    model = langid.fit_language_model(docs)
    got = {x["doc_id"]: x for x in langid.identify_languages(docs, model).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:60])
    assert [got[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3 and got[204]["lang_pred"] == "cc"
    shares = dict(x.split(":") for x in got[203]["mixture"].split(","))
    assert set(shares) == {"aa", "bb"} and abs(float(shares["aa"]) - 0.5) < 0.15
    assert sorted(x["doc_id"] for x in langid.keep_identified(docs, model).collect()) == [*range(60), 203, 204]
    assert langid.fit_language_model(docs.where("false")).predict("abc")[0] == "und"


@pytest.mark.parametrize("seed", range(5))
def test_mixture_by_brute_force(seed):
    """The proportions of expectation-maximisation against the best of a fine grid, and the set against all sets."""
    import itertools

    import numpy as np

    r = np.random.default_rng(seed)
    p = r.dirichlet(np.full(300, 0.05), 3).T + 1e-6
    p /= p.sum(0)
    true = np.array([[1, 0, 0], [0.5, 0.5, 0], [0.7, 0, 0.3], [0.4, 0.3, 0.3], [0.03, 0.97, 0]][seed])
    counts = r.multinomial(3000, p @ true)
    where = np.flatnonzero(counts)
    c = counts[where]
    shares, _ = langid.infer_mixture(np.log(p), where, c, rounds=200)
    likelihood = lambda pi, cols: float(c @ np.log(p[where][:, cols] @ pi))
    best = {}
    for size in (1, 2, 3):
        for cols in itertools.combinations(range(3), size):
            grid = [x for x in itertools.product(np.linspace(0.01, 1, 100), repeat=size) if abs(sum(x) - 1) < 1e-9]
            at = max(grid, key=lambda x: likelihood(np.array(x), list(cols)))
            best[cols] = (likelihood(np.array(at), list(cols)) / 3 - (size - 1) * np.log(c.sum() / 3), at)
    cols = max(best, key=lambda k: best[k][0])
    assert set(np.flatnonzero(shares)) == set(cols)
    assert np.abs(shares[list(cols)] - np.array(best[cols][1])).max() < 0.03


def test_language_edges(spark):
    rows = [(None, "the then this", "aa"), (1, "the then this that", "aa"), (2, "der die das", "bb"), (3, "der die das", "bb"), (3, "der die das", None)]
    docs = frame(spark, rows).withColumnRenamed("words", "lang_pred").withColumnRenamed("size", "score")
    got = langid.identify_languages(docs, langid.fit_language_model(docs)).collect()
    assert len(got) == len(rows) and {x["lang_pred"] for x in got if x["doc_id"] in (2, 3)} == {"bb"}
    assert langid.identify_languages(docs.where("false"), langid.fit_language_model(docs)).count() == 0


def test_threats_and_long_clauses():
    m = toxicity.ToxicityModel({"idiot": 1.0}, toxicity.DEFAULT)
    tags = lambda t: [x[0] for c in m.clauses(t) for x in c]
    assert tags("I will kill you") == ["Ty"] == tags("you will be killed") and tags("they kill time") == tags("kill") == []
    assert tags("I will not kill you") == ["ty"] and tags("he said I will kill you") == ["Try"]
    assert tags("he said " + "word " * 30 + "idiot") == ["Ir"] and tags("you " + "w" * 900 + " idiot") == ["Iy"]
    assert m.score("I will kill you") > 0.5 > m.score("he said you are not an idiot")
    assert m.score("I will kill you") > m.score("kill you") > m.score("you are not an idiot") > m.score("x")
    weights = lambda t: [w for c in m.clauses(t) for *_, w in c]
    assert weights("you are an idiot") > weights("an idiot") > weights("someone said idiot") > weights("never an idiot")
    assert weights("idiot idiot") == [1.0, 0.5]


def test_composed_grammar_equals_the_machines_in_turn():
    r = random.Random(9)
    parts = [toxicity.insult(), toxicity.threat(), toxicity.negation(), toxicity.reported(), toxicity.aimed()]
    for _ in range(500):
        symbols = r.choices(toxicity.SYMBOLS, k=r.randrange(1, 14))
        states, state = [p.start for p in parts], toxicity.GRAMMAR.start
        for x in symbols:
            y, weight = x, 1.0
            for i, part in enumerate(parts):
                states[i], y, w = part.step(states[i], y)
                weight *= w
            state, out, got = toxicity.GRAMMAR.step(state, x)
            assert (out, pytest.approx(weight)) == (y, got)


def test_toxicity_labels_with_clashes_conflicts_and_nulls(spark):
    r = random.Random(10)
    rows = [(i, prose(r, 30) + (" blarg" if i % 4 == 0 else "")) for i in range(200)] + [(None, "blarg you"), (900, "x")]
    labels = [(i, int(i % 4 == 0), "t", i, 0.1) for i in range(200)] + [(4, 0, "t", 1, 0.2), (None, 1, "t", 1, 0.3), (900, None, "t", 1, 0.3)]
    known = spark.createDataFrame(labels, "doc_id long, toxic int, text string, id long, score double")
    model = toxicity.fit_toxicity(frame(spark, rows), known)
    assert "blarg" in model.insults
    got = toxicity.score_toxicity(frame(spark, rows), model).collect()
    assert len(got) == len(rows) and next(x for x in got if x["doc_id"] is None)["score"] > 0.5
    again = toxicity.fit_toxicity(frame(spark, rows).repartition(7), known.repartition(3))
    assert again.insults == model.insults and again.weights.tolist() == pytest.approx(model.weights.tolist(), abs=1e-9)


def test_grammar():
    m = toxicity.ToxicityModel({"idiot": 1.0}, toxicity.np.array([-2.0, 3.0, 0.5, 0.5, 0.5, 1.0, 0.0, 0.5]))
    tags = lambda t: [x[0] for c in m.clauses(t) for x in c]
    assert tags("what an idiot") == ["I"] and tags("you are an idiot") == ["Iy"] and tags("that idiot, you!") == ["Iy"]
    assert tags("never an idiot") == ["i"] and tags("someone said idiot") == ["Ir"] and tags("idiotic") == []
    assert tags("not here. an idiot") == ["I"]
    assert m.score("you idiot") > m.score("someone said not an idiot") > m.score("hello") == m.score(None) == m.score("")
    assert len(m.clauses("idiot " * 20_000)) > 0


def test_toxicity_is_learned(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        words = prose(r, 40).split()
        if bad:
            words[r.randrange(40)] = r.choice(["blarg", "fnord"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs = frame(spark, [*rows, (900, None), (901, "")])
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, known)
    assert {"blarg", "fnord"} <= set(model.insults)
    got = {x["doc_id"]: x["score"] for x in toxicity.score_toxicity(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(300)) and got[900] == got[901] < 0.5
    assert toxicity.fit_toxicity(docs, known.where("false")).score("you idiot") > 0.5


def test_word_hashes_by_range():
    words = [w.encode() for w in "a b c a b c d".split()]
    p = common.Prefix(common.hash_words(words))
    g = p.grams(3)
    assert g[0] == g[3] and len(set(g.tolist())) == 4 and len(p.grams(8)) == 0


def test_ngram_join_reads_texts_in_narrow_batches(spark, monkeypatch):
    """Its jobs hold batches of 1,000 rows at most, and the session's limit is back afterwards."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    own, save = spark.conf.get(key), ngram_join.Scratch.save
    monkeypatch.setattr(ngram_join.Scratch, "save", lambda self, *a, **b: (seen.append(int(spark.conf.get(key))), save(self, *a, **b))[1])
    docs = spark.createDataFrame([(i, f"a b c d e f{i // 2}") for i in range(6)], "doc_id long, text string")
    rows = ngram_join.ngram_components(docs).collect()
    assert [r["component_id"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [0, 0, 2, 2, 4, 4]
    assert seen and max(seen) <= 1000 and spark.conf.get(key) == own
