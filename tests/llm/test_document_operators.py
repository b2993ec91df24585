"""Operators of the document pipeline against plain versions, on awkward rows and on a slice of the shared tables."""

import collections
import fractions
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from flowlens.llm import (
    dartminhash,
    decontam,
    license_scan,
    line_dedup,
    mixing,
    pii_crf,
    quality_gam,
    substring_rlz,
    topk_nra,
    toxicity_knn,
)
from flowlens.llm.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def base(spark):
    return spark


def docs_of(spark, rows, extra=""):
    return spark.createDataFrame(rows, DOCS + extra)


def awkward(spark):
    """Null texts, null ids and sources, empty and blank texts, repeated rows, one very long text."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
    rows = [(1, "one two three four five six seven", "en", "a", 1), (1, "one two three four five six seven", "en", "a", 1),
            (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "en", None, 4), (None, "no id here at all", "en", "b", 5),
            (5, long, "de", "b", len(long)), (6, "Ünï cödé — 日本語 text \U0001F600 ok", "xx", "c", 9), (7, "a\nb\n\nb\n", "en", "a", 7)]
    return docs_of(spark, rows)


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def run_all(spark, docs, labels, benchmark):
    return {
        "quality": quality_gam.score_quality(docs, labels), "mix": mixing.mix(docs), "copies": mixing.copies_of(docs),
        "near": dartminhash.near_duplicates(docs), "first": dartminhash.keep_first(docs),
        "toxic": toxicity_knn.score_toxicity(docs, labels), "lines": line_dedup.drop_boilerplate(docs),
        "pii": pii_crf.find_pii(docs), "license": license_scan.scan_licenses(docs),
        "substring": substring_rlz.dedup_substrings(docs), "leaks": decontam.find_leaks(docs, benchmark),
        "clean": decontam.drop_leaks(docs, benchmark),
    }


PER_ROW = ("quality", "mix", "near", "toxic", "lines", "pii", "license", "substring")


def test_awkward_rows_keep_their_places(spark):
    docs = awkward(spark)
    benchmark = spark.createDataFrame([(0, None), (1, ""), (2, "too short"), (3, "one two three four five six seven")],
                                      "item_id long, text string")
    labels = labels_of(spark, [(1, 1, 0), (None, 0, 1), (5, None, None), (6, 0, 1), (6, 1, 0)])
    got = {name: df.collect() for name, df in run_all(spark, docs, labels, benchmark).items()}
    ids = sorted(str(r["doc_id"]) for r in docs.collect())
    for name in PER_ROW:
        assert sorted(str(r["doc_id"]) for r in got[name]) == ids, name
    assert {r["doc_id"] for r in got["leaks"]} == {1}
    assert 1 not in {r["doc_id"] for r in got["clean"]} and len(got["clean"]) == len(ids) - 2
    assert all(0 <= r["score"] <= 1 for r in got["quality"] + got["toxic"] + got["license"])
    assert {r["doc_id"]: r["text"] for r in got["lines"]}[7] == "a\nb\n\nb\n"
    assert {r["doc_id"]: r["class_id"] for r in got["near"]} == {r["doc_id"]: r["doc_id"] for r in got["near"]}


def test_empty_tables(spark):
    docs, benchmark = docs_of(spark, []), spark.createDataFrame([], "item_id long, text string")
    for name, df in run_all(spark, docs, labels_of(spark), benchmark).items():
        assert df.collect() == [], name
    assert decontam.find_leaks(awkward(spark), benchmark).collect() == []
    assert topk_nra.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_clashing_columns(spark):
    names = "score int, predicted string, held_out long, n_lines int, copy int, labels string, taken int, _score int, class_id long"
    docs = docs_of(spark, [(1, "a b c d e f", "en", "s", 3, 1, "x", 2, 3, 4, "l", 5, 6, 7)], ", " + names)
    benchmark = spark.createDataFrame([(0, "k l m n o p")], "item_id long, text string")
    got = {n: df.collect() for n, df in run_all(spark, docs, labels_of(spark), benchmark).items()}
    assert all(len(rows) == 1 for n, rows in got.items() if n not in ("leaks", "copies"))
    assert got["quality"][0]["score"] == 1 and 0 <= got["quality"][0]["score_"] <= 1
    assert got["lines"][0]["n_lines"] == 3 or got["lines"][0]["n_lines_"] == 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    cursor = db.execute(ORACLES[name])
    order = sorted(range(len(cursor.description)), key=lambda i: cursor.description[i][0])
    want = sorted(tuple(repr(r[i]) for i in order) for r in cursor.fetchall())
    df = QUERIES[name](spark, SMALL)
    got = sorted(tuple(repr(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert got == want and len(got) > 0


def held_out_accuracy(scored, label, held):
    rows = [r for r in scored if r["doc_id"] in label and held(r["doc_id"])]
    assert rows and all(r["held_out"] for r in rows)
    return np.mean([r["predicted"] == label[r["doc_id"]] for r in rows])


def test_quality_and_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    got = QUERIES["op1_quality"](spark, sf).collect()
    assert len(got) == 10_000
    assert held_out_accuracy(got, {r["doc_id"]: r["quality"] for r in labels},
                             lambda i: zlib.crc32(str(i).encode()) % 5 == 0) > 0.97
    got = QUERIES["op4_toxicity"](spark, sf).collect()
    assert held_out_accuracy(got, {r["doc_id"]: r["toxic"] for r in labels},
                             lambda i: zlib.crc32(str(i).encode()) % 3 == 1) > 0.94


def test_block_max_index_is_exact():
    rng = np.random.default_rng(5)
    dense = np.where(rng.random((500, 60)) < 0.08, rng.random((500, 60)), 0)
    dense[::7] = dense[1]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    rows, terms = np.nonzero(dense)
    index = toxicity_knn.BlockMaxIndex(rows, terms, dense[rows, terms], (rng.random(500) < 0.3).astype(float), 60)
    for q in dense[:40]:
        t = np.flatnonzero(q)
        want = np.sort((dense @ q)[dense @ q > 1e-9])[::-1][:9]
        found, cosines = index.nearest(t, q[t], 9)
        assert np.allclose(cosines, want, atol=1e-5) and np.allclose((dense @ q)[found], cosines, atol=1e-5)


def test_every_significant_term_is_a_term(spark):
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 2
        side = "zq"[toxic]
        words = [f"{side}{chr(97 + n // 26)}{chr(97 + n % 26)}" for n in ((i // 2 + 37 * j) % 300 for j in range(8))]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, toxic))
    model = toxicity_knn.fit_neighbours(docs_of(spark, rows), labels_of(spark, labels))
    assert len(model.vocabulary) > 512
    words = {w for _, text, *_ in rows for w in text.split()}
    known = toxicity_knn.term_counts(pa.array(sorted(words)), model.vocabulary)[0]
    assert len(set(known.tolist())) == len(words)


def test_mix_targets_and_repeats(spark):
    rows = [(i, "w " * (1 + i % 9), "en", f"s{i % 4}" if i % 9 else None, 1) for i in range(4000)]
    docs = docs_of(spark, rows)
    one, two = mixing.mix(docs).collect(), mixing.mix(docs.repartition(5)).collect()
    assert sorted(one) == sorted(two)
    by = collections.defaultdict(lambda: [0, 0, 0])
    source = {r[0]: r[3] for r in rows}
    for r in one:
        assert 0 <= r["taken"] <= 3 * r["size"]
        acc = by[source[r["doc_id"]]]
        acc[0], acc[1], acc[2] = acc[0] + r["taken"], r["target"], r["source_size"]
    assert abs(sum(t for _, t, _ in by.values()) - sum(s for _, _, s in by.values())) < 1e-6
    for taken, target, size in by.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) < 0.1 * size
    copies = mixing.copies_of(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in copies} == {r["doc_id"]: r["copies"] for r in one if r["copies"]}


def plain_bag(text):
    words = [w.decode() for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))]
    grams = list(zip(*[words[k:] for k in range(5)], strict=False)) if len(words) >= 5 else [tuple(words)] if words else []
    return collections.Counter(grams)


def test_near_duplicates_equal_brute_force(spark):
    random.seed(4)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows, n = [], 0
    for size in (30, 120, 400):
        for _ in range(12):
            text = [random.choice(vocabulary) for _ in range(size)]
            for _ in range(5):
                other = list(text)
                for i in random.sample(range(size), random.choice([0, 1, size // 60, size // 25])):
                    other[i] = random.choice(vocabulary)
                rows.append((n, " ".join(other), "en", "s", 1))
                n += 1
    rows += [(n + i, "same text many times over again", "en", "s", 1) for i in range(300)]
    rows += [(n + 300, None, "en", "s", 1), (n + 301, "", "en", "s", 1)]
    got = {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(docs_of(spark, rows)).collect()}
    bags = {r[0]: plain_bag(r[1] or "") for r in rows}
    parent = {i: i for i in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(bags)
    for i in ids:
        for j in ids[:i]:
            if bags[i] and bags[j]:
                common = sum((bags[i] & bags[j]).values())
                if common >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - common):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in ids}


def brute_classes(texts):
    """Smallest number connected with each text."""
    bags, parent = [plain_bag(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(bags)):
        for j in range(i):
            common = sum((bags[i] & bags[j]).values())
            if common >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - common):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(bags))]


def graded(n, size, edits, seed):
    """Texts that differ from one text in a few places each: many pairs a little under the threshold."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        text = list(base)
        for i in rng.sample(range(size), rng.randrange(edits + 1)):
            text[i] = rng.choice(["", f"n{rng.randrange(10**6)}", "x y"])
        out.append(" ".join(w for w in text if w))
    return out


def test_a_large_graded_group_loses_no_class(spark):
    texts = graded(260, 150, 8, 1) + graded(60, 40, 3, 2)
    got = {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(docs_of(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_rare_pairs_hold_every_link_between_classes(spark):
    texts = sorted(set(graded(300, 150, 8, 3) + graded(80, 30, 3, 4) + ["a a a a a a a a a a a a", "a a a a a a a a a a a a a"]))
    bags = [plain_bag(t) for t in texts]
    rows = [(i, t, sum(bags[i].values()), i) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "_rep long, _text string, _size long, _class long")
    got = {frozenset((r["_x"], r["_y"])) for r in dartminhash.rare_pairs(
        frame.select("_rep", "_text"), frame.select("_rep", "_size", "_class"), 0.8).collect()}
    want = set()
    for i in range(len(texts)):
        for j in range(i):
            common = sum((bags[i] & bags[j]).values())
            if common >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - common):
                want.add(frozenset((rows[i][0], rows[j][0])))
    assert want <= got and len(got) < 0.5 * len(texts) * (len(texts) - 1) / 2


def test_ids_are_only_names(spark):
    a = "one two three four five six seven eight nine"
    b = "red orange yellow green blue indigo violet black white"
    docs = docs_of(spark, [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a, "en", "s", 1), (3, b, "en", "s", 1)])
    got = {(r["doc_id"], r["class_id"]) for r in dartminhash.near_duplicates(docs).collect()}
    of = {k: [c for d, c in got if d == k] for k in (1, 2, 3)}
    assert of[2] != of[3] and set(of[1]) == {of[2][0], of[3][0]}
    kept = dartminhash.keep_first(docs_of(spark, [(0, a, "en", "s", 1), (1, a, "en", "s", 1), (1, b, "en", "s", 1)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(0, a), (1, b)]
    kept = dartminhash.keep_first(docs_of(spark, [(None, a, "en", "s", 1), (4, a, "en", "s", 1), (4, a, "en", "s", 1), (4, a, "en", "s", 1),
                                                  (None, b, "en", "s", 1), (None, b, "en", "s", 1), (None, "", "en", "s", 1)])).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("4", a), ("None", ""), ("None", b)]


def test_dart_signatures_estimate_weighted_jaccard():
    random.seed(2)
    one = [random.choice("abcdefghij") for _ in range(300)]
    two = one[:260] + [random.choice("klmnop") for _ in range(40)]
    a, b = dartminhash.bags(pa.array([" ".join(one), " ".join(two)]))
    agree = (dartminhash.signature(*a, 3000) == dartminhash.signature(*b, 3000)).mean()
    assert abs(agree - dartminhash.similarity(a, b)) < 0.04


def test_line_dedup_drops_only_frequent_lines_of_the_host(spark):
    rows = [(i, f"menu\nunique line {i}\nmenu", "en", "x", 1) for i in range(60)]
    rows += [(100 + i, f"menu\nother {i}" if i < 4 else f"other {i}", "en", "y", 1) for i in range(60)]
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(docs_of(spark, rows)).collect()}
    assert got[0]["text"] == "unique line 0" and got[0]["n_dropped"] == 2
    assert got[100]["text"] == "menu\nother 0"


def test_substring_dedup_equals_brute_force(spark):
    random.seed(9)
    words = [f"t{i}" for i in range(60)]
    passages = [[random.choice(words) for _ in range(random.choice([12, 13, 14, 30]))] for _ in range(8)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(random.randint(0, 5)):
            text += random.choice(passages) if random.random() < 0.5 else [random.choice(words) for _ in range(random.randint(1, 25))]
        rows.append((i * 7 % 120, "  ".join(text), "en", "s", 1))
    rows += [(500, rows[3][1], "en", "s", 1), (500, rows[3][1], "en", "s", 1), (501, "x " * 40, "en", "s", 1)]
    got = {r["doc_id"]: r for r in substring_rlz.dedup_substrings(docs_of(spark, rows), texts=True).collect()}
    first = {}
    for i, text, *_ in rows:
        w = text.split()
        for p in range(len(w) - 12):
            key = tuple(w[p: p + 13])
            first[key] = min(first.get(key, i), i)
    for i, text, *_ in rows:
        w, gone = text.split(), set()
        for p in range(len(w) - 12):
            if first[tuple(w[p: p + 13])] < i:
                gone |= set(range(p, p + 13))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) == (len(w), len(gone), kept)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_factors_follow_one_reference():
    places, sources = np.array([0, 1, 2, 3, 10, 11]), np.array([4, 4, 5, 5, 4, 4])
    assert substring_rlz.factors(places, sources) == [(0, 14), (2, 14), (10, 14)]


def test_top_k_equals_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 12) / 256]) for i in range(700)]
    rows += [(1000, None), (1001, [float("nan")] * 12), (1002, [None] * 12), (1050, [1.0] * 5), (1100, [float("inf")] * 12),
             (1003, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk_nra.top_k(table, row_block=100, query_block=4).collect()]
    want = []
    fine = {i: np.array(v) * 256 for i, v in rows if v and None not in v and np.isfinite(v).all()}
    for q in (i for i in fine if i % 50 == 0):
        scores = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    assert sorted(got) == sorted(want)


def test_top_k_ranks_large_components_exactly(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8) / 256]) for i in range(200)]
    rows += [(200 + i, [float(x) * 4096.0 ** (i % 4) for x in rng.integers(-9, 10, 8)]) for i in range(200)]
    rows += [(450 + i, [2.0 ** 52 + j * 2 * (i % 3) for j in range(8)]) for i in range(6)]
    rows += [(500, [1e308, -1e308] * 4), (501, [1.7e308, 2.0 ** -8] * 4), (502, [-1e308] * 8), (550, [1e300] + [0.0] * 7)]
    got = topk_nra.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), row_block=90, query_block=3)
    fine = {i: [int(fractions.Fraction(x) * 256 // 1) for x in v] for i, v in rows}
    want = []
    for q in (i for i in fine if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(fine[q], v, strict=True)), i) for i, v in fine.items() if i != q)[:5]
        want += [(q, r, i, -s if abs(s) < 2 ** 63 else None) for r, (s, i) in enumerate(scores, 1)]
    key = lambda r: r[:2]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert any(r[3] is None for r in want)


def plain_pii(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0:
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                  if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_spans_equal_the_patterns():
    random.seed(6)
    for _ in range(20_000):
        text = "".join(random.choice("a1@.+- ()2%é9") for _ in range(random.randint(0, 30)))
        assert pii_crf.base_spans(text) == plain_pii(text)
    assert pii_crf.base_spans("a" * 200_000 + "1" * 100_000) == []


def test_crf_finds_what_the_patterns_miss():
    model = pii_crf.fit_crf(pii_crf.labelled_lines() * 3)
    text = "call (555) 010-9988 or mail bob@intranet, page 12 of 14"
    found = {(pii_crf.KINDS[k], text[a:b]) for k, a, b in pii_crf.found_spans(model, [text])[0]}
    assert ("phone", "(555) 010-9988") in found and ("email", "bob@intranet") in found
    assert not any("12" in piece or "14" in piece for _, piece in found)


def test_viterbi_equals_all_paths():
    model = pii_crf.fit_crf(pii_crf.labelled_lines())
    rng = np.random.default_rng(1)
    feats = rng.integers(0, len(model.names), (1, 4, 3))
    got = model.viterbi(feats, np.array([4]))[0]
    emit, move = model.unary[feats[0]].sum(1), model.pair + model.wall

    def score(path):
        return model.gate[path[0]] + sum(emit[t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False))

    best = max(np.ndindex(*[model.LABELS] * 4), key=score)
    assert abs(score(best) - score(tuple(got))) < 1e-9


def test_license_containment_equals_all_pairs(spark):
    random.seed(3)
    words = sorted({w for _, p in license_scan.TEMPLATES for w in p.split()}) + ["zz", "yy"]
    rows = []
    for i in range(150):
        if random.random() < 0.5:
            line = random.choice(license_scan.TEMPLATES)[1].split()
            if random.random() < 0.5:
                line[random.randrange(len(line))] = random.choice(words)
        else:
            line = [random.choice(words) for _ in range(random.choice([3, 20, 150]))]
        rows.append((i, "x\n" + " ".join(line).title(), "en", "s", 1))
    docs = docs_of(spark, rows)
    got = {r["doc_id"]: (set(r["labels"].split(",")) - {""}, r["score"]) for r in license_scan.scan_licenses(docs).collect()}
    for i, text, *_ in rows:
        want, best = set(), 0.0
        w = text.split("\n")[1].lower().split()
        blocks = [w] if len(w) <= 64 else [w[a: a + 64] for a in range(0, len(w) - 31, 32)]
        for label, phrase in license_scan.TEMPLATES:
            t = set(phrase.split())
            c = max(len(t & set(b)) / len(t) for b in blocks)
            if c >= 0.9:
                want.add(label)
                best = max(best, c)
        for label, phrase in license_scan.PHRASES.items():
            if f" {phrase} " in f" {' '.join(w)} ":
                want.add(label)
                best = 1.0
        assert got[i][0] == want and abs(got[i][1] - best) < 1e-9


WRAPPED = {
    "mit": """/* Permission is hereby granted, free of charge, to any person obtaining
 * a copy of this software and associated documentation files (the
 * "Software"), to deal in the Software without restriction. */""",
    "bsd": """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:""",
    "isc": """// Permission to use, copy, modify, and/or distribute this software for any
// purpose with or without fee is hereby granted, provided that the above
// copyright notice and this permission notice appear in all copies.""",
}


def test_licenses_wrapped_over_lines_are_found(spark):
    code = "\n".join(f"    let value{j} = compute(input{j}, {j});" for j in range(200))
    rows = []
    for i, notice in enumerate(WRAPPED.values()):
        rows += [(10 * i, notice, "en", "s", 1), (10 * i + 1, notice.replace("\n", "\r\n\r\n"), "en", "s", 1)]
        rows += [(10 * i + 2 + j, f"{code[:cut]}\n{notice}\n{code}", "en", "s", 1) for j, cut in enumerate((400, 437, 1200, 2900))]
    rows.append((90, WRAPPED["bsd"].replace("\n", f"\n{code}\n"), "en", "s", 1))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan_licenses(docs_of(spark, rows)).collect()}
    assert got.pop(90) == ("", 0.0)
    assert {i: v[0] for i, v in got.items()} == {i: list(WRAPPED)[i // 10] for i in got} and len(got) == 18
    assert all(score >= 0.9 for _, score in got.values())


def test_leaks_equal_all_windows(spark):
    random.seed(12)
    words = [f"q{i}" for i in range(400)]
    items = [(i, " ".join(random.choice(words) for _ in range(random.choice([15, 40, 59])))) for i in range(12)]
    rows = []
    for i in range(80):
        text = [random.choice(words) for _ in range(random.choice([3, 60, 200]))]
        if i % 3 == 0:
            piece = random.choice(items)[1].split()
            if i % 2:
                piece[random.choice([0, -1])] = "changed"
            at = random.randrange(len(text))
            text[at:at] = piece
        rows.append((i, " ".join(text).upper() if i % 5 == 0 else ", ".join(text), "en", "s", 1))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.find_leaks(docs_of(spark, rows), benchmark).collect()}
    want = {}
    for i, text, *_ in rows:
        w = re.findall(r"\w+", text.lower())
        for item, body in items:
            t = body.split()
            b = plain_bag(body)
            for s in range(max(1, len(w) - len(t) + 1)):
                a = plain_bag(" ".join(w[s: s + len(t)]))
                common = sum((a & b).values())
                sim = common / (sum(a.values()) + sum(b.values()) - common)
                if sim >= 0.8:
                    want[i, item] = max(sim, want.get((i, item), 0))
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


TAKEN = ("_kept", "_bm", "_bh", "_named", "_rate", "_copies", "_gone", "_key", "_row", "_doc", "_stays", "_id", "_text", "_source", "_size",
         "_digest", "_hub", "_rep", "_class", "_n", "_item", "_h", "_w", "_k")


def test_internal_names_are_no_reserved_words(spark):
    texts = ["one two three four five six", "seven eight nine ten eleven twelve", None]
    docs = docs_of(spark, [(i, t, "en", "s", 3, *["v"] * len(TAKEN)) for i, t in enumerate(texts)], "".join(f", {n} string" for n in TAKEN))
    benchmark = spark.createDataFrame([(0, "seven eight nine ten eleven twelve", "x", "y")], "item_id long, text string, _item string, _iw string")
    rows = {name: df.collect() for name, df in (
        ("lines", line_dedup.drop_boilerplate(docs)), ("copies", mixing.copies_of(docs)), ("mix", mixing.mix(docs)),
        ("first", dartminhash.keep_first(docs)), ("near", dartminhash.near_duplicates(docs)), ("clean", decontam.drop_leaks(docs, benchmark)))}
    assert [len(rows[n]) for n in ("lines", "copies", "mix", "first", "near", "clean")] == [3, 3, 3, 3, 3, 2]
    for name in ("lines", "first", "clean"):
        assert all(r[c] == "v" for r in rows[name] for c in TAKEN)


def test_items_without_id_and_short_items_are_found(spark):
    docs = docs_of(spark, [(1, "say: alpha beta gamma delta epsilon zeta eta", "en", "s", 1), (2, "nothing to see here at all", "en", "s", 1),
                           (3, "before tiny phrase after it all", "en", "s", 1), (4, "tiny phrase", "en", "s", 1), (5, "phrase tiny", "en", "s", 1)])
    benchmark = spark.createDataFrame([(None, "alpha beta gamma delta epsilon zeta eta"), (7, "tiny phrase"), (8, "tiny phrase"), (9, ""), (None, None)],
                                      "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["first_word"], r["similarity"]) for r in decontam.find_leaks(docs, benchmark).collect()}
    assert got == {(1, None, 1, 1.0), *((d, i, p, 1.0) for d, p in ((3, 1), (4, 0)) for i in (7, 8))}
    assert sorted(r["doc_id"] for r in decontam.drop_leaks(docs, benchmark).collect()) == [2, 5]


def test_blank_lines_stay(spark):
    rows = [(i, f"own {i}\n\t\nmenu\n\r\n ", "en", "x", 1) for i in range(40)]
    got = line_dedup.drop_boilerplate(docs_of(spark, rows)).collect()
    assert all(r["text"] == f"own {r['doc_id']}\n\t\n\r\n " and r["n_dropped"] == 1 for r in got)


def test_documents_without_id_draw_by_their_texts(spark):
    rows = [(None, f"{'w ' * 9}t{i}", "en", f"s{i % 3}", 1) for i in range(1500)]
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in mixing.mix(docs_of(spark, rows)).collect():
        by[r["target"]][0] += r["taken"]
        by[r["target"]][1] = r["target"]
    assert len(by) == 3 and all(abs(taken - target) < 0.12 * 5000 for taken, target in by.values())
