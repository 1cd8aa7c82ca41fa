"""The training-data operators against brute force, and their defined cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heliograph.llm import ann, bpe, chargrams, common, language_id, license_scan, minhash, mixing, queries, substring_dedup, topk, toxicity, url_filter
from heliograph.llm.license_rules import table
from tests.compare import same

DIR = "/root/testdata/sf0.01"
WORD = re.compile("[^\\x20\\x09-\\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pack string, _pack int, bucket string, rest string, rep string, row string"


def words(t):
    return WORD.findall(t or "")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "p", 1, "b", "r", "rep", "x") for i, t, lang, s in rows], SCHEMA)


def odd(seed=5):
    """Nulls in every column, empty and long texts, ties, repeated rows, shared passages."""
    r = random.Random(seed)
    word = lambda: r.choice(["alpha", "Beta", "gamma", "délta", "x", "über", "12", "a,b"]) + str(r.randrange(300))
    passage = " ".join(word() for _ in range(70))
    rows = [(0, None, "en", "s"), (1, "", "en", None), (2, "one", None, "s"), (3, " \t\n ", "en", "t")]
    rows += [(i, " ".join(word() for _ in range(r.randrange(1, 120))), r.choice(["en", "de", None]), r.choice(["s", "t", None, "z"])) for i in range(4, 30)]
    rows += [(30 + i, f"{word()} {passage} {word()}\n{word()}", "en", "s") for i in range(5)]
    rows += [(40, passage, "en", "t"), (41, passage, "en", "t"), (41, passage, "en", "t"), (None, passage, "en", "t"), (42, "same " * 200, "en", "u"), (43, "same " * 130, "en", "u")]
    rows += [(50, "w" * 30_000, "de", "s"), (51, " ".join(word() for _ in range(6000)), "de", "s")]
    base = [word() for _ in range(200)]
    for i in range(6):
        copy = list(base)
        copy[r.randrange(200)] = f"edit{i}"
        rows.append((60 + i, " ".join(copy), "en", "z"))
    return rows


@pytest.fixture(scope="module")
def odd_docs(spark):
    return docs_of(spark, odd()).cache()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert same(queries.queries()[name](spark, DIR), queries.oracle_sql()[name], DIR)


# substring dedup


def removed(rows, width):
    least = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and least[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("width", [50, 8])
def test_substring_dedup(spark, odd_docs, width):
    want = removed(odd(), width)
    got = substring_dedup.spans(odd_docs, width).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(x[:4] for x in want)
    assert all(sum(s.to_word - s.from_word for s in r.spans) == r.n_removed for r in got)
    back = substring_dedup.dedup(odd_docs, width)
    assert back.columns == odd_docs.columns and back.schema["n_chars"].dataType == odd_docs.schema["n_chars"].dataType
    texts = Counter((i, k if n else t) for (i, _, n, _, k), (_, t, *_) in zip(want, odd()))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == texts
    assert substring_dedup.dedup(odd_docs.filter("false"), width).count() == 0


# near-duplicates


def classes(rows, width, per_cent):
    sets = {}
    for n, (i, t, *_) in enumerate(rows):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[n] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    usable = [n for n in sets if sets[n] and rows[n][0] is not None]
    for a in usable:
        for b in usable:
            x = len(sets[a] & sets[b])
            if a < b and 100 * x >= per_cent * (len(sets[a]) + len(sets[b]) - x):
                up[root(a)] = root(b)
    least = defaultdict(list)
    for n in usable:
        least[root(n)].append(rows[n][0])
    return [(rows[n][0], len(sets[n]), min(least[root(n)]) if n in usable else rows[n][0]) for n in sets]


@pytest.mark.parametrize("width, per_cent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, odd_docs, width, per_cent):
    got = minhash.classes_of(odd_docs, width, per_cent).collect()
    want = classes(odd(), width, per_cent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(want)
    kept = minhash.keep_one(odd_docs, width, per_cent)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _, c in want if i is None or i == c)
    assert minhash.classes_of(odd_docs.filter("false"), width, per_cent).count() == 0


def test_one_row_of_each_class_stays(spark):
    """Rows that share a doc_id are judged by their own texts; repeated rows of the smallest doc_id leave one."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, "en", "s"), (1, a, "en", "t"), (1, a + " end", "en", "s"), (2, a, "en", "s"), (2, b, "en", "s"), (3, b + " x", "en", "s"), (4, None, "en", "s"), (4, "", "en", "s"), (4, None, "en", "s"), (5, b, "en", "s"), (6, "one", "en", "s"), (None, a, "en", "s")]
    kept = minhash.keep_one(docs_of(spark, rows), 5, 80).collect()
    assert Counter(r.doc_id for r in kept) == Counter([1, 2, 4, 4, 4, 6, None])
    assert [r.text for r in kept if r.doc_id == 2] == [b]


def test_chain_that_no_star_covers(spark):
    """Neighbours in a chain are alike, its ends aren't: all are one class."""
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[i * 10 : i * 10 + 200]), "en", "s") for i in range(20)]
    got = minhash.classes_of(docs_of(spark, rows), 3, 85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(classes(rows, 3, 85))
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize("bucket", [0, 100])
def test_links_across_large_buckets(spark, monkeypatch, bucket):
    """Texts of one template that are alike but not linked, with linked pairs among them: rare elements find these all."""
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    r = random.Random(12)
    template = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(60):
        own = [f"o{i}x{j}" for j in range(45)]
        rows.append((3 * i, " ".join(template + own), "en", "s"))
        if i % 3 == 0:
            own[r.randrange(45)] = f"edit{i}"
            rows.append((3 * i + 1, " ".join(template + own), "en", "s"))
    got = minhash.classes_of(docs_of(spark, rows), 3, 85).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == Counter(classes(rows, 3, 85))


def test_sketches_merge_and_estimate():
    a, b = [f"a{i} b c" for i in range(300)], [f"a{i} b c" for i in range(60, 360)]
    col = pa.array([" ".join(a), " ".join(b), " ".join(a + b)])
    h, bounds = minhash.shingles(col, 3)
    k = minhash.registers(h, bounds)
    union = minhash.registers(np.unique(np.concatenate([h[bounds[0] : bounds[1]], h[bounds[1] : bounds[2]]])), np.array([0, len(np.unique(h[: bounds[2]]))]))
    assert (np.maximum(k[0], k[1]) == union[0]).all()
    s = [set(h[bounds[i] : bounds[i + 1]].tolist()) for i in (0, 1)]
    true = len(s[0] & s[1]) / len(s[0] | s[1])
    at, _ = minhash.likelihood([(k[0] > k[1]).sum()], [(k[0] < k[1]).sum()], [(k[0] == k[1]).sum()], [len(s[0])], [len(s[1])], 0.85)
    assert abs(at[0] - true) < 0.15


# mixing


def fair(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, total = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in target]
        rest = total - sum(target.values())
        over = [s for s in free if rest * w[s] / sum(w[x] for x in free) > 2 * sizes[s]]
        if not over:
            return target | {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark, odd_docs):
    rows, takes = mixing.draw(odd_docs)
    sizes = Counter()
    for _, t, _, s in odd():
        sizes[s] += len(words(t))
    want = fair(sizes)
    names = {r.sid: r.source for r in mixing.targets(mixing.sized(odd_docs)).collect()}
    for r in rows.collect():
        assert r.source_size == sizes[names[r.sid]] and r.target == pytest.approx(want[names[r.sid]])
    taken = defaultdict(int)
    per = takes.groupBy("doc_id", "th", "copy").agg(F.sum(F.col("hi") - F.col("lo")).alias("n"))
    key = lambda r: (r.doc_id, r.th, r.copy)
    place = {key(r): (names[r.sid], r.size) for r in rows.collect()}
    for r in per.collect():
        taken[place[key(r)][0]] += r.n
        assert r.n <= 2 * place[key(r)][1]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    have = Counter()
    for r in mixed.collect():
        have[r.source] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert {s: n for s, n in have.items() if n} == {s: n for s, n in taken.items() if n}
    again = mixing.mix(odd_docs)
    assert Counter((r.doc_id, r.text) for r in mixed.collect()) == Counter((r.doc_id, r.text) for r in again.collect())
    assert mixing.mix(odd_docs.filter("false")).count() == 0
    assert mixing.mix(odd_docs.filter("text is null")).count() == 0


def test_mixing_is_native_and_permutes(spark):
    n = 1000
    df = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(7)).alias("p"))
    got = [r.p for r in df.collect()]
    assert sorted(got) == list(range(n)) and got != list(range(n))
    plan = queries.queries()["op2_source_mixing"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# classifiers


def test_toxicity_held_out(spark):
    got = queries.queries()["op4_toxicity"](spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    out = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in out]) >= 0.93
    clean = [r for r in out if not r.toxic]
    assert np.mean([r.predicted for r in clean]) <= 0.03


def test_toxicity_cases(spark, odd_docs):
    labels = spark.createDataFrame([(i, int(i % 2 == 0), None if i == 9 else 0) for i in range(4, 30)] + [(None, 1, 1), (7, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(odd_docs, labels)
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == len(odd()) and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.reject(odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.score < 0.5)
    none = toxicity.fit(odd_docs, labels.filter("false"))
    assert {round(r.score, 6) for r in toxicity.score(odd_docs, none).collect()} == {0.25}
    assert toxicity.score(odd_docs.filter("false"), model).count() == 0


def test_toxicity_learns_from_all_of_the_sample(spark):
    plain = "the quiet river runs past the old mill and the green field "
    rows = [(i, plain * 400 + ("zorgblatt " * 3 if i % 2 else ""), "en", "s") for i in range(60)]  # 24 KB each
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(spark, rows), labels)
    few = model.scores(pa.array([plain + "zorgblatt", plain]))
    assert few[0] > 0.5 > few[1]
    # Words of the later half of 12,000 labelled rows.
    labels = spark.range(12_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    rank = {i: k for k, i in enumerate(r.id for r in spark.range(12_000).orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 32)), "id").collect())}
    rows = [(i, "river mill" + ("" if i % 2 == 0 else " zorgblatt" if rank[i] >= 6_000 else " countryside meadows"), "en", "s") for i in range(12_000)]
    late = toxicity.fit(docs_of(spark, rows), labels, held_out=0)
    assert late.scores(pa.array(["zorgblatt"]))[0] > late.scores(pa.array(["river"]))[0] + 0.1
    assert len(late.table) == 3 << 20


def test_language_held_out_and_blind(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    q = queries.queries()["op3_language_id"]
    got = q(spark, DIR).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in out]) >= 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_cases(spark, odd_docs):
    model = language_id.fit(odd_docs)
    got = language_id.predict(odd_docs, model).collect()
    assert len(got) == len(odd())
    by = {r.doc_id: r for r in got}
    assert by[0].lang_pred == by[1].lang_pred == by[3].lang_pred == "und" and by[0].score == 0
    assert {r.lang_pred for r in got} <= {"und", "en", "de"}
    nothing = language_id.predict(odd_docs, language_id.fit(odd_docs.filter("false"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    one = language_id.train(pa.array(["bonjour le monde", "la vie"]), ["fr", "fr"])
    assert one.predict(pa.array(["quoi", "!!", None]))[0] == ["fr", "und", "und"]
    three = language_id.train(pa.array(["the cat and the dog"] * 9 + ["der hund und die katze"] * 9 + ["de hond en het huis"] * 9 + ["le chat et le chien"] * 9), ["en"] * 9 + ["de"] * 9 + ["nl"] * 9 + ["fr"] * 9)
    assert three.predict(pa.array(["the dog", "und die", "het huis en", "le chat et"]))[0] == ["en", "de", "nl", "fr"]


def test_ngrams_in_blocks_against_sets(monkeypatch):
    """Blocks of places change nothing; n-grams are those of the folded text between spaces."""
    texts = ["Aé b", None, "", "x" * 40, "one two THREE 42"]
    want = set()
    for i, t in enumerate(texts):
        b = bytes(chargrams.CLASS[x] for x in (t or "").encode())
        b = b" " + b + b" "
        for k, n in enumerate((2, 5)):
            for at in range(len(b) - n + 1):
                g = chargrams.grams(np.frombuffer(b[at : at + n], np.uint8), n)
                want.add((i, int(g[0]) + (k << chargrams.BITS)))
    for block in (3, 1 << 18):
        monkeypatch.setattr(chargrams, "BLOCK", block)
        d, f = chargrams.present(pa.array(texts), (2, 5))
        assert list(zip(d.tolist(), f.tolist())) == sorted(want)
        assert [(i, x) for i, u in enumerate(chargrams.distinct(pa.array(texts), (2, 5))) for x in u.tolist()] == sorted(want)
        table = np.where(np.arange(2 << chargrams.BITS) % 3 == 0, np.arange(2 << chargrams.BITS), -1)
        d, f = chargrams.present(pa.array(texts), (2, 5), table)
        assert list(zip(d.tolist(), f.tolist())) == sorted(x for x in want if x[1] % 3 == 0)


def test_toxicity_counts_against_sets(spark):
    """Evidence and log-count ratios as counted by hand, whole long texts included."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(20)) + (" zorgblatt" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(30)]
    rows.append((30, " ".join(word() for _ in range(30_000)) + " zorgblatt", 1))  # beyond any prefix
    sample = spark.createDataFrame(rows, "key long, text string, toxic int")
    model = toxicity.train(sample)
    sets = [set(chargrams.present(pa.array([t]), toxicity.NS)[1].tolist()) for _, t, _ in rows]
    toxic, other = Counter(x for s, (_, _, y) in zip(sets, rows) if y for x in s), Counter(x for s, (_, _, y) in zip(sets, rows) if not y for x in s)
    n1, n0 = sum(y for *_, y in rows), sum(not y for *_, y in rows)
    every = sorted(set(toxic) | set(other))
    gain = toxicity._gain(np.array([toxic[x] for x in every], float), np.array([other[x] for x in every], float), n1, n0)
    best = sorted(zip((-gain).tolist(), every))
    best = [x for g, x in best[: toxicity.FEATURES] if g < 0]
    assert set(model.buckets.tolist()) == set(best)
    p, q = sum(toxic.values()), sum(other.values())
    size = len(toxicity.NS) << chargrams.BITS
    ratio = np.array([np.log(((toxic[x] + 1) / (p + size)) / ((other[x] + 1) / (q + size))) for x in sorted(best)])
    place = {x: i for i, x in enumerate(sorted(best))}
    w, b = toxicity.solve([np.array(sorted(place[x] for x in s if x in place), np.int32) for s in sets], np.array([y for *_, y in rows]), ratio)
    assert np.allclose(w, model.weights) and abs(b - model.intercept) < 1e-9
    scores = model.scores(pa.array([t for _, t, _ in rows]))
    assert [int(x >= 0.5) for x in scores] == [y for *_, y in rows]


def test_rare_languages_have_places_and_batches_decide_nothing(spark):
    r = random.Random(9)
    of = {"en": "the and of to", "de": "der die und zu", "nl": "het een van de"}
    text = lambda lang: " ".join(r.choice(of[lang].split()) + " " + "".join(r.choice("abcde") for _ in range(4)) for _ in range(12))
    rows = [(i, text("en"), "en", "s") for i in range(400)] + [(1000 + i, text("de"), "de", "s") for i in range(400)] + [(2000 + i, text("nl"), "nl", "s") for i in range(8)]
    docs = docs_of(spark, rows)
    model = language_id.fit(docs, sample=60)
    assert model.languages == [["de", "en", "nl"]]
    texts = [t for _, t, *_ in rows] + [text("nl") for _ in range(40)]
    names, scores = model.predict(pa.array(texts))
    assert np.mean([n == "nl" for n in names[-40:]]) >= 0.9
    one = [model.predict(pa.array([t])) for t in texts[:20] + texts[-20:]]
    assert [n[0] for n, _ in one] == names[:20] + names[-20:] and [s[0] for _, s in one] == pytest.approx([*scores[:20], *scores[-20:]], abs=1e-9)
    # By the definition: shares of n-grams by counting.
    x = language_id.vectors(pa.array(texts[:3]), model.place, len(model.weights))
    for t, row in zip(texts[:3], x):
        b = b" " + bytes(chargrams.CLASS[c] for c in t.encode()) + b" "
        have = Counter(int(model.place[int(chargrams.grams(np.frombuffer(b[at : at + n], np.uint8), n, language_id.BITS)[0]) + (k << language_id.BITS)]) for k, n in enumerate(language_id.NS) for at in range(len(b) - n + 1))
        assert {i: v for i, v in enumerate(row.tolist()) if v} == pytest.approx({i: n / sum(have.values()) for i, n in have.items()})


# license scan


def test_license_base_against_words(spark, odd_docs):
    texts = {101: "CC-BY cc by, CC  BY!", 102: "All Rights\nReserved. the General Public License", 103: "all rights reservedx", 104: None, 105: "éall rights reserved", 106: "cc\u2003by"}
    rows = docs_of(spark, [(i, t, "en", "s") for i, t in texts.items()]).unionByName(odd_docs)
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    got = license_scan.scan(rows).collect()
    every = {**texts}
    for i, t, *_ in odd():
        if i is not None and i > 9:
            every[i] = t
    for r in got:
        if r.doc_id not in every:
            continue
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in every[r.doc_id] or ""))
        hits = [(k, label) for p, label, _ in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(hits))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert license_scan.scan(odd_docs.filter("false")).count() == 0


def test_license_rules():
    s = license_scan.Scanner()
    assert len(table()) >= 200
    labels = lambda t: [s.rules[r][0] for _, _, r in s.detections(t.lower())]
    assert labels("Licensed under the GNU Lesser General Public License, version 2.1") == ["lgpl-2.1"] or "lgpl-2.1" in labels("GNU Lesser General Public License, version 2.1")
    assert labels("GNU Lesser General Public License, version 2.1") == ["lgpl-2.1"]
    assert labels("SPDX-License-Identifier: Apache-2.0") == ["apache-2.0"]
    assert labels("SPDX-License-Identifier: (MIT OR Apache-2.0)").count("apache-2.0") == 1
    assert labels("https://creativecommons.org/licenses/by-sa/4.0/") == ["cc-by-sa"]
    assert labels("released under the MIT license") == ["mit"]
    assert labels("nothing to see") == []
    samples = {"mit": "the mit license", "zlib": "zlib license", "unlicense": "the unlicense", "wtfpl": "wtfpl"}
    for label, t in samples.items():
        assert label in labels(t)
    for _, keyword, pattern, _ in table():
        assert keyword == keyword.lower() and re.compile(pattern)


def sample_of(pattern, gap, longest):
    """A text that the pattern matches, with gap wherever anything may stand between words; optional parts are in if longest."""
    from re import _constants as K
    from re import _parser

    def one(node):
        op, arg = node
        if op is K.LITERAL:
            return chr(arg)
        if op is K.IN:
            return next(chr(x if o is K.LITERAL else x[0] if o is K.RANGE else ord("x")) for o, x in arg if o is not K.NEGATE)
        if op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, sub = arg
            blank = sub[0][0] is K.IN and (K.CATEGORY, K.CATEGORY_SPACE) in sub[0][1]
            return gap if blank else every(sub) * max(low, int(longest and high > 0))
        if op is K.BRANCH:
            return every(arg[1][-1 if longest else 0])
        if op is K.SUBPATTERN:
            return every(arg[3])
        assert op in (K.AT, K.ASSERT_NOT, K.ASSERT), op
        return ""

    def every(nodes):
        return "".join(map(one, nodes))

    return every(_parser.parse(pattern))


def test_license_rules_across_lines():
    for label, keyword, pattern, _ in table():
        for gap in ("\n", "  ", "-", " \n "):
            for longest in (False, True):
                text = sample_of(pattern, gap, longest)
                if found := re.search(pattern, text):
                    assert keyword in found.group(), (label, keyword, text)
        assert any(re.search(pattern, sample_of(pattern, "\n", x)) for x in (False, True)), pattern
    s = license_scan.Scanner()
    labels = lambda t: [s.rules[r][0] for _, _, r in s.detections(t.lower())]
    assert labels("Creative\nCommons Attribution-ShareAlike") == ["cc-by-sa"]
    assert labels("GNU Free\n Documentation License") == ["gfdl"]
    assert labels("in the public\ndomain") == ["public-domain"]
    assert labels("End-User License Agreement") == ["proprietary"]
    assert labels("for Good, not  Evil") == [] and labels("software shall be used for Good,\nnot Evil") == ["json"]
    assert labels("Open RAIL-M") == ["openrail"]


def test_license_expressions():
    s = license_scan.Scanner()
    labels = lambda t: [s.rules[r][0] for _, _, r in s.detections(t.lower())]
    assert labels("SPDX-License-Identifier: GPL-2.0-only OR MIT") == ["gpl-2.0-only", "mit"]
    assert labels("# SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nimport x") == ["mit", "apache-2.0", "bsd-3-clause"]
    assert labels("SPDX-License-Identifier: CC-BY-SA-4.0") == ["cc-by-sa-4.0"]
    text = "spdx-license-identifier: gpl-2.0-or-later"
    assert [(text[a:b]) for a, b, _ in s.detections(text)] == ["gpl-2.0-or-later"]
    assert all(p.groups <= 1 for _, p, _ in s.rules)


# vectors


def vectors(spark, n=150, dims=6, seed=2):
    r = random.Random(seed)
    rows = [(i, [round(r.gauss(0, 1), 2) for _ in range(dims)]) for i in range(n)]
    rows += [(200, None), (201, [0.0] * dims), (202, [float("nan")] * dims), (203, [None] * dims), (204, [float("inf")] + [1.0] * (dims - 1)), (205, rows[20][1]), (206, rows[20][1]), (207, [1.0, 2.0]), (208, [1e30] * dims)]
    return rows, spark.createDataFrame([(i, v, 1, "q") for i, v in rows], "vec_id long, embedding array<double>, label int, q_block string")


@pytest.mark.parametrize("blocks", [(8, 16), (2048, 8192)])
def test_block_matrix_join(spark, monkeypatch, blocks):
    monkeypatch.setattr(ann, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(ann, "ROW_BLOCK", blocks[1])
    rows, df = vectors(spark)
    ok = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    v = ann.usable(df)
    got = defaultdict(list)
    for r in ann.search(v.filter("id % 5 = 0"), v, 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for i, q in ok:
        if i % 5 == 0:
            best = sorted(((-dot(q, c), j) for j, c in ok if j != i))[:7]
            assert [x[1] for x in got[i]] == [j for _, j in best]
            assert [x[2] for x in got[i]] == pytest.approx([-s for s, _ in best])
    assert set(got) == {i for i, _ in ok if i % 5 == 0}
    assert ann.search(v.filter("false"), v, 3).count() == 0 and ann.search(v, v.filter("false"), 3).count() == 0


def test_bit_sliced_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 64)
    rows, df = vectors(spark)
    q = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    long = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    v = topk.quantised(df)
    got = defaultdict(list)
    for r in topk.search(v.filter("id % 5 = 0"), v, 9).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for i in q:
        if i % 5 == 0:
            assert got[i] == [(j, long(-s)) for s, j in sorted((-dot(q[i], q[j]), j) for j in q if j != i)[:9]]
    few = v.filter("id < 4")
    assert topk.search(few.filter("id = 0"), few, 9).count() == 3
    same_ = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(40)], "vec_id long, embedding array<double>")
    tied = topk.quantised(same_)
    assert [r.vec_id for r in topk.search(tied.filter("id = 3"), tied, 5).orderBy("rank").collect()] == [0, 1, 2, 4, 5]


@pytest.mark.parametrize("scale, dims, blocks", [(1.0, 64, (16, 32)), (1e9, 5, (16, 32)), (1.0, 2100, (64, 64)), (1e300, 3, (4, 8))])
def test_vectors_of_every_size_with_repeated_ids(spark, monkeypatch, scale, dims, blocks):
    """Ids of two rows each; wide vectors; components beyond 2^31 after scaling, of either kind of row and query."""
    for m in (ann, topk):
        monkeypatch.setattr(m, "QUERY_BLOCK", blocks[0])
        monkeypatch.setattr(m, "ROW_BLOCK", blocks[1])
    monkeypatch.setattr(ann, "CELL_ROWS", 48)
    r = random.Random(3)
    rows = []
    for i in range(60):
        v = [r.gauss(0, 1) * (scale if i % 3 else 1.0) for _ in range(dims)]
        rows += [(i, v), (i, v if i % 4 else [r.gauss(0, 1) for _ in range(dims)])]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    asked = {i: min(v for j, v in rows if j == i) for i in range(0, 60, 5)}
    v = ann.usable(df)
    got = defaultdict(list)
    for x in ann.search(v.filter("id % 5 = 0"), v, 11).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    assert set(got) == set(asked)

    def dot(a, b):
        total = 0.0
        for x, y in zip(a, b):
            total += x * y
        return total if total == total else -np.inf

    for i, q in asked.items():
        best = sorted((-dot(q, c), j) for j, c in rows if j != i)[:11]
        assert got[i] == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    whole = lambda c: [int(np.floor(x * 1024)) for x in c]
    long = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    ints = [(j, whole(c)) for j, c in rows]
    w = topk.quantised(df)
    exact = defaultdict(list)
    for x in topk.search(w.filter("id % 5 = 0"), w, 11).orderBy("query_id", "rank").collect():
        exact[x.query_id].append((x.vec_id, x.score))
    for i, q in asked.items():
        best = sorted((-sum(x * y for x, y in zip(whole(q), c)), j) for j, c in ints if j != i)[:11]
        assert exact[i] == [(j, long(-s)) for s, j in best]


def test_topk_keeps_large_vectors(spark):
    df = spark.createDataFrame([(100, [2.5e6, 1.0]), (200, [1e308, -1.0]), (3, [2.5e6, 0.5]), (4, [1.0, 1.0]), (5, [-1e308, 0.0])], "vec_id long, embedding array<double>")
    v = topk.quantised(df)
    got = [(x.query_id, x.vec_id, x.score) for x in topk.search(v.filter("id % 100 = 0"), v, 10).orderBy("query_id", "rank").collect()]
    top = (1 << 63) - 1
    a, b = [2_560_000_000, 1024], [2_560_000_000, 512]
    assert got == [(100, 200, top), (100, 3, a[0] * b[0] + a[1] * b[1]), (100, 4, a[0] * 1024 + 1024 * 1024), (100, 5, -top - 1), (200, 3, top), (200, 100, top), (200, 4, top), (200, 5, -top - 1)]  # exactly, 3 is nearer to 200 than 100 is


# urls


def by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7x?q#f", "http://example.com/en/8", "x://com/en/", "http://notcom/en/", "https://b.net/de/1", "https://example.net/de/8", "http://org/es/", "http://a.org?/es/", "http://a.org#/", "http://://x", "http://é.ORG/es/ü"] + [f"http://bad.com/en/{i}" for i in range(40)] + [f"http://bad.com/fr/{i}" for i in range(5)]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://com/en/", "h")], "page_id long, url string, host string")
    got = url_filter.judge(df).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        h, p = by_hand(urls[r.page_id]) if r.page_id is not None else ("com", "/en/")
        fits = [(len(t), t, v) for t, v in url_filter.RULES if (h == t.split("/")[0] or h.endswith("." + t.split("/")[0])) and p.startswith("/" + t.split("/", 1)[1])]
        assert (r.host, r.path) == (h, p)
        assert r.rule == (max(fits)[1] if fits else None)
        if fits:
            assert r.verdict == max(fits)[2]
        assert r.verdict in ("allow", "block")
    assert url_filter.judge(df.filter("false")).count() == 0


def test_mined_rules_against_counting(spark):
    r = random.Random(4)
    rows = [([x for x in "abcdef" if r.random() < 0.5], r.choice(["block", "block", None, "allow"])) for _ in range(120)]
    mined = url_filter.mine(spark.createDataFrame(rows, "items array<string>, verdict string"), 0.1, 0.6, 2)
    got = {tuple(x.tokens): (round(x.confidence, 9), round(x.support, 9)) for x in mined.collect()}
    want = {}
    for a in "abcdef":
        for b in "abcdef":
            if a <= b:
                t = tuple(sorted({a, b}))
                have = [v for items, v in rows if set(t) <= set(items)]
                hit = sum(v == "block" for v in have)
                if hit / 120 >= 0.1 and hit / len(have) >= 0.6:
                    want[t] = (round(hit / len(have), 9), round(hit / 120, 9))
    assert got == want
    urls = spark.createDataFrame([(i, list(x)) for i, (x, _) in enumerate(rows)], "key int, items array<string>")
    best = {x.key: round(x.confidence, 9) for x in url_filter.matched(urls, mined).collect()}
    for i, (items, _) in enumerate(rows):
        fit = [c for t, (c, _) in want.items() if set(t) <= set(items)]
        assert best.get(i) == (max(fit) if fit else None)


def test_deep_paths_are_mined_in_bounded_time(spark):
    """Thirty segments that always stand together are one token; nothing grows with their subsets."""
    deep = "/".join(f"s{i}" for i in range(30))
    urls = [f"http://bad.com/en/{deep}"] * 15 + [f"http://bad.com/fr/{deep}"] * 2 + [f"http://fine{i % 4}.net/a/b{i}" for i in range(40)]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert {r.page_id: r.verdict for r in got} == {i: "block" if i < 17 else "allow" for i in range(len(urls))}
    rows = spark.createDataFrame([(["a", 'b"\\\n', "c", "d"], "block")] * 12 + [(["a", "e"], None)] * 4, "items array<string>, verdict string")
    assert {tuple(r.tokens): r.confidence for r in url_filter.mine(rows).collect()} == {("a",): 0.75, ('b"\\\n',): 1.0, ("a", 'b"\\\n'): 1.0}


# byte-level BPE


def test_bpe_is_the_library_s(spark, odd_docs):
    import public_tokenizers as P
    import tiktoken

    path, pattern = bpe.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(6)
    texts = ["", "a", " \n\n x\x1c\x85y", "I'll we've", "q" * 3000, "é" * 90, "日本語" * 40, "😀🏽" * 30, "<|endoftext|>"]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x20, 0x600), r.randrange(0x3000, 0x3100), 9, 10, 32])) for _ in range(200)) for _ in range(60)]
    e = bpe.encoder(path, pattern)
    for t, ids in zip(texts, e.encode(texts)):
        want = lib.encode_ordinary(t)
        assert np.frombuffer(ids, "<u4").tolist() == want and e.decode(ids) == t.encode()
        assert [x for m in e.split(t) for x in e.one(m.encode())] == want
    got = bpe.digests(odd_docs, path, pattern).collect()
    want = Counter()
    for i, t, *_ in odd():
        ids = np.array(lib.encode_ordinary(t or ""), "<u4").tobytes()
        want[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want
    back = bpe.decode(bpe.encode(odd_docs, path, pattern), path, pattern)
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t, *_ in odd())
    assert bpe.digests(odd_docs.filter("false"), path, pattern).count() == 0


# the pipeline


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage is held against brute force on its own input."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "source_mixing", "bpe_encode_decode"] and P.ORACLE_SQL is None
    tables = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, tables[-1], DIR).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
    for t in tables[1:-1]:
        assert t.columns == docs.columns
    rows = [[(r.doc_id, r.text, r.lang, r.source) for r in t.collect()] for t in tables[:-1]]
    toxic = {r.doc_id for r in spark.read.parquet(f"{DIR}/labels.parquet").filter("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{DIR}/labels.parquet").filter("toxic = 0").collect()}
    left = {i for i, *_ in rows[1]}
    assert len(toxic & left) <= 0.1 * len(toxic) and len(clean - left) <= 0.02 * len(clean)
    assert Counter(rows[1]) <= Counter(rows[0])
    # Candidates for brute force: pairs that share a rare shingle.
    sets, shared = {}, defaultdict(list)
    for i, t, *_ in rows[1]:
        w = words(t.translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
        for s in sets[i]:
            shared[s].append(i)
    pairs = {(a, b) for ids in shared.values() for a in ids for b in ids if a < b}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x = len(sets[a] & sets[b])
        if 100 * x >= 80 * (len(sets[a]) + len(sets[b]) - x):
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    assert {i for i, *_ in rows[2]} == {i for i in up if root(i) == i}
    want = {i: (k if n else t) for (i, _, n, _, k), (_, t, *_) in zip(removed(rows[2], 50), rows[2])}
    assert {i: t for i, t, *_ in rows[3]} == want
    sizes, taken = Counter(), Counter()
    for _, t, _, s in rows[3]:
        sizes[s] += len(words(t))
    for _, t, _, s in rows[4]:
        taken[s] += len(words(t))
    for s, n in fair(sizes).items():
        assert abs(taken[s] - n) <= 0.5
    last = tables[-1].collect()
    assert len(last) == len(rows[4]) and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)


def test_common_pieces(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(40, 41), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in common.connected(edges).collect()}
    assert set(got.values()) == {1, 40} and got[20] == 1
    assert common.connected(edges.filter("false")).count() == 0
    buf, offsets = common.texts(pa.array(["a b", None, "", "c"]).slice(1, 3))
    assert bytes(buf) == b"c" and offsets.tolist() == [0, 0, 0, 1]
