"""The training-data operators against brute-force versions, round trips and edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaframe.llm import bpe, bradley_terry, html_extract, license_scan, mixing, multi_index, pii, quality_rules, simhash, suffix_dedup

WORDS = ["the", "of", "and", "kelp", "moss", "fern", "oak", "ash", "elm", "birch", "Pine", "cedar,", "yew."]


def texts(n, seed=1):
    r = random.Random(seed)
    out = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 120))) for _ in range(n)]
    out += [out[0], out[0], out[1] + " tail", "head " + out[2], "", "   \n\t ", None, out[3] + "\n" + out[3], "x" * 5000, "é" * 400 + out[4]]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None, "xx"][i % 4], ["s0", "s0", "s1", None][i % 4], 7, "extra") for i, t in enumerate(texts(60))]
    rows += [rows[3]]  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").cache()


def test_empty_tables(spark, docs):
    empty = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.judge(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0
    assert pii.pseudonymize(empty, "k").count() == 0 and mixing.mix(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0 and bradley_terry.classify(empty, labels).count() == 0
    assert license_scan.scan(empty).count() == 0


def test_simhash_components(docs):
    rows = docs.select("doc_id", "text").collect()
    got = sorted((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fp = [np.uint64(simhash.fingerprint(r.text)) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(int(fp[i]) ^ int(fp[j])).count("1") <= 3:
                parent[root(i)] = root(j)
    least = collections.defaultdict(lambda: 10**9)
    for i, r in enumerate(rows):
        least[root(i)] = min(least[root(i)], r.doc_id)
    assert got == sorted((r.doc_id, int(fp[i].view(np.int64)), least[root(i)]) for i, r in enumerate(rows))


def test_simhash_hash_is_sparks(spark):
    import xxhash

    text = "a b c"
    own = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert own & (2**64 - 1) == xxhash.xxh64_intdigest(text.encode(), 42)


def test_bucket_forest_is_complete():
    r = np.random.RandomState(0)
    fps = np.unique(np.uint64(1) << r.randint(0, 12, 300).astype(np.uint64) | np.uint64(1) << r.randint(0, 12, 300).astype(np.uint64))
    edges = simhash.bucket_links(fps)
    assert sum(len(a) for a, _ in edges) <= len(fps) - 1
    assert all((np.bitwise_count(a ^ b) <= 3).all() for a, b in edges)


def test_quality_base_counts(docs):
    rows = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for g in quality_rules.judge(docs).collect():
        t = rows[g.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = collections.Counter(grams)
        covered = {p for i, x in enumerate(grams) if c[x] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (g.n_words, g.word_chars, g.n_repeat_words, g.n_dup_lines, g.base_failed) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)), failed)
        assert not (g.kept and failed)


def removed_by_definition(rows, length):
    first = {}
    for doc, t in rows:
        if doc is not None:
            b = (t or "").encode()
            for p in range(len(b) - length + 1):
                w = b[p : p + length]
                first[w] = min(doc, first.get(w, doc))
    out = []
    for doc, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if doc is not None and first[b[p : p + length]] < doc:
                gone[p : p + length] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, chunk", [(50, 1 << 20), (50, 700), (400, 1 << 20), (3, 1000), (1, 64)])
def test_suffix_dedup_brute_force(spark, length, chunk):
    """Short and long lengths, pieces of texts, null and repeated doc_ids with equal and with other texts."""
    r = random.Random(length)
    long = "".join(r.choice("abcd ") for _ in range(3000))
    rows = [(i, t) for i, t in enumerate(texts(14))] + [(90, long), (91, "x" + long[40:2500] + "y"), (92, long[:1200] + long[:1200]), (None, long), (7, long), (7, long[1000:2200]), (92, "tail " + long[2000:])]
    rows += [rows[3], rows[-1]]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, tag int, spans int")
    got = suffix_dedup.remove_repeats(docs, length, chunk=chunk).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == removed_by_definition(rows, length)


def test_suffix_dedup_length_is_checked(docs):
    for length in (0, suffix_dedup.MAX_LENGTH + 1):
        with pytest.raises(ValueError):
            suffix_dedup.remove_repeats(docs, length)


def test_anchor_groups_do_not_depend_on_batches():
    r = np.random.RandomState(8)
    rows = np.unique(np.stack([r.randint(0, 4, 400), r.randint(0, 3, 400), r.randint(0, 12, 400), r.randint(0, 40, 400) * 2], 1), axis=0)
    rows[:, 1] += 10 * rows[:, 0]  # a context belongs to one anchor
    batch = lambda p: suffix_dedup._batch(k=p[:, 0], c=p[:, 1], doc_id=p[:, 2], tag=p[:, 2], span=p[:, 3])
    cut = lambda n: (batch(p) for p in np.array_split(rows, n))
    whole, pieces = (sorted(x for b in suffix_dedup._reduce_anchors(cut(n)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)) for n in (1, len(rows)))
    assert whole == pieces and len(whole) == len(rows)
    one_doc = np.array([[1, 1, 5, 0], [1, 2, 5, 2], [2, 9, 4, 4]])
    assert not [b for b in suffix_dedup._reduce_anchors(iter([batch(one_doc)]))]


def test_bpe_matches_the_library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    own, library = bpe.codec(path), Tokenizer.from_file(path)
    for t in [t or "" for t in texts(20)] + ["<|endoftext|>a<|endoftext|>", "日本 😀", "it's  \n\n x", "a" * 3000, "\x00\xad ²"]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False) == t
    assert own.encode(None) == []


def test_mix(docs):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == docs.count()
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 + min(r.size for r in own if r.size)
    assert all(0 <= r.copies <= 3 and r.taken == r.size * r.copies for r in got)


def test_license(spark):
    rows = [(1, "prose here\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "we met. RELEASED under the MIT license. then left"), (3, "nothing"), (4, None)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].best_license == "Apache-2.0" and got[1].best_score == 1.0 and got[2].best_license == "MIT"
    assert got[3].n_matches == got[4].n_matches == 0 and got[4].best_license is None


def test_top_k_is_exact(spark):
    r = np.random.RandomState(5)
    vectors = r.randn(300, 64)
    vectors[50:90] = vectors[0]  # a hot code
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900, None)]
    codes = multi_index.sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = multi_index.search(codes, codes.where("id % 20 = 0"), k=5).collect()
    bits = vectors > 0
    expected = [(q, k + 1, i, d) for q in range(0, 300, 20) for k, (d, i) in enumerate(sorted((int((bits[q] != bits[j]).sum()), j) for j in range(300) if j != q)[:5])]
    assert sorted(map(tuple, got)) == expected


def test_classifier_learns_and_holds_out(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(WORDS) + ("###" if i % 2 else "") for _ in range(60)), "en") for i in range(200)] + [(999, None, None)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, quality int")
    got = bradley_terry.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()
    held = [g for g in got if g.held_out and g.doc_id < 200]
    assert len(got) == 201 and all(0 <= g.score <= 1 for g in got)
    assert np.mean([g.predicted == 1 - g.doc_id % 2 for g in held]) > 0.95


def test_classifier_edges(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(WORDS[:6] if i % 2 else WORDS[6:]) for _ in range(40)), "x") for i in range(120)] + [(None, "free", "x"), (7, None, "x"), (8, "", "x"), (8, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    labels = [(i, i % 2) for i in range(120)]
    got = bradley_terry.classify(docs, spark.createDataFrame(labels + labels + [(9, 0), (None, 1), (10, None)], "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and [g.held_out for g in got if g.doc_id is None] == [None]
    held = [g for g in got if g.held_out and g.doc_id not in (7, 8)]
    assert np.mean([g.predicted == g.doc_id % 2 for g in held]) > 0.95  # word features alone tell these apart
    one = bradley_terry.classify(docs, spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")).collect()
    assert {g.predicted for g in one} == {1}
    none = bradley_terry.classify(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {g.score for g in none} == {0.5}


def test_ngram_shares():
    parts = bradley_terry.ngram_shares("Kelp and moss and fern") ** 2
    assert parts[: bradley_terry.BUCKETS].sum() == pytest.approx(1) and parts[bradley_terry.BUCKETS :].sum() == pytest.approx(1)
    assert bradley_terry.ngram_shares(None).sum() == bradley_terry.ngram_shares("").sum() == 0
    long = bradley_terry.ngram_shares("ab cd " * 400_000)
    assert np.allclose(long[bradley_terry.BUCKETS :], bradley_terry.ngram_shares("ab cd " * 100)[bradley_terry.BUCKETS :], atol=0.02)


def test_top_k_edges(spark):
    r = np.random.RandomState(6)
    own = [(i, int(c)) for i, c in enumerate(r.randint(0, 40, 120))] + [(3, 1 << 40), (500, None), (None, 7)]  # near codes, many ties
    codes = spark.createDataFrame(own + own[:5], "id long, code long")
    asked = [(1000, -1), (1001, 0), (1002, 0), (4, own[4][1])]  # codes that are not in the table, equal ones, and one that is
    got = multi_index.search(codes, spark.createDataFrame(asked, "id long, code long"), k=4).collect()
    known = {}
    for i, c in own:
        if i is not None and c is not None:
            known[i] = min(c, known.get(i, c))
    apart = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    expected = [(q, n + 1, i, d) for q, c in asked for n, (d, i) in enumerate(sorted((apart(c, x), i) for i, x in known.items() if i != q)[:4])]
    assert sorted(map(tuple, got)) == sorted(expected)
    few = codes.where("id in (1, 2)")
    assert multi_index.search(few, few, k=10).count() == 2
    assert multi_index.search(few.limit(0), few, k=10).count() == 0 and multi_index.search(few, few.limit(0), k=10).count() == 0


def test_license_windows(spark):
    import textwrap

    full, short = license_scan.FULL_TEXTS, license_scan.TEMPLATES
    wrapped = {
        "MIT": full["MIT"][0], "BSD-3-Clause": full["BSD-3-Clause"][0], "BSD-2-Clause": full["BSD-2-Clause"][0], "GPL-3.0": full["GPL-3.0"][0], "ISC": short["ISC"][0], "Apache-2.0": short["Apache-2.0"][1],
    }
    prose = "kelp and moss grow\nof the fern in the oak\n"
    rows = [(i, prose * 3 + "\n\n".join(textwrap.fill(x, 60) for x in t.split(". ")) + "\n" + prose * 3) for i, t in enumerate(wrapped.values())]
    rows += [(90, prose * 50), (91, rows[0][1] + rows[3][1]), (92, "Licensed under CC BY 4.0.\n" * 400 + full["MIT"][0])]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {name: (got[i].best_license, got[i].n_matches) for i, name in enumerate(wrapped)} == {name: (name, 1) for name in wrapped}
    assert got[90].n_matches == 0 and sorted(m.license for m in got[91].matches) == ["GPL-3.0", "MIT"]
    assert got[92].n_matches == 401


def test_license_versions_sentences_and_rows(spark):
    short, full = license_scan.TEMPLATES, license_scan.FULL_TEXTS
    two = "Licensed under the Apache License, Version 2.0. Released under the MIT license."
    gnu = "This work is licensed under the GNU General Public License, version "
    rows = [(1, f"{gnu}9", "x"), (2, f"{gnu}2", "x"), (3, two, "x"), (3, two, "x"), (None, "we met here. " + full["MIT"][0] + " We left again. " * 2000, "x"), (5, "", "x")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, matches string")).collect()
    by = {g.doc_id: g for g in got}
    assert len(got) == 6 and by[1].n_matches == 0 and by[2].best_license == "GPL-2.0"
    assert {m.license for m in by[3].matches} == {"Apache-2.0", "MIT"} and by[None].best_license == "MIT" and by[5].matches == []
    assert by[None].best_score > 0.95


def test_license_windows_brute_force():
    r = random.Random(7)
    scanner = license_scan.Scanner({"A": ("a b c d e f g h i j",), "B": ("d e f g k l m",)}, 0.8)
    for _ in range(300):
        lines = [" ".join(r.choice(["a b c", "d e f g", "h i j", "k l m", "x", "d e", "", "b c d e f"]).split()) for _ in range(r.randint(2, 12))]
        filled = [x.split() for x in lines if x]
        words = [w for x in filled for w in x]
        starts = [sum(map(len, filled[:k])) for k in range(len(filled) + 1)]
        scores = [
            2 * len(own & known) / (len(own) + n) for n, _, known in scanner.known for i in range(len(filled)) for j in range(i + 1, len(filled)) if (own := license_scan.bigrams(" ".join(words[starts[i] : starts[j + 1]])))
        ]
        got = scanner.windows([f"{a} {b}" for a, b in zip(words, words[1:])], starts)
        expected = max([s for s in scores if s >= 0.8], default=None)
        single = [2 * len(own & known) / (len(own) + n) for n, _, known in scanner.known for x in filled if (own := license_scan.bigrams(" ".join(x)))]
        if expected is not None and expected > max(single, default=0):
            assert max(w[0] for w in got) == pytest.approx(expected)
        assert all(w[0] in scores for w in got)


def test_attributes_by_whole_names():
    signature = html_extract._signature
    for plain in (' style="overflow:hidden"', " title='hidden gems'", ' data-hidden="false"', ' data-id="footer"', ' data-x = "a id=nav"', " alt=class=menu"):
        assert signature("div", plain)[0] == "div"
    for marked in (" hidden", " HIDDEN=''", ' data-x="1" class="a menu"', " id=footer", " aria-hidden = 'true'", ' a="b"role="navigation"'):
        assert signature("div", marked)[0] == "div!"


def test_html_copies_and_links(spark):
    story = "<body><div><p>%s first part of a story</p><p>%s the second part, which is longer</p></div><div>Call us</div><p>%s</p></body>"
    rows = [(i, f"http://c.org/{i}", story % ("One", "One", f"Page {i} of 6")) for i in range(6)] + [(10 + i, f"http://c.org/x{i}", story % (f"S{i}", f"T{i}", "")) for i in range(4)]
    rows += [(60 + i, f"http://g.org/{i}", f"<body><div class=u><p>Call us</p></div><p>Body {i} and more</p></body>") for i in range(20)]
    notice = "A notice that is longer than the text of any page of this host"
    rows += [(30 + i, f"http://e.org/{i}", f"<body><p>{notice}</p><p>Body {i}</p>{'<p>See</p>' * (i < 4)}</body>") for i in range(20)]
    rows += [(20, "http://d.org/", "<body><p>See <a href='/x'>the long report on kelp</a></p><ul><li><a href='/'>Home</a></li></ul></body>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"One first part of a story One the second part, which is longer Page {i} of 6" for i in range(6))
    assert all(got[10 + i] == f"S{i} first part of a story T{i} the second part, which is longer" for i in range(4))
    assert all(got[30 + i] == f"{notice} Body {i}" + " See" * (i < 4) for i in range(20))  # a sentence among others, on however many pages
    assert all(got[60 + i] == f"Body {i} and more" for i in range(20))
    assert got[20] == "See the long report on kelp"


def test_html_constants_inside_articles(spark):
    page = "<body><article><div class='x1'>Read more at our shop</div><p>Body %s text</p><p>%s</p></article></body>"
    rows = [(i, f"http://f.org/{i}", page % (i, "Said twice" if i < 2 else "")) for i in range(6)]
    rows += [(10 + i, f"http://g.org/{i}", page % (1, "")) for i in range(6)]  # copies of one page
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(6)] == [f"Body {i} text" + " Said twice" * (i < 2) for i in range(6)]
    assert {got[10 + i] for i in range(6)} == {"Read more at our shop Body 1 text"}


def test_training_rows_are_chosen_once_and_bounded(spark):
    rows = [(i, f"{'good words flow on' if i % 2 else '### $$$ junk'} {i}", "x") for i in range(60)] + [(60, None, "x"), (3, "another text of the same id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c_id string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(61)], "doc_id long, quality int")
    once, twice = bradley_terry.train(docs, labels), bradley_terry.train(docs.unionByName(docs).repartition(3), labels)
    assert once.threshold == twice.threshold and once.weights.tolist() == twice.weights.tolist()
    few = bradley_terry.train(docs, labels, max_rows=10)
    assert few.weights.tolist() == bradley_terry.train(docs.unionByName(docs), labels, max_rows=20).weights.tolist()


def test_training_moves_only_chosen_texts(spark, monkeypatch):
    rows = [(i, f"{'good words flow on' if i % 2 else '### $$$ junk'} {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen, own = [], bradley_terry.text_features
    monkeypatch.setattr(bradley_terry, "text_features", lambda df, *names: (seen.append(df), own(df, *names))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with labels too large to send
    try:
        bradley_terry.train(docs, labels, max_rows=10)
        plan = spark._jvm.PythonSQLUtils.explainString(seen[0]._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [p for p in plan.split("\n\n") if ") Exchange\n" in p and "text#" in p.split("Arguments")[0]]
    assert len(moved) == 1  # the one that drops repeated rows among the chosen
