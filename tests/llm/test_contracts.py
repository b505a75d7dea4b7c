"""Operators and pipeline stages against independent brute-force versions, with nulls, ties, repeated rows, hot groups and clashing columns."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest

from sylvaframe.llm import components, mixing, quality_rules, shingle_links, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = ["the", "of", "and", "kelp", "moss", "fern", "oak", "ash", "elm", "birch", "Pine", "cedar,", "yew."]


def prose(r, n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source, n_chars, row, __salt) with null and repeated ids, repeated rows, copies and null texts."""
    r = random.Random(11)
    base = [prose(r, r.randint(1, 150)) for _ in range(70)]
    base += [base[0]] * 12 + [base[1] + " end", "", "  \n", None, None, "one", "two words", "é " * 200]
    out = [(i if i % 17 else None, t, ["en", "fr", None][i % 3], ["a", "b", None, "a"][i % 4], 5, "clash", i) for i, t in enumerate(base)]
    return out + [out[2], out[2], (2, "another text under one id", "en", "a", 1, "clash", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, __salt int").cache()


# SimHash


def simhash_of(text):
    """Majority of the bits of XXH64 of the 3-word shingles, bit by bit."""
    import xxhash

    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > len(hashes) / 2) if hashes else 0


def groups_of(fps, bits=3):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= bits:
            parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_simhash_brute_force(docs, rows):
    fps = [simhash_of(x[1]) for x in rows]
    least = {}
    roots = groups_of(fps)
    for x, g in zip(rows, roots, strict=True):
        least[g] = min([v for v in (least.get(g), x[0]) if v is not None], default=None)
    expected = collections.Counter((x[0], f, least[g]) for x, f, g in zip(rows, fps, roots, strict=True))
    got = simhash.near_duplicates(docs).collect()
    assert collections.Counter((g.doc_id, g.fp & (2**64 - 1), g.component_id) for g in got) == expected
    kept = simhash.representatives(docs).collect()
    assert len(kept) == len(set(roots)) and kept[0].__fields__ == docs.columns
    best = {g: min((x[0] is None, x[0] or 0) for x, h in zip(rows, roots, strict=True) if h == g) for g in set(roots)}
    assert sorted((k.doc_id is None, k.doc_id or 0) for k in kept) == sorted(best.values())


def similar_groups(texts, groups, words=5, similarity=0.8):
    """groups, merged where two sets of lower-cased word shingles have the similarity or more, pair by pair."""
    split = [WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    sets = [{tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set() for w in split]
    groups = list(groups)
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if groups[i] != groups[j] and both and both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
            groups = [groups[i] if g == groups[j] else g for g in groups]
    return groups


def test_similar_sets_brute_force(spark):
    """Families of near copies, chains, a passage that many short texts share, repeated lines, cases, few words, null and repeated rows."""
    r = random.Random(8)
    prose = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    texts = [None, "", " ", "one two", "ONE two", "one two three four five", "one two three four five six"]
    for n in (9, 40, 70, 127, 128, 300, 900):
        base = prose(n)
        texts.append(" ".join(base))
        for k in range(8):
            copy = list(base)
            for at in r.sample(range(n), max(1, n * k // 150)):
                copy[at] = f"x{r.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    chain = prose(200)
    texts += [" ".join(chain[9 * k :] + prose(9 * k)) for k in range(12)]
    passage = prose(50)
    texts += [" ".join(prose(30) + passage) for _ in range(30)] + [" ".join(passage + ["end", str(k)]) for k in range(9)]
    line = " ".join(prose(60))
    texts += [line, "\n".join([line] * 40)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, texts[9], 0), (3, texts[3], 3), (70, texts[20], 1)]
    expected = similar_groups([x[1] for x in rows], groups_of([simhash_of(x[1]) for x in rows]))
    least = collections.defaultdict(list)
    for x, g in zip(rows, expected, strict=True):
        least[g].append((x[0] is None, x[0] or 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int").repartition(3)
    kept = simhash.representatives(docs, similarity=0.8).collect()
    assert sorted((k.doc_id is None, k.doc_id or 0) for k in kept) == sorted(min(x) for x in least.values())
    assert len(least) < len({g for g in groups_of([simhash_of(x[1]) for x in rows])}) and kept[0].__fields__ == docs.columns
    assert simhash.representatives(docs.limit(0), similarity=0.8).count() == 0
    with pytest.raises(ValueError):
        simhash.representatives(docs, similarity=0.4)


def test_parts_are_alike_for_similar_sets():
    """Pairs just at the limit share a key, at sizes about powers of two."""
    r = np.random.default_rng(4)
    for n in (1, 2, 6, 31, 45, 63, 64, 65, 127, 128, 129, 250, 256, 1000, 5000):
        for _ in range(60):
            hashes = r.integers(0, 2**63, 2 * n, dtype=np.uint64)
            gone = int(n * 0.2 / 1.8)
            a, b = np.sort(hashes[:n]), np.sort(np.concatenate([hashes[gone:n], hashes[n : n + gone]]))
            longer = np.sort(hashes[: n + n // 4])
            assert all(len(np.intersect1d(shingle_links.part_keys(a, 0.8), shingle_links.part_keys(x, 0.8))) for x in (b, longer))
            assert len(shingle_links.part_keys(longer, 0.8)) <= 128


def test_large_buckets_are_cut_on(spark):
    r = random.Random(5)
    centre = r.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in r.sample(range(32), r.randint(0, 9))) for _ in range(150)} | {r.getrandbits(64) for _ in range(20)}
    fps |= {f ^ sum(1 << b for b in r.sample(range(64), 3)) for f in sorted(fps)[:60]}
    fps = sorted(fps)
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    found = [(a & (2**64 - 1), b & (2**64 - 1)) for a, b in map(tuple, simhash.links(table, most=4).collect())]
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in found:
        parent[root(a)] = root(b)
    of = groups_of(fps)
    assert len({(root(f), g) for f, g in zip(fps, of, strict=True)}) == len(set(of)) == len({root(f) for f in fps})


def test_pieces_cover_three_bits():
    for free in (0xFFFFFFFF00000001, 0xFFFF, 0b1011):
        own = simhash.pieces(free)
        assert sum(own) == free and all(a & b == 0 for a, b in itertools.combinations(own, 2))


def test_components_of_a_star_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (3, 0)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 400)} | {1000 + i: 1000 for i in range(1, 41)}


# quality rules


def jensen_shannon(p, q):
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)
    return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))


def judged_by_definition(texts):
    """texts: (text, lang) -> list of (base counts, kept)."""
    n = len(texts)
    size = collections.Counter(lang for _, lang in texts)
    large = {lang for lang, k in size.items() if lang is not None and k >= max(quality_rules.MIN_LANG_DOCS, quality_rules.MIN_LANG_SHARE * n)}
    words = [WORD.findall(t or "") for t, _ in texts]
    lists = {}
    for lang in large:
        seen = collections.Counter(w for (_, x), own in zip(texts, words, strict=True) if x == lang for w in set(own))
        lists[lang] = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0].encode()))[: quality_rules.N_COMMON]]
    out = []
    for (text, lang), w in zip(texts, words, strict=True):
        text = text or ""
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = collections.Counter(grams)
        covered = len({p for i, g in enumerate(grams) if c[g] > 1 for p in (i, i + 1, i + 2)})
        lines = [x for x in text.split("\n") if WORD.search(x)]
        chars = sum(map(len, w))
        symbols, upper, mark = len(re.findall(r"[#*$%&|<>]", text)), sum(x.isupper() for x in text), len(re.findall(r"[!\"'()+,\-./:;=?@\[\\\]^_`{}~0-9]", text))
        failed = len(w) < 50 or 100 * covered > 50 * len(w)
        name = lang if lists.get(lang) else "und"
        p = [x / len(text) for x in (chars - symbols - upper - mark, upper, mark, symbols, len(text) - chars)] if len(w) >= 50 else None
        common = [w.count(x) for x in lists.get(lang, [])] + [0] * (quality_rules.N_COMMON - len(lists.get(lang, [])))
        q = [x / len(w) for x in [*common, len(w) - sum(common)]] if len(w) >= 200 and name != "und" else None
        out.append([(len(w), chars, symbols, len(lines) - len(set(lines)), covered, failed), name, p, q])
    mean = lambda vs: [sum(x) / len(vs) for x in zip(*vs, strict=True)] if vs else None
    ref = {name: [mean([o[k] for o in out if o[1] == name and not o[0][5] and o[k]]) for k in (2, 3)] for name in {o[1] for o in out}}
    limit = {}
    for name in ref:
        bins = [math.floor(jensen_shannon(o[3], ref[name][1]) * 1000) + 1 for o in out if o[1] == name and not o[0][5] and o[3]]
        if bins:
            a, b = np.percentile(bins, [25, 75])
            limit[name] = max(quality_rules.LEAST_WORD_LIMIT, (b + 3 * (b - a)) / 1000)
    verdicts = []
    for base, name, p, q in out:
        far = p and ref[name][0] and jensen_shannon(p, ref[name][0]) > quality_rules.MAX_CHAR_DISTANCE
        far = far or (q and ref[name][1] and jensen_shannon(q, ref[name][1]) > limit.get(name, 9))
        verdicts.append((*base, not base[5] and not far))
    return verdicts


def test_quality_rules_brute_force(spark):
    r = random.Random(4)
    own = {"en": ["the", "of", "and", "to", "in"], "de": ["der", "die", "und", "zu", "in"]}
    sample = lambda lang, n: " ".join(r.choice(own[lang]) if r.random() < 0.4 else f"w{r.randint(0, 10**6)}" for _ in range(n))
    texts = [(sample(x, r.choice([30, 120, 300, 500])), x) for x in ["en"] * 50 + ["de"] * 40] + [(sample("en", 300), "xx"), (None, "en"), ("", None)]
    texts += [(" ".join(f"w{i}" for i in range(500)), "en"), (sample("de", 400), "en"), ("a b c " * 80, "en"), ("###$ ab " * 150 + sample("en", 300), "de"), ("line\nline\n" + sample("de", 90), "de")]
    texts += [texts[0], texts[0]]
    docs = spark.createDataFrame([(i % 90 or None, t, x, "z") for i, (t, x) in enumerate(texts)], "doc_id long, text string, lang string, row string")
    got = quality_rules.judge(docs, with_row=True).collect()
    expected = collections.Counter((t, x, v) for (t, x), v in zip(texts, judged_by_definition(texts), strict=True))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert collections.Counter((g.row.text, g.row.lang, tuple(g[f] for f in fields)) for g in got) == expected
    rejected = {g.row.text for g in got if not g.kept and not g.base_failed}
    assert {texts[93][0], texts[94][0]} <= rejected


def test_window_positions_have_room():
    """The mask leaves as many bits for positions as a text of any length needs."""
    for n in (1, 2, 3, 255, 256, 1 << 24, (1 << 31) - 1):
        free = ~(-1 << len(f"{n:b}"))
        assert free >= n


# mixing


def best_sum(lengths, counts, budget):
    reach = {0}
    for n, c in zip(lengths, counts, strict=True):
        reach = {s + k * n for s in reach for k in range(c + 1) if s + k * n <= budget}
    return max(reach)


@pytest.mark.parametrize("words", [8, 64, 1 << 16])
def test_fit_budget_is_optimal(monkeypatch, words):
    monkeypatch.setattr(mixing, "FIRST_WORDS", words)
    monkeypatch.setattr(mixing, "FIRST_COPIES", 1 if words < 100 else 8)
    r = np.random.RandomState(3)
    for i in range(150):
        lengths = np.unique(r.randint(1, [12, 400][i % 2], r.randint(1, 9))) * (1 + 4 * (i % 3 == 0))
        counts = r.randint(1, 9, len(lengths))
        budget = int(r.randint(-2, (lengths * counts).sum() + 3))
        take = mixing.fit_budget(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert (lengths * take).sum() == best_sum(lengths.tolist(), counts.tolist(), max(0, budget))


def test_fit_budget_of_many_documents():
    lengths, counts = np.array([1000, 1001, 70_000]), np.array([900, 800, 1000])
    for budget in (12_345_678, 1_500_000, 1001 * 700):
        assert (lengths * mixing.fit_budget(lengths, counts, budget)).sum() == budget


def targets_by_definition(sizes, weights=(5, 2, 1), most=3):
    total, target, open_ = sum(sizes), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    left = total
    while open_:
        share = left / sum(weights[i % 3] for i in open_)
        above = [i for i in open_ if share * weights[i % 3] > most * sizes[i]]
        for i in above or open_:
            target[i] = most * sizes[i] if above else share * weights[i % 3]
        left -= sum(target[i] for i in above)
        open_ = [i for i in open_ if i not in above] if above else []
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 100], [5], [1, 1, 1, 1000, 1, 0, 7], [0, 0]])
def test_source_targets(spark, sizes):
    names = ["Ａ", "a", "Z", "é", "", "𝄞", "b"]
    own = sorted(names[: len(sizes) - 1]) + [None]
    table = spark.createDataFrame(list(zip(own, sizes, strict=True)), "source string, source_size long")
    got = {g.source: g.target for g in mixing.source_targets(table).collect()}
    assert [got[s] for s in own] == pytest.approx(targets_by_definition(sizes))


def test_mix_brute_force(docs, rows):
    got = mixing.mix(docs, with_row=True).collect()
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({x[3] for x in rows if x[3] is not None}) + [None]
    total = {s: sum(size(x[1]) for x in rows if x[3] == s) for s in sources}
    target = dict(zip(sources, targets_by_definition([total[s] for s in sources]), strict=True))
    assert collections.Counter((g.doc_id, g.source, g["size"]) for g in got) == collections.Counter((x[0], x[3], size(x[1])) for x in rows)
    assert all(g.row.text is None or size(g.row.text) == g["size"] for g in got)
    for s in sources:
        own = [g for g in got if g.source == s]
        assert all(g.source_size == total[s] and g.target == pytest.approx(target[s]) and g.taken == g["size"] * g.copies and 0 <= g.copies <= 3 for g in own)
        want = round(target[s])
        passes = min(3, want // total[s])
        rest = want - passes * total[s]
        by = collections.Counter(g["size"] for g in own if g["size"])
        assert sum(g.taken for g in own) == passes * total[s] + (0 if passes == 3 else best_sum(list(by), list(by.values()), rest))
    key = lambda gs: sorted((g.doc_id, g["size"], g.taken, g.source or "") for g in gs if g.doc_id is not None)
    assert key(got) == key(mixing.mix(docs.repartition(3)).collect())


def test_mix_of_empty_texts(spark):
    none = spark.createDataFrame([(1, None, "a"), (None, "", None), (1, None, "a")], "doc_id long, text string, source string")
    assert sorted((g.target, g.taken, g.source_size) for g in mixing.mix(none).collect()) == [(0.0, 0, 0)] * 3
    assert mixing.mix(none.limit(0)).count() == 0
