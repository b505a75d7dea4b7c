"""The corpus pipeline, stage by stage against brute-force versions, with null and repeated doc_ids, repeated rows and empty tables."""

import collections
import random
import re

import pytest
from test_contracts import WORD, best_sum, groups_of, judged_by_definition, simhash_of, targets_by_definition

import corpus_pipeline as p

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(21)
    prose = lambda n: " ".join(r.choice(["the", "of", "and", "to"]) if r.random() < 0.4 else f"w{r.randint(0, 10**5)}" for _ in range(n))
    texts = [prose(r.randint(60, 260)) for _ in range(60)]
    texts += [texts[0]] * 5 + [texts[1] + " tail", "short", None, "", "a b " * 90, prose(100) + " Mr John Smith wrote to j.smith@corp.de", prose(120) + " and Mr Smith called"]
    out = [(i if i % 11 else None, t, ["en", "fr"][i % 2], ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    return out + [out[4], out[4], (4, prose(90), "en", "a", 3), (4, "one", "en", "a", 3)]


def counted(df):
    return collections.Counter(tuple(r[c] for c in p.COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def steps(spark, rows):
    docs = spark.createDataFrame([(*x, 7) for x in rows], f"{SCHEMA}, row int")
    out = [docs]
    for _, stage in p.STAGES:
        out.append(stage(spark, out[-1], "").cache())
    return out


def test_rules(steps, rows):
    kept = [v[-1] for v in judged_by_definition([(x[1], x[2]) for x in rows])]
    assert counted(steps[1]) == collections.Counter(x for x, k in zip(rows, kept, strict=True) if k) and 50 < sum(kept) < len(rows)


def test_near_duplicates(steps):
    own = list(counted(steps[1]).elements())
    groups = collections.defaultdict(list)
    for x, g in zip(own, groups_of([simhash_of(x[1]) for x in own]), strict=True):
        groups[g].append(x)
    least = lambda xs: min((x[0] is None, x[0] or 0) for x in xs)
    got = counted(steps[2])
    assert sum(got.values()) == len(groups) < len(own)
    for xs in groups.values():
        mine = [x for x in got if x in xs]
        assert sum(got[x] for x in mine) == 1 and (mine[0][0] is None, mine[0][0] or 0) == least(xs)
    assert any(x[0] is None for x in got) and sum(got[x] for x in got if x[0] == 4) == 2


def test_private(steps):
    before, after = ({(x[0], x[3], WORD.findall(x[1])[0], len(WORD.findall(x[1]))): x for x in counted(s)} for s in steps[2:4])
    assert before.keys() == after.keys()
    changed = [k for k in before if before[k][1] != after[k][1]]
    assert {k for k in before if re.search("Smith|@", before[k][1])} == set(changed) and len(changed) == 2
    names = [re.search(r"Mr (?:\w+ )?(\w+) (?:wrote|called)", after[k][1])[1] for k in changed]
    assert names[0] == names[1] != "Smith" and not any(re.search("Smith|John|corp", x[1]) for x in after.values())
    assert all(x[4] == len(x[1]) for x in after.values())


def test_mix(steps):
    size = lambda x: len(WORD.findall(x[1]))
    before, after = counted(steps[3]), counted(steps[4])
    assert set(after) <= set(before) and all(after[x] <= 3 * before[x] for x in after)
    sources = sorted({x[3] for x in before if x[3] is not None}) + [None]
    total = {s: sum(size(x) * n for x, n in before.items() if x[3] == s) for s in sources}
    for s, target in zip(sources, targets_by_definition([total[s] for s in sources]), strict=True):
        want = round(target)
        passes = min(3, want // total[s])
        by = collections.Counter(size(x) for x in before.elements() if x[3] == s)
        expected = passes * total[s] + (0 if passes == 3 else best_sum(list(by), list(by.values()), want - passes * total[s]))
        assert sum(size(x) * n for x, n in after.items() if x[3] == s) == expected


def test_tokens(steps):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(p.tokenizer_path())
    expected = collections.Counter((x[0], tuple(library.encode(x[1], add_special_tokens=False).ids)) for x in counted(steps[4]).elements())
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in steps[5].collect()) == expected


def test_run_and_empty_tables(spark, rows, steps, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = p.run(spark, str(tmp_path))
    key = lambda df: collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in df.collect() if r.doc_id is not None)
    whole = key(got)
    assert whole == key(p.run(spark, str(tmp_path))) and abs(sum(whole.values()) - sum(key(steps[5]).values())) <= 3
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in p.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0 and (name == "tokens" or out.columns == p.COLUMNS)
