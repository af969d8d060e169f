import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import odd
import pyarrow as pa
import pytest

from textlode.llm import collocations as co
from textlode.llm import line_runs as lr
from textlode.llm import spelling as sp

LOWER = str.maketrans(sp.UPPER, sp.LOWER)


def docs(spark, texts, langs=("en",)):
    return spark.createDataFrame([(i, t, langs[i % len(langs)]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")


# phrases


def brute_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        swallowed = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= counts[p[i:j]]}
        scores = []
        for p, a in found.items():
            if p not in swallowed:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scores.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def phrases_of(table, **kw):
    rules = co.Rules(kw.pop("least", 3), kw.pop("top", 2000))
    return sorted(map(tuple, co.collocations(table, rules, **kw).collect()))


def wordy(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Ünder", "É", "don't", "x"]
    return [" ".join(rng.choice(words) + rng.choice(["", "", "", "", ",", ".\n", "\t"]) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("shard", [40, 3_000_000])
def test_phrases_are_brute_force(spark, monkeypatch, shard):
    """Cut into many shards or one; ties, several languages, a null language, overlapping repeats."""
    monkeypatch.setattr(co, "SHARD", shard)
    monkeypatch.setattr(co, "SLICE", 200)
    texts, langs = wordy(1) + ["aa aa aa aa aa aa aa", "the end. The end", None, ""], ("en", "de", None)
    table = docs(spark, texts, langs).repartition(3)
    expected = brute_phrases([(t, langs[i % 3]) for i, t in enumerate(texts)], 3, 2000)
    assert len(expected) > 300 and phrases_of(table) == expected


def test_a_small_filter_changes_nothing(spark):
    texts = wordy(2)
    assert phrases_of(docs(spark, texts), bits=64) == brute_phrases([(t, "en") for t in texts], 3, 2000)


def test_first_phrases_and_ties(spark):
    texts = [f"a{i} b{i} a{i} b{i} a{i} b{i}" for i in range(30)]
    got = phrases_of(docs(spark, texts), top=7)
    assert len(got) == 7 and got == brute_phrases([(t, "en") for t in texts], 3, 7)


def test_phrases_of_odd_tables(spark):
    rows = odd.rows()
    got = phrases_of(odd.table(spark), least=2)
    assert got == brute_phrases([(r[1], r[2]) for r in rows], 2, 2000)
    assert phrases_of(odd.empty(spark)) == []
    assert phrases_of(docs(spark, [None, "", " . "])) == []


def test_scores_beyond_64_bits(spark):
    big = 10**13
    words = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 2, big - 1)], "lang string, word string, w1 long, f long")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    phrases = spark.createDataFrame([("en", [1, 2], 10**12)], "lang string, ws array<long>, f long")
    assert co.scored(words, totals, phrases).first().score == 1000 * 10**12 * 10**15 // (big * (big - 1))


def test_suffix_array_and_intervals():
    rng = np.random.default_rng(5)
    stream = np.concatenate([[0], rng.integers(0, 4, 400), [0]]).astype(np.int32)
    order = co.suffix_array(stream, 5)
    ends = [tuple(stream[i : i + 5]) for i in order]
    assert sorted(order) == list(range(len(stream))) and ends == sorted(ends)
    for size, phrases, times in co.intervals(stream, range(1, 6)):
        brute = Counter(tuple(map(int, stream[i : i + size])) for i in range(len(stream) - size + 1) if 0 not in stream[i : i + size])
        assert {tuple(map(int, p)): int(t) for p, t in zip(phrases, times, strict=True)} == brute


@pytest.mark.parametrize("sizes", [range(2, 4), range(4, 6)])
def test_windows_hold_every_phrase(sizes):
    """The first words of windows, summed over batches of any length, are the phrases of each size."""
    rng = np.random.default_rng(6)
    for stream in ([], [0], [0, 1, 0], [0, 1, 2, 3, 4, 5], [0, *rng.integers(0, 4, 500), 0]):
        stream, depth = np.array(stream, np.int32), sizes[-1]
        found, times = co.windows(stream, sizes)
        assert len({*map(tuple, found.tolist())}) == len(found) <= len(stream) and (found[:, : sizes[0]] != 0).all()
        places = np.lexsort(found.T[::-1])
        rows = pa.RecordBatch.from_arrays([*(pa.array(found[places, j].astype(np.int64)) for j in range(depth)), pa.array(times[places].astype(np.int64))], [*co.WORDS[:depth], "n"])
        brute = {tuple(map(int, p)): int(t) for _, phrases, n in co.intervals(stream, sizes) for p, t in zip(phrases, n, strict=True) if t >= 3}
        for step in (1, 7, 1000):
            parts = (rows.slice(i, step) for i in range(0, len(found) + 1, step))
            got = [tuple(row.values()) for b in co.first_words(parts, sizes, 3) for row in b.to_pylist()]
            assert len(got) == len(brute) and {tuple(w for w in words if w): f for *words, f in got} == brute


def rows_made(spark, table, least):
    """The most rows that one MapInArrow makes while the phrases of a table are counted."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    phrases_of(table, least=least)
    most = 0
    for i in range(before, store.executionsCount()):
        run = store.executionsList().apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if node.name() == "MapInArrow":
                ids = [m.accumulatorId() for m in (node.metrics().apply(j) for j in range(node.metrics().size())) if m.name() == "number of output rows"]
                most = max([most, *(int(values.apply(x).replace(",", "")) for x in ids if values.contains(x))])
    return most


def test_rows_grow_with_the_text_alone(spark):
    """Five times the text, where most pairs become frequent: each step makes about five times the rows."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(30)) for _ in range(600)]
    small, large = (rows_made(spark, docs(spark, texts[:n]).repartition(n // 60), 5) for n in (120, 600))
    assert 0 < large <= 6 * small


# spelling


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    forms, out = {}, []
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n[w], len(near[w]), forms[w] and n[forms[w]]))
    return sorted(out)


def spelt(seed):
    """Words of few letters, so that many are one edit apart, with counts of all sizes."""
    rng = random.Random(seed)
    letters = "abcÀé÷"
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([4, 5, 6, 7]))) for _ in range(250)]
    words += ["color", "colour", "colours", "colr", "Color", "aaaaa", "aaaaaa", "aaaaaaa"]
    return [" ".join(rng.choices(words, [1 / (1 + i % 40) for i in range(len(words))], k=300)) + rng.choice([".", " 7x", "\n"]) for _ in range(40)]


def test_variants_are_brute_force(spark):
    texts = [*spelt(3), "hello " * 4 + "hallo " * 10 + "halla " * 25]
    got = sorted(map(tuple, sp.variants(docs(spark, texts)).collect()))
    n = brute_words(enumerate(texts))
    assert len(n) > 150 and got == brute_variants(n)
    assert any(r[1] and r[1] != r[2] for r in got)


def test_pairs_meet_once(spark):
    n = brute_words(enumerate(spelt(4)))
    pairs = [(r.a, r.b) for r in sp.near_pairs(spark.createDataFrame(list(n.items()), "word string, n long")).collect()]
    brute = {frozenset((a, b)) for a in n for b in n if one_apart(a, b)}
    assert len(pairs) == len(brute) and set(map(frozenset, pairs)) == brute


def test_an_edit_flips_two_bits_at_most(spark):
    words = ["color", "colour", "cilor", "çolor", "Éclair", "éclair", "naïve÷"]
    masks = {r.w: r.m for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", sp.parity_mask(sp.F.col("w")).alias("m")).collect()}
    assert [(masks["color"] ^ masks[w]).bit_count() for w in ("color", "colour", "cilor", "çolor")] == [0, 1, 2, 2]


def test_long_chains_of_forms(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(40)]
    assert dict(map(tuple, sp.roots(spark.createDataFrame(chain, "word string, form string")).collect())) == {a: "w40" for a, _ in chain}


def test_variants_of_odd_tables(spark):
    rows = odd.rows()
    assert sorted(map(tuple, sp.variants(odd.table(spark)).collect())) == brute_variants(brute_words((r[0], r[1]) for r in rows))
    assert sp.variants(odd.empty(spark)).collect() == []


# lines


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute_lines(rows, least=10, chars=1):
    n = Counter(k for _, t in rows for k in {line_key(x) for x in (t or "").split("\n")})
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(line_key(x)) < chars or n[line_key(x)] < least]
        out.append((doc_id, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def lined(seed, n=120):
    rng = random.Random(seed)
    lines = ["", "  ", "Menu", " menu\t", "FOOTER é", "FOOTER É", " menu", "a\r"] + [f"line {i}" for i in range(60)]
    return [(i, "\n".join(rng.choices(lines, k=rng.randrange(8)))) for i in range(n)] + [(None, "menu\nkept of none"), (None, None), (7, "menu"), (7, "menu")]


def test_lines_are_brute_force(spark):
    rows = lined(1)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = lr.dedup(table).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in found), key=repr) == brute_lines(rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in found)
    found = lr.dedup(table, lr.Rules(5, 6), texts=False).collect()
    assert sorted(map(tuple, found), key=repr) == brute_lines(rows, 5, 6)


def test_lines_of_odd_tables(spark):
    rows = [(r[0], r[1]) for r in odd.rows()] * 10
    table = spark.createDataFrame([r for r in odd.rows() for _ in range(10)], odd.SCHEMA)
    assert sorted(map(tuple, lr.dedup(table, texts=False).collect()), key=repr) == brute_lines(rows)
    assert lr.dedup(odd.empty(spark)).collect() == []


def test_runs_are_levelled_and_survive(spark, tmp_path):
    """Batches of a growing corpus: levels stay few, counts exact, a new session goes on, an uncommitted run counts for nothing."""
    total, path = Counter(), f"file://{tmp_path}/runs"
    runs = lr.LineRuns(spark, path, 4)
    for i in range(10):
        if i == 5:
            runs.write(spark.createDataFrame([(b"never committed", 9)], "line binary, n long"))
            runs = lr.LineRuns(spark, path)
            assert runs.buckets == 4
        rows = lined(i, 20)
        total.update(k for _, t in rows for k in {line_key(x) for x in (t or "").split("\n")} if k)
        out = lr.add_batch(runs, spark.createDataFrame(rows, "doc_id long, text string"))
        often = {k for k, c in total.items() if c >= 10}
        assert sorted((r.doc_id or -1, r.kept) for r in out.collect()) == sorted((d or -1, "\n".join(x for x in (t or "").split("\n") if line_key(x) not in often)) for d, t in rows)
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {r.line: r.n for r in runs.merged(runs.runs).collect()} == {lr.digest(k.encode()): n for k, n in total.items()}
    runs.store.expire()
    assert sorted(runs.store.names("data")) == sorted(f"run={r}" for r in runs.runs)


def test_runs_are_merged_without_an_exchange(spark, tmp_path):
    runs = lr.LineRuns(spark, f"file://{tmp_path}/runs", 4)
    for i in range(2):
        runs.add(spark.createDataFrame([(bytes([i]),)], "line binary"))
    plan = runs.merged(runs.runs)._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan.split("== Physical Plan ==")[1]


def test_a_hot_key_is_met_where_its_lines_lie(spark, monkeypatch):
    monkeypatch.setattr(lr, "HOT", 3)
    rows = [(i, f"hot\nwarm {i % 8}\nown {i}") for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, lr.dedup(table, texts=False).collect()), key=repr) == brute_lines(rows)


def test_no_table_of_words_is_broadcast(spark):
    """The rows that words meet by are twelve to a word, and Spark took their size for the words' file's: 10 MB of it were hundreds on the driver."""
    words = spark.createDataFrame([("letter", 9), ("lettre", 4), ("leter", 3), ("better", 5)], "word string, n long")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    pairs = sp.near_pairs(words)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.a, r.b) for r in pairs.collect()) == [("better", "letter"), ("leter", "letter")]
    found = sp.variants(spark.createDataFrame([(1, "letter " * 6 + "leter " * 3)], "doc_id long, text string"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() >= 1
