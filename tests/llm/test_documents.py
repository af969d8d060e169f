import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import odd
import pytest

from textlode.llm import jaccard_join as jj
from textlode.llm import quality_rules as qr
from textlode.llm import toxicity as tox


# n-gram Jaccard join


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_join(texts):
    """(class, copies) of each row number, by comparing all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    copies = Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if texts[i] is None or texts[j] is None:
                continue
            if a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9:
                copies[i] += a == b
                copies[j] += a == b
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(find(i), copies[i]) for i in range(len(texts))]


def near_texts(seed=1, families=6, size=12):
    rng, out = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 60, 300]))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
    out += [" ".join([rng.choice(vocabulary) for _ in range(100)] + passage) for _ in range(30)]
    rng.shuffle(out)
    return out


def joined(spark, texts, **kw):
    rows = spark.createDataFrame([(i, t, 1, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, row long, key string, number long")
    found = {r.row: (r.class_row, r.n_copies) for r in jj.near_duplicates(rows, row="number", **kw).collect()}
    return [found[i] for i in range(len(texts))]


def test_join_is_brute_force(spark):
    texts = near_texts() + odd.TEXTS + [odd.TEXTS[4]] * 3 + ["", None]
    assert joined(spark, texts) == brute_join(texts)


def test_join_of_large_nodes(spark, monkeypatch):
    """Families larger than a node go down all levels and are split around pivots."""
    monkeypatch.setattr(jj, "LEAF", 8)
    monkeypatch.setattr(jj, "LAST_LEAF", 8)
    texts = near_texts(2, families=2, size=60)
    assert joined(spark, texts) == brute_join(texts)


def wide_family(seed, size, edits):
    """Copies of one text with up to `edits` words replaced: many are linked to each other, others to few or none."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    chain, out = list(base), []
    for i in range(size):
        words = list(chain if i % 10 == 0 else base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        chain = words if i % 10 == 0 and rng.random() < 0.7 else list(base)  # edits of edited copies drift away from the base
        out.append(" ".join(words))
    return out


def test_wide_families_in_proportion(spark, monkeypatch):
    """Twice the family makes about twice the rows, not four times; nearly all that belongs together is found, and nothing else."""
    made, sums, park = [], [], jj.park
    monkeypatch.setattr(jj, "LAST_LEAF", 100)
    monkeypatch.setattr(jj, "park", lambda df, tag: (lambda t: made.append(t.count()) or t)(park(df, tag)))
    for size in (250, 500):
        made.clear()
        texts = wide_family(5, size, 12)
        expected, got = brute_join(texts), joined(spark, texts)
        sums.append(sum(made))
        linked = Counter(c for c, _ in expected)
        assert max(linked.values()) > size / 5 and sum(n == 1 for n in linked.values()) > size / 10
        together = [(i, c) for i, (c, _) in enumerate(expected) if linked[c] > 1]
        assert sum(got[i][0] == c for i, c in together) >= 0.95 * len(together)
        assert all(got[i][0] == i for i, (c, _) in enumerate(expected) if linked[c] == 1)
    assert sums[1] <= 2.8 * sums[0]


def brute_reps(texts, keys):
    """(key of the representative, similarity) of each text, by taking sets in the order of their smallest keys."""
    sets = [shingles(t) for t in texts]
    name, of = {}, []
    for i, t in enumerate(texts):
        of.append(sets[i] if t is not None else (None, i))  # a null text is alone
        name[of[i]] = min(name.get(of[i], keys[i]), keys[i])
    heads, found = [], {}
    for one in sorted(name, key=name.get):
        share = lambda h: len(one & h) / len(one | h) if one and h else 0.0
        linked = [h for h in heads if share(h) >= 0.8 - 1e-9] if isinstance(one, frozenset) else []
        if linked:
            found[one] = name[linked[0]], share(linked[0])
        else:
            found[one] = name[one], 1.0
            if isinstance(one, frozenset):
                heads.append(one)
    return [found[x] for x in of]


@pytest.mark.parametrize("texts", [near_texts(4, families=3) + odd.TEXTS + ["", None], wide_family(5, 120, 12)])
def test_representatives(spark, monkeypatch, texts):
    """Each document of a class has a representative that it is linked to, by the order of the keys; in blocks of a few, too."""
    monkeypatch.setattr(jj, "HEADS", 4)
    keys = [(i * 37) % 1009 for i in range(len(texts))]
    rows = spark.createDataFrame(list(zip(keys, texts, range(len(texts)))), "doc_id long, text string, number long")
    got = {r.doc: (r.rep_doc, r.similarity) for r in jj.near_duplicates(rows, row="number", pairs=True).collect()}
    assert [got[k] for k in keys] == brute_reps(texts, keys)
    assert len({r for r, _ in got.values()}) < len(texts)


@pytest.mark.parametrize("block", [7, 1024])
def test_every_link_is_counted(spark, monkeypatch, block):
    """Links between members that are not representatives too, in classes of several blocks; each of a set's copies counts."""
    monkeypatch.setattr(jj, "LINK_BLOCK", block)
    texts = wide_family(5, 90, 12)
    texts += [*texts[:5], texts[7], *near_texts(8, families=2), *odd.TEXTS, "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc: r.n_links for r in jj.near_duplicates(rows, pairs=True).collect()}
    sets = [shingles(t) if t is not None else frozenset() for t in texts]
    for i, a in enumerate(sets):
        assert got[i] == sum(bool(a and b) and a != b and len(a & b) >= 0.8 * len(a | b) - 1e-9 for b in sets)
    assert max(got.values()) > 10


def test_leaves_by_shingles(spark, monkeypatch):
    """Few members with much text are split around pivots as many members are."""
    monkeypatch.setattr(jj, "LEAF_TOKENS", 500)
    texts = near_texts(6, families=3, size=20)
    assert joined(spark, texts) == brute_join(texts)


def test_largest_leaf_in_memory():
    """What a leaf of 2,048 members may hold at most is compared in some hundred MB."""
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 62, 6000)
    sets = [np.sort(rng.choice(pool, jj.LEAF_TOKENS // jj.LAST_LEAF, replace=False)) for _ in range(jj.LAST_LEAF)]
    tracemalloc.start()
    counts = jj.common_counts(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6 and counts[0, 1] == len(np.intersect1d(sets[0], sets[1]))


def test_common_counts():
    rng = random.Random(3)
    sets = [np.array(sorted(rng.sample(range(60), rng.randrange(1, 40)))) for _ in range(30)]
    for cells in (1, 300, 10**6):
        got = jj.common_counts(sets, cells)
        assert all(got[i, j] == len(set(a.tolist()) & set(b.tolist())) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_join_by_exchange(spark, monkeypatch):
    monkeypatch.setattr(jj, "BROADCAST_BYTES", -1)
    texts = near_texts(3, families=4)
    assert joined(spark, texts) == brute_join(texts)


def test_join_of_tables(spark, sf_dir):
    assert jj.near_duplicates(odd.empty(spark)).count() == 0
    assert jj.near_duplicates(odd.table(spark)).count() == odd.table(spark).count()
    got = jj.op2_ngram_jaccard(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    expected = brute_join([d.text for d in docs])
    classes = defaultdict(set)
    for d, (c, _) in zip(docs, expected):
        classes[c].add(d.doc_id)
    assert {r.doc_id: (r.class_id, r.class_size, r.n_copies) for r in got} == {d.doc_id: (min(classes[c]), len(classes[c]), n) for d, (c, n) in zip(docs, expected)}
    reps = brute_reps([d.text for d in docs], [d.doc_id for d in docs])
    assert {r.doc_id: (r.rep_doc_id, r.similarity) for r in got} == {d.doc_id: r for d, r in zip(docs, reps)}


def test_runs_reach_the_recall():
    assert jj.runs_for(0.9) < jj.runs_for(0.99) < jj.runs_for(0.999)
    rng = np.random.default_rng(4)
    with np.errstate(over="ignore"):
        met, runs = 0, jj.runs_for(0.99)
        for _ in range(300):
            tokens = rng.integers(0, 2**63, 100).astype(np.uint64)
            a, b = np.sort(tokens[:90]), np.sort(np.r_[tokens[:80], tokens[90:]])  # Jaccard 0.8
            met += bool(np.intersect1d(jj.paths(a, runs)[-1][1], jj.paths(b, runs)[-1][1]).size)
    assert met >= 285


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 10), (20, 11), (20, 12), (30, 30)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.id: r.root for r in jj.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 6)} == {1} and {got[i] for i in (7, 8, 9)} == {7} and {got[i] for i in (10, 11, 12, 20)} == {10}
    assert {got[100 + i] for i in range(41)} == {100} and 30 not in got


# quality rules


def brute_measures(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@pytest.mark.parametrize("text", [*odd.TEXTS, "a b c d e a b c d e f", "x x x x x x", "x x x x x", "l\nl\n l\nl \nl", "#*$%&|<> a", "a\x0bb\x0cc\x1cd\x85e f", "a b c d e " * 2000])
def test_measures(text):
    assert qr.measure(text)[:5] == brute_measures(text)


def test_long_lines_in_parts(monkeypatch):
    texts = ["\n".join(" ".join(f"W{i * k % 97}" for i in range(500)) + " " * k for k in range(5)), "x" * 3000, "  a b " * 400]
    whole = [qr.measure(x) for x in texts]
    monkeypatch.setattr(qr, "PART", 50)
    for a, b in zip(whole, map(qr.measure, texts)):
        assert a[:6] == b[:6] and a[6].tolist() == b[6].tolist() and a[7].tolist() == b[7].tolist()


def test_a_long_text_takes_a_few_times_its_size():
    import tracemalloc

    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(200_000)]
    for sign in (" ", "\n"):
        text = sign.join(rng.choice(vocabulary) for _ in range(1_000_000))  # about 10 MB
        tracemalloc.start()
        assert qr.measure(text)[0] == 1_000_000
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8 * len(text)


def brute_verdicts(rows, rules):
    """(base_failed, words_left, kept) of (text, host) rows, from strings."""
    normal = lambda x: " ".join(w.decode() for w in x.lower().encode().split())
    hosts, lines, of = defaultdict(set), defaultdict(set), []
    for text, host in rows:
        found = [x for x in map(normal, (text or "").split("\n")) if x]
        of.append(found)
        if found:
            hosts[host].add(" ".join(found))
            for x in found:
                lines[host, x].add(" ".join(found))
    out = []
    for (text, host), found in zip(rows, of):
        frequent = lambda x: (n := len(lines[host, x])) > rules.min_docs and (n > rules.max_share * len(hosts[host]) or n > rules.max_docs)  # noqa: E731, B023
        n_words, _, _, _, n_repeat = brute_measures(text)
        left = n_words - sum(len(x.split(" ")) for x in found if frequent(x))
        failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat * n_words
        out.append((failed, left, not failed and left >= rules.min_words))
    return out


def test_verdicts(spark, monkeypatch):
    rng, rows = random.Random(6), []
    shared = ["this line is on very many pages of one and the same host", "so is this other one here"]
    for i in range(80):
        own = [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([4, 12, 30]))]
        rows.append(("\n".join([shared[0], " ".join(own), shared[i % 2]]), "h0" if i % 3 else "h1"))
    rows += [(t, None) for t in odd.TEXTS] + [("one family of copies has the same lines\nin each and every one of its documents here", "h0")] * 60
    df = spark.createDataFrame([(i, t, h, 1, "x") for i, (t, h) in enumerate(rows)], "doc_id long, text string, source string, line long, words string")
    for limit, rules in ((qr.BROADCAST_LINES, qr.Rules(min_docs=10, max_share=2.0, max_docs=30)), (-1, qr.Rules(min_docs=10))):
        monkeypatch.setattr(qr, "BROADCAST_LINES", limit)
        got = {r.doc_id: (r.base_failed, r.words_left, r.kept) for r in qr.judge(df, ["doc_id"], rules=rules).collect()}
        assert [got[i] for i in range(len(rows))] == brute_verdicts(rows, rules)
    assert sum(not f and not k for f, _, k in got.values()) > 5 and got[len(rows) - 1][2]
    assert qr.judge(odd.empty(spark), ["doc_id"]).count() == 0
    assert qr.judge(odd.table(spark), ["doc_id"]).count() == odd.table(spark).count()


def test_a_footer_with_a_long_word_on_500_documents(spark):
    footer = "read https://example.org/a-very-long-address/of-a-page-of-licences/by-nobody-in-particular.html first"
    rows = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i}\n{footer}", "h") for i in range(500)]
    got = qr.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).collect()
    assert {(r.n_words, r.words_left, r.kept) for r in got} == {(11, 8, False)}


def test_line_with_the_longest_word_of_all(spark):
    """Documents are distinct by their whole text, whatever their longest word; copies count once."""
    line = "see https://example.org/licences/of-this-and-that/by-nobody-in-particular.html for these"
    rows = [(i, f"{line}\nu{i} v{i} w{i} x{i} y{i} z{i}", "h") for i in range(30)]
    rows += [(100 + i, f"  One COPY\n\nof copies{' ' * i} with a line of ten words and more than that", "h") for i in range(30)]
    rows += [(200, f"{line}\n" + " ".join(f"k{k}" for k in range(12)), "h")]
    got = {r.doc_id: (r.words_left, r.kept) for r in qr.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).collect()}
    assert got == {**{i: (6, False) for i in range(30)}, **{100 + i: (14, True) for i in range(30)}, 200: (12, True)}


def test_quality_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    expected = brute_verdicts([(d.text, d.source) for d in docs], qr.Rules())
    got = {r.doc_id: r for r in qr.op10_quality_rules(spark, sf_dir).collect()}
    for d, (failed, left, kept) in zip(docs, expected):
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(d.text)
        assert (r.base_failed, r.words_left, r.kept) == (failed, left, kept)


# toxicity


def brute_kernel(a, b):
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(a)), tox.ORDER):
        for j in combinations(range(len(b)), tox.ORDER):
            if all(a[x] == b[y] for x, y in zip(i, j)):
                total += tox.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_is_its_definition():
    rng = random.Random(8)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))), "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))) for _ in range(60)]
    got = tox.subsequence_kernel(tox.codes([a for a, _ in pairs], 8), tox.codes([b for _, b in pairs], 6))
    assert got == pytest.approx([brute_kernel(a, b) for a, b in pairs], rel=1e-5, abs=1e-9)


def brute_k(a, b):
    own = brute_kernel(a, a) * brute_kernel(b, b)
    return (brute_kernel(a, b) / own**0.5) ** tox.POWER if own else 0.0


def test_kernel_of_strings_with_landmarks():
    rng = random.Random(10)
    marks = ["<idiot>", "trash", "aaaa", "<añb>"]
    words = ["".join(rng.choice("<>abidiotrsñ漢") for _ in range(rng.randrange(1, 8))) for _ in range(60)] + marks + ["", "ab", "zzzz"]
    got = tox.Strings(marks).kernel(words)
    assert got == pytest.approx(np.array([[brute_k(w, m) for m in marks] for w in words]), rel=1e-4, abs=1e-7)


def test_margins_are_sums_over_windows():
    marks = ["<idiot>", "trash>", "<ther>"]
    model = tox.Model(marks, np.array([1.0, 2.0, -0.5]), -0.7, 1.0, 0.0)
    matcher = tox.Matcher(model, memo=10)

    def brute(text):
        words = {tox.NO_LETTERS.sub("", w) for w in text.lower().split()} - {""}  # none here differ in signs only
        parts = [p for w in words for p in {f"<{w}>"[i : i + tox.WINDOW] for i in range(max(1, len(w) + 3 - tox.WINDOW))}]
        return sum(brute_k(p, m) * x for p in parts for m, x in zip(marks, model.weights)) + model.bias

    for text in ("some id-iot here", "TRASH there", "", "12 34", "the traxsh of idxiots " + "x" * 300):
        assert matcher.margins([text])[0] == pytest.approx(brute(text), rel=1e-4, abs=1e-5)
    worth = lambda w: matcher.margins([f"some {w} here"])[0] + 0.7
    assert worth("idiot") == worth("i.d-i*o.t") == worth("IDIOT!!") and worth("idiot") > 0.99 and worth("i d i o t") > 0.99
    assert worth("idxiot") > 5 * max(worth("island"), worth("bread"), 0.001)


def labelled(n=400, seed=9):
    rng = random.Random(seed)
    syllables = ["an", "er", "th", "on", "re", "ti", "st", "en", "ha", "ou"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "loser", "moron"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = labelled()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = tox.train_on(docs, labels)
    got = {r.doc_id: r.score for r in tox.score_table(docs.where(tox.held_out("doc_id")), model).collect()}
    truth = {r[0]: r[2] for r in rows}
    assert len(got) > 40 and sum((s >= 0.5) == truth[d] for d, s in got.items()) >= 0.97 * len(got)


def test_query_on_held_out_rows(spark):
    """Of 97 toxic held-out documents six hold no insult at all; few others are missed, and hardly a clean one is rejected."""
    sf_dir = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = [(truth[r.doc_id], r.predicted) for r in tox.op5_toxicity(spark, sf_dir).where("held_out").collect() if r.doc_id in truth]
    assert sum(t for t, _ in got) == 97 and sum(t and not p for t, p in got) <= 12 and sum(p and not t for t, p in got) <= 2


def test_scores_of_odd_tables(spark):
    docs, empty = odd.table(spark), odd.empty(spark)
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None), (4, 0), (99, 1), (9, 0)], "doc_id long, toxic int")
    model = tox.train_on(docs, labels)
    got = tox.score_table(docs, model, score="score").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert tox.train_on(docs, labels.limit(0)) is None and tox.train_on(empty, labels) is None
    assert {r.score for r in tox.score_table(docs, None).collect()} == {0.0}
    assert tox.score_table(empty, model).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark, sf_dir):
    got = {r.doc_id: r for r in tox.op5_toxicity(spark, sf_dir).collect()}
    import zlib

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    again = {r.doc_id: r.score for r in tox.score_table(docs, tox.train_on(docs, flipped)).collect()}
    for doc, r in got.items():
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and again[doc] == pytest.approx(r.score, abs=1e-9)
