"""Toxicity by a subsequence string kernel, Nystrom landmarks and a linear support vector machine.

Strings are compared by the gapped subsequence kernel: all common subsequences of three letters count,
each letter spanned at a discount, so insults with letters or signs put in between still match. The kernel
is normalised, and raised to a power, which is a kernel again and tells whole matches from chance ones:
k(s, t) = (K(s, t) / sqrt(K(s, s) K(t, t))) ** POWER. A document is the set of its words, long ones in
windows, and the kernel of two documents is the sum of k over all pairs of their strings.

Landmarks z are one-string documents. The Nystrom features of a document d, K(z, z) ** -1/2 times the sum of
k(z, s) over its strings s, go into a linear support vector machine trained on labelled documents. The machine
is a sum over strings, so a string's share of the margin is worked out once wherever it stands. The score is
the calibrated margin.

Landmarks are drawn from letter runs that set toxic training documents apart, and from ordinary words.
Training takes a bounded sample of labelled documents, by digest of their ids; scoring takes every
word of every text. Each worker keeps the words it has scored in a bounded memo.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, kept, table

#: Kernel: letters of a subsequence, and the discount of each letter spanned.
ORDER, DECAY = 3, 0.5
#: The power of the normalised kernel.
POWER = 6
#: Landmarks from toxic letter runs (of SHORTEST to LONGEST letters), and from ordinary words.
TOXIC_LANDMARKS, PLAIN_LANDMARKS, SHORTEST, LONGEST = 48, 16, 4, 7
#: Letters of a window of a word, and so of a landmark at most.
WINDOW = 7
#: The bound of the training sample: labelled documents of either class.
SAMPLE = {1: 1000, 0: 2000}
NO_LETTERS = re.compile(r"[\W\d_]+")
#: Marks of a word's start and end, letters like any other.
START, END = "<", ">"
#: A toxic letter run's log-likelihood ratio, and how much commoner it is in toxic documents than in clean ones, at least.
LEAST_WORTH, LEAST_ODDS = 14.0, 4.0
SPELLED = re.compile(r"(?:(?<=\s)|^)(?:[^\W\d_]\s){2,}[^\W\d_](?=\s|$)")


def bare(word: str) -> str:
    """A word's letters between the marks of its ends; empty if it has none."""
    letters = NO_LETTERS.sub("", word)
    return f"{START}{letters}{END}" if letters else ""


def windows(letters: str) -> list[str]:
    """The distinct runs of WINDOW letters, or the whole of a shorter word."""
    if len(letters) <= WINDOW:
        return [letters] if letters else []
    return list(dict.fromkeys([letters[at : at + WINDOW] for at in range(len(letters) - WINDOW + 1)]))


def bag_of(text: str) -> set[str]:
    """The distinct words of a text as they come, and words spelled in single letters put together."""
    low = text.lower()
    bag = set(low.split())
    bag.update("".join(x.split()) for x in SPELLED.findall(low))
    return bag


def codes(words: list[str], width: int) -> np.ndarray:
    """Letters as numbers, 0 after a word's end."""
    return np.array(words, f"<U{max(1, width)}").view(np.uint32).reshape(len(words), -1).astype(np.int32)


def subsequence_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """K(a[i], b[i]) for rows of letter codes: sum over common subsequences of ORDER letters of DECAY ** (letters spanned in both)."""
    n, short = len(a), b.shape[1]
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(np.where(b == 0, -1, b).T)  # the padding of one side matches nothing
    # partial[i][j]: subsequences of i letters in what is read of a and in b[:j], discounted to their ends
    one, decay = np.ones((short, n), np.float32), np.float32(DECAY)
    partial = [one] + [np.zeros((short + 1, n), np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(n, np.float32)
    for letter in a:
        same = (b == letter) * np.float32(DECAY**2)
        total += (same * partial[ORDER - 1][:short]).sum(0)
        for i in range(ORDER - 1, 0, -1):
            add = same * partial[i - 1][:short]
            for j in range(1, short):
                add[j] += decay * add[j - 1]
            partial[i] *= decay
            partial[i][1:] += add
    return total.astype(float)


@lru_cache(maxsize=32)
def spots(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of ORDER letters in a string, and their discounts."""
    at = np.array(list(combinations(range(length), ORDER)), np.int64).reshape(-1, ORDER)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)


class Strings:
    """Kernel values of strings with landmarks, by the subsequences that some landmark has."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        self.number = {ord(c): i for i, c in enumerate(sorted(set("".join(landmarks))), 1)}
        self.base = len(self.number) + 1
        found = sorted({tuple(self.number[ord(x[i])] for i in at) for x in landmarks for at in spots(len(x))[0]})
        self.row = np.zeros(self.base**ORDER, np.int32)  # 0: a subsequence that no landmark has
        for i, triple in enumerate(found, 1):
            self.row[self.place(np.array(triple)[None, :])] = i
        self.size = len(found) + 1
        # a column for each landmark: its own subsequences' discounts, over the root of its kernel value
        self.columns = np.zeros((self.size, len(landmarks)), np.float32)
        for j, x in enumerate(landmarks):
            letters = codes([x], len(x))
            np.add.at(self.columns[:, j], self.rows(letters)[0], spots(len(x))[1] / np.sqrt(subsequence_kernel(letters, letters)))
        self.columns[0] = 0

    def place(self, letters: np.ndarray) -> np.ndarray:
        out = letters[:, 0]
        for k in range(1, letters.shape[1]):
            out = out * self.base + letters[:, k]
        return out

    def rows(self, letters: np.ndarray) -> np.ndarray:
        """Numbers of the subsequences of equally long strings, given as code points."""
        known = np.array(sorted(self.number), np.int32)
        if not len(known):
            return np.zeros((len(letters), len(spots(letters.shape[1])[0])), np.int32)
        at = np.minimum(np.searchsorted(known, letters), len(known) - 1)
        own = np.where(known[at] == letters, at + 1, 0)  # letters in the order of their numbers
        places = spots(letters.shape[1])[0]
        out = own[:, places[:, 0]]
        for k in range(1, ORDER):
            out = out * self.base + own[:, places[:, k]]
        return self.row[out]

    def kernel(self, words: list[str]) -> np.ndarray:
        """k of each string with each landmark."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        for n in np.unique(lengths[lengths >= ORDER]).tolist():
            at = np.flatnonzero(lengths == n)
            discount = spots(n)[1].astype(np.float32)
            for start in range(0, len(at), 2000):
                part = at[start : start + 2000]
                letters = codes([words[i] for i in part], n)
                rows = self.rows(letters)
                some = np.flatnonzero(rows.any(1))  # others share no subsequence with any landmark
                if not len(some):
                    continue
                own = np.sqrt(subsequence_kernel(letters[some], letters[some])).astype(np.float32)
                i, j = np.nonzero(rows[some])  # in the order of strings, each of which is there
                found = np.add.reduceat(discount[j, None] * self.columns[rows[some][i, j]], np.r_[0, np.flatnonzero(np.diff(i)) + 1], axis=0)
                out[part[some]] = found / own[:, None]
        return np.minimum(out, 1) ** POWER


@dataclass
class Model:
    """landmarks; what a string's kernel values with them add to the margin, and the bias; the logistic curve from margins to scores."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))


class Matcher:
    """Margins of texts; memo: how many words are kept with theirs."""

    def __init__(self, model: Model, memo: int = 500_000, longest: int = 64) -> None:
        self.model, self.strings = model, Strings(model.landmarks)
        self.memo: dict[str, float] = {}  # of words as they come
        self.known: dict[str, float] = {}  # of bare words
        self.parts: dict[str, float] = {}  # of windows
        self.size, self.longest = memo, longest

    def learn(self, words: list[str]) -> dict[str, float]:
        """What words not met before add to the margin; those with the same letters share it. Words without letters add nothing."""
        letters = [bare(w) for w in words]
        found = {x: windows(x) for x in dict.fromkeys(letters) if x not in self.known}
        if len(self.parts) > self.size:
            self.parts = {}
        new = [x for x in dict.fromkeys(p for x in found.values() for p in x) if x not in self.parts]
        for start in range(0, len(new), 20_000):
            some = new[start : start + 20_000]
            self.parts.update(zip(some, (self.strings.kernel(some) @ self.model.weights).tolist()))
        parts = self.parts
        sums = {x: sum([parts[p] for p in of]) for x, of in found.items()}
        self.known.update((x, value) for x, value in sums.items() if len(x) <= self.longest)
        return {w: sums[x] if x in sums else self.known[x] for w, x in zip(words, letters)}

    def margins(self, texts: list[str]) -> np.ndarray:
        """The margin of each text: the bias, and what each of its distinct words adds."""
        bags = [bag_of(x) for x in texts]
        if len(self.memo) > self.size:
            self.memo, self.known = {}, {}
        memo = self.memo
        found = self.learn([w for w in set().union(*bags) if w not in memo])
        long = [w for w in found if len(w) > self.longest]
        memo.update(found)
        out = np.array([sum(map(memo.__getitem__, sorted(bag))) for bag in bags]) + self.model.bias
        for w in long:  # rare, and would make the memo's bound in bytes moot
            del memo[w]
        return out


def letter_runs(word: str) -> set[str]:
    return {word[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(word) - n + 1)}


def choose_landmarks(toxic: list[str], clean: list[str]) -> list[str]:
    """Letter runs that many toxic and few clean documents have, each for documents and letters of its own; then the commonest clean words."""
    bag = lambda x: {w for w in map(bare, set(x.lower().split())) if w}
    clean_words = Counter(w for x in clean for w in bag(x))
    common = {w for w, n in clean_words.items() if n > max(2, 0.02 * len(clean))}
    toxic_bags = [sorted(bag(x) - common) for x in toxic]
    floor = max(2, len(toxic) // 100)
    # first an upper bound of each run's documents, by digest, so that only runs above the floor take memory
    mask = (1 << 22) - 1
    bound = np.zeros(mask + 1, np.int32)
    for found in toxic_bags:
        bound[list({hash(run) & mask for w in found for run in letter_runs(w)})] += 1

    def counted(bags, likely) -> Counter:
        out: Counter = Counter()
        known: dict[str, tuple[str, ...]] = {}
        for found in bags:
            for w in found:
                if w not in known:
                    known[w] = tuple(run for run in letter_runs(w) if likely(run))
            out.update({run for w in found for run in known[w]})
        return out

    n_toxic = {run: n for run, n in counted(toxic_bags, lambda run: bound[hash(run) & mask] >= floor).items() if n >= floor}
    n_clean = counted(map(bag, clean), n_toxic.__contains__)
    # the log-likelihood ratio of a run's toxic documents
    share = len(toxic) / (len(toxic) + len(clean))
    worth = {run: n * np.log(n / (share * (n + n_clean[run]))) for run, n in n_toxic.items()}
    odds = {run: n / len(toxic) / ((n_clean[run] + 1) / (len(clean) + 1)) for run, n in n_toxic.items()}
    clear = {run for run in n_toxic if worth[run] >= LEAST_WORTH and odds[run] >= LEAST_ODDS}
    docs: dict[str, set[int]] = defaultdict(set)
    words: dict[str, set[str]] = defaultdict(set)
    for i, found in enumerate(toxic_bags):
        for w in found:
            for run in letter_runs(w) & clear:
                docs[run].add(i)
                words[run].add(w)
    chosen: list[str] = []
    taken: set[str] = set()
    told: set[str] = set()  # words that a chosen run is part of
    for run in sorted(clear, key=lambda r: (-worth[r], -len(r), r)):
        core = run.strip(START + END)
        shared = {core[i : i + SHORTEST] for i in range(max(1, len(core) - SHORTEST + 1))}
        if shared & taken or len(words[run] & told) > 0.5 * len(words[run]) or any(len(docs[run] & docs[c]) > 0.9 * len(docs[run] | docs[c]) for c in chosen):
            continue
        chosen.append(run)
        taken |= shared
        told |= words[run]
        if len(chosen) == TOXIC_LANDMARKS:
            break
    plain = [w for w, _ in sorted(clean_words.items(), key=lambda x: (-x[1], x[0])) if SHORTEST <= len(w) - 2 <= LONGEST and w not in chosen]
    return chosen + plain[:PLAIN_LANDMARKS]


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss, by Newton steps on the active rows; the last is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        active = y * (x @ beta) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve(penalty + (xa * wa[:, None]).T @ xa, (xa * wa[:, None]).T @ y[active])
        if np.allclose(new, beta, atol=1e-9):
            break
        beta = 0.5 * beta + 0.5 * new if _ > 30 else new
    return beta


def train(toxic: list[str], clean: list[str]) -> Model | None:
    """A model from the texts of both classes; None if either has none."""
    if not toxic or not clean:
        return None
    marks = choose_landmarks(toxic, clean)
    if not marks:
        return None
    strings, texts = Strings(marks), toxic + clean
    x, known = np.zeros((len(texts), len(marks))), {}
    for start in range(0, len(texts), 100):
        bags = [[part for w in sorted(bag_of(text)) if (b := bare(w)) for part in windows(b)] for text in texts[start : start + 100]]
        new = sorted({part for bag in bags for part in bag} - known.keys())
        known.update(zip(new, strings.kernel(new)))
        for i, bag in enumerate(bags, start):
            if bag:
                x[i] = np.sum([known[part] for part in bag], axis=0)
        if len(known) > 200_000:
            known = {}
    y = np.r_[np.ones(len(toxic)), -np.ones(len(clean))]
    # Nystrom: features whitened by the landmarks' own kernel matrix, folded into the weights
    own = strings.kernel(marks).astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2 + 1e-2 * np.eye(len(marks)))
    half = vectors @ np.diag(np.maximum(values, 1e-2) ** -0.5) @ vectors.T
    weight = np.where(y > 0, len(y) / (2 * len(toxic)), len(y) / (2 * len(clean)))
    beta = squared_hinge(x @ half, y, weight, ridge=0.3)
    folded, bias = half @ beta[:-1], float(beta[-1])
    slope, offset = calibrate(x @ folded + bias, y > 0)
    return Model(marks, folded, bias, slope, offset)


def calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to chances, with Platt's smoothed targets."""
    a, b = label.sum(), (~label).sum()
    target = np.where(label, (a + 1) / (a + 2), 1 / (b + 2))
    x, beta = np.c_[margin, np.ones(len(margin))], np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def sample_texts(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, bound: dict[int, int]) -> dict[int, list[str]]:
    """Texts of labelled documents, at most bound[c] of class c, those with the smallest digests of their ids.

    Null ids, labels and texts are left out. A document with several labels has the largest, and one with
    several texts the smallest.
    """
    spark = docs.sparkSession
    of = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("c"))
    ids = [r for c, n in bound.items() for r in of.where(F.col("c") == c).orderBy(F.xxhash64("k"), "k").limit(n).collect()]
    if not ids:
        return {c: [] for c in bound}
    few = spark.createDataFrame(ids, of.schema)  # at most the bound, two numbers a row
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(few), "k").groupBy("k", "c").agg(F.min("t").alias("t"))
    found: dict[int, list[str]] = {c: [] for c in bound}
    for r in texts.orderBy("k").collect():
        found[r.c].append(r.t)
    return found


def score_table(df: DataFrame, model: Model | None, text: str = "text", score: str = "score") -> DataFrame:
    """df with one more column, the score (0 to 1). A null text is scored as an empty one; without a model all scores are 0. A column named like it is replaced."""
    names = [c for c in df.columns if c != score]
    rows = df.select(*[F.col(f"`{c}`") for c in names])
    if model is None:
        return rows.withColumn(score, F.lit(0.0))
    shared = df.sparkSession.sparkContext.broadcast(model)  # some dozens of strings and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        matcher = kept(("toxicity", model.bias, *model.landmarks), lambda: Matcher(model))
        for batch in by_slices(batches):
            found = model.score(matcher.margins([x or "" for x in batch.column(text).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.float64())], names=[*names, score])

    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{types}, `{score}` double")


def held_out(key: str):
    """Documents that are never trained on: a fifth, by the CRC of their ids."""
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def train_on(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    found = sample_texts(docs, labels.where(~held_out(key)), key, text, label, SAMPLE)
    return train(found[1], found[0])


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity score of every document; labels are learnt from four fifths of them. Null texts score as empty ones; repeated rows are scored each; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_on(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score_table(docs, model).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
