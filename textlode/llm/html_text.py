"""Main text of web pages: a suffix array over the token streams of a host's pages.

A page becomes blocks, and their words its token stream, all of it: articles, menus, footers and the rest.
Markup tells only what an element is: scripts, forms, menus, headers, footers, sidebars and reader comments
are page furniture, an article is an article. Class words nominate a block at most (`MARKED`); they drop
nothing inside an article by themselves.

The streams of a host's pages are concatenated and their suffixes sorted by prefix doubling up to RUN tokens.
A run of RUN tokens that stands outside articles on two distinct pages is boilerplate. Covered tokens are
removed from nominated blocks in articles and, on pages without an article, from all that is no furniture;
unique runs stay. An article's other text stays by rule, whether it repeats in articles or outside them: a
passage that pages share in their articles cannot be told from what leaked into them, and articles do quote
what footers and adverts say (on the tables at hand one page in six does). Pages with the same stream are
one page here, so that copies do not erase each other.

A host's pages are dealt in parts of bounded size, each with an array of its own. Runs that stand outside
articles on pages of different parts are found by their digests, counted over the host, and each part is
given those of its host, so that the number of parts changes no text.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, park, table
from .url_filters import url_host

RUN = 8
#: Pages of a host in one suffix array, and the characters that one array is filled up to.
PART_PAGES, ARRAY_CHARS = 1024, 4_000_000
BROADCAST_HOSTS = 100_000
#: Digests in a row that is given to a part.
HANDED = 4096
M1, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)

#: What HTML elements are.
RAW = frozenset("script style noscript template textarea title svg iframe object canvas math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset("article main".split())
ASIDE = frozenset("nav footer aside form button select dialog menu head".split())
#: Names of reader comments, as whole class or id tokens of a section or list.
COMMENTS, HOLDERS = frozenset("comments comment-list comments-area comments-section disqus_thread respond".split()), frozenset("section div ol ul".split())
#: Words of class, id and role that nominate a block as no main text.
MARKED_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sidebar aside complementary
    footer masthead contentinfo cookie cookies consent gdpr notice notices alert popup modal overlay
    comment comments disqus respond replies form search login signup subscribe subscription newsletter
    share sharing social related recommended recommendations widget toolbar header siteheader pageheader topbar""".split()
)
#: Class, id and role words of main text, for pages without an element for it.
CONTENT = frozenset("article main content post entry story".split())
TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|$))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)|<[!?][^>]*(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))|\b(hidden)\b""")
WORD = re.compile(r"[a-z]+")

#: Furniture; neither; by class words main text; an article; nominated outside an article and in one.
OTHER, OPEN, CONTENTS, ARTICLE, MARKED, MARKED_IN = range(6)


def role_of(tag: str, attributes: str, inside: int) -> int:
    """What an element's content is, from the element and what it is inside of."""
    if inside == OTHER or tag in ASIDE or (tag == "header" and inside not in (ARTICLE, CONTENTS)):
        return OTHER
    role = ARTICLE if tag in MAIN else inside
    if attributes and tag not in ("html", "body"):
        for name, a, b, c, bare in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if bare or name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                return OTHER
            if name in ("class", "id", "role") and tag not in MAIN:
                words = set(WORD.findall(value))
                if tag in HOLDERS and COMMENTS & set(value.split()):
                    return OTHER
                if words & MARKED_WORDS:
                    role = MARKED_IN if inside in (ARTICLE, MARKED_IN) else MARKED
                elif words & CONTENT and role == OPEN:
                    role = CONTENTS
    return role


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(role, text) of every block of a page in its order. Text has single spaces and is never empty; a null page has no blocks."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    pieces: list[str] = []
    role, at, page = OPEN, 0, page or ""

    def flush() -> None:
        if pieces:
            # a reference may be cut by inline tags, so it is decoded in the block as a whole
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append((role, text))
            pieces.clear()

    while (found := TAG.search(page, at)) is not None:
        if found.start() > at:
            pieces.append(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if tag not in INLINE or stack[depth][1] != (stack[depth - 1][1] if depth else OPEN):
                        flush()
                    if tag in INLINE and any(t not in INLINE for t, _ in stack[depth + 1 :]):
                        del stack[depth]  # closed across a block: the block goes on
                    else:
                        del stack[depth:]
                    role = stack[-1][1] if stack else OPEN
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            pieces.append(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):
                while stack and (stack[-1][0] in INLINE or stack[-1][0] == tag):
                    if stack[-1][0] == tag:
                        stack.pop()
                        break
                    stack.pop()
                role = stack[-1][1] if stack else OPEN
        if tag in VOID or found[0].endswith("/>"):
            continue
        now = role_of(tag, found[3], role)
        if now != role:
            flush()
        stack.append((tag, now))
        role = now
    pieces.append(page[at:])
    flush()
    if any(r in (ARTICLE, MARKED_IN) for r, _ in out):
        return [(OPEN if r == CONTENTS else r, x) for r, x in out]
    return [(ARTICLE if r == CONTENTS else r, x) for r, x in out]


def repeated(tokens: np.ndarray, pages: np.ndarray, counts: np.ndarray | None = None, run: int = RUN) -> np.ndarray:
    """Which runs of `run` tokens, by their first, stand on two distinct pages; only runs that count are looked at there.

    tokens: numbers, of which a page's last is its own alone; pages: the page of each token; counts: of which tokens
    the run that begins there counts (all). The suffixes are ranked by their first 1, 2, 4, ... tokens; equal ranks are
    neighbours in the suffix array, and every suffix of a rank that stands on two pages is a hit, whether it counts or not.
    """
    n, rank, have = len(tokens), np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    hit = np.zeros(n, bool)
    if n < run:
        return hit
    while have < run:
        step = min(have, run - have)
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        rank, have = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64), have + step
    array = np.argsort(rank)  # in any order where equal
    starts = np.r_[0, np.flatnonzero(np.diff(rank[array])) + 1]
    of, far = pages[array], np.iinfo(np.int64)
    counted = np.ones(n, bool) if counts is None else counts[array]
    several = np.minimum.reduceat(np.where(counted, of, far.max), starts) < np.maximum.reduceat(np.where(counted, of, far.min), starts)
    hit[array] = np.repeat(several, np.diff(np.r_[starts, n]))
    hit[n - run + 1 :] = False
    return hit


def covered(starts: np.ndarray, run: int = RUN) -> np.ndarray:
    """Tokens under the runs that begin at the marked places."""
    edges = np.zeros(len(starts) + run + 1, np.int64)
    at = np.flatnonzero(starts)
    edges[at] += 1
    np.add.at(edges, at + run, -1)
    return (np.cumsum(edges) > 0)[: len(starts)]


def outside(roles: np.ndarray, run: int = RUN) -> np.ndarray:
    """Of which tokens the run that begins there lies outside articles, whole."""
    article = np.cumsum(np.r_[0, roles == ARTICLE])
    out = np.zeros(len(roles), bool)
    if len(roles) >= run:
        out[: len(roles) - run + 1] = article[run:] == article[:-run]
    return out


class Words:
    """Numbers and digests of words; memo: how many are kept."""

    def __init__(self, memo: int = 200_000) -> None:
        self.digest: dict[str, int] = {}
        self.size = memo

    def digests(self, words: list[str]) -> np.ndarray:
        if len(self.digest) > self.size:
            self.digest.clear()
        known = self.digest
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def run_digests(words: np.ndarray, run: int = RUN) -> np.ndarray:
    """A digest of each run, from the words' digests."""
    out = np.zeros(max(0, len(words) - run + 1), np.uint64)
    for k in range(run):
        out = (out ^ (out >> np.uint64(29))) * M1 + words[k : k + len(out)] * ODD
    return out.view(np.int64)


def stream(found: list[tuple[int, str]]) -> tuple[list[str], np.ndarray]:
    """The words of a page's blocks and the role of each."""
    words = " ".join([text for _, text in found]).split(" ") if found else []
    return words, np.repeat(np.array([r for r, _ in found], np.int8), [text.count(" ") + 1 for _, text in found])


def extracted(hosts: list[str], parsed: list[list[tuple[int, str]]], often: dict[str, np.ndarray]) -> list[tuple[str, int]]:
    """(text, removed tokens) of each page, from one suffix array over the whole streams of all; often: digests of boilerplate runs known of a host beyond this array."""
    number: defaultdict[str, int] = defaultdict(count().__next__)
    memo, streams, tokens, pages, counts = Words(), [], [], [], []
    host_number = {h: i for i, h in enumerate(dict.fromkeys(hosts))}
    for p, (host, found) in enumerate(zip(hosts, parsed)):
        words, roles = stream(found)
        streams.append((words, roles))
        of_page = np.fromiter(map(number.__getitem__, words), np.int64, len(words)) * len(host_number) + host_number[host]
        tokens.append(np.append(of_page, -p - 1))  # the last is its own: no run crosses pages
        pages.append(np.full(len(words) + 1, xxhash.xxh64_intdigest(host + " " + " ".join(words)) - 2**63))
        counts.append(np.append(outside(roles), False))
    hits = repeated(np.concatenate(tokens), np.concatenate(pages), np.concatenate(counts)) if tokens else np.zeros(0, bool)
    out, at = [], 0
    for host, (words, roles) in zip(hosts, streams):
        starts = hits[at : at + len(words)].copy()
        at += len(words) + 1
        if host in often and len(words) >= RUN:
            starts[: len(words) - RUN + 1] |= np.isin(run_digests(memo.digests(words)), often[host])
        main = (roles == ARTICLE) | (roles == MARKED_IN)
        wanted = main if main.any() else roles == OPEN
        kept = wanted & ~(covered(starts) & (roles != ARTICLE))
        text = " ".join(compress(words, kept.tolist()))
        out.append((text, int(wanted.sum() - kept.sum())))
    return out


def parsed_pages(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys with row, host, roles and texts: the blocks of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_slices(batches, 200):
            found = [blocks(x) for x in batch.column("html").to_pylist()]
            made = [pa.array([[r for r, _ in b] for b in found], pa.list_(pa.int8())), pa.array([[t for _, t in b] for b in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("row"), batch.column("host"), *made], names=[*keys, "row", "host", "roles", "texts"])

    types = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.select(*keys, "row", "host", "html").mapInArrow(run, f"{types}row long, host string, roles array<tinyint>, texts array<string>")


def runs_outside(pages: DataFrame) -> DataFrame:
    """(host, stream, digests): the runs outside articles of each page, and a digest of its whole stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        with np.errstate(over="ignore"):
            for batch in by_slices(batches, 200):
                made, names = [], []
                for roles, texts in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist()):
                    words, of = stream(list(zip(roles, texts)))
                    digests = run_digests(memo.digests(words))
                    made.append(np.unique(digests[outside(of)[: len(digests)]]))
                    names.append(xxhash.xxh64_intdigest(" ".join(words)) - 2**63)
                yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(names, pa.int64()), pa.array(made, pa.list_(pa.int64()))], names=["host", "stream", "digests"])

    return pages.select("host", "roles", "texts").mapInArrow(run, "host string, stream long, digests array<long>")


def judged_pages(dealt: DataFrame, keys: list[str]) -> DataFrame:
    """keys with text and n_removed. dealt must come with whole (host, part) groups in each partition, one after the other, digests (rows without roles) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        often: dict[str, list] = {}
        chars, last = 0, None

        def out() -> pa.RecordBatch:
            with np.errstate(over="ignore"):
                found = extracted([x[0] for x in held], [x[1] for x in held], {h: np.concatenate(d) for h, d in often.items()})
            rows = pa.Table.from_batches([x[2] for x in held]).combine_chunks()
            columns = [rows.column(k).chunk(0) for k in keys]
            return pa.RecordBatch.from_arrays([*columns, pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=[*keys, "text", "n_removed"])

        for batch in by_slices(batches, 200):
            columns = [batch.column(c).to_pylist() for c in ("host", "part", "roles", "texts", "digests")]
            key_columns = batch.select(keys)
            for i, (host, part, roles, texts, digests) in enumerate(zip(*columns)):
                if (host, part) != last and chars > ARRAY_CHARS:
                    yield out()
                    held, often, chars = [], {}, 0
                last = (host, part)
                if roles is None:
                    often.setdefault(host, []).append(np.array(digests, np.int64))
                    continue
                held.append((host, list(zip(roles, texts)), key_columns.slice(i, 1)))
                chars += sum(map(len, texts))
        if held:
            yield out()

    types = "".join(f"{k} {dealt.schema[k].dataType.simpleString()}, " for k in keys)
    return dealt.mapInArrow(run, f"{types}text string, n_removed long")


def main_text(df: DataFrame, keys: list[str], url: str = "url", page: str = "html") -> DataFrame:
    """keys with text, n_chars and n_removed (tokens of main text that were boilerplate), one row for each of df.

    A null or empty page has an empty text. Pages without a host are judged as pages of one host of their
    own. Broken markup is read as far as it goes, pages of any length whole. Repeated rows are pages of one
    stream and erase nothing of each other. An empty table gives an empty one. Other columns are not carried.
    """
    spark = df.sparkSession
    names = {f"_tl_k{i}": k for i, k in enumerate(keys)}
    host = F.coalesce(url_host(F.col(url)), F.lit(""))
    big = df.select(host.alias("host")).groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > PART_PAGES)
    big = park(big.select("host", F.ceil(F.col("n") / PART_PAGES).cast("int").alias("parts")), "hosts")
    big = F.broadcast(big) if big.count() <= BROADCAST_HOSTS else big
    rows = df.select(*[F.col(k).alias(n) for n, k in names.items()], host.alias("host"), F.col(page).alias("html")).withColumn("row", F.monotonically_increasing_id())
    # parsed on the way to the exchange; pages of divided hosts once more for their digests, which takes less than keeping all blocks
    placed = parsed_pages(rows, list(names)).join(big, "host", "left").withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int"))
    dealt = placed.select(*names, "host", "part", "row", "roles", "texts", F.lit(None).cast("array<long>").alias("digests"))
    if not big.isEmpty():
        told = runs_outside(parsed_pages(rows.join(big, "host", "left_semi"), [])).select("host", "stream", F.explode("digests").alias("d"))
        often = park(told.groupBy("host", "d").agg(F.min("stream").alias("a"), F.max("stream").alias("b")).where("a <> b").select("host", "d"), "often")
        sizes = park(often.groupBy("host").agg(F.ceil(F.count("*") / HANDED).cast("int").alias("chunks")), "sizes")
        rowed = often.join(sizes, "host").groupBy("host", F.pmod(F.xxhash64("d"), "chunks").alias("chunk")).agg(F.collect_list("d").alias("digests"))  # about HANDED each
        handed = rowed.join(big, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "digests")
        dealt = dealt.unionByName(handed.withColumn("row", F.lit(-1).cast("long")), allowMissingColumns=True)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // (4 * PART_PAGES)))
    dealt = dealt.repartition(tasks, "host", "part").sortWithinPartitions("host", "part", "row")
    found = judged_pages(dealt, list(names))
    return found.select(*[F.col(n).alias(k) for n, k in names.items()], "text", F.length("text").cast("long").alias("n_chars"), "n_removed")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page. Nulls, empty and repeated pages as main_text says."""
    return main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
