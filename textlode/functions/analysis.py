"""Text analysis as column expressions.

The order is fixed and matters: punctuation to spaces, lower case, split, least length, stop
words, stems. A term's position is its index in the filtered list.
"""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stem import check_language, stem_arrays

#: The 32 signs that become spaces.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: White space between tokens. A tab or newline is a token by itself, so these two get spaces around them first.
GAP = r"[\x0B-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
ALONE = "[\t\n]"

#: The 127 stop words.
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing a an the and but if or because as until while
    of at by for with about against between into through during before after above below to from up down in out
    on off over under again further then once here there when where why how all any both each few more most
    other some such no nor not only own same so than too very s t can will just don should now""".split()
)


@dataclass(frozen=True)
class Analyzer:
    """min_length: in characters, before stemming; stop_words: compared with lower-case tokens; language: of the stemmer, None for none."""

    min_length: int | None = None
    stop_words: tuple[str, ...] = ()
    language: str | None = None

    def __post_init__(self) -> None:
        check_language(self.language)

    def tokens(self, text: Column) -> Column:
        """Tokens of a text, without stems: array<string>, empty for a null text."""
        # split is several times as fast here as matching tokens by the complement of GAP
        spaced = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(f"[{re.escape(PUNCTUATION)}]"), F.lit(" "))
        found = F.split(F.lower(F.regexp_replace(spaced, F.lit(ALONE), F.lit(" $0 "))), GAP)
        keep = [lambda t: t != ""]
        if self.min_length:
            keep.append(lambda t: F.length(t) >= self.min_length)
        if self.stop_words:
            keep.append(lambda t: ~t.isin(*self.stop_words))  # a hash set, once there are more than a few
        return F.filter(found, lambda t: functools.reduce(operator.and_, [test(t) for test in keep]))

    def settings(self) -> dict:
        return {"min_token_length": self.min_length, "stop_words": list(self.stop_words), "language": self.language}

    @staticmethod
    def from_settings(settings: dict) -> Analyzer:
        return Analyzer(settings.get("min_token_length"), tuple(settings.get("stop_words") or ()), settings.get("language"))


#: Everything as it comes; and the setting of the published benchmarks without stems.
RAW, STANDARD = Analyzer(), Analyzer(3, STOP_WORDS)


def analyze(docs: DataFrame, analyzer: Analyzer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens) of every document, one row each; a document without tokens keeps its row.

    Stems replace tokens array by array, each worker with a bounded memo of terms: no token is exchanged.
    """
    rows = docs.select(F.col(key), analyzer.tokens(F.col(text)).alias("tokens"))
    if analyzer.language is None:
        return rows
    return rows.select(key, stem_arrays("tokens", analyzer.language).alias("tokens"))


def positions(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, term), one row for each token.

    The outer form keeps Catalyst from inferring a filter on the token array, which would tokenise twice.
    """
    return tokens.select(key, F.posexplode_outer("tokens").alias("pos", "term")).where("pos is not null")
