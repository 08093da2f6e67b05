"""Text analysis: tokenizers, token filters and analyzers over DataFrames.

A document's terms are one array column: tokenizers make it from the text (`array`), filters change it
(`array`), and nothing is shuffled until terms of different documents meet. Where byte offsets are asked
for, tokens are rows (doc_id, ord, term, start, end) instead, `end` exclusive: tokenizers have `rows` and
filters `apply` for them, and windows run over one document. All of it stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions.arrays import counted, none, without_repeats
from quern.functions.strings import fold_ascii, lower_each, normalize
from quern.sources.store import dealt

# The default English stopwords.
STOPWORDS = frozenset(
    """
a an the and or but if then else when at by for with about against between into through during
before after above below to from up down in out on off over under again further once here there all
any both each few more most other some such no nor not only own same so than too very can
will just don should now is are was were be been being have has had having do does did doing
of as this that these those it its i you he she we they me him her us them
""".split()
)


def stopword_list(*words: str) -> frozenset[str]:
    return frozenset(w for w in (x.strip().lower() for x in words) if w)


def merge_stopwords(*sets: frozenset[str]) -> frozenset[str]:
    return frozenset().union(*sets)


def by_doc():
    """Tokens of a document in order."""
    return W.partitionBy("doc_id").orderBy("ord")


def _runs(docs: DataFrame, word: str, gap: str) -> DataFrame:
    """Runs matching `word` with byte offsets: all runs of either kind, and running sums of their lengths.

    Texts are dealt out by document before they become runs, so the windows shuffle texts once and no runs; a task gets some 4 MB of them.
    """
    text = F.coalesce("text", F.lit(""))
    runs = dealt(docs.select("doc_id", "text"), "doc_id", each=4 << 20).select("doc_id", F.posexplode(F.regexp_extract_all(text, F.lit(f"{word}|{gap}"), F.lit(0))).alias("run", "term"))
    end = F.sum(F.octet_length("term")).over(W.partitionBy("doc_id").orderBy("run"))
    runs = runs.withColumn("end", end.cast("int")).where(F.col("term").rlike(f"^(?:{word})$"))
    return runs.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("run")) - 1).alias("ord"), "term", (F.col("end") - F.octet_length("term")).alias("start"), "end")


def exploded(docs: DataFrame, terms: Column) -> DataFrame:
    """(doc_id, ord, term) of an array column. The outer form spares a filter that computes the array once more."""
    return docs.select("doc_id", F.posexplode_outer(terms).alias("ord", "term")).where(F.col("term").isNotNull())


class Tokenizer:
    def array(self, text: Column) -> Column:
        raise NotImplementedError

    def rows(self, docs: DataFrame, offsets: bool = False) -> DataFrame:
        return self._offsets(docs) if offsets else exploded(docs, self.array(F.coalesce("text", F.lit(""))))


@dataclass(frozen=True)
class SimpleTokenizer(Tokenizer):
    """Runs of letters, decimal digits and underscores, each kind by its flag."""

    letters: bool = True
    digits: bool = True
    underscore: bool = True

    @property
    def kinds(self) -> str:
        return r"\p{L}" * self.letters + r"\p{Nd}" * self.digits + "_" * self.underscore

    def array(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(f"[{self.kinds}]+"), F.lit(0)) if self.kinds else none()

    def _offsets(self, docs: DataFrame) -> DataFrame:
        return _runs(docs, f"[{self.kinds}]+", f"[^{self.kinds}]+") if self.kinds else _runs(docs.where("false"), "x", "y")


@dataclass(frozen=True)
class WhitespaceTokenizer(Tokenizer):
    """Runs of characters that are not Unicode blanks."""

    def array(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(r"[^\p{IsWhite_Space}]+"), F.lit(0))

    def _offsets(self, docs: DataFrame) -> DataFrame:
        return _runs(docs, r"[^\p{IsWhite_Space}]+", r"\p{IsWhite_Space}+")


@dataclass(frozen=True)
class NGramTokenizer(Tokenizer):
    """All character n-grams of each simple token, sizes ascending; offsets are the token's."""

    min_n: int = 1
    max_n: int = 1

    @property
    def bounds(self) -> tuple[int, int]:
        low = max(1, self.min_n)
        return low, max(low, self.max_n)

    def array(self, text: Column) -> Column:
        low, high = self.bounds
        words = F.filter(SimpleTokenizer().array(text), lambda w: F.char_length(w) >= low)
        of_size = lambda w, n: F.transform(F.sequence(F.lit(1), F.char_length(w) - n + 1), lambda i: F.substring(w, i, n))
        sizes = lambda w: F.sequence(F.lit(low), F.least(F.lit(high), F.char_length(w)))
        return F.flatten(F.transform(words, lambda w: F.flatten(F.transform(sizes(w), lambda n: of_size(w, n)))))

    def _offsets(self, docs: DataFrame) -> DataFrame:
        low, high = self.bounds
        words = SimpleTokenizer().rows(docs, True).where(F.char_length("term") >= low)
        sizes = F.sequence(F.lit(low), F.least(F.lit(high), F.char_length("term")))
        grams = words.withColumn("n", F.explode(sizes)).withColumn("at", F.explode(F.sequence(F.lit(1), F.char_length("term") - F.col("n") + 1)))
        order = F.row_number().over(W.partitionBy("doc_id").orderBy("ord", "n", "at")) - 1
        return grams.select("doc_id", order.alias("new"), F.substring("term", F.col("at"), F.col("n")).alias("term"), "start", "end").withColumnRenamed("new", "ord")


class Changing:
    """A filter that maps each term by `change`."""

    def array(self, terms: Column) -> Column:
        return F.transform(terms, self.change)

    def apply(self, tokens: DataFrame) -> DataFrame:
        return tokens.withColumn("term", self.change(F.col("term")))


class Keeping:
    """A filter that keeps the terms for which `keeps` holds; None: all."""

    def array(self, terms: Column) -> Column:
        return terms if self.keeps(F.lit("")) is None else F.filter(terms, self.keeps)

    def apply(self, tokens: DataFrame) -> DataFrame:
        kept = self.keeps(F.col("term"))
        return tokens if kept is None else tokens.where(kept)


@dataclass(frozen=True)
class Lowercase(Changing):
    def change(self, term: Column) -> Column:
        return lower_each(term)


@dataclass(frozen=True)
class MinLength(Keeping):
    min: int = 1

    def keeps(self, term: Column) -> Column | None:
        return F.char_length(term) >= max(1, self.min)


@dataclass(frozen=True)
class MaxLength(Keeping):
    max: int = 0

    def keeps(self, term: Column) -> Column | None:
        return F.char_length(term) <= self.max if self.max > 0 else None


@dataclass(frozen=True)
class Stopwords(Keeping):
    words: frozenset[str] = STOPWORDS

    def keeps(self, term: Column) -> Column | None:
        return ~term.isin(*sorted(self.words)) if self.words else None


@dataclass(frozen=True)
class DedupAdjacent:
    """Drop a token equal to the one before it in the stream as it is here."""

    def array(self, terms: Column) -> Column:
        return without_repeats(terms)

    def apply(self, tokens: DataFrame) -> DataFrame:
        before = F.lag("term").over(by_doc())
        return tokens.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("term"))).drop("_before")


@dataclass(frozen=True)
class AsciiFold(Changing):
    def change(self, term: Column) -> Column:
        return fold_ascii(term)


@dataclass(frozen=True)
class Prefix(Keeping):
    prefix: str = ""

    def keeps(self, term: Column) -> Column | None:
        return term.startswith(self.prefix) if self.prefix else None


class Analysis:
    """What analyzers and pipelines share; `array` gives a text's terms, empty ones too."""

    def terms(self, docs: DataFrame) -> DataFrame:
        """(doc_id, ord, term) without empty terms; one that a filter has emptied leaves a gap in ord."""
        return exploded(docs, self.array(F.coalesce("text", F.lit("")))).where("term <> ''")

    def list(self, text: Column) -> Column:
        """The terms of a text as an array, without empty ones."""
        return F.filter(self.array(F.coalesce(text, F.lit(""))), lambda x: x != "")


@dataclass(frozen=True)
class Analyzer(Analysis):
    """A tokenizer and filters in order. The default ones: lower case, length, stopwords, adjacent repeats."""

    tokenizer: object = field(default_factory=SimpleTokenizer)
    filters: tuple = (Lowercase(), MinLength(1), Stopwords(), DedupAdjacent())

    def array(self, text: Column) -> Column:
        terms = self.tokenizer.array(text)
        for f in self.filters:
            terms = terms if f is None else f.array(terms)
        return terms

    def analyze(self, docs: DataFrame) -> DataFrame:
        """(doc_id, position, term, start, end); a filter that empties a term leaves a gap in the positions."""
        tokens = self.tokenizer.rows(docs, True)
        for f in self.filters:
            tokens = tokens if f is None else f.apply(tokens)
        tokens = tokens.withColumn("position", F.row_number().over(by_doc()) - 1)
        return tokens.where("term <> ''").select("doc_id", "position", "term", "start", "end")


DEFAULT = Analyzer()
IDENTITY = Analyzer(WhitespaceTokenizer(), (Lowercase(),))


@dataclass(frozen=True)
class Pipeline(Analysis):
    """Analyzers in a chain: each gets the terms of the one before, joined by blanks. None at all: the default one."""

    stages: tuple = ()

    def _chain(self) -> list:
        return [s for s in self.stages if s is not None] or ([] if self.stages else [DEFAULT])

    def array(self, text: Column) -> Column:
        stages = self._chain()
        for s in stages[:-1]:
            text = F.array_join(s.list(text), " ")
        return stages[-1].array(text) if stages else none()

    def analyze(self, docs: DataFrame) -> DataFrame:
        stages, text = self._chain(), F.coalesce("text", F.lit(""))
        for s in stages[:-1]:
            text = F.array_join(s.list(text), " ")
        return (stages or [DEFAULT])[-1].analyze(docs.select("doc_id", text.alias("text")).where(F.lit(bool(stages))))


def term_lists(docs: DataFrame, analyzer=DEFAULT, unique: bool = False) -> DataFrame:
    """(doc_id, terms array) for every document, in order; unique keeps first occurrences."""
    terms = analyzer.list(F.col("text"))
    return docs.select("doc_id", (F.array_distinct(terms) if unique else terms).alias("terms"))


def term_freq(docs: DataFrame, analyzer=DEFAULT) -> DataFrame:
    """(doc_id, term, tf), counted in each document's array; rows that repeat an id are documents of their own."""
    return docs.select("doc_id", F.inline_outer(counted(analyzer.list(F.col("text"))))).where(F.col("term").isNotNull())


def count_tokens(docs: DataFrame, analyzer=DEFAULT) -> DataFrame:
    """(doc_id, length), 0 for documents without terms."""
    return docs.select("doc_id", F.size(analyzer.list(F.col("text"))).cast("long").alias("length"))


def has_term(docs: DataFrame, term: str, analyzer=DEFAULT) -> DataFrame:
    """(doc_id, has_term): whether a document's terms hold the normalized term."""
    return docs.select("doc_id", F.array_contains(analyzer.list(F.col("text")), normalize(F.lit(term))).alias("has_term"))
