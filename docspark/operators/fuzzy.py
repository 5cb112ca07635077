"""Joins of texts that are nearly equal, by the ratio of matching blocks: 2 M / (|a| + |b|), M the characters in the blocks that match.

For a ratio of t or more, with s = |a| + |b|:

* M >= t s / 2, and M is at most the shorter length, so |b| lies between |a| t / (2 - t) and |a| (2 - t) / t;
* between two blocks that follow each other at least one character of either text is unmatched, so there are at most (1 - t) s + 1 blocks,
  and a block of n characters holds n - q + 1 grams of q characters: the texts share at least t s / 2 - (q - 1) ((1 - t) s + 1) grams, counted
  with their repeats.

With |b| as short as it may be, that is a least number of shared grams which |a| alone gives. Of two bags that share so many, the first
(size - number + 1) grams in any common order share one. So each text is joined by those first grams; pairs that meet are compared
exactly. Grams of two characters are used where they prove anything, single characters for the short texts where they do not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .shared import kept

#: Members of a class that meet those of another in one group.
BLOCK = 4096

#: Up to so many forms of a key are compared one by one with each text of that key, without a join of grams.
FEW = 32


def form(text: str | None) -> str:
    return " ".join((text or "").strip().lower().split())


class Against:
    """A form that others are compared with. What it takes to bound a ratio is worked out once: the characters in matching blocks stand in
    the same order in both texts, so they are at most the longest common subsequence, which comes from whole numbers as rows of bits."""

    def __init__(self, form: str):
        self.form, self.n = form, len(form)
        self.places: dict[str, int] | None = None
        self.matcher: SequenceMatcher | None = None

    def subsequence(self, x: str) -> int:
        """The length of the longest common subsequence."""
        if self.places is None:
            self.places = {}
            for i, c in enumerate(self.form):
                self.places[c] = self.places.get(c, 0) | 1 << i
        every = left = (1 << self.n) - 1
        for c in x:
            if (own := self.places.get(c)) and (hit := left & own):
                left = (left + hit | left - hit) & every
        return self.n - left.bit_count()

    def reached_by(self, x: str, least: float) -> bool:
        """Whether the ratio of ``x`` to this form reaches ``least``; what the bounds rule out is not compared."""
        s = len(x) + self.n
        if not x or not self.form or 2 * min(len(x), self.n) < least * s or 2 * self.subsequence(x) < least * s - 1e-9:
            return False
        if self.matcher is None:
            self.matcher = SequenceMatcher(None, "", self.form)
        self.matcher.set_seq1(x)
        return self.matcher.ratio() >= least


def alike(a: str | None, b: str | None, least: float) -> bool:
    """Whether the forms of two texts reach the ratio; lengths and subsequences that rule it out are not compared."""
    return Against(form(b)).reached_by(form(a), least)


def shared_grams(length: int, least: float, q: int) -> float:
    """How many grams a text of this length shares with any that is alike, at least."""
    s = length * 2 / (2 - least)  # with the shortest partner, as more characters share more
    return least * s / 2 - (q - 1) * ((1 - least) * s + 1)


def signs(text: str, least: float) -> list[str]:
    """The first grams of a form, in the order of their hashes."""
    n = len(text)
    if not n:
        return []
    short = 0  # the longest text of which pairs of characters prove nothing
    pairs = least / 2 > 1 - least
    if pairs:
        short = math.floor(1 / ((least / 2 - (1 - least)) * 2 / (2 - least)) + 1e-9)
    out = []
    for q in (1, 2):
        proven = shared_grams(n, least, q)
        if q == 2 and (not pairs or n <= short) or q == 1 and pairs and n > short * (2 - least) / least:
            continue
        seen: dict[str, int] = {}
        bag = []
        for i in range(n - q + 1):
            g = text[i : i + q]
            seen[g] = seen.get(g, 0) + 1
            bag.append(f"{q}{seen[g]} {g}")
        bag.sort(key=lambda x: (xxhash.xxh3_64_intdigest(x.encode()), x))
        out += bag[: len(bag) - max(1, math.ceil(proven - 1e-9)) + 1]
    return out


def _classes(rows: DataFrame, keys: list[str], key: str, text: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Members (``id, keys, c``) and classes (``keys, c, form, n, signs``) of rows that agree in ``keys`` and form; ``c`` is 128 bits of the
    form's hash, and signs are hashed, which adds pairs to compare and loses none."""
    kinds = dict(rows.dtypes)

    def forms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.rename(columns={"_text": "form"}).assign(form=[form(x) for x in f["_text"]])

    def signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), 256):
                some = f[a : a + 256]
                yield some.assign(signs=[[xxhash.xxh3_64_intdigest(s.encode()) - (1 << 63) for s in signs(x, least)] for x in some["form"]])

    named = [f"`{k}` {kinds[k]}" for k in keys]
    made = rows.select(F.col(key).alias("id"), *keys, F.col(text).alias("_text")).mapInPandas(forms, ", ".join([f"id {kinds[key]}", *named, "form string"]))
    made = kept(made.where("form <> ''").withColumn("c", F.substring(F.unhex(F.sha2("form", 256)), 1, 16)))
    each = made.groupBy(*keys, "c").agg(F.first("form").alias("form")).mapInPandas(signed, ", ".join([*named, "c binary", "form string", "signs array<long>"]))
    return made.select("id", *keys, "c").distinct(), kept(each.withColumn("n", F.length("form")))


def _alike_classes(left: DataFrame, right: DataFrame, keys: list[str], least: float) -> DataFrame:
    """``keys, c, d``: the classes whose forms reach the ratio. Signs are joined without texts, which meet the pairs that are left."""
    @F.pandas_udf(BooleanType())
    def reach(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x == y or Against(y).reached_by(x, least) for x, y in zip(a, b, strict=True)], dtype=bool)

    each = lambda df, c, n: df.select(*keys, F.col("c").alias(c), F.col("n").alias(n), F.explode("signs").alias("sign"))
    met = each(left, "c", "n").join(each(right, "d", "m"), [*keys, "sign"])
    met = met.where(2 * F.least("n", "m") >= F.lit(least) * (F.col("n") + F.col("m")) - 1e-9).select(*keys, "c", "d").distinct()
    texts = lambda df, c, x: df.select(*keys, F.col("c").alias(c), F.col("form").alias(x))
    met = met.join(texts(left, "c", "a"), [*keys, "c"]).join(texts(right, "d", "b"), [*keys, "d"])
    return met.where(reach("a", "b")).select(*keys, "c", "d")


def alike_pairs(left: DataFrame, right: DataFrame, key: str, text: str, keys: list[str], least: float) -> DataFrame:
    """``left_id, right_id`` of rows that agree in ``keys`` and whose texts' forms reach the ratio; texts without a form are like none.

    Equal forms of a key are one class. Classes are joined by ``keys`` and a gram, so a key with very many of them is dealt by grams, and
    lengths are compared before texts are. Members meet in blocks of ``BLOCK`` by ``BLOCK``, so copies cost the pairs that they make.
    """
    (a, some), (b, others) = _classes(left, keys, key, text, least), _classes(right, keys, key, text, least)
    a, b = kept(a), kept(b)
    pairs = kept(_alike_classes(some, others, keys, least))
    blocks = lambda df, c, n: df.groupBy(*keys, F.col("c").alias(c)).agg(F.ceil(F.count("*") / BLOCK).alias(n))
    pairs = kept(pairs.join(blocks(a, "c", "n"), [*keys, "c"]).join(blocks(b, "d", "m"), [*keys, "d"]))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    lefts = pairs.join(a, [*keys, "c"]).withColumn("i", deal("n")).withColumn("j", every("m")).select(F.col("id").alias("left_id"), *keys, "c", "d", "i", "j")
    rights = pairs.join(b.withColumnRenamed("c", "d"), [*keys, "d"]).withColumn("j", deal("m")).withColumn("i", every("n")).select(F.col("id").alias("right_id"), *keys, "c", "d", "i", "j")
    found = lefts.join(rights, [*keys, "c", "d", "i", "j"]).select("left_id", "right_id")
    several = lambda df: bool(df.groupBy("id").count().where("count > 1").limit(1).count())
    return found.distinct() if several(a) or several(b) else found  # only ids of several classes can make a pair twice


def without_alike(rows: DataFrame, gone: DataFrame, key: str, text: str, keys: list[str], least: float) -> DataFrame:
    """``rows`` that are like none of ``gone`` (``keys`` and the same text column).

    Where a key has up to ``FEW`` forms to go, each text meets them as it is, so what is shuffled are the texts. The others, with all their
    forms, are joined by grams, as pairs are.
    """
    formed = F.pandas_udf(lambda x: pd.Series([form(t) for t in x], dtype=object), "string")
    told = gone.select(*keys, formed(text).alias("_form")).where("_form <> ''").distinct()
    told = kept(told.groupBy(*keys).agg(F.count("*").alias("_n"), F.slice(F.collect_list("_form"), 1, FEW).alias("_gone")))

    @F.pandas_udf(BooleanType())
    def stays(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out, held = [], {}
        for t, forms in zip(texts, lists, strict=True):
            x, these = form(t), () if forms is None else tuple(forms)
            if these not in held:
                held = {these: [Against(y) for y in these]}  # rows of a key mostly follow each other
            out.append(not any(x == y.form or y.reached_by(x, least) for y in held[these]))
        return pd.Series(out, dtype=bool)

    few = told.where(F.col("_n") <= FEW).select(*keys, "_gone")
    left = rows.join(few, keys, "left").where(F.col("_gone").isNull() | stays(F.col(text), F.col("_gone"))).select(*rows.columns)
    many = told.where(F.col("_n") > FEW).select(*keys)
    if many.isEmpty():
        return left
    members, some = _classes(rows.join(many, keys, "left_semi"), keys, key, text, least)
    _, others = _classes(gone.join(many, keys, "left_semi").withColumn(key, F.lit(None).cast(dict(rows.dtypes)[key])), keys, key, text, least)
    found = members.join(_alike_classes(some, others, keys, least).select(*keys, "c").distinct(), [*keys, "c"], "left_semi")
    return left.join(found.select(F.col("id").alias(key)).distinct(), key, "left_anti")
