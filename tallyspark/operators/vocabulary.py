"""Vocabularies of many aliases found in token lists: all matches, the longest ones from left to right, the longest prefix; and what is made of them: tags with evidence, rewritten queries.

Aliases that fit a broadcast (their size is summed first) become a trie of tokens with failure links, by which a text is read once, whatever the number of aliases. Larger vocabularies
are joined: runs of a text's tokens, of the lengths that aliases have, meet the aliases by equality. Both give the same rows.

Cases. An alias without tokens matches nothing. Aliases of several targets give a match for each. Null token lists have no matches. Texts and aliases must be normalised alike.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of aliases, and what a node costs, that are broadcast at most.
MOST_BYTES, NODE_BYTES = 8 << 20, 200


class TokenTrie:
    """States of a trie of tokens; a state's failure link is the longest shorter suffix that is a state too."""

    def __init__(self, aliases: Sequence[tuple[str, ...]]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for number, tokens in enumerate(aliases):
            at = 0
            for t in tokens:
                if t not in self.next[at]:
                    self.next[at][t] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                at = self.next[at][t]
            if tokens:
                self.ends[at].append(number)
        self.lengths = [len(a) for a in aliases]
        self.fail, self.above = [0] * len(self.next), [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            at = queue.popleft()
            for t, below in self.next[at].items():
                f = self.fail[at]
                while f and t not in self.next[f]:
                    f = self.fail[f]
                self.fail[below] = self.next[f].get(t, 0)
                queue.append(below)
            # the nearest state on the way of failure links that ends an alias
            self.above[at] = self.fail[at] if self.ends[self.fail[at]] else self.above[self.fail[at]]

    def all(self, tokens: Sequence[str]) -> Iterator[tuple[int, int]]:
        """(start, alias) of every match, by their ends."""
        at = 0
        for i, t in enumerate(tokens):
            while at and t not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(t, 0)
            found = at
            while found:
                for number in self.ends[found]:
                    yield i + 1 - self.lengths[number], number
                found = self.above[found]

    def longest(self, tokens: Sequence[str], prefix: bool = False) -> Iterator[tuple[int, int]]:
        """From left to right the longest match that starts at a token, and on behind it. prefix: only one that starts the text."""
        best: dict[int, int] = {}
        for start, number in self.all(tokens):
            if start not in best or self.lengths[number] >= self.lengths[best[start]]:
                best[start] = number if start not in best or self.lengths[number] > self.lengths[best[start]] else min(number, best[start])
        at = 0
        while at < len(tokens):
            if at in best:
                yield at, best[at]
            if prefix:
                return
            at += self.lengths[best[at]] if at in best else 1


def fits(aliases: DataFrame) -> bool:
    n, size, tokens = aliases.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("alias")), F.lit(0)), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    return size + NODE_BYTES * (n + tokens) <= MOST_BYTES


def _aliases(aliases: DataFrame, split) -> DataFrame:
    """alias, target, tokens; one row each."""
    return aliases.select("alias", "target").distinct().withColumn("tokens", split(F.col("alias"))).filter(F.size("tokens") > 0)


def blanks(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def matches(texts: DataFrame, aliases: DataFrame, key: str, tokens: str, split=blanks, join: bool | None = None) -> DataFrame:
    """All matches: key, start (the token's place from 0), alias, target. aliases: alias, target. join: which of both ways; None: by size."""
    known = _aliases(aliases, split)
    if join or (join is None and not fits(known)):
        runs = sorted(r[0] for r in known.select(F.size("tokens")).distinct().collect()) or [1]
        own = texts.select(key, F.col(tokens).alias("__t"))
        cut = lambda n: F.transform(F.sequence(F.lit(0), F.size("__t") - n), lambda i: F.struct(i.cast("int").alias("start"), F.array_join(F.slice("__t", i + 1, n), " ").alias("run")))
        lists = [F.when(F.size("__t") >= n, cut(n)).otherwise(F.array().cast("array<struct<start:int,run:string>>")) for n in runs]
        grams = own.select(key, F.explode(F.flatten(F.array(*lists))).alias("g")).select(key, "g.start", "g.run")
        # Spark takes the runs for as small as the texts' files and would broadcast them, through the driver
        named = known.select(F.array_join("tokens", " ").alias("run"), "alias", "target").hint("merge")
        return grams.join(named, "run").select(key, "start", "alias", "target")
    return _found(texts, known, key, tokens, "all")


def longest(texts: DataFrame, aliases: DataFrame, key: str, tokens: str, split=blanks, prefix: bool = False, join: bool | None = None) -> DataFrame:
    """Matches from left to right, at each place the longest (of equal ones the least target); those that start inside another are left out. prefix: the longest match at the start only."""
    known = _aliases(aliases, split)
    one = known.groupBy(F.array_join("tokens", " ").alias("run")).agg(F.min(F.struct("target", "alias", "tokens")).alias("r")).select("r.*")
    if not (join or (join is None and not fits(one))):
        return _found(texts, one, key, tokens, "prefix" if prefix else "longest")
    found = matches(texts, one.select("alias", "target"), key, tokens, split, True).join(one.select("alias", "target", F.size("tokens").alias("n")), ["alias", "target"])
    best = found.groupBy(key, "start").agg(F.max(F.struct("n", "alias", "target")).alias("m"))
    if prefix:
        return best.filter("start = 0").select(key, "start", "m.alias", "m.target")
    # a text's matches are no more than its tokens; they are walked from left to right
    ordered = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "m.n", "m.alias", "m.target"))).alias("all"))
    step = lambda acc, m: F.when(m["start"] >= acc["free"], F.struct((m["start"] + m["n"]).alias("free"), F.array_append(acc["kept"], m).alias("kept"))).otherwise(acc)
    none = F.struct(F.lit(0).alias("free"), F.filter("all", lambda m: F.lit(False)).alias("kept"))
    return ordered.select(key, F.explode(F.aggregate("all", none, step, lambda acc: acc["kept"])).alias("m")).select(key, "m.start", "m.alias", "m.target")


def _found(texts: DataFrame, known: DataFrame, key: str, tokens: str, how: str) -> DataFrame:
    rows = known.orderBy("target", "alias").collect()  # a size that `fits` has summed
    shared = texts.sparkSession.sparkContext.broadcast((TokenTrie([tuple(r["tokens"]) for r in rows]), [(r["alias"], r["target"]) for r in rows]))

    @F.pandas_udf("array<struct<start:int,alias:string,target:string>>")
    def find(lists: pd.Series) -> pd.Series:
        trie, named = shared.value
        search = {"all": trie.all, "longest": trie.longest, "prefix": lambda t: trie.longest(t, True)}[how]
        return pd.Series([[(s, *named[n]) for s, n in search(list(t))] if t is not None else [] for t in lists])

    return texts.select(key, F.explode(find(F.col(tokens))).alias("m")).select(key, "m.start", "m.alias", "m.target")


def tags(found: DataFrame, key: str) -> DataFrame:
    """Of all matches: key, target, evidence (the distinct aliases that name it, in order) and times."""
    return found.groupBy(key, "target").agg(F.array_sort(F.collect_set("alias")).alias("evidence"), F.count("*").alias("times"))


def rewritten(texts: DataFrame, found: DataFrame, key: str, tokens: str, lengths) -> DataFrame:
    """texts with `rewritten`: the longest matches replaced by their targets, other tokens as they are. lengths: from an alias to its number of tokens, as a column."""
    marks = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("start", F.struct("target", lengths(F.col("alias")).alias("n"))))).alias("__m"))
    rows = texts.join(marks, key, "left")
    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, i: Column) -> Column:
        m = F.try_element_at("__m", i)
        word = F.coalesce(m["target"], F.get(tokens, i))
        return F.when(i < acc["free"], acc).otherwise(F.struct((i + F.coalesce(m["n"], F.lit(1))).cast("int").alias("free"), F.array_append(acc["out"], word).alias("out")))

    none = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("out"))
    return rows.withColumn("rewritten", F.array_join(F.aggregate(places, none, step, lambda acc: acc["out"]), " ")).drop("__m")
