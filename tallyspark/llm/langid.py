"""Language identification by interpolated Kneser-Ney character models.

A model of order five per language, over lower-cased words: a word's characters, with four blanks before and one after,
so that a character is predicted from at most four before it in the same word. Estimates are interpolated Kneser-Ney: raw
counts at the highest order, counts of distinct left neighbours below, one absolute discount per order and language, from how many n-grams were seen once and twice. The models are
stored as sorted arrays of 64-bit n-gram hashes, one per order, with a column of log-probabilities (and, for contexts, of
back-off weights) per language. The language is the one of least cross-entropy per character; its score is a softmax
whose temperature is fitted on texts kept out of the counts; a text is rejected if its cross-entropy is far above what
such texts of its length have. How far is calibrated on held-out texts by language and length, between a high quantile of these and what
they have under the models of the other languages, so that single odd texts don't set it.

Training reads at most `train_chars` characters in expectation, over all languages, chosen by a hash of the identifier
with one rate per language, and at least the texts of the least hash of each: that is the documented bound of the fit. Prediction reads every whole text. A worker keeps
the sums of up to `CACHED` words; that saves time and changes no result.

Cases. A text that is null or has no letter is `und` with score 0 and isn't rejected for its entropy but as undetermined.
Ties go to the first language in code-point order; rows repeated, or without identifier, are each judged by their text. A language column of nulls only, or no training text, makes every
text `und`. Columns named lang_pred, score, cross_entropy or rejected pass by with `_in` after their names, other columns as they are; an
empty input gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import aside, crc_mod, every, short_batches, unit_hash

ORDER, TRAIN_CHARS, CALIBRATION_DOCS, REJECT_Z, CACHED = 5, 4_000_000, 2000, 3.0, 150_000
MOST_LANGUAGES = 500
#: The lengths at which rejection is calibrated, on the starts of texts; the quantiles of known and of unknown languages; the least texts of a language for limits of its own.
LENGTHS, KNOWN, UNKNOWN, LEAST_TEXTS = (20, 50, 100, 200, 400, 1000, 4000), 0.995, 0.01, 100
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(window: np.ndarray) -> np.ndarray:
    """Hash the rows of a matrix of code points."""
    h = np.full(len(window), window.shape[1], dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window.shape[1]):
            h = (h ^ window[:, k].astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
    return h


def _windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The five-character windows that end at each predicted position of the words, and the positions per word."""
    text = "".join(f"    {w} " for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = np.array([len(w) for w in words], dtype=np.int64) + 1
    starts = np.concatenate([[0], np.cumsum(n + ORDER - 1)[:-1]])
    ends = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) + ORDER - 1
    return codes[ends[:, None] + np.arange(-ORDER + 1, 1)], n


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted hash array, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def discount(counts: np.ndarray) -> float:
    """n1 / (n1 + 2 n2), where n1 and n2 n-grams were counted once and twice; a half where that says nothing."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, once / (once + 2 * twice)) if once else 0.5


class Vocabulary(dict):
    """Words to places, in order of arrival."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        return place

    def take_new(self) -> list[str]:
        new, self.new = self.new, []
        return new


@dataclass
class LanguageModels:
    """keys[n], logp[n]: hashes and log-probabilities (a column per language) of the n-grams of order n + 1; ctx_keys[n],
    backoff[n]: the same of contexts of n characters; unseen: log-probability of an unknown character."""

    langs: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    ctx_keys: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    unseen: np.ndarray | None = None
    temperature: float = 1.0
    mean: np.ndarray | None = None
    spread: tuple[float, float] = (0.05, 1.0)
    cuts: np.ndarray | None = None

    def __post_init__(self):
        self.vocab, self.table, self.chars = Vocabulary(), np.zeros((0, len(self.langs))), np.zeros(0, dtype=np.int64)

    def __getstate__(self):
        none = {"vocab": Vocabulary(), "table": np.zeros((0, len(self.langs))), "chars": np.zeros(0, dtype=np.int64)}
        return self.__dict__ | none

    @classmethod
    def fit(cls, counts: pd.DataFrame) -> LanguageModels:
        """counts: rows lang, word, n."""
        langs = sorted(counts["lang"].unique()) if len(counts) else []
        out = cls(langs)
        per = []
        for lang in langs:
            own = counts[counts["lang"] == lang]
            w, n = _windows(list(own["word"]))
            per.append((w, np.repeat(own["n"].to_numpy(dtype=np.float64), n)))
        # by order: n-gram hashes, their counts, and the hashes of context and of the shorter n-gram, per language
        for order in range(1, ORDER + 1):
            found = []
            for w, c in per:
                grams = w[:, ORDER - order :]
                if order == ORDER:
                    rows, weight = grams, c
                else:  # distinct left neighbours
                    _, first = np.unique(_hash(w[:, ORDER - order - 1 :]), return_index=True)
                    rows, weight = grams[first], np.ones(len(first))
                h, first, back = np.unique(_hash(rows), return_index=True, return_inverse=True)
                found.append((h, rows[first], np.bincount(back, weights=weight, minlength=len(h))))
            every = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
            text = np.concatenate([f[1] for f in found]) if found else np.zeros((0, order), np.uint32)
            keys, first = np.unique(every, return_index=True)
            text = text[first]
            ctx = _hash(text[:, :-1]) if order > 1 else np.zeros(len(text), np.uint64)
            ctx_keys, ctx_of = np.unique(ctx, return_inverse=True)
            p, back_off = np.zeros((len(keys), len(langs))), np.ones((len(ctx_keys), len(langs)))
            lower = out._prob(text[:, 1:], order - 1) if order > 1 else np.full((len(keys), len(langs)), 1.0 / (len(keys) + 1))
            for i, (h, _, c) in enumerate(found):
                at = np.searchsorted(keys, h)
                total = np.bincount(ctx_of[at], weights=c, minlength=len(ctx_keys))
                kinds = np.bincount(ctx_of[at], minlength=len(ctx_keys))
                seen = total > 0
                less = discount(c)
                back_off[seen, i] = less * kinds[seen] / total[seen]
                p[:, i] = back_off[ctx_of, i] * lower[:, i]
                p[at, i] += np.maximum(c - less, 0) / total[ctx_of[at]]
            out.keys.append(keys)
            out.logp.append(np.log(p).astype(np.float32))
            out.ctx_keys.append(ctx_keys)
            out.backoff.append(np.log(back_off).astype(np.float32))
            if order == 1:
                out.unseen = np.log(back_off[0] / (len(keys) + 1)).astype(np.float32) if len(keys) else np.zeros(0, np.float32)
        out.mean = np.zeros(len(langs))
        return out

    def _log(self, w: np.ndarray, order: int) -> np.ndarray:
        """Log-probability of each window's last character, per language."""
        out = np.zeros((len(w), len(self.langs)), dtype=np.float32)
        todo = np.arange(len(w))
        while order and len(todo):
            grams = w[todo][:, w.shape[1] - order :]
            at, hit = _find(self.keys[order - 1], _hash(grams))
            out[todo[hit]] += self.logp[order - 1][at[hit]]
            todo, grams = todo[~hit], grams[~hit]
            if order > 1:
                at, known = _find(self.ctx_keys[order - 1], _hash(grams[:, :-1]))
                out[todo[known]] += self.backoff[order - 1][at[known]]
            else:
                out[todo] += self.unseen
            order -= 1
        return out

    def _prob(self, w: np.ndarray, order: int) -> np.ndarray:
        return np.exp(self._log(w, order).astype(np.float64))

    def words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log-probabilities per language, and characters, of each word."""
        sums, sizes, at = [], [], 0
        while at < len(new):  # blocks of bounded size
            upto, size = at, 0
            while upto < len(new) and (size < 100_000 or upto == at):
                size += len(new[upto]) + 1
                upto += 1
            w, n = _windows(new[at:upto])
            sums.append(np.add.reduceat(self._log(w, ORDER).astype(np.float64), np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0))
            sizes.append(n)
            at = upto
        return np.concatenate(sums), np.concatenate(sizes)

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities (a row per text, a column per language) and characters of whole texts."""
        total, size, at = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=np.int64), 0
        while at < len(texts):  # blocks of texts, so that places of words are held for few texts at once
            if len(self.vocab) > CACHED:
                self.vocab, self.table, self.chars = Vocabulary(), np.zeros((0, len(self.langs))), np.zeros(0, dtype=np.int64)
            upto, room, places = at, 300_000, []
            while upto < len(texts) and (room > 0 or upto == at):
                words = texts[upto].lower().split()
                places.append(np.fromiter(map(self.vocab.__getitem__, words), dtype=np.int64, count=len(words)))
                room -= len(words)
                upto += 1
            if new := self.vocab.take_new():
                found = self.words(new)
                self.table, self.chars = np.concatenate([self.table, found[0]]), np.concatenate([self.chars, found[1]])
            for k, p in enumerate(places):
                total[at + k], size[at + k] = self.table[p].sum(axis=0), self.chars[p].sum()
            at = upto
        return total, size

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        """Fit the temperature and what cross-entropy the texts of a language have, on texts not counted."""
        total, size = self.sums(texts)
        keep = size > 0
        if not keep.any():
            return
        y, total, size = np.array([self.langs.index(x) for x in langs])[keep], total[keep], size[keep]
        best = None
        for t in np.geomspace(1, 200, 40):
            z = total / t
            z = z - z.max(axis=1, keepdims=True)
            nll = -(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1))).mean()
            if best is None or nll < best[0]:
                best = (nll, t)
        self.temperature = float(best[1])
        h = -total[np.arange(len(y)), y] / size
        for i in range(len(self.langs)):
            if (y == i).any():
                self.mean[i] = np.median(h[y == i])
        sq = (h - self.mean[y]) ** 2
        a = float(np.quantile(sq[size >= np.median(size)], 0.9))
        b = float(np.quantile(sq * size, 0.9))
        self.spread = (a, b)
        self.cuts = self._limits([t for t, k in zip(texts, keep) if k], y)

    def _far(self, total: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language of each row, and how far its cross-entropy is above that language's, in spreads of its length."""
        best = total.argmax(axis=1)
        h = -total[np.arange(len(best)), best] / np.maximum(size, 1)
        return best, (h - self.mean[best]) / np.sqrt(self.spread[0] + self.spread[1] / np.maximum(size, 1))

    def _limits(self, texts: list[str], y: np.ndarray) -> np.ndarray:
        """How far a text may be, per language (row) and length (column): a high quantile of the held-out texts or, where texts scored
        without the model of their own language are farther, half-way to these on a log scale."""
        cuts = np.full((len(self.langs), len(LENGTHS)), REJECT_Z)
        for k, n in enumerate(LENGTHS):
            at = np.array([i for i, t in enumerate(texts) if len(t) >= n or k == 0], dtype=np.int64)
            if len(at) < LEAST_TEXTS and k:
                cuts[:, k] = cuts[:, k - 1]
                continue
            total, size = self.sums([texts[i][:n] for i in at])
            some = size > 0
            at, total, size = at[some], total[some], size[some]
            if not len(at):
                continue
            best, far = self._far(total, size)
            known = np.array([np.quantile(far[best == i] if (best == i).sum() >= LEAST_TEXTS else far, KNOWN) for i in range(len(self.langs))])
            cuts[:, k] = np.maximum(REJECT_Z, known)
            if len(self.langs) > 1:
                without = total.copy()
                without[np.arange(len(at)), y[at]] = -np.inf
                unknown = max(float(np.quantile(self._far(without, size)[1], UNKNOWN)), 0.0)
                cuts[:, k] = np.maximum(cuts[:, k], np.sqrt(cuts[:, k] * unknown))
        return cuts

    def limit(self, best: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The limit of each text by its language and length, straight between the calibrated lengths on a log scale."""
        if self.cuts is None:
            return np.full(len(best), 2 * REJECT_Z)
        at, out = np.log(np.maximum(size, 1)), np.empty(len(best))
        for i in range(len(self.langs)):
            out[best == i] = np.interp(at[best == i], np.log(LENGTHS), self.cuts[i])
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        real = [i for i, t in enumerate(texts) if t is not None and self.langs and any(c.isalpha() for c in t)]
        out: list[tuple[str, float, float | None, bool]] = [("und", 0.0, None, True)] * len(texts)
        if not real:
            return out
        total, size = self.sums([texts[i] for i in real])
        best, far = self._far(total, size)
        over = far > self.limit(best, size)
        z = (total - total.max(axis=1, keepdims=True)) / self.temperature
        score = 1 / np.exp(z).sum(axis=1)
        h = -total[np.arange(len(best)), best] / np.maximum(size, 1)
        for k, i in enumerate(real):
            out[i] = (self.langs[best[k]], float(score[k]), float(h[k]), bool(over[k]))
        return out


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words as prediction cuts them, counted in each batch."""
    for b in batches:
        found = Counter((lang, w) for lang, text in zip(b["lang"], b["text"]) for w in text.lower().split())
        yield pd.DataFrame([(lang, w, n) for (lang, w), n in found.items()], columns=["lang", "word", "n"])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_chars: int = TRAIN_CHARS, calibration_docs: int = CALIBRATION_DOCS) -> LanguageModels:
    """Fit on a bounded sample of labelled: rows drawn by a hash, at one rate per language. train_chars: characters that the models are counted from; calibration_docs: further texts, of no
    more characters than that, by which scores and rejection are calibrated; both in expectation. More than MOST_LANGUAGES labels are an error, as each has a model in every task."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    u = unit_hash(F.lit("langid"), F.col("id"))
    some = F.when(F.col("text").rlike(r"\S"), u)
    found = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("docs"), F.min(some).alias("first")).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sizes = {r["lang"]: (r["chars"], r["docs"]) for r in found if r["first"] is not None}
    first = {r["lang"]: r["first"] for r in found}
    if not sizes:
        return LanguageModels([])
    each, docs = train_chars / len(sizes), calibration_docs / len(sizes)
    per = lambda values: F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("lang"))
    rate = lambda part: per({k: part(*v) for k, v in sizes.items()})
    count_rate = rate(lambda chars, n: min(0.8, each / chars))
    held_rate = rate(lambda chars, n: min(0.2, docs / n, each / chars))
    rows = rows.filter(F.col("lang").isin(list(sizes)))
    # a language of few texts is still learned
    counted = rows.filter((u < count_rate) | (u == per({k: first[k] for k in sizes}))).select("lang", "text")
    counts = counted.mapInPandas(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    model = LanguageModels.fit(counts.sort_values(["lang", "word"], kind="stable"))
    held = rows.filter(u >= 1 - held_rate).select("text", "lang").collect()
    held = [r for r in held if r["lang"] in model.langs]
    model.calibrate([r["text"] for r in held], [r["lang"] for r in held])
    return model


def identify(docs: DataFrame, model: LanguageModels, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score, cross_entropy and rejected."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            yield pd.DataFrame(own.predict([t if isinstance(t, str) else None for t in texts]), columns=["lang_pred", "score", "cross_entropy", "rejected"])

    docs, text_col = aside(docs, ["lang_pred", "score", "cross_entropy", "rejected"], text_col)
    return docs.select("*", predict(F.col(f"`{text_col}`")).alias("__lang")).select(*every(docs), "__lang.*")


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: crc32 of the identifier modulo 3 isn't 1."""
    return docs.filter(crc_mod(id_col, 3) != 1)
