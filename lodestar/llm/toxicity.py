"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel compares words by the three-letter subsequences they share, gaps included: each
weighs ``DECAY`` to the power of the stretch it spans, up to ``SPAN`` letters, so a word with
an inserted or changed letter stays close to the word itself. The machine is trained on
labelled sentences by multiple-instance learning: a sentence is a bag of words and as toxic
as its worst word, its witness. The first positive instances are all words that toxic
sentences have more of than chance allows; then, turn by turn, the witnesses of labelled
texts join as positive or negative instances. Nyström features come from landmarks among the
instances; as the machine is linear in the kernel, all landmarks fold into one weight per
subsequence. A logistic curve turns a text's worst margin into a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hash63, kept, settle, share_bound

DECAY = 0.6
#: Three letters of six bits each.
CODES = 1 << 18
SPAN = 6
#: Labelled rows that the machine is fitted on: about so many of each label, by hash of the id.
TOXIC_ROWS = 4000
OTHER_ROWS = 8000
#: Landmarks besides the telling words.
LANDMARKS = 192
#: Common words, and words hardest to tell from toxic ones, that each turn is fitted to at most.
INSTANCES = 8000
#: How many of all counted words may be taken for telling by chance.
FALSE_WORDS = 0.01
ROUNDS = 3
COST = 10.0
CACHED_WORDS = 400_000
#: Characters whose words are scored at a time, and words compared at a time.
BLOCK = 1 << 19
TOGETHER = 4000
#: Letters in a row that are compared as one word, how many of them stretches share, and letters compared at a time.
LONG = 1000
OVERLAP = 50
LETTERS = 1 << 16

_LETTERS = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<!\S)(?:\S\s){2,}\S(?!\S)")


def forms(word: str) -> list[str]:
    """What to compare of a blank-parted word: its letters, and each run of letters.

    Of more than ``LONG`` letters in a row, what is compared are stretches that overlap.
    """
    runs = _LETTERS.findall(word)
    some = runs if len(runs) < 2 else ["".join(runs), *runs]
    if len(word) <= LONG:
        return some
    step = LONG - OVERLAP
    return [w[i : i + LONG] for w in some for i in range(0, max(1, len(w) - OVERLAP), step)]


def words(text: str) -> Iterator[set[str]]:
    """The lower-cased words of a text, in blocks; letters set apart by single blanks join to a word."""
    low = text.lower()
    at = 0
    while at < len(low):
        end = at + BLOCK
        # A block ends at white space after a word of several letters, so letters set apart stay together.
        while end < len(low) and not (low[end - 1].isspace() and not low[end - 2].isspace() and not low[end - 3].isspace()):
            end += 1
        part = low[at:end]
        at = end
        spaced = {"".join(m.split()) for m in _SPACED.findall(part)}
        yield set(part.split()) | spaced


@dataclass
class Kernel:
    """Letters are numbered: 1 marks a word's ends; a letter not in ``letters`` has a number by a hash of its own.

    So scripts of more letters than there are numbers are told apart as well, if less sharply.
    """

    letters: str
    table: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        points = np.arange(0x110000, dtype=np.uint64)
        self.table = (2 + (points * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(62)).astype(np.uint8)
        for i, c in enumerate(self.letters[:61]):
            self.table[ord(c)] = i + 3

    def subsequences(self, some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, subsequence, weight) without repeats, and the norm of each word."""
        line = "\0".join(f"\1{w}\1" for w in some) + "\0"
        points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = self.table[points].astype(np.int64)
        symbols[points == 1] = 1
        word = np.cumsum(points == 0) - (points == 0)
        keys, weights = [], []
        for b in range(2, SPAN):
            whole = np.flatnonzero((word[: len(word) - b] == word[b:]) & (points[b:] != 0)) if len(word) > b else []
            for a in range(1, b) if len(whole) else ():
                code = (symbols[whole] << 12) | (symbols[whole + a] << 6) | symbols[whole + b]
                keys.append((word[whole] << 18) | code)
                weights.append(np.full(len(whole), DECAY ** (b + 1)))
        if not keys:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0), np.zeros(len(some))
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        weight = np.bincount(back, np.concatenate(weights))
        norm = np.sqrt(np.bincount(key >> 18, weight**2, minlength=len(some)))
        return key >> 18, key & 0x3FFFF, weight, norm

    def dense(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised words as columns over the subsequences that any of them has, and the row of each subsequence.

        Row 0 is empty and stands for all other subsequences.
        """
        word, code, weight, norm = self.subsequences(some)
        held = np.unique(code)
        row = np.zeros(CODES, np.int32)
        row[held] = np.arange(1, len(held) + 1)
        dense = np.zeros((len(held) + 1, len(some)))
        dense[row[code], word] = weight / np.maximum(norm, 1e-12)[word]
        return dense, row

    def vectors(self, some: list[str], dense: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Inner products of normalised words with the columns of ``dense``."""
        out = np.zeros((len(some), dense.shape[1]))
        for start in range(0, len(some), 200):
            part = some[start : start + 200]
            word, code, weight, norm = self.subsequences(part)
            rows = dense[row[code]] * weight[:, None]
            total = np.zeros((len(part), dense.shape[1]))
            if len(word):
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                total[word[first]] = np.add.reduceat(rows, first)
            out[start : start + 200] = total / np.maximum(norm, 1e-12)[:, None]
        return out


@dataclass
class Model:
    """One weight a subsequence, the bias, and the slope and offset of the logistic curve."""

    letters: str
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.kernel = model, Kernel(model.letters)
        self.cache: dict[str, float] = {}

    def learn(self, new: list[str]) -> None:
        parts = [forms(w) for w in new]
        flat = [p for ps in parts for p in ps]
        ends = np.cumsum([len(p) for p in flat]) if flat else np.zeros(0, np.int64)
        found, first = [], 0
        while first < len(flat):  # so many words at a time that their letters are bounded
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + LETTERS, "right")))
            some = flat[first:last]
            word, code, weight, norm = self.kernel.subsequences(some)
            total = np.bincount(word, weight * self.model.weights[code], minlength=len(some))
            found.append(total / np.maximum(norm, 1e-12) + self.model.bias)
            first = last
        value = np.concatenate(found) if found else np.zeros(0)
        at = 0
        for w, ps in zip(new, parts, strict=True):
            self.cache[w] = max(value[at : at + len(ps)].tolist(), default=self.model.bias)
            at += len(ps)

    def prepare(self, seen: set[str]) -> None:
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        new = [w for w in seen if w not in self.cache]
        for start in range(0, len(new), TOGETHER):
            self.learn(new[start : start + TOGETHER])

    def margin(self, text: str | None) -> float:
        """The margin of a text's worst word; the bias without words."""
        worst = self.model.bias
        for some in words(text or ""):
            self.prepare(some)
            worst = max(worst, max(map(self.cache.__getitem__, some), default=worst))
        return worst

    def witness(self, text: str | None) -> tuple[str | None, float]:
        """A text's worst word and its margin; of words that tie, the first in order."""
        best: tuple[float, str] | None = None
        for some in words(text or ""):
            self.prepare(some)
            best = min([(-self.cache[w], w) for w in some] + ([best] if best else []), default=None)
        return (None, self.model.bias) if best is None else (best[1], -best[0])

    def margins(self, texts: pd.Series) -> np.ndarray:
        """Margins of many texts; words new to the cache are compared together, some texts at a time."""
        out: list[float] = []
        held: list[str | None] = []
        size = 0
        for text in [*texts, ...]:
            if text is ... or size > BLOCK:
                sets = [[*words(t or "")] for t in held]
                self.prepare({w for parts in sets for some in parts for w in some})
                get, bias = self.cache.__getitem__, self.model.bias
                out += [max((max(map(get, some), default=bias) for some in parts), default=bias) for parts in sets]
                held, size = [], 0
            if text is not ...:
                held.append(text)
                size += len(text or "")
        return np.maximum(np.array(out), self.model.bias)


def margins(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``margin`` to every row."""
    key = f"{hash((model.bias, model.weights.tobytes()))}"

    @F.pandas_udf("double")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(kept(f"toxicity {key}", lambda: Scorer(model)).margins(texts))

    return docs.withColumn("margin", measured(F.col(text_col).cast("string")))


def _newton_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) that minimise |w|² / 2 + Σ cost · max(0, 1 - y·wx)²."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, before = np.zeros(x.shape[1]), None
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        inside = y * (x @ w) < 1
        if before is not None and (inside == before).all():
            break
        before = inside
        held, scale = x[inside], 2 * cost[inside, None]
        w = np.linalg.solve(ridge + held.T @ (held * scale), held.T @ (y[inside] * scale[:, 0]))
    return w


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with softened targets."""
    target = np.where(label > 0, (label.sum() + 1) / (label.sum() + 2), 1 / (len(label) - label.sum() + 2))
    x, w = np.stack([margin, np.ones(len(margin))], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def _sentences(sample: DataFrame) -> DataFrame:
    parted = F.split("text", r"(?<=[.!?])\s+|\n+")
    return sample.select(F.explode(parted).alias("sentence"), "toxic").distinct()


def _contexts(sample: DataFrame, wanted: list[str]) -> dict[str, int]:
    """After how many different words each wanted word stands in toxic sentences.

    Near copies of a sentence give a word many sentences, but always after the same word.
    """
    held = frozenset(wanted)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for sentence in b.column(0).to_pylist():
                line = sentence.lower().split()
                for before, word in zip(["", *line], line, strict=False):
                    found.update((f, before) for f in forms(word) if f in held)
            rows = sorted(found)
            arrays = [pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "before"])

    pairs = _sentences(sample.where("toxic = 1")).select("sentence").mapInArrow(met, "word string, before string")
    return {r.word: r["count"] for r in pairs.distinct().groupBy("word").count().collect()}


def variants(word: str) -> list[str]:
    """A word with a letter doubled or put in, at some places."""
    out = []
    for i in range(1, len(word), max(1, len(word) // 4)):
        out += [word[:i] + word[i - 1] + word[i:], word[:i] + "x" + word[i:]]
    return out


def _word_counts(sample: DataFrame) -> DataFrame:
    """``word, toxic, other``: in how many different toxic and other sentences each word stands."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[str, list[int]] = {}
            for sentence, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in {f for some in words(sentence) for word in some for f in forms(word)}:
                    held.setdefault(w, [0, 0])[1 - toxic] += 1
            arrays = [pa.array(list(held), pa.string())]
            arrays += [pa.array([n[i] for n in held.values()], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "toxic", "other"])

    counts = _sentences(sample).mapInArrow(counted, "word string, toxic long, other long")
    return counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _gain(toxic: float, other: float, rate: float) -> float:
    """Nats by which the counts are likelier under their own rate than under the common one."""
    both = toxic + other
    return sum(n * np.log(n / (both * r)) for n, r in ((toxic, rate), (other, 1 - rate)) if n)


def _telling(sample: DataFrame, counts: DataFrame) -> tuple[list[str], list[str]]:
    """Words that toxic sentences have far more of than chance allows, most telling first; common words."""
    total = counts.agg(F.sum("toxic"), F.sum("other"), F.count("*")).first()
    toxic, other = float(total[0] or 0), float(total[1] or 0)
    if not toxic or not other:
        return [], []
    rate = toxic / (toxic + other)
    both = F.col("toxic") + F.col("other")
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (other + 1))
    gain = F.col("toxic") * F.log(F.greatest("toxic", F.lit(1)) / (both * rate)) + F.col("other") * F.log(
        F.greatest("other", F.lit(1)) / (both * (1 - rate))
    )
    fit = counts.withColumn("gain", gain).withColumn("odds", odds)
    # A word without a rate of its own gains x nats with a chance of about exp(-x).
    least = float(np.log(total[2] / FALSE_WORDS))
    likely = fit.where((F.col("gain") > least) & (F.col("odds") > float(np.log(8)))).collect()
    seen = _contexts(sample, [r.word for r in likely]) if likely else {}
    gains = {r.word: _gain(min(seen.get(r.word, 0), r.toxic), r.other, rate) for r in likely}
    common = fit.where(F.col("odds") < float(np.log(2))).orderBy(F.desc("other"), "word").limit(INSTANCES)
    telling = sorted((w for w, g in gains.items() if g > least), key=lambda w: (-gains[w], w))
    return telling, [r.word for r in common.collect()]


def _witnesses(sample: DataFrame, model: Model) -> tuple[list[str], list[str]]:
    """Witnesses of labelled texts: of toxic ones alone that are taken for toxic; of others that come near it."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            found = [(*scorer.witness(text), toxic) for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            columns = zip(*found, strict=True) if found else ((), (), ())
            kinds = (pa.string(), pa.float64(), pa.int32())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "margin", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(judged, "word string, margin double, toxic int").where("word is not null")
    each = rows.groupBy("word").agg(F.max("margin").alias("margin"), F.sum("toxic").alias("n"), F.count("*").alias("of"))
    each = each.where(F.col("margin") > -1.0).collect()
    worst = lambda word: max(forms(word), key=len, default=None)
    toxic = {worst(r.word) for r in each if r.margin > 0 and r.n == r.of}
    other = {worst(r.word) for r in each if r.n == 0}
    return sorted(w for w in toxic - other if w), sorted(w for w in other if w)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled rows (``labels``: the id and ``toxic`` 0 or 1); the caller leaves held-out rows out.

    About ``TOXIC_ROWS`` toxic and ``OTHER_ROWS`` other rows are taken by hash of the id. The
    machine is first fitted to telling words of toxic sentences and changed forms of them
    against common words (at most ``INSTANCES``), then again with the witnesses of the labelled
    texts and with words of other sentences, common or rare, that it took for toxic (the worst
    ``INSTANCES``). Landmarks are all telling words and up to ``LANDMARKS`` others. Without
    telling words every score is the softened share of toxic rows. An id with several labels is
    toxic if one of them is; rows that repeat count as often; a word counts once a sentence,
    however long the text is and wherever its blocks end.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    bounds = [share_bound(n, sizes.get(label, 0)) for label, n in ((1, TOXIC_ROWS), (0, OTHER_ROWS))]
    chosen = known.where(hash63(id_col) < F.when(F.col("toxic") == 1, bounds[0]).otherwise(bounds[1]))
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # The chosen rows are bounded by the two parameters, so no text is shuffled to find them.
    sample = settle(texts.join(F.broadcast(chosen), id_col).select("text", "toxic"), "toxicity-sample")
    counts = settle(_word_counts(sample), "word-counts")
    telling, plain = _telling(sample, counts)
    if not telling or not plain:
        share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
        return Model("", np.zeros(CODES), 0.0, 0.0, float(np.log(share / (1 - share))))
    marks = telling + plain[: LANDMARKS // ROUNDS]
    tally = pd.Series(list("".join(telling + marks))).value_counts()
    letters = "".join(sorted(tally.index, key=lambda c: (-tally[c], c))[:61])
    kernel = Kernel(letters)
    changed = [v for w in telling for v in variants(w)]
    model, seen = None, []
    for _ in range(ROUNDS):
        if model is not None:
            seen, clean = _witnesses(sample, model)
            plain = [*dict.fromkeys([*plain, *clean])]
            known = {*telling, *changed, *plain}
            seen = [w for w in seen if w not in known]
            hard = margins(counts.where("toxic = 0"), model, "word").where(F.col("margin") > -1.0)
            taken = hard.orderBy(F.desc("margin"), "word").limit(INSTANCES).collect()
            plain = [*dict.fromkeys([*plain, *(f for r in taken for f in forms(r.word))])]
            marks = [*dict.fromkeys([*marks, *(r.word for r in taken[: LANDMARKS // ROUNDS])])]
        dense, row = kernel.dense(marks)
        value, vector = np.linalg.eigh(dense.T @ dense)
        root = vector / np.sqrt(np.maximum(value, 1e-3))
        x = kernel.vectors([*telling, *changed, *seen, *plain], dense, row) @ root
        sizes_of = (len(telling), len(changed), len(seen), len(plain))
        y = np.repeat([1.0, 1.0, 1.0, -1.0], sizes_of)
        w = _newton_svm(x, y, np.repeat([COST * 30, COST * 3, COST * 3, COST], sizes_of))
        model = Model(letters, (dense @ (root @ w[:-1]))[row], float(w[-1]))
    rows = margins(sample, model).select("margin", "toxic").toPandas()
    model.slope, model.offset = _logistic(rows.margin.to_numpy(), rows.toxic.to_numpy())
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1, higher is likelier toxic) and ``predicted`` (1 from 0.5 on) from whole texts.

    Null and empty texts are scored as texts without a telling word. The columns ``margin``,
    ``score`` and ``predicted`` of ``docs``, if any, are replaced.
    """
    docs = docs.drop("margin", "score", "predicted")
    logit = F.col("margin") * model.slope + model.offset
    scored = margins(docs, model, text_col).withColumn("score", 1 / (1 + F.exp(-logit))).drop("margin")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of all documents.

    Rows whose crc32 of the id as text leaves remainder 0 by 5 are held out of learning; rows
    with a null id are neither held out nor learned from. Repeated rows stay.
    """
    learned = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = train(docs.where(learned), labels.where(learned))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(~learned, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return score(rows, model).select("doc_id", "held_out", "score", "predicted")
