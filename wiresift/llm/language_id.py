"""Language identification by a multilingual mixture.

Training: Spark counts hashed letter n-grams per language over all labelled
rows; the smoothed log-likelihoods form one table of BUCKETS rows and a column
per language, so its size is bounded by the number of languages, never by the
corpus.  Prediction: a word's likelihood in each language is the product of
its n-grams'.  Expectation-maximisation over a document's words estimates the
languages' proportions, with one more component for letter runs that are no
known language; the set of languages is the one with the largest likelihood
less a penalty for each language in it.

A null text, or one without a letter, is `und` with score 0.  With nothing to
learn from, every text is.  Rows are judged one by one, so repeated or null ids
do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U64, mix, spans

BUCKETS = 1 << 16
#: n-grams of a word, with a mark before and after it
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: EM of a text ends when no share moves by more in STEPS rounds
TOLERANCE, STEPS = 0.002, 4
#: characters of text that are worked on at once
SLICE = 1 << 20
#: log-likelihood that one more language must bring, for each unit of log(words)
PENALTY = 1.5
#: a letter run of no known language: its n-grams are this much rarer than a uniform guess over those seen
STRANGE = 0.05

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


class Letters:
    """Words of some texts: runs of letters, lower-cased, each with a 64-bit name."""

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").lower() for t in texts]
        self.points = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        inside = np.zeros(len(self.points) + 2, np.int8)
        inside[1:-1] = _letter_table()[self.points]
        step = np.diff(inside)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.cut = np.searchsorted(self.start, np.r_[0, np.cumsum(size)])  # words of text i: cut[i]:cut[i + 1]
        self.name = spans(mix(self.points.astype(U64) + U64(1)), self.start, self.end)

    def grams(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the n-grams of words `at`, each with a mark on either side, and their place in `at`."""
        length = self.end[at] - self.start[at] + 2
        first = np.cumsum(length) - length
        owner = np.repeat(np.arange(len(at)), length)
        source = np.arange(len(owner)) + (self.start[at] - first - 1)[owner]
        marked = self.points[np.clip(source, 0, len(self.points) - 1)].astype(U64)
        edge = np.zeros(len(owner), bool)
        edge[first] = edge[first + length - 1] = True
        marked[edge] = 0
        buckets, owners = [], []
        for n in ORDERS:
            m = max(len(marked) - n + 1, 0)
            h = np.full(m, n, U64)
            for i in range(n):
                h = h * U64(0x9E3779B97F4A7C15) + marked[i : i + m]
            keep = owner[:m] == owner[n - 1 :]
            if n == 1:
                keep &= ~edge
            buckets.append((mix(h[keep]) >> U64(48)).astype(np.int64))
            owners.append(owner[:m][keep])
        return np.concatenate(buckets), np.concatenate(owners)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words: their names, one place of each, and how often each occurs."""
        names, at, n = np.unique(self.name, return_index=True, return_counts=True)
        return names, at, n


def _slices(texts: list[str | None]):
    """Runs of texts with a bounded number of characters."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n > SLICE:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the (BUCKETS, languages) table of log-likelihoods, from all rows with a label."""

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), object)
            for name in dict.fromkeys(langs):
                own = [texts[i] for i in np.flatnonzero(langs == name)]
                total = held.setdefault(name, np.zeros(BUCKETS, np.int64))
                for a, z in _slices(own):
                    found = Letters(own[a:z])
                    _, at, n = found.distinct()
                    if len(at):
                        bucket, owner = found.grams(at)
                        total += np.bincount(bucket, n[owner], BUCKETS).astype(np.int64)
        for name, total in held.items():
            at = np.flatnonzero(total)
            columns = [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counted = rows.mapInArrow(count, "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows a language at most
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS, len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    column = np.array([place[x] for x in table.column("lang").to_pylist()], np.int64)
    counts[table.column("bucket").to_numpy(), column] = table.column("n").to_numpy()
    seen = max(1, int((counts.sum(axis=1) > 0).sum()))
    smoothed = (counts + 0.1) / (counts.sum(axis=0, keepdims=True) + 0.1 * seen)
    strange = np.full((BUCKETS, 1), STRANGE / seen)
    return langs, np.log(np.hstack([smoothed, strange])).astype(np.float32)


class WordScores:
    """Likelihood of a word in each language, remembered for up to `most` words (28 bytes each and language)."""

    def __init__(self, table: np.ndarray, most: int = 1_000_000):
        self.table, self.most = table, most
        self.names, self.likes = np.zeros(0, U64), np.zeros((table.shape[1], 0), np.float32)

    def of(self, words: Letters) -> np.ndarray:
        """(languages, words): each word's likelihoods, the largest being 1."""
        names, back = np.unique(words.name, return_inverse=True)
        place = np.searchsorted(self.names, names)
        known = place < len(self.names)
        known[known] = self.names[place[known]] == names[known]
        if not known.all():
            one = np.zeros(len(names), np.int64)
            one[back] = np.arange(len(back))
            bucket, owner = words.grams(one[~known])
            n = int((~known).sum())
            score = np.stack([np.bincount(owner, column[bucket], n) for column in self.table.T]).astype(np.float32)
            like = np.exp(np.maximum(score - score.max(axis=0), -60))
            if len(self.names) + n > self.most:
                keep = names[known]
                self.names, self.likes = keep, self.likes[:, place[known]]
            merged = np.concatenate([self.names, names[~known]])
            order = np.argsort(merged, kind="stable")
            self.names, self.likes = merged[order], np.hstack([self.likes, like])[:, order]
            place = np.searchsorted(self.names, names)
        return self.likes[:, place[back]]


def _mixture(like: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (languages, texts) and log-likelihood of texts of n words each, all with a word.

    Expectation and maximisation alternate until a text's shares rest; texts that rest are left out of further rounds.
    """
    share, open_, words, own = share.copy(), np.arange(len(n)), like, n
    while len(open_):
        head, now = np.cumsum(own) - own, share[:, open_]
        for _ in range(STEPS):
            weighted = [x * np.repeat(p, own) for x, p in zip(words, now)]
            scale = 1 / (sum(weighted) + np.float32(1e-30))
            now = np.stack([np.add.reduceat(w * scale, head) for w in weighted]) / own.astype(np.float32)
        moved = np.abs(now - share[:, open_]).max(axis=0) > TOLERANCE
        share[:, open_] = now
        if not moved.all():
            words, own, open_ = words[:, np.repeat(moved, own)], own[moved], open_[moved]
    total = sum(x * np.repeat(p, n) for x, p in zip(like, share))
    return share, np.add.reduceat(np.log(total + 1e-30), np.cumsum(n) - n)


def mixtures(texts: list[str | None], scores: WordScores) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: proportions of the chosen languages (last: of no known language), how many, its words."""
    got, kinds = Letters(texts), len(scores.likes)
    words = np.diff(got.cut)
    share, size = np.zeros((len(texts), kinds), np.float32), np.zeros(len(texts), int)
    full = np.flatnonzero(words)
    if not len(full):
        return share, size, words
    like, n = scores.of(got), words[full]
    head = np.cumsum(n) - n
    fit = np.stack([np.add.reduceat(np.log(x), head) for x in like])
    top = fit.argmax(axis=0)
    best = np.zeros((kinds, len(full)), np.float32)
    best[top, np.arange(len(full))] = 1
    chosen = np.ones(len(full), int)
    value = fit.max(axis=0)
    # No set's log-likelihood is above 0, so more languages can't win where one comes within the penalty.
    cost = PENALTY * np.log(np.maximum(n, 2))
    open_ = np.flatnonzero(value < -cost)
    if len(open_) and kinds > 1:
        take = np.repeat(np.isin(np.arange(len(full)), open_), n)
        like, n = like[:, take], n[open_]
        start = np.full((kinds, len(open_)), 1 / kinds, np.float32)
        whole, _ = _mixture(like, n, start)
        order = np.argsort(-whole, axis=0, kind="stable")
        for k in range(2, kinds + 1):  # nested sets: the k languages of largest share, while they are worth it
            allowed = np.zeros_like(whole)
            np.put_along_axis(allowed, order[:k], 1, axis=0)
            begin = (whole + np.float32(1e-6)) * allowed
            found, fit = _mixture(like, n, begin / begin.sum(axis=0))
            worth = fit - (k - 1) * cost[open_]
            better = worth > value[open_]
            best[:, open_[better]] = found[:, better]
            chosen[open_[better]] = k
            value[open_[better]] = worth[better]
            # No larger set's likelihood is above that of all languages or 0; most texts can't gain any more.
            going = better & (value[open_] < -k * cost[open_])
            if not going.any():
                break
            like, n, open_ = like[:, np.repeat(going, n)], n[going], open_[going]
            whole, order = whole[:, going], order[:, going]
    share[full], size[full] = best.T, chosen
    return share, size, words


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, text: str = "text") -> DataFrame:
    """`docs` and the columns lang_pred, score (its share), unknown_share, lang_shares."""
    model = docs.sparkSession.sparkContext.broadcast((langs, table))  # BUCKETS x languages x 4 bytes
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "unknown_share", "lang_shares")]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in fields])
    out = rows.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "unknown_share": F.lit(0.0), "lang_shares": F.lit("")})
    at = rows.columns.index(text)

    names_out = out.columns

    def judge(batches):
        names, weights = model.value
        scores = WordScores(weights)
        for b in batches:
            texts = b.column(at).to_pylist()
            pred, score, strange, shares = [], [], [], []
            for a, z in _slices(texts):
                share, _, n = mixtures(texts[a:z], scores)
                for row, words in zip(share, n):
                    if not words or not names:
                        pred.append(UNKNOWN), score.append(0.0), strange.append(1.0), shares.append("")
                        continue
                    known = row[:-1]
                    top = int(known.argmax())
                    pred.append(names[top])
                    score.append(min(1.0, float(known[top])))
                    strange.append(float(row[-1]))
                    shares.append(",".join(f"{names[i]}:{known[i]:.4f}" for i in np.flatnonzero(known >= 0.001)))
            added = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(strange, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *added, pa.array(shares, pa.string())], names=names_out)

    return rows.mapInArrow(judge, out.schema)


def accepted(docs: DataFrame, most_unknown: float = 0.5) -> DataFrame:
    """Rows whose text is in some known language: neither `und` nor mostly letter runs of no language.

    Learns from the rows' own `lang`; columns are returned unchanged.
    """
    langs, table = train(docs)
    if not langs:
        return docs
    judged = predict(docs, langs, table)
    good = (F.col("lang_pred") != UNKNOWN) & (F.col("unknown_share") <= most_unknown)
    return judged.where(good).select(*[F.col(f"`{c}`") for c in docs.columns])
