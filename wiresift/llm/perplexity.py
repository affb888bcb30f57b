"""Quality rules: text statistics and a modified Kneser-Ney perplexity band.

The model is made of n-grams of ORDER code points, packed into one number of 64
bits: a code point below 2 ** 16 stands for itself, others are hashed into that
range, and white-space runs are one symbol.  Spark counts the n-grams over all
texts, derives continuation counts, discounts and interpolated probabilities,
and the model is read as arrays sorted by packed n-gram.  Each language's texts
are scored by its own model; models go to the tasks in blocks of languages of
bounded size, so neither driver nor tasks hold all of them.  A null language
and an empty one are the same.  Documents outside their language's band of
log-perplexity (median plus or minus a number of robust deviations) are
rejected.  The robust deviation is the median absolute deviation scaled to the
normal one; where more than half of a language's texts score the same it is 0,
and the scaled mean absolute deviation stands in.

A null text is an empty one: no words, base rules fail, not kept.  Rows are
judged one by one, so repeated or null ids do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .kernel import LINED, SPACED, U64, buffers, grams, mix, runs, words

BITS, ORDER = 16, 4
SYMBOLS = 1 << BITS
#: n-grams of the models that are sent to the tasks at a time, at 12 bytes each; a larger language goes alone
BLOCK_GRAMS = 8_000_000
#: `[\x20\x09-\x0D]` of code points, and the zero that stands for them
_SPACES = np.array([0, 32, *range(9, 14)], np.uint32)


def packed(raw: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of texts, one ending at each symbol (before a text stand spaces), and their cuts."""
    point = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    cut = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][cut]
    symbol = np.where(point < SYMBOLS, point, mix(point.astype(U64)) & U64(SYMBOLS - 1)).astype(U64)
    symbol[np.isin(point, _SPACES)] = 0
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] != 0) | (symbol[:-1] != 0)
    keep[cut[:-1][np.diff(cut) > 0]] = True
    total = np.r_[0, np.cumsum(keep)]
    symbol, cut = symbol[keep], total[cut]
    out = symbol.copy()
    since = np.arange(len(symbol)) - np.repeat(cut[:-1], np.diff(cut))
    for i in range(1, ORDER):
        before = np.zeros_like(symbol)
        before[i:] = symbol[:-i] if len(symbol) > i else before[i:]
        before[since < i] = 0
        out |= before << U64(BITS * i)
    return out, cut


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _lang_groups(langs: list[str]) -> dict[str, np.ndarray]:
    names = np.array(langs, object)
    return {x: np.flatnonzero(names == x) for x in dict.fromkeys(langs)}


def _rows(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))


def counted(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts; each task sums its own first."""

    def count(batches):
        held: dict[str, list] = {}
        for b in batches:
            for lang, rows in _lang_groups(b.column(1).to_pylist()).items():
                raw, cut = buffers(b.column(0).take(pa.array(rows)))
                parts = held.setdefault(lang, [])
                for a, z in runs(cut):
                    ids, _ = packed(raw[cut[a] : cut[z]], cut[a : z + 1] - cut[a])
                    if len(ids):
                        parts.append(np.unique(ids, return_counts=True))
                if len(parts) > 64:
                    held[lang] = [_merged(parts)]
        for lang, parts in held.items():
            if parts:
                keys, n = _merged(parts)
                columns = [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

    found = _rows(docs).where(F.col("text").isNotNull()).select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(table: DataFrame) -> DataFrame:
    """The three discounts of each language from its counts of counts."""
    of = [F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(k: int):
        d = k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        usable = (F.col("n1") > 0) & (F.col(f"n{k}") > 0)
        return F.when(usable, F.greatest(F.lit(0.1), F.least(F.lit(k - 0.1), d))).otherwise(F.lit(0.5 * k))

    return table.groupBy("lang").agg(*of).select("lang", *[discount(k).alias(f"d{k}") for k in (1, 2, 3)])


def _last(size: int):
    """The last `size` symbols of an n-gram."""
    return F.col("gram").bitwiseAND((1 << BITS * size) - 1)


def model_tables(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Probabilities (lang, gram, p, size) and context weights (lang, context, weight, size), all orders.

    `size` is the n-gram's order, or the context's number of symbols.  Each order is written.
    """
    by_size = {ORDER: counts}
    for size in range(ORDER - 1, 0, -1):  # below the top: how many different symbols stand before
        by_size[size] = shared.written(by_size[size + 1].groupBy("lang", _last(size).alias("gram")).agg(F.count("*").alias("n")))
    lower, probabilities, weights = None, [], []
    for size in range(1, ORDER + 1):
        table = by_size[size].join(F.broadcast(_discounts(by_size[size])), "lang")  # a row a language
        n = F.col("n")
        taken = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        table = table.withColumns({"taken": taken, "context": F.shiftrightunsigned("gram", BITS)})
        context = table.groupBy("lang", "context").agg(F.sum("n").alias("all"), F.sum("taken").alias("freed"))
        context = shared.written(context.select("lang", "context", "all", (F.col("freed") / F.col("all")).alias("weight")))
        table = table.join(context, ["lang", "context"])
        own = (n - F.col("taken")) / F.col("all")
        if lower is None:
            table = table.withColumn("p", own + F.col("weight") / SYMBOLS)
        else:
            below = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            table = table.withColumn("suffix", _last(size - 1)).join(below, ["lang", "suffix"])
            table = table.withColumn("p", own + F.col("weight") * F.col("below"))
        lower = shared.written(table.select("lang", "gram", "p", F.lit(size).alias("size")))
        probabilities.append(lower)
        weights.append(context.select("lang", "context", "weight", F.lit(size - 1).alias("size")))
    union = probabilities[0], weights[0]
    for p, w in zip(probabilities[1:], weights[1:]):
        union = union[0].unionByName(p), union[1].unionByName(w)
    return union


class Model:
    """One language's model as arrays sorted by packed n-gram."""

    def __init__(self, probability: dict[int, tuple], weight: dict[int, tuple]):
        self.probability, self.weight = probability, weight

    @staticmethod
    def _find(arrays: tuple | None, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if arrays is None or not len(arrays[0]):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(arrays[0], keys), len(arrays[0]) - 1)
        return arrays[0][at] == keys, arrays[1][at]

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """Log-probability of n-grams, those that the top order doesn't hold included."""
        out = np.full(len(keys), -np.log(SYMBOLS), np.float32)
        open_, carried = np.arange(len(keys)), np.zeros(len(keys), np.float32)
        for size in range(ORDER, 0, -1):
            part = keys[open_] & U64((1 << BITS * size) - 1)
            hit, value = self._find(self.probability.get(size), part)
            out[open_[hit]] = value[hit] + carried[open_[hit]]
            known, weight = self._find(self.weight.get(size - 1), part >> U64(BITS))
            carried[open_] += np.where(known, weight, 0)
            open_ = open_[~hit]
        out[open_] += carried[open_]
        return out

    def score(self, raw: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Mean log-probability of texts; 0 for an empty one."""
        out = np.zeros(len(cut) - 1)
        for a, z in runs(cut):
            ids, at = packed(raw[cut[a] : cut[z]], cut[a : z + 1] - cut[a])
            if len(ids):
                keys, back = np.unique(ids, return_inverse=True)
                total = np.r_[0, np.cumsum(self.log_probability(keys)[back], dtype=np.float64)]
                out[a:z] = (total[at[1:]] - total[at[:-1]]) / np.maximum(np.diff(at), 1)
        return out


def load(probabilities: DataFrame, weights: DataFrame) -> dict[str, Model]:
    """The models of the tables' languages: of a block of them, as blocks() gives it."""

    def arrays(rows: DataFrame, key: str, value: str) -> dict[str, dict[int, tuple]]:
        out: dict[str, dict[int, tuple]] = {}
        table = rows.select("lang", "size", key, F.log(F.greatest(value, F.lit(1e-12))).cast("float").alias(value)).toArrow()
        for lang in pc.unique(table.column("lang")).to_pylist():
            of_lang = table.filter(pc.equal(table.column("lang"), lang))
            for size in range(ORDER + 1):
                own = of_lang.filter(pc.equal(of_lang.column("size"), size))
                keys = own.column(key).to_numpy().view(U64)
                order = np.argsort(keys)
                out.setdefault(lang, {})[size] = keys[order], own.column(value).to_numpy()[order]
        return out

    p, w = arrays(probabilities, "gram", "p"), arrays(weights, "context", "weight")
    return {x: Model(p[x], w.get(x, {})) for x in p}


def blocks(counts: DataFrame) -> list[list[str]]:
    """The languages, in blocks of about BLOCK_GRAMS n-grams; a row a language comes to the driver."""
    out, room = [], 0
    for r in sorted(counts.groupBy("lang").count().collect(), key=lambda r: (r["count"], r["lang"])):
        if r["count"] > room:
            out.append([])
            room = BLOCK_GRAMS
        out[-1].append(r["lang"])
        room -= r["count"]
    return out


def _sums(flags: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[cut[1:]] - total[cut[:-1]]


_SYMBOLIC = np.zeros(256, bool)
_SYMBOLIC[list(b"#*$%&|<>")] = True


def statistics(raw: np.ndarray, cut: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    w = words(raw, cut, SPACED, lower=False)
    out = {"n_words": np.diff(w.cut)}
    out["word_chars"] = _sums(SPACED[raw] & ((raw & 0xC0) != 0x80), cut)
    out["n_symbols"] = _sums(_SYMBOLIC[raw], cut)
    lines = words(raw, cut, LINED, lower=False)
    spaced = np.r_[0, np.cumsum(SPACED[raw])]
    wordy = spaced[lines.end] > spaced[lines.start]
    owner = lines.text_of()[wordy]
    own = mix(lines.name[wordy] + owner.astype(U64) * U64(0x9E3779B97F4A7C15))
    _, first = np.unique(own, return_index=True)
    n = len(cut) - 1
    out["n_dup_lines"] = np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n)
    h, ok = grams(w, 3)
    at = np.flatnonzero(ok)
    key = mix(h[at] + w.text_of()[at].astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    marked = np.zeros(len(w.name) + 2, bool)
    for i in range(3):
        marked[at[twice] + i] = True
    out["n_repeat_words"] = _sums(marked[: len(w.name)], w.cut)
    return out


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def scored(docs: DataFrame, models: dict[str, Model]) -> DataFrame:
    """Per row: doc_id, lang, the statistics and log_perplexity (mean nats a symbol; 0 for an empty text)."""
    shared_models = docs.sparkSession.sparkContext.broadcast(models)

    def score(batches):
        for b in batches:
            text, langs = b.column("text"), b.column("lang").to_pylist()
            raw, cut = buffers(text)
            parts = [statistics(raw[cut[a] : cut[z]], cut[a : z + 1] - cut[a]) for a, z in runs(cut)]
            base = [pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k in BASE] if parts else [pa.array([], pa.int64())] * 5
            nats = np.zeros(len(text))
            for lang, rows in _lang_groups(langs).items():
                nats[rows] = -shared_models.value.get(lang, Model({}, {})).score(*buffers(text.take(pa.array(rows))))
            names = ["doc_id", "lang", *BASE, "log_perplexity"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *base, pa.array(nats)], names=names)

    return docs.mapInArrow(score, f"doc_id long, lang string, {', '.join(f'{c} long' for c in BASE)}, log_perplexity double")


def all_scored(docs: DataFrame) -> DataFrame:
    """scored() of every row, block by block of languages."""
    counts, rows = shared.written(counted(docs)), _rows(docs)
    probabilities, weights = model_tables(counts)
    # Languages without a symbol have no model; their rows go with the first block.
    parts, known = [], blocks(counts)
    for i, block in enumerate(known or [[]]):
        own = F.col("lang").isin(block)
        rest = [x for other in known if other is not block for x in other]
        chosen = rows.where(own) if i else rows.where(~F.col("lang").isin(rest)) if rest else rows
        parts.append(scored(chosen, load(probabilities.where(own), weights.where(own))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: scores closer than this, in nats, differ by rounding only
ROUNDING = 1e-6


def judge(docs: DataFrame, deviations: float = 6.0, least_words: int = 50) -> DataFrame:
    """The rules' verdict on every row of `docs`."""
    table = shared.written(all_scored(docs))
    usable = table.where(F.col("n_words") >= least_words)
    middle = usable.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("middle"))
    off = F.abs(F.col("log_perplexity") - F.col("middle"))
    spread = usable.join(F.broadcast(middle), "lang").select("lang", "middle", off.alias("off"))  # a row a language
    band = spread.groupBy("lang").agg(
        F.first("middle").alias("middle"), F.percentile_approx("off", 0.5, 10_000).alias("median_off"), F.avg("off").alias("mean_off")
    )
    deviation = F.when(F.col("median_off") > ROUNDING, 1.4826 * F.col("median_off")).otherwise(1.2533 * F.col("mean_off"))
    width = deviations * deviation + ROUNDING
    band = band.select("lang", (F.col("middle") - width).alias("lower"), (F.col("middle") + width).alias("upper"))
    out = table.join(F.broadcast(band), "lang", "left")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(True))
    verdict = failed.alias("base_failed"), (~failed & inside).alias("kept")
    return out.select("doc_id", *BASE, *verdict, "log_perplexity", "lower", "upper")
