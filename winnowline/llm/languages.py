"""Language identification by multilingual mixture inference.

Letters are lowered, everything else is a break; character n-grams of one to three letters are hashed
into bins. Training sums the bins of each language over all training documents. A document is a mixture:
expectation-maximisation finds the shares of the languages from its n-gram likelihoods, and languages
are added to the set while a further one raises the likelihood by more than its penalty. The prediction
is the language with the largest share.

The model is a row of bins for each language. Languages are few by nature; more than ``max_languages``
distinct names in the column are an error, for then it holds something else.

Edge cases: a text that is null or has no letter is ``und`` with score 0; documents with null language
don't train, nor do those whose training condition is null (as that of a null id); an id that repeats
trains once for each row; with no training rows all texts are ``und``; ties go to the first language by
code point; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowline.llm.kernel import U64, mix

#: So many bins that scripts with thousands of letters still part; a language's row of the model has 1 MB.
BITS = 18


@functools.cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for what isn't a letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngram_bins(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, bounds by text, letters by text); n-grams don't cross breaks, and a break counts as a letter at word ends."""
    table = letters()
    joined = "\0\0".join(t or "" for t in texts) + "\0\0"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = table[code]
    bounds = np.concatenate(([0], np.cumsum([len(t or "") + 2 for t in texts])))
    x = low.astype(U64)
    prev, before = np.concatenate(([U64(0)], x[:-1])), np.concatenate(([U64(0), U64(0)], x[:-2]))
    # In breaks only the first place counts: it holds the n-gram that ends a word.
    live = (x > 0) | (prev > 0)
    one = mix(x * U64(2) + U64(1))
    two = mix((x * U64(0x1FFFFF) + prev) * U64(4) + U64(2))
    three = mix(((x * U64(0x1FFFFF) + prev) * U64(0x1FFFFF) + before) * U64(8) + U64(4))
    bins = (np.stack([one, two, three], 1) >> U64(64 - BITS)).astype(np.int32)[live]
    count = np.concatenate(([0], np.cumsum(live)))
    n_letters = np.concatenate(([0], np.cumsum(low > 0)))
    return bins.reshape(-1), count[bounds] * 3, np.diff(n_letters[bounds])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", max_languages: int = 200) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by language and bin). The bins of all documents are summed in Spark.

    What reaches the driver is one row of bins a language.
    """
    names = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang")).distinct().limit(max_languages + 1).collect()
    if len(names) > max_languages:
        raise ValueError(f"column {lang} has more than {max_languages} languages")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                bins, bounds, _ = ngram_bins(texts[at : at + 256])
                for k, name in enumerate(names[at : at + 256]):
                    if name not in sums:
                        sums[name] = np.zeros(1 << BITS, np.int64)
                    own = bins[bounds[k] : bounds[k + 1]]
                    u, c = np.unique(own, return_counts=True)
                    sums[name][u] += c
        for name, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], names=["lang", "bin", "n"])

    d = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counted = d.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))

    def pack(block: pa.Table) -> pa.Table:
        dense = np.zeros(1 << BITS)
        dense[block.column("bin").to_numpy()] = block.column("n").to_numpy()
        return pa.table([block.column("lang").slice(0, 1), pa.array([dense.tobytes()], pa.binary())], names=["lang", "counts"])

    rows = sorted(counted.groupBy("lang").applyInArrow(pack, "lang string, counts binary").collect())
    table = np.full((len(rows), 1 << BITS), 0.5)
    for k, r in enumerate(rows):
        table[k] += np.frombuffer(r["counts"])
    return [r["lang"] for r in rows], np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def _fit(p: np.ndarray, counts: np.ndarray, s: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Shares after EM from ``s``, and the log likelihood."""
    for _ in range(rounds):
        r = s[:, None] * p
        s = ((r / r.sum(0)) @ counts) / counts.sum()
    return s, float(np.log(s @ p) @ counts)


def mixture_shares(logs: np.ndarray, counts: np.ndarray, penalty: float, rounds: int = 20, tries: int = 4) -> np.ndarray:
    """Language shares of one document: the set grows, and then shrinks, while the penalised likelihood rises."""
    each = penalty * np.log(counts.sum() + 1)
    chosen = [int(np.argmax(logs @ counts))]
    probs = np.exp(logs - logs.max(0))
    shares, best = _fit(probs[chosen], counts, np.ones(1), 0)
    while len(chosen) < len(logs):
        # Candidates are those that explain most of what the present set explains worst.
        now = shares @ probs[chosen]
        gain = np.log1p(0.05 * (probs / now - 1)) @ counts
        gain[chosen] = -np.inf
        order = [int(k) for k in np.argsort(-gain)[:tries] if gain[k] > 0]
        trials = [(*_fit(probs[[*chosen, k]], counts, np.append(shares * 0.9, 0.1), rounds), k) for k in order]
        if not trials or max(t[1] for t in trials) - best <= each:
            break
        shares, best, new = max(trials, key=lambda t: t[1])
        chosen.append(new)
    while len(chosen) > 2:
        rest = [[c for c in chosen if c != k] for k in chosen]
        trials = [(*_fit(probs[r], counts, np.full(len(r), 1 / len(r)), rounds), r) for r in rest]
        s, value, r = max(trials, key=lambda t: t[1])
        if best - value > each:
            break
        shares, best, chosen = s, value, r
    out = np.zeros(len(logs))
    out[chosen] = shares
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text", penalty: float = 3.0) -> DataFrame:
    """key, lang_pred, score (the share of that language) and langs (the set found, with shares) for every row."""
    names, logs = model
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = d.dtypes[0][1]
    shared = docs.sparkSession.sparkContext.broadcast(logs)  # languages x 2^18 floats

    def run(batches):
        table = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            pred, score, sets = [], [], []
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                bins, bounds, n_letters = ngram_bins(part)
                for k in range(len(part)):
                    if not names or not n_letters[k]:
                        pred.append("und"), score.append(0.0), sets.append({})
                        continue
                    u, c = np.unique(bins[bounds[k] : bounds[k + 1]], return_counts=True)
                    s = mixture_shares(table[:, u].astype(float), c.astype(float), penalty)
                    top = int(np.argmax(s))
                    pred.append(names[top]), score.append(float(min(1.0, s[top]))), sets.append({names[j]: float(s[j]) for j in np.flatnonzero(s)})
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array([list(x.items()) for x in sets], pa.map_(pa.string(), pa.float64()))], names=["key", "lang_pred", "score", "langs"])

    return d.mapInArrow(run, f"key {kind}, lang_pred string, score double, langs map<string,double>").withColumnRenamed("key", key)


def detect_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", trains: Column | None = None, penalty: float = 3.0) -> DataFrame:
    """Train on the rows under ``trains`` and identify every row."""
    learned = train(docs if trains is None else docs.where(trains), text, lang)
    return identify(docs, learned, key, text, penalty)
