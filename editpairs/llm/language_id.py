"""Language identification by interpolated Kneser-Ney character models (operator 1).

Counting: each task counts the character 4-grams of its texts by language, and one aggregation adds the
counts up, over labelled rows of the training folds: all of them, or of a language with more than LEARN_CHARS
characters a sample by hash of about so many, which bounds the model whatever the corpus. Estimation: DataFrame operations give every
4-gram, 3-gram, 2-gram and character its interpolated probability; the lower orders use continuation
counts, and each order its own discount n1 / (n1 + 2 n2). Scoring: the model is a few arrays, sorted by a
64-bit hash of the gram, with a column of log probabilities a language; the language with the least
cross-entropy a character wins. Rejection: each language's and length's limit lies between what training
texts of that language have, all but ALLOWED of them, and what the model gives the training texts of other
languages that would be taken for it if their own language had not been learned. That is known without
another training, as each language has a model of its own: it is the least of the others' cross-entropies.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editpairs.llm.common import blocks_of, code_points, letter_table, mix64, written

ORDER = 4
BITS = 16
SPACE = 32
#: Labelled characters of a language that the models learn from, about. So many make a few hundred thousand grams of a
#: language; measured accuracy is in the tests. Everything else (scores, limits) covers all rows.
LEARN_CHARS = 1 << 25
#: Cross-entropy counts for the score as if over so many characters at most.
SCORE_CHARS = 64
#: Training texts of a language and length that its limit may refuse; of other languages' texts those whose
#: cross-entropy under this model is among the lowest FOREIGN don't count for the limit. A limit is APART nats a
#: character above the language's own texts at most.
ALLOWED, FOREIGN, APART = 0.001, 0.02, 0.5
#: Fewer training texts of a language and length than this: the loosest of the language's other thresholds holds,
#: that of its texts of all lengths among them.
LEAST_TEXTS = 50


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(4-grams as 64-bit numbers of four 16-bit symbols, number of each one's text, letters of each text).

    Letters are lower-cased, each run of other characters is one space, and three zeros stand before a
    text. Code points above 16 bits share the symbol FFFD.
    """
    codes = code_points(texts, ORDER - 1)
    letter = letter_table()[codes]
    symbol = np.where(letter, np.minimum(codes, 0x10000), SPACE).astype(np.uint64)
    symbol[symbol == 0x10000] = 0xFFFD
    symbol[codes == 0] = 0
    space = symbol == SPACE
    twice = space[1:] & space[:-1]
    keep = np.concatenate(([True], ~twice))
    symbol, letter = symbol[keep], letter[keep]
    owner = np.cumsum(symbol == 0) // (ORDER - 1) - 1
    gram = symbol.copy()
    for back in range(1, ORDER):
        gram[back:] |= symbol[:-back] << np.uint64(BITS * back)
    ends = symbol != 0
    return gram[ends], owner[ends], np.bincount(owner[letter], minlength=len(texts))


def count_grams(labelled: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of labelled (lang, text)."""

    def count(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            keys = np.concatenate([k for k, _ in parts])
            order = np.argsort(keys)
            keys, n = keys[order], np.concatenate([n for _, n in parts])[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            return keys[first], np.add.reduceat(n, first)

        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for a, b in blocks_of(texts):
                    key = np.sort(grams(texts[a:b])[0])
                    if not len(key):
                        continue
                    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                    held.setdefault(lang, []).append((key[first], np.diff(np.append(first, len(key)))))
                    if len(held[lang]) >= 16:
                        held[lang] = [merged(held[lang])]
        for lang, parts in held.items():
            keys, n = merged(parts)
            for a in range(0, len(keys), 50_000):
                part = slice(a, a + 50_000)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys[part])), "gram": keys[part].view(np.int64), "n": n[part].astype(np.int64)})

    counted = labelled.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def estimated(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(order, lang, key, n, value: log probability) and (order, lang, key of the context, n, value: log of its weight for the lower order)."""
    level, levels = counts, {}
    for k in range(ORDER, 0, -1):
        levels[k] = level
        level = level.groupBy("lang", F.col("gram").bitwiseAND((1 << BITS * (k - 1)) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    found, backs = [], []
    lower = None
    symbols = levels[1].select("gram").distinct().agg((F.count(F.lit(1)) + 1).alias("symbols"))  # one row
    for k in range(1, ORDER + 1):
        d = levels[k].groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
        d = d.select("lang", F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5).alias("d"))
        w = W.partitionBy("lang", "context")  # at most one row a symbol
        x = levels[k].join(F.broadcast(d), "lang").withColumn("context", F.shiftrightunsigned("gram", BITS) if k > 1 else F.lit(0).cast("long"))
        x = x.withColumn("total", F.sum("n").over(w)).withColumn("back", F.col("d") * F.count(F.lit(1)).over(w) / F.col("total"))
        if k == 1:
            x = x.join(F.broadcast(symbols)).withColumn("p_lower", 1 / F.col("symbols"))
        else:
            x = x.withColumn("suffix", F.col("gram").bitwiseAND((1 << BITS * (k - 1)) - 1)).join(lower, ["lang", "suffix"])
        x = x.withColumn("p", (F.col("n") - F.col("d")) / F.col("total") + F.col("back") * F.col("p_lower"))
        x = written(x.select("lang", "gram", "n", "context", "total", "back", "p"), f"language-model-{k}")
        found.append(x.select(F.lit(k).alias("order"), "lang", F.col("gram").alias("key"), "n", F.log("p").alias("value")))
        backs.append(x.groupBy("lang", "context").agg(F.max("total").alias("n"), F.log(F.max("back")).alias("value")).select(F.lit(k).alias("order"), "lang", F.col("context").alias("key"), "n", "value"))
        lower = x.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("p_lower"))
    union = lambda parts: functools.reduce(DataFrame.union, parts)
    return union(found), union(backs)


class HashArray:
    """Keys sorted by a 64-bit hash, with a row of values each and an index of the hash's first bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashed = mix64(keys)
        order = np.argsort(hashed)
        self.hashed, self.values = np.append(hashed[order], np.uint64(2**64 - 1)), np.concatenate((values[order], np.zeros((1, values.shape[1]), np.float32)))
        self.shift = np.uint64(64 - max(1, len(keys).bit_length() + 1))
        self.first = np.searchsorted(self.hashed[:-1], np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each key, is it there)"""
        hashed = mix64(keys)
        at = self.first[hashed >> self.shift]
        behind = np.flatnonzero(self.hashed[at] < hashed)
        while len(behind):
            at[behind] += 1
            behind = behind[self.hashed[at[behind]] < hashed[behind]]
        return at, self.hashed[at] == hashed


class Model:
    """Log probabilities of grams, by language; arrays only, so that it can be broadcast."""

    def __init__(self, found, backs, langs: list[str]):
        """found, backs: Arrow tables of estimated()."""
        self.langs, self.found, self.backs = langs, {}, {}
        number = {x: i for i, x in enumerate(langs)}
        symbols = max(1, len(set(found.filter(pa.compute.equal(found["order"], 1))["key"].to_pylist()))) + 1
        self.floor = np.full((1, len(langs)), -np.log(symbols), dtype=np.float32)
        for k in range(1, ORDER + 1):
            for table, into, empty in ((backs, self.backs, 0.0), (found, self.found, np.nan)):
                rows = table.filter(pa.compute.equal(table["order"], k))
                keys = rows["key"].to_numpy().view(np.uint64)
                unique, at = np.unique(keys, return_inverse=True)
                values = np.full((len(unique), len(langs)), empty, dtype=np.float32)
                values[at, [number[x] for x in rows["lang"].to_pylist()]] = rows["value"].to_numpy()
                if np.isnan(empty) and len(unique):
                    values = np.where(np.isnan(values), self._lower(unique, k), values)
                into[k] = HashArray(unique, values)

    def _lower(self, keys: np.ndarray, k: int) -> np.ndarray:
        at, there = self.backs[k].find(keys >> np.uint64(BITS) if k > 1 else np.zeros_like(keys))
        weight = np.where(there[:, None], self.backs[k].values[at], np.float32(0))
        return weight + self.log_probability(keys & np.uint64((1 << BITS * (k - 1)) - 1), k - 1)

    def log_probability(self, keys: np.ndarray, k: int = ORDER) -> np.ndarray:
        """A row for each gram, a column for each language."""
        if k == 0:
            return np.repeat(self.floor, len(keys), axis=0)
        at, there = self.found[k].find(keys)
        out = self.found[k].values[at]
        if len(absent := np.flatnonzero(~there)):
            out[absent] = self._lower(keys[absent], k)
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats a character by text and language, characters of each text, letters of each text)"""
        key, owner, letters = grams(texts)
        n = np.bincount(owner, minlength=len(texts))
        values = self.log_probability(key)
        total = np.stack([np.bincount(owner, weights=values[:, i], minlength=len(texts)) for i in range(len(self.langs))], axis=1)
        return -total / np.maximum(n, 1)[:, None], n, letters


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def sample(labelled: DataFrame) -> DataFrame:
    """lang, text of labelled (lang, text), or of each language a sample by hash of about LEARN_CHARS characters."""
    sums = labelled.groupBy("lang").agg(F.sum(F.length("text").cast("long")).alias("n")).filter(F.col("n") > LEARN_CHARS).collect()  # a row a language
    part = {r["lang"]: LEARN_CHARS / r["n"] for r in sums}
    if not part:
        return labelled.select("lang", "text")
    share = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in part.items() for x in pair)), F.col("lang")), F.lit(1.0))
    return labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")


def train(docs: DataFrame) -> Model | None:
    """A model of docs' labelled rows with a text (lang, text); None if there are none."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = written(count_grams(sample(labelled)), "gram-counts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    found, backs = estimated(counts)
    return Model(found.toArrow(), backs.toArrow(), langs)


SCORES = "lang_pred string, score double, cross_entropy double, n_symbols long, next_lang string, next_entropy double"
NAMES = [c.split()[0] for c in SCORES.split(", ")]


def scored(rows: DataFrame, model: Model | None) -> DataFrame:
    """rows (none of their columns named as in SCORES) and SCORES, from the column text, which goes, or else from doc.text; `und`, 0 and null for a text that is null or has no letter.

    next_lang, next_entropy: the least cross-entropy but one, and its language.
    """
    keep, within = [c for c in rows.columns if c != "text"], "text" not in rows.columns
    if model is None:
        empty = {"lang_pred": F.lit("und"), "score": F.lit(0.0), "cross_entropy": F.lit(None).cast("double"), "n_symbols": F.lit(0).cast("long"), "next_lang": F.lit(None).cast("string"), "next_entropy": F.lit(None).cast("double")}
        return rows.select(*keep, *(c.alias(n) for n, c in empty.items()))
    shared = rows.sparkSession.sparkContext.broadcast(model)  # at most LEARN_CHARS grams a language and order

    def score(batches):
        model = shared.value
        langs = np.array([*model.langs, "und"], dtype=object)
        for batch in batches:
            text = batch.column("doc").field("text") if within else batch.column("text")
            texts = [t or "" for t in text.to_pylist()]
            best, p, h, n, after, g = [], [], [], [], [], []
            for a, b in blocks_of(texts, 1 << 18):
                entropy, size, letters = model.cross_entropy(texts[a:b])
                lang, every = entropy.argmin(axis=1), np.arange(len(entropy))
                least = entropy[every, lang]
                odds = np.exp((least[:, None] - entropy) * np.minimum(size, SCORE_CHARS)[:, None]).sum(axis=1)
                entropy[every, lang] = np.inf
                other = entropy.argmin(axis=1)
                best.append(np.where(letters > 0, lang, len(model.langs)))
                p.append(np.where(letters > 0, 1 / odds, 0.0))
                h.append(np.where(letters > 0, least, np.nan))
                n.append(size)
                after.append(other)
                g.append(np.where((letters > 0) & np.isfinite(entropy[every, other]), entropy[every, other], np.nan))
            if not texts:
                continue
            h, g = np.concatenate(h), np.concatenate(g)
            columns = [langs[np.concatenate(best)], np.concatenate(p), pa.array(h, mask=np.isnan(h)), np.concatenate(n).astype(np.int64), pa.array(langs[np.concatenate(after)], pa.string(), mask=np.isnan(g)), pa.array(g, mask=np.isnan(g))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], names=[*keep, *NAMES])

    schema = T.StructType([*rows.select(*keep).schema, *T.StructType.fromDDL(SCORES)])
    return rows.mapInArrow(score, schema)


def limits(known: DataFrame) -> tuple[dict, dict]:
    """Limits by (language, power of two of the length) and by language; known: the rows to calibrate on, of scored().

    A limit lies halfway between the language's own texts, but ALLOWED of them, and other languages' texts, but
    FOREIGN of them, no further than APART from its own, and at its own texts' end where the two overlap. Classes of fewer than LEAST_TEXTS texts
    have none; the language's limit, for those, is the loosest of its classes' and of all its texts'.
    """
    size = F.floor(F.log2(F.greatest("n_symbols", F.lit(1)))).alias("size")
    rows = known.select(size, "lang_pred", "cross_entropy", "next_lang", "next_entropy")

    def ends(lang: str, value: str, quantile: float, *by) -> dict:
        stats = rows.filter(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang"), *by)
        stats = stats.agg(F.count(value).alias("texts"), F.percentile_approx(value, quantile, 10_000).alias("end")).collect()  # a few dozen rows a language
        return {(r["lang"], *(r[b] for b in by)): (r["texts"], r["end"]) for r in stats}

    def between(own: dict, foreign: dict) -> dict:
        out = {}
        for k, (texts, end) in own.items():
            n, begin = foreign.get(k, (0, None))
            out[k] = (texts, end + (min(max(0, begin - end) / 2, APART) if n >= LEAST_TEXTS else APART))
        return out

    every = between(ends("lang_pred", "cross_entropy", 1 - ALLOWED), ends("next_lang", "next_entropy", FOREIGN))
    sized = between(ends("lang_pred", "cross_entropy", 1 - ALLOWED, "size"), ends("next_lang", "next_entropy", FOREIGN, "size"))
    sized = {k: most for k, (texts, most) in sized.items() if texts >= LEAST_TEXTS}
    return sized, {lang: max([most, *(m for (x, _), m in sized.items() if x == lang)]) for (lang,), (_, most) in every.items()}


def with_rejection(table: DataFrame, learn: Column) -> DataFrame:
    """table (of scored(), already written) and `rejected`: no language, or a cross-entropy above its limit; learn: the rows to calibrate on."""
    sized, loose = limits(table.filter(learn & (F.col("lang_pred") != "und")))
    by_size, by_lang = (F.create_map(*(F.lit(x) for pair in m.items() for x in pair)) if m else None for m in ({f"{lang} {size}": v for (lang, size), v in sized.items()}, loose))
    find = lambda m, key: F.lit(None).cast("double") if m is None else F.try_element_at(m, key)
    size = F.floor(F.log2(F.greatest("n_symbols", F.lit(1)))).cast("string")
    limit = F.coalesce(find(by_size, F.concat_ws(" ", "lang_pred", size)), find(by_lang, F.col("lang_pred")), F.lit(float("inf")))
    return table.withColumn("rejected", (F.col("lang_pred") == "und") | F.coalesce(F.col("cross_entropy") > limit, F.lit(False)))


def identify(docs: DataFrame, keep: list[str]) -> DataFrame:
    """doc (the columns `keep` of docs), held_out, SCORES and rejected for every row of docs (doc_id, text, lang).

    Learns from rows of folds 0 and 2 with a lang; predicts from the text alone. Null and letterless texts
    are `und` and rejected; repeated rows get equal results; without labelled rows all is `und`; an empty
    table gives an empty one.
    """
    held_out = fold() == 1
    model = train(docs.filter(~held_out))
    rows = docs.select(*([] if "text" in keep else ["text"]), F.struct(*keep).alias("doc"), held_out.alias("held_out"), F.when(~held_out, F.col("lang")).alias("known"))
    table = written(scored(rows, model), "language-scores")
    # the label serves to calibrate, never to predict: a text whose prediction is right shows what its language's texts have
    return with_rejection(table, F.col("known") == F.col("lang_pred")).drop("known")


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language the models accept, with docs' columns, whatever their names."""
    return identify(docs, docs.columns).filter(~F.col("rejected")).select("doc.*")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, ["doc_id"]).select("doc.doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
