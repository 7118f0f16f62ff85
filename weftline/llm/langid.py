"""Language ID: known words by their log frequency in each language, else ever shorter n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import checkpointed, read_table, sized

UNKNOWN = "und"
#: Lengths of the n-grams that stand in for unseen words, longest first.
ORDERS = (5, 4, 3, 2, 1)
_WORD = re.compile(r"[^\W\d_]+")
#: Odd factors of a gram's characters by place, and one added by order; from XXH64, the same everywhere.
_FACTORS = np.array([xxhash.xxh64_intdigest(b"gram %d" % i) | 1 for i in range(max(ORDERS))], np.uint64)
_ORDER_KEYS = {n: np.uint64(xxhash.xxh64_intdigest(b"order %d" % n)) for n in ORDERS}
#: Characters whose words are looked up together.
_CHUNK = 1 << 20


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _word_keys(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode(errors="replace")) for w in words), np.uint64, len(words))


def _gram_keys(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, word) of each n-gram of the words between blanks; of one character, their letters only.

    All words stand in one array of code points with a blank between two; a gram is a window of it
    with no blank but at its ends.
    """
    text = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    blank = text == 32
    n = len(text) - order + 1
    if not words or n <= 0:
        return np.array([], np.uint64), np.array([], np.int64)
    keys = np.full(n, _ORDER_KEYS[order])
    whole = ~blank[:n] if order == 1 else np.ones(n, bool)
    with np.errstate(over="ignore"):
        for i in range(order):
            keys += text[i : i + n] * _FACTORS[i]
            if 0 < i < order - 1:
                whole &= ~blank[i : i + n]
    owner = np.cumsum(blank)[:n] - 1
    if order > 1:
        whole[-1:] &= ~blank[n - 1 : n] | (order > 2) | (n > 1)  # the last blank begins no word
        whole &= owner < len(words)
    return keys[whole], owner[whole]


def _own_key(gram: str) -> np.uint64:
    with np.errstate(over="ignore"):
        return _ORDER_KEYS[len(gram)] + (np.array([ord(c) for c in gram], np.uint64) * _FACTORS[: len(gram)]).sum(dtype=np.uint64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words by language, summed up over a few hundred rows."""
    for whole in batches:
        for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in Counter(_words(text or "")).items():
                    found[lang, word] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of words with their counts as order 0, and of their n-grams, each as often as its word."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in dict.fromkeys(langs):
            own = batch.filter(pa.array([x == lang for x in langs], pa.bool_()))
            words, counts = own.column(1).to_pylist(), own.column(2).to_numpy()
            for order in (0, *ORDERS):
                keys, owner = _gram_keys(words, order) if order else (_word_keys(words), np.arange(len(words)))
                keys, at = np.unique(keys, return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, at, counts[owner])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), order, np.int32)), pa.array(keys.view(np.int64)), pa.array(sums)], ["lang", "order", "key", "n"])


class Backoff:
    """A fitted model: log frequencies by language of each known word and n-gram, by 64-bit key.

    Only counts that are there are held, sorted by key; a language without a count has its
    smoothed least. So the model grows with the sample and not with its languages times its words.
    """

    def __init__(self, langs: list[str], counts: list[tuple[str, int, str, int]] = (), smoothing: float = 0.5, memory: int = 200_000):
        """``counts``: (lang, order, gram, n), of which order 0 are words."""
        self.langs, self.smoothing, self.memory = langs, smoothing, memory
        keys = [_word_keys([gram])[0] if order == 0 else _own_key(gram) for _, order, gram, _ in counts]
        self._learn(np.array([langs.index(c[0]) for c in counts], np.int64), np.array([c[1] for c in counts], np.int64), np.array(keys, np.uint64), np.array([c[3] for c in counts], np.int64))

    @classmethod
    def of_columns(cls, langs: list[str], lang: np.ndarray, order: np.ndarray, key: np.ndarray, n: np.ndarray, **options) -> Backoff:
        """From columns: the language's place, the order, the key and the count."""
        model = cls(langs, **options)
        model._learn(lang, order, key, n)
        return model

    def _learn(self, lang: np.ndarray, order: np.ndarray, key: np.ndarray, n: np.ndarray) -> None:
        smoothing, langs = self.smoothing, self.langs
        self.tables = {}
        for o in (0, *ORDERS):
            own = np.flatnonzero(order == o)
            own = own[np.lexsort((lang[own], key[own]))]
            keys, first = np.unique(key[own], return_index=True)
            totals = np.bincount(lang[own], n[own], len(langs)) + smoothing * len(keys)
            gains = np.log1p(n[own] / smoothing)
            self.tables[o] = keys, np.append(first, len(own)), lang[own].astype(np.int32), gains, np.log(smoothing) - np.log(np.maximum(totals, smoothing))
        self._forget()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("seen", "found")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.found = np.zeros((1024, len(self.langs)))

    def _means(self, order: int, keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For ``n`` words: how many of their keys are known, and the mean log frequencies of these."""
        known, first, lang, gains, least = self.tables[order]
        at = np.searchsorted(known, keys)
        hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == keys) if len(known) else np.array([], np.int64)
        at, owner = at[hit], owner[hit]
        count = np.bincount(owner, minlength=n)
        sizes = first[at + 1] - first[at]
        flat = np.repeat(first[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        width = len(self.langs)
        sums = np.bincount(np.repeat(owner, sizes) * width + lang[flat], gains[flat], n * width).reshape(n, width)
        return count, least + sums / np.maximum(count, 1)[:, None]

    def word_means(self, words: list[str]) -> np.ndarray:
        """A row for each word: its own log frequencies, or the mean of its longest known n-grams; zeros if none is known."""
        out = np.zeros((len(words), len(self.langs)))
        left = np.arange(len(words))
        for order in (0, *ORDERS):
            if not len(left):
                break
            own = [words[i] for i in left]
            keys, owner = _gram_keys(own, order) if order else (_word_keys(own), np.arange(len(own)))
            count, means = self._means(order, keys, owner, len(own))
            out[left[count > 0]] = means[count > 0]
            left = left[count == 0]
        return out

    def _rows(self, words: list[str]) -> np.ndarray:
        """Where the words' means stand. What is full is emptied between calls, never within one."""
        if len(self.seen) > self.memory:
            self._forget()
        if new := list(set(words).difference(self.seen)):
            at = len(self.seen)
            if at + len(new) > len(self.found):
                larger = np.zeros((max(2 * len(self.found), at + len(new)), len(self.langs)))
                larger[:at] = self.found[:at]
                self.found = larger
            for i in range(0, len(new), 1 << 16):
                part = new[i : i + (1 << 16)]
                self.found[at + i : at + i + len(part)] = self.word_means(part)
            self.seen.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """For each text the likeliest language, and its share if all are as likely before as after a mean word."""
        out: list[tuple[str, float]] = []
        own: list[list[str]] = []

        def settle() -> None:
            flat = [word for words in own for word in words]
            rows = self._rows(flat) if flat and self.langs else np.array([], np.int64)
            at = 0
            for words in own:
                if not self.langs or not any(c.isalpha() for word in words for c in word):
                    out.append((UNKNOWN, 0.0))
                else:
                    mean = self.found[rows[at : at + len(words)]].mean(axis=0)
                    share = np.exp(mean - mean.max())
                    best = int(np.argmax(share))
                    out.append((self.langs[best], float(share[best] / share.sum())))
                at += len(words)
            own.clear()

        held = 0
        for text in texts:
            own.append(_words(text or ""))
            held += len(text or "")
            if held >= _CHUNK:
                settle()
                held = 0
        settle()
        return out


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_lang: int = 2000) -> Backoff:
    """A model of ``labelled``, fitted on about ``per_lang`` rows of each language, drawn by id.

    ``per_lang`` rows (in expectation; all rows of a language with fewer) is the classifier's one
    bound: their texts count whole, and every word and n-gram of them is learned. The counts are
    as many as the sample's different words and n-grams by language; they come to the driver as
    columns. Rows with a null language are left out, null and repeated ids are drawn like others;
    no rows give a model that knows no language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("draw"), id_col).alias("draw"))
    shares = rows.groupBy("lang").agg(F.least(F.lit(1.0), per_lang / F.count(F.lit(1))).alias("share"))
    drawn = rows.join(sized(checkpointed(shares), 10_000), "lang").where((F.col("draw") / 2.0**64 + 0.5) <= F.col("share")).select("lang", "text")
    words = drawn.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = words.mapInArrow(_count_grams, "lang string, order int, key long, n long").groupBy("lang", "order", "key").agg(F.sum("n").alias("n"))
    counts = counts.toArrow()
    names = counts["lang"].combine_chunks().dictionary_encode() if counts.num_rows else pa.array([], pa.string()).dictionary_encode()
    found = names.dictionary.to_pylist()
    langs = sorted(found)
    place = np.array([langs.index(x) for x in found], np.int64)
    return Backoff.of_columns(langs, place[names.indices.to_numpy()], counts["order"].to_numpy(), counts["key"].to_numpy().view(np.uint64), counts["n"].to_numpy())


def identify(documents: DataFrame, model: Backoff, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, lang_pred, score)``, a row per document.

    A null text, one without a letter, and any text if the model knows no language is ``und`` with
    score 0. Texts are read whole, each row alone; null and repeated ids are passed on; extra
    columns are left out; an empty table gives an empty result. Of equally likely languages the
    first by name is taken. The model, whose size its sample bounds, is broadcast.
    """
    plain = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                found = shared.value.predict_all(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("id", plain.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(predict, schema).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from the fit, by the CRC-32 of its id as text; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` by a model of those not held out; see ``fit`` and ``identify`` for odd rows."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(documents.where(F.col("doc_id").isNotNull() & ~held_out()))
    return identify(documents, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
SQL: dict = {}
