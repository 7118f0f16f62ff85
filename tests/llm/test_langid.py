"""Language ID against a plain scorer over strings, and on rare languages."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftline.llm import langid
from weftline.llm.common import read_table


def grams(word, order):
    padded = word if order == 1 else f" {word} "
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


class Plain:
    """The same model with strings as keys, one word at a time."""

    def __init__(self, rows, smoothing=0.5):
        counts = defaultdict(Counter)
        for lang, text in rows:
            for word in langid._words(text or ""):
                counts[0, word][lang] += 1
                for order in langid.ORDERS:
                    for gram in grams(word, order):
                        counts[order, gram][lang] += 1
        self.langs = sorted({lang for c in counts.values() for lang in c})
        totals, entries = defaultdict(Counter), Counter()
        for (order, _), c in counts.items():
            totals[order].update(c)
            entries[order] += 1
        self.logs = {(order, gram): [math.log((c[lang] + smoothing) / (totals[order][lang] + smoothing * entries[order])) for lang in self.langs] for (order, gram), c in counts.items()}

    def word(self, word):
        for order in (0, *langid.ORDERS):
            own = [self.logs[order, g] for g in ([word] if order == 0 else grams(word, order)) if (order, g) in self.logs]
            if own:
                return np.mean(own, axis=0)
        return np.zeros(len(self.langs))

    def predict(self, text):
        words = langid._words(text or "")
        if not words or not self.langs:
            return "und", 0.0
        mean = np.mean([self.word(w) for w in words], axis=0)
        share = np.exp(mean - mean.max())
        return self.langs[int(share.argmax())], float(share.max() / share.sum())


def test_same_predictions_as_a_plain_scorer(spark, sf):
    docs = read_table(spark, sf, "documents")
    rows = docs.select("doc_id", "text", "lang", langid.held_out().alias("out")).collect()
    plain = Plain([(r.lang, r.text) for r in rows if not r.out and r.lang])
    found = {r.doc_id: r for r in langid.op8_language_id(spark, sf).collect()}
    assert len(found) == len(rows)
    for r in rows:
        lang, score = plain.predict(r.text)
        assert found[r.doc_id].held_out == r.out
        assert found[r.doc_id].score == pytest.approx(score, abs=1e-9) and (found[r.doc_id].lang_pred == lang or score < 0.5 + 1e-9)


def test_every_language_is_learned_from_words_that_occur_once(spark):
    rows = [(i, f"the cat number {'abcdefghij'[i % 10]} sat on the mat", "en") for i in range(300)] + [(300, "zdravo", "sr"), (301, "Ünï", "xx"), (302, None, "nn"), (303, "text", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "sr", "xx"] and model.predict("zdravo")[0] == "sr" and model.predict("zdravi")[0] == "sr"
    assert model.predict("ÜNÏ")[0] == "xx" and model.predict("the mat")[0] == "en"


def test_grams_of_words():
    words = ["a", "ab", "abc", "naïve", "漢字", "abc", "x" * 40]
    for order in langid.ORDERS:
        keys, owner = langid._gram_keys(words, order)
        expected = [(g, i) for i, w in enumerate(words) for g in grams(w, order)]
        assert owner.tolist() == [i for _, i in expected]
        names = defaultdict(set)
        for key, (gram, _) in zip(keys.tolist(), expected, strict=True):
            names[key].add(gram)
        assert all(len(n) == 1 for n in names.values()) and len(names) == len({g for g, _ in expected})
    assert all(len(langid._gram_keys([], order)[0]) == 0 for order in langid.ORDERS)


def test_texts_in_one_call_or_each_alone(spark, sf):
    rows = read_table(spark, sf, "documents").select("text", "lang").collect()
    model = langid.Backoff(["de", "en"], [("de", 0, "und", 5), ("en", 0, "and", 5), ("de", 2, "ei", 3), ("en", 2, "th", 3)], memory=50)
    texts = [r.text for r in rows] + [None, "", "1 2 3"]
    together = model.predict_all(texts)
    assert together == [model.predict(t) for t in texts] and together[-3:] == [("und", 0.0)] * 3
