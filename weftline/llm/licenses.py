"""License scans: ordered signature rules behind a keyword prefilter, overlaps resolved by priority."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import read_table
from weftline.llm.license_rules import NAMES, SPDX

#: Phrases whose every place is reported, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Bytes of words stay, A-Z become a-z, all others a space; bytes from 0x80 on belong to words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BASE_SCORE = 0.5


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: re.Pattern


class Detection(NamedTuple):
    label: str
    priority: int
    start: int  # in the normalised text
    end: int


class Rules:
    """Rules by keyword; an automaton finds which keywords a text has in one pass over it."""

    def __init__(self, names: str = NAMES, spdx: str = SPDX):
        import ahocorasick

        self.rules = [Rule(label, int(priority), keyword, re.compile(pattern)) for label, priority, keyword, pattern in (line.split("|", 3) for line in names.strip().splitlines())]
        for name in spdx.split():
            words = " ".join(name.encode().translate(_WORDS).decode().split())
            self.rules.append(Rule(name.lower(), 99, f"spdx license identifier {words}", re.compile(rf"\bspdx license identifier {words}\b")))
        by_keyword: dict[str, list[int]] = defaultdict(list)
        for i, rule in enumerate(self.rules):
            by_keyword[rule.keyword].append(i)
        self.automaton = ahocorasick.Automaton()
        for keyword, own in by_keyword.items():
            self.automaton.add_word(keyword, own)
        self.automaton.make_automaton()

    def detections(self, norm: str) -> list[Detection]:
        wanted = {i for _, own in self.automaton.iter(norm) for i in own}
        return [Detection(self.rules[i].label, self.rules[i].priority, *m.span()) for i in sorted(wanted) for m in self.rules[i].pattern.finditer(norm)]


def resolved(detections: list[Detection]) -> list[Detection]:
    """The detections that no other one suppresses, by place.

    By descending priority, then length, then place and label, a detection is kept unless its
    interval lies within that of one kept before.
    """
    kept: list[Detection] = []
    starts: list[int] = []  # intervals of kept ones that lie in no other, by start and so by end
    ends: list[int] = []
    for d in sorted(detections, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        i = bisect_right(starts, d.start)
        if i and ends[i - 1] >= d.end:
            continue
        kept.append(d)
        j = i
        while j < len(ends) and ends[j] <= d.end:
            j += 1
        if i and starts[i - 1] == d.start:
            i -= 1
        starts[i:j], ends[i:j] = [d.start], [d.end]
    return sorted(kept, key=lambda d: (d.start, d.end, d.label))


@lru_cache(maxsize=1)
def _rules() -> Rules:
    return Rules()


def scan(text: bytes | None) -> dict:
    """What a text in UTF-8 holds: words, places of the phrases, labels, detections and a score."""
    norm = b" ".join((text or b"").translate(_WORDS).split())
    n_words = norm.count(b" ") + 1 if norm else 0
    padded = b" " + norm + b" "
    places, base = [], set()
    for phrase, label in PHRASES:
        sought = b" " + phrase.encode() + b" "
        at, before, words = padded.find(sought), 0, 0
        while at >= 0:
            words += padded.count(b" ", before, at)
            before = at
            places.append(words)
            base.add(label)
            at = padded.find(sought, at + 1)
    found = resolved(_rules().detections(norm.decode(errors="replace")))
    score = max([_BASE_SCORE if base else 0.0, *(d.priority / 100 for d in found)])
    return {
        "n_words": n_words, "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": sorted(base), "labels": sorted(base | {d.label for d in found}), "score": score,
    }


_FIELDS = (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
            found = [scan(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[c] for f in found], kind) for c, kind in _FIELDS)], ["id", *(c for c, _ in _FIELDS)])


def license_labels(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, n_words, n_base, first_word, last_word, base_labels, labels, score)``, a row per document.

    A-Z are lowered; words are runs of letters, digits and characters beyond ASCII. n_base counts
    all places, overlapping ones too, where the words of one of the phrases stand one after
    another; first_word and last_word are the first and last of these (null if there is none) and
    base_labels the phrases' labels. ``labels`` (sorted lists, like base_labels) adds those of the
    signature rules. The score is that of the surest sign, 0 if there is none.

    A text is read whole and each row alone. A null text is an empty one; null and repeated ids
    are passed on; extra columns are left out; an empty table gives an empty result.
    """
    plain = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = [T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")]
    lists = [T.StructField(c, T.ArrayType(T.StringType())) for c in ("base_labels", "labels")]
    schema = T.StructType([T.StructField("id", plain.schema["id"].dataType), *counts, *lists, T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(_scan, schema).withColumnRenamed("id", id_col)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_labels(read_table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


QUERIES = {"op7_licenses": op7_licenses}
SQL: dict = {}
