"""License scans by ordered signature rules.

Hundreds of patterns, each gated by a keyword that every match must hold: a text is searched for the few dozen
distinct keywords first, and only rules whose keyword occurs run. Detections overlap: where the interval of one (of
a tagged identifier: without the tag) lies within that of another, the one of lower priority (later in the table) is suppressed. The base phrases are counted apart, by words, and their labels always stay.

Defined cases: null is the empty text: no words, no labels (empty strings), score 0. score is the largest confidence
of the detections that stay (a base phrase counts 0.9).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import common as C
from heliograph.llm.license_rules import table

#: Phrase, label, keyword.
BASE = (("cc by", "cc-by", "cc"), ("general public license", "gpl", "general"), ("all rights reserved", "reserved", "reserved"))
_W = "0-9a-z\x80-\U0010ffff"
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Scanner:
    def __init__(self):
        self.rules = [(label, re.compile(pattern), confidence) for label, _, pattern, confidence in table()]
        self.by_keyword: dict[str, list[int]] = {}
        for i, (_, keyword, _, _) in enumerate(table()):
            self.by_keyword.setdefault(keyword, []).append(i)
        self.base = [(re.compile(f"(?<![{_W}])" + f"[^{_W}]+".join(p.split()) + f"(?![{_W}])"), label, keyword) for p, label, keyword in BASE]
        self.word = re.compile(f"[{_W}]+")

    def detections(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) that stay, in order of place; text is lower-cased."""
        found = []
        for keyword, rules in self.by_keyword.items():
            if keyword in text:
                for r in rules:
                    group = self.rules[r][1].groups  # 0: the whole match
                    found += [(*m.span(group), r) for m in self.rules[r][1].finditer(text) if m.end() > m.start()]
        found.sort()
        kept: list[tuple[int, int, int]] = []
        at = 0
        while at < len(found):  # clusters of overlapping detections, each settled for itself
            end, to = found[at][1], at + 1
            while to < len(found) and found[to][0] < end:
                end, to = max(end, found[to][1]), to + 1
            own: list[tuple[int, int, int]] = []
            for d in sorted(found[at:to], key=lambda d: (d[2], d[0], -d[1])):
                if not any((o[0] <= d[0] and d[1] <= o[1]) or (d[0] <= o[0] and o[1] <= d[1]) for o in own):
                    own.append(d)
            kept += sorted(own)
            at = to
        return kept

    def places(self, text: str) -> list[tuple[int, str]]:
        """(start, label) of the base phrases."""
        return [(m.start(), label) for pattern, label, keyword in self.base if keyword in text for m in pattern.finditer(text)]

    def scan(self, text: str) -> tuple[int, int | None, int | None, str, str, float, list[dict]]:
        text = text.translate(_UPPER) if text.isascii() is False else text.lower()
        base, found = self.places(text), self.detections(text)
        first = last = None
        if base:
            first = len(self.word.findall(text, 0, min(s for s, _ in base)))
            last = len(self.word.findall(text, 0, max(s for s, _ in base)))
        base_labels = sorted({x for _, x in base})
        labels = sorted({*base_labels, *(self.rules[r][0] for _, _, r in found)})
        score = max([0.0, *([0.9] if base else []), *(self.rules[r][2] for _, _, r in found)])
        return len(base), first, last, ",".join(base_labels), ",".join(labels), score, [{"start": s, "end": e, "label": self.rules[r][0]} for s, e, r in found]


_scanner: list[Scanner] = []
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:int,end:int,label:string>>"
_DETECTIONS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))


def _run(batches):
    if not _scanner:
        _scanner.append(Scanner())
    scanner = _scanner[0]
    for whole in batches:
        for b in C.chunks(whole):
            buf, offsets = C.texts(b.column(1))
            counts = np.diff(C.words(C.LOWER[buf], offsets, C.ALNUM_WORD)[2])
            rows = [scanner.scan(t) for t in pc.fill_null(b.column(1), "").to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _DETECTIONS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): word and phrase counts, labels, and the detections with their places (characters)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_run, SCHEMA)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.documents(spark, sf_dir, "doc_id", "text")).drop("detections")
