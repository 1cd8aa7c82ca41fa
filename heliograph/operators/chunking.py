"""Chunking of documents, and contexts for chunks.

Fixed windows of words are native. The other chunkers are sequential within a text: Arrow UDFs that return an array of
chunks, exploded into rows. Chunks: chunk_id ("doc_id::position"), doc_id, position, text, start_char, end_char, section.
"""

from __future__ import annotations

import re
from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions.batches import piecewise

PIECES = "array<struct<text:string,start_char:int,end_char:int,section:string>>"


def fixed(docs: DataFrame, size: int = 200, overlap: int = 40) -> DataFrame:
    """Windows of so many words; the last one ends with the text. Offsets are those within the chunk."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    w = F.filter(F.split(F.coalesce("text", F.lit("")), "(?U)[\\s\\x1c-\\x1f]+"), lambda x: x != "")
    n, step = F.size("w"), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step))
    rows = docs.select("doc_id", w.alias("w")).select("doc_id", "w", F.posexplode(starts).alias("position", "at"))
    text = F.array_join(F.slice("w", F.col("at") + 1, F.lit(size)), " ")
    return rows.select(F.concat_ws("::", F.col("doc_id").cast("string"), F.col("position").cast("string")).alias("chunk_id"), "doc_id", "position", text.alias("text"), F.lit(0).alias("start_char"), F.length(text).alias("end_char"), F.lit("").alias("section"))


def by_sentences(text: str, limit: int = 800, overlap: int = 1) -> list[dict]:
    """Whole sentences up to so many characters (at least one), with so many repeated."""
    parts = [p.strip() for p in re.split(r"(?<=[!.?])\s+", text.strip())]
    parts = [p for p in parts if p]
    out, i = [], 0
    while i < len(parts):
        j, used = i, 0
        while j < len(parts) and (j == i or used + len(parts[j]) <= limit):
            used += len(parts[j]) + 1
            j += 1
        body = " ".join(parts[i:j])
        out.append(dict(text=body, start_char=0, end_char=len(body), section=""))
        if j >= len(parts):
            break
        i = max(i + 1, j - overlap)
    return out


SEPARATORS = tuple("\n\n|\n|. | |".split("|"))


def _pack(parts: list[str], sep: str, size: int, overlap: int) -> list[str]:
    out, held, used = [], [], 0
    for p in parts:
        if held and used + len(sep) + len(p) > size:
            whole = sep.join(held).strip()
            if whole:
                out.append(whole)
            while held and used > overlap:
                used -= len(held[0]) + (len(sep) if len(held) > 1 else 0)
                del held[0]
        held.append(p)
        used += len(p) + (len(sep) if len(held) > 1 else 0)
    tail = sep.join(held).strip()
    return [*out, tail] if tail else out


def _divide(text: str, seps: tuple[str, ...], size: int, overlap: int) -> list[str]:
    at = next((i for i, s in enumerate(seps) if s == "" or s in text), None)
    sep, finer = (seps[-1], ()) if at is None else (seps[at], () if seps[at] == "" else seps[at + 1 :])
    out, small = [], []
    for p in text.split(sep) if sep else text:
        if 0 < len(p) < size:
            small.append(p)
        elif p:
            out += _pack(small, sep, size, overlap)
            small = []
            out += _divide(p, finer, size, overlap) if finer else [p]
    return out + _pack(small, sep, size, overlap)


def recursive_text(text: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> list[dict]:
    """Divides at the first separator there is, finer where a piece is still too long, and merges small pieces with overlap."""
    body, out, at = text.strip(), [], 0
    for piece in _divide(body, separators, size, overlap) if body else []:
        start = body.find(piece, at)
        start = at if start < 0 else start
        out.append(dict(text=piece, start_char=start, end_char=start + len(piece), section=""))
        at = max(0, start + len(piece) - overlap)
    return out


def markdown_text(text: str, limit: int = 1000) -> list[dict]:
    """One chunk per section with its heading; what stands before the first is the Introduction; long sections are divided."""
    body = text.strip()
    heads = list(re.finditer(r"(?m)^#{1,6}\s+(.+)$", body))
    if not heads:
        return recursive_text(body, limit, 100)
    cuts = [(h.group(1).strip(), h.start()) for h in heads]
    if cuts[0][1] > 0:
        cuts.insert(0, ("Introduction", 0))
    out = []
    for (name, start), end in zip(cuts, [*[c[1] for c in cuts[1:]], len(body)]):
        part = body[start:end].strip()
        if not part:
            continue
        if len(part) <= limit:
            out.append(dict(text=part, start_char=start, end_char=end, section=name))
        else:
            out += [dict(text=p["text"], start_char=p["start_char"] + start, end_char=p["end_char"] + start, section=name) for p in recursive_text(part, limit, 100)]
    return out


CHUNKERS: dict[str, Callable[..., list[dict]]] = {"sentence": by_sentences, "recursive": recursive_text, "markdown": markdown_text}


def chunk(docs: DataFrame, method: str | Callable[[str], list[dict]] = "recursive", carry: tuple[str, ...] = (), **options) -> DataFrame:
    """Chunks of docs(doc_id, text) by name (fixed, sentence, recursive, markdown) or by a function of your own.

    carry: columns of docs that each chunk gets too (not with fixed).
    """
    if method == "fixed":
        return fixed(docs, **options)
    split = CHUNKERS[method] if isinstance(method, str) else method

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split(t or "", **options))

    rows = docs.select("doc_id", *carry, F.posexplode(piecewise(run, PIECES)("text")).alias("position", "p"))
    return rows.select(F.concat_ws("::", F.col("doc_id").cast("string"), F.col("position").cast("string")).alias("chunk_id"), "doc_id", "position", "p.*", *carry)


def title_context(doc_id: Column, title: Column) -> Column:
    """The title, else the document's id with spaces for - and _."""
    return F.coalesce(F.when(title != "", title), F.translate(doc_id.cast("string"), "-_", "  "))


def first_sentence(document: Column, limit: int = 160) -> Column:
    return F.substring(F.get(F.split(F.trim(document), r"(?U)\n|(?<=[!.?])\s+", 2), F.lit(0)), 1, limit)


def lead_of(first: Column, chunk_text: Column, start_char: Column) -> Column:
    """A document's first sentence; empty for a chunk at its start or one that holds it."""
    return F.when((start_char == 0) | chunk_text.contains(first), F.lit("")).otherwise(first)


def lead_context(document: Column, chunk_text: Column, start_char: Column, limit: int = 160) -> Column:
    """The same from the whole document."""
    return lead_of(first_sentence(document, limit), chunk_text, start_char)


def heading_context(document: Column, start_char: Column) -> Column:
    """The path of markdown headings above a chunk, joined by " > "."""

    def run(d: pd.Series, s: pd.Series) -> pd.Series:
        def path(text: str | None, at: int) -> str:
            above: list[tuple[int, str]] = []
            for m in re.finditer(r"(?m)^([#]{1,6})\s+(\S.*?)\s*$", text or ""):
                if m.start() > at:
                    break
                above = [a for a in above if a[0] < len(m.group(1))] + [(len(m.group(1)), m.group(2))]
            return " > ".join(t for _, t in above)

        return pd.Series([path(t, a) for t, a in zip(d, s)])

    return piecewise(run, "string")(document, start_char)


def combined_context(*contexts: Column) -> Column:
    return F.array_join(F.filter(F.array(*contexts), lambda x: x != ""), " | ")


def index_text(context: Column, text: Column) -> Column:
    """What is indexed: the context, a line break, the text."""
    return F.when(context != "", F.concat(context, F.lit("\n"), text)).otherwise(text)


def reassemble(chunks: DataFrame) -> DataFrame:
    """doc_id, text: chunks in order of start_char without their overlaps; joined by blank lines if offsets aren't distinct."""
    per = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "position", "text"))).alias("a"), (F.countDistinct("start_char") == F.count("*")).alias("real"))
    plain = F.array_join(F.transform(F.array_sort(F.transform("a", lambda x: F.struct(x["position"].alias("position"), x["text"].alias("text")))), lambda x: x["text"]), "\n\n")
    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.substring(x["text"], F.greatest(F.lit(0), acc["end"] - x["start_char"]) + 1, F.length(x["text"]))
        return F.struct(F.greatest(acc["end"], x["start_char"] + F.length(x["text"])).cast("int").alias("end"), F.concat(acc["out"], fresh).alias("out"))

    joined = F.aggregate("a", start, step, lambda acc: acc["out"])
    return per.select("doc_id", F.when(F.col("real"), joined).otherwise(plain).alias("text"))
