"""Personal data: exact base recognisers and bootstrapped contextual extraction.

One pass over the texts finds the base spans (email, ip, card, phone) and the other identifier-like tokens, each with its
lexical patterns: the word before it, the word behind it, and both. Digit groups apart by spaces, parentheses, dots or
hyphens are one token, beside the unbroken tokens in them. Base entities are the seeds. A bipartite graph of patterns and instances
(token values) is scored in rounds: a pattern's trust is the sum of its known instances' scores by the count of all its instances and
``DOUBT``; patterns of ``SUPPORT`` known instances and a trust of ``ACCEPT`` are reliable; an unseen instance of reliable patterns becomes
known, with a score of one minus the product of their doubts, and so lends support to its other patterns. Rounds end when
nothing new is found. Spans of found values, wherever they stand, have the kind ``id`` and follow the base kinds.

Offsets are code points. Null and empty texts hold nothing; base matches that overlap across kinds all stay, and tokens that
overlap a base span are no candidates; repeated rows and equal ids are rows of their own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from siltbed.llm import common as C

# The base patterns and the order of kinds.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9_./+@-]{4,}[A-Za-z0-9]")
GROUPED = re.compile(r"(?<![A-Za-z0-9_./+@-])\(?[A-Za-z]{0,4}[0-9]++(?:(?:[\x20.-]|\)[\x20.-]?|\x20\()(?:[0-9]{2,}+|[A-Z]{4}(?=\x20[0-9])))++(?![A-Za-z0-9_/+@]|[.-][A-Za-z0-9])")
NEXT_WORD = re.compile(r"\W*+([^\W\d_]++)")
SPANS = "__private_spans__"
LEAST_DIGITS = 4  # digits of an identifier-like token
DOUBT, SUPPORT, ACCEPT = 1.0, 5, 0.8


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain. A match starts where the run of local characters before its @ starts, but not before the
    last match's end, so each @ is looked at once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and at >= end and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def small(part: str) -> bool:
    return len(part := part.lstrip("0")) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum("0" <= ch <= "9" for ch in m[0]) <= 15]
    return out


def left_word(text: str, start: int) -> str:
    """The letters before the last signs before ``start``, however far, or nothing if there is a digit or underscore between."""
    end = start
    while end and not (text[end - 1].isalnum() or text[end - 1] == "_"):
        end -= 1
    at = end
    while at and text[at - 1].isalnum() and not text[at - 1].isdecimal():
        at -= 1
    return text[at:end].lower()


def right_word(text: str, end: int) -> str:
    m = NEXT_WORD.match(text, end)
    return m[1].lower() if m else ""


def patterns(text: str, start: int, end: int) -> list[str]:
    """The contexts of a span: ``word _``, ``_ word`` and ``word _ word``."""
    left, right = left_word(text, start), right_word(text, end)
    out = ([f"{left} _"] if left else []) + ([f"_ {right}"] if right else [])
    return out + ([f"{left} _ {right}"] if len(out) == 2 else [])


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds and identifier-like tokens with their contexts."""
    out = [{"patterns": patterns(text, a, b), "value": text[a:b].lower(), "seed": True, "s": a, "e": b} for _, a, b in base]
    if DIGIT.search(text):
        taken = sorted((a, b) for _, a, b in base)
        k = 0
        groups = [m.span() for m in GROUPED.finditer(text) if m.end() - m.start() >= 6 and any(ch in " ()" for ch in m[0])]
        for start, end in sorted([*groups, *(m.span() for m in TOKEN.finditer(text))]):
            value = text[start:end]
            if sum("0" <= ch <= "9" for ch in value) < LEAST_DIGITS:
                continue
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            if k < len(taken) and taken[k][0] < end:
                continue
            out.append({"patterns": patterns(text, start, end), "value": value.lower(), "seed": False, "s": start, "e": end})
    return out


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text in pdf["text"]:
            base = base_spans(text) if text else []
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            said = spelled(base)
            out.append((*counts, hashlib.sha256(said.encode()).hexdigest(), said, candidates(text, base) if text else []))
        cols = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found"]
        yield pd.concat([pdf[["k2", "doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=cols)], axis=1)


SCANNED = ("k2 binary, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
           "found array<struct<patterns:array<string>,value:string,seed:boolean,s:int,e:int>>")


def score_instances(edges: DataFrame) -> DataFrame:
    """(value): unseen instances that reliable patterns find, from edges (pattern, value, seed)."""
    edges = C.materialize(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "private-edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT)  # fewer never give support
    graph = C.materialize(edges.join(sizes, "pattern"), "private-graph")
    known = C.materialize(graph.filter("seed").select("value", F.lit(1.0).alias("score"), F.lit(True).alias("seed")).distinct(), "private-known")
    while True:
        held = graph.select("pattern", "value", "n").join(known, "value")
        trust = held.groupBy("pattern", "n").agg(F.sum("score").alias("held"), F.count("*").alias("support"))
        trust = trust.select("pattern", "support", (F.col("held") / (F.col("n") + DOUBT)).alias("trust"))
        reliable = C.materialize(trust.filter((F.col("support") >= SUPPORT) & (F.col("trust") >= ACCEPT)), "private-trust")
        fresh = graph.select("pattern", "value").join(reliable, "pattern").join(known.select("value"), "value", "left_anti")
        doubt = F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999999)))))
        fresh = C.materialize(fresh.groupBy("value").agg((1 - doubt).alias("score")).withColumn("seed", F.lit(False)), "private-fresh")
        if fresh.isEmpty():
            return known.filter(~F.col("seed")).select("value")
        known = C.materialize(known.unionByName(fresh), "private-known")


def find_spans(docs: DataFrame) -> DataFrame:
    """(k2, doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found): one row per document."""
    C.prepared(docs)
    keyed = docs.select(C.text_key(F.col("doc_id"), F.col("text")).alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = C.materialize(keyed.mapInPandas(scan, SCANNED), "private-scan")
    tokens = scanned.filter(F.size("found") > 0).select("k2", F.explode("found").alias("t")).select("k2", "t.*")
    values = score_instances(tokens.select(F.explode("patterns").alias("pattern"), "value", "seed"))
    hits = tokens.filter(~F.col("seed")).select("k2", "value", "s", "e").distinct().join(values, "value")
    more = C.materialize(hits.groupBy("k2").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("more")), "private-more")
    spelled_more = F.transform("more", lambda x: F.concat_ws(":", F.lit("id"), x["s"].cast("string"), x["e"].cast("string")))
    spans = F.concat_ws(",", F.nullif(F.col("base"), F.lit("")), spelled_more)
    return scanned.drop("found").join(more, "k2", "left").select(
        "k2", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_found"))


def mask(text: str | None, spans: str | None) -> str | None:
    """The text with each span replaced by its kind; of overlapping spans the first covers the others."""
    if not text or not spans:
        return text
    parts, at = [], 0
    marks = sorted(((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(","))))
    end = 0
    for a, b, kind in marks:
        b = -b
        if a >= end:
            parts += [text[at:a], f"[{kind.upper()}]"]
        end = at = max(end, b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked; their count of characters follows."""
    spans = find_spans(docs).filter("spans <> ''").select(F.col("k2").alias(C.KEY), F.col("spans").alias(SPANS)).distinct()
    marked = C.keyed(docs).join(C.materialize(spans, "private-spans").hint("merge"), C.KEY, "left")  # the same way at every size
    masked = F.pandas_udf(lambda texts, marks: pd.Series([mask(t, s) for t, s in zip(texts, marks)], dtype=object), "string")
    done = marked.withColumn("text", F.when(F.col(SPANS).isNull(), F.col("text")).otherwise(masked("text", F.coalesce(SPANS, F.lit("")))))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(SPANS).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return done.select(*docs.columns)
