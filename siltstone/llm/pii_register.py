"""Likeness of words to a register of any size, by joins in place of a copy in every worker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.pii_candidates import Register, asked_words, readings
from siltstone.operators.skew import skew_join
from siltstone.session import settle

#: What a part of a name is looked up as: the whole, the name less a sign, its beginning, its ending.
WHOLE, LESS, HEAD, TAIL = range(4)


class KnownWords(Register):
    """A register that knows the likeness of the words of some texts; all others are like nothing."""

    def __init__(self, likes: dict[str, list[float]]):
        super().__init__([])
        self.likes = likes

    def likeness(self, word: str) -> tuple[tuple[float, float, float], tuple[float, float, float]]:
        found = self.likes.get(word)
        return (tuple(found[:3]), tuple(found[3:])) if found else ((0.0, 0.0, 0.0), (0.0, 0.0, 0.0))


def name_parts(register: DataFrame) -> DataFrame:
    """``part, s, kind, n``: in how many names of a kind each part occurs (once for wholes and names less a sign)."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r = Register(zip(b["name_text"], b["name_kind"]))
            yield pd.DataFrame([(w, k) for k, names in r.exact.items() for w in names], columns=["w", "kind"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for w, k in zip(b["w"], b["kind"]):
                out.append((WHOLE, w, k))
                out += [(LESS, d, k) for d in (Register._cut(w) if len(w) > 4 else ())]
                out += [(HEAD, w[:i], k) for i in range(2, len(w) - 1)] + [(TAIL, w[i:], k) for i in range(2, len(w) - 1)]
            yield pd.DataFrame(out, columns=["part", "s", "kind"])

    names = register.select(F.col("name_text").cast("string"), F.col("name_kind").cast("string")).filter("name_text is not null and name_kind is not null")
    folded = names.mapInPandas(parts, "w string, kind string").distinct()
    return folded.mapInPandas(cut, "part int, s string, kind string").groupBy("part", "s", "kind").agg(F.count("*").alias("n"))


def word_likeness(words: DataFrame, register: DataFrame) -> DataFrame:
    """``word, likes``: the six figures of :meth:`Register.likeness` of the distinct ``words`` that are like a name at all.

    A word asks for its own parts only, so what it is compared with is as much as
    it is long; parts that very many words share are spread.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = set()
            for word in b["word"]:
                for w in readings(word):
                    cuts = Register._cut(w)
                    out |= {(word, part, s) for s in (w, *cuts) for part in (WHOLE, LESS)}
                    out |= {(word, HEAD, w[:i]) for i in range(2, len(w) - 1)} | {(word, TAIL, w[i:]) for i in range(2, len(w) - 1)}
            yield pd.DataFrame(list(out), columns=["word", "part", "s"])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for word, found in zip(b["word"], b["found"]):
                own = Register([])
                for f in found:
                    if f["kind"] in own.exact:
                        if f["part"] == WHOLE:
                            own.exact[f["kind"]].add(f["s"])
                        elif f["part"] == LESS:
                            own.near[f["kind"]].add(f["s"])
                        else:
                            (own.head if f["part"] == HEAD else own.tail)[f["kind"]][f["s"]] = f["n"]
                given, family = own.likeness(word)
                out.append((word, [float(x) for x in (*given, *family)]))
            yield pd.DataFrame(out, columns=["word", "likes"])

    probes = settle(words.mapInPandas(ask, "word string, part int, s string"), "name-probes")
    met = skew_join(probes, settle(name_parts(register), "name-parts"), ["part", "s"], ["word"])
    return met.groupBy("word").agg(F.collect_list(F.struct("part", "s", "kind", "n")).alias("found")).mapInPandas(judge, "word string, likes array<double>")


def with_likes(docs: DataFrame, register: DataFrame) -> DataFrame:
    """``doc_id, text, likes``: each document with the likeness of its own words."""

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(row, w) for row, text in zip(b["row"], b["text"]) for w in asked_words(text)], columns=["row", "word"])

    kept = settle(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")
    asked = settle(kept.filter("text is not null").select("row", "text").mapInPandas(words_of, "row long, word string"), "asked-words")
    likes = settle(word_likeness(asked.select("word").distinct(), register), "likes")
    own = skew_join(asked, likes, ["word"], ["row"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "likes"))).alias("likes"))
    return kept.join(own, "row", "left").select("doc_id", "text", "likes")
