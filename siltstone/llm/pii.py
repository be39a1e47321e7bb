"""Personal information in free text: candidate spans judged by boosted trees."""

from __future__ import annotations

import gc
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import boosting
from siltstone.llm.pii_candidates import EXAMPLE, FAINT, KINDS, NAME_BEST, NAME_FAINT, NAME_GIVEN, NAME_N_GIVEN, NAME_TITLE, Candidate, Register, candidates
from siltstone.llm.pii_register import KnownWords, with_likes
from siltstone.session import settle

#: Documents whose candidates the trees are fitted on, and the most labelled rows taken from them.
SAMPLE_DOCS = 3000
SAMPLE_ROWS = 200_000
#: A name register of up to so many rows is sent to every worker; the words of the texts are joined with a larger one.
REGISTER_ROWS = 100_000
#: Parts of the sample; part 0 calibrates.
FOLDS = 5

#: Features that helped to label a row; every row is learnt once with and once without them.
MASKED = {
    "email": ((), ()),
    "phone": ((10, 13, 14, 15), (1, 2)),
    "id_number": ((10, 13, 14, 15), (1, 2)),
    "address": ((4, 12, 13), (1, 2)),
    "name": ((), (1, 2)),
}
SPAN = "kind string, start_pos long, end_pos long"


@dataclass
class KindModel:
    kind: str
    weights: list[dict[str, float]]
    trees: boosting.Trees | None

    def features(self, rows: list[Candidate]) -> np.ndarray:
        hints = [[w.get(h, 0.0) for w, h in zip(self.weights, r.hints)] for r in rows]
        return np.concatenate([_plain(self.kind, np.array([r.form for r in rows], np.float32)), np.array(hints, np.float32)], axis=1)

    def margins(self, rows: list[Candidate]) -> np.ndarray:
        """How far above its threshold each row is, as a share of what is possible; below 0 is a no."""
        if self.trees is None:  # no examples of both sorts: what form and surroundings settle
            return np.array([float(r.label) - 0.5 for r in rows])
        t = self.trees.threshold
        return (self.trees.probability(self.features(rows)) - t) / (1 - t)


def _plain(kind: str, form: np.ndarray) -> np.ndarray:
    """Without the features that only serve to hide others."""
    form = form.copy()
    if kind == "name":
        form[:, list(NAME_BEST.values())] = 0
    return form


def _counts(hints: list[str], y: np.ndarray) -> dict[str, np.ndarray]:
    """How often each string comes with a 1 and a 0."""
    seen: dict[str, np.ndarray] = {}
    for h, v in zip(hints, y.tolist()):
        seen.setdefault(h, np.zeros(2))[0 if v else 1] += 1
    return seen


def _odds(a: float, b: float, prior: float) -> float:
    return float(np.log((a + prior) / (b + 1 - prior)))


def fit_kind(kind: str, form: np.ndarray, hints: list[list[str]], y: np.ndarray, fold: np.ndarray) -> KindModel:
    """Weights of the hint strings, then trees on form and weights.

    A row is trained with weights counted on the other folds. (Leaving out just
    the row itself would give its label away: its weight would differ from that
    of an equal row with the other label.)
    """
    shown = y == EXAMPLE
    if shown.all():
        return KindModel(kind, [], None)
    if kind == "address":
        y = _known_streets([h[0] for h in hints], y)
    y = np.maximum(y, 0)
    prior = float(np.clip(y[~shown].mean(), 0.05, 0.95))
    base = _odds(0, 0, prior)
    weights, columns = [], []
    nothing = np.zeros(2)
    for slot, column in enumerate(zip(*hints)):
        column = np.array(column, object)
        use = ~shown | (slot == NAME_FAINT)
        counts = _counts(list(column[use]), y[use])
        own = {f: _counts(list(column[use & (fold == f)]), y[use & (fold == f)]) for f in np.unique(fold)}
        columns.append([_odds(*(counts[h] - own[f].get(h, nothing)), prior) - base for h, f in zip(column[~shown], fold[~shown])])
        weights.append({h: _odds(*n, prior) - base for h, n in counts.items() if n.sum() > 1})
    form, y, fold = form[~shown], y[~shown], fold[~shown]
    x = np.concatenate([_plain(kind, form), np.array(columns, np.float32).T], axis=1)
    hidden = x.copy()
    forms, slots = MASKED[kind]
    hidden[:, [*forms, *(form.shape[1] + s for s in slots)]] = 0
    if kind == "name":
        for to, source in NAME_BEST.items():
            hidden[:, to] = form[:, source]
        sure = (y > 0) & ((form[:, NAME_TITLE] > 0.6) | (form[:, 0] >= 5))  # a title or given name vouches for the rest
        faint = x[sure]
        faint[:, 1] = FAINT
        vouched = (y > 0) & (form[:, NAME_N_GIVEN] > 0) & (form[:, 1] >= 5)  # the family name vouches for a given name that the register lacks
        unknown = x[vouched]
        unknown[:, [NAME_GIVEN, form.shape[1] + NAME_FAINT]] = 0
        more = (hidden, faint, unknown)
        return KindModel(kind, weights, boosting.fit(x, y, fold, np.concatenate(more), np.concatenate([y, y[sure], y[vouched]]), np.concatenate([fold, fold[sure], fold[vouched]]), trees=60))
    return KindModel(kind, weights, boosting.fit(x, y, fold, hidden, y, fold, trees=60))


def _known_streets(streets: list[str], y: np.ndarray) -> np.ndarray:
    """Labels corrected by the streets that recur: whole ones count across a line end, cut ones don't."""
    known = Counter(s for s, v in zip(streets, y) if v)
    starts = {" ".join(s.split()[:i]): n for s, n in known.items() if n > 2 for i in range(1, len(s.split()))}
    return np.array([1.0 if known[s] > 2 and starts.get(s, 0) <= known[s] else 0.0 if starts.get(s, 0) > known[s] else v for s, v in zip(streets, y)])


def read_register(register: DataFrame) -> Register | None:
    """The register, or None if it has more than ``REGISTER_ROWS`` rows."""
    rows = register.select(F.col("name_text").cast("string"), F.col("name_kind").cast("string")).distinct().limit(REGISTER_ROWS + 1).collect()
    return Register([tuple(r) for r in rows]) if len(rows) <= REGISTER_ROWS else None


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _batch_register(register: Register | None, batch: pa.RecordBatch) -> Register:
    """The shared register, or what the batch's own column says of its words."""
    if register is not None:
        return register
    return KnownWords({w: v for likes in batch.column(2).to_pylist() for w, v in likes or ()})


def train(docs: DataFrame, register: Register | None, sample_docs: int = SAMPLE_DOCS) -> dict[str, KindModel]:
    """One model a kind, from the candidates of a sample that label themselves.

    No labels are given, so they come from the candidates whose form and
    surroundings settle what they are (a full number right after "Tel.", a
    register name after a title, a lot number). The features that did so are
    hidden in a second copy of each row, so the trees learn to decide the rest
    from what remains. The sample is about ``sample_docs`` documents, drawn by the
    hash of the id; it bounds the fit only, every document is searched. ``docs``:
    ``doc_id, text``, and ``likes`` where the register is None.
    """
    share = min(1.0, sample_docs / max(1, docs.count()))
    taken = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    shared = docs.sparkSession.sparkContext.broadcast(register)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, known = [], _batch_register(shared.value, b)
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out += [(c.kind, c.label, list(c.form), list(c.hints), doc_id or 0, c.start, c.end) for c in candidates(text, known, examples=True) if c.label != -1]
            names = ("kind", "label", "form", "hints", "doc_id", "start", "stop")
            types = (pa.string(), pa.int32(), pa.list_(pa.float32()), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], list(names))

    rows = taken.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id").mapInArrow(run, "kind string, label int, form array<float>, hints array<string>, doc_id long, start long, stop long").limit(SAMPLE_ROWS).toPandas()
    models = {}
    for kind in KINDS:
        own = rows[rows["kind"] == kind].sort_values(["doc_id", "start", "stop", "label"], kind="stable")  # the fit does not depend on the order of tasks
        form = np.array([np.asarray(f, np.float32) for f in own["form"]], np.float32)
        models[kind] = fit_kind(kind, form, [list(h) for h in own["hints"]], own["label"].to_numpy(np.float64), own["doc_id"].to_numpy() % FOLDS)
    return models


def select(found: list[tuple[float, Candidate]]) -> list[Candidate]:
    """The accepted spans of a text, none overlapping: best first, of about equals (quarters) the longer."""
    kept: list[Candidate] = []  # by place, so a span has to be compared with its two neighbours only
    for _, c in sorted(found, key=lambda x: (-round(4 * x[0]), x[1].start - x[1].end, x[1].start, x[1].kind)):
        i = bisect_left(kept, c.start, key=lambda k: k.start)
        if (i == 0 or kept[i - 1].end <= c.start) and (i == len(kept) or kept[i].start >= c.end):
            kept.insert(i, c)
    return kept


def find(texts: list[str | None], models: dict[str, KindModel], register: Register) -> list[list[Candidate]]:
    """The personal information in each text."""
    pool: dict[str, list[tuple[int, Candidate]]] = {k: [] for k in KINDS}
    for i, t in enumerate(texts):
        for c in candidates(t, register):
            pool[c.kind].append((i, c))
    accepted: list[list[tuple[float, Candidate]]] = [[] for _ in texts]
    for kind, rows in pool.items():
        if rows:
            for (i, c), m in zip(rows, models[kind].margins([c for _, c in rows])):
                if m >= 0:
                    accepted[i].append((float(m), c))
    return [select(a) for a in accepted]


def redact(text: str, spans: list[Candidate]) -> str:
    """The text with ``[EMAIL]``, ``[PHONE]`` and so on in place of each span."""
    out, at = [], 0
    for c in spans:
        out += [text[at : c.start], f"[{c.kind.upper()}]"]
        at = c.end
    return "".join([*out, text[at:]])


def scan(df: DataFrame, register: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, spans`` of each document, and with ``redacted`` its ``text`` without them.

    ``spans`` is an array of (kind, start_pos, end_pos) in code points, empty for a
    null, empty or clean text; the redacted text of a null is null. Every document
    is searched as a whole, and no row is shuffled. A register too large to be sent
    to every worker is joined with the distinct words of the texts, and each
    document gets what it says of its own words; the result is the same.
    """
    names, docs = read_register(register), _documents(df, id_col, text_col)
    if names is None:
        docs = settle(with_likes(docs, register), "with-likes")
    shared = df.sparkSession.sparkContext.broadcast((names, train(docs, names, sample_docs)))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        register, models = shared.value
        gc.disable()  # millions of small tuples and no cycles: within a batch nothing needs collecting
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    b = whole.slice(at, 1024)
                    texts = b.column(1).to_pylist()
                    found = find(texts, models, _batch_register(register, b))
                    spans = pa.array([[{"kind": c.kind, "start_pos": c.start, "end_pos": c.end} for c in f] for f in found], span)
                    columns = [b.column(0), spans]
                    if redacted:
                        columns.append(pa.array([None if t is None else redact(t, f) for t, f in zip(texts, found)], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans", "text"][: len(columns)])
                gc.collect()
        finally:
            gc.enable()

    return docs.mapInArrow(run, f"doc_id long, spans array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>" + (", text string" if redacted else ""))


def findings(scanned: DataFrame) -> DataFrame:
    """``doc_id, kind, start_pos, end_pos``, one row a span."""
    return scanned.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*").distinct()
