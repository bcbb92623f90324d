"""Subject areas of documents: classifier chains with calibrated links and beam search.

Features of a document are of terms (how large a part of its sentences is about each area), of its source
and of its structure.  The weights of terms start from the documents labelled with an area and the
areas' own words, and are refined by assigning each sentence of a labelled document to one of the document's
areas or to none (a few rounds of expectation and maximisation).  One logistic link for each area
follows in a chain; a link sees the labels before it, so that areas that come together support each
other.  Links are calibrated on documents they weren't fitted on, and the most probable combination of
labels is found by beam search.

The model is fitted on at most ``FIT_DOCUMENTS`` labelled documents, drawn by hash of the identifier;
everything else covers every document as a whole.

Defined results: null and blank texts, and texts without a sentence, have no area; a label given twice
counts once; labels of absent documents or unknown areas don't count; without labels the areas' own words
decide alone; documents sent twice are judged each; empty tables give nothing.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_DOCUMENTS = 10_000
SHARE = 0.25
BEAM = 6
ROUNDS = 3
#: Sum of weights from which a sentence is about an area.
LEAST_SCORE = 1.5
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W\d_]+)*")
_FURNITURE = regex.compile(
    r"^\s*(?:(?:subject|x-[\w-]+|from|to|date|sent|cc|objet|betreff|von|an|de|à)\s?:.*|-{2,} ?.* ?-{2,}|\[.*\]|\(.*\)|page \d+.*|[^.!?]{1,40}(?: \| [^.!?|]{1,40})+|[-=_*~#|\s]+|contents\.?|https?://\S+)\s*$", regex.I
)
_BULLET = regex.compile(r"^\s*(?:[-*•>]|\d+[.)])\s+")
_END = regex.compile(r"(?<=[.!?…]['\"”»)]?)\s+(?=[\p{Lu}\p{N}\"“«(])")
_ABBREVIATED = regex.compile(r"(?:^|\s)(?:\p{Lu}|Mr|Mrs|Ms|Dr|Prof|No|no|Fig|vs|etc|bzw|z\.B)\.$")


def _may_be_furniture(line: str) -> bool:
    """Cheap test that every line of page furniture passes."""
    start = line.lstrip()[:9].lower()
    return not start or start[0] in "-[(=_*~#|" or ":" in line or "|" in line or start.startswith(("page ", "contents", "http"))


def sentences(text: str | None, title: str | None = None) -> list[str]:
    """The sentences of a text without titles and page furniture; wrapped lines are joined."""
    if not text:
        return []
    out: list[str] = []
    for block in regex.split(r"\n\s*\n", text.replace("\r", "")):
        pieces: list[str] = []
        for line in block.split("\n"):
            if _may_be_furniture(line) and _FURNITURE.match(line):
                pieces.append("\x00")
            elif _BULLET.match(line):
                pieces.append("\x00" + _BULLET.sub("", line).strip())
            else:
                pieces.append(line.strip())
        for part in " ".join(pieces).split("\x00"):
            held = ""
            for s in _END.split(part.strip()):
                s = f"{held} {s}".strip()
                if _ABBREVIATED.search(s):
                    held = s
                    continue
                held = ""
                if s:
                    out.append(s)
            if held:
                out.append(held)
    name = (title or "").strip().rstrip(".").lower()
    return [s for s in out if len(_WORD.findall(s)) >= 4 and s.rstrip(".").lower() != name and not regex.match(r"\d+ \p{L}+ \d+ ", s) and (s[-1] in ".!?…\"”»)" or len(s) > 60)]


def terms(sentence: str) -> set[str]:
    w = [x.lower() for x in _WORD.findall(sentence)]
    return {x for x in w if not x.isdigit()} | {f"{a} {b}" for a, b in zip(w[:-1], w[1:], strict=True)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 40) -> np.ndarray:
    """Weights (last: bias) of a logistic regression, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        slope = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


SOURCES = 16


@dataclass
class SubjectModel:
    areas: list[str]
    weights: dict[str, tuple[int, float]]  # of terms that speak for one area
    order: list[int]
    links: list[np.ndarray]
    scales: list[tuple[float, float]]
    sources: dict[str, int]

    def sentence_area(self, sentence: str) -> int:
        w = [x.lower() for x in _WORD.findall(sentence)]
        get, hits = self.weights.get, {}
        for t in w:
            if (hit := get(t)) is not None and not t.isdigit():
                hits[t] = hit
        for a, b in zip(w[:-1], w[1:], strict=True):
            if (hit := get(t := f"{a} {b}")) is not None:
                hits[t] = hit
        if not hits:
            return -1
        score: dict[int, float] = defaultdict(float)
        for t in sorted(hits):
            score[hits[t][0]] += hits[t][1]
        best = max(score, key=lambda k: (score[k], -k))
        return best if score[best] >= LEAST_SCORE else -1

    def features(self, rows: list[tuple[str | None, str | None, str | None]]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the rows with a sentence, features) of rows (text, title, source)."""
        n = len(self.areas)
        split = [sentences(text, title) for text, title, _ in rows]
        kept = [k for k, s in enumerate(split) if s]
        share, kind, structure = np.zeros((len(kept), n)), np.zeros((len(kept), SOURCES)), np.zeros((len(kept), 3))
        for i, k in enumerate(kept):
            text, title, source = rows[k]
            s = split[k]
            for a in map(self.sentence_area, s):
                if a >= 0:
                    share[i, a] += 1 / len(s)
            kind[i, self.sources.get((source or "").split("/")[0], SOURCES - 1)] = 0.3
            structure[i] = np.log1p(len(s)) / 4, min(1.0, (text or "").count("\n") / (len(s) + 1)) / 2, float(bool(title)) / 4
        # steep around the share that decides, so that a link can place its threshold
        steep = np.clip((share - SHARE) * 8, -1, 1)
        return np.array(kept, np.int64), np.hstack([share, steep, (share >= SHARE - 1e-9) * 1.0, kind, structure])

    def decode(self, x: np.ndarray) -> np.ndarray:
        """For each row the combination of labels (a boolean for each area) of greatest probability that the beam keeps."""
        n = len(x)
        logp, labels = np.zeros((n, 1)), np.zeros((n, 1, 0))
        for k, (a, w, (scale, shift)) in enumerate(zip(self.order, self.links, self.scales, strict=True)):
            own = _own(x, a, len(self.areas))
            z = (own @ w[: own.shape[1]])[:, None] + labels @ w[own.shape[1] : own.shape[1] + k] + w[-1]
            p = np.clip(_sigmoid(z * scale + shift), 1e-9, 1 - 1e-9)
            wider = np.concatenate([logp + np.log(p), logp + np.log(1 - p)], axis=1)
            both = np.concatenate([np.concatenate([labels, np.full((*labels.shape[:2], 1), y)], axis=2) for y in (1.0, 0.0)], axis=1)
            best = np.argsort(-wider, axis=1, kind="stable")[:, :BEAM]
            logp, labels = np.take_along_axis(wider, best, 1), np.take_along_axis(both, best[:, :, None], 1)
        out = np.zeros((n, len(self.areas)), bool)
        if n:
            out[:, self.order] = labels[:, 0] > 0
        return out


def _own(x: np.ndarray, area: int, n: int) -> np.ndarray:
    """Features of a link: its area's, the strongest other's, source and structure."""
    other = np.delete(x[:, :n], area, axis=1).max(axis=1, keepdims=True) if n > 1 else np.zeros((len(x), 1))
    return np.hstack([x[:, [area, n + area, 2 * n + area]], other, x[:, 3 * n :]])


def _term_weights(docs: list[tuple[list[str], set[int]]], seeds: list[list[str]], areas: int) -> dict[str, tuple[int, float]]:
    """Terms that speak for one area, from labelled documents and the areas' own words."""
    if not areas:
        return {}
    vocabulary: dict[str, int] = {}
    own = {vocabulary.setdefault(w.lower(), len(vocabulary)): a for a, words in enumerate(seeds) for w in words}
    ids, sizes, home = [], [], []
    for d, (s, _) in enumerate(docs):
        for x in s:
            known = [vocabulary.setdefault(t, len(vocabulary)) for t in sorted(terms(x))]
            ids.append(np.array(known, np.int64))
            sizes.append(len(known))
            home.append(d)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    home, v = np.array(home, np.int64), len(vocabulary)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    labels = np.zeros((len(docs), areas))
    for d, (_, marked) in enumerate(docs):
        labels[d, sorted(marked)] = 1
    part = labels / np.maximum(labels.sum(axis=1, keepdims=True), 1)
    prior = (1 + part.sum(axis=0)) / (areas + part.sum())

    def choose(counts: np.ndarray, n: np.ndarray, least: float, purity: float) -> tuple[np.ndarray, np.ndarray]:
        """(area or -1, weight) of every term."""
        area = counts[:, :areas].argmax(axis=1)
        p = (counts[np.arange(v), area] + prior[area]) / (n + 1)
        area, weight = np.where((n >= least) & (p >= purity), area, -1), np.log(p / prior[area])
        for t, k in own.items():
            area[t], weight[t] = k, max(4.0, weight[t] if area[t] == k else 0.0)
        return area, weight

    pair = np.unique(home[sentence] * v + flat) if len(flat) else np.zeros(0, np.int64)  # each term once a document
    counts = np.stack([np.bincount(pair % v, weights=part[pair // v, k], minlength=v) for k in range(areas)], axis=1) if len(pair) else np.zeros((v, areas))
    area, weight = choose(counts, counts.sum(axis=1), 2, 0.6)
    for _ in range(ROUNDS if len(flat) else 0):
        topical = area[flat] >= 0
        score = np.bincount(sentence[topical] * areas + area[flat[topical]], weights=weight[flat[topical]], minlength=len(sizes) * areas).reshape(-1, areas)
        score *= labels[home]
        best = np.where(score.max(axis=1) >= LEAST_SCORE, score.argmax(axis=1), areas)
        counts = np.bincount(flat * (areas + 1) + best[sentence], minlength=v * (areas + 1)).reshape(v, areas + 1).astype(float)
        area, weight = choose(counts, counts.sum(axis=1), 3, 0.5)
    names = list(vocabulary)
    return {names[t]: (int(area[t]), float(weight[t])) for t in np.flatnonzero(area >= 0)}


def fit(rows: list[tuple[str | None, str | None, str | None, set[str]]], areas: list[str], seeds: list[list[str]]) -> SubjectModel:
    """rows: (text, title, source, labels) of labelled documents."""
    index = {a: k for k, a in enumerate(areas)}
    docs = [(sentences(text, title), {index[x] for x in labels if x in index}) for text, title, _, labels in rows]
    keep = [k for k, (s, labels) in enumerate(docs) if s and labels]
    rows, docs = [rows[k] for k in keep], [docs[k] for k in keep]
    n = len(areas)
    common = Counter((source or "").split("/")[0] for _, _, source, _ in rows)
    sources = {k: i for i, (k, _) in enumerate(sorted(common.items(), key=lambda kv: (-kv[1], kv[0]))[: SOURCES - 1])}
    # term weights of one half serve the other, so that links see shares as they are on new documents
    half = [_term_weights([d for k, d in enumerate(docs) if k % 2 == h], seeds, n) for h in (0, 1)]
    parts = [SubjectModel(areas, w, [], [], [], sources) for w in half]
    x = np.zeros((len(rows), 3 * n + SOURCES + 3))
    for h in (0, 1):
        x[h::2] = parts[1 - h].features([r[:3] for r in rows[h::2]])[1]
    # documents without an area aren't labelled: the same documents without their topical sentences stand for them
    y = np.array([[float(a in labels) for a in range(n)] for _, labels in docs]).reshape(len(docs), n)
    blank = x.copy()
    blank[:, :n], blank[:, n : 2 * n], blank[:, 2 * n : 3 * n] = 0, -1, 0
    blank = blank[::4]
    x, y = np.r_[x, blank], np.r_[y, np.zeros((len(blank), n))]
    order = list(np.argsort(-y.sum(axis=0), kind="stable")) if len(y) else list(range(n))
    links, scales = [], []
    for k, a in enumerate(order):
        inputs = np.hstack([_own(x, a, n), y[:, order[:k]]])
        if len(inputs) < 20 or y[:, a].sum() < 3:  # too few labels: the share alone decides
            w = np.zeros(4 + SOURCES + 3 + k + 1)
            w[2], w[-1] = 8.0, -4.0
            links.append(w)
            scales.append((1.0, 0.0))
            continue
        fold = np.arange(len(inputs)) % 3
        held = np.zeros(len(inputs))
        for f in range(3):
            w = _logistic(inputs[fold != f], y[fold != f, a], 0.3)
            held[fold == f] = inputs[fold == f] @ w[:-1] + w[-1]
        scale = _logistic(held[:, None], y[:, a], 0.05)  # Platt's calibration on held-out scores
        links.append(_logistic(inputs, y[:, a], 0.3))
        scales.append((float(max(scale[0], 0.1)), float(scale[1])))
    return SubjectModel(areas, _term_weights(docs, seeds, n), order, links, scales, sources)


def fit_from(documents: DataFrame, labels: DataFrame, areas: DataFrame, most: int = FIT_DOCUMENTS) -> SubjectModel:
    listed = sorted((r["subject"], list(r["content"] or [])) for r in areas.where("subject is not null").collect())  # one row for each area
    by_doc = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    by_doc = by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text", "title", "source").join(F.broadcast(by_doc), "doc_id").orderBy("doc_id").collect()  # ``most`` labelled documents
    return fit([(r["text"], r["title"], r["source"], set(r["subjects"])) for r in rows], [a for a, _ in listed], [w for _, w in listed])


def _classifier(model_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: SubjectModel = model_b.value
        for b in batches:
            for s in range(0, len(b), 2000):
                part = b.slice(s, 2000)
                kept, x = model.features(list(zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True)))
                row, area = np.nonzero(model.decode(x))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept[row])), pa.array([model.areas[a] for a in area], pa.string())], names=["doc_id", "subject"])

    return run


def classify(documents: DataFrame, model: SubjectModel) -> DataFrame:
    """(doc_id, subject), no row for documents without an area."""
    model_b = documents.sparkSession.sparkContext.broadcast(model)
    return documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), "text", "title", "source").mapInArrow(_classifier(model_b), "doc_id bigint, subject string")


def composition(documents: DataFrame, model: SubjectModel) -> DataFrame:
    """(source, subject, documents, share): share of each area in the documents of each kind of source."""
    kind = F.coalesce(F.element_at(F.split("source", "/"), 1), F.lit("unknown"))
    total = documents.groupBy(kind.alias("source")).agg(F.count(F.lit(1)).alias("total"))
    found = classify(documents, model).distinct().join(documents.select("doc_id", kind.alias("source")), "doc_id").groupBy("source", "subject").agg(F.count(F.lit(1)).alias("documents"))
    return found.join(total, "source").select("source", "subject", "documents", (F.col("documents") / F.col("total")).alias("share"))
