"""Hierarchical language identification.

Features are counts of byte bigrams and trigrams of letters, hashed into a fixed number of
columns. A linear model for each family against the rest decides the family first; inside it
one linear support vector machine for every pair of languages votes. The models learn from a
bounded sample of labelled documents, drawn by a hash of doc_id (`SAMPLE` documents of a
language are expected), and are small enough to travel with the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lehrplan.llm import arrays as A

COLUMNS = 1 << 12
SAMPLE = 600
ROWS = 256  # rows of a block: a row of features is dense
UNKNOWN = "und"

# families of ISO 639-1 codes (fixed values); other codes are families of their own
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv", "celtic": "br cy ga gd gv kw", "hellenic": "el",
    "uralic": "et fi hu se", "turkic": "az kk ky tk tr tt uz",
    "iranian": "fa ku ps tg", "indic": "as bn gu hi mr ne or pa sa sd si ur",
    "dravidian": "kn ml ta te", "semitic": "am ar he mt", "sinitic": "zh yue",
    "austronesian": "id jv mg mi ms su tl", "japonic": "ja", "koreanic": "ko",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_MAP = np.full(256, 32, np.uint8)
_MAP[65:91] = np.arange(97, 123)
_MAP[97:123] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)


def features(block: A.Block, columns: int = COLUMNS) -> np.ndarray:
    """Unit rows of damped n-gram counts, shape (rows, columns)."""
    data = _MAP[block.data]
    after_c3 = np.zeros(len(data), bool)
    after_c3[1:] = data[:-1] == 0xC3
    data = np.where(after_c3 & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), data + 32, data)
    row = np.repeat(np.arange(block.rows), np.diff(block.offsets))
    wide = data.astype(np.uint32)
    out = np.zeros((block.rows, columns), np.float32)
    for size in (2, 3):
        if len(wide) < size:
            continue
        name = np.full(len(wide) - size + 1, size, np.uint32)
        for j in range(size):
            name = (name * np.uint32(0x01000193)) ^ wide[j:len(wide) - size + 1 + j]
        name = (name * np.uint32(0x9E3779B1)) >> np.uint32(32 - columns.bit_length() + 1)
        first = row[:len(name)]
        whole = (first == row[size - 1:]) & ((data[:len(name)] != 32) | (data[1:len(name) + 1] != 32))
        at = first[whole] * columns + name[whole]
        out += np.bincount(at, minlength=block.rows * columns).reshape(block.rows, columns)
    out = np.log1p(out)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(length, 1e-9)


def lettered(block: A.Block) -> np.ndarray:
    """Which rows hold a letter of any script."""
    ascii_letter = (_MAP[block.data] != 32) & (block.data < 128)
    sums = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = sums[block.offsets[1:]] > sums[block.offsets[:-1]]
    for i in np.flatnonzero(~out):
        raw = block.data[block.offsets[i]:block.offsets[i + 1]].tobytes()
        out[i] = any(c.isalpha() for c in raw.decode("utf-8", "replace"))
    return out


def _machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 80) -> np.ndarray:
    """Linear support vector machine with squared hinge; the last weight is the bias.

    Both classes weigh the same. Accelerated gradient steps of fixed number and size: the
    outcome does not depend on how rows were partitioned beyond their order, which is fixed.
    """
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    share = share.astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    last, t = w, 1.0
    look = w
    for _ in range(steps):
        margin = 1 - y * (x @ look[:-1] + look[-1])
        pull = share * y * np.maximum(margin, 0)
        slope = np.append(-2 * (x.T @ pull), -2 * pull.sum()).astype(np.float32) + penalty * look
        w = look - 0.24 * slope  # unit rows with a bias: the curvature is at most 4
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = w + (t - 1) / ahead * (w - last)
        last, t = w, ahead
    return w


@dataclass
class Model:
    """Weights by family and by pair of languages of one family."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family: np.ndarray | None = None
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    columns: int = COLUMNS

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of every row."""
        one = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
        if len(self.families) > 1:
            chance = _sigmoid(one @ self.family.T)
            best = chance.argmax(axis=1)
            score = chance[np.arange(len(x)), best] / np.maximum(chance.sum(axis=1), 1e-9)
        else:
            best, score = np.zeros(len(x), int), np.ones(len(x))
        names = np.empty(len(x), object)
        for k, family in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            langs = self.members[family]
            votes = np.zeros((len(rows), len(langs)))
            for (i, a), (j, b) in combinations(enumerate(langs), 2):
                p = _sigmoid(one[rows] @ self.pairs[a, b])
                votes[:, i] += p
                votes[:, j] += 1 - p
            win = votes.argmax(axis=1)
            names[rows] = np.array(langs, object)[win]
            if len(langs) > 1:
                score[rows] *= votes[np.arange(len(rows)), win] / (len(langs) - 1)
        return names, np.clip(score, 0.0, 1.0)


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-3.0 * np.clip(margin, -10, 10)))


def _examples(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in A.blocks(A.column(batch, "text"), most=ROWS):
            x, there = features(block, columns), lettered(block)
            at, values = [], []
            for i in range(block.rows):
                used = np.flatnonzero(x[i]) if there[i] else np.zeros(0, int)
                at.append(used.astype(np.int32))
                values.append(x[i, used])
            own = [A.column(batch, c).slice(block.first, block.rows) for c in ("doc_id", "lang")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
                ["doc_id", "lang", "at", "value"])


def train(labelled: DataFrame, sample: int = SAMPLE, columns: int = COLUMNS) -> Model:
    """Learn from ``doc_id, text, lang``; rows with a null in any of them are left out.

    Of every language about ``sample`` documents are taken (all, if there are fewer), chosen by
    a hash of doc_id; they reach the driver as sparse features. Without rows the model knows no
    language.
    """
    rows = labelled.where("doc_id is not null and text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model(columns=columns)
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n)))
                         for lang, n in sorted(sizes.items())])
    draw = (F.xxhash64("doc_id").cast("double") / F.lit(2.0 ** 64)) + 0.5
    got = (rows.where(draw < share).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
           .mapInArrow(partial(_examples, columns=columns),
                       "doc_id long, lang string, at array<int>, value array<float>")
           .where(F.size("at") > 0).toArrow().to_pylist())
    got.sort(key=lambda r: (r["lang"], r["doc_id"], len(r["at"])))
    x = np.zeros((len(got), columns), np.float32)
    for i, r in enumerate(got):
        x[i, r["at"]] = r["value"]
    lang = np.array([r["lang"] for r in got])
    known = sorted(set(lang))
    home = {c: FAMILY_OF.get(c.lower().split("-")[0], c) for c in known}
    model = Model(families=sorted(set(home.values())), columns=columns)
    model.members = {f: [c for c in known if home[c] == f] for f in model.families}
    family = np.array([home[c] for c in lang])
    rest = model.families[1:] if len(model.families) == 2 else model.families
    if len(model.families) > 1:
        found = [_machine(x, np.where(family == f, 1, -1).astype(np.float32)) for f in rest]
        model.family = np.stack([-found[0], *found] if len(rest) == 1 else found)
    for langs in model.members.values():
        for a, b in combinations(langs, 2):
            two = (lang == a) | (lang == b)
            model.pairs[a, b] = _machine(x[two], np.where(lang[two] == a, 1, -1).astype(np.float32))
    return model


def _predict(batches: Iterator[pa.RecordBatch], model: Model, keep: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = np.full(batch.num_rows, UNKNOWN, object)
        scores = np.zeros(batch.num_rows)
        if model.families:
            for block in A.blocks(A.column(batch, "text"), most=ROWS):
                there = lettered(block)
                name, score = model.predict(features(block, model.columns))
                rows = slice(block.first, block.first + block.rows)
                names[rows] = np.where(there, name, UNKNOWN)
                scores[rows] = np.where(there, score, 0.0)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:keep], pa.array(names.tolist(), pa.string()), pa.array(scores)],
            [*batch.schema.names[:keep], "_language", "_score"])


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None,
             names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns (doc_id), language and score (0 to 1) of every row, from its text alone.

    A null text, one without a letter, and any text under a model that knows no language is
    `und` with score 0. An empty table gives an empty result.
    """
    keep = keep or ["doc_id"]
    wanted = docs.select(*[F.col(f"`{c}`") for c in keep + ["text"] * ("text" not in keep)])
    schema = StructType([wanted.schema[c] for c in keep] +
                        [StructField("_language", StringType()), StructField("_score", DoubleType())])
    out = wanted.mapInArrow(partial(_predict, model=model, keep=len(keep)), schema)
    return out.withColumnsRenamed({"_language": names[0], "_score": names[1]})
