"""Byte-level BPE against the tiktoken library, clustering and filter orders against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from lehrplan.llm import arrays, bpe, centroids, filters, pretokens, queries
from tests.compare import check, connect
from tests.conftest import SMALL

DOCS = "doc_id long, text string, lang string, ids string, digest string"
SIGNS = "abst'tlrevmd 's  \n\t 12١!?-é\U0001F600中 　'll've'RE"


@pytest.fixture(scope="module")
def table():
    return pretokens.classes(pretokens.class_table())


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks=bpe.read_ranks(queries.RANKS))


@pytest.fixture(scope="module")
def odd(spark):
    draw = random.Random(11)
    texts = [None, "", " ", "\n", "a", "aaaa " * 90_000, "x" * 70_000, "ab" * 30_000, " " * 5_000 + "z",
             "hello <|endoftext|> world", "don't we'll I'VE 'sa ''s", "".join(map(chr, range(0x300))),
             *["".join(draw.choice(SIGNS) for _ in range(draw.randrange(200))) for _ in range(60)],
             "same text # here", "same text # here", "same text # here", "A B C", "ONE TWO three four",
             " ".join(f"w{i}" for i in range(250)), " ".join(["w"] * 250), "\x0b\x0c\x1c x\x1fy"]
    rows = [(i, t, (None, "en", "de", "")[i % 4], "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[-4], rows[-4], (None, "same text # here", "en", "", ""), (None, "only here", None, "", ""),
             (None, "only here", None, "", ""), (None, None, "en", "", ""), (-5, "same text # here", "xx", "", "")]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.mark.parametrize("window", [24, 1 << 20])
def test_pretokens(table, window):
    pattern, draw = regex.compile(public_tokenizers.PATTERN), random.Random(window)
    for _ in range(150):
        texts = ["".join(draw.choice(SIGNS) for _ in range(draw.randrange(60))) for _ in range(12)]
        got = []
        for block in arrays.blocks(pa.array(texts)):
            for data, starts, ends in pretokens.tokens(block, table, window):
                got += [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
        assert got == [m.group() for t in texts for m in pattern.finditer(t)]


def test_scan_is_a_product():
    """The blocked scan equals one composition after the other, at lengths around its blocks."""
    draw = np.random.default_rng(1)
    for count in (0, 1, 2, 7, 8, 9, 63, 64, 65, 700):
        f = pretokens.OF_SYMBOL[draw.integers(0, 2 * pretokens.SYMBOLS, count)]
        got, state = pretokens.scan(f, width=8), np.arange(pretokens.STATES)
        for i in range(count):
            state = pretokens.FUNCTIONS[f[i]][state]
            assert (pretokens.FUNCTIONS[got[i]] == state).all()


def test_merge_like_library(library):
    draw, known = random.Random(5), bpe.vocabulary(queries.RANKS)
    pieces = [bytes(draw.choice(b"abe \xc3\xa9tion") for _ in range(draw.randrange(1, 150)))
              for _ in range(400)]
    ids, count = known.merge(pieces)
    ends = np.cumsum(count)
    for piece, end, n in zip(pieces, ends, count):
        assert list(ids[end - n:end]) == library._encode_single_piece(piece)


def test_cache_is_confirmed_by_bytes():
    """Pre-tokens with one hash stay apart, and a cache that starts anew forgets nothing it needs."""
    seen = []

    def encode(new):
        seen.extend(new)
        return np.array([int(p) for p in new]), np.ones(len(new), np.int64)

    data = np.frombuffer(b"".join(b"%04d" % (i % 50) for i in range(400)), np.uint8)
    starts = np.arange(0, len(data), 4)
    pieces, one_hash = bpe.Pieces(encode, cached=60), pretokens.hashes
    try:
        pretokens.hashes = lambda data, starts, ends: np.zeros(len(starts), np.uint64)
        for _ in range(3):
            ids, count = pieces(data, starts, starts + 4)
            assert (ids == np.arange(400) % 50).all() and (count == 1).all()
    finally:
        pretokens.hashes = one_hash
    assert len(seen) == 50


def test_bpe(odd, library):
    rows = Counter((r["doc_id"], r["text"]) for r in odd.collect())
    encoded = bpe.encode(odd, queries.RANKS).cache()
    want = Counter()
    for (doc, text), n in rows.items():
        want[doc, tuple(library.encode_ordinary(text or ""))] += n
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == want
    known = bpe.vocabulary(queries.RANKS)
    for r in encoded.collect():
        sizes = [int(known.sizes[i]) for i in r["ids"]]
        assert r["offsets"] == [sum(sizes[:i]) for i in range(min(len(sizes), 300))] + \
            r["offsets"][300:]
    decoded = bpe.decode(encoded, queries.RANKS)
    texts = Counter()
    for (doc, text), n in rows.items():
        texts[doc, (text or "").encode()] += n
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in decoded.collect()) == texts
    # a run of tokens decodes into its bytes
    run = encoded.where("size(ids) > 9").select("doc_id", F.slice("ids", 3, 5).alias("ids"),
                                                F.slice("offsets", 3, 5).alias("offsets"))
    text = {d: (t or "").encode() for d, t in rows}
    for r in bpe.decode(run, queries.RANKS).collect():
        if r["doc_id"] is not None:
            a = r["offsets"][0]
            assert bytes(r["decoded"]) == text[r["doc_id"]][a:a + len(r["decoded"])]
    assert bpe.decode(bpe.encode(odd.limit(0), queries.RANKS), queries.RANKS).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(odd.limit(1).select("doc_id", F.array(F.lit(50256)).alias("ids"),
                                       F.array(F.lit(0)).alias("offsets")), queries.RANKS).collect()


def brute_clusters(vectors, k, rounds):
    hashed = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "~", v)
                    for i, v in vectors)
    means = [list(v) for _, v in hashed[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(means))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in vectors]
        for c in range(len(means)):
            mine = [v for (_, v), o in zip(vectors, own) if o == c]
            if mine:
                means[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, *reversed(nearest(v))) for i, v in vectors], means


def test_centroids(spark):
    draw, inf = np.random.default_rng(3), float("inf")
    rows = [(i, [float(x) for x in draw.normal(i % 3, 1, 4)], "clash") for i in range(60)]
    rows += [(60, None, ""), (61, [], ""), (62, [1.0] * 3, ""), (63, [1.0, None, 2.0, 3.0], ""),
             (64, [1.0, inf, 2.0, 3.0], ""), (65, [float("nan")] * 4, ""), (66, [0.0] * 4, ""),
             (None, [1.0, -1.0, 0.5, 0.0], ""), rows[0], rows[0], (67, [1e30, -1e30, 0.0, -0.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    limit = 1 << 27
    kept = [(i, [max(-limit, min(limit, int(np.floor(min(max(1024 * x, -2.0**40), 2.0**40))))) for x in v])
            for i, v, _ in rows if v and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    for k, rounds in ((3, 4), (8, 10), (200, 2)):
        want, means = brute_clusters(kept, k, rounds)
        got = centroids.cluster(df, k, rounds, dimensions=4).collect()
        assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == Counter(want)
        total = Counter()
        for _, c, d in want:
            total[c] += d
        assert all(r["cluster_inertia"] == total[r["cluster"]] and r["inertia"] == sum(total.values())
                   and r["centroid"] == means[r["cluster"]] for r in got)
    assert centroids.cluster(df.limit(0)).count() == 0
    # two equal starting vectors: the second cluster stays empty and where it is
    twins = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {(r["cluster"], r["distance"]) for r in centroids.cluster(twins, 2, dimensions=2).collect()} == {(0, 0)}


def test_centroid_query_uses_no_python(spark):
    plan = centroids.assign(spark.createDataFrame([(1, [1, 2], 5)], "vec_id long, vector array<long>, square long"),
                            [[0, 0], [3, 3]])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_audit(rows, labels):
    found, good, toxic = [], Counter(), Counter()
    for doc, q, t in labels:
        good[doc] |= q == 1
        toxic[doc] |= t == 1
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    for doc, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)),
                 "E": text in first and (doc is None or first[text] < doc)}
        found.append((lang or "", {k for k in fails if fails[k]}, int(good[doc]) if doc is not None else 0,
                      int(toxic[doc]) if doc is not None else 0))
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        for step, own in enumerate(order):
            before = set(order[:step])
            for part in {p for p, *_ in found}:
                mine = [(f, g, t) for p, f, g, t in found if p == part]
                gone = [(f, g, t) for f, g, t in mine if own in f and not f & before]
                out[part, "".join(order), step + 1] = [
                    sum(not f & (before | {own}) for f, *_ in mine), len(gone),
                    sum(own in f and bool(f & before) for f, *_ in mine),
                    sum(f == {own} for f, *_ in mine), sum(g for _, g, _ in gone),
                    sum(t for *_, t in gone)]
                shapley[part, own] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filters(spark, odd):
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 80, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (7, None, 1)]
    table = spark.createDataFrame([(i, q, None if t is None else int(t), "x") for i, q, t in labels],
                                  "doc_id long, quality int, toxic int, part string")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names)
           for r in filters.audit(odd, table).collect()}
    assert got == brute_audit(rows, labels)
    assert filters.audit(odd.limit(0), table).count() == 0
    assert filters.audit(odd, table.limit(0)).where("good_lost > 0").count() == 0


def test_transducer_of_long_rows(monkeypatch):
    """A row longer than a window gives the same counts, words across windows counted once."""
    draw = random.Random(2)
    text = "".join(draw.choice("ab É#X \t") for _ in range(5000)) + "w" * 300 + " end"
    block = next(arrays.blocks(pa.array([text])))
    want = [int(x[0]) for x in filters.measured(block)]
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert want == [len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), len(text),
                    sum(c in "#$%&*|" for c in text)]
    monkeypatch.setattr(filters, "WINDOW", 64)
    assert [int(x[0]) for x in filters.measured(block)] == want


def test_equal_spans_with_one_hash():
    """The table decides by bytes: equal hashes of different words keep them apart."""
    words = [b"alpha", b"beta", b"alpha", b"a" * 400, b"a" * 399 + b"b", b"a" * 400, b"beta"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    owner = arrays.first_equal(data, starts, ends, np.full(len(words), 7, np.uint64))
    assert all((owner[i] == owner[j]) == (words[i] == words[j])
               for i in range(len(words)) for j in range(len(words)))


@pytest.mark.parametrize("name", ["op12_integer_centroids", "op13_byte_transducer"])
def test_against_sql(spark, name):
    from lehrplan.llm.oracle import ORACLE
    assert check(spark, connect(SMALL), SMALL, name, queries.QUERIES, ORACLE) is None


def test_bpe_query(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = Counter()
    for r in docs:
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    got = queries.op11_transition_scan(spark, SMALL).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
